"""Periodic runs of words by maximal pairs.

A run of period q that is l words long puts two suffixes q words apart that agree on l - q words: a maximal pair, which
neither a word more to the left nor one more to the right keeps. So runs need no search for their ends. For every text:

1. words become numbers and suffixes are sorted by doubling, only those that still share their beginning with another;
2. the intervals of common prefixes are built bottom-up over the sorted suffixes. Each holds its suffixes' places in order,
   and with each place the class of the word left of it. Where two intervals join, places of one are looked up among those
   of the other; neighbours of different classes that are near enough for the length they share are a run;
3. pairs at a multiple of the period have the same ends as the run and give way to the smallest distance.

Two places of one interval that agree on three periods or more have no third place of it between them unless the period is
smaller, so only neighbours are looked at and an interval of many places costs a search for each place of its smaller part.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidepanel.llm.common import binaries, chunks, expand, joined_words, map_arrow, refuse_clash, text_buffers, words_of

#: A run has this many words at least, and this many periods.
MIN_LENGTH, MIN_PERIODS = 6, 4

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def prefix_ranks(word: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Rank of every suffix by its first 1, 2, 4, ... words; texts never mix. Two suffixes have equal ranks if they agree
    that far. The last ranks are all different. Every array has one more entry, which equals no other."""
    n = len(word)
    _, kind, count = np.unique(text * (int(word.max(initial=0)) + 1) + word, return_inverse=True, return_counts=True)
    first = np.cumsum(count) - count
    rank = np.append(first[kind], -1).astype(np.int32)
    ranks, reach = [rank], 1
    open_ = np.flatnonzero(count[kind] > 1)
    while open_.size:
        mine = rank[open_].astype(np.int64)
        key = mine * (n + 1) + rank[np.minimum(open_ + reach, n)] + 1
        order = np.argsort(key, kind="stable")
        key, mine, open_ = key[order], mine[order], open_[order]
        place = np.arange(len(open_))
        starts_class = np.concatenate(([True], mine[1:] != mine[:-1]))
        starts = np.concatenate(([True], key[1:] != key[:-1]))
        class_at = np.maximum.accumulate(np.where(starts_class, place, 0))
        at = np.maximum.accumulate(np.where(starts, place, 0))
        rank = rank.copy()
        rank[open_] = mine + at - class_at
        ranks.append(rank)
        reach *= 2
        alone = starts & np.append(starts[1:], True)
        open_ = open_[~alone]
    return ranks


def common_prefixes(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at two places agree on."""
    shared = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank = ranks[level]
        shared += (rank[a + shared] == rank[b + shared]).astype(np.int64) << level
    return shared


class Intervals:
    """Bottom-up joining of the intervals of one chain of sorted suffixes; ``runs`` maps (start, end) to the period."""

    def __init__(self, left: list[int], min_length: int, min_periods: int) -> None:
        self.left, self.min_length, self.repeats = left, min_length, min_periods - 1
        self.runs: dict[tuple[int, int], int] = {}

    def pair(self, i: int, j: int, shared: int) -> None:
        distance = j - i
        if distance * self.repeats <= shared and distance + shared >= self.min_length and self.left[i] != self.left[j]:
            key = i, j + shared
            self.runs[key] = min(self.runs.get(key, distance), distance)

    def join(self, one: list[int], other: list[int], shared: int) -> list[int]:
        """The places of both in order, after the pairs of neighbours across them."""
        many, few = (one, other) if len(one) >= len(other) else (other, one)
        for place in few:
            k = bisect_left(many, place)
            if k:
                self.pair(many[k - 1], place, shared)
            if k < len(many):
                self.pair(place, many[k], shared)
        if len(few) * 8 < len(many):
            for place in few:
                insort(many, place)
        else:
            many += few
            many.sort()
        return many

    def chain(self, places: list[int], shared: list[int]) -> None:
        """Sorted suffixes, and what each shares with the next one."""
        held: list[tuple[int, list[int]]] = []
        now = [places[0]]
        for place, common in zip(places[1:], shared):
            while held and held[-1][0] > common:
                value, before = held.pop()
                now = self.join(before, now, value)
            if held and held[-1][0] == common:
                now = self.join(held.pop()[1], now, common)
            held.append((common, now))
            now = [place]
        while held:
            value, before = held.pop()
            now = self.join(before, now, value)


def find_runs(word: np.ndarray, at: np.ndarray, min_length: int = MIN_LENGTH, min_periods: int = MIN_PERIODS) -> np.ndarray:
    """All runs as rows (start, length, period), by start and period, of texts whose word numbers stand one behind the
    other with these offsets; starts count from the first text's first word."""
    none = np.zeros((0, 3), np.int64)
    n = len(word)
    if not n:
        return none
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ranks = prefix_ranks(word, text)
    distance = np.arange(1, min_length + 1)
    least = int(np.maximum(min_length - distance, (min_periods - 1) * distance).min())  # what the pair of any run shares
    level = min(least.bit_length() - 1, len(ranks) - 1)
    seen = np.bincount(ranks[level][:n], minlength=n)
    open_ = np.flatnonzero(seen[ranks[level][:n]] > 1)
    if not open_.size:
        return none
    order = open_[np.argsort(ranks[-1][open_])]
    shared = np.append(common_prefixes(ranks, order[:-1], order[1:]), 0)
    # chains of suffixes that share enough; one without two places near enough for its longest prefix has no run
    chain = np.concatenate(([0], np.cumsum(shared[:-1] < least)))
    first = np.flatnonzero(np.diff(chain, prepend=-1))
    longest = np.maximum.reduceat(np.where(shared >= least, shared, 0), first)
    by_place = np.lexsort((order, chain))
    gap = np.diff(order[by_place], append=n)
    gap[np.append(first[1:], len(order)) - 1] = n
    nearest = np.minimum.reduceat(gap, first)
    left = np.concatenate(([-1], ranks[0][:n - 1]))
    left[at[:-1][np.diff(at) > 0]] = -1
    found = Intervals(left.tolist(), min_length, min_periods)
    last = np.append(first[1:], len(order))
    for c in np.flatnonzero(nearest * (min_periods - 1) <= longest).tolist():
        a, b = first[c], last[c]
        found.chain(order[a:b].tolist(), shared[a:b - 1].tolist())
    if not found.runs:
        return none
    out = np.array([(start, end - start, period) for (start, end), period in found.runs.items()], np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def repeat_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), min_length: int = MIN_LENGTH,
                min_periods: int = MIN_PERIODS) -> DataFrame:
    """Runs of every text and the text without their repetitions: (doc_id, kept columns, n_words, runs, collapsed).

    Words are the longest stretches without ASCII white space. A run is a stretch of words with smallest period ``period`` that
    no neighbouring word extends, at least ``min_length`` words and ``min_periods`` periods long; ``runs`` is an array of
    (start, length, period) by start and period. ``collapsed`` holds the words that no run has behind its first period,
    with one space between them.

    Null, empty and wordless texts have no run and an empty ``collapsed``. Every row is a text of its own, also with a
    repeated or null id. Kept columns must not have an output's name (ValueError); others are not read. An empty table
    gives an empty one. A text is worked on whole, in one task, with about 200 bytes for each of its words.
    """
    outputs = ("n_words", "runs", "collapsed")
    refuse_clash(keep, doc_id, *outputs)
    if min_periods < 2 or min_length < 2:
        raise ValueError("a run has two periods and two words at least")
    kinds = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in chunks(offsets):
                raw = data[offsets[i]:offsets[j]]
                start, length, at = words_of(raw, offsets[i:j + 1] - offsets[i], _WORD)
                words, word_at = joined_words(raw, start, length)
                number = binaries(words, word_at).dictionary_encode().indices.to_numpy().astype(np.int64)
                runs = find_runs(number, at, min_length, min_periods)
                change = np.zeros(len(start) + 1, np.int64)
                np.add.at(change, runs[:, 0] + runs[:, 2], 1)
                np.add.at(change, runs[:, 0] + runs[:, 1], -1)
                stays = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                left = np.searchsorted(stays, at)
                size = np.diff(word_at)[stays]
                bytes_at = np.concatenate(([0], np.cumsum(size)))[left]
                text_out = words[expand(word_at[:-1][stays], size)]
                # the space behind a text's last word goes
                filled = np.diff(left) > 0
                text_out = np.delete(text_out, bytes_at[1:][filled] - 1)
                bytes_at = bytes_at - np.concatenate(([0], np.cumsum(filled)))
                owner = np.searchsorted(at, runs[:, 0], "right") - 1
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(runs[:, 0] - at[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(kinds)))
                collapsed = binaries(text_out, bytes_at).cast(pa.large_string()).cast(pa.string())
                rows = [column.slice(i, j - i) for column in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(np.diff(at)), lists, collapsed], names=[doc_id, *keep, *outputs])

    source = docs.select(text, doc_id, *keep)
    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (doc_id, *keep)]
    return map_arrow(source, work, ", ".join([*kept, "n_words long", "runs array<struct<start:long,length:long,period:long>>", "collapsed string"]))
