"""Importance resampling of documents towards a target corpus by hashed word features.

Texts are cut at newlines. Over the whole corpus equal lines are one row with their number, so a line's features are taken
once and count as often as the line occurs; runs of words that cross a newline belong to no line and are added
separately. The same holds for a document's weight: the distinct lines of a chunk are scored once, and a text adds up
its lines and what crosses them. Feature counts are a fixed number of buckets; nothing else leaves the executors. The draw
ranks documents by weight plus a Gumbel variate of their id, which is sampling without replacement in proportion to the weights.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import binaries, chunks, expand, joined_words, map_arrow, numbered, stored, sums, text_buffers, words_of

#: Longest run of words that is a feature.
ORDER = 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(data: np.ndarray, offsets: np.ndarray, order: int, buckets: int, crossing: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature, the offsets of the texts in them, and the number of words of each text. With ``crossing``
    only the runs that a newline divides."""
    data = _LOWER[data]
    start, length, at = words_of(data, offsets, _WORD)
    words, word_at = joined_words(data, start, length)
    line = np.searchsorted(np.flatnonzero(data == 0x0A), start)
    ends = np.repeat(at[1:], np.diff(at))
    first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for more in range(int(crossing), order):
        begin = np.flatnonzero(np.arange(len(start)) + more < ends)
        if crossing:
            begin = begin[line[begin] != line[begin + more]]
        first.append(begin)
        last.append(begin + more)
    begin, end = np.concatenate(first), np.concatenate(last)
    sorted_ = np.argsort(begin, kind="stable")
    begin, end = begin[sorted_], end[sorted_]
    size = word_at[end + 1] - 1 - word_at[begin]
    grams = words[expand(word_at[begin], size)]
    coded = binaries(grams, np.concatenate(([0], np.cumsum(size)))).dictionary_encode()
    bucket = np.array([zlib.crc32(g) % buckets for g in coded.dictionary.to_pylist()], np.int64)
    return bucket[coded.indices.to_numpy()], np.searchsorted(begin, at), np.diff(at)


def bucket_counts(texts: DataFrame, text: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket; null texts have none."""

    def totals(batches: Iterator[pa.RecordBatch], crossing: bool) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            times = batch.column(1).to_numpy()
            for i, j in chunks(offsets):
                found, at, _ = features(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], order, buckets, crossing)
                by_time = np.repeat(times[i:j], np.diff(at))
                for n in np.unique(by_time).tolist():  # whole numbers, few different ones
                    total += n * np.bincount(found[by_time == n], minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    texts = texts.select(F.col(text).alias("text")).filter("text is not null")
    lines = texts.select(F.explode(F.split("text", "\n", -1)).alias("line")).groupBy("line").agg(F.count("*").alias("times"))
    found = map_arrow(lines, lambda batches: totals(batches, False), "bucket long, n long")
    if order > 1:
        whole = texts.filter(F.contains("text", F.lit("\n"))).select("text", F.lit(1).cast("long"))
        found = found.union(map_arrow(whole, lambda batches: totals(batches, True), "bucket long, n long"))
    out = np.zeros(buckets, np.int64)
    for row in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which a feature of each bucket is likelier in the target, with one added to every count."""
    whole, wanted = int(source.sum()) + len(source), int(target.sum()) + len(target)
    ratio = (target + 1.0) * whole / ((source + 1.0) * wanted)
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def gumbel(seed: int, doc_id: int | str | None) -> int:
    """Thousandths of a standard Gumbel variate of an id; a null id is the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document: the floored mean gain of its features, 0 without
    any, and that plus its Gumbel variate."""
    shipped = docs.sparkSession.sparkContext.broadcast(gains)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shipped.value

        def sums_of(data: np.ndarray, offsets: np.ndarray, crossing: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            bucket, at, words = features(data, offsets, order, len(gain), crossing)
            return words, np.diff(at), sums(gain[bucket], at)

        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                raw, at = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
                # lines with the newline or the text's end behind them
                cut = np.union1d(at, np.flatnonzero(raw == 0x0A) + 1)
                coded = binaries(raw, cut).dictionary_encode()
                which = coded.indices.to_numpy()
                distinct, distinct_at = text_buffers(coded.dictionary.cast(pa.large_binary()))
                line_at = np.searchsorted(cut, at)
                words, size, total = (sums(part[which], line_at) for part in sums_of(distinct, distinct_at, False))
                if order > 1:
                    _, more, extra = sums_of(raw, at, True)
                    size, total = size + more, total + extra
                weight = np.where(size > 0, total // np.maximum(size, 1), 0)
                ids = batch.column(0).slice(i, j - i)
                score = weight + np.array([gumbel(seed, x) for x in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, size, weight, score))], names=[doc_id, "n_words", "n_features", "weight", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(doc_id, text), work, f"`{doc_id}` {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", order: int = ORDER,
             buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document with its weight towards the target texts and its place in the draw: (doc_id, n_words, n_features,
    weight, score, rank).

    Features are the runs of 1 to ``order`` words, A-Z lower-cased, counted in hashed buckets. Of the documents with
    ``min_words`` words, ``percent`` in a hundred (rounded down) with the highest scores are drawn; ``rank`` numbers
    them, ties by smaller id, a null id last, and is null for all others.

    Null, empty and wordless texts have no features and weight 0. Every row is a document; rows with one id have one
    variate, and which of rows that are equal in score and id comes first is left open. Other columns are not read.
    Empty tables are corpora without features.
    """
    gains = bucket_gains(bucket_counts(docs, text, order, buckets), bucket_counts(target, target_text, order, buckets))
    scored = stored(score_documents(docs, gains, doc_id, text, order, seed), "scores")
    open_ = F.col("n_words") >= min_words
    # scores are whole numbers within some tens of thousands of 0, whatever the corpus
    counts = {r["score"]: r["n"] for r in scored.filter(open_).groupBy("score").agg(F.count("*").alias("n")).collect()}
    wanted = percent * sum(counts.values()) // 100
    reached, least = 0, None
    for score in sorted(counts, reverse=True):
        if reached >= wanted:
            break
        reached, least = reached + counts[score], score
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if least is None:
        return none
    drawn = open_ & (F.col("score") >= least)
    first = scored.filter(drawn).withColumn("row", F.monotonically_increasing_id())
    ranked = numbered(first, [F.col("score").desc(), F.col(doc_id).asc_nulls_last(), F.col("row").asc()], "rank").drop("row")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return none.filter(~drawn).unionByName(ranked)
