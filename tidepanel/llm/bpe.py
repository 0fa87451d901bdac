"""Byte-level BPE on whole batches: pre-tokens are cut with array operations on the UTF-8 bytes of many texts at once,
and distinct pre-tokens are merged together. Results equal the public tokenizer's for the same vocabulary file."""

from __future__ import annotations

import functools
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa

from tidepanel.llm.common import expand

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Words above this size are merged one by one with a heap, so that their cost stays n log n.
LONG_WORD = 512

# The white space code points of the pre-tokenizer, its contractions, and its special token.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = [b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"]
SPECIAL = b"<|endoftext|>"


@functools.cache
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for cp in range(0x110000):
        kind = kinds.get(unicodedata.category(chr(cp))[0])
        if kind:
            table[cp] = kind
    table[WHITE_SPACE] = SPACE
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character that every byte of UTF-8 belongs to."""
    table = classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if lead.size:
        at = lambda k: data.take(lead + k, mode="clip").astype(np.int32) & 0x3F
        b0 = data[lead].astype(np.int32)
        two, four = b0 < 0xE0, b0 >= 0xF0
        cp = np.where(two, (b0 & 0x1F) << 6 | at(1),
                      np.where(four, (b0 & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3), (b0 & 0x0F) << 12 | at(1) << 6 | at(2)))
        kind = table[np.minimum(cp, 0x10FFFF)]
        out[lead] = kind
        out[lead + 1] = kind
        out[lead[~two] + 2] = kind[~two]
        out[lead[four] + 3] = kind[four]
    return out


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every pre-token of texts that lie one behind the other; no pre-token crosses a text's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = byte_classes(data)
    fence = np.zeros(n + 1, bool)
    fence[offsets] = True
    special = find_special(data, fence)
    for at in special:
        fence[at] = fence[at + len(SPECIAL)] = True
    mark = fence[:n].copy()
    mark[1:] |= kind[1:] != kind[:-1]
    mark[0] = True
    # the last white space before a word: a blank joins the word, another one is a pre-token of its own
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~fence[1:n]) + 1
    last = after - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    mark[last] = True
    mark[after[data[last] == 0x20]] = False
    # contractions: an apostrophe that opens a pre-token
    quote = np.flatnonzero(data == 0x27)
    quote = quote[mark[quote]]
    if quote.size:
        for tail in CONTRACTIONS:
            hit = quote[quote + len(tail) < n]
            for k, byte in enumerate(tail):
                hit = hit[(data[hit + 1 + k] == byte) & ~fence[hit + 1 + k]]
            mark[hit + 1] = False
            mark[(hit + 1 + len(tail))[hit + 1 + len(tail) < n]] = True
    for at in special:
        mark[at] = True
        mark[at + 1:at + len(SPECIAL)] = False
    return np.flatnonzero(mark)


def find_special(data: np.ndarray, fence: np.ndarray) -> list[int]:
    """Places of the special token, none across a text's end."""
    raw, found, at = data.tobytes(), [], 0
    while (at := raw.find(SPECIAL, at)) >= 0:
        if fence[at + 1:at + len(SPECIAL)].any():
            at += 1
        else:
            found.append(at)
            at += len(SPECIAL)
    return found


def distinct_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Code of each pre-token and the distinct pre-tokens by code."""
    offsets = np.append(starts, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
    encoded = words.dictionary_encode()
    return encoded.indices.to_numpy(), encoded.dictionary


class Vocabulary:
    """Merges and token bytes of a byte-level BPE file (``tokenizers`` format)."""

    def __init__(self, content: str) -> None:
        model = json.loads(content)
        self.special_id = next(t["id"] for t in model["added_tokens"] if t["content"].encode() == SPECIAL)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(printable)]
        letter = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
        self.tokens: list[bytes] = [b""] * (max([self.special_id, *vocab.values()]) + 1)
        for text, i in vocab.items():
            self.tokens[i] = bytes(letter[c] for c in text)
        self.tokens[self.special_id] = SPECIAL
        self.base = np.zeros(256, np.int32)
        for text, b in letter.items():
            self.base[b] = vocab[text]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = left << 20 | right
        self.slots = _hash_table(key)
        self.key, self.rank, self.made = key, np.arange(len(key), dtype=np.int32), made
        self.ranks = {int(k): r for r, k in enumerate(key)}
        self.decimal = [str(i) for i in range(len(self.tokens))]

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; a large number where the pair has none."""
        key = left.astype(np.int64) << 20 | right
        out = np.full(len(key), NO_RANK, np.int32)
        at, open_ = _slot(key, len(self.slots)), np.arange(len(key))
        while open_.size:
            rank = self.slots[at]
            hit = rank >= 0
            same = hit & (self.key[rank] == key[open_])
            out[open_[same]] = rank[same]
            go = hit & ~same
            open_, at = open_[go], (at[go] + 1) & (len(self.slots) - 1)
        return out

    def merge(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every word one behind the other, and the offsets of the words."""
        words = words.cast(pa.large_binary())
        count = len(words)
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + count + 1]
        if not count:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
        offsets = offsets - offsets[0]
        size = np.diff(offsets)
        single: dict[int, list[int]] = {int(w): self.merge_long(words[int(w)].as_py()) for w in np.flatnonzero(size > LONG_WORD)}
        for w in np.flatnonzero(size == len(SPECIAL)):
            if words[int(w)].as_py() == SPECIAL:
                single[int(w)] = [self.special_id]
        keep = np.ones(count, bool)
        keep[list(single)] = False
        active = np.flatnonzero(keep)
        owner = np.repeat(active, size[active])
        symbol = self.base[data[expand(offsets[:-1][active], size[active])]]
        done_symbol, done_owner = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        rank = np.full(len(symbol), NO_RANK, np.int32)  # of the pair that starts at each symbol
        if len(symbol):
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.lookup(symbol[inside], symbol[inside + 1])
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            length = np.diff(np.append(first, len(symbol)))
            least = np.minimum.reduceat(rank, first)
            if (least == NO_RANK).any():
                over = np.repeat(least == NO_RANK, length)
                done_symbol.append(symbol[over])
                done_owner.append(owner[over])
                symbol, owner, rank = symbol[~over], owner[~over], rank[~over]
                length, least = length[least != NO_RANK], least[least != NO_RANK]
                if not len(symbol):
                    break
            hit = rank == np.repeat(least, length)
            # of overlapping hits every second one counts, from the left
            where = np.flatnonzero(hit)
            run = np.concatenate(([True], np.diff(where) != 1))
            nth = np.arange(len(where)) - np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
            where = where[nth % 2 == 0]
            symbol[where] = self.made[rank[where]]
            stay = np.ones(len(symbol), bool)
            stay[where + 1] = False
            now = where - np.arange(len(where))
            symbol, owner, rank = symbol[stay], owner[stay], rank[stay]
            touched = np.concatenate((now, now[now > 0] - 1))
            rank[touched] = NO_RANK
            touched = touched[touched + 1 < len(symbol)]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched] = self.lookup(symbol[touched], symbol[touched + 1])
        if single:
            done_symbol += [np.array(v, np.int32) for v in single.values()]
            done_owner += [np.full(len(v), w) for w, v in single.items()]
        symbol, owner = np.concatenate(done_symbol), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbol[order], np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=count))))

    def merge_long(self, word: bytes) -> list[int]:
        """One long word: a heap of pairs over a linked list."""
        ids = self.base[np.frombuffer(word, np.uint8)].tolist()
        after, before, ranks = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)], self.ranks
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := ranks.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := ranks.get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


NO_RANK = np.iinfo(np.int32).max


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)
    return mixed.astype(np.int64)


def _hash_table(keys: np.ndarray) -> np.ndarray:
    """Open addressing over a power of two; a slot holds the position of its key or -1."""
    size = 1 << max(4, (4 * len(keys)).bit_length())
    table = [-1] * size
    for position, at in enumerate(_slot(keys, size).tolist()):
        while table[at] >= 0:
            at = (at + 1) & (size - 1)
        table[at] = position
    return np.array(table, np.int32)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """Vocabulary of a file that every machine has; loaded once per worker."""
    with open(path, encoding="utf-8") as file:
        return Vocabulary(file.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(data: np.ndarray, offsets: np.ndarray, ids_of) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one behind the other, and each text's offsets in them. ``ids_of(words)`` gives the ids of distinct
    words."""
    starts = word_starts(data, offsets)
    codes, words = distinct_words(data, starts)
    flat, places = ids_of(words)
    sizes = np.diff(places)[codes]
    ids = flat[expand(places[codes], sizes)]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return ids, ends[np.searchsorted(starts, offsets)]
