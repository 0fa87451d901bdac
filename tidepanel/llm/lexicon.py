"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The words (pre-tokens) of all texts are counted; the most frequent ones are compiled with their ids into a transducer
whose states share suffixes: ids sit on the earliest arc that decides them, and states with equal continuations are one.
The transducer is one array file in the shared folder that Spark ships to every executor, where workers memory-map it.
Words that it does not accept are merged exactly by the vocabulary's ranks, so results never depend on the lexicon.
"""

from __future__ import annotations

import functools
import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import bpe
from tidepanel.llm.common import chunks, expand, map_arrow, put_file, stored, text_buffers

#: Bound of the lexicon in words, and the distinct words that a task holds before it hands its counts on.
LEXICON_WORDS = 65_536
COUNTED_WORDS = 300_000


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows (word, n): occurrences of pre-tokens over whole texts. Each task counts locally and leaves out words that it
    has met once (lossy counting: a word loses at most one occurrence for each flush of a task)."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            kept = {w: n for w, n in held.items() if n > 1}
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in chunks(offsets):
                part = data[offsets[i]:offsets[j]]
                codes, words = bpe.distinct_words(part, bpe.word_starts(part, offsets[i:j + 1] - offsets[i]))
                for word, n in zip(words.to_pylist(), np.bincount(codes, minlength=len(words)).tolist()):
                    held[word] = held.get(word, 0) + n
                if len(held) > COUNTED_WORDS:
                    yield flush()
        yield flush()

    return map_arrow(docs.select(text), local, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Transducer:
    """Minimal acyclic transducer from byte strings to id sequences, as flat arrays.

    ``keys`` holds state * 256 + byte of every arc in ascending order, so an arc is found by binary search.
    """

    FIELDS = ("keys", "target", "arc_at", "arc_ids", "accepts", "final_at", "final_ids")

    def __init__(self, arrays: dict[str, np.ndarray]) -> None:
        self.__dict__.update(arrays)
        self.longest = int(arrays["shape"][0])

    @staticmethod
    def compile(words: dict[bytes, tuple[int, ...]]) -> Transducer:
        """Words are added in byte order; behind the common prefix with the next word, states are final and are
        replaced by an equal state if there is one."""
        arcs: list[dict[int, list]] = [{}]  # state: byte -> [target, ids]
        finals: dict[int, tuple[int, ...]] = {}
        known: dict[tuple, int] = {}

        def settle(path: list[int], word: bytes, down_to: int) -> None:
            for depth in range(len(path) - 1, down_to, -1):
                state = path[depth]
                shape = (finals.get(state), tuple((b, t, ids) for b, (t, ids) in sorted(arcs[state].items())))
                arcs[path[depth - 1]][word[depth - 1]][0] = known.setdefault(shape, state)

        path, before = [0], b""
        for word in sorted(words):
            ids = words[word]
            common = next((k for k, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
            settle(path, before, common)
            path = path[:common + 1]
            for depth in range(common, len(word)):
                arcs.append({})
                arcs[path[-1]][word[depth]] = [len(arcs) - 1, ()]
                path.append(len(arcs) - 1)
            # ids move along the shared prefix only as far as both sides agree; the rest moves one arc on
            for depth in range(common):
                arc = arcs[path[depth]][word[depth]]
                same = next((k for k, (a, b) in enumerate(zip(arc[1], ids)) if a != b), min(len(arc[1]), len(ids)))
                rest, state = arc[1][same:], arc[0]
                if rest:
                    for other in arcs[state].values():
                        other[1] = rest + other[1]
                    if state in finals:
                        finals[state] = rest + finals[state]
                arc[1], ids = arc[1][:same], ids[same:]
            if common < len(word):
                arcs[path[common]][word[common]][1] = ids
                ids = ()
            finals[path[-1]] = ids
            before = word
        settle(path, before, 0)

        number, order = {0: 0}, [0]
        for state in order:
            for _, (target, _) in sorted(arcs[state].items()):
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
        flat = [(number[s] * 256 + b, number[t], ids) for s in order for b, (t, ids) in sorted(arcs[s].items())]
        ends = [finals.get(s, ()) for s in order]
        csr = lambda seqs: (np.concatenate(([0], np.cumsum([len(x) for x in seqs]))).astype(np.int64), np.array([i for x in seqs for i in x], np.int64))
        arc_at, arc_ids = csr([x[2] for x in flat])
        final_at, final_ids = csr(ends)
        return Transducer({"keys": np.array([x[0] for x in flat], np.int64), "target": np.array([x[1] for x in flat], np.int64), "arc_at": arc_at, "arc_ids": arc_ids,
                           "accepts": np.array([s in finals for s in order], np.int64), "final_at": final_at, "final_ids": final_ids,
                           "shape": np.array([max(map(len, words), default=0)], np.int64)})

    def to_bytes(self) -> bytes:
        parts = [np.array([self.longest], np.int64), *(getattr(self, f) for f in self.FIELDS)]
        head = np.cumsum([len(parts) + 1, *(len(p) for p in parts)])
        out = io.BytesIO()
        np.save(out, np.concatenate([head, *parts]))
        return out.getvalue()

    @staticmethod
    def mapped(path: str) -> Transducer:
        """Open a file of ``to_bytes`` as a memory map; all workers of a machine share its pages."""
        whole = np.load(path, mmap_mode="r")
        head = whole[:len(Transducer.FIELDS) + 2]
        names = ("shape", *Transducer.FIELDS)
        return Transducer({n: whole[head[k]:head[k + 1]] for k, n in enumerate(names)})

    def run(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Walk all words at once. Returns which words are accepted, and their ids with offsets (none if not accepted)."""
        words = words.cast(pa.large_binary())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2], np.uint8)
        size = np.diff(offsets)
        state = np.zeros(len(words), np.int64)
        alive = np.flatnonzero((size <= self.longest) & (size > 0)) if len(self.keys) else np.zeros(0, np.int64)
        ended, via = [], []
        for depth in range(self.longest):
            if not alive.size:
                break
            key = state[alive] * 256 + data[offsets[alive] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            alive, arc = alive[found], arc[found]
            state[alive] = self.target[arc]
            via.append((alive, arc))
            last = size[alive] == depth + 1
            ended.append(alive[last][self.accepts[state[alive[last]]] == 1])
            alive = alive[~last]
        accepted = np.zeros(len(words), bool)
        if ended:
            accepted[np.concatenate(ended)] = True
        owner = [w[accepted[w]] for w, _ in via] + [np.flatnonzero(accepted)]
        first = [self.arc_at[a[accepted[w]]] for w, a in via] + [self.final_at[state[accepted]]]
        past = [self.arc_at[a[accepted[w]] + 1] for w, a in via] + [self.final_at[state[accepted] + 1]]
        base = len(self.arc_ids)
        first[-1], past[-1] = first[-1] + base, past[-1] + base
        owner, first, past = map(np.concatenate, (owner, first, past))
        order = np.argsort(owner, kind="stable")  # arcs of a word stay in the order of the walk
        owner, first, length = owner[order], first[order], (past - first)[order]
        ids = np.concatenate((self.arc_ids, self.final_ids))[expand(first, length)]
        each = np.bincount(owner, weights=length, minlength=len(words)).astype(np.int64)
        return accepted, ids, np.concatenate(([0], np.cumsum(each)))


def lexicon_ids(lexicon: Transducer, vocab: bpe.Vocabulary):
    """Function from distinct words to ids: the lexicon's where it accepts a word, exact merges elsewhere."""

    def ids_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        accepted, found, found_at = lexicon.run(words)
        missing = np.flatnonzero(~accepted)
        merged, merged_at = vocab.merge(words.take(pa.array(missing)))
        size, start = np.diff(found_at), found_at[:-1].copy()
        size[missing], start[missing] = np.diff(merged_at), merged_at[:-1] + len(found)
        return np.concatenate((found, merged))[expand(start, size)], np.concatenate(([0], np.cumsum(size)))

    return ids_of


@functools.cache
def _worker_lexicon(name: str) -> Transducer:
    return Transducer.mapped(SparkFiles.get(name))


def build_lexicon(docs: DataFrame, vocab_path: str, words: int = LEXICON_WORDS, text: str = "text") -> str:
    """Compile the most frequent words of ``docs`` and ship them; the name opens the lexicon in a task. Words are as
    frequent as the least count that leaves no more than ``words`` of them; only those come to the driver."""
    counts = stored(word_counts(docs, text), "words")
    step = F.floor(F.log2("n") * 16)  # counts in steps of about four per cent: a few hundred rows for any corpus
    sizes = {r["step"]: r["words"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()}
    room, least = words, None
    for s in sorted(sizes, reverse=True):
        if sizes[s] > room:
            break
        room, least = room - sizes[s], s
    rows = counts.filter(step >= least).select("word").collect() if least is not None else []
    vocab = bpe.vocabulary(vocab_path)
    frequent = [bytes(r["word"]) for r in rows]
    flat, at = vocab.merge(pa.array(frequent, pa.large_binary()))
    compiled = Transducer.compile({w: tuple(flat[at[k]:at[k + 1]].tolist()) for k, w in enumerate(frequent)})
    return put_file(docs.sparkSession, "lexicon", compiled.to_bytes())


def decode(ids: list[int], vocab: bpe.Vocabulary) -> str:
    """Text of ids; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(vocab.tokens.__getitem__, ids)).decode("utf-8", "replace")


def encode_documents(docs: DataFrame, vocab_path: str | None = None, words: int = LEXICON_WORDS, with_ids: bool = False,
                     doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text: (doc_id, n_tokens, ids_sha256, decoded_sha256), and with ``with_ids`` the ids
    and the decoded text too.

    Null and empty texts have no ids. Every row is encoded for itself: repeated rows and ids stay, null ids too. Other
    columns are not read. An empty table gives an empty one.
    """
    path = vocab_path or bpe.default_path()
    name = build_lexicon(docs, path, words, text)
    extra = ", ids array<int>, decoded string" if with_ids else ""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(path)
        ids_of = lexicon_ids(_worker_lexicon(name), vocab)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                ids, at = bpe.encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], ids_of)
                flat, bounds = ids.tolist(), at.tolist()
                every = [flat[a:b] for a, b in zip(bounds, bounds[1:])]
                decoded = [decode(x, vocab) for x in every]
                columns = [batch.column(0).slice(i, j - i), pa.array(np.diff(at)),
                           pa.array([hashlib.sha256(",".join(map(vocab.decimal.__getitem__, x)).encode()).hexdigest() for x in every], pa.string()),
                           pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())]
                names = [doc_id, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array(every, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(doc_id, text), work, f"{doc_id} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
