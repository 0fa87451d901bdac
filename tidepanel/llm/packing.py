"""Best-fit packing of documents into sequences after Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to the capacity, so the whole instance is a histogram of at most ``capacity`` classes,
whatever the corpus. The driver solves that histogram: sets of one to three pieces that dominate every alternative for
an open piece, longest first, are fixed, many sequences at a time; the rest is packed best-fit, longest first. Runs of equal
sequences are kept as ranges, so the plan has a few thousand rows. Pieces find their place by their rank within their
length class, which is counted in parallel over hashed blocks of documents; a hot class is spread over all blocks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm import bpe
from tidepanel.llm.common import chunks, expand, map_arrow, stored, text_buffers

CAPACITY = 1024
END_ID = 2
BLOCKS = 256


def cut_documents(docs: DataFrame, vocab_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of every document: its ids and the end id, cut from the end so that only the first piece may be short."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = bpe.vocabulary(vocab_path)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                ids, at = bpe.encode(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], vocab.merge)
                size = np.diff(at) + 1
                first = np.concatenate(([0], np.cumsum(size)))[:-1]
                stream = np.full(int(size.sum()), END_ID, "<u4")
                stream[expand(first, size - 1)] = ids
                count = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), count)
                piece = expand(np.zeros(len(size), np.int64), count)
                head = size - (count - 1) * capacity
                start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[row], capacity)
                begin = first[row] + start
                crc = [zlib.crc32(stream[a:a + n]) for a, n in zip(begin.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                    names=[doc_id, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(doc_id, text), work, f"{doc_id} {kind}, piece int, start long, length long, ids_crc32 long")


class Plan:
    """Placement of length classes: each row puts the next ``count`` pieces of a length at an offset of consecutive
    sequences."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.left = {length: n for length, n in counts.items() if n}
        self.capacity, self.sequences, self.reduced = capacity, 0, 0
        self.used: dict[int, int] = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, count, first sequence, offset

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.used[length], count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def fix(self, lengths: tuple[int, ...]) -> None:
        """Fill as many new sequences with this set as the open pieces allow."""
        many = min(self.left[x] // lengths.count(x) for x in set(lengths))
        offset = 0
        for x in lengths:
            self.put(x, many, self.sequences, offset)
            offset += x
        self.sequences += many
        self.reduced += many

    def dominating(self, top: int | None = None) -> tuple[int, ...] | None:
        """A set with this open length, else the longest, that dominates all others with it: alone, in a pair or in a
        triple."""
        sizes = sorted(self.left)
        top = sizes[-1] if top is None else top
        room = self.capacity - top

        def open_(x: int, *taken: int) -> bool:
            return self.left[x] > (top, *taken).count(x)

        fits = [x for x in sizes[:bisect_left(sizes, room + 1)] if open_(x)]
        if not fits:
            return (top,)
        best = fits[-1]
        if best == room:
            return (top, best)
        low = fits[0]
        low2 = low if open_(low, low) else fits[1] if len(fits) > 1 else None
        if low2 is None or low + low2 > room:
            return (top, best)  # one more piece at most: the longest that fits
        third = next((x for x in fits if open_(x, low, low2)), None)
        if third is not None and low + low2 + third <= room:
            return None  # more than two further pieces may fit; no set of three dominates for sure
        pairs = []
        for a in fits:
            b = next((b for b in reversed(fits[:bisect_left(fits, min(a, room - a) + 1)]) if open_(b, a)), None)
            if b is not None:
                pairs.append((a + b, a))
        total, greater = max(pairs)
        if total <= best:
            return (top, best)  # the one piece holds at least what any two hold, and a pair can take its place
        less = total - greater
        above = [x for x in fits if x > less]
        two = sum((above[:1] * 2 if above and self.left[above[0]] > (top == above[0]) + 1 else above[:2]))
        if greater == best and (len(above) < 2 and self.left[best] < 2 or two > room):
            return (top, greater, less)  # no two pieces above the lesser one fit, so every pair can take their places
        return None

    def reduce(self) -> None:
        """Fix dominating sets, longest first; a length without one is passed over, and looked at again as long as any
        other was fixed."""
        before = -1
        while before < self.reduced:
            before = self.reduced
            for length in sorted(self.left, reverse=True):
                while length in self.left and (fixed := self.dominating(length)):
                    self.fix(fixed)

    def best_fit(self) -> None:
        """Longest first into the fullest sequence with room; sequences of equal room are kept as ranges."""
        rooms: dict[int, list[tuple[int, int]]] = {}
        order: list[int] = []
        for length in sorted(self.left, reverse=True):
            while self.left.get(length):
                at = bisect_left(order, length)
                if at == len(order):
                    # open as many sequences as this class fills by itself, at least one
                    per = self.capacity // length
                    many = max(1, self.left[length] // per)
                    first, self.sequences = self.sequences, self.sequences + many
                    self._add(rooms, order, self.capacity, first, many)
                    continue
                room = order[at]
                first, many = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], order[at]
                count = min(many, self.left[length])
                self.put(length, count, first, self.capacity - room)
                if count < many:
                    self._add(rooms, order, room, first + count, many - count)
                if room > length:
                    self._add(rooms, order, room - length, first, count)

    @staticmethod
    def _add(rooms: dict, order: list[int], room: int, first: int, many: int) -> None:
        if room not in rooms:
            rooms[room] = []
            order.insert(bisect_left(order, room), room)
        rooms[room].append((first, many))


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Reduce by dominance until no length has a dominating set, then pack the remainder best-fit."""
    plan = Plan(counts, capacity)
    plan.reduce()
    plan.best_fit()
    return plan


def pack_documents(docs: DataFrame, vocab_path: str | None = None, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack all documents: one row per piece with its sequence and its offset there.

    A null or empty text is the end id alone. Every row is a document of its own, also with a repeated or null id; ties
    in length are ranked by block, id and piece, and which of equal rows comes first has no effect on the result's rows.
    Other columns are not read. An empty table gives an empty one.
    """
    blocks = max(BLOCKS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = cut_documents(docs, vocab_path or bpe.default_path(), capacity, doc_id, text)
    pieces = stored(pieces.withColumn("block", F.pmod(F.xxhash64(doc_id, "piece", "ids_crc32"), F.lit(blocks)).cast("int")), "pieces")
    cells = pieces.groupBy("length", "block").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cells = stored(cells.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0).cast("long"))), "cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row per class
    rows = np.array(solve(counts, capacity).rows, np.int64).reshape(-1, 5)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shipped = docs.sparkSession.sparkContext.broadcast(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        span = max(int((table[:, 1] + table[:, 2]).max(initial=0)), 1)
        key = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = table[np.searchsorted(key, length * span + rank, "right") - 1]
            keep = [batch.column(k) for k in range(5)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])],
                                             names=[doc_id, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    nth = F.row_number().over(Window.partitionBy("length", "block").orderBy(doc_id, "piece", "start", "ids_crc32"))
    ranked = (pieces.join(cells.drop("n"), ["length", "block"])
              .select(doc_id, "piece", "start", "length", "ids_crc32", (F.col("before") + nth - 1).alias("rank")))
    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(ranked, place, f"{doc_id} {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
