"""Exact Jaccard join on word shingles with a token-group matrix.

1. Every text becomes its set of 5-word shingles; equal sets are one node from here on.
2. Nodes with an equal min-hash are compared with the one of them that has the fewest rare tokens, which among edited
   copies is the text closest to the original; verified links join nodes to groups, so a large group of near copies is one
   group and costs a few comparisons a node, not all pairs.
3. The matrix holds, for each group, the union of its members' leading tokens: of a set's tokens, rare ones first, the
   fifth that two sets cannot miss each other in. How common a token is comes from counts over all texts; any
   order that all sets share keeps the join exact. A token's place in that order tells how much a set can still share
   behind it, and so how large a partner may be; it is entered for the bands of sizes that its place allows only. Passages
   that many otherwise different texts hold come behind their own tokens and are entered for no band at all.
4. A node opens the groups that hold one of its leading tokens for its band of sizes, and all others stay closed: the sets
   there cannot overlap enough. Members of groups that have opened each other, by a token that the places and sizes of
   both allow, are verified on the whole texts if their leading tokens share what a link leaves to them.

Every pair of linked sets is verified directly, or both of its ends are already in one group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import chunks, components, discard, expand, map_arrow, stored, text_buffers

WORDS = 5
#: Similarity of a link, in fifths: 4 / 5.
FIFTHS = 4
MARKS = 6
#: Sizes up to this are bands of their own, above it a band is so many per cent wide.
EXACT_SIZES, BAND_WIDTH = 25, 1.04
SLOT_BITS = 22
LOCAL_TOKENS = 4_000_000
#: Times that nodes are compared with a head of their min-hash before the matrix.
HEADS = 1
#: A table of ids up to this size is sent to all executors, a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: The same for a table of tokens alone, 8 bytes a row.
BROADCAST_TOKENS = 1_000_000

_FACTOR, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, size: int) -> np.ndarray:
    """Powers of a number modulo 2 ** 64, grown on demand."""
    if name not in _powers or len(_powers[name]) < size:
        steps = np.full(max(size, 1 << 19), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word and the offsets of the texts in them; words don't cross texts."""
    n = len(data)
    gap = np.ones(n + 1, bool)
    gap[:n] = _GAP[data]
    fence = np.zeros(n + 1, bool)
    fence[offsets] = True
    start = np.flatnonzero(~gap[:n] & (np.concatenate(([True], gap[:n - 1])) | fence[:n])) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(~gap[:n] & (gap[1:] | fence[1:])) + 1 if n else np.zeros(0, np.int64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power("up", _FACTOR, n), dtype=np.uint64)))
    word = (total[end] - total[start]) * _power("down", _INVERSE, n + 1)[start]
    return _mix(word ^ (end - start).astype(np.uint64) * _FACTOR), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of every text, ascending, and the offsets of the texts in them."""
    word, at = word_hashes(data, offsets)
    count = np.diff(at)
    window = max(len(word) - words + 1, 0)
    token = np.zeros(window, np.uint64)
    for k in range(words):
        token = _mix(token * _FACTOR + word[k:k + window])
    sets = []
    for a, n in zip(at[:-1].tolist(), count.tolist()):
        if n >= words:
            each = np.sort(token[a:a + n - words + 1])
            sets.append(each[np.concatenate(([True], each[1:] != each[:-1]))])
        elif n:
            whole = np.array([n], np.uint64)  # the whole sequence, apart from any shingle
            for k in range(n):
                whole = _mix(whole * _INVERSE + word[a + k])
            sets.append(whole)
        else:
            sets.append(token[:0])
    sizes = np.array([len(s) for s in sets], np.int64)
    return np.concatenate([token[:0], *sets]), np.concatenate(([0], np.cumsum(sizes)))


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows of two kinds: (doc_id, text_key, n_shingles, node, marks) per document, and (token, times) for tokens that a task has met
    in two or more of its texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def row(ids: pa.Array, keys: pa.Array, size, node, marks, token, times) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, keys, pa.array(size, pa.int64()), pa.array(node, pa.int64()), pa.array(marks, pa.list_(pa.int64())), pa.array(token, pa.int64()), pa.array(times, pa.int64())],
                                              names=["doc_id", "text_key", "n_shingles", "node", "marks", "token", "times"])

        def common(kind: pa.DataType) -> pa.RecordBatch:
            token, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            token, times = token[times > 1].view(np.int64), times[times > 1]
            none = [None] * len(token)
            return row(pa.nulls(len(token), kind), pa.nulls(len(token), pa.int64()), none, none, none, token, times)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                tokens, at = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                size = np.diff(at)
                filled = np.flatnonzero(size)
                marks: list = [None] * (j - i)
                if filled.size:
                    lows = np.stack([np.minimum.reduceat(_mix(tokens + salt), at[:-1][filled]) for salt in np.arange(MARKS, dtype=np.uint64) * _FACTOR], 1).view(np.int64)
                    for f, low in zip(filled.tolist(), lows.tolist()):
                        marks[f] = low
                node = [_node(tokens[a:b]) if b > a else None for a, b in zip(at.tolist(), at[1:].tolist())]
                none = [None] * (j - i)
                yield row(batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), size, node, marks, none, none)
                held.append(tokens)
                if sum(map(len, held)) > LOCAL_TOKENS:
                    yield common(kind)
        if held:
            yield common(kind)

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), text, F.xxhash64(text)), work, f"doc_id {kind}, text_key long, n_shingles long, node long, marks array<long>, token long, times long")


def commonness(rows: DataFrame) -> np.ndarray:
    """Level of every hash slot: the binary logarithm of the count of its most common token. The table is put together by
    ranges of slots on the executors; 256 lists of one number a filled slot, 2 ** SLOT_BITS at most, come to the driver."""
    counted = rows.filter("times is not null").groupBy("token").agg(F.sum("times").alias("times")).filter("times >= 4")
    slot = F.shiftrightunsigned("token", 64 - SLOT_BITS).cast("int")
    found = counted.groupBy(slot.alias("slot")).agg(F.max(F.floor(F.log2("times"))).cast("int").alias("level"))
    packed = found.groupBy(F.shiftright("slot", SLOT_BITS - 8).alias("range")).agg(F.collect_list(F.col("slot") * 64 + F.col("level")).alias("filled"))
    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    for chunk in packed.select("filled").toArrow()["filled"].chunks:
        filled = chunk.flatten().to_numpy()
        levels[filled // 64] = filled % 64
    return levels


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity, checked on the whole texts of their representatives.

    Only texts of nodes that occur in a pair are read on; a node in many pairs is a skewed key of the pairs' side only,
    which adaptive execution splits.
    """
    wanted = stored(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi").select("node", "rep"), "wanted")
    texts = docs.select(F.col("doc_id").alias("rep"), F.col(text).alias("text")).join(_small(wanted.withColumnRenamed("rep", "named")), F.col("rep").eqNullSafe(F.col("named")))
    texts = stored(texts.select("node", "text"), "texts")
    first, second = texts.toDF("a", "text_a"), texts.toDF("b", "text_b")
    both = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "text_a", "text_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data_a, offsets_a = text_buffers(batch.column(2))
            data_b, offsets_b = text_buffers(batch.column(3))
            left, right = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in chunks(offsets_a + offsets_b):
                token_a, at_a = shingle_sets(data_a[offsets_a[i]:offsets_a[j]], offsets_a[i:j + 1] - offsets_a[i])
                token_b, at_b = shingle_sets(data_b[offsets_b[i]:offsets_b[j]], offsets_b[i:j + 1] - offsets_b[i])
                keep = []
                for k in range(j - i):
                    x, y = token_a[at_a[k]:at_a[k + 1]], token_b[at_b[k]:at_b[k + 1]]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    # a row that shares the representative's id but not its text is no member of the pair
                    keep.append((FIFTHS + 5) * shared >= FIFTHS * (len(x) + len(y)) and _node(x) == left[i + k] and _node(y) == right[i + k])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = stored(map_arrow(both, work, "a long, b long"), "links")
    discard(wanted, texts)
    return found


def leading_tokens(docs: DataFrame, levels: np.ndarray, text: str) -> DataFrame:
    """Rows (node, size, rare, tokens): the leading tokens of every non-empty text in the common order, and the share of rare
    ones among all its tokens, per mille."""
    shipped = docs.sparkSession.sparkContext.broadcast(levels)  # 2 ** SLOT_BITS bytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shipped.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in chunks(offsets):
                tokens, at = shingle_sets(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                level = table[(tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                filled = np.flatnonzero(np.diff(at))
                size = np.diff(at)[filled]
                least = -(-size * FIFTHS // 5)
                kept = size - least + 1
                # stable by level within a text: tokens are ascending already
                owner = np.repeat(np.arange(len(filled)), size)
                order = np.argsort(owner * 256 + level, kind="stable")
                chosen = tokens[order][expand(at[:-1][filled], kept)].view(np.int64)
                node = [_node(tokens[a:b]) for a, b in zip(at[filled].tolist(), at[filled + 1].tolist())]
                rare = np.bincount(owner, weights=level == 0, minlength=len(filled)) * 1000 // size
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kept))).astype(np.int32)), pa.array(chosen))
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(size), pa.array(rare.astype(np.int32)), lists], names=["node", "size", "rare", "tokens"])

    return map_arrow(docs.select(text), work, "node long, size long, rare int, tokens array<long>")


def _sizes_fit(a: str, b: str) -> F.Column:
    return (F.col(a) * 5 >= F.col(b) * FIFTHS) & (F.col(b) * 5 >= F.col(a) * FIFTHS)


def _largest(size: F.Column, place: F.Column) -> F.Column:
    """Size of the largest partner of which the token at this place (from 0) can still be the first shared one: not more
    than the tokens behind it can follow, and a link needs 4 / 9 of both sizes in common."""
    return F.least(F.floor(size * 5 / FIFTHS), F.floor((size - place) * (FIFTHS + 5) / FIFTHS) - size)


def _band(size: F.Column) -> F.Column:
    """Number of the band of sizes."""
    wide = F.floor(F.log(size / EXACT_SIZES) / F.log(F.lit(BAND_WIDTH))) + EXACT_SIZES
    return F.when(size <= EXACT_SIZES, size).otherwise(wide).cast("int")


def star_links(ranked: DataFrame, source: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) of nodes with heads, and the groups that they make.

    Nodes of like size with an equal min-hash share a key. Its head is the node with the fewest rare tokens that was not
    a head before; nodes outside the head's group are compared with it. A key with a large part of all nodes is counted
    with partial minima and is a skewed key of the nodes' side of the join only.
    """
    band = F.floor(F.log("size") / F.log(F.lit(1.25)) + F.col("nth") / MARKS)
    key = ["nth", "mark", "band"]
    spread = stored(ranked.select("node", "size", "rare", F.posexplode("marks").alias("nth", "mark")).withColumn("band", band), "spread")
    links = groups = used = None
    for _ in range(HEADS):
        open_ = spread if used is None else spread.join(used, [*key, "node"], "left_anti")
        if groups is None:
            open_ = open_.withColumn("group", F.col("node"))
        else:
            open_ = open_.join(_small(groups), "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
        heads = open_.groupBy(*key).agg(F.min(F.struct("rare", "node", "size", "group")).alias("head"), F.min("group").alias("low"), F.max("group").alias("high"))
        heads = stored(heads.filter("low <> high").select(*key, "head.*").withColumnRenamed("node", "b").withColumnRenamed("size", "other").withColumnRenamed("group", "into").drop("rare"), "heads")
        pairs = open_.join(heads, key).filter(F.col("group") != F.col("into")).filter(_sizes_fit("size", "other"))
        pairs = stored(pairs.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), "pairs")
        found = verify(pairs, source, nodes, "text")
        discard(pairs)
        links = found if links is None else links.union(found)
        groups = components(links)
        fresh = heads.select(*key, F.col("b").alias("node"))
        used = fresh if used is None else used.union(fresh)
    return links, groups


def matrix_cells(lead: DataFrame) -> DataFrame:
    """Rows (token, node, group, size, largest, band, facing): the leading tokens of nodes (node, group, size, tokens) that
    several groups hold, for each band of sizes that a partner can have by the token's place and by the sets that hold it."""
    cells = lead.select("node", "group", "size", F.posexplode("tokens").alias("place", "token"))
    # most tokens are in one group only; those that stay are few
    several = stored(cells.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low <> high").select("token"), "tokens")
    shared = stored(cells.join(F.broadcast(several) if several.count() <= BROADCAST_TOKENS else several, "token", "left_semi").distinct(), "cells")
    held = stored(shared.groupBy("token").agg(F.min("size").alias("least"), F.max("size").alias("most")), "held")
    cells = (shared.join(_small(held), "token")
             .withColumn("smallest", F.greatest(F.ceil(F.col("size") * FIFTHS / 5), "least"))
             .withColumn("largest", F.least(_largest(F.col("size"), F.col("place")), "most")).filter("smallest <= largest"))
    cells = stored(cells.select("token", "node", "group", "size", "largest", _band(F.col("size")).alias("band"),
                                F.explode(F.sequence(_band(F.col("smallest")), _band(F.col("largest")))).alias("facing")), "cells")
    discard(several, shared, held)
    return cells


def open_groups(cells: DataFrame) -> DataFrame:
    """The cells of nodes with the groups (``other``) that they open: those with a member in the facing band of sizes that
    holds the token for the node's own band."""
    matrix = cells.select("token", F.col("group").alias("other"), F.col("facing").alias("band"), F.col("band").alias("facing")).distinct()
    return cells.join(matrix, ["token", "band", "facing"]).filter("group <> other")


def facing_pairs(opened: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose groups have opened each other by one token, for their sizes."""
    first = opened.select("token", "band", "facing", F.col("node").alias("a"), "size", "largest", F.col("group").alias("of_a"), F.col("other").alias("of_b"))
    last = opened.select("token", F.col("facing").alias("band"), F.col("band").alias("facing"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("largest").alias("largest_b"),
                         F.col("group").alias("of_b"), F.col("other").alias("of_a"))
    both = first.join(last, ["token", "band", "facing", "of_a", "of_b"]).filter("a < b and size_b <= largest and size <= largest_b")
    return both.filter(_sizes_fit("size", "size_b")).select("a", "b").distinct()


def _wanted(size: F.Column, other: F.Column) -> F.Column:
    """Leading tokens that linked sets of these sizes share at least. Of the set whose leading tokens end first in the common
    order, only the rest can add to what the leading tokens share."""
    rest = lambda x: F.ceil(x * FIFTHS / 5) - 1
    return F.greatest(F.ceil((size + other) * FIFTHS / (FIFTHS + 5)) - F.greatest(rest(size), rest(other)), F.lit(1))


def sharing_pairs(pairs: DataFrame, lead: DataFrame) -> DataFrame:
    """The pairs whose leading tokens share as many as a link of their sizes needs; only the lists of nodes in pairs move."""
    named = stored(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "named")
    lists = stored(lead.select("node", "size", "tokens").join(_small(named), "node", "left_semi").dropDuplicates(["node"]), "lists")
    both = pairs.join(lists.toDF("a", "size", "tokens"), "a").join(lists.toDF("b", "size_b", "tokens_b"), "b")
    return both.filter(F.size(F.array_intersect("tokens", "tokens_b")) >= _wanted(F.col("size"), F.col("size_b"))).select("a", "b")


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shingle counts and components of all documents: (doc_id, n_shingles, component_id).

    Two documents link if 100 * intersection >= 80 * union of their sets of distinct 5-word shingles (A-Z lower-cased);
    with fewer words the whole sequence is the one element. Null, empty and wordless texts have an empty set and link
    with nothing: their component is their own id. ``component_id`` is the smallest id that links reach. Every row
    counts; rows that repeat an id join the texts' nodes each. A null id is a row, but no component's name unless nothing
    else is in it. Other columns are not read. An empty table gives an empty one.
    """
    rows = link_rows(docs, doc_id, text)
    return rows.select(F.col("doc_id").alias(doc_id), "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def link_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The same row by row, whatever its id: (doc_id, text_key, n_shingles, component, component_id). ``text_key`` is the
    ``xxhash64`` of the row's text, ``component`` a number of its component, null for an empty set."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = stored(sketch(source, "doc_id", "text"), "sketch")
    base = rows.filter("times is null").select("doc_id", "text_key", "n_shingles", "node", "marks")
    nodes = stored(base.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("size"), F.min("marks").alias("marks")), "nodes")

    levels = commonness(rows)
    lead = stored(leading_tokens(source, levels, "text"), "leading")
    ranked = stored(nodes.join(lead.select("node", "rare").distinct(), "node"), "ranked")
    links, groups = star_links(ranked, source, nodes)

    # the matrix: leading tokens by group, of tokens that two groups hold
    lead = lead.join(_small(groups), "node", "left").withColumn("group", F.coalesce("component", "node"))
    cells = matrix_cells(lead)
    opened = stored(open_groups(cells), "opened")
    second = stored(sharing_pairs(stored(facing_pairs(opened), "pairs"), lead), "pairs")
    discard(cells, opened)
    more = verify(second, source, nodes, "text")
    if not more.isEmpty():
        groups = components(links.union(more))

    named = nodes.select("node", "rep").join(groups, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = named.join(smallest, "component").select("node", "component", "component_id")
    return (base.select("doc_id", "text_key", "n_shingles", "node").join(of_node, "node", "left")
            .select("doc_id", "text_key", "n_shingles", "component", "component_id"))
