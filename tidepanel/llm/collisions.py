"""Near-duplicate vectors by collision-counting projections.

Rows are sorted along many one-dimensional random projections. Two rows collide on a projection if the second lies in the
window centred at the first, and, so that a list stays sub-quadratic, in the same cell of a few further projections'
signs. The chance of a collision at the cosine threshold is known exactly, so the number of projections is set for a
wanted recall and a pair needs a minimal count of collisions before its cosine is computed.

Equal vectors are merged beforehand. A cell that is too large is dealt into blocks, and every pair of blocks is a task.
No pair leaves a task: it returns, per row, the number of links and the smallest row that it hangs together with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import components, map_arrow, stored

COSINE = 0.9
RECALL = 0.999
MIN_COUNT = 2
#: Half width of the window; a pair at the threshold differs by a normal number of deviation sqrt(2 - 2 * cosine).
WINDOW = 1.0
CELL_ROWS = 128
BLOCK_ROWS = 2048


def design(rows: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """Sign bits of a cell, and projections needed so that a pair at the threshold reaches the count with the recall."""
    bits = max(0, math.ceil(math.log2(max(rows, 1) / CELL_ROWS)))
    spread = math.sqrt(max(2 - 2 * cosine, 1e-12))
    hit = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits * math.erf(WINDOW / spread / math.sqrt(2))
    count = MIN_COUNT
    while sum(math.comb(count, j) * hit ** j * (1 - hit) ** (count - j) for j in range(MIN_COUNT)) > 1 - recall:
        count += 1
    return bits, count


def project(unit: np.ndarray, bits: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and value of every row on every projection; the same for a given dimension wherever it is computed."""
    normal = np.random.default_rng(unit.shape[1]).standard_normal((unit.shape[1], count * (bits + 1)))
    value = (unit @ normal).reshape(len(unit), count, bits + 1)
    cell = ((value[:, :, 1:] > 0) * (1 << np.arange(bits, dtype=np.int64))).sum(2)
    return cell, value[:, :, 0]


def unit_rows(column: pa.Array, size: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # no overflow in the squares
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _forest(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each place hangs together with."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Links of every vector: (vec_id, n_links, component_id, kept).

    Pairs are linked if their cosine in double precision is at least ``cosine``. Vectors that are null, empty, zero, or
    hold a null or non-finite component link with nothing, and vectors of different dimensions don't link. Every row
    counts, repeated ones too; rows that share an id share their component. A null id is kept as a row; it counts for
    others but is no component's name. Other columns are not read. An empty table gives an empty one.
    """
    spark = vectors.sparkSession
    vector = F.col(embedding)
    sound = (vector.isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
             & F.exists(vector, lambda x: x != 0))
    base = vectors.select(F.col(vec_id).alias("id"), F.when(F.coalesce(sound, F.lit(False)), vector).alias("vector"))
    key = F.when(F.col("vector").isNotNull(), F.concat_ws(":", F.xxhash64("vector"), F.hash("vector"), F.size("vector")))
    keyed = base.withColumn("key", key)
    # rows by vector: the name is the smallest id, copies count as often as they occur
    merged = stored(keyed.filter("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
                    .withColumn("row", F.xxhash64("key")), "vectors")
    bits, count = design(merged.count(), cosine, recall)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(2)], np.int64)
            for size in np.unique(sizes).tolist():
                for some in np.array_split(np.flatnonzero(sizes == size), -(-int((sizes == size).sum()) // 200)):
                    part = batch.take(pa.array(some))
                    cell, _ = project(unit_rows(part.column(2), size), bits, count)
                    row = np.repeat(np.arange(len(some)), count)
                    copied = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(count, dtype=np.int32), len(some))), pa.array(cell.ravel()), pa.array(np.full(len(row), size, np.int32)), *copied.columns],
                        names=["nth", "cell", "size", "row", "copies", "vector"])

    kind = vectors.schema[embedding].dataType.simpleString()
    dealt = map_arrow(merged.select("row", "copies", "vector"), deal, f"nth int, cell long, size int, row long, copies long, vector {kind}")
    large = dealt.groupBy("nth", "cell", "size").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK_ROWS)
    dealt = (dealt.join(stored(large, "cells"), ["nth", "cell", "size"], "left")
             .withColumn("blocks", F.coalesce(F.ceil(F.col("n") / BLOCK_ROWS), F.lit(1)).cast("int")).withColumn("block", F.pmod("row", "blocks").cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("nth", "cell", "size", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "row", "copies", "vector"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        nth, _, size, low, high = (k.as_py() for k in key)
        table = table.combine_chunks()
        block, row, copies = (table.column(c).to_numpy() for c in ("block", "row", "copies"))
        unit = unit_rows(table.column("vector").combine_chunks(), size)
        cell, value = project(unit, bits, count)
        order = np.argsort(value[:, nth], kind="stable")
        block, row, copies, unit, cell, value = block[order], row[order], copies[order], unit[order], cell[order], value[order]
        line = value[:, nth]
        left, right = [], []
        for first in range(0, len(row), 256):
            some = slice(first, min(first + 256, len(row)))
            # windows centred at the queries, along the sorted projection
            until = int(np.searchsorted(line, line[some.stop - 1] + WINDOW, "right"))
            q, v = np.nonzero((line[None, first:until] - line[some, None] <= WINDOW) & (np.arange(first, until)[None, :] > np.arange(first, some.stop)[:, None]))
            q, v = q + first, v + first
            if low != high:
                apart = block[q] != block[v]
                q, v = q[apart], v[apart]
            hits = np.zeros(len(q), np.int16)
            for k in range(count):
                met = (cell[q, k] == cell[v, k]) & (np.abs(value[q, k] - value[v, k]) <= WINDOW)
                if k < nth:  # a pair is counted where it collides first
                    q, v, hits = q[~met], v[~met], hits[~met]
                else:
                    hits += met
            q, v = q[hits >= MIN_COUNT], v[hits >= MIN_COUNT]
            near = np.einsum("ij,ij->i", unit[q], unit[v]) >= cosine
            left.append(q[near])
            right.append(v[near])
        a, b = np.concatenate(left), np.concatenate(right)
        links = np.bincount(a, weights=copies[b], minlength=len(row)) + np.bincount(b, weights=copies[a], minlength=len(row))
        root = _forest(len(row), a, b)
        some = np.flatnonzero(links > 0)
        return pa.table({"row": row[some], "links": links[some].astype(np.int64), "root": row[root[some]]})

    found = stored(dealt.groupBy("nth", "cell", "size", "low", "high").applyInArrow(compare, "row long, links long, root long"), "links")
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    names = merged.select("row", "rep", "key", "copies")
    parts = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    grouped = names.join(parts.withColumnRenamed("node", "row"), "row", "left").withColumn("component", F.coalesce("component", "row"))
    smallest = grouped.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_key = (grouped.join(smallest, "component").join(links, "row", "left")
              .select("key", "component_id", (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links")))
    joined = keyed.select("id", "key").join(by_key, "key", "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                         F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
