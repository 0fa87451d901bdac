"""Helpers of the training-data operators: shared storage, Arrow batches in byte-bounded chunks, connected components."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tidepanel

#: Bytes of a batch that are looked at together: a Python worker holds about a hundred bytes for each.
CHUNK_BYTES = 400_000


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir`` of the session, else one below the warehouse (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut and the rows outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def put_file(spark: SparkSession, name: str, payload: bytes, ending: str = "", add: bool = True) -> str:
    """Write one small file to the shared folder through Spark's file system layer. With ``add`` it is shipped to every
    executor and the name returned, with which workers open ``SparkFiles.get(name)``; else its path is returned."""
    unique = f"{name}-{uuid.uuid4().hex}{ending}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{unique}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(payload))
    out.close()
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if not add:
        return whole
    spark.sparkContext.addFile(whole)
    return unique


_shipped: set[str] = set()


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` for functions of this package, which is sent along once per application: executors need not have
    it installed."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def ship_package(spark: SparkSession) -> None:
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(tidepanel.__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, f"{root.name}/{file.relative_to(root)}")
    spark.sparkContext.addPyFile(put_file(spark, "package", packed.getvalue(), ".zip", add=False))
    _shipped.add(application)


def refuse_clash(keep: Iterable[str], *outputs: str) -> None:
    """Kept columns with the name of an output would be two columns of one name."""
    if clash := {c.lower() for c in keep} & set(outputs):
        raise ValueError(f"kept columns have the names of outputs: {sorted(clash)}")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows, without copies; nulls count as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ends + lengths, lengths)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each range between neighbouring offsets; empty ranges give 0. Every range is summed by itself, so a large
    value never takes digits from the ranges behind it."""
    out = np.zeros(len(offsets) - 1, np.result_type(values, np.int64))
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    if filled.size:
        out[filled] = np.add.reduceat(values[:offsets[-1]], offsets[:-1][filled])
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the longest runs of bytes that ``inside`` (one flag per byte value) marks, and the offsets of
    the texts in them; a word never crosses texts."""
    n = len(data)
    flag = np.zeros(n + 2, bool)
    flag[1:-1] = inside[data]
    fence = np.zeros(n + 1, bool)
    fence[offsets] = True
    start = np.flatnonzero(flag[1:-1] & (~flag[:-2] | fence[:-1]))
    end = np.flatnonzero(flag[1:-1] & (~flag[2:] | fence[1:])) + 1
    return start, end - start, np.searchsorted(start, offsets)


def joined_words(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words one behind the other, each with a space behind it, and their offsets."""
    at = np.concatenate(([0], np.cumsum(length + 1)))
    out = np.full(int(at[-1]), 0x20, np.uint8)
    out[expand(at[:-1], length)] = data[expand(start, length)]
    return out, at


def binaries(data: np.ndarray, at: np.ndarray) -> pa.LargeBinaryArray:
    """The ranges between neighbouring offsets as Arrow values, without copies."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows of a small-column table numbered 1, 2, 3... in an order, without a window over all rows.

    Rows are dealt by ranges of the order and sorted within; their place is written with them, and the counts of the
    ranges (one number each) give every range its first number. Rows that are equal in the order must not be many.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(name, F.monotonically_increasing_id()), name)
    counts = {r["part"]: r["count"] for r in placed.groupBy(F.shiftright(name, 33).alias("part")).count().collect()}  # one row a range
    first, rows = 1, []
    for part in sorted(counts):
        rows.append((part, first))
        first += counts[part]
    ahead = spark.createDataFrame(rows, "part long, first long")
    placed = placed.withColumn("part", F.shiftright(name, 33)).join(F.broadcast(ahead), "part")
    return placed.withColumn(name, F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + F.col("first")).select(*df.columns, name)


def crc_fold(id_column: Column) -> Column:
    """Fold of a document: crc32 of its id as text, modulo 5."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected edge list (a, b): rows (node, component), component = smallest node
    that can be reached. Nodes without edges do not appear.

    Every round points each node at the smallest label among its neighbours and its own label's label (pointer
    jumping), so chains shrink fast; labels are aggregated with partial minima, so a node with a third of all edges is
    one row per task. Each round is written to the shared folder; it ends when no label changes.
    """
    both = edges.select("a", "b").filter("a <> b")
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    both = stored(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("near")))
        # a label also moves to the smaller label its node has found, so whole trees hang over at once
        found = labels.join(near, "node")
        moved = found.filter("near < component").groupBy(F.col("component").alias("node")).agg(F.min("near").alias("near"))
        best = (found.select("node", "component", F.least("component", "near").alias("best"))
                .join(moved.withColumnRenamed("near", "hung"), "node", "left")
                .select("node", "component", F.least("best", F.coalesce("hung", "best")).alias("best")))
        jump = best.select(F.col("node").alias("best"), F.col("best").alias("further"))
        after = stored(best.join(jump, "best").select("node", "component", F.least("best", "further").alias("next")), "labels")
        changed = not after.filter("next < component").isEmpty()
        labels = after.select("node", F.col("next").alias("component"))
        if not changed:
            return labels
