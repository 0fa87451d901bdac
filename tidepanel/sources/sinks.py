"""Result sinks.  Paths must be visible to all executors."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from tidepanel.operators.lineage import DERIVED, row_digest


def write_lineage(closure: DataFrame, nodes: DataFrame, path: str) -> None:
    """Ancestor pairs with the record of each ancestor, as JSON lines."""
    records = nodes.withColumnRenamed("dataset_id", "ancestor")
    closure.join(records, "ancestor", "left").write.mode("errorifexists").json(path)


def write_results(sections: Mapping[str, DataFrame], path: str) -> None:
    """One Parquet table per report section below ``path``."""
    for name, df in sections.items():
        df.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/{name}")


def write_bucketed(df: DataFrame, table: str, keys: Sequence[str] = ("ticker",), order: Sequence[str] = ("d",),
                   buckets: int | None = None) -> None:
    """Table of the session's catalogue, in one sorted file per bucket of ``keys``.

    It is shuffled once, when it is written; every window by its keys reads it in
    place afterwards.  Its files lie in the warehouse, which all executors share.
    """
    count = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(count, *keys).write.mode("errorifexists").format("parquet")
     .bucketBy(count, *keys).sortBy(*keys, *order).saveAsTable(table))


@dataclass(frozen=True)
class Section:
    """A table to write, the columns its content hash covers, and what it was made of."""

    rows: DataFrame
    digest: Sequence[Column]
    parents: Sequence[str] = field(default_factory=tuple)
    kind: str = DERIVED
    date: str = "d"


RECORD = ("dataset_id string, kind string, source_url string, retrieved_at timestamp, rows bigint, first_obs date, last_obs date, "
          "content_hash string, parents array<string>")


def write_recorded(sections: Mapping[str, Section], path: str) -> DataFrame:
    """Write every section below ``path`` and return their birth certificates.

    Rows, dates and the content hash are observed in the pass that writes a
    section: nothing is read again.  One record per section; the hash is a sum of
    row digests, so it does not depend on the order of rows.
    """
    spark = next(iter(sections.values())).rows.sparkSession
    records = []
    for name, section in sections.items():
        seen = Observation(name)
        target = f"{path.rstrip('/')}/{name}"
        section.rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.min(section.date).alias("first_obs"), F.max(section.date).alias("last_obs"),
                             F.sum(row_digest(section.digest)).cast("string").alias("content_hash")).write.mode("errorifexists").parquet(target)
        found = seen.get
        records.append((name, section.kind, target, datetime.now(timezone.utc), found["rows"], found["first_obs"], found["last_obs"], found["content_hash"], list(section.parents)))
    return spark.createDataFrame(records, RECORD)
