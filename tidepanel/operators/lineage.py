"""Fingerprints, ancestor closure and the contamination gate."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.runtime import materialise, written

OBSERVED, DERIVED, SYNTHETIC = "observed", "derived", "synthetic"


class ContaminatedDataError(RuntimeError):
    """A series with a synthetic ancestor was about to be reported."""


class MissingDataError(RuntimeError):
    """A required input is absent; nothing is filled in for it."""


def row_digest(columns: Sequence[Column]) -> Column:
    """60 bits of the digest of a row, as an exact number."""
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame, columns: Sequence[Column], keys: Sequence[str] = ("ticker",),
                date: str = "d") -> DataFrame:
    """Rows, first and last date, and a content hash that ignores row order.

    The hash is a sum of row digests, so it is a mergeable aggregate and works
    on data of any size.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(date).alias("first_obs"), F.max(date).alias("last_obs"),
        F.sum(row_digest(columns)).cast("string").alias("content_hash"))


def provenance(fingerprints: DataFrame, kind: str, source_id: Column, source_url: Column,
               parents: Column | None = None, notes: str = "") -> DataFrame:
    """Birth certificate of each dataset."""
    return fingerprints.select(
        source_id.alias("dataset_id"), F.lit(kind).alias("kind"), source_id.alias("source_id"),
        source_url.alias("source_url"), F.current_timestamp().alias("retrieved_at"), "rows", "first_obs",
        "last_obs", "content_hash",
        (parents if parents is not None else F.array().cast("array<string>")).alias("parents"),
        F.lit(notes).alias("notes"))


def edges_of(provenance_table: DataFrame) -> DataFrame:
    return provenance_table.select(F.col("dataset_id").alias("child"), F.explode("parents").alias("parent"))


class CyclicLineageError(RuntimeError):
    """A dataset is its own ancestor."""


def ancestors(edges: DataFrame) -> DataFrame:
    """All (dataset, ancestor) pairs with the shortest distance, for chains of any depth.

    The covered distance doubles with every round, but only new pairs are joined:
    a pair that is more than ``reach`` and at most twice as far apart consists of
    one exactly ``reach`` apart, which the round before has found, and a known one.
    So a round joins no pair that an earlier round has joined, and it ends when
    nothing lies ``reach`` apart.  Each round's new pairs are written once.
    """
    fresh = written(edges.select(F.col("child").alias("dataset_id"), F.col("parent").alias("ancestor"),
                                 F.lit(1).alias("depth")).distinct(), "pairs")
    known, reach = fresh, 1
    while True:
        own = [r[0] for r in fresh.filter("dataset_id = ancestor").select("dataset_id").take(10)]
        if own:
            raise CyclicLineageError("their own ancestors: " + ", ".join(map(str, own)))
        far = fresh.filter(F.col("depth") == reach)
        if far.isEmpty():
            return known
        fresh = written(further_pairs(far, known).join(known.select("dataset_id", "ancestor"), ["dataset_id", "ancestor"], "left_anti"), "pairs")
        known, reach = known.unionByName(fresh), 2 * reach


def further_pairs(far: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs behind the ends of ``far``, each with the shortest way found."""
    above = known.select(F.col("dataset_id").alias("ancestor"), F.col("ancestor").alias("_above"), F.col("depth").alias("_more"))
    step = far.join(above, "ancestor").select("dataset_id", F.col("_above").alias("ancestor"), (F.col("depth") + F.col("_more")).alias("depth"))
    return step.groupBy("dataset_id", "ancestor").agg(F.min("depth").alias("depth"))


def tainted(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Datasets that are synthetic or have a synthetic ancestor.

    Only the set of tainted ids travels from parents to children, one level per
    round; no pair of dataset and ancestor is built.  Known ids never travel
    again, so the rounds end at any depth.
    """
    edges = materialise(edges.distinct())
    frontier = materialise(nodes.filter(F.col("kind") == SYNTHETIC).select("dataset_id").distinct())
    found = frontier
    while not frontier.isEmpty():
        step = (edges.join(frontier, edges.parent == frontier.dataset_id, "left_semi")
                .select(F.col("child").alias("dataset_id")).distinct()
                .join(found, "dataset_id", "left_anti"))
        frontier = materialise(step)
        found = found.unionByName(frontier)
    return found


def derived_kind(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Kind after propagation: derived data of a synthetic input is synthetic."""
    bad = tainted(nodes, edges).withColumn("_bad", F.lit(True))
    return (nodes.join(bad, "dataset_id", "left")
            .withColumn("kind", F.when(F.col("_bad"), F.lit(SYNTHETIC)).otherwise(F.col("kind"))).drop("_bad"))


def assert_report_safe(nodes: DataFrame, edges: DataFrame, reported: DataFrame) -> None:
    """Raise if any reported dataset is tainted; at most ten ids are fetched."""
    bad = reported.join(tainted(nodes, edges), "dataset_id", "left_semi").select("dataset_id").take(10)
    if bad:
        raise ContaminatedDataError("synthetic ancestors in: " + ", ".join(str(r[0]) for r in bad))


def merge_lineages(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of ancestor lists without repeats."""
    out = first.select("dataset_id", "ancestor")
    for o in others:
        out = out.unionByName(o.select("dataset_id", "ancestor"))
    return out.distinct()
