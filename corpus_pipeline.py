"""Corpus pipeline: quality, language, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all that the one before it kept, and is written as Parquet to the shared
folder before the next one reads it. All but the last return the columns of their input. Further columns of documents go
along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import cotraining, groups, language, packing
from tidepanel.llm.common import crc_fold, stored

#: A document stays if its main language holds at least this share of it.
LANGUAGE_SHARE = 0.5


#: The columns that stages read.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keeping_columns(stage: Stage) -> Stage:
    """The stage with all further columns under names of their own, so that they meet none of its own columns."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = [c if c in DOCUMENT else f"further {k}" for k, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inside), sf_dir).toDF(*docs.columns)

    return run_stage


@keeping_columns
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    scorer = cotraining.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.score_documents(docs, scorer, keep=tuple(docs.columns)).filter("accepted").select(*docs.columns)


@keeping_columns
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that holds at least half of them; without a letter there is none."""
    model = language.fit(docs.filter(crc_fold(F.col("doc_id")) != 0))
    found = language.identify(docs, model, keep=tuple(docs.columns))
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_SHARE)).select(*docs.columns)


@keeping_columns
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates: the one with the smallest id, a null id being the largest, and of equal
    ids the first by a hash of the text.

    Every row is judged by its own text, so an id that stands at several texts is in the group of each. Texts without a
    word are in no group; of rows that repeat such a text and an id one stays.
    """
    found = groups.link_rows(docs).groupBy(F.col("doc_id").alias("an id"), F.col("text_key").alias("a text"))
    found = stored(found.agg(F.count("*").alias("rows"), F.max("component").alias("component")), "components")
    first = found.filter("component is not null").groupBy("component").agg(F.min(F.struct(F.col("an id").isNull(), "an id", "a text")).alias("row"))
    first = first.select(F.col("row.an id").alias("first id"), F.col("row.a text").alias("first text"), F.lit(True).alias("stays"))
    same = F.col("an id").eqNullSafe(F.col("first id")) & (F.col("a text") == F.col("first text"))
    found = found.join(first, same, "left").withColumn("stays", F.col("stays").isNotNull() | F.col("component").isNull())
    found = stored(found.filter("not stays or rows > 1 and (component is not null or `an id` is not null)").select("an id", "a text", "stays"), "ids")
    gone, repeated = found.filter("not stays").drop("stays"), found.filter("stays").drop("stays")
    if found.count() <= groups.BROADCAST_ROWS:
        gone, repeated = F.broadcast(gone), F.broadcast(repeated)
    own = F.col("doc_id").eqNullSafe(F.col("an id")) & (F.xxhash64("text") == F.col("a text"))
    left = docs.join(gone, own, "left_anti")
    again = left.join(repeated, own, "left_semi").withColumn("text key", F.xxhash64("text")).dropDuplicates(["doc_id", "text key"])
    return left.join(repeated, own, "left_anti").select(*docs.columns).union(again.select(*docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("language", known_language), ("near_duplicates", one_of_each_group), ("packing", packed)]

#: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
