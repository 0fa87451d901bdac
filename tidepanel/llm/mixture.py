"""Mixing sources to target weights by repeating documents.

Words are summed by source on the map side; the few numbers of each source give its target and its rate. A document is then
taken floor(rate) times and, with the rest as probability, once more, decided by a hash of the document and a seed. Only the
table of sources is joined to the documents; no document is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import numbered, stored

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 2024
WORD = r"[^\x20\x09-\x0D]+"
#: Tables of sources up to this size are sent to all executors; beyond it only those with many documents are.
BROADCAST_BYTES = 32_000_000


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def coin_of(doc_id: Column, text: Column, seed: int) -> Column:
    """A number from 0 to below 1 by a hash of the seed, the id and the text; nulls count as empty."""
    named = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights: Sequence[float] | DataFrame = WEIGHTS, most: float = MOST) -> DataFrame:
    """Targets from documents' sources and sizes, one row per source: (source, rows, source_size, weight, target).

    ``weights`` repeat over the sources in code-point order, null last, or are a table (source, weight) of distinct
    sources, where a source without a weight gets none. Targets share the size of all documents by weight, stop at ``most``
    times their source's size, and what is left over is shared by the others again until none is above. That is one level
    for all: a target is level * weight or its limit. Each round raises the level with sums over the sources.
    """
    sizes = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("source_size"))
    if isinstance(weights, DataFrame):
        given = weights.select(F.col("source").alias("of"), "weight")
        table = sizes.join(given, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(0.0))).drop("of")
    else:
        table = numbered(stored(sizes, "sizes"), [F.col("source").asc_nulls_last()], "place")
        each = F.array(*[F.lit(float(w)) for w in weights])
        table = table.withColumn("weight", F.get(each, F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int"))).drop("place")
    table = stored(table, "sources")
    limit = F.col("source_size") * F.lit(float(most))
    whole = table.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total, weight, capped, level = whole["size"] or 0, whole["weight"] or 0.0, -1, 0.0
    level = total / weight if weight else 0.0
    while level:
        above = F.lit(level) * F.col("weight") > limit
        now = table.agg(F.count_if(above).alias("n"), F.sum(F.when(above, limit)).alias("limits"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if now["n"] == capped or not now["open"]:
            break
        capped, level = now["n"], max(level, (total - (now["limits"] or 0.0)) / now["open"])
    return table.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit))


def _with_targets(rows: DataFrame, table: DataFrame) -> DataFrame:
    """The rows (in, coin, ...) with their source's columns and the copies that are taken of each."""
    table = table.withColumnRenamed("source", "of")
    same = F.col("in").eqNullSafe(F.col("of"))
    facts = table.agg(F.sum(F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)) + 64).alias("bytes"), F.sum("rows").alias("rows")).first()
    if (facts["bytes"] or 0) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(table), same)
    else:
        # sources with many rows are few; the others have few rows for each key of the shuffle
        share = facts["rows"] // 10_000
        many = F.broadcast(table.filter(F.col("rows") > share))
        joined = rows.join(many, same).unionByName(rows.join(many, same, "left_anti").join(table.filter(F.col("rows") <= share).hint("merge"), same))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return joined.withColumn("copies", F.floor(rate) + F.when(F.col("coin") < rate - F.floor(rate), 1).otherwise(0))


def plan_mixture(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] | DataFrame = WEIGHTS,
                 most: float = MOST, seed: int = SEED) -> DataFrame:
    """What the mix takes of every document: (doc_id, size, source_size, target, copies, taken), sizes in words.

    A document is taken floor(rate) times, and once more with the fraction as probability, so its source's words come near
    the target and none is taken more than ``most`` times (rounded up). A rerun takes the same; another seed takes others. Null texts have
    size 0; a null source is a source. Equal rows decide alike. Other columns are not read. Sources without a word have
    target 0 and are not taken. An empty table gives an empty one.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(source).alias("in"), size_of(F.col(text)).alias("size"), coin_of(F.col(doc_id), F.col(text), seed).alias("coin"))
    rows = stored(rows, "sized")  # the texts are read once
    found = _with_targets(rows, source_targets(rows.select(F.col("in").alias("source"), "size"), weights, most))
    return found.select(F.col("id").alias(doc_id), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] | DataFrame = WEIGHTS,
                  most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` with all its columns, whatever their names, as often as ``plan_mixture`` takes it."""
    sized = docs.select(F.col(source).alias("source"), size_of(F.col(text)).alias("size"))
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("in"), coin_of(F.col(doc_id), F.col(text), seed).alias("coin"))
    found = _with_targets(rows, source_targets(sized, weights, most)).filter("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
