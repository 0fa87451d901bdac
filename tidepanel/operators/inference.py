"""Sharpe statistics that account for sample length, tails and trial count."""

from __future__ import annotations

import math
from itertools import combinations
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidepanel.functions.numeric import ROWS_PER_YEAR, as_col, by_series, so_far
from tidepanel.functions.probability import norm_cdf, norm_ppf, norm_ppf_value
from tidepanel.operators.running import join_null_safe, running_aggregates
from tidepanel.runtime import written

EULER_GAMMA = 0.5772156649015329
KEYS = ("ticker", "strategy")


def sharpe_agg(r: Column | str, risk_free: float = 0.0, annualize: bool = True) -> Column:
    """Aggregate: mean excess return over its deviation, NULL for constant or
    fewer than two returns."""
    r = as_col(r)
    value = (F.avg(r) - risk_free / ROWS_PER_YEAR) / F.stddev_samp(r)
    if annualize:
        value = value * math.sqrt(ROWS_PER_YEAR)
    return F.when((F.count(r) >= 2) & (F.max(r) > F.min(r)) & (F.stddev_samp(r) > 0), value)


def moment_aggs(r: str = "net") -> list[Column]:
    """n, per-row Sharpe, bias-corrected skewness and raw kurtosis."""
    n = F.count(r).cast("double")
    g1, g2 = F.skewness(r), F.kurtosis(r)
    varies = F.max(r) > F.min(r)
    skew = F.when(varies & (n > 2), g1 * F.sqrt(n * (n - 1)) / (n - 2))
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6) + 3
    kurt = F.when(varies & (n > 3), corrected).when(varies & (n == 3), g2 + 3)
    return [F.count(r).alias("observations"), sharpe_agg(r).alias("sharpe_annual"),
            sharpe_agg(r, annualize=False).alias("sharpe_row"), skew.alias("skew"), kurt.alias("kurt")]


def _spread() -> Column:
    sr = F.col("sharpe_row")
    return 1 - F.col("skew") * sr + (F.col("kurt") - 1) / 4 * sr * sr


def with_psr(df: DataFrame, benchmark: Column | float = 0.0, out: str = "psr") -> DataFrame:
    """Probability that the true Sharpe exceeds ``benchmark`` (per row)."""
    target = F.lit(float(benchmark)) if isinstance(benchmark, (int, float)) else benchmark
    z = ((F.col("sharpe_row") - target) * F.sqrt(F.col("observations") - 1)
         / F.sqrt(F.greatest(_spread(), F.lit(1e-12))))
    z = F.when((F.col("observations") >= 3) & F.col("sharpe_row").isNotNull(), z)
    return df.withColumn("_z", z).withColumn(out, norm_cdf("_z")).drop("_z")


def with_expected_max(df: DataFrame, trials: Column | int, variance: Column,
                      out: str = "expected_max_sharpe") -> DataFrame:
    """Expected best Sharpe among ``trials`` strategies without skill."""
    if isinstance(trials, int) and trials < 1:
        raise ValueError("trials must be at least 1")
    n = (F.lit(trials) if isinstance(trials, int) else trials).cast("double")
    sigma = F.sqrt(F.greatest(variance, F.lit(1e-12)))
    best = sigma * ((1 - EULER_GAMMA) * F.col("_z1") + EULER_GAMMA * F.col("_z2"))
    return (df.withColumn("_n", n)
            .withColumn("_p1", 1 - 1 / F.col("_n"))
            .withColumn("_p2", 1 - 1 / (F.col("_n") * math.e))
            .withColumn("_z1", norm_ppf("_p1")).withColumn("_z2", norm_ppf("_p2"))
            .withColumn(out, F.when(F.col("_n") == 1, F.lit(0.0)).when(F.col("_n") > 1, best))
            .drop("_n", "_p1", "_p2", "_z1", "_z2"))


def default_variance() -> Column:
    """Asymptotic variance of a Sharpe ratio, used when trials were not observed."""
    return 1 / F.greatest(F.col("observations") - 1, F.lit(1)).cast("double")


def min_track_record(confidence: float = 0.95, benchmark: float = 0.0) -> Column:
    """Rows needed to tell the Sharpe from ``benchmark``; infinite if not above it."""
    sr, z = F.col("sharpe_row"), norm_ppf_value(confidence)
    need = 1 + _spread() * F.pow(z / (sr - benchmark), 2)
    return (F.when(F.col("observations") < 3, F.lit(None).cast("double"))
            .when(sr.isNull() | (sr <= benchmark), F.lit(float("inf")))
            .otherwise(need))


def sharpe_assessment(panel: DataFrame, trials: int = 1, trial_variance: DataFrame | Sequence[str] | None = None,
                      keys: Sequence[str] = KEYS, r: str = "net") -> DataFrame:
    """One row per series with every Sharpe statistic.

    ``trial_variance``: the variance of the per-row Sharpe across trials, as a table
    with some of the keys and ``trial_var``, or as the keys of the group whose
    members are the trials: it then comes from the rows at hand.
    """
    out = panel.groupBy(*keys).agg(*moment_aggs(r))
    variance = default_variance()
    if isinstance(trial_variance, (list, tuple)):
        out = out.withColumn("trial_var", F.var_samp("sharpe_row").over(Window.partitionBy(*trial_variance)))
        variance = F.coalesce(F.col("trial_var"), variance)
        trial_variance = None
    if trial_variance is not None:
        on = [k for k in keys if k in trial_variance.columns]
        out = out.join(trial_variance, on, "left")
        variance = F.coalesce(F.col("trial_var"), variance)
    out = with_expected_max(out, trials, variance)
    out = with_psr(with_psr(out), F.col("expected_max_sharpe"), out="deflated_sharpe")
    return (out.withColumn("trials", F.lit(trials))
            .withColumn("min_track_record", min_track_record())
            .withColumn("verdict", sharpe_verdict())
            .drop("trial_var"))


def trial_variance(panel: DataFrame, group: Sequence[str] = ("ticker",), trial: str = "strategy",
                   r: str = "net") -> DataFrame:
    """Variance of the per-row Sharpe ratios over the trials of a group."""
    each = panel.groupBy(*group, trial).agg(sharpe_agg(r, annualize=False).alias("_s"))
    return each.groupBy(*group).agg(F.var_samp("_s").alias("trial_var"))


def sharpe_verdict() -> Column:
    dsr = F.col("deflated_sharpe")
    return (F.when(F.col("observations") < 252, "INSUFFICIENT_SAMPLE")
            .when(dsr >= 0.95, "SURVIVES_95")
            .when(dsr >= 0.90, "MODERATE_90")
            .otherwise("NO_EVIDENCE"))


def track_record_verdict() -> Column:
    return F.when(F.col("min_track_record") > F.col("observations"), "TOO_SHORT").otherwise("LONG_ENOUGH")


def pbo_verdict(pbo: str = "pbo") -> Column:
    p = F.col(pbo)
    return (F.when(p.isNull(), "NOT_COMPUTABLE").when(p < 0.10, "ROBUST")
            .when(p < 0.50, "MODERATE_OVERFITTING").otherwise("OVERFITTED"))


def interval_includes_zero(low: str = "ci_low", high: str = "ci_high") -> Column:
    return F.coalesce((F.col(low) <= 0) & (F.col(high) >= 0), F.lit(False))


# --- stationary bootstrap -------------------------------------------------

# Modulus and multiplier of the Park-Miller generator.
_MODULUS, _MULTIPLIER = 2 ** 31 - 1, 48271
_TABLE = 256  # powers are tabulated in four levels, more than the generator's period


def _powers(step: int) -> Column:
    """Array literal of ``multiplier ** (step * i)`` for i = 0 .. 255."""
    return F.array(*[F.lit(pow(_MULTIPLIER, step * i, _MODULUS)).cast("long") for i in range(_TABLE)])


def _uniform(seed: Column, i: Column) -> Column:
    """The i-th uniform in (0, 1) of a seed, without drawing those before it."""
    i = i.cast("long") % (_MODULUS - 1)

    def level(k: int) -> Column:
        return F.element_at(_powers(_TABLE ** k), (F.shiftright(i, 8 * k) % _TABLE + 1).cast("int"))

    near = seed * level(0) % _MODULUS * level(1) % _MODULUS
    value = F.when(i < _TABLE ** 2, near).otherwise(near * level(2) % _MODULUS * level(3) % _MODULUS)
    return value.cast("double") / float(_MODULUS)


def wrapped_positions(start: Column, length: int, n: Column) -> Column:
    """Row positions of a block that wraps around the end of its series."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: ((start + i) % n).cast("int"))


def _prefix_sums(returns: DataFrame, r: str) -> DataFrame:
    """(_sid, pos, s1, s2): sums of the first ``pos`` returns and of their squares, for 0 to twice the length of a
    series, so that a block that wraps around is a difference as well."""
    w = by_series(["_sid"])
    whole = Window.partitionBy("_sid")
    rows = returns.select(
        "_sid", F.row_number().over(w).alias("pos"), F.count(F.lit(1)).over(whole).alias("n"),
        F.sum(r).over(so_far(w)).alias("s1"), F.sum(F.col(r) * F.col(r)).over(so_far(w)).alias("s2"),
        F.sum(r).over(whole).alias("t1"), F.sum(F.col(r) * F.col(r)).over(whole).alias("t2"))

    def entry(pos: Column, s1: Column, s2: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), s1.alias("s1"), s2.alias("s2"))

    zero = entry(F.lit(0), F.lit(0.0), F.lit(0.0))
    own, again = entry(F.col("pos"), F.col("s1"), F.col("s2")), entry(F.col("pos") + F.col("n"), F.col("s1") + F.col("t1"), F.col("s2") + F.col("t2"))
    return rows.select("_sid", F.inline(F.when(F.col("pos") == 1, F.array(zero, own, again)).otherwise(F.array(own, again))))


def _block_sums(replicates: DataFrame, prefix: DataFrame, draws: Column, p: float) -> DataFrame:
    """Sums over the blocks of each replicate (_sid, _rep, n, seed), from its first ``draws`` draws: one row per block, cut
    off where the replicate is full.  Blocks live where their replicate does; only the prefix sums travel."""
    n = F.col("n")
    blocks = replicates.select("_sid", "_rep", "n", "seed", F.explode(F.sequence(F.lit(0), draws - 1)).alias("_k"))
    length = F.lit(1.0) if p == 1.0 else 1 + F.floor(F.ln(_uniform(F.col("seed"), 2 * F.col("_k") + 1)) / math.log(1 - p))
    blocks = blocks.select("_sid", "_rep", "n", "_k", F.floor(_uniform(F.col("seed"), 2 * F.col("_k")) * n).cast("int").alias("_start"),
                           F.least(length, n).cast("int").alias("_len"))
    order = Window.partitionBy("_rep").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (blocks.withColumn("_before", F.sum("_len").over(order) - F.col("_len")).filter(F.col("_before") < n)
              .withColumn("_take", F.least("_len", n - F.col("_before")).cast("int")).withColumn("_stop", F.col("_start") + F.col("_take")))
    begin = prefix.select("_sid", F.col("pos").alias("_start"), F.col("s1").alias("_b1"), F.col("s2").alias("_b2"))
    stop = prefix.select("_sid", F.col("pos").alias("_stop"), F.col("s1").alias("_e1"), F.col("s2").alias("_e2"))
    found = blocks.join(begin, ["_sid", "_start"]).join(stop, ["_sid", "_stop"])
    return found.groupBy("_rep").agg(
        F.sum(F.col("_e1") - F.col("_b1")).alias("sum_r"), F.sum(F.col("_e2") - F.col("_b2")).alias("sum_r2"),
        F.count(F.lit(1)).cast("int").alias("blocks"), F.sum("_take").alias("rows_drawn"))


def bootstrap_replicates(panel: DataFrame, keys: Sequence[str] = KEYS, r: str = "net",
                         replicates: int = 2000, mean_block: float = 21.0, seed: int = 42) -> DataFrame:
    """Stationary-bootstrap replicates: sums of the drawn returns and their squares,
    and the shape of the draw (blocks, rows drawn).

    Blocks wrap around and have geometric lengths drawn by inversion, so a
    replicate needs about ``n / mean_block`` draws rather than ``n``.  A block is
    a run of neighbouring rows: its sums are differences of prefix sums.  Blocks
    are rows of a few numbers, generated where their replicate lives; replicates
    are dealt over all tasks, so few series still fill a cluster.

    The generator is seeded by a digest of (seed, series, replicate), so any task
    can repeat a draw.  Blocks are drawn until the replicate is full: usually a
    number with six standard deviations of room does it, and the others are drawn
    again with as many as always suffice, one per row.
    """
    keys = list(keys)
    returns = written(panel.filter(F.col(r).isNotNull()).select(*keys, "d", r), "returns")
    series = (returns.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sharpe_agg(r).alias("sharpe"), F.sum(r).alias("t1"))
              .withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1).cast("long")))
    series = running_aggregates(series, ["_all"], keys, {"_sid": ("sum", "_one")}).withColumn("_sid", F.col("_sid").cast("int"))
    series = written(series.drop("_all", "_one"), "series")
    prefix = written(_prefix_sums(join_null_safe(returns, series.select(*keys, "_sid"), keys), r), "prefix")
    label = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("b").cast("string"))
    digest = F.conv(F.substring(F.md5(label), 1, 12), 16, 10).cast("long") % (_MODULUS - 1) + 1
    tasks = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = (series.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
            .select("_sid", "n", digest.alias("seed"), (F.col("_sid").cast("long") * replicates + F.col("b") - 1).alias("_rep"))
            .repartition(tasks, "_rep"))

    p = 1.0 / max(mean_block, 1.0)
    n = F.col("n").cast("double")
    usual = F.least(n, F.ceil(n * p + 6 * F.sqrt(n * p * (1 - p)) + 10)).cast("int")
    drawn = written(_block_sums(each, prefix, usual, p), "replicates")

    def named(sums: DataFrame) -> DataFrame:
        sums = sums.withColumn("_sid", F.floor(F.col("_rep") / replicates).cast("int")).withColumn("b", (F.col("_rep") % replicates + 1).cast("int"))
        return sums.join(series, "_sid")

    short = named(drawn).filter("rows_drawn < n").select("_rep")
    if not short.isEmpty():
        rest = _block_sums(each.join(short, "_rep", "left_semi").repartition(tasks, "_rep"), prefix, F.col("n").cast("int"), p)
        drawn = drawn.join(short, "_rep", "left_anti").unionByName(rest)
    return named(drawn).select(*keys, "b", "n", "sharpe", "sum_r", "sum_r2", "t1", "blocks", "rows_drawn")


def bootstrap_sharpe(panel: DataFrame, keys: Sequence[str] = KEYS, r: str = "net",
                     replicates: int = 2000, mean_block: float = 21.0, confidence: float = 0.95,
                     seed: int = 42, min_rows: int = 30) -> DataFrame:
    """Percentile interval of the annual Sharpe and the one-sided p-value of the mean.

    Under 30 rows only the point estimate is kept; a constant series has none.
    """
    reps = bootstrap_replicates(panel, keys, r, replicates, mean_block, seed)
    n = F.col("n").cast("double")
    mean = F.col("sum_r") / n
    var = (F.col("sum_r2") - n * mean * mean) / (n - 1)
    srep = F.when(var > 1e-20, mean / F.sqrt(var) * math.sqrt(ROWS_PER_YEAR))
    reps = reps.select(*keys, "n", "sharpe", srep.alias("_s"), mean.alias("_m"), (F.col("t1") / n).alias("_obs"))
    tail = (1 - confidence) / 2
    # The point estimate rides along with the replicates: the panel is read once.
    bands = reps.groupBy(*keys).agg(
        F.first("n").alias("observations"), F.first("sharpe").alias("sharpe"),
        F.percentile("_s", F.lit(tail)).alias("_low"), F.percentile("_s", F.lit(1 - tail)).alias("_high"),
        F.count_if(F.col("_m") - F.col("_obs") >= F.abs(F.col("_obs"))).alias("_hits"))
    usable = (F.col("observations") >= min_rows) & F.col("sharpe").isNotNull()
    return bands.select(*keys, "observations", "sharpe",
                        F.when(usable, F.col("_low")).alias("ci_low"),
                        F.when(usable, F.col("_high")).alias("ci_high"),
                        F.when(usable, (F.col("_hits") + 1) / (replicates + 1)).alias("p_value"))


# --- combinatorially symmetric cross-validation ---------------------------

def cscv_splits(n_splits: int) -> list[tuple[int, list[int]]]:
    """All ways to take half of the blocks as in-sample (252 for ten blocks)."""
    if n_splits % 2:
        raise ValueError("n_splits must be even")
    return list(enumerate(list(c) for c in combinations(range(n_splits), n_splits // 2)))


def split_table(spark: SparkSession, n_splits: int) -> DataFrame:
    """The same splits as rows (combo, block, in_sample), made by the executors: halves
    are the numbers with half of their bits set, the first block being the highest bit."""
    if n_splits % 2:
        raise ValueError("n_splits must be even")
    halves = spark.range(1 << n_splits).filter(F.bit_count("id") == n_splits // 2)
    # the number of a half is the number of halves above it: at each block left out, those that agree before and take it
    place = F.lit(0).cast("long")
    for block in range(n_splits):
        taken = F.bit_count(F.shiftright("id", n_splits - block))
        here = F.shiftright("id", n_splits - 1 - block).bitwiseAND(F.lit(1))
        ways = F.array(*[F.lit(math.comb(n_splits - 1 - block, n_splits // 2 - 1 - k) if k < n_splits // 2 else 0) for k in range(n_splits + 1)])
        place = place + F.when(here == 0, F.get(ways, taken)).otherwise(0)
    numbered = halves.withColumn("combo", place)
    table = numbered.select("combo", "id", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("block"))
    bit = F.expr(f"shiftright(id, {n_splits - 1} - block)").bitwiseAND(F.lit(1))
    return table.select("combo", "block", (bit == 1).alias("in_sample"))


def cscv_blocks(trials: DataFrame, group: Sequence[str], trial: str = "strategy", r: str = "net",
                n_splits: int = 10) -> DataFrame:
    """Mergeable moments of every (block, trial), using only complete dates.

    Dates on which a trial is missing are dropped; the remainder of the division
    into blocks goes to the last one.
    """
    group = list(group)
    known = trials.filter(F.col(r).isNotNull())
    n_trials = trials.groupBy(*group, trial).agg(F.lit(1).alias("_x")).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_trials"))
    dates = (known.groupBy(*group, "d").agg(F.count(F.lit(1)).alias("_have")).join(n_trials, group)
             .filter(F.col("_have") == F.col("n_trials")))
    w = Window.partitionBy(*group)
    size = F.floor(F.col("_dates") / n_splits)
    dates = (dates.withColumn("_dates", F.count(F.lit(1)).over(w))
             .withColumn("_pos", F.row_number().over(w.orderBy("d")) - 1)
             .filter((F.col("n_trials") >= 2) & (F.col("_dates") >= 2 * n_splits))
             .select(*group, "d", "n_trials", F.least(F.floor(F.col("_pos") / size), F.lit(n_splits - 1))
                     .cast("int").alias("block")))
    return (known.join(dates, [*group, "d"])
            .groupBy(*group, "n_trials", trial, "block")
            .agg(F.count(r).alias("n"), F.sum(r).alias("s1"), F.sum(F.col(r) * F.col(r)).alias("s2"),
                 F.min(r).alias("lo"), F.max(r).alias("hi")))


def pbo_logits(trials: DataFrame, group: Sequence[str] = ("ticker",), trial: str = "strategy",
               r: str = "net", n_splits: int = 10) -> DataFrame:
    """One row per split: the in-sample winner and the logit of its out-of-sample rank."""
    group = list(group)
    blocks = cscv_blocks(trials, group, trial, r, n_splits)
    splits = split_table(trials.sparkSession, n_splits)
    if n_splits <= 16:  # 205,920 small rows at most; more are joined by shuffle
        splits = F.broadcast(splits)

    def side(flag: bool) -> list[Column]:
        pick = F.col("in_sample") == flag
        n = F.sum(F.when(pick, F.col("n"))).cast("double")
        s1, s2 = F.sum(F.when(pick, F.col("s1"))), F.sum(F.when(pick, F.col("s2")))
        varies = F.max(F.when(pick, F.col("hi"))) > F.min(F.when(pick, F.col("lo")))
        sd = F.sqrt((s2 - s1 * s1 / n) / (n - 1))
        # Twelve digits: trials with the same returns must tie whatever the order of summation.
        return [F.round(F.when((n >= 2) & varies & (sd > 0), s1 / n / sd), 12).alias("is_sr" if flag else "oos_sr")]

    # Hashing the small moments by trial keeps the widened rows in place.
    each = (blocks.repartition(*group, trial).join(splits, "block").groupBy(*group, "n_trials", "combo", trial)
            .agg(*side(True), *side(False)))
    best = (each.groupBy(*group, "combo")
            .agg(F.min_by(F.struct(F.col(trial).alias("winner"), F.col("oos_sr").alias("winner_oos")),
                          F.when(F.col("is_sr").isNotNull(), F.struct((-F.col("is_sr")).alias("a"), F.col(trial).alias("t"))))
                 .alias("_b"), F.count("oos_sr").alias("_ranked"))
            .filter("_b IS NOT NULL AND _ranked > 0").select(*group, "combo", "_b.*"))
    rank = F.count_if(F.col("oos_sr") < F.col("winner_oos")) + (F.count_if(F.col("oos_sr") == F.col("winner_oos")) + 1) / 2
    ranked = each.join(best, [*group, "combo"]).groupBy(*group, "n_trials", "combo", "winner").agg(
        F.when(F.max("winner_oos").isNotNull(), rank).alias("rank"))
    omega = F.least(F.greatest(F.col("rank") / (F.col("n_trials") + 1.0), F.lit(1e-6)), F.lit(1 - 1e-6))
    return (ranked.withColumn("omega", F.when(F.col("rank").isNotNull(), omega))
            .withColumn("logit", F.ln(F.col("omega") / (1 - F.col("omega")))))


def pbo(trials: DataFrame, group: Sequence[str] = ("ticker",), trial: str = "strategy",
        r: str = "net", n_splits: int = 10) -> DataFrame:
    """Share of splits whose in-sample winner falls below the out-of-sample median.
    A group that cannot be computed stays, without a share and NOT_COMPUTABLE."""
    logits = pbo_logits(trials, group, trial, r, n_splits)
    shares = logits.groupBy(*group).agg(
        F.avg(F.coalesce((F.col("logit") < 0).cast("double"), F.lit(0.0))).alias("pbo"),
        F.count(F.lit(1)).alias("n_combinations"), F.percentile("logit", F.lit(0.5)).alias("median_logit"))
    return (trials.select(*group).distinct().join(shares, list(group), "left")
            .withColumn("n_combinations", F.coalesce("n_combinations", F.lit(0)))
            .withColumn("pbo_verdict", pbo_verdict()))
