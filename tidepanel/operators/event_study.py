"""Abnormal returns around dated events.

Everything an event needs depends only on its series and its anchor row (the
first row on or after the event date).  The market model and the abnormal
returns are therefore computed once per series and row with sliding frames,
which the calendar bounds, and events only look them up: no event is expanded
into its 250 estimation rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.numeric import by_series, ratio, so_far
from tidepanel.functions.probability import t_two_sided
from tidepanel.operators.indicators import KEYS, simple_return_col
from tidepanel.operators.quantiles import exact_quantiles
from tidepanel.operators.running import join_null_safe
from tidepanel.runtime import written


@dataclass(frozen=True)
class EventParams:
    estimation_window: int = 250
    estimation_gap: int = 30
    pre: int = 1
    post: int = 3
    min_observations: int = 100


def asset_and_market(panel: DataFrame, market: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Returns of each series with the market return of the date (NULL if none)."""
    r = panel.select(*keys, "d", simple_return_col(by_series(keys)).alias("r")).filter("r IS NOT NULL")
    return r.join(market, "d", "left")


def market_model(returns: DataFrame, params: EventParams = EventParams(),
                 keys: Sequence[str] = KEYS) -> DataFrame:
    """Least squares of the asset on the market, for every possible anchor row.

    The estimation window ends ``gap`` rows before the anchor and holds
    ``estimation_window + 1`` rows, fewer at the start of a series.  Its sums are
    differences of running sums, so the work per row does not grow with the
    window.
    """
    w = by_series(keys)
    both = F.col("r").isNotNull() & F.col("market_r").isNotNull()
    x, y = F.when(both, F.col("market_r")), F.when(both, F.col("r"))
    terms = {"n": both.cast("double"), "x": x, "y": y, "xx": x * x, "xy": x * y, "yy": y * y}
    last, before = params.estimation_gap, params.estimation_gap + params.estimation_window + 1
    zero = F.lit(0.0)
    running = returns.select("*", (F.row_number().over(w) - 1).alias("pos"), *[
        F.sum(F.coalesce(term, zero)).over(so_far(w)).alias(f"_c_{name}") for name, term in terms.items()])
    sums = running.select(*returns.columns, "pos", *[
        (F.coalesce(F.lag(f"_c_{name}", last).over(w), zero)
         - F.coalesce(F.lag(f"_c_{name}", before).over(w), zero)).alias(f"_{name}") for name in terms])
    c = {name: F.col(f"_{name}") for name in terms}
    moments = (sums.withColumn("_sxx", c["xx"] - ratio(c["x"] * c["x"], c["n"]))
               .withColumn("_sxy", c["xy"] - ratio(c["x"] * c["y"], c["n"]))
               .withColumn("_syy", c["yy"] - ratio(c["y"] * c["y"], c["n"])))
    ok = ((F.col("_n") >= params.min_observations) & (F.col("_sxx") > 0)
          & (F.col("pos") >= params.estimation_gap + params.min_observations))
    residual = F.greatest(F.col("_syy") * (1 - F.col("r_squared")), zero) / (F.col("_n") - 2)
    return (moments.withColumn("estimation_obs", F.col("_n").cast("long"))
            .withColumn("beta", F.when(ok, F.col("_sxy") / F.col("_sxx")))
            .withColumn("alpha", (F.col("_y") - F.col("beta") * F.col("_x")) / F.col("_n"))
            .withColumn("r_squared", ratio(F.col("beta") * F.col("_sxy"), "_syy"))
            .withColumn("residual_sd", F.when(ok, F.sqrt(residual)))
            .select(*returns.columns, "pos", "estimation_obs", "alpha", "beta", "r_squared", "residual_sd"))


def anchor_effects(returns: DataFrame, params: EventParams = EventParams(),
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Cumulative abnormal return, its t and the degrees of freedom for every possible anchor row."""
    frame = by_series(keys).rowsBetween(-params.pre, params.post)
    both = F.col("r").isNotNull() & F.col("market_r").isNotNull()
    model = market_model(returns, params, keys)
    sums = (model.withColumn("_n", F.count_if(both).over(frame))
            .withColumn("_r", F.sum(F.when(both, F.col("r"))).over(frame))
            .withColumn("_m", F.sum(F.when(both, F.col("market_r"))).over(frame)))
    car = F.when(F.col("alpha").isNotNull(),
                 F.coalesce(F.col("_r") - F.col("_n") * F.col("alpha") - F.col("_m") * F.col("beta"), F.lit(0.0)))
    se = F.col("residual_sd") * F.sqrt(F.col("_n"))
    return (sums.withColumn("car", car)
            .withColumn("event_obs", F.col("_n"))
            .withColumn("car_t", F.when(se > 0, F.col("car") / se))
            .withColumn("car_df", F.greatest(F.col("estimation_obs") - 2, F.lit(1)))
            .drop("_n", "_r", "_m"))


def event_anchors(events: DataFrame, rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(series, event_date) to the first row on or after it; NULL after the last row.

    Distinct event dates and the rows of a series are both bounded by the
    calendar, so the merge is one running window in descending date order.
    """
    wanted = events.select(*keys, F.col("event_date").alias("d")).distinct().withColumn("_event", F.lit(1))
    marks = rows.select(*keys, "d").withColumn("_event", F.lit(0)).unionByName(wanted)
    # Descending: rows of the same date must come before its events.
    w = Window.partitionBy(*keys).orderBy(F.col("d").desc(), F.col("_event").asc())
    row_d = F.when(F.col("_event") == 0, F.col("d"))
    return (marks.withColumn("anchor_d", F.last(row_d, ignorenulls=True).over(
                w.rowsBetween(Window.unboundedPreceding, 0)))
            .filter("_event = 1").select(*keys, F.col("d").alias("event_date"), "anchor_d"))


def event_results(events: DataFrame, returns: DataFrame, params: EventParams = EventParams(),
                  keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per event; those without enough history or a later row have a reason."""
    effects = anchor_effects(returns, params, keys).select(
        *keys, F.col("d").alias("anchor_d"), "alpha", "beta", "r_squared", "residual_sd",
        "estimation_obs", "event_obs", "car", "car_t", "car_df")
    lookup = event_anchors(events, returns, keys).join(effects, [*keys, "anchor_d"], "left")
    lookup = lookup.withColumn("car_p", t_two_sided("car_t", "car_df")).drop("car_df")  # at anchors only
    reason = (F.when(F.col("anchor_d").isNull(), "NO_LATER_ROW")
              .when(F.col("alpha").isNull(), "INSUFFICIENT_HISTORY"))
    return events.join(lookup, [*keys, "event_date"], "left").withColumn("skipped", reason)


def event_abnormal(events: DataFrame, returns: DataFrame, params: EventParams = EventParams(),
                   keys: Sequence[str] = KEYS) -> DataFrame:
    """Abnormal return of every row of an event window, per distinct anchor."""
    model = market_model(returns, params, keys)
    anchors = (event_anchors(events, returns, keys).filter("anchor_d IS NOT NULL")
               .select(*keys, "anchor_d").distinct())
    fits = (anchors.join(model.select(*keys, F.col("d").alias("anchor_d"), "pos", "alpha", "beta"),
                         [*keys, "anchor_d"]).filter("alpha IS NOT NULL"))
    spread = fits.select(*keys, "anchor_d", "alpha", "beta",
                         F.explode(F.sequence(F.col("pos") - params.pre, F.col("pos") + params.post)).alias("pos"),
                         F.col("pos").alias("_anchor_pos"))
    rows = model.select(*keys, "pos", "d", "r", "market_r").filter("market_r IS NOT NULL")
    return (spread.join(rows, [*keys, "pos"])
            .select(*keys, "anchor_d", "d", (F.col("pos") - F.col("_anchor_pos")).alias("offset"),
                    (F.col("r") - F.col("alpha") - F.col("beta") * F.col("market_r")).alias("abnormal_r")))


def caar_by_category(results: DataFrame, category: str = "category",
                     same: Sequence[str] = ("ticker", "event_date")) -> DataFrame:
    """Mean effect per class of event with a cross-sectional t test.

    Events of one class on one date of one series have the same effect, so they
    are counted before anything is gathered: a class ships at most one row per
    series and date.  Fewer than five events give no inference.
    """
    counted = (results.filter(F.col("car").isNotNull()).groupBy(category, *same)
               .agg(F.first("car").alias("car"), F.count(F.lit(1)).alias("_k")))
    counted = written(counted, "effects")  # one row per class, series and date
    k, car = F.col("_k"), F.col("car")
    agg = counted.groupBy(category).agg(
        F.sum("_k").alias("n_events"), (F.sum(k * car) / F.sum(k)).alias("mean_car"),
        (F.sum(F.when(car > 0, k).otherwise(0)) / F.sum(k)).alias("hit_rate"),
        (F.max("car") > F.min("car")).alias("_varies"))
    centred = join_null_safe(counted, agg.select(category, "mean_car"), [category])
    spread = centred.groupBy(category).agg(F.sum(k * F.pow(car - F.col("mean_car"), 2)).alias("_ss"))
    sd = F.sqrt(F.col("_ss") / (F.col("n_events") - 1))
    t = F.when((F.col("n_events") >= 2) & F.col("_varies") & (sd > 0),
               F.col("mean_car") / (sd / F.sqrt("n_events")))
    agg = join_null_safe(agg, exact_quantiles(counted, [category], {"median_car": "car"}, weight="_k"), [category])
    return (join_null_safe(agg, spread, [category]).withColumn("t_stat", t)
            .withColumn("_df", F.col("n_events") - 1)
            .withColumn("p_value", t_two_sided("t_stat", "_df"))
            .withColumn("verdict", caar_verdict())
            .drop("_ss", "_varies", "_df"))


def caar_verdict() -> Column:
    return (F.when(F.col("n_events") < 5, "TOO_FEW_EVENTS")
            .when(F.col("p_value") < 0.05, "SYSTEMATIC_EFFECT")
            .otherwise("NO_SYSTEMATIC_EFFECT"))


def recent_events(events: DataFrame, k: int = 30, keys: Sequence[str] = KEYS,
                  order: Sequence[str] = ("event_date", "event_id")) -> DataFrame:
    """The latest ``k`` events per series.  Spark limits each map task to ``k``
    rows per series before the shuffle, so a hot series costs nothing extra."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return (events.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
