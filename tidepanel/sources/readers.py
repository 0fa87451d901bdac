"""Landed files to typed tables.

Each ``read_*`` opens files with a fixed schema; each ``parse_*`` or
``normalise_*`` works on any DataFrame of that shape, so the rules can be applied
to a table, a file or a query alike.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidepanel.functions.dates import parse_day
from tidepanel.functions.numeric import nan_to_null
from tidepanel.functions.text import classify_filing, clean_symbol, root_symbol
from tidepanel.operators.lineage import MissingDataError
from tidepanel.sources import schemas

OHLCV = ("open", "high", "low", "close", "volume")
CORRUPT = "_corrupt"


# --- gates ---------------------------------------------------------------------

def require_columns(df: DataFrame, needed: Sequence[str]) -> None:
    """Fail while the plan is built if a column is missing (case-insensitive)."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in needed if c.lower() not in have]
    if missing:
        raise MissingDataError(f"missing columns {missing}; received {df.columns}")


def missing_keys(requested: DataFrame, loaded: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Requested series without a single row."""
    return requested.join(loaded.select(*keys).distinct(), list(keys), "left_anti")


def require_empty(violations: DataFrame, message: str) -> None:
    """Raise with up to ten offending rows."""
    bad = violations.take(10)
    if bad:
        raise MissingDataError(f"{message}: {[tuple(r) for r in bad]}")


def drop_null_prices(df: DataFrame, price: str = "close") -> DataFrame:
    """Undefined closes go before any lag or window sees them."""
    return df.withColumn(price, nan_to_null(price)).filter(F.col(price).isNotNull())


def history_gate(df: DataFrame, min_rows: int = 260, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Row count of each series and whether it is long enough to analyse."""
    return (df.filter("close IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("accepted", F.col("n_rows") >= min_rows))


def accepted_only(df: DataFrame, gate: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    return df.join(gate.filter("accepted"), list(keys), "left_semi")


def warmup_start(end: Column, years: float = 2.0) -> Column:
    """Start of the load range: the reported years plus a year and a half."""
    return F.date_sub(end, int(365.25 * (years + 1.5)))


def in_window(df: DataFrame, end: str, years: float = 2.0, date: str = "d") -> DataFrame:
    """Date range filter with constant bounds, so it reaches the file scan."""
    stop = F.lit(end).cast("date")
    return df.filter((F.col(date) >= warmup_start(stop, years)) & (F.col(date) < stop))


# --- prices ----------------------------------------------------------------------

def normalise_bars(raw: DataFrame) -> DataFrame:
    """Lower-case names, five price columns, dates without time, NaN to NULL."""
    lower = raw.toDF(*[c.lower() for c in raw.columns])
    if "date" in lower.columns:
        lower = lower.withColumnRenamed("date", "d")
    require_columns(lower, ("ticker", "d", *OHLCV))
    return lower.select("ticker", F.to_date("d").alias("d"), *[nan_to_null(c).alias(c) for c in OHLCV])


def split_dividends(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(prices not adjusted for dividends, positive payments) from one scan."""
    lower = raw.toDF(*[c.lower() for c in raw.columns])
    prices = normalise_bars(raw)
    date = F.to_date("date" if "date" in lower.columns else "d")
    if "dividends" not in lower.columns:
        paid = lower.select("ticker", date.alias("d"), F.lit(0.0).alias("per_share"))
    else:
        paid = lower.select("ticker", date.alias("d"), nan_to_null("dividends").alias("per_share"))
    return prices, paid.filter("per_share > 0")


def read_bucketed(spark: SparkSession, table: str) -> DataFrame:
    """A table of :func:`tidepanel.sources.sinks.write_bucketed`: windows and joins by its keys need no exchange."""
    return spark.table(table)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.BARS).parquet(path)


def read_raw_bars(spark: SparkSession, path: str) -> DataFrame:
    return normalise_bars(spark.read.schema(schemas.RAW_BARS).csv(path, header=True, mode="FAILFAST"))


def parse_secondary(lines: DataFrame, keys: Sequence[str] = ("ticker",)) -> DataFrame:
    """Closes from vendor CSV lines (``line`` column); a body without the header
    ("No data") yields no rows because its lines are not records."""
    rec = F.from_csv("line", schemas.SECONDARY)
    return (lines.filter(F.col("line").rlike("^\\d{4}-\\d{2}-\\d{2},")).withColumn("_r", rec)
            .select(*keys, F.col("_r.Date").alias("d"), F.col("_r.Close").alias("close"))
            .filter("close IS NOT NULL"))


def read_secondary_close(spark: SparkSession, path: str, ticker: str) -> DataFrame:
    """One vendor file; its text is split into lines by the scan."""
    return parse_secondary(spark.read.text(path).select(F.lit(ticker).alias("ticker"), F.col("value").alias("line")))


# --- monthly index -----------------------------------------------------------------

def parse_monthly_index(payloads: DataFrame, body: str = "body", keys: Sequence[str] = ()) -> DataFrame:
    """``{"data": [["YYYY-MM-DD", number], ...]}`` to (month, level)."""
    rows = payloads.select(*keys, F.explode(F.from_json(body, schemas.MONTHLY_INDEX)["data"]).alias("_r"))
    return rows.select(*keys, F.to_date(F.col("_r")[0]).alias("month"),
                       F.col("_r")[1].try_cast("double").alias("level"))


def read_monthly_index(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Levels by month; a month without a value aborts the load in strict mode."""
    out = parse_monthly_index(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"))
    if strict:
        if out.isEmpty():
            raise MissingDataError("the index payload holds no months")
        require_empty(out.filter("level IS NULL"), "months without a value")
    return out


# --- filings and issuers ---------------------------------------------------------

def once(value: Column) -> Column:
    """A costly value, computed once per row: the optimiser does not copy it into
    the filters and projections above, as it does with a plain column."""
    return F.explode(F.array(value))


def _filings_of(body: str) -> Column:
    """The payload, with its text in the corrupt field if it does not parse."""
    return F.from_json(body, f"{schemas.FILINGS}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})


def payload_rejects(payloads: DataFrame, stage: str, keys: Sequence[str] = ("ticker",), body: str = "body") -> DataFrame:
    """Payloads that give no rows, and why: (stage, series, reason, rows), one row per series and reason.

    ``stage`` is ``filings``, ``index`` or ``issuers``.  A payload is EMPTY_BODY
    (NULL or blank), MALFORMED (no JSON of the expected shape) or NO_RECORDS (the
    list of records is missing).  All others are parsed, each by itself.
    """
    empty = ~F.coalesce(F.col(body).rlike("\\S"), F.lit(False))
    if stage == "filings":
        parsed = once(_filings_of(body))
        broken, none = F.col("_p").isNull() | F.col(f"_p.{CORRUPT}").isNotNull(), F.col("_p.filings.recent").isNull()
    elif stage == "index":
        parsed = once(F.from_json(body, f"{schemas.MONTHLY_INDEX}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}))
        broken, none = F.col("_p").isNull() | F.col(f"_p.{CORRUPT}").isNotNull(), F.col("_p.data").isNull()
    elif stage == "issuers":
        parsed = once(F.from_json(body, schemas.ISSUERS))  # a map has no field for corrupt text: it is NULL as a whole
        broken, none = F.col("_p").isNull(), F.size("_p") == 0
    else:
        raise ValueError(f"unknown stage {stage!r}")
    reason = F.when(empty, "EMPTY_BODY").when(broken, "MALFORMED").when(none, "NO_RECORDS")
    series = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    bad = payloads.withColumn("_p", parsed).select(series.alias("series"), reason.alias("reason")).filter("reason IS NOT NULL")
    return bad.groupBy(F.lit(stage).alias("stage"), "series", "reason").agg(F.count(F.lit(1)).alias("rows"))


def parse_filings(payloads: DataFrame, since: str, forms: Sequence[str] = ("8-K", "6-K"),
                  body: str = "body") -> DataFrame:
    """Parallel arrays to one row per filing of the wanted forms.

    ``payloads``: ticker, cik and the JSON body.  Arrays are zipped to the
    shortest of the required ones; missing items are empty.  Payloads without
    records are listed by :func:`payload_rejects`.
    """
    recent = once(_filings_of(body)["filings"]["recent"])
    named = ("form", "filingDate", "accessionNumber", "primaryDocument")
    opened = payloads.withColumn("_f", recent)
    shortest = F.least(*[F.size(F.coalesce(F.col(f"_f.{c}"), F.array().cast("array<string>"))) for c in named])
    items = F.coalesce(F.col("_f.items"), F.transform(F.col("_f.form"), lambda _: F.lit("")))
    shortest = F.least(shortest, F.size(items))
    zipped = F.slice(F.arrays_zip(*[F.col(f"_f.{c}").alias(c) for c in named], items.alias("items")), 1, shortest)
    rows = opened.select("ticker", "cik", F.inline(zipped))
    rows = rows.filter(F.col("form").isin(*forms)).withColumn("event_date", parse_day("filingDate"))
    rows = rows.filter(F.col("event_date") >= F.lit(since).cast("date"))
    text = F.coalesce("items", F.lit(""))
    return rows.select(
        "event_date", "ticker", classify_filing(F.col("form"), text).alias("category"),
        F.trim(F.concat_ws(" ", "form", text)).alias("label"), F.lit("SEC EDGAR").alias("source"),
        F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), F.col("cik").cast("string"), F.lit("/"),
                 F.replace("accessionNumber", F.lit("-"), F.lit("")), F.lit("/"), F.col("primaryDocument")).alias("url"),
        F.col("form").alias("raw_form"))


def read_filings(spark: SparkSession, path: str, ticker: str, cik: int, since: str,
                 forms: Sequence[str] = ("8-K", "6-K"), strict: bool = True) -> DataFrame:
    """Filings of one issuer; in strict mode a payload without records aborts the load."""
    body = spark.read.text(path, wholetext=True).select(
        F.lit(ticker).alias("ticker"), F.lit(cik).alias("cik"), F.col("value").alias("body"))
    if strict:
        require_empty(payload_rejects(body, "filings"), "payloads without filings")
    return parse_filings(body, since, forms)


def parse_issuers(payloads: DataFrame, body: str = "body") -> DataFrame:
    """``{"0": {"ticker": .., "cik_str": ..}, ...}`` to (symbol, cik)."""
    entries = payloads.select(F.explode(F.map_values(F.from_json(body, schemas.ISSUERS))).alias("_e"))
    return entries.select(F.upper("_e.ticker").alias("symbol"), F.col("_e.cik_str").cast("bigint").alias("cik"))


def resolve_issuers(tickers: DataFrame, issuers: DataFrame) -> DataFrame:
    """Issuer id of each ticker; unresolved ones keep NULL for the gate."""
    one = issuers.groupBy("symbol").agg(F.min("cik").alias("cik"))
    return (tickers.withColumn("symbol", root_symbol(F.col("ticker")))
            .join(one, "symbol", "left").select("ticker", "symbol", "cik"))


def read_issuers(spark: SparkSession, path: str) -> DataFrame:
    return parse_issuers(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"))


# --- curated events, holdings -----------------------------------------------------

MANUAL_REQUIRED = ("date", "ticker", "category", "label", "url")


def manual_event_rejects(raw: DataFrame) -> DataFrame:
    """Records with an empty required field, and which ones."""
    gaps = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in MANUAL_REQUIRED]))
    return raw.withColumn("missing", F.array_join(gaps, ",")).filter("missing <> ''")


def manual_events(raw: DataFrame) -> DataFrame:
    """Records in which every required field is filled, typed."""
    complete = raw
    for c in MANUAL_REQUIRED:
        complete = complete.filter(F.coalesce(F.col(c), F.lit("")) != "")
    return complete.select(F.to_date("date").alias("event_date"), "ticker", "category", "label",
                           F.coalesce("source", F.lit("curated")).alias("source"), "url")


def read_manual_events(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    raw = spark.read.schema(schemas.MANUAL_EVENTS).json(path, multiLine=True)
    if strict:
        require_empty(manual_event_rejects(raw), "events without a verifiable source or field")
    return manual_events(raw)


def normalise_holdings(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Alphabetic symbols from whichever known header the file uses."""
    found = [a for a in schemas.HOLDING_ALIASES if a in raw.columns]
    if not found:
        raise MissingDataError(f"no symbol column among {raw.columns}")
    symbol = clean_symbol(F.col(f"`{found[0]}`"))
    position = F.col(order) if order else F.monotonically_increasing_id()
    return raw.select(symbol.alias("symbol"), position.alias("position")).filter("symbol IS NOT NULL")


def read_holdings(spark: SparkSession, path: str, min_symbols: int = 50) -> DataFrame:
    out = normalise_holdings(spark.read.csv(path, header=True))
    n = out.limit(min_symbols).count()
    if n < min_symbols:
        raise MissingDataError(f"only {n} symbols in the holdings file")
    return out
