"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained on a small labelled table of URLs with the JVM's logistic regression; scoring is one projection of
built-in functions, without a shuffle.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
GRAMS = (3, 4, 5)

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# The default training table: labelled URLs, 1 is blocked.
LABELLED = (
    ("https://www.cheap-pills.example.com/en/12", 1), ("http://cheap-pills.example.org/order?id=3", 1), ("https://best-pills-online.example.com/", 1),
    ("http://www.online-pharmacy-pills.example.net/buy/viagra", 1), ("https://viagra-cheap.example.com/de/4", 1), ("http://m.free-bets.example.com/de/963?page=2", 1),
    ("https://free-bets.example.org/en/7.html", 1), ("http://sport-bets-bonus.example.net/play", 1), ("https://casino-bonus.example.com/en/31", 1),
    ("https://www.casino-win.example.org/de/8", 1), ("http://casino-win-big.example.com/fr/77#top", 1), ("https://live-casino.example.net/es/6/", 1), ("http://m.grand-casino.example.com/en/19", 1),
    ("http://www.online-casino.example.org/slots", 1), ("https://poker-free-spins.example.com/", 1), ("https://spam-farm.example.org/en/756#top", 1),
    ("http://www.spam-farm.example.com/fr/2/", 1), ("https://link-farm-spam.example.net/a/b/c", 1), ("https://ads-track.example.org/en/584", 1),
    ("http://www.ads-track.example.com/pixel?x=1", 1), ("https://track-click-ads.example.net/banner", 1), ("http://adserver.popup-ads.example.com/click", 1),
    ("https://xxx-adult-cams.example.com/live", 1), ("http://www.porn-tube-free.example.net/en/1", 1), ("https://adult-dating-sex.example.org/join", 1),
    ("http://payday-loan-fast.example.com/apply", 1), ("https://www.cheap-loans-now.example.org/en/22", 1), ("http://win-prize-free.example.com/claim", 1),
    ("https://warez-crack-keygen.example.net/download", 1), ("http://torrent-free-movies.example.org/download", 1), ("https://get-rich-quick-crypto.example.com/", 1),
    ("http://replica-watches-cheap.example.com/fr/9", 1), ("https://m.spam-farm.example.net/es/5", 1), ("http://blog.cheap-pills.example.net/de/44/", 1),
    ("https://www.therti.example.org/en/196/", 0), ("https://m.ththth.example.net/en/673/", 0), ("http://therha.example.com/en/676", 0),
    ("http://www.therer.example.com/fr/144.html", 0), ("https://blog.tionsh.example.net/en/633", 0), ("https://thther.example.org/en/233?page=2&ref=x", 0),
    ("https://blog.ththan.example.net/de/503#top", 0), ("https://therin.example.net/en/854/", 0), ("http://www.therwh.example.org/es/245#top", 0),
    ("https://www.ththhe.example.com/en/773?utm_source=feed", 0), ("http://blog.theres.example.com/en/495", 0), ("http://www.tionble.example.com/en/997.html", 0),
    ("https://news.example.org/world/2024/05/report.html", 0), ("https://docs.example.com/guide/install", 0), ("http://library.example.edu/catalogue/books", 0),
    ("https://www.university.example.edu/research/papers", 0), ("https://en.encyclopedia.example.org/wiki/History", 0), ("http://recipes.example.com/bread", 0),
    ("https://blog.gardening.example.net/spring-flowers", 0), ("https://www.museum.example.org/exhibitions", 0), ("https://weather.example.com/forecast/today", 0),
    ("http://www.localpaper.example.org/de/sport/fussball", 0), ("https://developer.example.com/reference/strings", 0), ("https://forum.example.net/t/1234", 0),
    ("http://health.example.gov/advice/nutrition", 0), ("https://www.parliament.example.gov/sessions", 0), ("https://stories.example.com/es/cuentos/12", 0),
    ("http://m.theatre.example.org/fr/programme", 0), ("https://maps.example.com/city/streets", 0), ("https://www.anderen.example.com/de/71", 0),
    ("https://blog.ingthe.example.org/en/402", 0), ("http://erand.example.net/fr/18/", 0),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case. Path: then up to ``?``,
    ``#`` or the end. Both are empty for null or without ``://``."""
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    rest = F.coalesce(after, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (length, rule, verdict) of the longest rule whose host is the URL's or a parent of it and whose path starts
    the URL's; null if none fits. Rules of equal length: the later one in string order."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in rules]
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def _field_buckets(name: str, field: Column) -> Column:
    """Buckets of one field's n-grams, in time linear in its length: it is cut into code points once, which are bound as an
    element of an array, and every gram is put together from its places."""

    def grams(chars: Column, n: int) -> Column:
        at = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - F.lit(n))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(name), F.concat(*(F.get(chars, i + F.lit(k)) for k in range(n)))), F.lit(BUCKETS)).cast("int"))

    def slid(chars: Column) -> Column:
        return F.flatten(F.array(*(grams(chars, n) for n in GRAMS)))

    return F.get(F.transform(F.array(F.regexp_extract_all(field, F.lit("(?s)(.)"), F.lit(1))), slid), F.lit(0))


def gram_buckets(host: Column, path: Column) -> Column:
    """Bucket of every character n-gram of host and path; the two are hashed apart."""
    fields = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.concat(F.lit("^"), path, F.lit("$"))))
    parts = [_field_buckets(name, field) for name, field in fields]
    return F.when(F.length(host) + F.length(path) == 0, F.array().cast("array<int>")).otherwise(F.concat(*parts))


def labelled_urls(spark: SparkSession, rows=LABELLED) -> DataFrame:
    """The labelled table (url, blocked) as a relation of constants."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*(F.struct(F.lit(u).alias("url"), F.lit(float(b)).alias("blocked")) for u, b in rows))))


def train(labelled: DataFrame, regularisation: float = 0.01) -> tuple[list[float], float]:
    """Weights by bucket and intercept. Only the model, ``BUCKETS`` numbers, comes to the driver. URLs that are null or
    without a label are no examples."""
    grams = gram_buckets(*host_and_path(F.col("url"))).cast("array<string>")
    rows = labelled.filter("url is not null and blocked is not null").select(grams.alias("grams"), F.col("blocked").alias("label")).filter("size(grams) > 0")
    buckets = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=BUCKETS).fit(rows)
    model = LogisticRegression(regParam=regularisation, maxIter=100, tol=1e-6, standardization=False).fit(buckets.transform(rows))
    weights = [0.0] * BUCKETS
    for bucket, weight in zip(buckets.vocabulary, model.coefficients.toArray().tolist()):
        weights[int(bucket)] = weight
    return weights, float(model.intercept)


def judge_urls(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """Verdict of every URL: (page_id, host, path, rule, verdict, score).

    ``rule`` is the longest fitting rule, else null, and decides; without one the model does: block if its probability
    ``score`` exceeds a half. A null URL or one without ``://`` has an empty host and path, score 0 and is allowed. Each
    row is judged by itself, so repeated rows and null ids stay; other columns are not read; no rows give no rows.
    """
    weights, intercept = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    host, path = host_and_path(F.col(url))
    cut = pages.select(page_id, host.alias("host"), path.alias("path"))
    grams = gram_buckets(F.col("host"), F.col("path"))
    margin = F.aggregate(grams, F.lit(intercept), lambda acc, b: acc + F.get(table, b))
    score = F.when(F.length("host") + F.length("path") == 0, 0.0).otherwise(1 / (1 + F.exp(-margin)))
    judged = cut.select(page_id, "host", "path", longest_rule(F.col("host"), F.col("path"), rules).alias("hit"), score.alias("score"))
    method = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return judged.select(page_id, "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"), "score")
