"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import collisions, cotraining, density, groups, language, lexicon, mixture, packing, periodic, rarity, resampling, token_trees, urls
from tidepanel.llm.common import crc_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(function: Callable) -> Callable:
    QUERIES[function.__name__] = function
    return function


@_query
def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document with the transducer lexicon."""
    return lexicon.encode_documents(_table(spark, sf_dir, "documents"))


@_query
def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned outside the held-out fold. Without an id a document is in neither."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False)))
    model = language.fit(docs.filter("not held_out and doc_id is not null"))
    return language.identify(docs, model, keep=("held_out",))


@_query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    return urls.judge_urls(_table(spark, sf_dir, "pages"))


def document_edits() -> F.Column:
    """Three edits of a document: words put in the place of 12 code points at a third, 40 code points taken out at two
    thirds, and its beginning written once more behind the end."""
    n = F.length(F.coalesce("text", F.lit("")))
    label = F.concat_ws(" ", "source", "lang")
    edit = lambda start, removed, inserted: F.struct(start.cast("long").alias("start"), F.lit(removed).cast("long").alias("removed"), inserted.alias("inserted"))
    return F.array(edit(F.floor(n / 3), 12, label), edit(F.floor(2 * n / 3), 40, F.lit("")),
                   edit(2 * n + 64, 0, F.concat(F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, 30))))


@_query
def op4_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits."""
    return token_trees.count_edited(_table(spark, sf_dir, "documents").withColumn("edits", document_edits()))


@_query
def op5_rarity_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return rarity.fingerprint_documents(_table(spark, sf_dir, "documents"))


@_query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return density.extract_pages(_table(spark, sf_dir, "pages"))


@_query
def op7_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    return cotraining.score_documents(docs, cotraining.train(docs, _table(spark, sf_dir, "labels")))


@_query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@_query
def op9_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links of all vectors."""
    return collisions.link_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar shingle sets."""
    return groups.link_documents(_table(spark, sf_dir, "documents"))


def repeated_words(doc_id: F.Column, text: F.Column) -> F.Column:
    """The text, of whose words those from a place on repeat with a period, both given by the id's checksum, if that ends
    with 0."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: F.Column) -> F.Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        period = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % period))), " ")

    # as an element of an array the words are found once, not once for each place
    words = F.array(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    changed = F.get(F.transform(words, lambda w: F.when(F.size(w) > 0, repeated(w))), F.lit(0))
    return F.when(h % 10 == 0, changed).otherwise(text)


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words in every document, the longest one, and digests of all of them and of the text without repetitions."""
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", repeated_words(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic.repeat_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of every document towards the benchmark's texts, and the tenth of the longer ones that is drawn."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


@_query
def op13_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources by weights 1, 2, 3 takes of every document."""
    return mixture.plan_mixture(_table(spark, sf_dir, "documents")).drop("copies")


#: Links and their closure in DuckDB, over the whole tables.
_CLOSURE = """reach AS (SELECT node, node AS root FROM nodes UNION SELECT link.b, reach.root FROM reach JOIN link ON link.a = reach.node),
component AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)"""

SQL["op9_vector_links"] = f"""WITH RECURSIVE nodes AS (SELECT vec_id AS node FROM embeddings),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
{_CLOSURE}
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN component ON node = vec_id"""

SQL["op10_jaccard_join"] = rf"""WITH RECURSIVE nodes AS (SELECT doc_id AS node FROM documents),
words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM words),
runs AS (SELECT doc_id, n, pos, concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS token FROM places WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
sets AS (SELECT DISTINCT doc_id, token FROM runs WHERE pos <= greatest(n - 4, 1)),
tokens AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sets),
link AS (SELECT x.doc_id AS a, y.doc_id AS b FROM tokens x JOIN tokens y ON x.token = y.token AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
{_CLOSURE}
SELECT doc_id, (SELECT count(*) FROM sets WHERE sets.doc_id = documents.doc_id) AS n_shingles, component_id FROM documents JOIN component ON node = doc_id"""

#: CRC-32 of the words in DuckDB: a table of 256 steps, then byte by byte.
_CRC = """steps AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_concat([b::BIGINT], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) AS r(b))),
crc AS (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(length(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT word FROM source UNION SELECT word FROM target), steps)"""

_LOWER_WORDS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word"

SQL["op12_importance_resampling"] = rf"""WITH source AS (SELECT doc_id, {_LOWER_WORDS} FROM documents), target AS (SELECT {_LOWER_WORDS} FROM benchmark),
{_CRC},
s AS (SELECT bucket, count(*) AS n FROM source JOIN crc USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM target JOIN crc USING (word) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM source) + 10000) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM target) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
sized AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM source JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN sized USING (doc_id)),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""

SQL["op13_source_mixture"] = r"""WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
  ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 8))::BIGINT / 4294967296 AS coin FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sized GROUP BY source),
before AS (SELECT *, coalesce(sum(3 * source_size) OVER o, 0) AS limits, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open, sum(source_size) OVER () AS total
  FROM sources WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((total - limits)::DOUBLE / open) AS level FROM before),
targets AS (SELECT source, source_size, least(level * weight, 3 * source_size) AS target FROM sources, level), rated AS (SELECT *, target / nullif(source_size, 0) AS rate FROM targets)
SELECT doc_id, size, source_size, target, (coalesce(floor(rate) + CASE WHEN coin < rate - floor(rate) THEN 1 ELSE 0 END, 0) * size)::BIGINT AS taken
FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source"""
