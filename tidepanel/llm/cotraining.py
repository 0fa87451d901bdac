"""Quality classifier by co-training on two views of a document.

One view is the text (its characters and words), the other the metadata (source, language, stated length). Each view has
a logistic regression; over some rounds every document without a label that one view is sure of becomes a training
example of the other view. Both are calibrated on labelled documents that they never saw, and a regression on the two
calibrated scores, fitted there too, scores all documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import bpe
from tidepanel.llm.common import chunks, map_arrow, refuse_clash, stored, sums, text_buffers
from tidepanel.llm.groups import word_hashes

#: About so many labelled documents are used, chosen by a hash of the id; a fifth of them only calibrates.
LABELLED_DOCUMENTS = 50_000
ROUNDS = 2
SURE = 0.98
KEEP = 0.5
SOURCE_BUCKETS, LANG_BUCKETS = 32, 16

_KIND = np.zeros(256, np.uint8)
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 1
_KIND[ord("!")] = 2
_KIND[ord("|")] = 3
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 4
_KIND[[*range(0x30, 0x3A)]] = 5
_KIND[[*range(0x41, 0x5B)]] = 6
_KIND[[0x0A, 0x0D]] = 7


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of every text: shares of kinds of characters and of kinds of words, and how words repeat."""
    size = np.maximum(np.diff(offsets), 1)
    kind = _KIND[data]
    upper = (kind == 6)
    upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    classes = bpe.byte_classes(data)
    letters = np.maximum(sums(classes == bpe.LETTER, offsets), 1)
    columns = [sums(kind == k, offsets) / size for k in (1, 2, 3, 4, 5, 7)]
    columns += [sums(upper, offsets) / letters, sums(classes == bpe.LETTER, offsets) / size, sums(classes == bpe.SPACE, offsets) / size]
    words, at = word_hashes(data, offsets)
    count = np.diff(at)
    most = np.maximum(count, 1)
    again = np.zeros(len(words))
    again[1:] = words[1:] == words[:-1]
    again[at[:-1][count > 0]] = 0
    distinct = np.array([len(np.unique(words[a:b])) for a, b in zip(at.tolist(), at[1:].tolist())])
    columns += [sums(again, at) / most, distinct / most, np.log1p(count), sums(classes != bpe.SPACE, offsets) / most / 10]
    last = np.flatnonzero((classes[:-1] != bpe.SPACE) & (classes[1:] == bpe.SPACE)) if len(data) else np.zeros(0, np.int64)
    odd = np.zeros(len(data))
    odd[last] = np.isin(kind[last], (2, 3, 4))
    columns.append(sums(odd, offsets) / most)
    return np.stack(columns, 1)


def metadata_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Features of the metadata; a null is a value of its own."""
    out = np.zeros((len(source), SOURCE_BUCKETS + LANG_BUCKETS + 2))
    for row, (s, l, n) in enumerate(zip(source, lang, n_chars)):
        out[row, zlib.crc32(str(s).encode()) % SOURCE_BUCKETS] = 1
        out[row, SOURCE_BUCKETS + zlib.crc32(str(l).encode()) % LANG_BUCKETS] = 1
        out[row, -2] = math.log1p(max(n or 0, 0))
        out[row, -1] = out[row, -2] ** 2 / 10
    return out


@dataclass
class Scorer:
    """Weights of both views and of their combination; without labels of both kinds every score is ``constant``."""

    text: np.ndarray = field(default_factory=lambda: np.zeros(0))
    metadata: np.ndarray = field(default_factory=lambda: np.zeros(0))
    combined: np.ndarray = field(default_factory=lambda: np.zeros(3))
    constant: float | None = None

    def score(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(text), self.constant)
        margin = self.combined[0] * _margin(text, self.text) + self.combined[1] * _margin(metadata, self.metadata) + self.combined[2]
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def _margin(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return rows @ weights[:-1] + weights[-1]


def _fit(rows: DataFrame, features: str, regularisation: float = 1e-4) -> np.ndarray:
    """Weights and intercept of a regression on ``label``."""
    model = LogisticRegression(regParam=regularisation, maxIter=50, tol=1e-6).fit(rows.select(array_to_vector(features).alias("features"), "label"))
    return np.append(model.coefficients.toArray(), model.intercept)


def _margin_column(features: str, weights: np.ndarray) -> F.Column:
    table = F.array(*(F.lit(float(w)) for w in weights[:-1]))
    return F.aggregate(F.zip_with(features, table, lambda x, w: x * w), F.lit(float(weights[-1])), lambda acc, x: acc + x)


def sure_examples(others: DataFrame, judge: str, weights: np.ndarray, scale: np.ndarray) -> DataFrame:
    """The documents without a label that the view ``judge`` is sure of, by its calibrated probability, with that label."""
    chance = 1 / (1 + F.exp(-(_margin_column(judge, weights) * float(scale[0]) + float(scale[1]))))
    sure = others.withColumn("chance", chance).filter((F.col("chance") >= SURE) | (F.col("chance") <= 1 - SURE))
    return sure.withColumn("label", (F.col("chance") > 0.5).cast("double"))


COLUMNS = ("text", "source", "lang", "n_chars")


def _views(batch: pa.RecordBatch, at: dict[str, int], i: int, j: int, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    text = text_view(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
    metadata = metadata_view(*(batch.column(at[c]).slice(i, j - i).to_pylist() for c in COLUMNS[1:]))
    return text, metadata


def features(docs: DataFrame) -> DataFrame:
    """Both views of every document: (doc_id, words, about)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {c: k + 1 for k, c in enumerate(COLUMNS)}
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in chunks(offsets):
                views = _views(batch, at, i, j, data, offsets)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel())) for v in views]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists], names=["doc_id", "words", "about"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", *COLUMNS), work, f"doc_id {kind}, words array<double>, about array<double>")


def train(docs: DataFrame, labels: DataFrame, most: int = LABELLED_DOCUMENTS, rounds: int = ROUNDS) -> Scorer:
    """Co-train on ``labels`` (doc_id, quality) and on all documents without a label.

    Null ids and null qualities are no labels; of several labels of a document the mean decides. Only weights come to the
    driver.
    """
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    total = max(known.count(), 1)
    known = known.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20)))
    known = known.filter(F.col("place") < min(1.0, most / total)).select("doc_id", "label", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).alias("held"))
    table = stored(features(docs).join(known, "doc_id", "left"), "views")
    seeds, held, others = table.filter("label is not null and not held"), table.filter("label is not null and held"), table.filter("label is null")
    found = {(r["held"], r["label"]) for r in table.filter("label is not null").groupBy("held", "label").count().collect()}
    if len(found) < 4:
        return Scorer(constant=0.0 if found and all(label == 0 for _, label in found) else 1.0)
    examples = {"words": seeds, "about": seeds}
    weights: dict[str, np.ndarray] = {}
    scale: dict[str, np.ndarray] = {}
    for step in range(rounds + 1):
        for view, rows in examples.items():
            weights[view] = _fit(rows.select(view, "label"), view)
            scale[view] = _fit(held.select(F.array(_margin_column(view, weights[view])).alias("margin"), "label"), "margin")
        if step < rounds:
            for view, other in (("words", "about"), ("about", "words")):
                sure = sure_examples(others, other, weights[other], scale[other])
                examples[view] = seeds.select(view, "label").union(sure.select(view, "label"))
    calibrated = [_margin_column(v, weights[v]) * float(scale[v][0]) + float(scale[v][1]) for v in ("words", "about")]
    both = _fit(held.select(F.array(*calibrated).alias("margins"), "label"), "margins")
    text, metadata = scale["words"], scale["about"]
    return Scorer(weights["words"], weights["about"], np.array([both[0] * text[0], both[1] * metadata[0], both[2] + both[0] * text[1] + both[1] * metadata[1]]))


def score_documents(docs: DataFrame, scorer: Scorer, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Kept columns, ``quality_score`` (0 to 1) and ``accepted`` (score of a half at least) of every document.

    Null and empty texts are scored like any other, as texts without words; nulls of the metadata are values. Each row is
    scored by itself, so repeated rows and null ids stay. No rows give no rows. Kept columns must not have an output's name
    (ValueError).
    """
    refuse_clash(keep, "quality_score", "accepted")
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)  # some hundred numbers
    columns = list(dict.fromkeys([*keep, *COLUMNS]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        at = {c: columns.index(c) for c in COLUMNS}
        for batch in batches:
            data, offsets = text_buffers(batch.column(at["text"]))
            for i, j in chunks(offsets):
                score = model.score(*_views(batch, at, i, j, data, offsets))
                yield pa.RecordBatch.from_arrays([*(batch.column(columns.index(c)).slice(i, j - i) for c in keep), pa.array(score), pa.array(score >= KEEP)],
                                                 names=[*keep, "quality_score", "accepted"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(*columns), work, f"{kinds}, quality_score double, accepted boolean")
