"""Language identification as the mixture of languages of a document.

A word's likelihood under a language comes from a chain of byte n-grams (each byte given the three before it). Per
document, expectation-maximisation estimates the share of every language of a set; the set starts with the best single
language and grows by one language while that raises the likelihood by more than a penalty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import bpe
from tidepanel.llm.common import chunks, expand, map_arrow, refuse_clash, sums, text_buffers

GRAM_BITS = 16
#: The model is fitted on about this many labelled documents of each language, chosen by a hash of the id.
TRAINING_DOCUMENTS = 5_000
SMOOTHING = 2.0
#: A further language must raise the log-likelihood by so much for each unit of log(words).
PENALTY = 3.0
ROUNDS = 25
UNKNOWN = "und"


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Runs of letters: their text, their code, and the distinct runs by code."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.large_binary())
    letter = bpe.byte_classes(data) == bpe.LETTER
    mark = np.zeros(n + 1, bool)
    mark[offsets] = True
    mark = mark[:n]
    mark[1:] |= letter[1:] != letter[:-1]
    mark[0] = True
    starts = np.flatnonzero(mark)
    codes, words = bpe.distinct_words(data, starts)
    runs = letter[starts]
    text = np.searchsorted(offsets, starts[runs], "right") - 1
    return text, codes[runs], words


def gram_places(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash buckets of every word's 4-grams and of their 3-byte contexts, and the words' offsets. Words are framed by
    blanks."""
    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    size = np.diff(offsets)
    grams = size + 1
    ends = np.concatenate(([0], np.cumsum(grams)))
    framed = np.full(int((size + 4).sum()), 0x20, np.uint64)  # three blanks before and one behind
    first = np.concatenate(([0], np.cumsum(size + 4)))[:-1]
    if len(framed) and words.buffers()[2] is not None:
        framed[expand(first + 3, size)] = np.frombuffer(words.buffers()[2], np.uint8)[expand(offsets[:-1], size)]
    at = expand(first, grams)
    context = framed[at] << np.uint64(16) | framed[at + 1] << np.uint64(8) | framed[at + 2] if len(at) else np.zeros(0, np.uint64)
    whole = context << np.uint64(8) | framed[at + 3] if len(at) else context
    place = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
    return place(whole), place(context), ends


class Model:
    """Counts of grams and contexts by language."""

    def __init__(self, languages: list[str], grams: np.ndarray, contexts: np.ndarray) -> None:
        self.languages = languages
        self.grams, self.contexts = grams.astype(np.float64), contexts.astype(np.float64)

    def word_scores(self, words: pa.Array) -> np.ndarray:
        """Log-likelihood of each word under each language."""
        gram, context, ends = gram_places(words)
        value = np.log((self.grams[gram] + SMOOTHING * 1e-2) / (self.contexts[context] + SMOOTHING))
        return np.stack([sums(value[:, k], ends) for k in range(len(self.languages))], 1)


def fit(docs: DataFrame, most: int = TRAINING_DOCUMENTS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Model of all languages in ``lang``. Only counts of hashed grams come to the driver: languages times 2 ** 17."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((1 << GRAM_BITS, 0)), np.zeros((1 << GRAM_BITS, 0)))
    share = F.create_map(*(F.lit(x) for l in languages for x in (l, min(1.0, most / sizes[l]))))
    chosen = known.filter((F.pmod(F.xxhash64(doc_id), F.lit(1 << 20)) / F.lit(float(1 << 20))) < share[F.col(lang)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((len(languages), 2 << GRAM_BITS), np.int64)
        for batch in batches:
            whose = np.array([languages.index(x) for x in batch.column(1).to_pylist()], np.int64)
            data, offsets = text_buffers(pc.utf8_lower(batch.column(0)))
            for i, j in chunks(offsets):
                owner, codes, words = letter_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                gram, context, ends = gram_places(words)
                kinds = np.bincount(codes * len(languages) + whose[i:j][owner], minlength=len(words) * len(languages)).reshape(-1, len(languages))
                for k in range(len(languages)):
                    each = np.repeat(kinds[:, k], np.diff(ends))
                    table[k] += np.bincount(np.concatenate((gram, context + (1 << GRAM_BITS))), weights=np.concatenate((each, each)), minlength=2 << GRAM_BITS).astype(np.int64)
        k, place = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(table[k, place])], names=["k", "place", "n"])

    counted = map_arrow(chosen.select(text, lang), count, "k int, place int, n long").groupBy("k", "place").agg(F.sum("n").alias("n"))
    # put together on the executors: a list of counts for each language and stretch of places
    lists = counted.groupBy("k", F.shiftright("place", 12)).agg(F.collect_list(F.struct("place", "n")).alias("counts")).select("k", "counts").toArrow()
    table = np.zeros((2 << GRAM_BITS, len(languages)))
    for batch in lists.to_batches():
        counts = batch.column(1).flatten()
        k = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
        table[counts.field("place").to_numpy(), k] = counts.field("n").to_numpy()
    return Model(languages, table[:1 << GRAM_BITS], table[1 << GRAM_BITS:])


def mixtures(scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Language shares of each text. ``scores`` has the log-likelihoods of all words, a text's words together;
    ``bounds`` are the texts' offsets. A text without words has no shares."""
    texts, kinds = len(bounds) - 1, scores.shape[1]
    count = np.diff(bounds)
    top = scores.max(1, keepdims=True, initial=-np.inf)
    like = np.exp(scores - top)
    single = np.stack([sums(scores[:, k] - top[:, 0], bounds) for k in range(kinds)], 1)
    share = np.zeros((texts, kinds))
    filled = np.flatnonzero(count > 0)
    share[filled, single[filled].argmax(1)] = 1.0
    value = single.max(1, initial=-np.inf)
    open_ = filled
    for _ in range(kinds - 1):
        if not open_.size:
            break
        size = count[open_]
        words = like[expand(bounds[:-1][open_], size)]
        ends = np.concatenate(([0], np.cumsum(size)))
        owner = np.repeat(np.arange(len(open_)), size)
        mix = share[open_]
        # likelihood is concave in the shares, so its slope towards a language bounds what that language can add
        ratio = words / np.maximum((words * mix[owner]).sum(1), 1e-300)[:, None]
        slope = np.stack([sums(ratio[:, k], ends) for k in range(kinds)], 1) - size[:, None]
        slope[mix > 0] = -np.inf
        best, bar = slope.argmax(1), PENALTY * np.log(size + 1)
        go = slope.max(1) > bar
        open_, best, bar = open_[go], best[go], bar[go]
        if not open_.size:
            break
        stay = go[owner]
        words, size = words[stay], size[go]
        ends = np.concatenate(([0], np.cumsum(size)))
        owner = np.repeat(np.arange(len(open_)), size)
        mix = mix[go] * 0.8
        mix[np.arange(len(open_)), best] = 0.2
        for _ in range(ROUNDS):
            part = words * mix[owner]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
            mix = np.stack([sums(part[:, k], ends) for k in range(kinds)], 1) / size[:, None]
        reached = sums(np.log(np.maximum((words * mix[owner]).sum(1), 1e-300)), ends)
        better = reached - value[open_] > bar
        open_ = open_[better]
        share[open_], value[open_] = mix[better], reached[better]
    return share


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Language of every whole text: (doc_id, [kept columns], lang_pred, score, languages, shares).

    ``lang_pred`` is the language with the largest share (the first by name of equal ones), ``score`` that share.
    Null or empty texts, texts without a letter, and all texts under a model without languages are ``und`` with score 0.
    Kept columns must not have an output's name (ValueError).
    Each row is judged by its text alone; repeated rows and null ids stay; no rows give no rows.
    """
    refuse_clash(keep, "lang_pred", "score", "languages", "shares")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages times 2 ** 17 numbers
    columns = [doc_id, *(c for c in keep if c != doc_id)]
    if text not in columns:
        columns.append(text)
    out = [c for c in columns if c != text or text in keep]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shipped.value
        names = fitted.languages
        for batch in batches:
            data, offsets = text_buffers(pc.utf8_lower(batch.column(columns.index(text))))
            for i, j in chunks(offsets):
                owner, codes, words = letter_words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                bounds = np.searchsorted(owner, np.arange(j - i + 1))
                if names and len(owner):
                    share = mixtures(fitted.word_scores(words)[codes], bounds)
                else:
                    share = np.zeros((j - i, max(len(names), 1)))
                best = share.argmax(1)
                score = share[np.arange(j - i), best]
                guess = [names[b] if s > 0 else UNKNOWN for b, s in zip(best.tolist(), score.tolist())]
                order = np.argsort(-share, axis=1, kind="stable")
                langs = [[names[k] for k in row if s[k] > 0] for row, s in zip(order.tolist(), share)]
                parts = [[float(s[k]) for k in row if s[k] > 0] for row, s in zip(order.tolist(), share)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(columns.index(c)).slice(i, j - i) for c in out), pa.array(guess, pa.string()), pa.array(np.minimum(score, 1.0)),
                     pa.array(langs, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))],
                    names=[*out, "lang_pred", "score", "languages", "shares"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in out)
    return map_arrow(docs.select(*columns), work, f"{kinds}, lang_pred string, score double, languages array<string>, shares array<double>")
