"""Periodic runs, importance resampling and source mixing against plain definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tables import DOCUMENTS, EMPTY, documents
from tidepanel.llm import mixture, periodic, queries, resampling

WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_definition(words, min_length=6, min_periods=4):
    found = {}
    for q in range(1, len(words) // min_periods + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            if i > start and i - start + q >= max(min_length, min_periods * q):
                found.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def repetitive(rnd, most=60):
    words = []
    while len(words) < rnd.randint(0, most):
        words += [rnd.choice("ab c") for _ in range(rnd.randint(1, 6))] * rnd.randint(1, 9)
        if rnd.random() < 0.5:
            del words[len(words) - rnd.randint(0, 3):]
    return words


@pytest.mark.parametrize("min_length, min_periods", [(6, 4), (3, 2), (9, 3)])
def test_runs_follow_the_definition(min_length, min_periods):
    rnd = random.Random(min_length)
    for _ in range(500):
        texts = [repetitive(rnd) for _ in range(rnd.randint(1, 4))]
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        found = periodic.find_runs(np.array([ord(w) for t in texts for w in t], np.int64), at, min_length, min_periods)
        assert found.tolist() == [[s + at[k], n, q] for k, t in enumerate(texts) for s, n, q in runs_by_definition(t, min_length, min_periods)]


def test_long_texts_of_one_word_or_phrase_stay_cheap():
    for words, expected in (([7] * 400_000, [[0, 400_000, 1]]), (([*range(50)] * 8 + [99]) * 400, [[k * 401, 400, 50] for k in range(400)] + [[0, 160_400, 401]])):
        found = periodic.find_runs(np.array(words), np.array([0, len(words)]))
        assert found.tolist() == sorted(expected, key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    if doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def test_periodic_query_against_plain_python(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    with_runs = 0
    for d in docs:
        words = planted(d["doc_id"], WHITE.findall(d["text"] or ""))
        runs = runs_by_definition(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        r = rows[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2]))).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        with_runs += bool(runs)
    assert with_runs > 10


def test_runs_of_odd_rows(spark):
    rows = periodic.repeat_runs(documents(spark), keep=("length", "key")).collect()
    expected = []
    for d in DOCUMENTS:
        words = WHITE.findall(d[1] or "")
        # the long text: a word, and one word (a no-break space parts none) 30,000 times
        runs = [(1, 30_000, 1)] if d[0] == 9 else runs_by_definition(words)
        expected.append((str(d[0]), d[5], len(words), runs, collapsed(words, runs)))
    got = [(str(r["doc_id"]), r["length"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert periodic.repeat_runs(documents(spark, EMPTY)).count() == 0
    with pytest.raises(ValueError, match="runs"):
        periodic.repeat_runs(documents(spark).withColumnRenamed("key", "runs"), keep=("runs",))


def grams(text, order):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[k:k + n]) for n in range(1, order + 1) for k in range(len(words) - n + 1)]


def resampled(docs, target, order, buckets, seed, min_words, percent):
    """By definition: every feature of every text by itself."""
    s, t = Counter(), Counter()
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            counts.update(zlib.crc32(g.encode()) % buckets for g in grams(text, order)[1])
    S, T = s.total(), t.total()
    out = []
    for doc_id, text in docs:
        words, found = grams(text, order)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in (zlib.crc32(g.encode()) % buckets for g in found)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    open_ = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0]))
    for rank, r in enumerate(open_, 1):
        r.append(rank if rank <= percent * len(open_) // 100 else None)
    return sorted((tuple(r) if len(r) == 6 else (*r, None) for r in out), key=str)


LINES = ["the cat sat", "on the mat", "", "The dog, it ran.", "naïve café 12", "x"]


@pytest.mark.parametrize("order, buckets, percent", [(1, 10_000, 10), (1, 50, 50), (3, 1000, 35), (2, 7, 100)])
def test_resampling_follows_the_definition(spark, order, buckets, percent):
    rnd = random.Random(order)
    docs = [(k, "\n".join(rnd.choice(LINES) for _ in range(rnd.randint(0, 12)))) for k in range(200)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (None, "\n".join(LINES * 5)), (None, "the cat"), (203, "a" * 100_000 + " b\n" * 1000)]
    target = ["the cat\nsat on the mat the cat ran", "café", None, ""]
    source = spark.createDataFrame([(*d, "w", 1) for d in docs], "doc_id long, text string, weight string, rank int").repartition(3)
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, n long")
    rows = resampling.resample(source, wanted, order=order, buckets=buckets, min_words=3, percent=percent).collect()
    assert sorted((tuple(r) for r in rows), key=str) == resampled(docs, target, order, buckets, resampling.SEED, 3, percent)


def test_resampling_of_odd_rows(spark):
    rows = resampling.resample(documents(spark), documents(spark, DOCUMENTS[:3])).collect()
    assert len(rows) == len(DOCUMENTS)
    open_ = [r for r in rows if r["n_words"] >= 20]
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, len(open_) // 10 + 1))
    assert resampling.resample(documents(spark, EMPTY), documents(spark)).count() == 0
    alone = resampling.resample(documents(spark), documents(spark, EMPTY), percent=100).collect()
    assert sorted(r["rank"] for r in alone if r["rank"]) == list(range(1, len(open_) + 1))


def test_many_equal_scores_are_numbered_without_gaps(spark):
    """A third of all rows without an id and with one text: all have one score."""
    rows = [(None if k % 3 == 0 else k, "the cat sat on the mat") for k in range(900)]
    found = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("cat",)], "text string"), min_words=1, percent=80).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 721))
    order = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in order] == sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in order)


def targets_by_rounds(sizes, weights, most=3):
    """Share by weight, cap, share the excess again."""
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        total, over = sum(weights[s] for s in open_), 0.0
        for s in list(open_):
            target[s] += left * weights[s] / total
            if target[s] > most * sizes[s]:
                over += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
        left = over
    return target


def mixed_rows(seed=4, sources=9, each=60):
    rnd = random.Random(seed)
    rows = []
    for s in range(sources):
        name = None if s == sources - 1 else f"s{s:02d}"
        for _ in range(each * (12 if s == 2 else 1)):
            rows.append((len(rows), " ".join("w" for _ in range(rnd.randint(0, 2 if s % 4 == 1 else 30))), name))
    return rows


def test_targets_copies_and_the_mix_agree(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, size int, copies string")
    plan = mixture.plan_mixture(docs).collect()
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(text.split())
    names = sorted(sizes, key=lambda s: (s is None, s))
    expected = targets_by_rounds(sizes, {s: 1 + k % 3 for k, s in enumerate(names)})
    assert any(expected[s] == 3 * sizes[s] for s in names)
    taken = defaultdict(int)
    assert len(plan) == len(rows)
    for r in plan:
        source = rows[r["doc_id"]][2]
        assert r["size"] == len(rows[r["doc_id"]][1].split()) and r["source_size"] == sizes[source]
        assert math.isclose(r["target"], expected[source], rel_tol=1e-12)
        assert r["copies"] in (math.floor(r["target"] / sizes[source]), math.ceil(r["target"] / sizes[source]))
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s in names:  # four standard deviations of the draw
        assert abs(taken[s] - expected[s]) <= 4 * math.sqrt(sum(len(t.split()) ** 2 for _, t, of in rows if of == s)) / 2 + 1
    mixed = mixture.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({r["doc_id"]: r["copies"] for r in plan if r["copies"]})
    assert mixture.plan_mixture(docs.repartition(7)).orderBy("doc_id").collect() == sorted(plan, key=lambda r: r["doc_id"])


def test_many_sources_are_joined_without_sending_them_all(spark, monkeypatch):
    docs = spark.createDataFrame(mixed_rows(), "doc_id long, text string, source string")
    sent = mixture.plan_mixture(docs).orderBy("doc_id").collect()
    monkeypatch.setattr(mixture, "BROADCAST_BYTES", 0)
    assert mixture.plan_mixture(docs).orderBy("doc_id").collect() == sent


def test_given_weights(spark):
    docs = spark.createDataFrame(mixed_rows(), "doc_id long, text string, source string")
    given = spark.createDataFrame([("s00", 1.0), ("s02", 2.0), (None, 5.0)], "source string, weight double")
    rows = {r["source"]: r for r in mixture.source_targets(docs.select("source", mixture.size_of(docs.text).alias("size")), given, most=1000).collect()}
    total = sum(r["source_size"] for r in rows.values())
    assert math.isclose(rows[None]["target"], total * 5 / 8) and rows["s01"]["target"] == 0


def test_mixture_of_odd_rows(spark):
    plan = mixture.plan_mixture(documents(spark)).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in plan) == sorted((str(d[0]), len(WHITE.findall(d[1] or ""))) for d in DOCUMENTS)
    assert mixture.plan_mixture(documents(spark, EMPTY)).count() == 0
    empty = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixture.plan_mixture(empty).orderBy("doc_id").collect()] == [(1, 0, 0, 0.0, 0, 0), (2, 0, 0, 0.0, 0, 0)]
