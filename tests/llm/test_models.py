"""Language mixtures, quality, fingerprints, vector links, Jaccard join and the pipeline, by brute force or held-out rows."""

import hashlib
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tables import DOCUMENTS, EMPTY, documents, prose
from tidepanel.llm import collisions, common, cotraining, groups, language, rarity
from tidepanel.llm.queries import QUERIES


def roots(nodes, edges):
    above = {n: n for n in nodes}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in edges:
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    nodes = {n for a, b in edges if a != b for n in (a, b)}
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_language_of_held_out_documents(spark, sf_dir):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op2_language_mixture"](spark, sf_dir).collect()]
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and held
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and abs(sum(r["shares"]) - 1) < 1e-6 for r in rows)


def best_mixture(scores, languages):
    """Shares of the set of languages with the best penalised likelihood, over all sets, by plain iteration."""
    best = None
    for mask in range(1, 1 << languages):
        chosen = [k for k in range(languages) if mask >> k & 1]
        like = np.exp(scores[:, chosen] - scores.max(1, keepdims=True))
        mix = np.full(len(chosen), 1 / len(chosen))
        for _ in range(200):
            part = like * mix
            mix = (part / part.sum(1, keepdims=True)).mean(0)
        value = np.log((like * mix).sum(1)).sum() - language.PENALTY * np.log(len(scores) + 1) * (len(chosen) - 1)
        if best is None or value > best[0]:
            best = value, dict(zip(chosen, mix))
    return best[1]


def test_mixture_finds_the_best_set():
    rng = np.random.default_rng(2)
    for shares in ([1, 0, 0], [0.6, 0.4, 0], [0.1, 0.2, 0.7], [0.34, 0.33, 0.33]):
        words = rng.choice(3, 400, p=shares)
        scores = rng.normal(-10, 0.3, (400, 3))
        scores[np.arange(400), words] += 4
        found = language.mixtures(scores, np.array([0, 400, 400]))
        wanted = best_mixture(scores, 3)
        assert set(np.flatnonzero(found[0])) == set(wanted)
        assert all(abs(found[0][k] - v) < 0.02 for k, v in wanted.items())
        assert not found[1].any()


def test_mixture_does_not_depend_on_the_texts_before():
    rng = np.random.default_rng(3)
    mixed = rng.normal(-10, 0.3, (400, 3))
    mixed[np.arange(400), rng.choice(3, 400, p=[0.6, 0.4, 0])] += 4
    before = np.full((50, 3), -10.0)
    before[:49, 0] += 10
    before[49, 1] += 60  # one word that another language likes by 60 nats more
    alone = language.mixtures(mixed, np.array([0, 400]))[0]
    behind = language.mixtures(np.concatenate((before, mixed)), np.array([0, 50, 50, 450]))
    assert np.count_nonzero(alone) == 2 == np.count_nonzero(behind[2])
    assert (behind[2] == alone).all() and not behind[1].any()
    huge = common.sums(np.array([1e300, 1.0, 2.0, 1e17, 1.0]), np.array([0, 1, 1, 3, 4, 5, 5]))
    assert huge.tolist() == [1e300, 0.0, 3.0, 1e17, 1.0, 0.0]


def test_language_of_odd_rows(spark):
    docs = documents(spark)
    model = language.fit(docs)
    rows = language.identify(docs, model, keep=("lang", "length")).collect()
    assert len(rows) == len(DOCUMENTS)
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "fr", "und"}
    assert sum(r["lang_pred"] == "und" for r in rows) == sum(not re.search(r"[^\W\d_]", d[1] or "") for d in DOCUMENTS)
    assert all(r["score"] == 0 for r in rows if r["lang_pred"] == "und")
    none = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(documents(spark, EMPTY), model).collect() == []


def test_quality_of_labelled_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op7_cotrained_quality"](spark, sf_dir).collect()}
    assert len(rows) == 1000
    right = [rows[d]["accepted"] == bool(q) for d, q in labels.items() if d in rows]
    assert np.mean(right) > 0.97
    assert all(0 <= r["quality_score"] <= 1 for r in rows.values())


def test_features_of_a_large_batch_take_little_memory(monkeypatch):
    """Python workers hold a chunk of a batch at a time, with about a hundred bytes for each of it, and small tables of powers."""
    monkeypatch.setattr(groups, "_powers", {})
    texts = [prose(k, 400) for k in range(1500)]
    data, offsets = common.text_buffers(pa.array(texts, pa.large_string()))
    assert len(data) > 2_000_000
    tracemalloc.start()
    parts = [cotraining.text_view(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]) for i, j in common.chunks(offsets)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50_000_000, peak
    assert np.array_equal(np.concatenate(parts), cotraining.text_view(data, offsets))


def test_quality_of_odd_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    scorer = cotraining.train(docs, labels)
    rows = cotraining.score_documents(docs, scorer, keep=("doc_id", "length")).collect()
    assert len(rows) == len(DOCUMENTS) and all(r["accepted"] for r in rows)
    fitted = cotraining.Scorer(np.ones(15), np.ones(cotraining.SOURCE_BUCKETS + cotraining.LANG_BUCKETS + 3), np.array([1.0, 0.0, 0.0]))
    assert len(cotraining.score_documents(docs, fitted).collect()) == len(DOCUMENTS)
    assert cotraining.score_documents(documents(spark, EMPTY), fitted).collect() == []
    none = cotraining.train(documents(spark, EMPTY), labels.limit(0))
    assert none.constant == 1.0


def plain_regression(x, y, regularisation=1e-4):
    """Newton's method on the mean log loss with the penalty on standardised weights; constant columns have weight 0."""
    spread = x.std(0, ddof=1)
    used = np.flatnonzero(spread > 0)
    z = np.column_stack([x[:, used], np.ones(len(x))])
    penalty = np.diag(np.append(regularisation * spread[used] ** 2, 0))
    w = np.zeros(z.shape[1])

    def loss(w):
        return np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).mean() + w @ penalty @ w / 2

    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        curve = z.T @ (z * (p * (1 - p))[:, None]) / len(z) + penalty
        step = np.linalg.lstsq(curve, z.T @ (p - y) / len(z) + penalty @ w, rcond=1e-14)[0]
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-10:
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    out = np.zeros(x.shape[1] + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def plain_cotraining(views, label, held, rounds):
    """The rounds as a loop over arrays: (weights, scale, pseudo-labels by round and judging view)."""
    known, seeds = ~np.isnan(label), ~np.isnan(label) & ~held
    examples = {v: (views[v][seeds], label[seeds]) for v in views}
    given, weights, scale, margin = [], {}, {}, {}
    for step in range(rounds + 1):
        for v in views:
            weights[v] = plain_regression(*examples[v])
            margin[v] = views[v] @ weights[v][:-1] + weights[v][-1]
            scale[v] = plain_regression(margin[v][known & held][:, None], label[known & held])
        if step < rounds:
            for v, judge in (("words", "about"), ("about", "words")):
                chance = 1 / (1 + np.exp(-(margin[judge] * scale[judge][0] + scale[judge][1])))
                sure = ~known & ((chance >= cotraining.SURE) | (chance <= 1 - cotraining.SURE))
                given.append((judge, {int(k): float(chance[k] > 0.5) for k in np.flatnonzero(sure)}, chance))
                examples[v] = (np.concatenate([views[v][seeds], views[v][sure]]), np.concatenate([label[seeds], (chance[sure] > 0.5).astype(float)]))
    return weights, scale, given


def test_cotraining_follows_the_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 2, 900)
    rows = []
    for k, y in enumerate(truth.tolist()):
        words = prose(k, 30).replace(".", "").split()
        for at in rng.integers(0, 30, rng.poisson(5 - 4 * y)):
            words[at] += "!"
        rows.append((k, " ".join(words), "en", "abcd"[rng.choice(4, p=[0.02, 0.28, 0.3, 0.4] if y else [0.4, 0.3, 0.28, 0.02])], int(rng.lognormal(5 + y, 0.5)), "x", 1))
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, int(truth[k]), 0) for k in range(400)], "doc_id long, quality int, toxic int")
    calls = []
    real = cotraining.sure_examples

    def noted(others, judge, weights, scale):
        found = real(others, judge, weights, scale)
        calls.append((judge, {r["doc_id"]: r["label"] for r in found.collect()}))
        return found

    monkeypatch.setattr(cotraining, "sure_examples", noted)
    scorer = cotraining.train(docs, labels, rounds=2)
    held = {r["doc_id"] for r in labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) == 0).collect()}
    data, offsets = common.text_buffers(pa.array([r[1] for r in rows], pa.large_string()))
    views = {"words": cotraining.text_view(data, offsets), "about": cotraining.metadata_view([r[3] for r in rows], [r[2] for r in rows], [r[4] for r in rows])}
    label = np.where(np.arange(900) < 400, truth, np.nan)
    weights, scale, given = plain_cotraining(views, label, np.isin(np.arange(900), list(held)), 2)
    assert [judge for judge, _ in calls] == [judge for judge, *_ in given]
    for (judge, found), (_, expected, chance) in zip(calls, given):
        clear = {k for k in range(400, 900) if min(abs(chance[k] - cotraining.SURE), abs(1 - chance[k] - cotraining.SURE)) > 0.002}
        assert {k: v for k, v in found.items() if k in clear} == {k: v for k, v in expected.items() if k in clear}
        assert len(found) > 20  # both views are sure of some
    calibrated = np.column_stack([(views[v] @ weights[v][:-1] + weights[v][-1]) * scale[v][0] + scale[v][1] for v in ("words", "about")])
    known = np.isin(np.arange(900), list(held))
    both = plain_regression(calibrated[known], truth[known])
    wanted = 1 / (1 + np.exp(-(calibrated @ both[:-1] + both[-1])))
    assert np.abs(scorer.score(views["words"], views["about"]) - wanted).max() < 0.03


def test_exchanged_labels_teach_the_other_view(spark):
    """Labels only know sources s0 and s1 and exclamation marks. Sources s2 and s3 are learned from texts, sevens and
    bars behind the marks from sources; documents that show nothing but these are right after the exchange only."""
    def text(k, mark):
        return " ".join(w + mark * (n % 4 == 0) for n, w in enumerate(prose(k, 24).replace(".", "").split()))

    rows, truth = [], {}

    def add(count, sources, marks):
        for k in range(count):
            good = k % 2
            truth[len(rows)] = good
            rows.append((len(rows), text(k, marks[good]), "en", sources[good], 100, "x", 1))

    add(200, ("s1", "s0"), ("!", ""))
    add(300, ("s3", "s2"), ("!", ""))
    add(300, ("s1", "s0"), ("!7", "!|"))
    by_source, by_text = range(800, 900), range(900, 1000)
    add(100, ("s3", "s2"), ("=", "="))
    add(100, ("s9", "s9"), ("!7", "!|"))
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, truth[k], 0) for k in range(200)], "doc_id long, quality int, toxic int")
    right = {}
    for rounds in (0, 2):
        found = {r["doc_id"]: r["accepted"] for r in cotraining.score_documents(docs, cotraining.train(docs, labels, rounds=rounds)).collect()}
        right[rounds] = [np.mean([found[k] == bool(truth[k]) for k in part]) for part in (range(200), by_source, by_text)]
    assert right[0][0] == right[2][0] == 1.0
    assert max(right[0][1:]) < 0.8 and min(right[2][1:]) > 0.95, right


def plain_features(raw):
    """Features of one text by the definition, window by window."""
    if len(raw) < rarity.WINDOW:
        windows = []
    else:
        windows = [raw[k:k + rarity.WINDOW] for k in range(len(raw) - rarity.WINDOW + 1)]
    total = np.array([sum(int(rarity._TERM[c]) for c in Counter(w).values()) for w in windows], np.int64)
    rank = rarity._rank(total) if windows else total
    popular = Counter()
    for first in range(-rarity.WINDOW + 1, len(windows)):
        span = [(rank[k], k) for k in range(max(first, 0), min(first + rarity.WINDOW, len(windows))) if rank[k] < rarity._NEVER]
        if span:
            popular[min(span)[1]] += 1
    return sorted(k for k, n in popular.items() if n >= rarity.POPULARITY)


def test_features_by_definition(monkeypatch):
    rng = np.random.default_rng(7)
    texts = [prose(3, 60), prose(5, 20) + " aaaa" * 40, "short", "", "ü" * 90, "".join(map(chr, rng.integers(32, 1000, 400))), prose(1, 200)]
    data, offsets = common.text_buffers(pa.array(texts, pa.large_string()))
    whole = rarity.features(data, offsets)
    for text, found in zip(texts, whole):
        raw = text.encode()
        windows = {raw[k:k + rarity.WINDOW] for k in plain_features(raw)}
        if len(raw) < rarity.SHORT:
            windows |= {raw[k:k + rarity.SMALL] for k in range(len(raw) - rarity.SMALL + 1)}
        assert len(found) == max(len(windows), 1)
    monkeypatch.setattr(rarity, "SEGMENT", 150)  # long texts in segments have the same features
    assert all((a == b).all() for a, b in zip(whole, rarity.features(data, offsets)))


def test_window_sums_across_stretches(monkeypatch):
    """Bytes are counted by stretches: windows that cross them have the sums of the definition."""
    monkeypatch.setattr(rarity, "STRETCH", 100)
    rng = np.random.default_rng(3)
    for n in (64, 65, 99, 100, 101, 163, 164, 700):
        for kinds in (1, 3, 256):
            data = rng.integers(0, kinds, n).astype(np.uint8)
            expected = [sum(int(rarity._TERM[c]) for c in Counter(data[k:k + rarity.WINDOW].tolist()).values()) for k in range(n - rarity.WINDOW + 1)]
            assert rarity._window_sums(data).tolist() == expected, (n, kinds)


def test_short_texts_are_compared_by_small_windows():
    one = "A short line about a brown fox that jumps over a lazy dog."
    texts = [one, one.replace("brown", "brawn"), "Nothing of that kind is said in this other line of words.", one[:29] + "quite another second half of it", "tiny", "tiny", "tine"]
    chain = rarity.chains(texts)
    assert rarity.likeness(chain[0], chain[1]) > 0.5 > 0.05 > rarity.likeness(chain[0], chain[2])
    assert rarity.likeness(chain[0], chain[3]) > 0.3
    assert rarity.likeness(chain[4], chain[5]) == 1.0 and rarity.likeness(chain[4], chain[6]) < 0.5
    for size in (100, 150, 190):  # an edited text has its first half
        whole = prose(3, 60)[:size]
        first, second = rarity.chains([whole, whole[:size // 2 + size % 2] + prose(11, 60)[:size // 2]])
        assert rarity.likeness(first, second) > 0.3


@pytest.mark.parametrize("ids", [[*range(2000), 10 ** 12], [None] * 700 + [*range(1301)], [5] * 1000 + [k * 10 ** 9 for k in range(1000)], [-(1 << 63), (1 << 63) - 1, *range(-1000, 1000)]])
def test_buckets_of_ids_are_even(spark, ids):
    docs = spark.createDataFrame([(i, f"text {k} of the table") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = rarity._with_next(docs, "doc_id", "text").filter("extra = 0").groupBy("bucket").count().collect()
    assert sum(r["count"] for r in rows) == len(ids)
    assert max(r["count"] for r in rows) < 4 * len(ids) / 32 and len(rows) > 24
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rarity._with_next(docs, "doc_id", "text").filter("extra = 0").orderBy("bucket", F.asc_nulls_first("doc_id")).collect()]
    assert order == sorted(order)


def test_likeness():
    a, b, c = rarity.chains([prose(1, 900), prose(1, 800) + prose(2, 100), "".join(f"{k * 7919 % 10007:x} " for k in range(900))])
    assert rarity.likeness(a, a) == 1 and rarity.likeness(a, b) == rarity.likeness(b, a) > 0.6 > 0.4 > rarity.likeness(a, c) >= 0


@pytest.mark.parametrize("rows", [DOCUMENTS, [(5, "only one", None, None, None, None, None)], EMPTY, [(10 ** 12 * (k % 3) + k, prose(k), None, None, None, None, None) for k in range(60)]])
def test_fingerprints_of_odd_rows(spark, rows):
    found = rarity.fingerprint_documents(documents(spark, rows)).collect()
    order = sorted(((d[0] is not None, d[0] or 0, d[1] or "") for d in rows))
    texts = [t for _, _, t in order]
    wanted = Counter()
    for k, (_, _, text) in enumerate(order):
        half = len(text) // 2
        edited = text[:len(text) - half] + texts[(k + 1) % len(texts)][:half]
        wanted[order[k][1] if order[k][0] else None, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found) == wanted
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    by_text = defaultdict(set)
    for r in found:
        by_text[next((t for p, i, t in order if (i if p else None) == r["doc_id"] and len(t) == r["n_chars"]), None)].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())


def test_vector_links_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    rows = [*base, *(base[:60] + rng.normal(0, 0.1, (60, 16))), *(base[7] + rng.normal(0, 0.05, (80, 16))), *base[:20], base[3] * 5.0]
    table = [(k, [float(x) for x in v], 1) for k, v in enumerate(rows)]
    odd = [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] * 8, 1), (904, [float("nan")] + [1.0] * 15, 1), (905, [float("inf")] * 16, 1), (906, [1.0, 2.0], 1), (907, [1.0, 2.0], 1), (5, table[5][1], 2)]
    vectors = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>, cell int")
    found = collisions.link_vectors(vectors).collect()
    assert len(found) == len(table) + len(odd)
    ids = [k for k, _, _ in table] + [5]
    unit = np.array([*rows, rows[5]])
    unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    component = roots(set(ids), [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if ids[a] != ids[b]])
    count = defaultdict(list)
    for i, n in zip(ids, near.sum(1)):
        count[i].append(int(n))
    mine = defaultdict(list)
    for r in found:
        mine[r["vec_id"]].append(r["n_links"])
        if r["vec_id"] in component:
            assert r["component_id"] == component[r["vec_id"]] and r["kept"] == (r["vec_id"] == r["component_id"])
    assert {i: sorted(n) for i, n in count.items()} == {i: sorted(n) for i, n in mine.items() if i in count}
    rest = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found if r["vec_id"] >= 900}
    assert rest == {k: (0, k) for k in range(900, 906)} | {906: (1, 906), 907: (1, 906)}
    assert collisions.link_vectors(vectors.limit(0)).collect() == []


def test_large_cells_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(1)
    rows = [(k, [float(x) for x in np.ones(8) + rng.normal(0, 0.02, 8)]) for k in range(150)]
    found = collisions.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {(r["n_links"], r["component_id"]) for r in found} == {(149, 0)}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    edges = [(sets[a][0], sets[b][0]) for a in range(len(sets)) for b in range(a) if sets[a][1] and sets[b][1]
             and 100 * len(sets[a][1] & sets[b][1]) >= 80 * len(sets[a][1] | sets[b][1])]
    return {i: len(s) for i, s in sets}, roots({i for i, _ in sets}, edges)


def test_jaccard_join_by_brute_force(spark):
    rng = np.random.default_rng(9)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, passage = [], " ".join(vocabulary[:60])
    for k in range(120):
        text = " ".join(rng.choice(vocabulary, rng.integers(1, 120)))
        rows.append(text + (" " + passage if k % 3 == 0 else ""))
    for k in range(120):  # chains of edits around the threshold
        words = rows[k % 40].split() if k < 80 else rows[-1].split()
        for _ in range(max(1, len(words) // 40)):
            words[int(rng.integers(0, len(words)))] = str(rng.choice(vocabulary))
        rows.append(" ".join(words))
    rows += ["a b", "A  b", "a b c d", "a b c d e", "", None, " ", rows[0].upper(), "é É"]
    table = list(enumerate(rows))
    size, component = brute_components(table)
    found = {r["doc_id"]: r for r in groups.link_documents(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert {i: r["n_shingles"] for i, r in found.items()} == size
    assert {i: r["component_id"] for i, r in found.items()} == component


def test_places_and_bands_let_in_every_linked_size(spark):
    """A set of x tokens whose first shared one stands at place p shares x - p at most; all partners for which that is
    enough are within the bound, and their band within the bands of the bound."""
    x, y, p = F.col("x"), F.col("y"), F.col("p")
    grid = spark.range(1, 300).select(F.col("id").alias("x")).withColumn("p", F.explode(F.sequence(F.lit(0), F.floor(x / 5).cast("int"))))
    grid = grid.withColumn("y", F.explode(F.sequence(F.ceil(x * 4 / 5), F.floor(x * 5 / 4))))
    enough = 9 * (x - p) >= 4 * (x + y)
    largest = groups._largest(x, p)
    assert grid.filter(enough != (y <= largest)).isEmpty()
    assert grid.filter(enough & ~groups._band(y).between(groups._band(F.ceil(x * 4 / 5)), groups._band(largest))).isEmpty()


def test_linked_sets_share_the_wanted_leading_tokens():
    rng = np.random.default_rng(2)
    sizes = [(int(a), int(b)) for a in rng.integers(1, 120, 60) for b in range(-(-int(a) * 4 // 5), int(a) * 5 // 4 + 1)]
    for s, t in sizes:
        common = -(-4 * (s + t) // 9)
        if common > min(s, t):
            continue
        order = rng.permutation(s + t - common)  # a common order of all tokens
        x, y = np.sort(order[:s]), np.sort(order[s - common:])
        lists = [set(z[:len(z) - -(-len(z) * 4 // 5) + 1].tolist()) for z in (x, y)]
        rest = max(-(-s * 4 // 5), -(-t * 4 // 5)) - 1
        assert len(lists[0] & lists[1]) >= max(common - rest, 1)


def test_near_copies_that_do_not_link_form_few_pairs(spark):
    """Copies of one text of 60 words, two words changed in each: most do not link, and all hold the same passages. The
    passages' places let none of them in; what meets are the few copies whose changes touch hardly a shingle."""
    counts = []
    for copies in (300, 1200):
        rng = np.random.default_rng(copies)
        texts = []
        for k in range(copies):
            words = [f"w{n}" for n in range(60)]
            for at in rng.choice(60, 2, replace=False):
                words[at] = f"own{k}x{at}"
            texts.append((k, " ".join(words)))
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        levels = groups.commonness(groups.sketch(docs, "doc_id", "text"))
        lead = groups.leading_tokens(docs, levels, "text").withColumn("group", F.col("node"))
        cells = common.stored(groups.matrix_cells(lead), "cells")
        few = sum(len({k for k, w in enumerate(t.split()) if w.startswith("own")} & set(range(4, 56))) == 0
                  or len({max(0, min(55, k - d)) for k, w in enumerate(t.split()) if w.startswith("own") for d in range(5)}) <= 7 for _, t in texts)
        opened = common.stored(groups.open_groups(cells), "opened")
        counts.append((cells.select("node").distinct().count(), opened.select("node", "other").distinct().count()))
        assert counts[-1][0] <= 2 * few + 10 and opened.count() < 1.5 * counts[-1][1] + 100
    assert counts[1][1] < 12_000  # 69,486 when places did not count
    assert {r["component_id"] for r in groups.link_documents(docs).collect()} == set(brute_components(texts)[1].values())


def test_jaccard_join_without_first_groups(spark, monkeypatch):
    """The matrix alone finds every link, also when no min-hash has joined anything before."""
    monkeypatch.setattr(groups, "verify", lambda pairs, *rest, real=groups.verify, calls=[]: real(pairs.limit(0) if not calls and not calls.append(1) else pairs, *rest))
    table = [(k, prose(k % 9, 30 + k % 4)) for k in range(60)]
    _, component = brute_components(table)
    found = groups.link_documents(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == component


def test_jaccard_join_of_odd_rows(spark):
    found = groups.link_documents(documents(spark)).collect()
    assert len(found) == len(DOCUMENTS)
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[2]["component_id"] == 1 and by_id[8]["component_id"] == 7 and by_id[4]["n_shingles"] == 0
    assert groups.link_documents(documents(spark, EMPTY)).collect() == []


def test_pipeline_by_stages(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = {r["doc_id"]: r["text"] for r in held.collect()}
        held = common.stored(stage(spark, held, sf_dir), name)
        assert held.columns == columns
        after = {r["doc_id"]: r["text"] for r in held.collect()}
        assert after.items() <= before.items() and after
        if name == "near_duplicates":
            _, component = brute_components(before.items())
            assert set(after) == {i for i, c in component.items() if i == c}
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == set(after)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [i for i, t in {r["doc_id"]: r["text"] for r in docs.collect()}.items() if labels.get(i) == 1 and t]
    kept = corpus_pipeline.quality(spark, docs, sf_dir).select("doc_id").collect()
    assert len(set(clean) - {r["doc_id"] for r in kept}) <= 0.03 * len(clean)


def test_one_row_of_each_group_whatever_its_id(spark):
    import corpus_pipeline

    texts = {k: prose(k, 60) for k in range(1, 8)}
    near = texts[4].replace("fox", "cat", 1)
    rows = [(3, texts[1]), (5, texts[1]), (5, texts[2]), (None, texts[3]), (None, texts[3]), (None, texts[1]), (None, texts[4]), (9, near), (7, texts[5]), (7, texts[5]), (7, texts[6]),
            (None, texts[7]), (8, ""), (8, ""), (8, texts[1].upper()), (None, None), (None, None)]
    kept = corpus_pipeline.one_of_each_group(spark, documents(spark, [(*r, "en", "a", 1, "x", None) for r in rows]), "").collect()
    wanted = [(3, texts[1]), (5, texts[2]), (None, texts[3]), (9, near), (7, texts[5]), (7, texts[6]), (None, texts[7]), (8, ""), (None, None), (None, None)]
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter(wanted)


def test_pipeline_stages_bear_odd_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (DOCUMENTS, EMPTY):
        docs = documents(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, str(tmp_path)), name)
            if name == "quality":
                assert docs.count() == len(rows)
        assert docs.filter(F.col("length").isNull()).isEmpty()


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    names = ["score", "accepted", "lang_pred", "shares", "languages", "quality_score", "stays", "an id", "text key", "row", "further 7"]
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = documents(spark)
    for name in names:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    held = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        held = common.stored(stage(spark, held, str(tmp_path)), name)
        assert held.columns == docs.columns
    assert held.count() > 3
    for row in held.filter("doc_id is not null").collect():
        assert all(row[name] == f"{name}{row['doc_id']}" for name in names)
    with pytest.raises(ValueError, match="score"):
        language.identify(docs, language.Model([], np.zeros((1, 0)), np.zeros((1, 0))), keep=("score",))
    with pytest.raises(ValueError, match="accepted"):
        cotraining.score_documents(docs, cotraining.Scorer(constant=1.0), keep=("accepted",))
