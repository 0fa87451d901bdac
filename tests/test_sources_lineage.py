import json

import pytest
from pyspark.sql import functions as F

from helpers import day
from tidepanel.functions import text as tx
from tidepanel.operators import lineage as ln
from tidepanel.operators import universe as un
from tidepanel.sources import dimensions as dm
from tidepanel.sources import readers as rd
from tidepanel.sources import sinks


def test_classification_rules(spark):
    cases = [("8-K", "", "hecho_relevante"), (" 6-k ", "Dividend declared", "retorno_al_accionista"), ("10-Q", "dividend", "resultados_trimestrales"),
             ("8-K", "Quarter outlook", "resultados_trimestrales"), ("X", "tender offer", "financiamiento"), ("X", "", "sin_clasificar"),
             ("8-K", "proyeccion anual", "hecho_relevante"), ("8-K", "New CEO", "cambio_directivo"), ("8-K", "subdividend", "hecho_relevante"),
             ("8-K", "ébond", "hecho_relevante")]
    df = spark.createDataFrame(cases, "form string, title string, want string")
    for r in df.withColumn("got", tx.classify_filing(F.col("form"), F.col("title"))).collect():
        assert r.got == r.want, r
    stem = df.filter("title = 'proyeccion anual'").select(tx.classify_filing(F.col("form"), F.col("title"), stems=True).alias("c")).first()
    assert stem.c == "revision_guidance"


def test_filings_file(spark, tmp_path):
    recent = {"form": ["8-K", "10-K", "6-K"], "filingDate": ["2024-01-02", "2024-02-02", "2020-01-01"],
              "accessionNumber": ["1-2-3", "4-5-6", "7-8-9"], "primaryDocument": ["a.htm", "b.htm", "c.htm"]}
    path = tmp_path / "f.json"
    path.write_text(json.dumps({"filings": {"recent": recent}}))
    out = rd.read_filings(spark, str(path), "YPF", 904851, "2022-01-01").collect()
    assert len(out) == 1
    assert out[0].label == "8-K" and out[0].url.endswith("/904851/123/a.htm") and out[0].category == "hecho_relevante"


def test_broken_payloads_are_listed_and_lose_nothing_else(spark, tmp_path):
    recent = {"form": ["8-K"], "filingDate": ["2024-01-02"], "accessionNumber": ["1-2-3"], "primaryDocument": ["a.htm"]}
    good = json.dumps({"filings": {"recent": recent}})
    bodies = [("A", good), ("A", good[:50]), ("B", '{"filings": {}}'), ("C", ""), ("C", None), ("C", " \n"), ("D", "[1, 2]"), ("E", "no json"), ("F", '{"filings": {"recent": {}}}')]
    payloads = spark.createDataFrame([(t, 1, b) for t, b in bodies], "ticker string, cik long, body string")
    rejects = {(r.series, r.reason): r.rows for r in rd.payload_rejects(payloads, "filings").collect()}
    assert rejects == {("A", "MALFORMED"): 1, ("B", "NO_RECORDS"): 1, ("C", "EMPTY_BODY"): 3, ("D", "MALFORMED"): 1, ("E", "MALFORMED"): 1}
    assert [r.ticker for r in rd.parse_filings(payloads, "2020-01-01").collect()] == ["A"]
    index = spark.createDataFrame([("i", '{"data": [["2024-01-01", 1]]}'), ("j", "{"), ("k", '{"x": 1}')], "ticker string, body string")
    assert {(r.series, r.reason) for r in rd.payload_rejects(index, "index").collect()} == {("j", "MALFORMED"), ("k", "NO_RECORDS")}
    issuers = spark.createDataFrame([("i", '{"0": {"ticker": "a", "cik_str": 1}}'), ("j", "{"), ("k", "{}")], "ticker string, body string")
    assert {(r.series, r.reason) for r in rd.payload_rejects(issuers, "issuers").collect()} == {("j", "MALFORMED"), ("k", "NO_RECORDS")}
    path = tmp_path / "bad.json"
    path.write_text(good[:50])
    with pytest.raises(ln.MissingDataError):
        rd.read_filings(spark, str(path), "YPF", 1, "2022-01-01")
    assert rd.read_filings(spark, str(path), "YPF", 1, "2022-01-01", strict=False).isEmpty()


def test_sections_are_recorded_while_they_are_written(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([("A", day("2024-01-02"), 1), ("A", day("2024-01-03"), 2), ("B", day("2024-01-05"), None)], "ticker string, d date, v int")

    def counted(rows):
        for r in rows:
            reads.add(1)
            yield r

    section = spark.createDataFrame(df.rdd.mapPartitions(counted), df.schema)
    digest = [F.col("ticker"), F.col("d"), F.col("v")]
    records = {r.dataset_id: r for r in sinks.write_recorded({"all": sinks.Section(section, digest, ["raw"], ln.OBSERVED), "none": sinks.Section(df.limit(0), digest)}, str(tmp_path)).collect()}
    assert reads.value == 3
    want = df.agg(F.sum(ln.row_digest(digest)).cast("string")).first()[0]
    r = records["all"]
    assert (r.rows, r.first_obs, r.last_obs, r.content_hash, r.parents) == (3, day("2024-01-02"), day("2024-01-05"), want, ["raw"])
    assert spark.read.parquet(r.source_url).count() == 3 and records["none"].rows == 0 and records["none"].first_obs is None


def test_bucketed_bars_need_no_exchange(spark):
    import uuid

    from helpers import ohlcv_frame
    from tidepanel.operators import signals as sg

    bars = ohlcv_frame(spark, 400).unionByName(ohlcv_frame(spark, 400, 4, "B"))
    table = f"bars_{uuid.uuid4().hex}"
    sinks.write_bucketed(bars, table)
    stored = rd.read_bucketed(spark, table)
    built = sg.build_signals(stored)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    assert sorted(map(str, built.collect())) == sorted(map(str, sg.build_signals(bars).collect()))
    spark.sql(f"DROP TABLE {table}")


def test_index_file_aborts_on_missing_month(spark, tmp_path):
    path = tmp_path / "i.json"
    path.write_text('{"data": [["2024-01-01", 100.5], ["2024-02-01", null]]}')
    with pytest.raises(ln.MissingDataError):
        rd.read_monthly_index(spark, str(path))
    assert rd.read_monthly_index(spark, str(path), strict=False).count() == 2
    path2 = tmp_path / "j.json"
    path2.write_text('{"data": [["2024-01-01", 100.5]]}')
    assert rd.read_monthly_index(spark, str(path2)).first().level == 100.5


def test_secondary_no_data(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Open,High,Low,Close,Volume\n2024-01-02,1,2,0.5,1.5,10\n")
    (tmp_path / "b.csv").write_text("No data")
    assert rd.read_secondary_close(spark, str(tmp_path / "a.csv"), "A").first().close == 1.5
    assert rd.read_secondary_close(spark, str(tmp_path / "b.csv"), "B").isEmpty()


def test_manual_events_need_a_url(spark, tmp_path):
    good = {"date": "2026-08-04", "ticker": "Y", "category": "split", "label": "x", "url": "https://e.org"}
    path = tmp_path / "m.json"
    path.write_text(json.dumps([good, {**good, "url": ""}]))
    with pytest.raises(ln.MissingDataError):
        rd.read_manual_events(spark, str(path))
    rows = rd.read_manual_events(spark, str(path), strict=False).collect()
    assert [r.source for r in rows] == ["curated"] and rows[0].event_date == day("2026-08-04")


def test_issuers_and_holdings(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"0": {"ticker": "ypf", "cik_str": 904851}, "1": {"ticker": "MU", "cik_str": 1}}))
    tick = spark.createDataFrame([("YPF.BA",), ("ZZ",)], "ticker string")
    got = {r.ticker: r.cik for r in rd.resolve_issuers(tick, rd.read_issuers(spark, str(path))).collect()}
    assert got == {"YPF.BA": 904851, "ZZ": None}
    csv = tmp_path / "h.csv"
    csv.write_text("Name,Symbol\n" + "\n".join(f"n, {a}{b} " for a in "abcdefgh" for b in "abcdefgh") + "\nx,US-1\n")
    assert rd.read_holdings(spark, str(csv)).count() == 64
    csv.write_text("Name,Symbol\nn,A\n")
    with pytest.raises(ln.MissingDataError):
        rd.read_holdings(spark, str(csv))
    with pytest.raises(ln.MissingDataError):
        rd.normalise_holdings(spark.createDataFrame([("a",)], "other string"))


def test_bars_gate_and_nan(spark):
    raw = spark.createDataFrame([("A", "2024-01-02 10:00:00", 1.0, 1.0, 1.0, float("nan"), 5.0)],
                                "Ticker string, Date string, Open double, High double, Low double, Close double, Volume double")
    row = rd.normalise_bars(raw).first()
    assert row.close is None and row.d == day("2024-01-02")
    with pytest.raises(ln.MissingDataError):
        rd.normalise_bars(raw.drop("Close"))
    want = spark.createDataFrame([("A",), ("B",)], "ticker string")
    assert [r.ticker for r in rd.missing_keys(want, rd.normalise_bars(raw)).collect()] == ["B"]


def test_costs_by_market(spark):
    df = spark.createDataFrame([("YPFD.BA",), ("NVDA",)], "ticker string")
    got = {r.ticker: r.one_way for r in dm.with_costs(df).collect()}
    assert got == pytest.approx({"YPFD.BA": 0.0078, "NVDA": 0.0005})


def test_universe_falls_back(spark):
    symbols = spark.createDataFrame([(f"S{i}", i) for i in range(60)], "symbol string, position int")
    caps = spark.createDataFrame([(f"S{i}", float(i % 7) if i else None) for i in range(60)], "symbol string, cap double")
    top = [r.symbol for r in un.top_by_cap(symbols, caps, 3).collect()]
    assert top == ["S6", "S13", "S20"]
    assert not un.resolve_universe(symbols, caps, 10).first().is_fallback
    assert un.resolve_universe(symbols.limit(20), caps, 10).count() == 10
    assert un.resolve_universe(symbols.limit(20), caps, 10).first().is_fallback


def nodes(spark, extra=()):
    chain = [("raw", "observed", []), ("fake", "synthetic", [])]
    chain += [(f"d{i}", "derived", [f"d{i - 1}"] if i else ["fake", "raw"]) for i in range(6)]
    chain += [("clean", "derived", ["raw"]), *extra]
    return spark.createDataFrame(chain, "dataset_id string, kind string, parents array<string>")


def test_taint_survives_derivations(spark):
    n = nodes(spark)
    e = ln.edges_of(n)
    assert {r[0] for r in ln.tainted(n, e).collect()} == {"fake", *[f"d{i}" for i in range(6)]}
    kinds = {r.dataset_id: r.kind for r in ln.derived_kind(n, e).collect()}
    assert kinds["d5"] == "synthetic" and kinds["clean"] == "derived"
    ln.assert_report_safe(n, e, spark.createDataFrame([("clean",)], "dataset_id string"))
    with pytest.raises(ln.ContaminatedDataError):
        ln.assert_report_safe(n, e, spark.createDataFrame([("d5",)], "dataset_id string"))


def test_ancestors_with_shared_paths_and_sink(spark, tmp_path):
    n = nodes(spark, [("top", "derived", ["d2", "clean"])])
    closure = ln.ancestors(ln.edges_of(n))
    got = {(r.ancestor, r.depth) for r in closure.filter("dataset_id = 'top'").collect()}
    assert got == {("d2", 1), ("clean", 1), ("d1", 2), ("raw", 2), ("d0", 3), ("fake", 4)}
    path = str(tmp_path / "out")
    sinks.write_lineage(closure, n, path)
    assert spark.read.json(path).count() == closure.count()


def test_deep_chains_and_cycles(spark):
    edges = lambda pairs: spark.createDataFrame(pairs, "child string, parent string")
    chain = [(f"n{k}", f"n{k + 1}") for k in range(150)]
    closure = ln.ancestors(edges(chain))
    assert closure.count() == 150 * 151 // 2
    assert closure.filter("dataset_id = 'n0' AND ancestor = 'n150'").first().depth == 150
    for cycle in ([("a", "a")], [("a", "b"), ("b", "a")], [*chain, ("n150", "n0")]):
        with pytest.raises(ln.CyclicLineageError):
            ln.ancestors(edges(cycle))


def test_a_round_joins_new_pairs_only(spark, monkeypatch):
    """A chain of 150: the rows of all joins are the pairs that they find, each once."""
    rows = []
    real = ln.further_pairs

    def counted(far, known):
        step = far.join(known.select(F.col("dataset_id").alias("ancestor"), F.col("ancestor").alias("above")), "ancestor")
        rows.append(step.count())
        return real(far, known)

    monkeypatch.setattr(ln, "further_pairs", counted)
    closure = ln.ancestors(spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(150)], "child string, parent string"))
    assert closure.count() == 150 * 151 // 2 == sum(rows) + 150
    assert len(rows) == 8


def test_fingerprint_ignores_order_but_not_values(spark):
    df = spark.createDataFrame([("A", day("2024-01-02"), 1), ("A", day("2024-01-03"), 2)], "ticker string, d date, v int")
    h = lambda x: ln.fingerprint(x, [F.col("d"), F.col("v")]).first().content_hash
    assert h(df) == h(df.orderBy(F.desc("d")).repartition(3)) != h(df.withColumn("v", F.col("v") + 1))
