import duckdb
import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as entry
from tidepanel.plans import analysis as an
from tidepanel.plans import panel as pn
from tidepanel.plans.queries import QUERIES, strategy_panel

# These start jobs while the plan is built (checkpoints, files).
EAGER = {"lineage", "lineage_union", "contamination_gate", "write_lineage", "write_results", "regime_medians",
         "compare_strategies", "comparison_verdict", "analyze_panel", "fifo_match", "realized_gains", "ledger_running_balance",
         "ledger_totals", "oversold_accounts", "liquidation_value", "ledger_mismatches", "xs_momentum_rank", "caar_by_category",
         "verdicts", "bootstrap_gather", "bootstrap_sharpe_ci", "bootstrap_pvalue", "stationary_bootstrap", "walk_forward_plugin",
         "walk_forward_plugin_summary", "recorded_sections", "load_bars_bucketed", "analysis_gates"}


def test_every_query_has_a_twin():
    assert QUERIES.keys() <= entry.queries().keys()
    assert QUERIES.keys() <= entry.oracle_sql().keys() <= entry.queries().keys()


def test_entry(spark):
    assert entry.entry(spark).count() == 15


@pytest.mark.parametrize("key", ["latest_signal", "strategy_summary", "event_study", "realized_gains", "pbo", "rejects", "ledger_mismatches",
                                 "series_fingerprint", "comparison_verdict", "analysis_gates", "recorded_sections", "payload_rejects",
                                 "load_filings_beside_rejects", "walk_forward_plugin", "load_bars_bucketed"])
def test_small_scale_twins(spark, sf_dir, key):
    from tools.check_oracles import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert compare(QUERIES[key](spark, sf_dir).toPandas(), con.execute(entry.oracle_sql()[key]).df()) == ""


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_any_plan(spark, sf_dir):
    for key, fn in QUERIES.items():
        if key not in EAGER:
            plan = plan_of(fn(spark, sf_dir))
            for node in ("PythonUDF", "EvalPython", "InPandas", "InArrow", "CartesianProduct"):
                assert node not in plan, (key, node)


def test_strategy_panel_shuffles_twice(spark, sf_dir):
    """Once to aggregate trades into days, once by series; every window reuses that."""
    plan = plan_of(strategy_panel(pn.bars(spark, sf_dir)))
    assert plan.count("Exchange hashpartitioning") == 2


def test_scan_reads_only_needed_columns(spark, sf_dir):
    plan = plan_of(QUERIES["latest_signal"](spark, sf_dir))
    assert "l_tax" not in plan and "l_comment" not in plan
    window = plan_of(QUERIES["warmup_window"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in window


@pytest.mark.parametrize("key, scans", [("data_anomalies", 4), ("latest_signal", 2), ("dsr", 2), ("ratio_asof", 4), ("reconcile_sources", 4),
                                        ("ccl_level_gap", 8), ("load_filings", 1)])
def test_facts_are_read_once(spark, sf_dir, key, scans):
    """A panel of bars is two files (trades and orders); each side of a comparison is one panel. The bars with anomalies
    are a panel and its repeated dates."""
    assert plan_of(QUERIES[key](spark, sf_dir)).count("FileScan") <= scans


@pytest.mark.parametrize("key", ["analysis_gates", "analyze_panel"])
def test_whole_runs_form_their_bars_once(spark, sf_dir, monkeypatch, key):
    """Every table that a whole run gets comes from the written bars: only their first plan joins trades."""

    class Given(Exception):
        pass

    def given(panel, market, events, **others):
        gates = others.get("gates")
        raise Given([panel, market, *[t for t in [others.get("secondary"), *(vars(gates).values() if gates else ())] if isinstance(t, DataFrame)]])

    monkeypatch.setattr(an, "analyze_panel", given)
    with pytest.raises(Given) as found:
        QUERIES[key](spark, sf_dir)
    tables = found.value.args[0]
    assert len(tables) > 2 and all("l_orderkey" not in plan_of(t) for t in tables)


def test_json_is_parsed_once(spark, sf_dir):
    for key in ("load_filings", "json_functions"):
        plan = QUERIES[key](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1, key
