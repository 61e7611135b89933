"""Queries against their SQL in DuckDB on the smallest tables, and the whole study end to end."""

import json
import math
from dataclasses import replace
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import main
from tidemark.plans import queries, study
from tidemark.plans.adapters import BENCHMARK, Fixtures
from tidemark.plans.oracles import ORACLES
from tidemark.sources import sinks

SMALL = "/root/testdata/sf0.001"
CHECKED = ("sue_panel", "quarterly_derived", "asof_forward", "asof_nearest", "plausibility", "lookahead_violations", "timing_mix", "audit", "event_returns", "wild_bootstrap", "daily_book", "cost_curve")


def shown(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return str(v)[:10] if hasattr(v, "year") else v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(shown(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {t.stem} AS SELECT * FROM read_parquet('{t}')")
    mine, theirs = queries.QUERIES[name](spark, SMALL).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and p == pytest.approx(q, abs=2e-5)) for p, q in zip(x, y, strict=True)), (x, y)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(ORACLES)
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_study_end_to_end(spark, tmp_path):
    fx = Fixtures(spark, "/root/testdata/sf0.01")
    prices = fx.grid.select("session", "ticker", "open", "close")
    cfg = replace(queries.CFG, n_bootstrap=40)
    done = study.run_study(study.Inputs(fx.eps, fx.announcements, prices, fx.universe, fx.factors, fx.consensus), cfg)
    t = {k: v.collect() for k, v in done.tables.items()}
    audit = [r.n for r in t["sample_audit"]]
    assert [r.stage for r in t["sample_audit"]][0] == "eps_rows" and all(a >= b for a, b in zip(audit[2:], audit[3:]))
    assert audit[-1] == done.events.count()
    tests = {(r.metric, r.method): r for r in t["inference_tests"]}
    assert len(tests) == 21 and tests["abdrift_d20", "welch_t"].estimate == pytest.approx(tests["abdrift_d20", "wild_cluster_bootstrap_t"].estimate)
    curve = sorted((r.round_trip_bps, r.next_close) for r in t["cost_curve"])
    assert all(a[1] >= b[1] for a, b in zip(curve, curve[1:]))
    assert dict(curve)[5.0] == pytest.approx(next(r.total_return_pct for r in t["backtest_summary"] if r.entry_timing == "next_close"))
    assert {r.portfolio for r in t["calendar_time_alpha"]} == {"spread_ret", "long_ret", "short_ret"} and len(t["power_analysis"]) == 1 and len(t["surprise_definitions"]) == 2
    figures = study.figure_tables(done, fx.grid, cfg)
    assert {k[0] for k in figures} == set("123456789") and BENCHMARK == cfg.benchmark
    assert figures["2_bucket_d5"].count() == 3 and figures["8_legs"].count() == 3
    n = done.tables["daily"].where("net_ret is not null").count()
    assert figures["6_equity"].count() == -(-n // 5)
    assert figures["6_benchmark"].orderBy("session").first().growth == 1.0
    assert [r.is_highest for r in figures["7_decay"].orderBy("spread").collect()].count(True) == 1 and figures["4_means"].first().gap is not None
    assert {"ci_low", "ci_high", "mean_y"} <= set(figures["1_bins"].columns)
    sinks.save_events(done.events, str(tmp_path / "panel"), cfg, "test", "made here")
    side = json.loads((tmp_path / "panel.meta.json").read_text())
    assert side["n_events"] == audit[-1] == sinks.load_events(spark, str(tmp_path / "panel")).count() and side["beat_threshold_sigma"] == cfg.beat_threshold
    with pytest.raises(FileNotFoundError, match="main.py study"):
        sinks.load_events(spark, str(tmp_path / "none"))
    assert len(main.headline(done, "abdrift_d20")) == 1 + 3 + 2 + 2
    paths = sinks.write_results({k: done.tables[k] for k in ("sample_audit", "daily")}, str(tmp_path), "test", "made here", "2001-12-31")
    assert all(Path(p + ".meta.json").exists() for p in paths) and spark.read.option("header", True).csv(paths[0]).count() == len(audit)
