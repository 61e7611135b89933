"""Hot keys and whole-table orders: one key with 200,000 rows, ranks and numbers against plain Python, settings that raise."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import inference, panel, portfolio, ranks, temporal
from tidemark.config import CostAssumptions


def test_asof_of_one_hot_key(spark):
    n = 200_000
    left = spark.range(n).select(F.lit("hot").alias("k"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") % 40_000).cast("int")).alias("at"), "id")
    right = spark.range(n).select(F.lit("hot").alias("k"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("id") % 40_000 * 2).cast("int")).alias("day"), F.col("id").alias("v"))
    began = time.perf_counter()
    got = temporal.asof_forward(left, right, "k", "at", "day", ["day", "v"], 3, ["v"]).agg(F.count("v").alias("n"), F.max(F.datediff("day", "at")).alias("far"), F.max("v").alias("v")).first()
    assert (got.n, got.far, got.v) == (n, 1, 20_000) and time.perf_counter() - began < 60


def test_sums_before_and_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.0, 2.0, 2.5, 7.0]), i, rng.randrange(9)) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, id int, w int").repartition(5)
    got = {r.id: r for r in ranks.with_sum_before(df, ["x", "id"], "w", "before").collect()}
    ordered, so_far = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])), 0
    for x, i, w in ordered:
        assert got[i].before == so_far and got[i].x == x
        so_far += w
    numbers = ranks.with_sum_before(df, ["x", "id"], None, "i").orderBy("i").collect()
    assert [r.i for r in numbers] == list(range(300)) and [r.id for r in numbers] == [i for _, i, _ in ordered]
    assert ranks.with_sum_before(df.where("id < 0"), ["x", "id"], None, "i").count() == 0
    known = [r for r in rows if r[0] is not None]
    for r in ranks.average_rank(df.where("x is not null"), "x", "rank").collect():
        less, ties = sum(k[0] < r.x for k in known), sum(k[0] == r.x for k in known)
        assert r["rank"] == less + (ties + 1) / 2


def test_spearman_of_ties(spark):
    rows = [(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (5.0, 9.0), (None, 1.0)]
    got = inference.spearman(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    a, b = [1.5, 1.5, 3, 4], [1, 2.5, 2.5, 4]
    ma, mb = sum(a) / 4, sum(b) / 4
    want = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    assert got.n == 4 and got.rank_correlation == pytest.approx(want)


def test_band_holds_the_line(spark):
    rows = [(float(i % 50), 2.0 * (i % 50) + (i * 7 % 11 - 5) / 10, f"e{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "x double, y double, id string")
    band = inference.linear_fit_band(df, "x", "y", ["id"], points=5, draws=100).orderBy("x").collect()
    assert len(band) == 5 and all(r.low < 2 * r.x + 0.2 and r.high > 2 * r.x - 0.2 and r.high - r.low < 0.3 for r in band)
    again = inference.linear_fit_band(df.repartition(7), "x", "y", ["id"], points=5, draws=100).orderBy("x").collect()
    assert [tuple(r) for r in again] == [pytest.approx(tuple(r)) for r in band]


def test_members_with_two_dates(spark):
    universe = spark.createDataFrame([("A", "2001-01-01"), ("A", "2000-01-01"), ("B", None), ("B", "2005-01-01")], "ticker string, d string").selectExpr("ticker", "cast(d AS date) AS date_added")
    events = spark.createDataFrame([("A", "2000-06-01"), ("A", "1999-06-01"), ("B", "1990-01-01"), ("C", "1990-01-01")], "ticker string, d string").selectExpr("ticker", "cast(d AS date) AS announcement_date")
    got = panel.with_membership(events, universe).orderBy("ticker", "announcement_date").collect()
    assert [r.member for r in got] == [False, True, True, True]


def test_sample_sizes_and_power():
    plain = stats.required_sample_size(0.5, 5.0)
    assert stats.required_sample_size(0.5, 5.0, icc=0.1, cluster_size=11) == pytest.approx(2 * plain)
    assert stats.required_sample_size(0.5, 5.0, variance_inflation=3.0, icc=0.1, cluster_size=11) == pytest.approx(3 * plain)
    for effect, se in ((0.5, math.inf), (math.nan, 1.0), (math.inf, 1.0), (0.5, 0.0), (0.5, math.nan)):
        assert math.isnan(stats.achieved_power(effect, se))
    assert stats.achieved_power(0.5, 0.1785) == pytest.approx(0.8, abs=0.01)


def test_costs_as_returns():
    m = portfolio.CostModel(CostAssumptions(0.5, 1, 10, -0.3, 252))
    assert m.impact_bps == 0 and m.turnover_cost(2.0) == pytest.approx(2 * 1.5 / 1e4)
    assert m.borrow_cost(-0.5) == m.borrow_cost(0.5) == pytest.approx(0.5 / 1e4)
