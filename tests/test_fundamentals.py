from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import fundamentals as fd

FACTS = "cik long, start date, end date, val double, filed date, days int"


def quarter(i):
    month = 3 * (i % 4) + 3
    end = date(2010 + i // 4, month, {3: 31, 6: 30, 9: 30, 12: 31}[month])
    return date(end.year, end.month - 2, 1), end


@pytest.mark.parametrize(("v", "want"), [(5.0001, "Beat"), (5.0, "In-Line"), (0.0, "In-Line"), (-5.0, "In-Line"), (-5.0001, "Miss"), (None, "Unknown"), (float("nan"), "Unknown")])
def test_buckets(spark, v, want):
    assert spark.createDataFrame([(v,)], "v double").select(fd.categorize(F.col("v"), 5, -5)).first()[0] == want


@pytest.mark.parametrize(("a", "e", "want"), [(1.10, 1.0, 10), (-0.5, -1.0, 50), (-1.5, -1.0, -50), (0.2, 0.001, None), (0.02, 0.01, 100), (10.0, 0.05, 200), (None, 1.0, None)])
def test_percent_surprise(spark, a, e, want):
    got = spark.createDataFrame([(a, e)], "a double, e double").select(fd.percent_surprise(F.col("a"), F.col("e"))).first()[0]
    assert got is None if want is None else got == pytest.approx(want)


def eps(spark, values, skip=()):
    rows = [(t, quarter(i)[1], float(v), quarter(i)[1] + timedelta(30)) for t, vs in values.items() for i, v in enumerate(vs) if i not in skip]
    return spark.createDataFrame(rows, "ticker string, end date, val double, filed date")


def test_sue_needs_spread_and_history(spark):
    flat = fd.standardized_unexpected_earnings(eps(spark, {"A": [1.0] * 20})).collect()
    assert all(r.sue is None for r in flat)
    rising = fd.standardized_unexpected_earnings(eps(spark, {"A": [1 + 0.10 * (i // 4) for i in range(20)]})).orderBy("end").collect()
    assert rising[-1].drift == pytest.approx(0.10) and rising[-1].sue is None
    wavy = fd.standardized_unexpected_earnings(eps(spark, {"A": [i * i % 7 for i in range(24)], "B": [i * 3 % 5 for i in range(24)]})).collect()
    by = {(r.ticker, r.end): r for r in wavy}
    assert all((by[t, quarter(i)[1]].sue is None) == (i < 12) for t in "AB" for i in range(24))
    alone = fd.standardized_unexpected_earnings(eps(spark, {"A": [i * i % 7 for i in range(24)]})).collect()
    assert all(by["A", r.end].sue == r.sue for r in alone)
    assert by["A", quarter(20)[1]].history_known_by == quarter(19)[1] + timedelta(30)


def test_sue_gap_poisons_the_next_windows(spark):
    got = fd.standardized_unexpected_earnings(eps(spark, {"A": [i * i % 7 for i in range(24)]}, skip=(12,))).orderBy("end").collect()
    assert any(r.seasonal_diff is None for r in got[12:])
    with pytest.raises(ValueError, match="missing columns"):
        fd.standardized_unexpected_earnings(eps(spark, {"A": [1]}).drop("val"))


def test_first_reported(spark):
    s, e = quarter(0)
    df = spark.createDataFrame([(1, s, e, 0.8, date(2021, 1, 1), 90), (1, s, e, 1.0, date(2020, 1, 1), 90), (1, s, e, 9.0, date(2019, 1, 1), 365)], FACTS)
    assert [r.val for r in fd.first_reported(df, 80, 100).collect()] == [1.0]


def test_fourth_quarter(spark):
    quarters = [(1, *quarter(i), v, date(2011, 1, 1), 90) for i, v in enumerate((1.0, 1.2, 1.3))]
    year = (1, quarter(0)[0], quarter(3)[1], 5.0, date(2011, 2, 2), 364)
    fourth = lambda rows: [(round(r.val, 6), r.derived, r.filed) for r in fd.quarterly_eps(spark.createDataFrame(rows, FACTS)).where(F.col("end") == quarter(3)[1]).collect()]
    assert fourth([*quarters, year]) == [(1.5, True, date(2011, 2, 2))]
    assert fourth([*quarters, year, (1, *quarter(3), 1.55, date(2011, 2, 3), 92)]) == [(1.55, False, date(2011, 2, 3))]
    assert fourth([*quarters[:2], year]) == []
    assert fourth([*quarters, (2, *year[1:])]) == []


def test_filings(spark):
    rows = [(1, "a", "8-K", "2.02,9.01", date(2020, 1, 1)), (1, "b", "8-K", "5.02", date(2020, 1, 1)), (1, "c", "10-Q", "2.02", date(2020, 1, 1)), (1, "d", "8-K", None, date(2020, 1, 1)), (1, "a", "8-K", "2.02", date(2020, 1, 2)), (1, "e", "8-K/A", "2.02", date(2020, 1, 1))]
    df = spark.createDataFrame(rows, "cik long, accession string, form string, items string, filing_date date").withColumn("accepted_utc", F.col("filing_date").cast("timestamp_ntz"))
    assert [(r.accession, r.filing_date) for r in fd.earnings_announcements(df).collect()] == [("a", date(2020, 1, 1))]


def test_one_tag_a_company(spark):
    s, e = quarter(0)
    rows = [(1, "EarningsPerShareBasic", s, e, 1.0), (1, "EarningsPerShareDiluted", s, e, 0.9), (1, "EarningsPerShareDiluted", None, e, 0.7), (2, "EarningsPerShareDiluted", None, e, 0.5), (2, "EarningsPerShareBasic", s, e, 0.6)]
    got = fd.pick_eps_tag(spark.createDataFrame(rows, "cik long, tag string, start date, end date, val double")).collect()
    assert sorted((r.cik, r.val, r.days) for r in got) == [(1, 0.9, 89), (2, 0.6, 89)]


def test_symbols(spark):
    assert spark.createDataFrame([(" brk.b ",)], "s string").select(fd.market_symbol(F.col("s"))).first()[0] == "BRK-B"
