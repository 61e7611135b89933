"""Calendar, timing, as-of joins and guards on tiny inputs with results worked out by hand."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import panel, temporal

SESSIONS = [d for d in (date(2020, 1, 2) + timedelta(n) for n in range(90)) if d.weekday() < 5][:60]


@pytest.fixture(scope="module")
def cal(spark):
    return spark.createDataFrame([(i, d) for i, d in enumerate(SESSIONS)], "session_pos int, session date").cache()


def utc(text):
    """New York wall clock as UTC; January to early March 2020 is five hours behind."""
    return datetime.fromisoformat(text) + timedelta(hours=4 if "2020-03-08" < text < "2020-11-01" else 5)


def announced(spark, *rows):
    return spark.createDataFrame([(i, "AAA", utc(t)) for i, t in enumerate(rows)], "id int, ticker string, accepted_utc timestamp_ntz")


@pytest.mark.parametrize(("clock", "label"), [("06:00", "before_open"), ("09:29", "before_open"), ("09:30", "intraday"), ("12:00", "intraday"), ("16:00", "intraday"), ("16:00:00.000001", "after_close"), ("16:01", "after_close"), ("20:30", "after_close")])
def test_timing_edges(spark, clock, label):
    assert announced(spark, f"2020-02-03 {clock}").select(temporal.timing_label(F.col("accepted_utc"))).first()[0] == label


def test_summer_time(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 15, 21, 30),), (datetime(2020, 7, 15, 20, 30),)], "t timestamp_ntz")
    assert {r[0] for r in df.select(temporal.timing_label(F.col("t"))).collect()} == {"after_close"}


def test_reaction_sessions(spark, cal):
    rows = announced(spark, f"{SESSIONS[10]} 07:00", f"{SESSIONS[10]} 17:00", "2020-01-10 17:00", "2020-01-11 08:00", "2020-01-11 12:00", "2020-01-15 10:00", "2019-12-01 12:00", "2030-01-01 12:00")
    got = {r.id: r for r in temporal.reaction_and_entry(rows, cal).collect()}
    monday = SESSIONS.index(date(2020, 1, 13))
    assert [got[i].reaction_pos for i in range(4)] == [10, 11, monday, monday]
    assert (got[4].reaction_pos, got[4].entry_pos_open) == (monday, monday + 1)
    at = SESSIONS.index(date(2020, 1, 15))
    assert (got[5].reaction_pos, got[5].entry_pos_close, got[5].entry_pos_open) == (at, at, at + 1)
    assert got[6].reaction_pos == 0 and got[7].reaction_pos == 60


def test_fills_never_precede_announcements(spark, cal):
    rows = temporal.reaction_and_entry(announced(spark, "2020-01-15 10:00", "2020-01-15 17:00", "2020-01-10 16:00", "2020-03-09 12:00"), cal)
    for timing in (temporal.NEXT_OPEN, temporal.NEXT_CLOSE):
        fills = rows.withColumn("session_pos", F.col(temporal.entry_column(timing))).join(cal, "session_pos")
        if timing == temporal.NEXT_OPEN:
            temporal.assert_no_lookahead(fills, "accepted_utc", "session", timing)
        early = rows.withColumn("session_pos", F.col(temporal.entry_column(timing)) - 1).join(cal, "session_pos")
        with pytest.raises(AssertionError, match="4 fills"):
            temporal.assert_no_lookahead(early, "accepted_utc", "session", timing)
    with pytest.raises(ValueError):
        temporal.entry_column("whenever")


EPS = "ticker string, end date, val double"


def test_forward_match(spark):
    ann = lambda *days: spark.createDataFrame([("AAA", f"n{i}", utc(f"{d} 16:30")) for i, d in enumerate(days)], "ticker string, accession string, accepted_utc timestamp_ntz")
    two = spark.createDataFrame([("AAA", date(2020, 3, 31), 1.0), ("AAA", date(2020, 6, 30), 2.0)], EPS)
    got = panel.match_announcements(two, ann("2020-04-28", "2020-07-28")).orderBy("end").collect()
    assert [(r.end, r.accession) for r in got] == [(date(2020, 3, 31), "n0"), (date(2020, 6, 30), "n1")]
    assert panel.match_announcements(two.limit(1), ann("2020-03-15")).count() == 0
    assert panel.match_announcements(two.limit(1), ann("2020-07-29")).count() == 0
    assert [r.end for r in panel.match_announcements(two, ann("2020-07-05")).collect()] == [date(2020, 6, 30)]


def test_nearest_quote(spark):
    left = spark.createDataFrame([(f"e{i}", t, date(2020, 5, 10)) for i, t in enumerate("ABCDEF")], "id string, ticker string, day date")
    quote = [("A", -2, 1.0), ("B", 0, 2.0), ("C", 2, 3.0), ("D", 19, 4.0), ("F", -1, 5.0), ("F", 1, 6.0), ("F", -1, 7.0)]
    right = spark.createDataFrame([(t, date(2020, 5, 10) + timedelta(d), v) for t, d, v in quote], "ticker string, on date, v double")
    got = {r.ticker: r.v for r in temporal.asof_nearest(left, right, "ticker", "day", "on", ["v"], 2, ["id"], ["v"]).collect()}
    assert got == {"A": 1.0, "B": 2.0, "C": 3.0, "D": None, "E": None, "F": 7.0}


def test_plausible_earnings(spark, cal):
    rows = [(d, t, float(p), float(p)) for d in SESSIONS for t, p in (("AAA", 50), ("BIG", 7000), ("ZERO", 0))]
    grid = panel.dense_grid(spark.createDataFrame(rows, "session date, ticker string, open double, close double"))
    day = SESSIONS[5]
    cases = [("AAA", 1.25, True), ("AAA", 1.2e8, False), ("AAA", 7000.0, False), ("AAA", -1.0, True), ("BIG", 120.0, True), ("ZZZ", 9.0, True), ("ZERO", 0.0, True), ("ZERO", 0.1, False)]
    df = spark.createDataFrame([(t, day, v, ok) for t, v, ok in cases] + [("AAA", date(2019, 1, 1), 13.0, False)], "ticker string, end date, val double, want boolean")
    got = panel.plausible_eps(df, grid).collect()
    assert all(r.plausible == r.want for r in got) and len(got) == 9


def test_membership(spark):
    universe = spark.createDataFrame([("OLD", date(1990, 1, 1)), ("NEW", date(2021, 6, 1)), ("ANY", None)], "ticker string, date_added date")
    events = spark.createDataFrame([(t, date(2015, 1, 1)) for t in ("OLD", "NEW", "ANY", "GONE")], "ticker string, announcement_date date")
    assert {r.ticker: r.member for r in panel.with_membership(events, universe).collect()} == {"OLD": True, "NEW": False, "ANY": True, "GONE": True}
    assert {r.ticker for r in panel.members_on(universe, "2015-01-01").collect()} == {"OLD", "ANY"}


def test_point_in_time_is_strict(spark):
    df = spark.createDataFrame([(date(2020, 2, 2), utc("2020-02-03 21:00")), (date(2020, 2, 3), utc("2020-02-03 21:00")), (None, utc("2020-02-03 21:00"))], "k date, t timestamp_ntz")
    assert [r[0] for r in df.select(panel.point_in_time(F.col("k"), F.col("t"))).collect()] == [True, False, False]
