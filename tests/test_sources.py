"""Readers and sinks on files made here."""

import io
import json
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import fundamentals
from tidemark.sources import readers, sinks


def block(*rows):
    names = ("accessionNumber", "filingDate", "acceptanceDateTime", "form", "items")
    return {n: [r[i] for r in rows] for i, n in enumerate(names)}


def test_filing_pages(spark, tmp_path):
    d = tmp_path / "f"
    d.mkdir()
    hit = ("a1", "2020-01-15", "2020-01-15T21:30:00.000Z", "8-K", "2.02,9.01")
    old = ("a0", "2001-01-15", "2001-01-15T12:00:00.000Z", "8-K", "2.02")
    (d / "CIK0000000123.json").write_text(json.dumps({"filings": {"recent": block(hit, ("b", "2020-02-01", "2020-02-01T10:00:00.000Z", "10-Q", "")), "files": [{"name": "CIK0000000123-submissions-001.json"}]}}))
    (d / "CIK0000000123-submissions-001.json").write_text(json.dumps(block(old, hit)))
    (d / "CIK0000000456.json").write_text(json.dumps({"filings": {"recent": block(), "files": []}}))
    got = readers.filings(spark, str(d)).collect()
    assert sorted((r.cik, r.accession) for r in got) == [(123, "a0"), (123, "a1"), (123, "a1"), (123, "b")]
    u = spark.createDataFrame([("AAA", 123)], "ticker string, cik long")
    rows = readers.announcements(spark, str(d), u).orderBy("accession").collect()
    assert [(r.ticker, r.accession, r.accepted_utc) for r in rows] == [("AAA", "a0", datetime(2001, 1, 15, 12)), ("AAA", "a1", datetime(2020, 1, 15, 21, 30))]


def test_concept_files(spark, tmp_path):
    fact = lambda v, start="2020-01-01": {"start": start, "end": "2020-03-31", "val": v, "filed": "2020-05-01", "form": "10-Q", "fy": 2020, "fp": "Q1"}
    for name, facts in (("1_EarningsPerShareDiluted", [fact(0.9)]), ("1_EarningsPerShareBasic", [fact(1.0)]), ("2_EarningsPerShareDiluted", [fact(0.5, None)]), ("2_EarningsPerShareBasic", [fact(0.6)])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"units": {"USD/shares": facts}}))
    (tmp_path / "3_EarningsPerShareDiluted.json").write_text("null")
    got = readers.eps_facts(spark, str(tmp_path)).collect()
    assert sorted((r.cik, r.tag, r.val, r.days) for r in got) == [(1, "EarningsPerShareDiluted", 0.9, 90), (2, "EarningsPerShareBasic", 0.6, 90)]


def test_factor_zips(spark, tmp_path):
    def zipped(name, text):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.writestr("x.csv", text.encode("latin-1"))
        (tmp_path / name).write_bytes(buffer.getvalue())
        return str(tmp_path / name)

    three = zipped("a.zip", "Prose é, with commas\n,Mkt-RF,SMB,HML,RF\n20200102, 1.0, 2.0, -3.0, 0.01\n20200103,bad,1.0\n2020,1,2,3,4\n20200104\nCopyright 2020\n")
    mom = zipped("b.zip", "20200102, 5.0\n20200106, 1\n")
    got = {r.date: r for r in readers.factors(spark, three, mom).collect()}
    assert set(got) == {date(2020, 1, 2), date(2020, 1, 3)}
    a, b = got[date(2020, 1, 2)], got[date(2020, 1, 3)]
    assert (a.mkt_rf, a.smb, a.hml, a.mom, a.rf) == pytest.approx((0.01, 0.02, -0.03, 0.05, 0.0001))
    assert (b.mkt_rf, b.smb, b.hml, b.mom, b.rf) == (None, 0.01, None, None, None)


def test_universe(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,name,sector,cik,date_added\nA,Alpha,X,1,2001-02-03\nB,Beta,Y,2,unknown\nC,Gamma,Z,3,\n")
    assert [(r.ticker, r.cik, r.date_added) for r in readers.universe(spark, str(tmp_path / "u.csv")).orderBy("ticker").collect()] == [("A", 1, date(2001, 2, 3)), ("B", 2, None), ("C", 3, None)]
    (tmp_path / "v.csv").write_text("ticker,name\nA,Alpha\n")
    with pytest.raises(ValueError, match="missing columns"):
        readers.universe(spark, str(tmp_path / "v.csv"))


def test_prices(spark, tmp_path):
    wide = lambda rows: spark.createDataFrame(rows, "Date timestamp, AAA double, `B.C` double")
    nan = float("nan")
    close, open_ = wide([(datetime(2020, 1, 2, 5), 1.0, nan), (datetime(2020, 1, 3), 2.0, 3.0)]), wide([(datetime(2020, 1, 3), 1.5, 2.5), (datetime(2020, 1, 6), 9.0, 9.0)])
    long = readers.wide_prices(close, open_)
    assert sorted(map(tuple, long.collect()), key=str) == sorted([(date(2020, 1, 2), "AAA", None, 1.0), (date(2020, 1, 2), "B.C", None, None), (date(2020, 1, 3), "AAA", 1.5, 2.0), (date(2020, 1, 3), "B.C", 2.5, 3.0)], key=str)
    sinks.write_parquet(long, str(tmp_path / "p"), "test", "made here", "2020-01-03", rows=4)
    assert readers.prices(spark, str(tmp_path / "p")).count() == 4
    meta = json.loads((tmp_path / "p.meta.json").read_text())
    assert meta["rows"] == 4 and list(meta) == sorted(meta) and {"artifact", "command", "git_commit", "generated_utc", "data_source", "data_as_of"} <= set(meta)
    with pytest.raises(FileNotFoundError, match="land it"):
        readers.load(spark, str(tmp_path / "none"), "land it")


def test_consensus(spark):
    rows = [(1, "A", datetime(2020, 5, 1, 1), 1.0, 1.1, 10.0), (2, "A", datetime(2020, 4, 30, 21), 2.0, 2.1, 5.0), (3, "A", datetime(2020, 5, 1, 21), None, 1.0, None), (4, "B", datetime(2020, 5, 1, 21), 1.0, None, None)]
    df = spark.createDataFrame(rows, "row int, ticker string, announced_utc timestamp_ntz, eps_estimate double, eps_actual double, yahoo_surprise_pct double")
    assert [(r.ticker, r.announced_date, r.eps_estimate) for r in readers.consensus(df).collect()] == [("A", date(2020, 4, 30), 1.0)]


def test_nan_is_null(spark):
    df = schema.null_nans(spark.createDataFrame([(float("nan"), "x"), (1.0, "y")], "v double, s string"))
    assert df.where(F.col("v").isNull()).count() == 1 and fundamentals.SIGMA_FLOOR > 0


def test_stream(spark, tmp_path):
    from tidemark.streaming import live

    src = str(tmp_path / "in")
    rows = [("AAA", "n1", datetime(2020, 1, 15, 22)), ("AAA", "n1", datetime(2020, 1, 15, 22)), ("BBB", "n2", datetime(2020, 1, 16, 13))]
    spark.createDataFrame(rows, "ticker string, accession string, accepted_utc timestamp").write.parquet(src)
    cal = spark.createDataFrame([(i, date(2020, 1, 13 + i)) for i in range(5)], "session_pos int, session date")
    stream = spark.readStream.schema("ticker string, accession string, accepted_utc timestamp").parquet(src)
    for name, df, mode in (("placed", live.placed(stream, cal), "append"), ("mix", live.timing_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.accession, r.timing, r.reaction_pos) for r in spark.table("placed").collect()} == {("n1", "after_close", 3), ("n2", "before_open", 3)}
    assert {(r.timing, r.n) for r in spark.table("mix").collect()} == {("after_close", 2), ("before_open", 1)}
