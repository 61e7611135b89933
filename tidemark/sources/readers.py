"""Readers: landed filing JSON, factor zips, price panels, universe and consensus files.

Fetching is not the engine's work: files are landed first (a folder that Spark can read), then scanned.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.operators import fundamentals, temporal

_BLOCK = "struct<accessionNumber: array<string>, filingDate: array<string>, acceptanceDateTime: array<string>, form: array<string>, items: array<string>>"
_FACT = "struct<start: string, end: string, val: double, filed: string, form: string, fy: int, fp: string>"


def universe(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header. Dates that do not parse are null: such members have always been members."""
    raw = spark.read.option("header", True).csv(path)
    schema.require_columns(raw, ("ticker", "name", "sector", "cik", "date_added"), "universe")
    return raw.select("ticker", "name", "sector", F.col("cik").try_cast("long").alias("cik"), F.to_date(F.try_to_timestamp("date_added", F.lit("yyyy-MM-dd"))).alias("date_added"))


def filings(spark: SparkSession, path: str) -> DataFrame:
    """cik, accession, filing_date, accepted_utc, form, items of landed filing indexes, one JSON document a file.

    A document is a company's index, with its latest filings in ``filings.recent``, or a page of older ones, which is that
    block alone; blocks are objects of parallel arrays. The company number comes from the file name."""
    text = spark.read.option("wholetext", True).text(path).select("value", F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long").alias("cik"))
    recent = F.from_json("value", f"struct<filings: struct<recent: {_BLOCK}>>")["filings"]["recent"]
    block = F.coalesce(F.when(recent["accessionNumber"].isNotNull(), recent), F.from_json("value", _BLOCK))
    rows = text.select("cik", block.alias("b")).where(F.size("b.accessionNumber") > 0)
    zipped = rows.select("cik", F.inline(F.arrays_zip("b.accessionNumber", "b.filingDate", "b.acceptanceDateTime", "b.form", "b.items")))
    return zipped.select("cik", F.col("accessionNumber").alias("accession"), F.to_date("filingDate").alias("filing_date"), F.try_to_timestamp("acceptanceDateTime").cast("timestamp_ntz").alias("accepted_utc"), "form", "items")


def announcements(spark: SparkSession, path: str, universe_: DataFrame) -> DataFrame:
    """Earnings announcements of the universe's companies, with their tickers."""
    found = fundamentals.earnings_announcements(filings(spark, path))
    return found.join(universe_.select("cik", "ticker"), "cik").select("ticker", "cik", "accession", "filing_date", "accepted_utc")


def eps_facts(spark: SparkSession, path: str) -> DataFrame:
    """EPS facts of landed concept files (``<cik>_<tag>.json``), with ``units["USD/shares"]``; the first usable tag a company."""
    text = spark.read.option("wholetext", True).text(path).withColumn("_name", F.col("_metadata.file_name"))
    facts = F.from_json("value", f"struct<units: map<string, array<{_FACT}>>>")["units"]["USD/shares"]
    rows = text.select(F.regexp_extract("_name", r"(\d+)", 1).cast("long").alias("cik"), F.regexp_extract("_name", r"_(\w+)\.json$", 1).alias("tag"), F.inline(facts))
    dated = rows.select("cik", "tag", F.to_date("start").alias("start"), F.to_date("end").alias("end"), "val", F.to_date("filed").alias("filed"), "form", "fy", "fp")
    return fundamentals.pick_eps_tag(schema.null_nans(dated))


def prices(spark: SparkSession, path: str) -> DataFrame:
    """A long price panel (session, ticker, open, close) in Parquet; times are dropped from sessions, NaN is null."""
    raw = schema.require_columns(spark.read.parquet(path), ("session", "ticker", "open", "close"), "prices")
    return schema.null_nans(raw.select(F.to_date("session").alias("session"), "ticker", F.col("open").cast("double"), F.col("close").cast("double")))


def wide_prices(close: DataFrame, open_: DataFrame, date: str = "Date") -> DataFrame:
    """Long from two wide frames (a column a ticker). Opens follow the rows and tickers of the closes."""

    def long(df: DataFrame, name: str) -> DataFrame:
        tickers = [c for c in df.columns if c != date]
        return df.select(F.to_date(date).alias("session"), *(F.col(f"`{t}`").cast("double").alias(t) for t in tickers)).unpivot("session", [F.col(f"`{t}`") for t in tickers], "ticker", name)

    return schema.null_nans(long(close, "close").join(long(open_, "open"), ["session", "ticker"], "left").select("session", "ticker", "open", "close"))


def factor_zip_lines(spark: SparkSession, path: str) -> DataFrame:
    """line: the text lines of zipped CSV files; a file is a few megabytes at most and is unzipped by one task."""

    def unzip(rows: Iterable) -> Iterable:
        import pyarrow as pa

        for batch in rows:
            for content in batch.column(0):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        yield pa.RecordBatch.from_pydict({"line": z.read(name).decode("latin-1").splitlines()})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unzip, "line string")


def factor_lines(lines: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """date and ``columns``, as decimals: of lines whose first field is eight digits and that have a second; prose and
    footers drop out, short rows end in nulls, and what is no number is null."""
    cells = F.transform(F.split("line", ","), lambda x: F.trim(x))
    rows = lines.select(cells.alias("c")).where(F.col("c")[0].rlike("^[0-9]{8}$") & (F.size("c") >= 2))
    return rows.select(F.to_date(F.col("c")[0], "yyyyMMdd").alias("date"), *((F.get("c", F.lit(i)).try_cast("double") / 100).alias(n) for i, n in enumerate(columns, 1)))


def factors(spark: SparkSession, three_factor_zip: str, momentum_zip: str) -> DataFrame:
    """Three factors and the bill rate, left joined with momentum."""
    three = factor_lines(factor_zip_lines(spark, three_factor_zip), ("mkt_rf", "smb", "hml", "rf"))
    mom = factor_lines(factor_zip_lines(spark, momentum_zip), ("mom",))
    return schema.null_nans(three.join(mom, "date", "left").select("date", "mkt_rf", "smb", "hml", "mom", "rf"))


def consensus(quotes: DataFrame) -> DataFrame:
    """Of quotes (ticker, announced_utc, eps_estimate, eps_actual, yahoo_surprise_pct, in order ``row``) those with an
    estimate and a report, by New York date; of a ticker's several on a day, the first."""
    known = quotes.where(F.col("eps_estimate").isNotNull() & F.col("eps_actual").isNotNull()).withColumn("announced_date", temporal.eastern_date(F.col("announced_utc")))
    first = Window.partitionBy("ticker", "announced_date").orderBy("row")
    return known.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("ticker", "announced_date", "eps_estimate", "eps_actual", "yahoo_surprise_pct")


def load(spark: SparkSession, path: str, command: str) -> DataFrame:
    """A Parquet table that an earlier command wrote; if it is not there, the error names the command."""
    try:
        return spark.read.parquet(path)
    except Exception as e:  # Spark's own error type differs between classic and connect
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path} does not exist; run `{command}` first") from e
        raise
