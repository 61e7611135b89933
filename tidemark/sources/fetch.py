"""Landing: what has to be fetched is stored as files first, and the engine scans the files.

A cached JSON file is a landed file: :mod:`tidemark.sources.readers` reads the cache folders as they are. Network
access is a callable, so tests and other clients can replace it."""

from __future__ import annotations

import csv
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable, Sequence
from html.parser import HTMLParser
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schema
from tidemark.config import StudyConfig
from tidemark.operators import temporal

#: Fixed values of the public filing service.
SUBMISSIONS = "https://data.sec.gov/submissions/{name}"
CONCEPT = "https://data.sec.gov/api/xbrl/companyconcept/CIK{cik:010d}/us-gaap/{tag}.json"
EPS_TAGS = ("EarningsPerShareDiluted", "EarningsPerShareBasic")
SPACING_SECONDS = 0.11
ATTEMPTS = 3
RETRIED = frozenset({403, 429, *range(500, 600)})


def http_get(url: str, user_agent: str) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": user_agent}), timeout=30) as r:
        return r.read()


class CachedJson:
    """JSON by URL, from a folder or else the network: spaced out, tried again where that can help. What does not exist
    (404) is stored as ``null``, so it is asked for once."""

    def __init__(self, folder: str, user_agent: str, get: Callable[[str, str], bytes] = http_get, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.folder, self.user_agent, self.get, self.clock, self.sleep = Path(folder), user_agent, get, clock, sleep
        self.last = float("-inf")

    def _wait(self) -> None:
        early = self.last + SPACING_SECONDS - self.clock()
        if early > 0:
            self.sleep(early)
        self.last = self.clock()

    def json(self, url: str, key: str, use_cache: bool = True) -> object:
        path = self.folder / key
        if use_cache and path.exists():
            return json.loads(path.read_text())
        for attempt in range(1, ATTEMPTS + 1):
            self._wait()
            try:
                found = json.loads(self.get(url, self.user_agent))
                break
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    found = None
                    break
                if e.code not in RETRIED or attempt == ATTEMPTS:
                    raise
                self.sleep(2.0**attempt)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(".part")
        part.write_text(json.dumps(found))
        part.replace(path)
        return found


def land_company(client: CachedJson, cik: int, tags: Sequence[str] = EPS_TAGS) -> None:
    """The filing index with all its pages under ``filings``, and the EPS concepts under ``concepts``."""
    name = f"CIK{cik:010d}.json"
    index = client.json(SUBMISSIONS.format(name=name), f"filings/{name}")
    for page in ((index or {}).get("filings") or {}).get("files") or []:
        client.json(SUBMISSIONS.format(name=page["name"]), f"filings/{page['name']}")
    for tag in tags:
        client.json(CONCEPT.format(cik=cik, tag=tag), f"concepts/{cik}_{tag}.json")


class _Table(HTMLParser):
    """The cells of the first table of a page."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[str]] = []
        self.depth = self.tables = 0
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.depth, self.tables = self.depth + 1, self.tables + 1
        elif self.tables == 1 and self.depth == 1 and tag == "tr":
            self.rows.append([])
        elif self.tables == 1 and self.depth == 1 and tag in ("td", "th"):
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif tag in ("td", "th") and self.cell is not None:
            self.rows[-1].append("".join(self.cell).strip())
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def land_universe(html: str, path: str) -> int:
    """Constituents of an index page as the CSV that ``readers.universe`` reads, by ticker; returns their number."""
    table = _Table()
    table.feed(html)
    head, *rows = [r for r in table.rows if r]
    named = {"Symbol": "ticker", "Security": "name", "GICS Sector": "sector", "CIK": "cik", "Date added": "date_added"}
    if missing := sorted(set(named) - set(head)):
        raise ValueError(f"constituents: missing columns: {missing}")
    out = [{named[h]: v for h, v in zip(head, r, strict=False) if h in named} for r in rows]
    for r in out:
        r["ticker"] = r["ticker"].strip().upper().replace(".", "-")
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, list(named.values()))
        w.writeheader()
        w.writerows(sorted(out, key=lambda r: r["ticker"]))
    return len(out)


def land_prices(spark: SparkSession, tickers: Sequence[str], fetch: Callable[[Sequence[str]], Iterable[tuple]], path: str, batch_size: int = 100) -> DataFrame:
    """``fetch`` gives (session, ticker, open, close) rows of a batch of tickers; each batch is appended to the panel."""
    for lo in range(0, len(tickers), batch_size):
        rows = list(fetch(tickers[lo : lo + batch_size]))
        spark.createDataFrame(rows, schema.PRICES).write.mode("append").option("compression", "zstd").parquet(path)
    return schema.null_nans(spark.read.parquet(path))


def land_consensus(spark: SparkSession, tickers: Iterable[str], fetch: Callable[[str], Iterable[tuple]], path: str) -> DataFrame:
    """``fetch`` gives (announced_utc, estimate, actual, surprise) rows of a ticker; unreported quarters drop out."""
    rows = [(n, t, *r) for t in tickers for n, r in enumerate(fetch(t))]
    raw = spark.createDataFrame(rows, "row int, ticker string, announced_utc timestamp_ntz, eps_estimate double, eps_actual double, yahoo_surprise_pct double")
    from tidemark.sources.readers import consensus

    consensus(schema.null_nans(raw)).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def universe_path(folder: str, default: str | None = None) -> str:
    """``universe.csv`` of the folder, if it has one; else the default."""
    own = Path(folder) / "universe.csv"
    if own.exists() or default is None:
        return str(own)
    return default


def fetch_all(spark: SparkSession, folder: str, members: DataFrame, cfg: StudyConfig, client: CachedJson, prices: Callable[[Sequence[str]], Iterable[tuple]], factor_file: Callable[[str], bytes], command: str) -> dict[str, int]:
    """Lands everything that a study reads, as tables of ``folder`` with sidecars; returns the rows of each.

    The downloads are a loop over the members, spaced out as the services ask; what they bring is parsed by Spark."""
    from tidemark.operators.fundamentals import quarterly_eps
    from tidemark.sources import clients, readers, sinks

    known = members.select("ticker", "cik").where("cik IS NOT NULL").collect()  # an index's members
    for r in known:
        land_company(client, r["cik"])
    announced = readers.announcements(spark, f"{client.folder}/filings", members)
    eps = quarterly_eps(readers.eps_facts(spark, f"{client.folder}/concepts")).join(members.select("ticker", "cik"), "cik").select(*(f.split()[0] for f in schema.QUARTERLY_EPS.split(", ")))
    spark.createDataFrame([], schema.PRICES).write.mode("overwrite").parquet(f"{folder}/prices")  # batches are appended to it
    land_prices(spark, sorted({*(r["ticker"] for r in known), cfg.benchmark}), prices, f"{folder}/prices")
    if spark.read.parquet(f"{folder}/prices").isEmpty():
        raise RuntimeError("no prices came back; are the network and the tickers right?")
    for name in (clients.THREE_FACTORS, clients.MOMENTUM):
        path = Path(folder) / "factor_files" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(factor_file(name))
    factors = readers.factors(spark, *(f"{folder}/factor_files/{n}" for n in (clients.THREE_FACTORS, clients.MOMENTUM)))
    written = {"announcements": (announced, SUBMISSIONS), "quarterly_eps": (eps, CONCEPT), "factors": (factors, clients.FACTORS)}
    for name, (table, source) in written.items():
        sinks.write_parquet(table, f"{folder}/{name}", command, source, cfg.end_date)
    sinks.write_provenance(spark, f"{folder}/prices", command, "daily adjusted prices", cfg.end_date)
    return {name: spark.read.parquet(f"{folder}/{name}").count() for name in (*written, "prices")}


def build_sample(inputs: dict[str, DataFrame], tickers: DataFrame, start: str, folder: str) -> dict[str, int]:
    """Every input cut to the tickers (factors to the days from ``start`` on), as Parquet; returns the rows of each."""
    names = tickers.select("ticker").distinct()
    counts = {}
    for name, df in inputs.items():
        small = df.where(F.col("date") >= F.lit(start).cast("date")) if "ticker" not in df.columns else df.join(names, "ticker", "left_semi")
        small.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{folder}/{name}").count()
    return counts


def timing_mix(announcements: DataFrame) -> DataFrame:
    return announcements.groupBy(temporal.timing_label(F.col("accepted_utc")).alias("timing")).agg(F.count(F.lit(1)).alias("n"))
