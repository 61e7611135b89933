import io
import json
import urllib.error
import zipfile
from datetime import date, datetime

import pytest

from tidemark.config import StudyConfig
from tidemark.plans import study
from tidemark.sources import clients, fetch, readers


class Net:
    """Answers by URL part; an int is an HTTP error."""

    def __init__(self, *answers):
        self.answers, self.asked, self.now, self.slept = list(answers), [], 0.0, []

    def get(self, url, agent):
        self.asked.append(url)
        a = self.answers.pop(0)
        if isinstance(a, int):
            raise urllib.error.HTTPError(url, a, "no", {}, None)
        return json.dumps(a).encode()

    def sleep(self, s):
        self.slept.append(s)
        self.now += s

    def client(self, folder):
        return fetch.CachedJson(str(folder), "test", self.get, lambda: self.now, self.sleep)


def test_cache_and_spacing(tmp_path):
    net = Net({"a": 1}, {"a": 2})
    c = net.client(tmp_path)
    assert c.json("u", "k.json") == {"a": 1} and c.json("u", "k.json") == {"a": 1} and len(net.asked) == 1
    assert c.json("u", "k.json", use_cache=False) == {"a": 2} and net.slept == pytest.approx([0.11])


def test_missing_is_asked_once(tmp_path):
    net = Net(404)
    c = net.client(tmp_path)
    assert c.json("u", "k.json") is None and c.json("u", "k.json") is None and (tmp_path / "k.json").read_text() == "null"


def test_retries(tmp_path):
    assert Net(503, 429, [1]).client(tmp_path).json("u", "a.json") == [1]
    with pytest.raises(urllib.error.HTTPError):
        Net(500, 500, 500).client(tmp_path).json("u", "b.json")
    with pytest.raises(urllib.error.HTTPError):
        Net(400).client(tmp_path).json("u", "c.json")


def test_company_lands_where_readers_look(spark, tmp_path):
    block = {"accessionNumber": ["x"], "filingDate": ["2020-01-02"], "acceptanceDateTime": ["2020-01-02T21:00:00.000Z"], "form": ["8-K"], "items": ["2.02"]}
    old = {k: [v[0].replace("x", "y")] for k, v in block.items()}
    facts = {"units": {"USD/shares": [{"start": "2020-01-01", "end": "2020-03-31", "val": 1.0, "filed": "2020-05-01"}]}}
    net = Net({"filings": {"recent": block, "files": [{"name": "CIK0000000007-submissions-001.json"}]}}, old, 404, facts)
    fetch.land_company(net.client(tmp_path), 7)
    assert sorted(r.accession for r in readers.filings(spark, f"{tmp_path}/filings").collect()) == ["x", "y"]
    assert [(r.cik, r.tag) for r in readers.eps_facts(spark, f"{tmp_path}/concepts").collect()] == [(7, "EarningsPerShareBasic")]


def test_universe_page(spark, tmp_path):
    html = "<p>x</p><table><tr><th>Symbol</th><th>Security</th><th>GICS Sector</th><th>CIK</th><th>Date added</th></tr><tr><td> brk.b</td><td>B</td><td>F</td><td>0000001</td><td>2010-02-16</td></tr><tr><td>AAA</td><td>A</td><td>T</td><td>2</td><td>1999 (x)</td></tr></table><table><tr><td>no</td></tr></table>"
    assert fetch.land_universe(html, str(tmp_path / "u.csv")) == 2
    assert [(r.ticker, r.cik, r.date_added) for r in readers.universe(spark, str(tmp_path / "u.csv")).collect()] == [("AAA", 2, None), ("BRK-B", 1, date(2010, 2, 16))]
    with pytest.raises(ValueError):
        fetch.land_universe("<table><tr><th>Symbol</th></tr></table>", str(tmp_path / "v.csv"))


def test_prices_consensus_and_sample(spark, tmp_path):
    batches = []

    def prices(tickers):
        batches.append(list(tickers))
        return [(date(2020, 1, 2), t, float("nan"), 1.0) for t in tickers]

    panel = fetch.land_prices(spark, [f"T{i}" for i in range(5)], prices, str(tmp_path / "p"), 2)
    assert [len(b) for b in batches] == [2, 2, 1] and panel.where("open is null").count() == 5
    quotes = fetch.land_consensus(spark, ["T1", "T2"], lambda t: [(datetime(2020, 1, 2, 22), 1.0, 1.1, 10.0), (datetime(2020, 4, 2, 22), 1.0, None, None)], str(tmp_path / "c"))
    assert quotes.count() == 2
    factors = spark.createDataFrame([(date(2019, 1, 1), 0.0), (date(2020, 1, 1), 0.0)], "date date, rf double")
    counts = fetch.build_sample({"prices": panel, "factors": factors}, spark.createDataFrame([("T1",), ("T1",)], "ticker string"), "2020-01-01", str(tmp_path / "s"))
    assert counts == {"prices": 1, "factors": 1}


def zipped(text):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.csv", text)
    return out.getvalue()


def test_everything_lands_and_loads(spark, tmp_path):
    """From nothing to the inputs of a study: two members, one without facts, and a benchmark."""
    folder = tmp_path / "data"
    folder.mkdir()
    html = "<table><tr><th>Symbol</th><th>Security</th><th>GICS Sector</th><th>CIK</th><th>Date added</th></tr><tr><td>AAA</td><td>A</td><td>F</td><td>7</td><td>2010-02-16</td></tr><tr><td>BBB</td><td>B</td><td>F</td><td>8</td><td></td></tr></table>"
    fetch.land_universe(html, str(folder / "universe.csv"))
    block = {"accessionNumber": ["x"], "filingDate": ["2020-05-01"], "acceptanceDateTime": ["2020-05-01T21:00:00.000Z"], "form": ["8-K"], "items": ["2.02"]}
    facts = {"units": {"USD/shares": [{"start": "2020-01-01", "end": "2020-03-31", "val": 1.0, "filed": "2020-05-01", "form": "10-Q", "fy": 2020, "fp": "Q1"}]}}

    def get(url, agent):
        if "0000000008" in url or "Basic" in url:
            raise urllib.error.HTTPError(url, 404, "no", {}, None)
        return json.dumps({"filings": {"recent": block, "files": []}} if "submissions" in url else facts).encode()

    client = fetch.CachedJson(str(folder / "json"), "test", get, lambda: 0.0, lambda s: None)
    files = {clients.THREE_FACTORS: "prose\n20200102,1.0,0.5,-0.5,0.01\n", clients.MOMENTUM: "20200102,0.25\n"}
    prices = lambda tickers: [(date(2020, 1, 2), t, 1.0, 2.0) for t in tickers]
    members = readers.universe(spark, fetch.universe_path(str(folder), "elsewhere.csv"))
    run = lambda p: fetch.fetch_all(spark, str(folder), members, StudyConfig(), client, p, lambda name: zipped(files[name]), "test")
    assert run(prices) == run(prices) == {"announcements": 1, "quarterly_eps": 1, "factors": 1, "prices": 3}
    assert (folder / "prices.meta.json").exists() and (folder / "factors.meta.json").exists()
    got = study.load_inputs(spark, str(folder))
    assert got.consensus is None and [r.ticker for r in got.announcements.collect()] == ["AAA"] and got.universe.count() == 2
    assert got.factors.first().mom == pytest.approx(0.0025) and got.eps.first().val == 1.0
    with pytest.raises(RuntimeError, match="no prices"):
        run(lambda tickers: [])
    (folder / "universe.csv").unlink()
    fetch.land_universe(html.replace("BBB", "CCC"), str(tmp_path / "pinned.csv"))
    assert fetch.universe_path(str(folder), "pinned") == "pinned"
    assert sorted(r.ticker for r in study.load_inputs(spark, str(folder), str(tmp_path / "pinned.csv")).universe.collect()) == ["AAA", "CCC"]
    with pytest.raises(FileNotFoundError, match="fetch"):
        study.load_inputs(spark, str(tmp_path / "nothing"))


def test_a_missing_vendor_is_named():
    with pytest.raises(RuntimeError, match="yfinance"):
        list(clients.prices("2020-01-01", "2020-02-01")(["AAA"]))
