"""Event-study inputs made from the star schema: brands are companies, ship quarters are fiscal quarters.

Unit prices range over two decades, so a price is 100 plus twice their logarithm: returns of a few percent.
The definitions are SQL with a few functions that Spark and DuckDB spell differently, so that both engines start from
the same rows; what is done with them is written twice, as DataFrame operators and as SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import panel
from tidemark.session import checkpointed

BENCHMARK = "ALL"

#: name -> (tables it reads, SQL). {wd(x)}: 0 for Monday; {minutes(n)}: an interval; {ntz}: a timestamp without zone.
DEFINITIONS = {
    "sales": """SELECT p_brand AS ticker, cast(substr(p_brand, 7) AS bigint) AS cik, cast(l_shipdate AS date) AS day, year(l_shipdate) AS y, quarter(l_shipdate) AS q,
        l_extendedprice * (1 - l_discount) AS rev, l_extendedprice / l_quantity AS px, l_orderkey * 10 + l_linenumber AS okey FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "fundamentals": """SELECT ticker, cik, k, make_date(y, q * 3 - 2, 1) AS start, last_day(make_date(y, q * 3, 1)) AS period_end, val,
        last_day(make_date(y, q * 3, 1)) + cast(20 + (cik * 5 + k * 11) % 90 AS int) AS filed
        FROM (SELECT ticker, cik, y, q, y * 4 + q AS k, round(avg(rev) / 20000, 3) AS val FROM {sales} GROUP BY ticker, cik, y, q) f""",
    "announcements": """SELECT ticker, cik, k, concat(ticker, '-', cast(k AS {string})) AS accession, cast(period_end + cast(5 + (k * 7 + cik) % 40 AS int) AS date) AS filing_date,
        cast(period_end + cast(5 + (k * 7 + cik) % 40 AS int) AS {ntz}) + {minutes((cik * 131 + k * 977) % 1440)} AS accepted_utc FROM {fundamentals} WHERE (cik * 13 + k * 7) % 20 <> 0""",
    "prices": """SELECT day AS session, ticker, round(100 + 2 * ln(min_by(px, okey)), 4) AS open, round(100 + 2 * ln(avg(px)), 4) AS close FROM {sales} WHERE {wd(day)} < 5 GROUP BY day, ticker""",
    "universe": """SELECT DISTINCT ticker, cik, CASE WHEN cik % 5 <> 0 THEN date '1995-01-01' + cast((cik * 53) % 1800 AS int) END AS date_added FROM {sales}""",
    "consensus": """SELECT a.ticker, a.filing_date + cast(a.k % 5 - 2 AS int) AS announced_date, round(f.val * (1 + ((a.k * 3 + a.cik) % 21 - 10) / 100.0), 5) AS eps_estimate, f.val AS eps_actual
        FROM {announcements} a JOIN {fundamentals} f ON a.ticker = f.ticker AND a.k = f.k WHERE (a.cik + a.k) % 9 <> 0""",
    "facts": """SELECT cik, start, period_end, val, filed, {days(start, period_end)} AS days FROM {fundamentals} WHERE NOT (month(period_end) = 12 AND cik % 2 = 1)
        UNION ALL SELECT cik, start, period_end, round(val * 0.9, 4), filed + cast(365 AS int), {days(start, period_end)} FROM {fundamentals} WHERE (cik + k) % 3 = 0
        UNION ALL SELECT cik, min(start), max(period_end), round(sum(val) + 0.25, 4), max(filed) + cast(9 AS int), {days(min(start), max(period_end))} FROM {fundamentals} GROUP BY cik, year(period_end) HAVING count(*) = 4""",
    "factors": """SELECT date, round((p1 / lag(p1) OVER (ORDER BY date) - 1) / 50, 6) AS mkt_rf, round((p2 / lag(p2) OVER (ORDER BY date) - 1) / 50, 6) AS smb, round((p3 / lag(p3) OVER (ORDER BY date) - 1) / 50, 6) AS hml,
        round((p4 / lag(p4) OVER (ORDER BY date) - 1) / 50, 6) AS mom, round(p5 / 1e10, 8) AS rf FROM (SELECT cast(o_orderdate AS date) AS date, avg(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END) AS p1,
        avg(CASE WHEN o_orderpriority LIKE '2%' THEN o_totalprice END) AS p2, avg(CASE WHEN o_orderpriority LIKE '3%' THEN o_totalprice END) AS p3, avg(CASE WHEN o_orderpriority LIKE '4%' THEN o_totalprice END) AS p4,
        avg(CASE WHEN o_orderpriority LIKE '5%' THEN o_totalprice END) AS p5 FROM {orders} GROUP BY cast(o_orderdate AS date)) d""",
}
ORDER = tuple(DEFINITIONS)

_SPARK = {"string": "string", "ntz": "timestamp_ntz", "wd": "weekday({})", "minutes": "make_dt_interval(0, 0, cast({} AS int), 0)", "days": "datediff({1}, {0})"}
_DUCK = {"string": "varchar", "ntz": "timestamp", "wd": "(isodow({}) - 1)", "minutes": "to_minutes({})", "days": "cast({1} - {0} AS int)"}


def render(sql: str, dialect: dict[str, str], tables: dict[str, str]) -> str:
    """Fill {name} and {name(args)}; nested parentheses in arguments are fine."""
    out, i = [], 0
    while (j := sql.find("{", i)) >= 0:
        end = sql.index("}", j)
        name, _, rest = sql[j + 1 : end].partition("(")
        out.append(sql[i:j])
        if rest:
            args, depth, start = [], 0, 0
            body = rest[:-1]
            for p, c in enumerate(body + ","):
                depth += (c == "(") - (c == ")")
                if c == "," and depth == 0:
                    args.append(body[start:p].strip())
                    start = p + 1
            out.append(dialect[name].format(*args))
        else:
            out.append(dialect.get(name) or tables[name])
        i = end + 1
    return "".join(out) + sql[i:]


def duckdb_ctes() -> str:
    """The adapters as common table expressions over the driver's views, with the filled grid that the operators build."""
    names = {n: n for n in (*DEFINITIONS, "lineitem", "part", "orders")}
    ctes = [f"{n} AS ({render(s, _DUCK, names)})" for n, s in DEFINITIONS.items()]
    return "WITH " + ",\n".join(ctes)


class Fixtures:
    """The inputs as DataFrames, over one folder of tables; each is planned when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A frame that operators join again and again: computed when first asked for, then read back."""
        if name not in self._kept:
            self._kept[name] = checkpointed(make())
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _defined(self, name: str) -> DataFrame:
        import re

        used = {n: (getattr(self, n) if n in DEFINITIONS else self.table(n)) for n in set(re.findall(r"\{(\w+)\}", DEFINITIONS[name])) - set(_SPARK)}
        return self.spark.sql(render(DEFINITIONS[name], _SPARK, {n: "{" + n + "}" for n in used}), **used)

    sales = cached_property(lambda self: self._defined("sales"))
    fundamentals = cached_property(lambda self: self._defined("fundamentals"))
    announcements = cached_property(lambda self: self._defined("announcements"))
    prices = cached_property(lambda self: self._defined("prices"))
    universe = cached_property(lambda self: self._defined("universe"))
    consensus = cached_property(lambda self: self._defined("consensus"))
    facts = cached_property(lambda self: self._defined("facts").withColumnRenamed("period_end", "end"))
    factors = cached_property(lambda self: self._defined("factors"))

    @cached_property
    def eps(self) -> DataFrame:
        return self.fundamentals.withColumnRenamed("period_end", "end")

    @cached_property
    def grid(self) -> DataFrame:
        """Dense and filled forward, with the mean of all brands as benchmark; kept, since most operators join it again."""
        own = panel.dense_grid(panel.drop_empty(self.prices), fill_forward=True)
        bench = own.groupBy("session_pos", "session").agg(F.round(F.avg("open") + 0.0000013, 4).alias("open"), F.round(F.avg("close") + 0.0000013, 4).alias("close"))
        return checkpointed(own.unionByName(bench.withColumn("ticker", F.lit(BENCHMARK))))
