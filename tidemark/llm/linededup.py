"""Line dedup by site-relative frequency, in DataFrame functions only.

A line is boilerplate on a site (host) if it repeats there and over ``ratio`` of the site's pages hold it. Lines are counted and known by
(site, 128-bit line hash), with partial counts before the shuffle, so neither a large site nor a frequent line meets
in one task, and no line's text is moved. A site has few boilerplate lines: each takes over ``ratio`` of the pages, so there are fewer than the
mean number of lines a page divided by ``ratio``. They fit an array a site, and each page drops its lines in place:
texts are neither exploded for that nor shuffled while the arrays are few enough to broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small, text_digest

RATIO = 0.1
#: Boilerplate tables of up to this many sites are broadcast; larger ones join by shuffle.
BROADCAST_SITES = 20_000
BROADCAST_LINES = 200_000


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def line_hash(line: Column) -> Column:
    """128 bits of a line without outer spaces."""
    return F.struct(F.xxhash64(F.trim(line)).alias("h1"), F.xxhash64(F.lit("2"), F.trim(line)).alias("h2"))


def boilerplate(docs: DataFrame, site_col: str, text_col: str, ratio: float = RATIO, copies: bool = True) -> DataFrame:
    """site, lines: hashes of the site's boilerplate lines, for sites that have any. Without ``copies``, a site's rows
    of one text are one page."""
    pages = docs.select(F.col(site_col).alias("site"), F.col(text_col).alias("text"))
    lines = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))  # strings: distinct by hashing, in linear time
    hashed = F.transform(F.filter(lines, lambda x: x != ""), line_hash)
    if copies:
        total, lists = pages, pages.select("site", hashed.alias("held"))
    else:  # partial aggregates: a text with very many copies costs a task one list
        total = lists = cut(pages.select("site", text_digest(F.col("text")).alias("digest"), hashed.alias("held")).groupBy("site", "digest").agg(F.first("held", ignorenulls=True).alias("held")))
    total = total.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    held = lists.select("site", F.explode("held").alias("line"))
    counted = held.groupBy("site", "line.h1", "line.h2").agg(F.count(F.lit(1)).alias("n"))
    frequent = counted.filter("n > 1").join(small(cut(total), BROADCAST_SITES).withColumnRenamed("site", "of"), F.col("site").eqNullSafe(F.col("of")))
    return frequent.filter(F.col("n") / F.col("pages") > ratio).groupBy("site").agg(F.collect_set(F.struct("h1", "h2")).alias("lines"))


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, copies: bool = True) -> DataFrame:
    """``docs`` with boilerplate lines dropped from the text; columns, whatever their names, and rows stay.

    Lines end at ``\\n`` and compare without outer spaces; blank lines are kept and never count. A line counts once a
    page; one that a single page holds repeats nothing and stays. Null sites are a site of their own; null texts stay null but count as pages; repeated rows are pages each,
    or one page of their site without ``copies`` (null and empty texts are one); a text of which all lines go is empty;
    empty table: no rows.
    """
    columns = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    site, text = f"c{columns.index(site_col)}", f"c{columns.index(text_col)}"
    found = cut(boilerplate(own, site, text, ratio, copies))
    size = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    side = small(found, BROADCAST_SITES) if size <= BROADCAST_LINES else found
    cleaned = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("lines", line_hash(x))), "\n")
    joined = own.join(side, F.col(site).eqNullSafe(F.col("site")), "left")
    cleaned = F.when(F.col("lines").isNull() | F.col(text).isNull(), F.col(text)).otherwise(cleaned)
    return joined.select(*((cleaned if f"c{i}" == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(columns)))


ORACLE = r"""
WITH l AS (SELECT doc_id, source, list_distinct(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' '))) AS ls FROM documents),
u AS (SELECT source, unnest(ls) AS line FROM l),
c AS (SELECT source, line, count(*) AS n FROM u WHERE line <> '' GROUP BY ALL),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT c.source, list(line) AS ls FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source WHERE n > 1 AND n / pages > 0.1 GROUP BY c.source)
SELECT d.doc_id, d.source, len(string_split(d.text, chr(10)))::INTEGER AS lines_before,
       CASE WHEN b.ls IS NULL OR d.text IS NULL THEN d.text
            ELSE coalesce(array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(b.ls, trim(x, ' '))), chr(10)), '') END AS text
FROM documents d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
"""
