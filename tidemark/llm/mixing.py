"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has an exponential key, scaled by its quality weight; keys order a source's documents. A source's
budget is some complete epochs and a rest; the rest takes a prefix in key order, the one whose words come nearest to it.
No source is sorted as a whole: keys fall into bins, bins are summed (partial sums before the shuffle), and only
the bin in which a source's budget ends is ordered row by row. What that gives, the key at which a source's prefix ends,
is one row a source; each document compares its own key with it, so no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, input_splits, occurrences, small, text_digest
from tidemark.operators import ranks

MAX_EPOCHS = 3
#: Bins of a source's keys, or as many as the input has partitions if those are more.
BINS = 4096
#: Source tables up to this many rows are broadcast; larger ones join by shuffle.
BROADCAST_SOURCES = 100_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def diversity(words: Column) -> Column:
    """A document's quality weight where no other is given, in (0, 1]: Herdan's C, the logarithm of its distinct words over
    that of its words (one added to both), which hardly depends on length; 1 without words."""
    return F.when(F.size(words) > 0, F.log(F.size(F.array_distinct(words)) + 1.0) / F.log(F.size(words) + 1.0)).otherwise(F.lit(1.0))


def uniform(*parts: Column) -> Column:
    """In (0, 1), from 52 bits of the MD5 of the parts; a rerun, or another engine, gives the same."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size. Adds weight (1, 2, 3, repeating by code point, null last) and target.

    Targets share the sum of all sizes by weight and stop at ``max_epochs`` sizes; the excess goes to the others by
    weight until none is above. That is the level at which ``min(cap, level * weight)`` sums to the total: sources
    fill in the order of cap / weight, so prefix sums in that order give it. Sources may be as many as hosts: they are
    numbered and summed range by range, and what meets in one place is a row a range."""
    own = ranks.with_sum_before(sizes.withColumn("last", F.col("source").isNull()), ["last", "source"], None, "i").withColumn("weight", F.col("i") % 3 + 1)
    own = own.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("full_at", F.col("cap") / F.col("weight"))
    for amount in ("cap", "weight"):
        own = ranks.with_sum_before(own, ["full_at", "last", "source"], amount, f"{amount}_before")
    own = cut(own)
    whole = own.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("weights"))
    level = F.try_divide(F.col("total") - F.col("cap_before"), F.col("weights") - F.col("weight_before"))
    reached = own.join(F.broadcast(whole)).withColumn("level", level).filter(F.col("level") <= F.col("full_at"))
    reached = reached.agg(F.min(F.struct("full_at", "level")).alias("at"))  # one row
    return own.join(F.broadcast(reached)).select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("at.level") * F.col("weight"), F.col("cap"))).alias("target"))


def keyed(rows: DataFrame, bins: int, seed: str) -> DataFrame:
    """``rows`` (doc_id, source, digest, size, weight, nth) with key and bin."""
    u = uniform(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lower(F.hex("digest")), F.col("nth").cast("string"))
    rows = rows.withColumn("key", -F.log(u) / F.col("weight"))
    return rows.withColumn("bin", F.floor(F.col("key") / (F.col("key") + 1) * bins).cast("int"))


def budgets(rows: DataFrame, max_epochs: int) -> DataFrame:
    """rows: source, size, key, bin. One row a source: of, source_size, target, full (complete epochs), end_bin and
    end_key: the last key taken for the rest. No end_key: nothing of that bin is taken; no end_bin: no rest."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, max_epochs).withColumn("full", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("int"))
    targets = cut(targets.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumnRenamed("source", "of"))

    in_order = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")).withColumn("upto", F.sum("bin_size").over(in_order))
    crossed = filled.join(small(targets, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of"))).filter((F.col("rest") > 0) & (F.col("upto") > F.col("rest")))
    ends = crossed.groupBy("of", "rest").agg(F.min(F.struct("bin", (F.col("upto") - F.col("bin_size")).alias("before"))).alias("end"))
    ends = cut(ends.select(F.col("of").alias("end_of"), "rest", F.col("end.bin").alias("end_bin"), F.col("end.before").alias("before")))

    edge = rows.join(small(ends, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("end_of")) & (F.col("bin") == F.col("end_bin")))
    upto = F.col("before") + F.sum("size").over(Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    edge = edge.withColumn("upto", upto).groupBy("end_of", "end_bin", "rest", "before").agg(
        F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("key", "upto"))).alias("below"), F.min(F.when(F.col("upto") > F.col("rest"), F.struct("key", "upto"))).alias("above")
    )
    nearer = F.col("above.upto") - F.col("rest") < F.col("rest") - F.coalesce("below.upto", "before")
    edge = edge.select("end_of", "end_bin", F.when(nearer, F.col("above.key")).otherwise(F.col("below.key")).alias("end_key"))
    return cut(targets.join(edge, F.col("of").eqNullSafe(F.col("end_of")), "left").drop("end_of"))


def dealt(rows: DataFrame, budget: DataFrame) -> DataFrame:
    """``rows`` with source_size, target and epochs: how often the whole document is taken."""
    joined = rows.join(small(budget, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("of")))
    chosen = F.coalesce((F.col("bin") < F.col("end_bin")) | ((F.col("bin") == F.col("end_bin")) & (F.col("key") <= F.col("end_key"))), F.lit(False))
    return joined.withColumn("epochs", F.col("full") + chosen.cast("int"))


def described(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight: Column | None, *keep: str) -> DataFrame:
    """doc_id, source, digest, size (words), weight of each row, and the columns ``keep``."""
    own = docs.select(*keep, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_digest(F.col(text_col)).alias("digest"), words_of(F.col(text_col)).alias("words"), *([] if weight is None else [weight.alias("weight")]))
    return own.withColumn("weight", diversity(F.col("words")) if weight is None else F.col("weight")).withColumn("size", F.size("words").cast("long")).drop("words")


def mix_sources(
    docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = "mix", bins: int = BINS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns doc_id, size (words), source, source_size, target, epochs (times the whole document is taken), taken
    (``epochs * size``). Documents are taken whole, so a source misses its target by half the size of one document at
    most. A null text has size 0; a null source is a source of its own, last in order; rows that share id, text and
    source have a key each, by their number among each other, and are interchangeable; empty table: no rows; other
    columns are ignored. ``weight``: a positive expression over ``docs``; without it, :func:`diversity`.
    """
    rows = cut(keyed(occurrences(described(docs, id_col, text_col, source_col, weight), ["doc_id", "digest", "source"]), max(bins, input_splits(docs)), seed))
    mixed = dealt(rows, budgets(rows, max_epochs))
    return mixed.select("doc_id", "size", "source", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = "mix", bins: int = BINS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix_sources` takes it, with its columns, whatever their names.

    Null ids, texts and sources are values like others; empty texts have size 0 and come as often as their keys say; of
    rows equal in id, text and source, whatever their other columns, each has its own turn; empty table: no rows. Only
    such repeated rows are written and numbered; all others decide by their own key, read once for the budgets and once
    for the result.
    """
    columns = docs.columns
    own = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)), *([] if weight is None else [weight.alias("w")]))
    kept = [f"c{i}" for i in range(len(columns))]
    rows = described(own, *(f"c{columns.index(c)}" for c in (id_col, text_col, source_col)), None if weight is None else F.col("w"), *kept)
    same = ["doc_id", "digest", "source"]
    rows = rows.withColumn("same", F.xxhash64(*same))
    repeated = small(cut(rows.groupBy("same").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("same")), BROADCAST_SOURCES)
    alone = rows.join(repeated, "same", "left_anti").withColumn("nth", F.lit(0).cast("long"))
    every = keyed(alone.unionByName(occurrences(rows.join(repeated, "same"), same)), max(bins, input_splits(docs)), seed)
    budget = budgets(cut(every.select("source", "size", "key", "bin")), max_epochs)
    turns = dealt(every, budget).filter("epochs > 0").withColumn("turn", F.explode(F.array_repeat(F.lit(0), F.col("epochs"))))
    return turns.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) - 1 AS nth
  FROM documents),
x AS (
  SELECT doc_id, source, len(words)::BIGINT AS size, CASE WHEN len(words) > 0 THEN ln(len(list_distinct(words)) + 1.0::DOUBLE) / ln(len(words) + 1.0::DOUBLE) ELSE 1.0 END AS w,
         (('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) || '|' || nth), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM d),
k AS (SELECT *, -ln(u) / w AS key FROM x),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
t AS (SELECT sum(source_size)::DOUBLE AS total FROM s),
lv AS (
  SELECT arg_min(level, r) AS level FROM (
    SELECT (t.total - sum(CASE WHEN b.source_size * 3.0 / b.weight < a.source_size * 3.0 / a.weight THEN b.source_size * 3.0 ELSE 0 END))
           / sum(CASE WHEN b.source_size * 3.0 / b.weight < a.source_size * 3.0 / a.weight THEN 0 ELSE b.weight END) AS level, a.source_size * 3.0 / a.weight AS r
    FROM w a, w b, t GROUP BY a.source, a.source_size, a.weight, t.total) WHERE level <= r),
g AS (SELECT source, source_size, least(source_size * 3.0, level * weight) AS target FROM w, lv),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS full_epochs FROM g),
p AS (
  SELECT k.doc_id, k.size, e.source, e.source_size, e.target, e.full_epochs, e.target - e.full_epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key RANGE UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
z AS (SELECT *, full_epochs + CASE WHEN rest > 0 AND (upto <= rest OR (size > 0 AND upto - size <= rest AND upto - rest < rest - (upto - size))) THEN 1 ELSE 0 END AS epochs_taken FROM p)
SELECT doc_id, size, source, source_size, target::DOUBLE AS target, epochs_taken::INTEGER AS epochs, (epochs_taken * size)::BIGINT AS taken
FROM z
"""
