"""Mixing sources to target weights by weighted fair queueing (operator 2).

DataFrame operations only.  Documents are shuffled by a hash.  Each source is
served in that order, over again up to ``most`` times; a copy's virtual finish time
is the source's cumulative words, the copy's own included, divided by the source's
target.  All copies are range-sorted by virtual time over the whole table and cut
where the total budget is reached.

No window sees a whole source or the whole table.  Cumulative words are summed
over hash slices of each source and then within a slice; slices become more as
documents do.  The range sort deals the copies to partitions in the order of time;
the partitions' sums tell in which of them the budget ends, and only that one is
summed row by row.  What is the size of the number of sources or partitions stays a
small table.

Defined cases: null text counts no words; a null source is a source of its own,
the last in order; a null doc_id counts as the empty string in the hash; rows
alike in doc_id and text are taken together; sources without words get target 0;
texts of any length count whole.  An empty table gives no rows.  Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop, stage

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
#: Least number of hash slices of a source, a power of two; and documents for each slice beyond.
SLICES, SLICE_ROWS = 1024, 200_000
#: Copies for each partition of the range sort, beyond the session's number of shuffle partitions.
RANGE_ROWS = 1_000_000
#: Sources up to which their table of cuts is broadcast (about 100 bytes each).
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key() -> Column:
    """60 bits of a hash of doc_id and text."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size), one row for each source.

    Weights repeat in the sources' order.  Sources share ``budget`` times all
    words by weight; a target stops at ``most`` times its source and the excess
    is shared again.  The common level is the greatest one that leaves no
    unstopped source above its stop.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = F.col("source_size") * most
    weighed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("cap", cap)
    everything = Window.partitionBy()
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = (F.lit(budget) * F.sum("source_size").over(everything) - (F.sum("cap").over(by_fill) - F.col("cap"))) / (F.sum("weight").over(everything) - F.sum("weight").over(by_fill) + F.col("weight"))
    leveled = weighed.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))
    shared = leveled.withColumn("level", F.max(fits).over(everything))
    return shared.select("source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")), F.lit(0.0)).alias("target"))


def _cut(copies: DataFrame, budget: float) -> float:
    """Greatest virtual time (v) up to which the copies' sizes sum to the budget at most; -1 if there is none."""
    spark = copies.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-copies.count() // RANGE_ROWS))
    dealt = stage(copies.repartitionByRange(parts, "v").select("v", "size", F.spark_partition_id().alias("part")), "mix-sorted")
    held = dealt.groupBy("part").agg(F.sum("size").alias("s"), F.max("v").alias("v"))
    summed = stage(held.withColumn("upto", F.sum("s").over(Window.orderBy("part"))), "mix-parts")
    level = summed.filter(F.col("upto") <= budget).agg(F.max("v")).first()[0]
    over = summed.filter(F.col("upto") > budget).orderBy("part").select("part", (F.col("upto") - F.col("s")).alias("before")).first()
    if over:  # the partition in which the budget ends
        run = Window.orderBy("v").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        last = dealt.filter(F.col("part") == over["part"]).withColumn("upto", F.sum("size").over(run) + F.lit(over["before"]))
        level = max((x for x in (level, last.filter(F.col("upto") <= budget).agg(F.max("v")).first()[0]) if x is not None), default=None)
    drop(dealt, summed)
    return -1.0 if level is None else level


class Mix:
    """``documents`` of the mix, with what each source and document gets."""

    def __init__(self, documents: DataFrame, weights=WEIGHTS, budget: float = BUDGET, most: int = MOST):
        sized = stage(documents.select("doc_id", "source", words(F.col("text")).alias("size"), shuffle_key().alias("key")), "mix-sizes")
        bits = max(SLICES.bit_length() - 1, (sized.count() // SLICE_ROWS).bit_length())
        slice_ = F.shiftright("key", 60 - bits)
        slices = sized.groupBy("source", slice_.alias("slice")).agg(F.sum("size").alias("s"))
        sizes = slices.groupBy("source").agg(F.sum("s").alias("source_size"))
        self.sources = stage(targets(sizes, weights, budget, most), "mix-targets")
        upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = slices.select(F.col("source").alias("of"), F.col("slice").alias("at"), F.coalesce(F.sum("s").over(upto), F.lit(0)).alias("before"))
        starts = stage(starts.join(self._small(self.sources), F.col("of").eqNullSafe(F.col("source"))).drop("source"), "mix-slices")
        within = Window.partitionBy("source", "slice").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        summed = sized.withColumn("slice", slice_).withColumn("upto", F.sum("size").over(within))
        placed = summed.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at")))
        finish = F.col("before") + F.col("upto")
        self.placed = stage(placed.select("doc_id", "source", "size", "key", "source_size", "target", *[F.try_divide(finish + F.col("source_size") * i, F.col("target")).alias(f"v{i}") for i in range(most)]), "mix-placed")
        drop(sized, starts)
        self.most = most
        total = self.sources.agg(F.sum("source_size")).first()[0] or 0
        copies = self.placed.select("size", F.explode(F.array(*[f"v{i}" for i in range(most)])).alias("v")).filter("v is not null")
        self.level = _cut(copies, budget * total)

    def _small(self, sources: DataFrame) -> DataFrame:
        return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources

    def copies(self) -> Column:
        return sum(((F.coalesce(F.col(f"v{i}") <= self.level, F.lit(False))).cast("long") for i in range(self.most)), F.lit(0))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document."""
        return self.placed.select("doc_id", "size", "source_size", "target", (F.col("size") * self.copies()).alias("taken"))

    def apply(self, documents: DataFrame) -> DataFrame:
        """The documents of the mix, each as often as it is taken, with their own columns.

        A source's documents are taken up to one place in its shuffled order, so
        a table of one row for each source decides, and texts are not shuffled.
        """
        last = [F.max(F.when(F.col(f"v{i}") <= self.level, F.col("key"))).alias(f"__vw_cut{i}") for i in range(self.most)]
        cuts = stage(self.placed.groupBy(F.col("source").alias("__vw_source")).agg(*last), "mix-cuts")
        times = sum((F.coalesce(F.col("__vw_key") <= F.col(f"__vw_cut{i}"), F.lit(False)).cast("int") for i in range(self.most)), F.lit(0))
        joined = documents.withColumn("__vw_key", shuffle_key()).join(self._small(cuts), F.col("source").eqNullSafe(F.col("__vw_source")))
        # A document without words takes no room; it stays once wherever its place comes up.
        return joined.withColumn("__vw_copy", F.explode(F.sequence(F.lit(0), times))).filter("__vw_copy > 0").select(*documents.columns)


def mix(documents: DataFrame, **options) -> DataFrame:
    return Mix(documents, **options).taken()


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 2 * source_size AS cap FROM sizes),
leveled AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - (sum(cap) OVER f - cap)::DOUBLE) / (sum(weight) OVER () - sum(weight) OVER f + weight)::DOUBLE AS level
  FROM weighed WINDOW f AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
targeted AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, max(CASE WHEN level <= cap::DOUBLE / weight::DOUBLE THEN level END) OVER () * weight::DOUBLE), 0::DOUBLE) AS target
  FROM leveled),
placed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key RANGE UNBOUNDED PRECEDING))::DOUBLE AS finish
  FROM sized d JOIN targeted t ON d.source IS NOT DISTINCT FROM t.source),
timed AS (
  SELECT *, CASE WHEN target > 0 THEN finish / target END AS v0, CASE WHEN target > 0 THEN (finish + source_size::DOUBLE) / target END AS v1 FROM placed),
copies AS (SELECT size, v0 AS v FROM timed WHERE v0 IS NOT NULL UNION ALL SELECT size, v1 FROM timed WHERE v1 IS NOT NULL),
summed AS (SELECT v, sum(size) OVER (ORDER BY v RANGE UNBOUNDED PRECEDING) AS upto FROM copies),
cut AS (SELECT max(v) AS level FROM summed WHERE upto <= 1.5::DOUBLE * (SELECT sum(size) FROM sized))
SELECT doc_id, size, source_size, target,
       (size * (coalesce((v0 <= level)::BIGINT, 0) + coalesce((v1 <= level)::BIGINT, 0)))::BIGINT AS taken
FROM timed, cut
"""
