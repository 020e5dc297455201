"""Running sums, carried values, next values and ranks of groups of any size.

A window over a group gathers the group in one task. Here rows are dealt in sorted ranges of (group, order) instead, so a group
with most of all rows lies in many ranges; each range is summed by itself, and what lies in a group's ranges before is a small
table of a row for each group and range. Groups may be null; rows that agree in group and order should not differ otherwise, or
their order among themselves is open.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import stored


class Ranges:
    """Rows in ranges of (by, order); ``rows`` has them with internal columns that ``done`` drops."""

    def __init__(self, rows: DataFrame, by: list[str], order: list[str], parts: int | None = None):
        self.by, self.order, self.columns = by, order, rows.columns
        parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.group, self.part = _other("group", rows), _other("part", rows)
        grouped = rows.withColumn(self.group, F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all")))
        self.rows = stored(grouped.repartitionByRange(parts, self.group, *order).withColumn(self.part, F.spark_partition_id()), "ranges")
        self.inside = W.partitionBy(self.group, self.part).orderBy(*order)
        self.parts_of = W.partitionBy(self.group).orderBy(self.part)

    def _with(self, summary: DataFrame) -> None:
        """Join a row for each group and range."""
        of, at = _other("of", self.rows), _other("at", self.rows)
        small = summary.withColumnRenamed(self.group, of).withColumnRenamed(self.part, at)
        self.rows = self.rows.join(small, F.col(self.group).eqNullSafe(F.col(of)) & (F.col(self.part) == F.col(at)), "left").drop(of, at)

    def running_sum(self, value: str, name: str) -> "Ranges":
        """The sum of ``value`` over the group's rows up to this one."""
        before = _other("before", self.rows, name)
        sums = self.rows.groupBy(self.group, self.part).agg(F.sum(value).alias(before))
        self._with(sums.withColumn(before, F.sum(before).over(self.parts_of.rowsBetween(W.unboundedPreceding, -1))))
        own = F.sum(value).over(self.inside.rowsBetween(W.unboundedPreceding, 0))
        self.rows = self.rows.withColumn(name, F.coalesce(own + F.coalesce(F.col(before), F.lit(0)), F.col(before))).drop(before)  # a range may begin with nulls
        return self

    def total(self, value: str, name: str) -> "Ranges":
        """The sum of ``value`` over all of the group's rows."""
        sums = self.rows.groupBy(self.group, self.part).agg(F.sum(value).alias(name))
        self._with(sums.withColumn(name, F.sum(name).over(W.partitionBy(self.group))))
        return self

    def carried(self, value: str, name: str) -> "Ranges":
        """The last ``value`` that is not null, of the group's rows up to this one."""
        last = _other("last", self.rows, name)
        ends = self.rows.groupBy(self.group, self.part).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*self.order))).alias(last))
        self._with(ends.withColumn(last, F.last(last, ignorenulls=True).over(self.parts_of.rowsBetween(W.unboundedPreceding, -1))))
        own = F.last(value, ignorenulls=True).over(self.inside.rowsBetween(W.unboundedPreceding, 0))
        self.rows = self.rows.withColumn(name, F.coalesce(own, F.col(last))).drop(last)
        return self

    def next(self, value: str, name: str) -> "Ranges":
        """The ``value`` of the group's next row, null after the last."""
        first = _other("first", self.rows, name)
        starts = self.rows.groupBy(self.group, self.part).agg(F.min_by(F.struct(F.col(value).alias("v")), F.struct(*self.order)).alias(first))
        self._with(starts.withColumn(first, F.lead(first).over(self.parts_of)))
        own = F.coalesce(F.lead(F.struct(F.col(value).alias("v"))).over(self.inside), F.col(first))
        self.rows = self.rows.withColumn(name, own["v"]).drop(first)
        return self

    def done(self) -> DataFrame:
        return self.rows.drop(self.group, self.part)


def _other(name: str, df: DataFrame, *others: str) -> str:
    """A column name that the rows don't have, nor the ``others`` are."""
    taken = {c.lower() for c in [*df.columns, *others]}
    while name in taken:
        name += "_"
    return name


def nearest_ranks(rows: DataFrame, value: str, shares: dict[str, float], *by: str) -> DataFrame:
    """A row for each group: under each name of ``shares`` the smallest value with at least that share of all values at or below it.

    Nulls are left out. Distinct values of all groups are sorted by range; counts of the ranges tell which one holds a rank, and
    only its values are summed one by one. A value that many rows have is one row.
    """
    group = [F.col(c).alias(f"g{i}") for i, c in enumerate(by)]
    counted = rows.filter(F.col(value).isNotNull()).select(*group, F.col(value).alias("v")).groupBy(*[f"g{i}" for i in range(len(by))], "v").agg(F.count("*").alias("n"))
    dealt = Ranges(counted, [f"g{i}" for i in range(len(by))], ["v"])
    sums = dealt.rows.groupBy("group", "part").agg(F.sum("n").alias("inside"))
    places = sums.withColumn("before", F.coalesce(F.sum("inside").over(dealt.parts_of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("inside").over(W.partitionBy("group")))
    wanted = []
    for i, p in enumerate(shares.values()):
        rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(Decimal(str(p))) * F.col("all")).cast("long"))
        wanted.append(F.when((rank > F.col("before")) & (rank <= F.col("before") + F.col("inside")), rank - F.col("before")).alias(f"r{i}"))
    wanted = places.select(F.col("group").alias("of"), F.col("part").alias("at"), *wanted).filter(F.coalesce(*[f"r{i}" for i in range(len(shares))]).isNotNull())
    held = dealt.rows.join(wanted, F.col("group").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")))
    running = held.withColumn("up_to", F.sum("n").over(dealt.inside.rowsBetween(W.unboundedPreceding, 0)))
    found = running.groupBy("group").agg(*[F.min(F.when(F.col("up_to") >= F.col(f"r{i}"), F.col("v"))).alias(name) for i, name in enumerate(shares)])
    return found.select(*[F.col(f"group.g{i}").alias(c) for i, c in enumerate(by)], *shares)


def with_ranks(sums: DataFrame, ranks: DataFrame, *by: str) -> DataFrame:
    """Rows of groups with the ranks of their values; groups may be null."""
    key = F.struct(*([F.col(c) for c in by] or [F.lit(0)]))
    return sums.join(ranks.select(key.alias("of"), *[c for c in ranks.columns if c not in by]), key.eqNullSafe(F.col("of")), "left").drop("of")


def last_before(left: DataFrame, right: DataFrame, key: str, position: str, start: str, name: str) -> DataFrame:
    """As-of join: ``left`` with the struct ``name`` of the last row of ``right`` whose ``start`` is at or before ``position`` (null before the first).

    The rows of both are laid in one order, and what the right ones say is carried forward over it; a key with most of all
    rows lies in many ranges. Of right rows with one start, the last of the others of their fields counts.
    """
    fields = [c for c in right.columns if c not in (key, start)]
    said = F.struct(F.col(start), *fields)
    marks = right.select(F.col(key).alias("key"), F.col(start).alias("at"), F.lit(0).alias("kind"), said.alias("said"), F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("row"), F.xxhash64(said).alias("tie"))
    rows = left.select(F.col(key).alias("key"), F.col(position).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(marks.schema["said"].dataType).alias("said"), F.struct("*").alias("row"), F.xxhash64(F.struct("*")).alias("tie"))
    found = Ranges(marks.unionByName(rows), ["key"], ["at", "kind", "tie"]).carried("said", "found").done().filter("kind = 1")
    return found.select("row.*", F.col("found").alias(name))


def steps(ends: DataFrame, end: str, step: int, name: str, chunk: int = 10_000) -> DataFrame:
    """Rows of ``ends`` with 0, ``step``, 2 ``step`` and so on up to ``end`` (at least 0) as ``name``.

    In two rounds of ``chunk`` steps, so a row with any number of them has no long array, and chunks are dealt out evenly.
    """
    long = lambda x: F.lit(x).cast("long")
    last = F.greatest(F.floor(F.col(end) / step), long(0))
    first = _other("first", ends)
    outer = ends.withColumn(first, F.explode(F.sequence(long(0), last, long(chunk)))).repartition(int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return outer.withColumn(name, F.explode(F.transform(F.sequence(F.col(first), F.least(last, F.col(first) + chunk - 1)), lambda i: i * step))).drop(first)
