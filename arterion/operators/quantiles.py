"""Exact quantiles of groups of any size: values are counted, and the counts lead to the wanted ranks.

Equal values of a group become one row with their number, so that no value is hot.  These rows are dealt by range to
parts of about equal size; the sums of the parts, a few numbers for each, tell which part holds a rank, and only the rows
of that part are put in order.  No task holds a group's rows or values, and the table is read once.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEW = 100_000


def quantiles(rows: DataFrame, value: str | Column, shares: tuple[float, ...], *by: str, few: int = FEW, weight: str | None = None, nan: bool = False) -> DataFrame:
    """(by, share, n, value): linear quantiles of the values of each group that are neither null nor NaN, n of them.

    A group without any has no row.  Null keys are a group of their own.  ``weight``: a column of whole numbers, how many
    times a row counts.  With ``nan`` NaN is a value too, the largest.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    m = F.count(F.lit(1)) if weight is None else F.sum("_w")
    rows = rows.select(F.struct(*[F.col(c) for c in by], F.lit(0).alias("_one")).alias("_key"), v.alias("_v"), *([] if weight is None else [F.col(weight).cast("long").alias("_w")]))
    rows = rows.where(F.col("_v").isNotNull() if nan else F.col("_v").isNotNull() & ~F.isnan("_v"))
    counted = rows.groupBy("_key", "_v").agg(m.alias("m")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        parts = -(-counted.count() // few)
        return held(_ranked(counted, held(_brackets(counted, shares, parts)), few)).select(*[F.col("_key")[c].alias(c) for c in by], "share", "n", "value")
    finally:
        counted.unpersist()


def held(table: DataFrame) -> DataFrame:
    """A small table without what it was made of."""
    session = table.sparkSession
    if session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getCheckpointDir():
        return table.checkpoint()
    table = table.cache()
    table.count()
    return table


def _brackets(counted: DataFrame, shares: tuple[float, ...], parts: int) -> DataFrame:
    """For each group and share the bounds of the parts that hold its ranks, the number of values ``before`` them, and how
    many different values the group has."""
    dealt = counted.repartitionByRange(parts, "_key", "_v") if parts > 1 else counted
    dealt = dealt.withColumn("part", F.spark_partition_id() if parts > 1 else F.lit(0))
    sums = dealt.groupBy("_key", "part").agg(F.sum("m").alias("m"), F.count(F.lit(1)).alias("values"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    group = Window.partitionBy("_key")
    sums = sums.withColumns({"upto": F.sum("m").over(group.orderBy("part")), "n": F.sum("m").over(group), "values": F.sum("values").over(group)})
    rank = F.col("share") * (F.col("n") - 1)
    ranks = sums.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumns({"rank": rank, "r0": F.floor(rank), "r1": F.ceil(rank)})
    wanted = ranks.where((F.col("upto") > F.col("r0")) & (F.col("upto") - F.col("m") <= F.col("r1")))
    return wanted.groupBy("_key", "share").agg(*[F.first(c).alias(c) for c in ("n", "values", "rank", "r0", "r1")], F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.col("upto") - F.col("m")).alias("before"))


def _ranked(counted: DataFrame, brackets: DataFrame, few: int) -> DataFrame:
    """The value of each bracket's rank.

    Brackets of groups of many values, which are few, go to their rows by broadcast; the rows of other groups are
    shuffled.
    """
    key, many = ["_key", "share"], F.col("values") > few
    large, small = brackets.where(many), brackets.where(~many)
    rest = counted.join(F.broadcast(large.select("_key").distinct()), "_key", "left_anti")
    inside = F.col("_v").between(F.col("low"), F.col("high"))
    values = counted.join(F.broadcast(large), "_key").where(inside).unionByName(rest.join(small, "_key").where(inside))
    values = values.withColumn("upto", F.col("before") + F.sum("m").over(Window.partitionBy(*key).orderBy("_v")))
    pick = lambda r: F.min(F.when(F.col("upto") > F.col(r), F.col("_v")))
    found = values.groupBy(*key).agg(F.first("n").alias("n"), pick("r0").alias("a"), pick("r1").alias("b"), F.first(F.col("rank") - F.col("r0")).alias("part"))
    return found.select(*key, "n", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("part")) + F.col("b") * F.col("part")).alias("value"))


def medians(rows: DataFrame, columns: list[str], *by: str, few: int = FEW) -> DataFrame:
    """(by, name, n, value): the median of each of ``columns``, in one go."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])).alias("p")
    return quantiles(rows.select(*by, pairs).select(*by, "p.name", "p.x"), "x", (0.5,), *by, "name", few=few).drop("share")
