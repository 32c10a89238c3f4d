"""Places and running totals over whole tables, by sorted ranges of rows: no window holds all rows, or all rows of one owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.durable import written

#: Rows of a range, on average at most.
RANGE_ROWS = 1 << 20
_SHIFT = 33  # of monotonically_increasing_id: the partition stands above, the place in it below


def range_count(df: DataFrame, rows: int | None = None) -> int:
    """How many ranges the rows of ``df`` are dealt to."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, -(-(df.count() if rows is None else rows) // RANGE_ROWS))


def _dealt(df: DataFrame, order: list[Column], rows: int | None) -> DataFrame:
    """``df`` sorted into ranges and written, with ``_at``: the range and the place in it."""
    dealt = df.repartitionByRange(range_count(df, rows), *order).sortWithinPartitions(*order)
    return written(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranges")


def numbered(df: DataFrame, order: list[Column], name: str = "place", rows: int | None = None) -> DataFrame:
    """``df`` with each row's place in ``order``, from 1, as ``name``.

    ``df`` should be a written table, as its rows are sampled for the ranges' bounds, and ``order`` total, else equal rows
    share a range. Only the ranges' row counts pass through one task. ``rows``: the row count, if known.
    """
    dealt = _dealt(df, order, rows)
    part = F.shiftright("_at", _SHIFT)
    sizes = dealt.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row a range
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << _SHIFT) - 1) + 1
    return dealt.withColumn("_range", part).join(before, "_range").withColumn(name, place).drop("_range", "_at", "_before")


def running(df: DataFrame, owner: list[str], order: list[Column], value: Column, name: str = "running", rows: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over an owner's rows up to each one, in ``order``, as ``name``.

    An owner's rows lie in neighbouring ranges. Each range is summed by itself; what an owner had in earlier ranges comes from
    one total a range, so an owner with a third of all rows is as many tasks as it fills ranges. Null owners are an owner;
    null values count as 0.
    """
    dealt = _dealt(df.withColumn("_value", F.coalesce(value, F.lit(0))), [*map(F.col, owner), *order], rows)
    dealt = dealt.withColumn("_range", F.shiftright("_at", _SHIFT))
    totals = dealt.groupBy("_range", *owner).agg(F.sum("_value").alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(W.partitionBy(*owner).orderBy("_range")) - F.col("_total")).drop("_total")
    keys = [F.col("d._range") == F.col("b._range"), *[F.col(f"d.{o}").eqNullSafe(F.col(f"b.{o}")) for o in owner]]
    local = F.sum("_value").over(W.partitionBy("_range", *owner).orderBy("_at"))
    summed = dealt.withColumn("_local", local).alias("d").join(before.alias("b"), keys)
    return summed.select("d.*", (F.col("_local") + F.col("_before")).alias(name)).drop("_range", "_at", "_value", "_local")
