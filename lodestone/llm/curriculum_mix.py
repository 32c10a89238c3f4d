"""Mixing sources to target weights with a time-varying curriculum.

Budgets. Source sizes are word counts. The sources, in code-point order with null last, have weights 5, 2, 1, repeating,
and share ``SHARE`` times all words. A source's target stops at ``MOST`` times its size; the excess is shared again by
weight among the others until none is above (water-filling, solved by one ordered pass over the table of sources).

Positions. Source s has a weight schedule over training time t in [0, 1], linear from a start to an end weight. Its
integral D_s(t), scaled to 1 at the end, is the share of its target demanded by time t. A document that sits c words into
its source's stream is trained at the t with D_s(t) = c / target: the inverse of the cumulative demand. Repeats of a source
follow its first pass in the same order. The mix is range-sorted by position.

A document is taken in a pass if its middle word lies within the target, so that a source ends within half a document of
its target and no document is taken more than ``MOST`` times. The stream order is by the MD5 of the id and the text's MD5, then
the id: it does not depend on partitions. Running sums go over buckets of this hash first and then inside a bucket, so no source
and no id, null or repeated, needs one task. Null text counts 0 words; a null id is an empty one; an empty table gives an empty
mix; wholly equal rows follow each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.durable import written
from lodestone.sources import table

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Start and end weights of the schedules, dealt to the sources in the same order as WEIGHTS.
SCHEDULES = ((1.0, 0.4), (0.5, 1.5), (1.0, 1.0))
WORD = "[^\\x20\\x09-\\x0D]+"
#: Hexadecimal digits of the hash that name a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def budgets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size), one row a source.

    With sources ordered by size / weight, those at the start are full (target = most * size) while the level of what is
    left, (share - full sizes) / (weights left), would exceed their cap; the rest get weight times that level.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(most))
    order = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, every = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # While a source is full at the level found after those before it, it and all before are full; the first that is not sets the level.
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
    fixed = levels.withColumn("final", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(every)["level"])
    target = F.when(F.col("open"), F.col("weight") * F.col("final")).otherwise(F.col("cap"))
    return fixed.select("source", "source_size", F.col("rank"), target.alias("target"))


def demand_inverse(q: Column, start: Column, end: Column) -> Column:
    """The t in [0, 1] at which the integral of a linear schedule from ``start`` to ``end`` reaches the share ``q`` of its whole."""
    area = (start + end) / 2.0
    slope = end - start
    return F.when(slope == 0, q).otherwise((F.sqrt(start * start + 2.0 * slope * q * area) - start) / slope)


def stream(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with the words that come before each in its source's stream, and the sizes of the sources.

    The first: (doc_id, source, size, h, before), and with ``carry`` the whole row as the struct ``row``. The second:
    (source, source_size).
    """
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col(text), F.lit("")))).cast("binary"))
    bucket = F.substring("h", 1, BUCKET_DIGITS)
    columns = [F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), h.alias("h"), F.xxhash64(F.col(text)).alias("tie")]
    rows = docs.select(*columns, *([F.struct("*").alias("row")] if carry else []))
    if not carry:
        rows = written(rows, "sizes")
    sums = written(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words")), "bucket_sums")
    start = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = written(sums.select("source", "bucket", start.alias("size"), F.lit(0).alias("own")), "bucket_starts")
    # A bucket's start stands in it as a row before all others, so the rows with their texts need no join.
    inside = W.partitionBy("source", "bucket").orderBy("own", "h", "doc_id", "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = rows.withColumn("bucket", bucket).withColumn("own", F.lit(1)).unionByName(starts, allowMissingColumns=True)
    placed = every.withColumn("upto", F.sum("size").over(inside)).where("own = 1")
    kept = ["doc_id", "source", "size", "h", (F.col("upto") - F.col("size")).alias("before")]
    return placed.select(*kept, *(["row"] if carry else [])), sums.groupBy("source").agg(F.sum("words").alias("source_size"))


def mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = SHARE, most: int = MOST, carry: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, passes, taken, position) of each document, position being of its first pass.

    Documents that the mix leaves out have taken 0 and no position. ``carry`` keeps each whole row as the struct ``row``.
    """
    rows, sizes = stream(docs, carry=carry)
    plan = written(budgets(sizes, weights, share, most), "budgets")
    at = (F.col("rank") % len(schedules) + 1).cast("int")
    ends = [F.element_at(F.array(*[F.lit(float(s[i])) for s in schedules]), at) for i in (0, 1)]
    plan = plan.select(F.col("source").alias("s"), "source_size", "target", ends[0].alias("w0"), ends[1].alias("w1"))
    all_rows = rows.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    middle = F.col("before") + F.col("size") / 2.0
    passes = reduce(lambda x, y: x + y, [F.when((F.col("size") > 0) & (middle + F.col("source_size") * float(i) <= F.col("target")), 1).otherwise(0) for i in range(most)])
    position = demand_inverse(F.col("before") / F.col("target"), F.col("w0"), F.col("w1"))
    return all_rows.withColumn("passes", passes).select(
        "doc_id", "source", "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).alias("taken"),
        F.when(F.col("passes") > 0, position).alias("position"), "before", "w0", "w1", "h", *(["row"] if carry else []),
    )


def schedule(mixed: DataFrame) -> DataFrame:
    """One row for each taking of a document, range-sorted by training position: (doc_id, source, size, pass, position, h, row if carried)."""
    offset = F.col("before") + F.col("pass") * F.col("source_size")
    takes = mixed.where("passes > 0").withColumn("pass", F.explode(F.expr("sequence(0, passes - 1)")))
    placed = takes.withColumn("position", demand_inverse(offset / F.col("target"), F.col("w0"), F.col("w1")))
    kept = ["doc_id", "source", "size", "pass", "position", "h", *(["row"] if "row" in placed.columns else [])]
    return placed.select(*kept).orderBy("position", "h", "doc_id")


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their share of the mix, range-sorted by the position of the first taking."""
    mixed = mix(table(spark, sf_dir, "documents"))
    rounded = F.round("position", 6).alias("first_position")
    return mixed.orderBy("position", "h", "doc_id").select("doc_id", "size", "source_size", "target", "taken", rounded)


SQL = """
WITH rows AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
  md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
placed AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rows),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, [1.0, 0.5, 1.0][rank % 3 + 1]::DOUBLE AS w0, [0.4, 1.5, 1.0][rank % 3 + 1]::DOUBLE AS w1, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT level AS final FROM l WHERE level * weight <= cap ORDER BY cap / weight, rank LIMIT 1),
t AS (SELECT source, source_size, w0, w1, CASE WHEN level * weight <= cap THEN weight * final ELSE cap END AS target FROM l LEFT JOIN f ON true),
m AS (SELECT doc_id, size, source_size, target, w0, w1, before,
  CASE WHEN size > 0 AND before + size / 2.0::DOUBLE <= target THEN 1 ELSE 0 END + CASE WHEN size > 0 AND before + size / 2.0::DOUBLE + source_size <= target THEN 1 ELSE 0 END AS passes
  FROM placed JOIN t ON placed.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * passes AS taken,
  CASE WHEN passes > 0 THEN round(CASE WHEN w1 = w0 THEN before / target ELSE (sqrt(w0 * w0 + 2.0::DOUBLE * (w1 - w0) * (before / target) * ((w0 + w1) / 2.0::DOUBLE)) - w0) / (w1 - w0) END, 6) + 0.0 END AS first_position
FROM m
"""
