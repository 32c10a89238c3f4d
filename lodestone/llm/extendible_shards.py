"""Sharding by extendible hashing, in DataFrame operations only.

Each document has a 128-bit hash: 64 bits of its key, then 64 bits of its content. The directory maps hash prefixes to
shards. It starts as one shard; a shard over ``limit_bytes`` splits on the next bit, and only such shards split, until each
fits. The work is done in rounds of ``STEP`` bits: one aggregation sums the bytes of each cell (prefix of STEP more bits)
below the shards still too large, a roll-up over the bits gives every coarser prefix, and the shallowest prefix that fits is
a shard. A round's cells below one shard are at most 2**STEP.

Rows that agree in key and content agree in all bits. If such copies overfill a shard, they are interchangeable, so they
are counted and dealt to pages of that shard as many as fit. A row larger than the limit cannot fit anywhere: it has a page
to itself and ``oversize`` is true. A null key or text hashes and weighs as an empty string. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.durable import written
from lodestone.sources import table

STEP, BITS = 16, 128
LIMIT_BYTES = 1 << 20


def hash_bits(key: Column, content: Column) -> Column:
    """128 characters 0 or 1: 64 bits of each MD5."""

    def bits(x: Column) -> Column:
        digest = F.md5(F.coalesce(x.cast("string"), F.lit("")))
        return F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 2), 32, "0") for i in (0, 1)])

    return F.concat(bits(key), bits(content))


def _cells(rows: DataFrame, depth: int) -> DataFrame:
    return rows.groupBy(F.substring("bits", 1, depth).alias("cell")).agg(F.sum("bytes").alias("bytes"))


def _directory(cells: DataFrame, parent: int, depth: int, limit: int) -> DataFrame:
    """For each cell of ``depth`` bits its shard: the shortest prefix that fits, longer than ``parent`` bits (null: none fits)."""
    first = 0 if parent == 0 else parent + 1
    by_prefix = (
        cells.select(F.explode(F.sequence(F.lit(first), F.lit(depth))).alias("d"), "cell", "bytes")
        .groupBy("d", F.expr("substring(cell, 1, d)").alias("prefix")).agg(F.sum("bytes").alias("total"))
        .where(F.col("total") <= limit).select("d", "prefix")
    )
    levels = cells.select("cell", F.explode(F.sequence(F.lit(first), F.lit(depth))).alias("d")).withColumn("prefix", F.expr("substring(cell, 1, d)"))
    fits = levels.join(by_prefix, ["d", "prefix"]).groupBy("cell").agg(F.min("d").alias("shard_bits"))
    return cells.select("cell").join(fits, "cell", "left")


def shards(docs: DataFrame, key: str = "doc_id", content: str = "text", limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """(key, shard, depth, page, bytes, shard_bytes, oversize) of each row; shard is the prefix of hash bits, '' for one shard.

    Only the key, the hash and the length are moved; a writer joins by key or partitions by ``shard`` afterwards.
    """
    size = F.coalesce(F.octet_length(F.col(content)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias(key), hash_bits(F.col(key), F.col(content)).alias("bits"), size.alias("bytes"))
    rows = written(rows, "hashed")
    done, left, parent = [], rows, 0
    for depth in range(STEP, BITS + 1, STEP):
        directory = written(_directory(_cells(left, depth), parent, depth, limit_bytes), f"directory{depth}")
        cells = F.broadcast(directory) if depth == STEP else directory  # the first directory has at most 2**STEP cells
        placed = left.withColumn("cell", F.substring("bits", 1, depth)).join(cells, "cell").drop("cell")
        done.append(placed.where("shard_bits is not null"))
        over = directory.where("shard_bits is null")
        if over.isEmpty():
            left = None
            break
        left, parent = written(placed.where("shard_bits is null").drop("shard_bits"), f"over{depth}"), depth
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = out.select(key, F.expr("substring(bits, 1, shard_bits)").alias("shard"), F.col("shard_bits").alias("depth"), F.lit(0).cast("long").alias("page"), "bytes")
    if left is not None:  # copies that agree in all bits
        copies = left.groupBy(key, "bits", "bytes").count()
        room = F.greatest(F.lit(1), F.expr(f"{limit_bytes} div greatest(bytes, 1)"))
        paged = copies.withColumn("i", F.explode(F.expr("sequence(0L, `count` - 1)"))).select(
            key, F.col("bits").alias("shard"), F.lit(BITS).alias("depth"), F.floor(F.col("i") / room).alias("page"), "bytes"
        )
        out = out.unionByName(paged)
    return out.withColumn("oversize", F.col("bytes") > limit_bytes)


def op2_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of at most 1 MiB of text over all documents."""
    return shards(table(spark, sf_dir, "documents"))


SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes,
    format('{{:032b}}', ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT) || format('{{:032b}}', ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 9, 8))::BIGINT) AS bits
  FROM documents),
node(prefix, d, total) AS (
  SELECT '', 0, coalesce(sum(bytes), 0)::BIGINT FROM hashed
  UNION ALL
  SELECT n.prefix || x.bit, n.d + 1, (SELECT coalesce(sum(bytes), 0)::BIGINT FROM hashed h WHERE left(h.bits, n.d + 1) = n.prefix || x.bit)
  FROM node n, (VALUES ('0'), ('1')) x(bit) WHERE n.total > {LIMIT_BYTES} AND n.d < 64)
SELECT doc_id, prefix AS shard, d AS depth, 0::BIGINT AS page, bytes, bytes > {LIMIT_BYTES} AS oversize
FROM hashed JOIN (SELECT prefix, d FROM node WHERE total <= {LIMIT_BYTES}) ON starts_with(bits, prefix)
"""
