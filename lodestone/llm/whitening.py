"""Whitening of embeddings by distributed block matrices.

Each entry c of a vector becomes the integer floor(scale * c) + shift. The covariance is fitted on the distinct integer vectors,
each counted once, so copies, however many, weigh nothing; all rows are then projected. Rows are centred, indexed and cut into
the blocks of a Spark MLlib ``BlockMatrix``; the transpose times the matrix gives the scatter, whose eigenvectors are found
locally (one number for each pair of dimensions), and multiplying the blocks by the whitening matrix projects the rows.

An index is the row's task when it was written times a stride, plus its place there; indices that no row has are rows of zeros,
which add nothing. Block matrices take ``CHUNK_BLOCKS`` blocks at a time, so that the block numbers, which MLlib gathers at
the driver, are bounded too; scatters of several add up. The product over rows is split ``MIDDLE`` ways, else the one block of
the result would draw all rows to one task.

Rows with a null vector, or with a null or non-finite entry, give no rows; neither do vectors of another length than
most have (of equally common lengths the longer counts), which have no place in the space, nor vectors of no length. Null and
repeated ids are kept row by row. Components without variance have a null ``whitened``; their ``explained`` is 0, or null if nothing
varies. ``identity_error`` is over the components that vary, null without any. A deviation that does not fit in 64 bits is null. Sums
of entries are exact while they fit in 64 bits. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.durable import Scratch, written
from lodestone.sources import table

SCALE, SHIFT, COMPONENTS = 256, 0, 4
#: Rows and columns of a block, blocks of a matrix, and splits of the sum over rows.
BLOCK_ROWS, BLOCK_COLS, CHUNK_BLOCKS, MIDDLE = 2048, 1024, 1 << 16, 64
#: A component varies if its eigenvalue is over this share of all.
NOISE = 1e-12


def integers(rows: DataFrame, vector: str, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """The vector's integer entries; null if it is null, empty, or holds a null or non-finite entry."""
    fit = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return F.when(fit & (F.size(vector) > 0), F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + shift))


def indexed(rows: DataFrame, here: Scratch, label: str) -> tuple[DataFrame, int]:
    """``rows`` written with ``index``, and the bound of the index: rows of one task stand together, from a multiple of BLOCK_ROWS."""
    placed = here.written(rows.withColumn("_at", F.monotonically_increasing_id()), label)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    parts, most = placed.agg(F.coalesce(F.max(part) + 1, F.lit(0)), F.coalesce(F.max(place) + 1, F.lit(0))).first()
    stride = -(-most // BLOCK_ROWS) * BLOCK_ROWS
    return placed.withColumn("index", part * stride + place).drop("_at"), parts * stride


def sums(fit: DataFrame, dims: int) -> tuple[int, np.ndarray]:
    """The number of vectors ``x`` and the sum of each dimension: one row a task and dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            total += batch.column(0).flatten().to_numpy().reshape(-1, dims).sum(axis=0)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(dims), pa.int32()), pa.array(total), pa.array([n] * dims, pa.int64())], names=["d", "total", "n"])

    found = fit.select("x").mapInArrow(run, "d int, total long, n long").groupBy("d").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = np.zeros(dims, np.int64)
    for r in found:  # a row a dimension
        out[r["d"]] = r["total"]
    return (found[0]["n"] if found else 0), out


def _matrices(rows: DataFrame, bound: int, mean: np.ndarray) -> Iterator[tuple[int, BlockMatrix]]:
    """(first index, block matrix) of the centred rows, a chunk of blocks at a time."""
    centred = F.zip_with("x", F.lit(mean.tolist()), lambda c, m: c - m)
    step, cols = BLOCK_ROWS * CHUNK_BLOCKS, min(BLOCK_COLS, len(mean))
    for low in range(0, bound, step):
        chunk = rows.where(F.col("index").between(low, low + step - 1)).select((F.col("index") - low).alias("index"), array_to_vector(centred).alias("vector"))
        yield low, IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(chunk, "vector"), min(step, bound - low), len(mean)).toBlockMatrix(BLOCK_ROWS, cols)


def scatter(rows: DataFrame, bound: int, mean: np.ndarray) -> np.ndarray:
    """The transpose of the centred rows times themselves."""
    out = np.zeros((len(mean), len(mean)))
    for _, x in _matrices(rows, bound, mean):
        product = x.transpose()._java_matrix_wrapper.call("multiply", x._java_matrix_wrapper._java_model, MIDDLE)
        out += BlockMatrix(product, x.colsPerBlock, x.colsPerBlock).toLocalMatrix().toArray()
    return out


def project(rows: DataFrame, bound: int, mean: np.ndarray, matrix: np.ndarray, label: str) -> DataFrame:
    """(index, y): the centred rows times ``matrix``, and zeros for indices without a row."""
    spark, dims, k = rows.sparkSession, *matrix.shape
    out = spark.createDataFrame([], "index long, y array<double>")
    for low, x in _matrices(rows, bound, mean):
        cols = x.colsPerBlock
        parts = [((i // cols, 0), Matrices.dense(len(matrix[i : i + cols]), k, matrix[i : i + cols].ravel(order="F").tolist())) for i in range(0, dims, cols)]
        y = x.multiply(BlockMatrix(spark.sparkContext.parallelize(parts), cols, k)).toIndexedRowMatrix()
        found = callMLlibFunc("getIndexedRows", y._java_matrix_wrapper._java_model)
        out = out.unionByName(written(found.select((F.col("index") + low).alias("index"), vector_to_array("vector").alias("y")), label))
    return out


def eigen(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    e, u = np.linalg.eigh(covariance)
    return e[::-1][:k], u[:, ::-1][:, :k]


def whiten(docs: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each row and component."""
    with Scratch() as here:
        valid = docs.select(F.col(key), integers(docs, vector, scale, shift).alias("x")).where("x is not null")
        every, bound = indexed(valid, here, "vectors")
        sizes = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dims = sizes["d"] if sizes else 0
        if not dims:
            return docs.select(F.col(key)).limit(0).selectExpr(
                f"`{key}`", "cast(null as int) component", "cast(null as long) n", "cast(null as long) deviation", "cast(null as double) whitened",
                "cast(null as double) explained", "cast(null as double) identity_error",
            )
        every = every.where(F.size("x") == dims)
        fit, fit_bound = indexed(every.select("x").distinct(), here, "distinct_vectors")
        n, total = sums(fit, dims)
        mean = total / n
        covariance = scatter(fit, fit_bound, mean) / n
        trace = float(np.trace(covariance))
        values, vectors = eigen(covariance, min(k, dims))
        varies = values > max(trace * NOISE, 0.0)
        whitening = vectors * np.where(varies, 1 / np.sqrt(np.where(varies, values, 1.0)), 0.0)

        seen = fit.select("index").join(project(fit, fit_bound, mean, whitening, "fit_projected"), "index")
        pairs = [(i, j) for i in range(len(values)) for j in range(i + 1) if varies[i] and varies[j]]
        found = seen.agg(*[F.covar_pop(F.col("y")[i], F.col("y")[j]) for i, j in pairs]).first() if pairs else []  # centred, divided by n
        error = max((abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True)), default=None)

        off = F.zip_with("x", F.lit(total.tolist()), lambda c, s: F.try_subtract(F.try_multiply(c, F.lit(n).cast("long")), s))
        deviation = F.aggregate(off, F.lit(0).cast("long"), lambda acc, d: F.try_add(acc, F.try_multiply(d, d)))
        rows = every.select(key, "index", deviation.alias("deviation")).join(project(every, bound, mean, whitening, "projected"), "index")
        of = [
            F.struct(
                F.lit(i + 1).alias("component"), (F.col("y")[i] if varies[i] else F.lit(None).cast("double")).alias("whitened"),
                F.lit((float(values[i]) / trace if varies[i] else 0.0) if trace else None).cast("double").alias("explained"),
            )
            for i in range(len(values))
        ]
        out = rows.select(key, "deviation", F.explode(F.array(*of)).alias("c")).select(
            key, F.col("c.component"), F.lit(n).cast("long").alias("n"), "deviation", F.col("c.whitened"), F.col("c.explained"), F.lit(error).cast("double").alias("identity_error")
        )
        return written(out, "whitened")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on the four strongest components."""
    return whiten(table(spark, sf_dir, "embeddings"))
