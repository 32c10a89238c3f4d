"""Similarity of texts and vectors as joins and aggregations.

Long form everywhere: a text's stems or tokens are rows, pairs come from equi-joins on them, and sums are of integers where
they can be. Texts without the shared unit form no pair: their similarity is 0 (1 for two empty weighted sets, see
``weighted_jaccard``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.durable import written
from lodestone.functions.text import stems, tokens

#: Rows of query vectors that are sent to all tasks at once; more are handled in blocks.
QUERY_BLOCK, QUERY_BYTES = 100_000, 64 << 20
#: Pairs of vectors that are multiplied at once.
PAIRS = 1 << 20


def keyword_coverage(named: DataFrame, weights: DataFrame) -> DataFrame:
    """(item_id, doc_id, hit, total): the summed weight of the posting's terms that the item names or implies, and of all.

    ``named``: (item_id, canonical), closed under implication; ``weights``: (doc_id, term, w10). Pairs without a common
    term are absent.
    """
    totals = weights.groupBy("doc_id").agg(F.sum("w10").alias("total"))
    hit = weights.join(named.select("item_id", F.col("canonical").alias("term")), "term").groupBy("item_id", "doc_id").agg(F.sum("w10").alias("hit"))
    return hit.join(totals, "doc_id").select("item_id", "doc_id", "hit", "total")


def stem_counts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, stem, n)."""
    return texts.select(key, F.explode(stems(F.col(text))).alias("stem")).groupBy(key, "stem").agg(F.count("*").alias("n"))


def stem_cosine(a: DataFrame, b: DataFrame, ka: str, kb: str) -> DataFrame:
    """(ka, kb, cosine) of the stem counts of two tables of texts; pairs without a common stem are absent."""
    x, y = stem_counts(a, ka), stem_counts(b, kb)
    size = lambda t, k, name: t.groupBy(k).agg(F.sum(F.col("n") * F.col("n")).alias(name))
    dots = x.withColumnRenamed("n", "nx").join(y.withColumnRenamed("n", "ny"), "stem").groupBy(ka, kb).agg(F.sum(F.col("nx") * F.col("ny")).alias("dot"))
    return dots.join(size(x, ka, "sx"), ka).join(size(y, kb, "sy"), kb).select(ka, kb, (F.col("dot") / (F.sqrt("sx") * F.sqrt("sy"))).alias("cosine"))


def relevance(coverage: DataFrame, cosine: DataFrame) -> DataFrame:
    """(item_id, doc_id, bp): 0.7 of the coverage and 0.3 of the similarity, in ten-thousandths, rounded once."""
    both = coverage.join(cosine, ["item_id", "doc_id"], "full")
    score = 0.7 * F.coalesce(F.col("hit") / F.col("total"), F.lit(0.0)) + 0.3 * F.coalesce("cosine", F.lit(0.0))
    return both.select("item_id", "doc_id", F.round(F.round(score, 4) * 10_000).cast("long").alias("bp"))


def dot(a: Column, b: Column) -> Column:
    products = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: z["a"].cast("double") * z["b"].cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def vector_similarity(a: Column, b: Column) -> Column:
    """Dot product of unit vectors, kept within 0 and 1."""
    return F.least(F.greatest(dot(a, b), F.lit(0.0)), F.lit(1.0))


def embed(texts: DataFrame, encoder: Callable[[pd.Series], pd.Series], text: str = "text") -> DataFrame:
    """Adds ``embedding`` from a caller's own encoder, which gets batches of texts and gives lists of floats."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield encoder(batch)

    return texts.withColumn("embedding", run(F.col(text)))


def _lengths(vectors: pa.Array) -> np.ndarray:
    return np.nan_to_num(pc.list_value_length(vectors).to_numpy(zero_copy_only=False), nan=-1.0).astype(np.int64)  # null: -1


def _matrix(vectors: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(a row a vector, rows that are whole): those of length ``d`` without nulls; the others are 0."""
    n, sizes, flat = len(vectors), np.maximum(_lengths(vectors), 0), vectors.flatten()
    ok = sizes == d
    if flat.null_count:
        ok[np.repeat(np.arange(n), sizes)[~flat.is_valid().to_numpy(zero_copy_only=False)]] = False
    out = np.zeros((n, d))
    out[ok] = flat.to_numpy(zero_copy_only=False)[(np.cumsum(sizes) - sizes)[ok][:, None] + np.arange(d)]
    return out, ok


def _products(q: pa.Array, v: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, similarities of the queries from there on with all of ``v``): some PAIRS at once, kept within 0 and 1.

    Vectors of different lengths, with nulls, or null have similarity 0, and not a number counts as 1, as with ``vector_similarity``.
    """
    sides = [(_matrix(q, d), _matrix(v, d)) for d in np.intersect1d(_lengths(q), _lengths(v)) if d > 0]
    rows = max(1, PAIRS // max(1, len(v)))
    for i in range(0, len(q), rows):
        out = np.zeros((min(rows, len(q) - i), len(v)))
        for (x, fine), (y, whole) in sides:
            with np.errstate(invalid="ignore"):
                s = x[i : i + rows] @ y.T
            s = np.where(np.isnan(s), 1.0, np.clip(s, 0.0, 1.0))
            out = s if len(sides) == 1 and fine.all() and whole.all() else np.where(np.outer(fine[i : i + rows], whole), s, out)
        yield i, out


def _first(q: pa.Array, v: pa.Array, ids: pa.Array, items: pa.Array, k: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """(query ids, item ids, similarities to six places) of the k best ``items`` of each of the queries ``ids``, ties by id, never its own."""
    order = pc.sort_indices(items)
    items, v = items.take(order), v.take(order)
    names = pc.index_in(ids, items).to_numpy(zero_copy_only=False)  # the place of the query itself among the items
    for i, s in _products(q, v):
        n, m = s.shape
        millionths = np.floor(s * 1e6 + 0.5).astype(np.int64)
        key = (1_000_001 - millionths) * m + np.arange(m)  # of equal ones the first by id
        for row in np.flatnonzero(~np.isnan(names[i : i + n])) if m else ():
            same = items.slice(int(names[i + row]))
            for at in range(len(same)):
                if same[at] != ids[i + int(row)]:
                    break
                key[row, int(names[i + row]) + at] = np.iinfo(np.int64).max
        best = np.argpartition(key, k - 1, axis=1)[:, :k] if m > k else np.broadcast_to(np.arange(m), (n, m))
        rows = np.repeat(np.arange(n), best.shape[1])
        cols = best.ravel()
        kept = key[rows, cols] < np.iinfo(np.int64).max
        rows, cols = rows[kept], cols[kept]
        yield ids.take(pa.array(rows + i)), items.take(pa.array(cols)), millionths[rows, cols] / 1e6


def _query_blocks(queries: DataFrame) -> Iterator[Broadcast]:
    """The queries with unit vectors, in blocks of some QUERY_BLOCK rows and QUERY_BYTES, as Arrow tables in all tasks."""
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long") * 8), F.lit(0))).first()
    blocks = max(1, -(-n // QUERY_BLOCK), -(-size // QUERY_BYTES))
    for i in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i) if blocks > 1 else queries
        yield queries.sparkSession.sparkContext.broadcast(part.withColumn("v", unit(F.col("v"))).toArrow().combine_chunks())


def _only(batch: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    column = batch.column(name)
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop("v").schema)


def against_all(queries: DataFrame, items: DataFrame) -> DataFrame:
    """Every query (query_id, v, ...) with every item (item_id, v, ...) of another id, and their ``similarity``.

    The queries are a stated set: they are counted and go to the tasks in blocks, so no side is sent whole. A task multiplies its
    items' unit vectors by a block's, some PAIRS at once.
    """
    units = items.withColumn("v", unit(F.col("v")))
    schema = f"{_fields(items)}, {_fields(queries)}, similarity double"
    out = None
    for known in _query_blocks(queries):

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            asked = known.value
            for batch in batches:
                for i, s in _products(_only(asked, "v"), batch.column("v")) if len(batch) else ():
                    n, m = s.shape
                    rows, cols = pa.array(np.repeat(np.arange(i, i + n), m)), pa.array(np.tile(np.arange(m), n))
                    left, right = batch.drop_columns("v").take(cols), asked.drop_columns("v").take(rows).combine_chunks()
                    every = [*left.columns, *[_only(right, c) for c in right.column_names], pa.array(s.ravel())]
                    yield pa.RecordBatch.from_arrays(every, names=[*left.schema.names, *right.column_names, "similarity"])

        pairs = units.mapInArrow(run, schema).where("query_id <> item_id")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def nearest(queries: DataFrame, items: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, item_id, similarity): each query's k most similar items, ties by id.

    ``queries`` (query_id, v) is a stated set, held against all ``items`` (item_id, v); the best k of each batch leave a task.
    """
    queries, items = queries.select("query_id", "v").where("query_id is not null"), items.select("item_id", "v").where("item_id is not null")
    schema, out = f"{_fields(queries)}, {_fields(items)}, similarity double", None
    for known in _query_blocks(queries):

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            asked = known.value
            for batch in batches:
                for found in _first(_only(asked, "v"), batch.column("v"), _only(asked, "query_id"), batch.column("item_id"), k) if len(batch) else ():
                    yield pa.RecordBatch.from_arrays([*found[:2], pa.array(found[2])], names=["query_id", "item_id", "similarity"])

        pairs = items.withColumn("v", unit(F.col("v"))).mapInArrow(run, schema)
        out = pairs if out is None else out.unionByName(pairs)
    return _ranked(out, k)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "item_id"))
    return pairs.withColumn("r", rank).where(F.col("r") <= k).drop("r")


#: Rows that the cells are fitted on at most, and items of a cell's part on average.
CELL_SAMPLE, PART_ITEMS = 20_000, 5_000
#: Queries of the sample that choose the number of probes.
TRIED = 200


def _cells_of(rows: DataFrame, key: str, centres: np.ndarray, n: int, out: str) -> DataFrame:
    """(key, v, out): unit vectors with their ``n`` nearest cells, nearest first; no shuffle."""
    known = rows.sparkSession.sparkContext.broadcast(centres)  # a row a cell; cells are bounded by the sample

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        near = np.argsort(-np.stack(vectors.to_list()) @ known.value.T, axis=1, kind="stable")[:, :n]
        return pd.Series(list(near.astype(np.int32)))

    return rows.select(key, unit(F.col("v")).alias("v")).withColumn(out, cells("v"))


def fitted_cells(items: DataFrame, k: int, recall: float) -> tuple[np.ndarray, int]:
    """(centres, probes): cells of unit vectors, and how many a query must look into for ``recall`` of its k nearest.

    Both come from a sample of at most CELL_SAMPLE items by the hash of their ids. The probes are the fewest that find that share
    of the k nearest in the sample for TRIED of its items.
    """
    sample = items.select("item_id", unit(F.col("v")).alias("v")).orderBy(F.xxhash64("item_id"), "item_id").limit(CELL_SAMPLE).toPandas()  # bounded
    if not len(sample):
        return np.zeros((0, 0)), 0
    vectors = np.stack(sample["v"].to_list())
    rng = np.random.Generator(np.random.PCG64(5))
    m = max(1, min(len(vectors), int(np.sqrt(len(vectors) * 4)), 1024))
    centres = vectors[rng.choice(len(vectors), m, replace=False)]
    for _ in range(12):
        own = np.argmax(vectors @ centres.T, axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, vectors)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centres)
    own = np.argmax(vectors @ centres.T, axis=1)
    asked = vectors[:TRIED]
    best = np.argsort(-(asked @ vectors.T) + 2 * np.eye(len(asked), len(vectors)), axis=1, kind="stable")[:, :k]  # not itself
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[best], axis=1).ravel())
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def approximate_nearest(queries: DataFrame, items: DataFrame, k: int = 3, recall: float = 0.95) -> DataFrame:
    """(query_id, item_id, similarity): about each query's k most similar items, ties by id; both sides may be large.

    Every item is in its nearest cell; a query looks into as many cells as the sample asks for, so both sides are shuffled by cell
    and neither is sent whole. A cell of many items, such as copies, is dealt to parts by hash, each of which gets its queries. Similarities are
    exact; only items in cells not looked into can be missed. Rows with null or empty vectors have no cell.
    """
    good = lambda t: t.where(F.size("v") > 0)
    centres, probes = fitted_cells(good(items), k, recall)
    if not probes:
        return queries.select("query_id").crossJoin(items.select("item_id")).withColumn("similarity", F.lit(0.0)).limit(0)
    inside = written(_cells_of(good(items), "item_id", centres, 1, "cell").withColumn("cell", F.col("cell")[0]).withColumnRenamed("v", "iv"), "cells")
    parts = inside.groupBy("cell").agg(F.ceil(F.count("*") / PART_ITEMS).cast("int").alias("parts"))  # a row a cell
    dealt = inside.join(F.broadcast(parts), "cell").select("cell", F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int").alias("part"), "item_id", "iv")
    asked = _cells_of(good(queries), "query_id", centres, probes, "cells").select("query_id", F.col("v").alias("qv"), F.explode("cells").alias("cell"))
    asked = asked.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, similarity double"
    names = ["query_id", "item_id", "similarity"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _first(_only(left, "qv"), _only(right, "iv"), _only(left, "query_id"), _only(right, "item_id"), k) if len(left) and len(right) else ()
        parts = [pa.Table.from_arrays([*x[:2], pa.array(x[2])], names=names) for x in found]
        return pa.concat_tables(parts) if parts else pa.table({"query_id": left.column("query_id").slice(0, 0), "item_id": right.column("item_id").slice(0, 0), "similarity": pa.array([], pa.float64())})

    return _ranked(asked.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInArrow(best, schema), k)


def nearest_texts(queries: DataFrame, items: DataFrame, k: int = 3) -> DataFrame:
    """(query_id, item_id, similarity): each text's k most similar texts of ``items`` by stem cosine, ties by id; never the one of its own id.

    Both are (id, text) with distinct ids. Pairs with a common stem come from an equi-join; all others have similarity 0, and of
    those only the first k + 1 items by id can be among a query's best k, as each item before them is similar or the query itself.
    """
    x, y = queries.select(F.col("id").alias("query_id"), "text"), items.select(F.col("id").alias("item_id"), "text")
    alike = stem_cosine(x, y, "query_id", "item_id").select("query_id", "item_id", F.round("cosine", 6).alias("similarity"))
    first = y.select("item_id").orderBy("item_id").limit(k + 1)
    others = x.select("query_id").crossJoin(F.broadcast(first)).withColumn("similarity", F.lit(0.0))  # k + 1 rows
    pairs = alike.unionByName(others).where(F.col("query_id") != F.col("item_id"))
    best = pairs.groupBy("query_id", "item_id").agg(F.max("similarity").alias("similarity"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("similarity").desc(), "item_id"))
    return best.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def grounding(texts: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, words, grounded): the stems of each text, and those that its sources hold, wholly or by a 5-character beginning.

    ``texts`` and ``sources`` are (keys, stem) in long form, one row an occurrence. A share is grounded / words.
    """
    full = sources.select(*keys, "stem").distinct().withColumn("whole", F.lit(True))
    part = sources.where(F.length("stem") >= 5).select(*keys, F.substring("stem", 1, 5).alias("start")).distinct().withColumn("begun", F.lit(True))
    rows = texts.withColumn("start", F.when(F.length("stem") >= 5, F.substring("stem", 1, 5)))
    found = rows.join(full, [*keys, "stem"], "left").join(part, [*keys, "start"], "left")
    return found.groupBy(*keys).agg(F.count("*").alias("words"), F.count_if(F.col("whole") | F.coalesce("begun", F.lit(False))).alias("grounded"))


def token_jaccard(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds ``common`` and ``all_`` counts of the distinct lower-case tokens of two text columns."""
    x, y = tokens(F.col(a)), tokens(F.col(b))
    return pairs.withColumn("common", F.size(F.array_intersect(x, y))).withColumn("all_", F.size(F.array_union(x, y)))


def weighted_jaccard(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, b, low, high): summed lesser and greater weights over the union of terms; low / high is the similarity, 1 if both are 0.

    ``pairs``: (a, b) of ids in ``weights`` (doc_id, term, w10). high = total(a) + total(b) - low.
    """
    weights = written(weights, "weights")
    left, right = ([F.col("doc_id").alias(k), "term", F.col("w10").alias(f"w{k}")] for k in "ab")
    common = pairs.join(weights.select(*left), "a").join(weights.select(*right), ["b", "term"]).groupBy("a", "b").agg(F.sum(F.least("wa", "wb")).alias("low"))
    total = weights.groupBy("doc_id").agg(F.sum("w10").alias("t"))
    out = pairs.join(common, ["a", "b"], "left").join(total.select(F.col("doc_id").alias("a"), F.col("t").alias("ta")), "a", "left").join(
        total.select(F.col("doc_id").alias("b"), F.col("t").alias("tb")), "b", "left"
    )
    low = F.coalesce("low", F.lit(0))
    return out.select("a", "b", low.alias("low"), (F.coalesce("ta", F.lit(0)) + F.coalesce("tb", F.lit(0)) - low).alias("high"))


def pair_separation(scored: DataFrame) -> DataFrame:
    """One row from (bp, same): ranges of the scores of like and unlike pairs, the best threshold by accuracy, and whether one separates them.

    A pair is called alike at a score of the threshold or more; ties go to the lowest threshold. The scores are first counted by
    value, of which there are at most 10,001.
    """
    by = written(scored.groupBy("bp").agg(F.count_if("same").alias("yes"), F.count_if(~F.col("same")).alias("no")), "scores")
    down = W.orderBy(F.col("bp").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    swept = by.withColumn("right", F.sum("yes").over(down) + F.sum("no").over(every) - F.sum("no").over(down))
    best = swept.agg(F.min(F.struct(-F.col("right"), "bp"))["bp"].alias("threshold"), F.max("right").alias("right"), F.sum(F.col("yes") + F.col("no")).alias("pairs"))
    ends = by.agg(*[f(F.when(F.col(side) > 0, F.col("bp"))).alias(f"{name}_{f.__name__}") for side, name in (("yes", "same"), ("no", "other")) for f in (F.min, F.max)])
    return ends.crossJoin(best).withColumn("separates", F.col("right") == F.col("pairs"))  # one row each
