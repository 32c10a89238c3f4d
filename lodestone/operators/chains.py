"""Chains of anchors: the first point of a key is one, and each next anchor is the first point at least ``step`` after the one before.

Which points are anchors looks sequential: each depends on the one before. Points are sorted into ranges, a task each, and a key
with many points fills many ranges. Within a range every point knows the end of the chain that would enter there: it is found
for all points at once by doubling, so a range is a function from the earliest time the next anchor may have to that time after
the range. It is a step function with a row for each different end. Functions of neighbouring ranges of a key are put together by
doubling as well, in as many rounds as the logarithm of the ranges of the largest key, which gives every range its true entry; a
last pass marks the anchors from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lodestone.durable import Scratch, written
from lodestone.operators.ranges import range_count


def _after(at: np.ndarray, step: int) -> np.ndarray:
    """For each point the first one at least ``step`` later; the number of points if there is none."""
    return np.searchsorted(at, at + step, "left")


def _ends(at: np.ndarray, step: int) -> np.ndarray:
    """When the next anchor may come after the chain that enters at each point has left these points."""
    n = len(at)
    up = np.append(_after(at, step), n)
    end = np.arange(n + 1)
    while True:  # a point takes its successor's end, distances double
        last = up[end] == n
        if last[:-1].all():
            return at[end[:-1]] + step
        end = np.where(last, end, up[end])
        nxt = up[up]
        up = np.where(nxt == n, up, nxt)


def _pieces(batches: Iterator[pa.RecordBatch], by: list[int]) -> Iterator[pa.Table]:
    """Runs of rows with equal values in the columns ``by``, from sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.zeros(batch.num_rows, np.int64)
        for i in by:
            part = batch.column(i).dictionary_encode(null_encoding="encode")
            codes = codes * (len(part.dictionary) + 1) + part.indices.to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            name = tuple(batch.column(i)[a].as_py() for i in by)
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = name
    if held:
        yield pa.Table.from_batches(held)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def anchors(points: DataFrame, step: int) -> DataFrame:
    """Points (key, at, id) with ``anchor_at`` and ``anchor_id``, the anchor at or before each, and ``nth``, its number from 0.

    ``at`` and ``id`` are long and not null; ties in time go by id. A null key is a key of its own.
    """
    rows = points.select("key", F.col("at").cast("long"), F.col("id").cast("long"))
    with Scratch() as here:
        order = ["key", "at", "id"]
        dealt = rows.repartitionByRange(range_count(rows), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
        dealt = here.written(dealt, "points")
        spans = here.written(dealt.groupBy("key", "part").agg(F.min(F.struct("at", "id")).alias("first")), "spans")
        own = W.partitionBy("key").orderBy("part")  # a row for each range that a key is in
        spans = here.written(spans.withColumn("piece", F.row_number().over(own) - 1).withColumn("pieces", F.count("*").over(W.partitionBy("key"))), "pieces")
        same = [F.col("p.key").eqNullSafe(F.col("s.key")), F.col("p.part") == F.col("s.part")]

        # a function for each piece of a key in several ranges: up to ``brk`` the next anchor may come at ``val``
        wide = dealt.alias("p").join(spans.where("pieces > 1").alias("s"), same).select("p.key", "piece", "at", "id")
        shape = wide.select("key", F.col("piece").cast("long").alias("piece"), F.col("at").alias("brk"), F.col("at").alias("val")).schema
        arrow = to_arrow_schema(shape)

        def functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _pieces(batches, [0, 1]):
                at = _numbers(t, "at")
                val = _ends(at, step)
                keep = np.flatnonzero(np.append(val[1:] != val[:-1], True))
                yield pa.RecordBatch.from_arrays([t.column("key").take(pa.array(keep)).combine_chunks(), t.column("piece").cast(pa.int64()).take(pa.array(keep)).combine_chunks(), pa.array(at[keep]), pa.array(val[keep])], schema=arrow)

        sorted_ = wide.repartition("key", "piece").sortWithinPartitions("key", "piece", "at", "id")
        jump = here.written(sorted_.mapInArrow(functions, shape), "functions")
        # the time from which the next anchor may come when a piece is entered; known for the first piece
        entry = here.written(spans.where("pieces > 1 and piece = 0").select("key", F.lit(0).cast("long").alias("piece"), F.col("first.at").alias("at")), "entries")
        most = spans.agg(F.max("pieces")).first()[0] or 1

        def looked_up(asked: DataFrame, reach: int) -> DataFrame:
            """(key, piece, brk, val) of ``asked`` with ``val`` put through the function of the piece ``reach`` further."""
            ask = asked.select("key", (F.col("piece") + reach).alias("to"), F.lit(1).alias("kind"), F.col("val").alias("at"), "piece", "brk")
            told = jump.select("key", F.col("piece").alias("to"), F.lit(0).alias("kind"), F.col("brk").alias("at"), "piece", F.col("val").alias("brk"))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for t in _pieces(batches, [0, 1]):
                    kind, at, brk = _numbers(t, "kind"), _numbers(t, "at"), _numbers(t, "brk")
                    f, q = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
                    i = np.searchsorted(at[f], at[q], "left")
                    val = np.where(i < len(f), np.append(brk[f], 0)[i], at[q])  # beyond the last point a piece changes nothing
                    back = t.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([back.column("key").combine_chunks(), back.column("piece").combine_chunks(), pa.array(brk[q]), pa.array(val)], schema=arrow)

            both = told.unionByName(ask).repartition("key", "to").sortWithinPartitions("key", "to", "kind", "at")
            return both.mapInArrow(run, shape)

        reach = 1
        while reach < most:
            # entries known up to ``reach`` pieces in give those up to twice as far: each passes the pieces before
            passed = entry.select("key", "piece", F.col("at").alias("brk"), F.col("at").alias("val"))
            far = looked_up(passed, 0).select("key", (F.col("piece") + reach).alias("piece"), F.col("val").alias("at"))
            known = spans.where("pieces > 1").groupBy("key").agg(F.max("pieces").alias("n")).alias("k")
            far = far.alias("f").join(known, F.col("f.key").eqNullSafe(F.col("k.key"))).where("piece < n").select("f.key", "piece", "at")
            entry = here.written(entry.unionByName(far), "entries")
            if 2 * reach < most:
                jump = here.written(looked_up(jump, reach), "functions")  # from each piece, twice as many pieces
            reach *= 2

        entries = entry.alias("e")
        starts = spans.alias("s").join(entries, F.col("s.key").eqNullSafe(F.col("e.key")) & (F.col("s.piece") == F.col("e.piece")), "left")
        starts = here.written(starts.select("s.key", "s.part", "s.piece", F.coalesce("e.at", F.col("s.first")["at"]).alias("open")), "starts")

        # the anchors of each piece from its entry on; those before belong to the last anchor of an earlier piece
        out = dealt.alias("p").join(starts.alias("s"), same).select("p.key", "p.part", "at", "id", "piece", "open")
        shown = rows.select("key", F.lit(0).alias("part"), "at", "id", F.lit(0).alias("piece"), F.col("at").alias("anchor_at"), F.col("at").alias("anchor_id"), F.col("at").alias("local")).schema
        marked_arrow = to_arrow_schema(shown)

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in _pieces(batches, [0, 1]):
                at, ids = _numbers(t, "at"), _numbers(t, "id")
                up, chosen, i = _after(at, step).tolist(), [], int(np.searchsorted(at, t.column("open")[0].as_py(), "left"))
                while i < len(at):
                    chosen.append(i)
                    i = up[i]
                nth = np.searchsorted(np.array(chosen, np.int64), np.arange(len(at)), "right")  # anchors so far
                none = nth == 0
                first = np.array(chosen or [0])[np.maximum(nth - 1, 0)]
                columns = [pa.array(x, pa.int64(), mask=none) for x in (at[first], ids[first])]
                kept = [t.column(c).combine_chunks() for c in ("key", "part", "at", "id", "piece")]
                yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array(nth.astype(np.int64))], schema=marked_arrow)

        done = here.written(out.repartition("key", "part").sortWithinPartitions("key", "part", "at", "id").mapInArrow(marked, shown), "marked")
        # what the pieces before hold: their anchors' number, and the last of them
        last = done.groupBy("key", "piece").agg(F.max("local").alias("n"), F.max(F.when(F.col("anchor_at").isNotNull(), F.struct("anchor_at", "anchor_id"))).alias("last"))
        earlier = W.partitionBy("key").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
        before = last.select("key", "piece", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("sum"), F.last("last", ignorenulls=True).over(earlier).alias("last"))
        full = done.alias("d").join(before.alias("b"), F.col("d.key").eqNullSafe(F.col("b.key")) & (F.col("d.piece") == F.col("b.piece")))
        return written(full.select(
            "d.key", "at", "id", F.coalesce("anchor_at", F.col("last")["anchor_at"]).alias("anchor_at"), F.coalesce("anchor_id", F.col("last")["anchor_id"]).alias("anchor_id"),
            (F.col("sum") + F.col("local") - 1).alias("nth"),
        ), "anchors")
