"""Location of stated passages in documents: one pass over the text for a block of passages, no join and no shuffle of lines.

Text is compared in NFKC, without white space, with look-alikes of the hyphen folded. A passage begins in a line that holds
its first ``START`` characters (all of a shorter passage) and must be complete within ``SPAN`` lines. Every place in a text is
hashed at the lengths of the beginnings, all places at once; a small table of the beginnings' hashes leaves the few places that
are then compared in full, so what leaves a task is in proportion to the hits.

``passages`` (item_id, text) is a stated set of queries; it goes to the tasks in blocks of ``BLOCK`` rows and ``BLOCK_BYTES``, one
pass over the documents for each block. Null and blank texts hold nothing and are found nowhere. Rows that repeat an id are
searched one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.folds import ordered_fold
from lodestone.operators.squeeze import squeezed

#: Characters of a passage's beginning that must stand in one line, and lines that a passage may span.
START, SPAN = 14, 8
BLOCK, BLOCK_BYTES = 1 << 17, 64 << 20
#: Characters that are hashed at once; a longer text is one buffer.
_BUFFER = 1 << 20
#: Hits that leave a task at once.
HITS = 1 << 12
_BASE = 0x9E3779B97F4A7C15
_BITS = 20


def _windows(c: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the characters from each place on): windows of 1, 2, 4, 8 characters are put together."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    whole = {1: c}
    while 2 * max(whole) <= max(lengths):
        k = max(whole)
        h = whole[k]
        whole[2 * k] = h[:-k] * power(k) + h[k:] if len(h) > k else h[:0]
    for n in lengths:
        if n <= len(c):
            out, done = None, 0
            for k in sorted(whole, reverse=True):
                if n & k:
                    part = whole[k][done : done + len(c) - n + 1]
                    out = part if out is None else out * power(k) + part
                    done += k
            yield n, out


class Finder:
    """A block of passages, ready to be looked for."""

    def __init__(self, passages: list[str]) -> None:
        self.passages = passages
        self.of: dict[str, list[int]] = {}
        for i, p in enumerate(passages):
            self.of.setdefault(p[:START], []).append(i)
        self.lengths = sorted({len(s) for s in self.of})
        self.table = {n: np.zeros(1 << _BITS, bool) for n in self.lengths}
        self.hashes = {}
        for n in self.lengths:
            c = np.frombuffer("".join(s for s in self.of if len(s) == n).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
            h = np.sort(next(_windows(c, [n]))[1][::n])
            self.hashes[n] = h
            self.table[n][h >> np.uint64(64 - _BITS)] = True

    def starts(self, text: str) -> Iterator[tuple[int, str]]:
        """(place, beginning) wherever a beginning stands in ``text``."""
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        for n, h in _windows(c, self.lengths) if len(c) and self.lengths else ():
            at = np.flatnonzero(self.table[n][h >> np.uint64(64 - _BITS)])
            known = self.hashes[n]
            near = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
            for i in at[known[near] == h[at]].tolist():
                s = text[i : i + n]
                if s in self.of:
                    yield i, s

    def hits(self, texts: list[str]) -> Iterator[tuple[int, int, int, int | None, str | None]]:
        """(text, passage, first line, last line or None, span) for each line that holds a passage's beginning."""
        at, whole = np.cumsum([0, *(len(t) + 1 for t in texts)]), "\n".join(texts)
        breaks = np.flatnonzero(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4") == 10)
        seen = set()
        for place, s in self.starts(whole):
            row = int(np.searchsorted(at, place, "right")) - 1
            line = int(np.searchsorted(breaks, place))  # over all texts of the buffer
            begin = int(breaks[line - 1]) + 1 if line else 0
            zero = int(np.searchsorted(breaks, at[row]))
            window = None
            for i in self.of[s]:
                if (line, i) not in seen:
                    seen.add((line, i))
                    window = window or whole[begin : min(int(at[row + 1]) - 1, int(breaks[line + SPAN - 1]) if line + SPAN - 1 < len(breaks) else len(whole))].split("\n")
                    found = "".join(window).find(self.passages[i])
                    if found < 0:
                        yield row, i, line - zero, None, None
                    else:
                        n = int(np.searchsorted(np.cumsum([len(x) for x in window]), found + len(self.passages[i])))
                        yield row, i, line - zero, line - zero + n, "".join(window[: n + 1])


def _buffers(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        if held and size + len(t) > _BUFFER:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield first, held


def _found(batches: Iterator[pa.RecordBatch], ids: pa.Array, finder: Finder) -> Iterator[pa.RecordBatch]:
    """The hits in batches of (doc_id, text); those of a buffer are handed on some HITS at once, so no batch's hits are held together."""
    names = ["doc_id", "item_id", "first", "last", "span", "passage"]
    for batch in batches:
        for first, texts in _buffers(batch.column(1).to_pylist()):
            hits = finder.hits(texts)
            while found := list(islice(hits, HITS)):
                rows, items, lines, ends, spans = zip(*found, strict=True)
                columns = [batch.column(0).take(pa.array([first + r for r in rows], pa.int32())), ids.take(pa.array(items, pa.int32())), pa.array(lines, pa.int32()), pa.array(ends, pa.int32()), pa.array(spans, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([finder.passages[i] for i in items], pa.string())], names=names)


def passage_hits(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, first, last, span, passage): every line that holds a passage's beginning.

    ``last`` is the last line that the passage needs and ``span`` the lines up to it, null if ``SPAN`` lines do not hold it.
    """
    spark = docs.sparkSession
    wanted = squeezed(passages.select("item_id", "text"), "text", "p").where("p <> ''").select("item_id", "p")
    n, size = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("p").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_BYTES))
    bodies = squeezed(docs.select("doc_id", F.regexp_replace("text", "\\R", "\n").alias("text")).where("text is not null"), "text", "body", "[^\\S\\n]+").select("doc_id", "body")
    kinds = docs.schema["doc_id"].dataType.simpleString(), passages.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        block = (wanted.where(F.pmod(F.xxhash64("item_id", "p"), F.lit(blocks)) == b) if blocks > 1 else wanted).toArrow()  # BLOCK rows, about
        known = spark.sparkContext.broadcast((block.column("item_id").combine_chunks(), Finder(block.column("p").to_pylist())))

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            return _found(batches, *known.value)

        hits = bodies.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, first int, last int, span string, passage string")
        out = hits if out is None else out.unionByName(hits)
    return out


def locate_passages(hits: DataFrame) -> DataFrame:
    """(doc_id, item_id, first, last) of each passage that is complete from the first line that holds its beginning."""
    first = hits.groupBy("doc_id", "item_id").agg(F.min(F.struct("first", "last")).alias("b"))
    return first.select("doc_id", "item_id", "b.first", "b.last").where("last is not null")


def locate_in_order(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, first, last) of passages looked for in order of ``ord``: each search starts after the place found before.

    Only the first line from there that holds the beginning counts. A passage that is not found leaves the cursor and has nulls.
    ``passages``: (item_id, ord).
    """
    places = hits.groupBy("doc_id", "item_id").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("places"))
    flat = F.array_join(F.transform("places", lambda p: F.concat_ws(":", p["first"].cast("string"), p["last"].cast("string"))), ",")
    rows = places.join(passages.select("item_id", "ord"), "item_id").select("doc_id", "ord", "item_id", flat.alias("places"))

    def step(cursor: int, row: tuple) -> tuple:
        for place in row[3].split(","):
            first, _, last = place.partition(":")
            if int(first) >= cursor:
                return (int(last) + 1, (first, last)) if last else (cursor, (None, None))
        return cursor, (None, None)

    out = ordered_fold(rows, ["doc_id"], ["ord"], lambda: 0, step, "first string, last string")
    return out.select("doc_id", "item_id", F.col("first").cast("int").alias("first"), F.col("last").cast("int").alias("last"))


def exclusive_span(span: Column, passage: Column, marker: str = "[-*\\u2022]") -> Column:
    """Whether a span holds hardly more than the passage: at most 3 characters are left, no letter or digit beside a marker."""
    at = F.position(passage, span)
    rest = F.concat(F.substring(span, F.lit(1), at - 1), F.substring(span, at + F.length(passage), F.length(span)))
    bare = F.regexp_replace(rest, marker, "")
    return F.contains(span, passage) & (F.length(rest) <= 3) & ~bare.rlike("[\\p{L}\\p{N}]")
