"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with each run of white space as one space. An item of m characters may differ from the
document's passage by k edits, ``k = max(FEWEST, RATE * m)`` (less for items too short for pieces of SHORTEST characters).
It is split into k + 1 pieces. A passage within k edits keeps at least one piece whole, so exact piece hits, found for all
pieces at once by an Aho-Corasick automaton, miss nothing. Around each hit the item is aligned with Myers' bit-parallel
algorithm over the window where it could lie, which gives the least edit distance and where it ends.

The items are read in blocks of bounded size (``BLOCK`` characters in all), one at a time, so what the driver holds and sends
to the tasks has a bound; every document is searched against every block. Documents do not move: no shuffle. Whole texts are
searched.

Null or empty texts hold nothing; null, empty and blank items and those with a null id match nothing; items that repeat are
found by each id. Ids of documents and items may be of any type that Spark casts to text and back. Rows that repeat are
searched each; a document with a null id is searched like any other. A hit is the best one of its (document, item). An empty
table of documents or items gives no hits. Extra columns are not carried by ``matches``, and all are by ``clean``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.durable import written
from lodestone.sources import table

RATE, FEWEST, SHORTEST = 0.05, 2, 8
#: Characters of items in a block.
BLOCK = 4_000_000


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def budget(m: int, rate: float = RATE) -> int:
    """Edits allowed for an item of m characters."""
    return max(0, min(max(FEWEST, int(m * rate)), m // SHORTEST - 1))


def split(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def myers(pattern: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """(least distance, end) of the pattern in any part of ``text``, or None if over k; ``pattern``: bits of each character."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, k + 1, -1
    for j, c in enumerate(text):
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= k else None


def bits(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """The pieces of a block of items and their automaton; built once in each worker."""

    def __init__(self, items: list[tuple[str, str]], rate: float):
        self.items: list[tuple[str, str, int, dict[str, int]]] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            k = budget(len(text), rate)
            for at, piece in split(text, k):
                pieces.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, text, k, bits(text)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.automaton.add_word(piece, (len(piece), where))
        if pieces:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[str, int, int]]:
        """(item_id, distance, end in the normalised text) of the items found."""
        if not self.items:
            return []
        text = normal(text)
        windows: dict[int, list[int]] = {}
        for last, (n, where) in self.automaton.iter(text):
            for i, at in where:
                windows.setdefault(i, []).append(last + 1 - n - at)
        out = []
        for i, starts in windows.items():
            item_id, item, k, pattern = self.items[i]
            best = None
            for start in sorted(set(starts)):  # each is where the item would begin, give or take k
                a, b = max(0, start - k), start + len(item) + k
                if text.startswith(item, max(0, start)):
                    found = (0, max(0, start) + len(item))
                else:
                    got = myers(pattern, len(item), text[a:b], k)
                    found = got and (got[0], a + got[1])
                if found and (best is None or found < best):
                    best = found
                if best and best[0] == 0:
                    break
            if best:
                out.append((item_id, *best))
        return out


def _blocks(items: DataFrame) -> Iterator[tuple[int, list[tuple[str, str]]]]:
    """(number of blocks, the items of one as (id as text, text)): of at most BLOCK characters each, as a rule, and read one at a time."""
    rows = items.select(F.col("item_id").cast("string").alias("id"), "text").where("length(text) > 0 and id is not null")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    count = -(-total // BLOCK)
    if count <= 1:
        yield 1, [(r["id"], r["text"]) for r in rows.collect()]  # at most BLOCK characters
        return
    dealt = written(rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(2 * count))), "items")
    for i in range(2 * count):
        yield 2 * count, [(r["id"], r["text"]) for r in dealt.where(F.col("block") == i).select("id", "text").toLocalIterator()]


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, item_id, distance, end): items found in documents; ``end`` is in the normalised text. One pass over the documents a block."""
    spark = docs.sparkSession
    kinds = docs.schema[key].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    out = None
    for count, block in _blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                found = [(d, *hit) for d, t in zip(batch["key"], batch["text"], strict=True) if isinstance(t, str) for hit in matcher.hits(t)]
                yield pd.DataFrame(found, columns=["key", "item", "distance", "end"])

        rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).where("text is not null")
        part = rows.mapInPandas(run, "key string, item string, distance int, end long")
        if count > 1:  # a block leaves the driver before the next one comes
            part = written(part, "matches")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out.select(F.col("key").cast(kinds[0]).alias(key), F.col("item").cast(kinds[1]).alias("item_id"), "distance", "end")


def _leaks(sent: Broadcast, rate: float) -> Callable:
    """A column function: whether a text holds an item of the block."""

    @F.pandas_udf("boolean")
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, rate)
        for texts in batches:
            yield pd.Series([isinstance(t, str) and bool(matcher.hits(t)) for t in texts], dtype=bool)

    return leaks


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose own text holds an item, whatever their id; all columns kept, nothing shuffled."""
    spark = docs.sparkSession
    for count, block in _blocks(items):
        sent = spark.sparkContext.broadcast(block)
        docs = docs.where(~_leaks(sent, rate)(F.col(text)))
        if count > 1:
            docs = written(docs, "clean")
            sent.destroy()
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, item) pair in which the document holds the item, over all documents and all of ``benchmark``."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "distance", "end")
