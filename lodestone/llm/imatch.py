"""I-Match document fingerprints with several randomised lexicons.

The lexicon is the set of terms within a band of inverse document frequency, counted over all documents: held by at most
``TOP_SHARE`` of them and by at least ``LOW_SHARE`` (two documents at least). The band is the same at every size of the corpus. A
term in it is in LOW_SHARE of the documents, so there are at most the mean number of different terms in a document, divided by
LOW_SHARE: what is sent to the tasks (8 bytes a term) does not grow with the number of documents.

A fingerprint has ``len(RATES)`` parts. Part i keeps those distinct lexicon terms of the text that fall into the i-th
random subset of the lexicon, sorted, and hashes them; subsets of different rates suit texts of different lengths. Two
fingerprints are alike by the share of equal parts among those that are not empty in both, at the rates that suit both
texts: those at which at least a quarter of the parts are empty, so that a part holds one or two terms and survives an
edit elsewhere. Equal texts have equal fingerprints and are wholly alike. A text without lexicon terms has only empty parts, like an
empty text; its fingerprint tells nothing, and it is like no text but its equal.

Terms are words split at ASCII white space, ASCII letters in lower case, of any length. Null text counts as empty. The next
document of a row is by descending id, null ids last; rows of one id follow each other by a hash of their text, so any number of
them is dealt to many tasks, equal rows in any order, and each gives a row. The last one is followed by the first; a table of one row follows itself; an empty one gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.durable import written
from lodestone.llm.words import mix, word_hashes
from lodestone.sources import table

TOP_SHARE, LOW_SHARE = 0.05, 1 / 5000
#: Bytes of text in a range of documents, on average; ranges grow once there are RANGES of them, which bounds their table.
RANGE_BYTES, RANGES = 64 << 20, 1 << 16
#: The share of the lexicon in each part's subset.
LEVELS, EACH = tuple(2.0**-k for k in range(4, 12)), 8
RATES = tuple(r for r in LEVELS for _ in range(EACH))
_SEEDS = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 63, len(RATES), dtype=np.uint64)
_LIMITS = np.array([int(r * (1 << 64)) for r in RATES], np.uint64)
EMPTY = "-" * 8


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's terms."""
    return np.unique(word_hashes(text.encode("utf-8", "surrogatepass").lower())) if isinstance(text, str) and text else np.zeros(0, np.uint64)


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term, df): documents that hold each term, counted within batches before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [terms(t) for t in batch["text"]]
            term, df = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            yield pd.DataFrame({"term": term.view(np.int64), "df": df})

    return docs.select(F.col(text).alias("text")).mapInPandas(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def lexicon(docs: DataFrame, text: str = "text", top_share: float = TOP_SHARE, low_share: float = LOW_SHARE) -> np.ndarray:
    """The sorted hashes of the terms in the band: at most the mean number of terms in a document divided by ``low_share``."""
    counts = written(document_frequencies(docs, text), "document_frequencies")
    rows = docs.count()
    low, high = max(2, rows * low_share), rows * top_share
    kept = counts.where((F.col("df") >= low) & (F.col("df") <= high)).select("term")
    found = kept.toArrow()["term"].to_numpy().view(np.uint64)
    return np.sort(found)


def parts(found: np.ndarray, lex: np.ndarray) -> list[str]:
    """The parts of the fingerprint of a text's distinct terms."""
    if len(lex):
        at = np.searchsorted(lex, found)
        at[at == len(lex)] = 0
        kept = found[lex[at] == found]
    else:
        kept = found[:0]
    if not len(kept):
        return [EMPTY] * len(RATES)
    inside = mix(kept[None, :] ^ _SEEDS[:, None]) < _LIMITS[:, None]
    return [hashlib.blake2b(kept[row].tobytes(), digest_size=4).hexdigest() if row.any() else EMPTY for row in inside]


def likeness(a: list[str], b: list[str], equal: bool = False) -> float:
    """Share of equal parts among those not empty in both, at the rates that suit both; 1 for ``equal`` texts, 0 where nothing is told."""
    if equal or (a == b and a != [EMPTY] * len(RATES)):
        return 1.0
    told = []
    for at in range(0, len(RATES), EACH):
        level = list(zip(a[at : at + EACH], b[at : at + EACH], strict=True))
        if min(sum(x == EMPTY for x, _ in level), sum(y == EMPTY for _, y in level)) * 4 >= EACH or at + EACH == len(RATES):
            told += [(x, y) for x, y in level if x != EMPTY or y != EMPTY]
    return sum(x == y for x, y in told) / len(told) if told else 0.0


def fingerprints(docs: DataFrame, lex: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) of each row; no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch["key"], "fingerprint": ["".join(parts(terms(t), known.value)) for t in batch["text"]]})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"`{key}` string, fingerprint string").withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """(part, id, h, doc_id, text, guest), and the number of parts: documents dealt to ranges of descending (doc_id, hash of the text), each range followed by the next one's first.

    A range's last document so stands beside its successor; the last range is followed by the very first document. Only
    ids and hashes are read to set the bounds, of which there are RANGES at most; the text moves once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.xxhash64("text").alias("h"), "doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    n = min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES)))
    bounds = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n)).first()[0] or [] if n > 1 else []
    known = spark.sparkContext.broadcast(np.sort(np.array(bounds, np.int64)))  # 8 bytes a range

    @F.pandas_udf("int")
    def part(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        """Ranges from the highest id down; an id that is several bounds is dealt to as many ranges by hash."""
        below, upto = np.searchsorted(known.value, ids, "left"), np.searchsorted(known.value, ids, "right")
        share = (hashes.to_numpy().astype(np.float64) / 2.0**63 + 1) / 2
        inner = np.minimum(((upto - below) * share).astype(np.int64), np.maximum(upto - below - 1, 0))
        return pd.Series((len(known.value) - upto + inner).astype(np.int32))

    rows = rows.withColumn("part", part("id", "h"))
    head = rows.groupBy("part").agg(F.min(F.struct((-1 - F.col("id")).alias("down"), "h")).alias("first"))  # -1 - id: no overflow
    first = sorted(head.select("part", "first.*").collect(), key=lambda r: r["part"])  # a row for each range
    before = [(-1 - r["down"], r["h"], first[i - 1]["part"]) for i, r in enumerate(first)]  # the range that this one's first follows
    lead = F.broadcast(spark.createDataFrame(before, "id long, h long, guest_of int"))  # a row for each range
    guests = rows.drop("part").join(lead, ["id", "h"]).select("id", "h", "doc_id", "text", F.col("guest_of").alias("part"), F.lit(True).alias("guest"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests), len(bounds) + 1


def op9_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    known = spark.sparkContext.broadcast(lexicon(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # (part, doc_id, text, fingerprint parts) of the row that waits for its successor
        for batch in batches:
            out = []
            for part, doc_id, text, guest in zip(batch["part"], batch["doc_id"], batch["text"], batch["guest"], strict=True):
                text = text if isinstance(text, str) else ""
                own = parts(terms(text), known.value)
                if held and held[0] == part:
                    cut = len(held[2]) // 2
                    edited = held[2][: len(held[2]) - cut] + text[:cut]
                    new = parts(terms(edited), known.value)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[1], len(held[2]), digest, "".join(held[3]), "".join(new), likeness(held[3], new, edited == held[2]), likeness(held[3], own, text == held[2])))
                held = None if guest else (part, doc_id, text, own)
            yield pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    rows, n = neighbours(docs)
    dealt = rows.repartitionById(n, F.col("part")).sortWithinPartitions("part", "guest", F.col("id").desc(), "h")
    out = dealt.select("part", F.col("doc_id").cast("string").alias("doc_id"), "text", "guest").mapInPandas(
        run, "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
