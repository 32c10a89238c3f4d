"""Resampling towards a target distribution: documents drawn by importance weights of hashed word runs.

Every run of 1 to ``longest`` consecutive words (joined by one space) is a feature; its UTF-8 bytes' crc32 modulo
``buckets`` is its bucket. A bucket's gain is the floored thousandfold log ratio of its smoothed shares in the target texts
and in the documents; a document's weight is the floored mean of its features' gains. Each task counts into an array and
gives a row for each bucket at most; the gains are one array of ``buckets`` numbers, sent to all tasks.

The draw is without replacement: each document's weight gets Gumbel noise from a hash of its id, and the ``percent`` highest
scores of the documents with at least ``least`` words are drawn. Their cutoff comes from a quantile sketch of the scores: two
of its quantiles bracket the cutoff, the exact counts of rows above and inside the bracket prove that it lies there or have the
bracket widened, and only the rows inside are sorted, by ranges, to find the last row drawn. Drawn rows get their ranks from a
range sort with the ranges' row counts, so no task holds more than a range.

Words are runs of ASCII letters and digits and of all other characters above 0x7F, ASCII letters in lower case, of any
length. Null and empty texts have no features and weight 0. Null ids draw as the id of no characters and come last among equal
scores; rows that repeat an id have the same noise, and equal rows are drawn as separate rows. Empty tables give no rows; without
target texts all gains follow from the documents alone. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.durable import Scratch, written
from lodestone.operators.ranges import numbered
from lodestone.sources import table

BUCKETS, LONGEST = 10000, 1
PERCENT, LEAST, SEED = 10, 20, "2024"
#: Relative error of the sketch, and the first bracket's half width as a share of all rows.
ACCURACY, WIDTH = 10000, 4 / 10000
_WORD = bytes(range(0x30, 0x3A)), bytes(range(0x61, 0x7B)), bytes(range(0x41, 0x5B))
_CLEAN = bytes(c + 32 if c in _WORD[2] else c if c in _WORD[0] + _WORD[1] or c > 0x7F else 32 for c in range(256))
#: Bytes whose words are split at once; a piece ends at a word's end.
_PIECE = 1 << 18


def codes(data: bytes | None, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """The number of words, and the crc32 of every run of 1 to ``longest`` words."""
    clean, at, n, found, tail = (data or b"").translate(_CLEAN), 0, 0, [], []
    while at < len(clean):
        cut = clean.find(b" ", at + _PIECE)
        cut = len(clean) if cut < 0 else cut
        words = clean[at:cut].split()
        n += len(words)
        found.append(np.fromiter(map(crc32, words), np.uint32, len(words)))
        if longest > 1:
            words, old = tail + words, len(tail)  # runs that end in this piece
            run = list(map(crc32, words))
            for k in range(2, longest + 1):
                run = [crc32(b" " + w, c) for c, w in zip(run, words[k - 1 :], strict=False)]
                found.append(np.array(run[max(0, old - k + 1) :], np.uint32))
            tail = words[1 - longest :]
        at = cut
    return n, np.concatenate(found) if found else np.zeros(0, np.uint32)


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Features in each bucket, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                total += np.bincount(codes(value.as_py(), longest)[1] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["bucket", "n"])

    counts = docs.select(F.col(text).cast("binary")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in counts.collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Each bucket's floored thousandfold log ratio of its share in ``target`` and in ``docs``."""
    s, t = (bucket_counts(x, text, buckets, longest).astype(np.float64) for x in (docs, target))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """(key, words, n_features, weight) of each row; no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(gain)  # 8 bytes a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                n, found = codes(value.as_py(), longest)
                out.append((n, len(found), int(known.value[found % len(known.value)].sum()) // len(found) if len(found) else 0))
            columns = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, "words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text).cast("binary").alias("_text")).mapInArrow(run, f"`{key}` {kind}, words long, n_features long, weight long")


def noise(key: str, seed: str = SEED) -> Column:
    """Gumbel noise, in thousandths, of an id: the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def bracket(scores: DataFrame, k: int, rows: int) -> tuple[int, int, int]:
    """(low, high, above): the k-th highest of ``rows`` scores lies within low..high, and ``above`` scores are over high."""
    width, q = WIDTH, 1 - k / rows
    while True:
        low, high = scores.agg(F.percentile_approx("score", [max(0.0, q - width), min(1.0, q + width)], ACCURACY)).first()[0]
        if width >= 1:
            low, high = scores.agg(F.min("score"), F.max("score")).first()
        above, inside = scores.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            return low, high, above
        width *= 8


def drawn(scored: DataFrame, key: str = "doc_id", percent: int = PERCENT, least: int = LEAST) -> DataFrame:
    """``scored`` (a written table of key, words, n_features, weight, score, row) with ``rank``; null for rows not drawn."""
    rows = scored.where(F.col("words") >= least)
    total = rows.count()
    k = percent * total // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    order = [F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features"), F.col("row")]
    low, high, above = bracket(rows, k, total)
    inside = numbered(rows.where(F.col("score").between(low, high)), order, "place")
    last = inside.where(F.col("place") == k - above).first()  # one row
    same = (F.col("score") == last["score"]) & F.col(key).eqNullSafe(F.lit(last[key]))
    before = F.col(key).isNotNull() if last[key] is None else F.coalesce(F.col(key) < last[key], F.lit(False))
    tie = same & ((F.col("n_features") < last["n_features"]) | ((F.col("n_features") == last["n_features"]) & (F.col("row") <= last["row"])))
    taken = (F.col("words") >= least) & ((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & before) | tie)
    ranks = numbered(scored.where(taken), order, "rank", k)
    return ranks.unionByName(scored.where(~taken).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = LEAST, seed: str = SEED, longest: int = LONGEST) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of ``docs``; ``rank`` from 1 for those drawn, else null."""
    with Scratch() as here:
        scored = weighted(docs, gains(docs, target, text, longest=longest), key, text, longest)
        scored = scored.withColumn("score", F.col("weight") + noise(key, seed)).withColumn("row", F.monotonically_increasing_id())
        out = drawn(here.written(scored, "scores"), key, percent, least).select(key, "n_features", "weight", "score", "rank")
        return written(out, "resampled")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of all documents, drawn towards the texts of ``benchmark``."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_FEATURES = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'))"
SQL = f"""
WITH RECURSIVE steps AS (SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS entries FROM steps WHERE k = 8),
found AS (SELECT 's' AS side, doc_id, row, {_FEATURES} AS word FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)
  UNION ALL SELECT 't', NULL, NULL, {_FEATURES} FROM benchmark),
counted AS (SELECT side, row, word, count(*) AS n FROM found GROUP BY ALL),
bytes AS (SELECT word, list_transform(range(length(hex(encode(word))) // 2), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT word FROM counted)),
coded AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % {BUCKETS} AS bucket FROM bytes, crc),
dealt AS (SELECT side, row, bucket, sum(n)::BIGINT AS n FROM counted JOIN coded USING (word) GROUP BY ALL),
shares AS (SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t FROM dealt GROUP BY 1),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS}))))::BIGINT AS g FROM shares),
weights AS (SELECT row, sum(n)::BIGINT AS n, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS w FROM dealt JOIN gain USING (bucket) WHERE side = 's' GROUP BY 1),
scored AS (SELECT doc_id, row, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
  coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM (SELECT doc_id, row_number() OVER () AS row FROM documents) LEFT JOIN weights USING (row)),
drawn AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, row) AS rank FROM scored WHERE n_features >= {LEAST})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT {PERCENT} * count(*) // 100 FROM drawn) THEN rank END AS rank FROM scored LEFT JOIN drawn USING (row)
"""
