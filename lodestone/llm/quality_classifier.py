"""Quality classifier by supervised subword embeddings.

Every word, every pair of adjacent words and every run of 3 to 5 characters inside a word (its two borders count as a
character) is hashed to one of ``BUCKETS`` rows of a learned embedding matrix. A document is the mean of its features'
vectors; a softmax layer gives the probability of label 1. Embeddings and layer are trained together by stochastic gradient
descent in numpy, one document a step; the mean makes the gradient of one embedding small, so its step is larger than the
layer's by a tenth of the number of the document's different features. A pair of words is hashed by the exclusive or of
their hashes, so a word said twice is one feature whatever the word.

Training takes a bounded sample: at most ``SAMPLE`` documents of each label, chosen by the MD5 of the id among the
labelled rows of the training folds, and of these the first whose features take at most ``SAMPLE_BYTES``. The two labels weigh the same in training; the output is moved to the labels' real
shares, counted over all training rows. Labels, language, source and id are never features. The sample is trained in one
task; only the model, 4 bytes a bucket, comes to the driver.

Scoring reads whole texts, of any length and with words of any length. The model is linear in the mean, so a document's score is the mean of one
number per bucket; the table of these (4 bytes a bucket) is what is sent to the tasks. Null and empty texts have no
features: their score is the prior share of label 1. Rows with null labels or ids do not train; several labels of one id
count as the lowest; of several rows with a labelled id the least text trains. Every row is scored, those with a null id and
repeated ones too. Without training rows every score is one half; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.words import word_hashes
from lodestone.sources import table

BUCKETS, DIM = 1 << 18, 8
SAMPLE, SAMPLE_BYTES = 1500, 128 << 20
EPOCHS, RATE = 8, 0.5
GRAMS = (3, 4, 5)
_SPACE = re.compile("[ \t-\r]")
#: Characters whose features are made at once; a piece ends after a space, so a longer word is one piece.
_BUFFER = 1 << 18


def _pieces(text: str) -> Iterator[str]:
    """``text`` in parts of about _BUFFER characters that end with a space."""
    at = 0
    while len(text) - at > _BUFFER:
        end = _SPACE.search(text, at + _BUFFER)
        if end is None:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def _buffers(texts: list[str | None]) -> Iterator[tuple[str, list[int], list[int]]]:
    """Texts joined to buffers of about _BUFFER characters: (characters, row of each piece, end of each piece)."""
    parts, rows, ends, size = [" "], [], [], 1
    for row, text in enumerate(texts):
        for piece in _pieces(text) if isinstance(text, str) else [""]:
            if size + len(piece) + 1 > 2 * _BUFFER and rows:
                yield "".join(parts), rows, ends
                parts, rows, ends, size = [" "], [], [], 1
            parts += [piece, " "]
            size += len(piece) + 1
            rows.append(row)
            ends.append(size)
    if rows:
        yield "".join(parts), rows, ends


def _features(texts: list[str | None]) -> Iterator[tuple[list[int], list[int], np.ndarray, np.ndarray]]:
    """(rows, ends, positions, buckets) of the features of each buffer; those of one piece lie before its end, and nothing crosses a text's end."""
    last = (-1, np.uint64(0))  # the row and the hash of the buffer's last word
    for text, rows, ends in _buffers(texts):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        space = (c == 32) | ((c >= 9) & (c <= 13))
        word = np.flatnonzero(~space[1:] & space[:-1]) + 1
        h = word_hashes(text.encode("utf-8", "surrogatepass"))
        yield rows, ends, word, (h & np.uint64(BUCKETS - 1)).astype(np.int32)
        if len(word):
            row = np.asarray(rows)[np.searchsorted(ends, word, "right")]
            before_row, before = np.concatenate([[last[0]], row[:-1]]), np.concatenate([np.array([last[1]], np.uint64), h[:-1]])
            same = row == before_row
            pair = ((h ^ before) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int32) & np.int32(BUCKETS - 1)
            yield rows, ends, word[same], pair[same]
            last = (int(row[-1]), h[-1])
        symbol = np.where(space, np.uint32(32), c) * np.uint32(0x9E3779B1)
        code, inner = symbol, np.ones(len(c), bool)
        for n in range(2, max(GRAMS) + 1):
            m = len(c) - n + 1
            code = code[:m] * np.uint32(0x01000193) + symbol[n - 1 :]
            inner = inner[:m]
            if n > 2:
                inner = inner & ~space[n - 2 : n - 2 + m]
            if n in GRAMS:
                at = np.flatnonzero(inner)
                mixed = code[at] ^ code[at] >> np.uint32(15)
                yield rows, ends, at, (mixed * np.uint32(0x85EBCA6B) >> np.uint32(14)).astype(np.int32)


def _spans(ends: list[int], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the features of each piece begin and end; a feature may start on the space before the piece."""
    begins = np.array([1, *ends[:-1]])
    return np.searchsorted(at, begins - 1), np.searchsorted(at, np.asarray(ends) - 1)


def document_features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text, sorted by bucket."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for rows, ends, at, bucket in _features(texts):
        for row, i, j in zip(rows, *_spans(ends, at), strict=True):
            found[row].append(bucket[i:j])
    return [np.unique(np.concatenate([*f, np.zeros(0, np.int32)]), return_counts=True) for f in found]


@dataclass
class Model:
    """``value``: each bucket's contribution to the log-odds of label 1; ``bias``: the log-odds of a text without features."""

    value: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for rows, ends, at, bucket in _features(texts):
            run = np.concatenate([[0.0], np.cumsum(self.value[bucket], dtype=np.float64)])
            a, b = _spans(ends, at)
            np.add.at(total, rows, run[b] - run[a])
            np.add.at(count, rows, b - a)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -30, 30)))


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, shares: tuple[float, float], seed: int = 1) -> Model:
    """Fit embeddings and softmax by SGD, one document a step; ``shares``: the real shares of labels 0 and 1."""
    rng = np.random.Generator(np.random.PCG64(seed))
    emb = (rng.random((BUCKETS, DIM), dtype=np.float32) - np.float32(0.5)) / np.float32(DIM)
    out = np.zeros((DIM, 2), np.float32)
    steps = EPOCHS * len(features)
    weight = len(labels) / 2 / np.maximum(np.bincount(labels, minlength=2), 1)
    done = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(features)):
            ids, counts = features[i]
            if len(ids):
                share = (counts / counts.sum(dtype=np.float64)).astype(np.float32)
                rows = emb[ids]
                hidden = share @ rows
                z = hidden @ out
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                step = np.float32(RATE * weight[labels[i]] * (1 - done / steps))
                back = out @ p
                out -= step * np.outer(hidden, p)
                emb[ids] = rows - step * len(ids) * share[:, None] * back[None, :] * np.float32(0.1)
            done += 1
    value = emb @ (out[:, 1] - out[:, 0])
    prior = np.log(max(shares[1], 1e-6) / max(shares[0], 1e-6))
    return Model(value.astype(np.float32), float(prior))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on ``labels`` (doc_id, label): at most ``sample`` documents and ``sample_bytes`` of features a label, so the one task that trains is bounded."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = max(1, counts.get(0, 0) + counts.get(1, 0))
    order = F.md5(F.col("doc_id").cast("string"))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).orderBy(order, "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)

    shares = counts.get(0, 0) / total, counts.get(1, 0) / total

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                found = document_features(part.column("text").to_pylist())
                made = [pa.array([x.astype(kind).tobytes() for x in xs], pa.binary()) for kind, xs in zip((np.int32, np.uint32), zip(*found, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), *made], names=["doc_id", "label", "ids", "counts"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels = [], []
        for batch in batches:  # at most 2 * sample rows
            held += [(np.frombuffer(i.as_buffer(), np.int32), np.frombuffer(c.as_buffer(), np.uint32)) for i, c in zip(batch["ids"], batch["counts"], strict=True)]
            labels += batch["label"].to_pylist()
        model = train(held, np.array(labels, int), shares)
        yield pa.RecordBatch.from_arrays([pa.array([model.value.tobytes()], pa.binary()), pa.array([model.bias])], names=["value", "bias"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # chosen: at most 2 * sample rows
    texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(features, "doc_id long, label int, ids binary, counts binary")
    size = F.sum(F.octet_length("ids").cast("long") * 2).over(W.partitionBy("label").orderBy(order, "doc_id"))  # at most ``sample`` rows a label
    rows = rows.withColumn("size", size).where(F.col("size") <= sample_bytes).drop("size")
    model = rows.repartition(1).sortWithinPartitions("doc_id").mapInArrow(trained, "value binary, bias double").first()
    if model is None:  # no row trains, so no task ran
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(model["value"], np.float32), model["bias"])


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of each row; no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(model)  # 4 bytes a bucket

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = known.value.scores(list(batch["text"]))
            yield pd.DataFrame({key: batch["key"], "score": score, "predicted": (score >= 0.5).astype("int32")})

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"`{key}` string, score double, predicted int").withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows with a score of at least ``least``, all columns kept; only the text goes through Python."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(known.value.scores(list(texts)))

    return docs.where(score(F.col(text)) >= least)


def fold(doc_id) -> Column:
    """crc32 of the id as text, mod 3; fold 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    """The model of ``labels.quality`` outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id")) != 1)
    return fit(docs, labels.select("doc_id", F.col("quality").alias("label")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored, with the held-out fold marked."""
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, fitted(spark, docs, sf_dir))
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
