"""Resampling, whitening and packing against brute force and round trips, with the odd cases of each."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import cost_packing, importance_resampling, whitening

DOCS = "doc_id long, text string, rank string, row string, words string"


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))


# --- 11: resampling


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def test_codes(monkeypatch):
    rng = random.Random(11)
    for longest in (1, 2, 3):
        for _ in range(100):
            text = "".join(rng.choice(["a", "Ab1", "é", "É", " ", "-", "_x", "\n", "9", "İ"]) for _ in range(rng.randrange(60)))
            words, found = features(text, longest)
            want = Counter(zlib.crc32(f.encode()) for f in found)
            for piece in (1 << 18, 7):
                monkeypatch.setattr(importance_resampling, "_PIECE", piece)
                n, got = importance_resampling.codes(text.encode(), longest)
                assert n == len(words) and Counter(got.tolist()) == want
    assert importance_resampling.codes(None) [0] == 0 and importance_resampling.codes(b"x" * (1 << 20))[0] == 1


@pytest.mark.parametrize("longest", [1, 2])
def test_resample(spark, longest, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(word(rng) for _ in range(rng.randrange(8, 60)))) for i in range(700)]
    rows += [(900, None), (901, ""), (902, "***"), (903, " ".join(word(rng) for _ in range(60_000)))] + [(None, rows[3][1] + " x y z " * 8)] * 3 + [(5, rows[5][1] + " u v w " * 8)] * 4
    target = [(1, " ".join(word(rng) for _ in range(300))), (2, None), (3, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "r", "s", "w") for i, t in rows], DOCS).repartition(5)
    got = importance_resampling.resample(docs, spark.createDataFrame(target, "item_id long, text string"), longest=longest).collect()
    count = lambda texts: Counter(zlib.crc32(f.encode()) % 10000 for t in texts for f in features(t, longest)[1])
    s, t = count(x for _, x in rows), count(x for _, x in target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    want = []
    for i, text in rows:
        words, found = features(text, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20])
    order = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0] or 0, w[1]))
    drawn = order[: 10 * len(order) // 100]
    ranks = {id(w): n + 1 for n, w in enumerate(drawn)}
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, (tuple(r) for r in got))) == sorted(key((*w[:4], ranks.get(id(w)))) for w in want)


def test_ties_and_a_bracket_that_misses(spark, monkeypatch):
    rows = [(i // 2, 30, 30, 0, (i * 7919) % 3, i) for i in range(400)] + [(None, 30, 30, 0, 2, 400 + i) for i in range(90)] + [(7, 3, 3, 0, 99, 500)]
    scored = spark.createDataFrame(rows, "doc_id long, words long, n_features long, weight long, score long, row long")
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[5]))
    for percent, width in ((10, 4 / 10000), (45, 1e-9), (100, 0.1), (0, 0.1)):
        monkeypatch.setattr(importance_resampling, "WIDTH", width)
        got = {r["row"]: r["rank"] for r in importance_resampling.drawn(scored, percent=percent).collect()}
        k = percent * len(order) // 100
        assert len(got) == len(rows) and got == {r[5]: None for r in rows} | {r[5]: n + 1 for n, r in enumerate(order[:k])}


def test_resample_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", "", "", "")], DOCS)
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance_resampling.resample(docs.limit(0), target).count() == 0
    assert [r["rank"] for r in importance_resampling.resample(docs, target).collect()] == [None]


# --- 12: whitening

VECTORS = "vec_id long, embedding array<float>, x int, index string, y string"


@pytest.mark.parametrize("blocks", [None, (8, 3, 2)])
def test_whitening(spark, blocks, monkeypatch):
    if blocks:
        for name, value in zip(("BLOCK_ROWS", "BLOCK_COLS", "CHUNK_BLOCKS"), blocks, strict=True):
            monkeypatch.setattr(whitening, name, value)
    rng = np.random.Generator(np.random.PCG64(3))
    base = (rng.normal(size=(90, 7)) * np.array([3, 2.5, 2, 1.5, 1, 0.5, 0.2])).astype(np.float32)
    good = [(i, v.tolist()) for i, v in enumerate(base)] + [(200 + i, base[4].tolist()) for i in range(60)] + [(None, base[5].tolist()), (3, base[6].tolist())]
    bad = [(300, None), (301, []), (302, [1.0, None] + [0.0] * 5), (303, [float("nan")] * 7), (304, [float("inf")] + [0.0] * 6), (305, [1.0, 2.0])]
    docs = spark.createDataFrame([(i, v, 1, "a", "b") for i, v in good + bad], VECTORS).repartition(3)
    got = whitening.whiten(docs).collect()
    x = np.floor(np.array([v for _, v in good], np.float32).astype(float) * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    cov = np.cov(fit.T.astype(float), bias=True)
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    y = (x - total / n) @ u / np.sqrt(e)
    assert len(got) == 4 * len(good)
    sign = {}
    want = Counter()
    rows = {}
    for (i, _), xi, yi in zip(good, x, y, strict=True):
        for c in range(4):
            rows.setdefault((i, c + 1, int(((n * xi - total) ** 2).sum())), []).append(yi[c])
            want[i, c + 1, int(((n * xi - total) ** 2).sum())] += 1
    assert Counter((r["vec_id"], r["component"], r["deviation"]) for r in got) == want
    for r in got:
        value = rows[r["vec_id"], r["component"], r["deviation"]][0]
        s = sign.setdefault(r["component"], np.sign(value * r["whitened"]))
        assert r["n"] == n and abs(r["whitened"] - s * value) < 1e-9 and abs(r["explained"] - e[r["component"] - 1] / np.trace(cov)) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_without_spread(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0], 0, "", "")] * 3, VECTORS)
    assert [(r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in whitening.whiten(one).collect()] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 3
    line = spark.createDataFrame([(i, [float(i), 2.0 * i], 0, "", "") for i in range(5)] + [(9, [3e36, 0.0], 0, "", "")], VECTORS)
    got = whitening.whiten(line.where("vec_id < 9")).collect()
    assert {(r["component"], r["whitened"] is None, round(r["explained"], 9)) for r in got} == {(1, False, 1.0), (2, True, 0.0)}
    empty = whitening.whiten(one.limit(0))
    assert empty.count() == 0 and empty.columns == whitening.whiten(one).columns
    assert whitening.whiten(spark.createDataFrame([(1, None, 0, "", "")], VECTORS)).count() == 0


# --- 13: packing

PACKED = "doc_id long, text string, length string, start string, ids string"


@pytest.fixture(scope="module")
def vocabulary():
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def test_encoder(vocabulary, monkeypatch):
    path, plain = vocabulary
    rng = random.Random(13)
    texts = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "don't  stop 12 3", "x <|endoftext|> y", "é è ü  z", "\x1c a \x1d b", "a\x85 b", "\n\n a\n b\n", "x\u00a0y \u00a0 z", "\x1c", "a\x1cb c\x1fd", "naïve œuvre ǆ ʰx"]
    texts += ["".join(rng.choice([" ", "a", "bc", "\n", "'s", "1", ".", "  ", "é", "\t", "日本", "\x1f", "　"]) for _ in range(rng.randrange(80))) for _ in range(400)]
    encoder = cost_packing.Encoder(path)
    assert encoder.by_unit
    other = cost_packing.Encoder(vocabulary[0].replace("byte_bpe_50k.json", "word_bpe_49k.json"))
    assert not other.by_unit and np.frombuffer(other.encode(["A b!"])[0], "<u4").tolist() == other.tokenizer.encode("A b!", add_special_tokens=False).ids
    for cache in (1 << 18, 1 << 18, 30):  # the second time from memory, then with hardly any
        monkeypatch.setattr(cost_packing, "CACHE", cache)
        for t, ids in zip(texts, encoder.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_assign():
    rng = random.Random(14)
    for _ in range(200):
        lengths = sorted((rng.choice([rng.randint(1, 1023), rng.randint(1, 60), 600]) for _ in range(rng.randrange(1, 120))), reverse=True)
        out = cost_packing.assign(lengths)
        filled, parts = {}, {}
        for i, start, n, s, offset in out:
            filled.setdefault(s, []).append((offset, n))
            parts.setdefault(i, []).append((start, n))
        for pieces, ends in [(filled[s], None) for s in filled] + [(parts[i], lengths[i]) for i in range(len(lengths))]:
            at = 0
            for start, n in sorted(pieces):
                assert start == at and n > 0
                at += n
            assert at == ends if ends is not None else at in {1 << b for b in range(11)}
        costs = [sum(cost_packing.cost(n) for _, n in filled[s]) for s in filled if sum(n for _, n in filled[s]) == 1024]
        whole = sum(len(p) == 1 for p in parts.values())
        assert whole >= len(lengths) - len(filled) * 2 and (len(costs) < 2 or max(costs) <= cost_packing.cost(1024))
    # falling cost to the cheapest sequence: the two long ones part, the short ones even them out
    even = cost_packing.assign([700, 600, 300, 248, 100, 100])
    assert {(i, s) for i, _, _, s, _ in even} >= {(0, 0), (1, 1), (2, 1)}


def test_packing(spark, vocabulary):
    path, plain = vocabulary
    rng = random.Random(15)
    rows = [(i, " ".join(word(rng) for _ in range(rng.randrange(0, 300)))) for i in range(260)]
    rows += [(500, None), (501, ""), (502, "x" * 30_000), (503, " ".join(word(rng) for _ in range(40_000)))] + [(None, rows[9][1])] * 3 + [rows[8]] * 50
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], PACKED).repartition(4)
    got = cost_packing.pack(docs, path, group=4).collect()
    ids = {t: plain.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows}
    want = Counter((i, len(ids[t])) for i, t in rows)
    tokens = {}
    for r in got:
        tokens[r["doc_id"], r["doc_tokens"]] = tokens.get((r["doc_id"], r["doc_tokens"]), 0) + r["length"]
    assert tokens == {k: k[1] * n for k, n in want.items()}
    text = {(i, len(ids[t])): ids[t] for i, t in rows}
    for r in got:
        piece = text[r["doc_id"], r["doc_tokens"]][r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and zlib.crc32(np.array(piece, "<u4").tobytes()) == r["ids_crc32"]
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at in {1 << b for b in range(11)}
    assert sum(sum(n for _, n in p) < 1024 for p in sequences.values()) <= 10 * max(1, len(sequences) // 3)
    assert cost_packing.pack(docs.limit(0), path).count() == 0
    again = cost_packing.pack(docs, path, group=4).collect()
    assert Counter(r["length"] for r in again) == Counter(r["length"] for r in got)


def test_new_queries_on_given_tables(spark):
    import os

    from lodestone.llm.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert QUERIES["op11_importance_resampling"](spark, sf).count() == rows
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert QUERIES["op12_whitening"](spark, sf).count() == 4 * vectors.where(whitening.integers(vectors, "embedding").isNotNull()).count()
    packed = QUERIES["op13_cost_packing"](spark, sf)
    full = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert full.count() == rows and full.where("n <> m").count() == 0
