import itertools
import random
from collections import Counter

import numpy as np
import pytest

from lodestone.durable import Scratch
from lodestone.llm import ngram_jaccard as nj


def corpus(seed, size=160):
    """Unrelated texts, near copies at many distances, a large group of near copies, shared passages, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 4)))
    texts = []
    passage = [word() for _ in range(30)]
    base = [word() for _ in range(120)]
    while len(texts) < size:
        kind = rng.random()
        if kind < 0.2:
            texts.append([word() for _ in range(rng.randint(1, 25))])
        elif kind < 0.35:
            texts.append([word() for _ in range(rng.randint(10, 40))] + passage)
        elif kind < 0.6:
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = word()
            texts.append(t)
        elif texts and kind < 0.95:
            t = list(rng.choice(texts)) or [word()]
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = word()
            if rng.random() < 0.3:
                t = t[: -rng.randint(1, 4)] or t
            texts.append(t)
        else:
            texts.append([])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def brute(rows, n, t):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= t * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "t", "sub", "seed", "few"), [(3, 90, 3, 1, 8), (5, 80, 2, 2, 3), (2, 60, 2, 3, 2)])
def test_against_brute_force(spark, monkeypatch, n, t, sub, seed, few):
    monkeypatch.setattr(nj, "FEW", few)  # so that buckets are cut finer too
    rows = corpus(seed)
    rng = random.Random(seed)
    rng.shuffle(rows)
    got = nj.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=n, t=t, sub=sub).collect()
    assert {r["id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(sorted(rows), n, t)


def test_similar_sets_share_a_signature():
    rng = np.random.Generator(np.random.PCG64(5))
    for t, sub in ((90, 2), (80, 2), (80, 3)):
        for _ in range(400):
            a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64) * np.uint64(2))
            b = set(a.tolist())
            for _ in range(rng.integers(0, nj.most_different(len(a), len(a), t) + 3)):
                if rng.random() < 0.5 and len(b) > 1:
                    b.remove(sorted(b)[rng.integers(len(b))])
                else:
                    b.add(int(rng.integers(0, 1 << 63)) * 2)
            b = np.array(sorted(b), np.uint64)
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= t * (len(a) + len(b) - inter) and not np.array_equal(a, b):
                assert set(nj.signatures(a, t, sub).tolist()) & set(nj.signatures(b, t, sub).tolist())


def test_edges(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a b c d", 0), (4, "A  b\nC d", 0), (4, "A  b\nC d", 1), (None, "a b c d", 2), (5, "x", 0), (6, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = sorted((r["id"] is None, r["id"] or 0, r["n_shingles"], r["component_id"]) for r in nj.similar(docs, n=3, t=90).collect())
    assert got == [(False, 1, 0, 1), (False, 2, 0, 2), (False, 3, 2, 3), (False, 4, 2, 3), (False, 4, 2, 3), (False, 5, 1, 5), (False, 6, 1, 5), (True, 0, 2, None)]
    assert nj.similar(docs.limit(0), n=3, t=90).count() == 0


def test_repeated_ids_with_different_texts(spark):
    """Every row links by its own text, whatever other rows have its id, in every order of the rows."""
    rng = random.Random(3)
    long = lambda: [f"w{rng.randrange(10**6)}" for _ in range(60)]
    near = lambda t: " ".join(t[:-1] + ["other"])
    a, b, c, d = long(), long(), long(), long()
    rows = [(5, " ".join(a)), (5, " ".join(b)), (5, None), (7, near(a)), (8, near(b)), (2, near(c)), (9, " ".join(c)), (9, near(d)), (3, " ".join(d)), (9, near(a)), (11, near(a)), (6, near(d)), (5, "")]
    linked = brute(list(enumerate(t for _, t in rows)), 3, 90)
    lowest = {}
    for j, (i, _) in enumerate(rows):
        lowest[linked[j][1]] = min(i, lowest.get(linked[j][1], i))
    want = sorted((i, n, lowest[root]) for (i, _), (n, root) in zip(rows, linked.values(), strict=True))
    for order in (rows, rows[::-1]):
        got = nj.similar(spark.createDataFrame(order, "doc_id long, text string").coalesce(1), n=3, t=90).collect()
        assert sorted((r["id"], r["n_shingles"], r["component_id"]) for r in got) == want


@pytest.mark.parametrize("slice_", [1 << 18, 5])
def test_elements_beside_the_centre_are_counted_in_slices(spark, monkeypatch, slice_):
    """Each element of each member that its group's centre lacks was a row of its own, as was each of the few sets that make a centre."""
    monkeypatch.setattr(nj, "SLICE", slice_)
    rng = random.Random(11)
    rows = [(g, i, rng.sample(range(-40, 40), rng.randint(0, 12))) for g in (3, -8) for i in range(50)]
    count = Counter((g, e) for g, _, new in rows for e in new)
    want = {(g, i): {(e, count[g, e]) for e in new if count[g, e] > 1} for g, i, new in rows}
    with Scratch() as scratch:
        found = nj._shared(spark.createDataFrame(rows, "g long, id long, new array<long>").repartition(3), scratch)
        got = {(r["g"], r["id"]): [tuple(x) for x in r["own"]] for r in found.collect()}
        plan = found._jdf.queryExecution().toString()
    assert {k: set(v) for k, v in got.items()} == {k: v for k, v in want.items() if v} and all(len(v) == len(set(v)) for v in got.values())
    assert "explode" not in plan
    few = spark.createDataFrame([(1, [[1, 2, 3], [2, 3, 4], [3, 5]]), (2, [[7, 8]]), (3, [[1, 2], [2, 3]]), (4, [[1], [2]])], "g long, few array<array<long>>")
    assert {r["g"]: sorted(r["c"]) for r in nj._majority(few).collect()} == {1: [2, 3], 2: [7, 8], 3: [2], 4: []}


def test_pairs_of_small_buckets_are_told_apart_by_sketches(spark, monkeypatch):
    """All pairs of a bucket's members were listed and their sets fetched, however different the sets were."""
    rng = np.random.Generator(np.random.PCG64(6))
    for size in (1, 30, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        b = np.union1d(a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, 1 + size // 20, dtype=np.uint64))
        x, y = (np.array(s, np.int64).view(np.uint64) for s in nj._sketches([a, b]).to_pylist())
        assert 0 < np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
    passage = " ".join(f"common{i}" for i in range(60))
    rows = [(d, passage + "".join(f" own{d}x{i}" for i in range(15))) for d in range(24)]
    rows.append((24, rows[17][1] + " more"))
    made, written = [], nj.Scratch.written

    def counting(self, df, label):
        out = written(self, df, label)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr(nj.Scratch, "written", counting)
    got = nj.similar(spark.createDataFrame(rows, "doc_id long, text string"), n=5, t=80).collect()
    assert {r["id"]: r["component_id"] for r in got} == {d: min(d, 17) if d == 24 else d for d, _ in rows}
    assert any(label == "small" and n > 20 for label, n in made)
    assert sum(n for label, n in made if label == "pairs") < 100
