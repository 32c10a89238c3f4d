"""Classes of equal postings, passages, and top-k with bounds, against brute force."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.operators import dedup, gate, passages
from lodestone.operators import similarity as sim
from lodestone.operators.ranges import numbered, running
from lodestone.operators.topk import Search, top_relevant

H9, B8 = 9, 8


def jaccard(a, b):
    low = sum(min(a.get(t, 0), b.get(t, 0)) for t in {*a, *b})
    return low, sum(a.values()) + sum(b.values()) - low


def test_classes_and_reuse(spark):
    """Decisions, batch and live reuse and leaders on many equal postings, from all pairs in plain Python."""
    rng = random.Random(31)
    sets = [{}] + [{f"t{rng.randrange(9)}": rng.choice([3, 5, 10]) for _ in range(rng.randint(1, 8))} for _ in range(12)]
    sets += [dict(list(s.items())[:-1]) for s in sets[1:6]]
    stems = [{f"s{rng.randrange(5)}": rng.randint(1, 3) for _ in range(4)} for _ in range(3)]
    posts, weights, counts = [], [], []
    for i in range(90):
        s, c = rng.choice(sets), rng.choice(stems)
        posts.append((rng.choice("uvw"), i, (i * 37) % 90, s, c))
        weights += [(i, t, w) for t, w in s.items()]
        counts += [(i, t, n) for t, n in c.items()]
    p = spark.createDataFrame([x[:3] for x in posts], "owner string, doc_id long, ord long")
    w, n = spark.createDataFrame(weights, "doc_id long, term string, w10 long"), spark.createDataFrame(counts, "doc_id long, stem string, n long")

    def cosine(a, b):
        return sum(a[t] * b.get(t, 0) for t in a) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5

    def hit(x, y):
        low, high = jaccard(x[3], y[3])
        return low * 10 >= high * H9 or (low * 10 >= high * B8 and cosine(x[4], y[4]) >= 0.95)

    classes = dedup.posting_classes(w, p)
    assert {r["doc_id"]: r["cls"] for r in classes.collect()} == {x[1]: min(y[1] for y in posts if y[3] == x[3]) for x in posts}
    pairs = dedup.similar_postings(w, classes)
    texts = dedup.text_classes(n, classes)
    assert {r["doc_id"]: r["cls"] for r in texts.collect()} == {x[1]: min(y[1] for y in posts if y[3:] == x[3:]) for x in posts}
    wide = dedup.band_pairs(pairs, classes, texts)
    both = spark.createDataFrame([(x[1], y[1], cosine(x[4], y[4])) for x in posts for y in posts], "a long, b long, cosine double")
    members, links = dedup.memberships(wide.join(dedup.reuse_decision(wide, both), ["a", "b"]), classes, texts)
    order = sorted(posts, key=lambda x: x[2])
    batch, live, led = {}, {}, {}
    for i, x in enumerate(order):
        batch[x[1]] = next((y[1] for y in order[:i] if hit(x, y)), None)
        live[x[1]] = next((y[1] for y in led.get(x[0], [])[::-1] if hit(x, y)), None)
        if live[x[1]] is None:
            led.setdefault(x[0], []).append(x)
    assert {r["doc_id"]: r["reused"] for r in dedup.batch_reuse(p, links, members).collect()} == batch
    assert {r["doc_id"]: r["reused"] for r in dedup.live_reuse(p, links, members).collect()} == live
    lead = []
    for x in posts:
        low = [jaccard(x[3], y[3]) for y in lead]
        if not any(a * 10 >= b * B8 for a, b in low):
            lead.append(x)
    got = dedup.class_leaders(classes.select(F.lit(0).alias("g"), F.col("doc_id").alias("node"), "cls"), pairs, "g")
    assert {r["node"] for r in got.collect() if r["leads"]} == {x[1] for x in lead}


def test_equal_postings_make_no_pairs(spark):
    posts = spark.range(10_000).select(F.lit("u").alias("owner"), F.col("id").alias("doc_id"), F.col("id").alias("ord"))
    weights = posts.select("doc_id", F.lit("x").alias("term"), F.lit(3).cast("long").alias("w10"))
    classes = dedup.posting_classes(weights, posts)
    assert classes.count() == 10_000 and classes.select("cls").distinct().count() == 1 and dedup.similar_postings(weights, classes).count() == 0
    none = spark.createDataFrame([], "a long, b long")
    assert dedup.live_reuse(posts, none, classes).where("reused is null").count() == 1
    cands = posts.select(F.col("owner").alias("owner_id"), F.col("doc_id").alias("cand_id"), F.col("ord").alias("pos"), F.lit(1).alias("length"), F.lit("same words here").alias("text"))
    assert gate.drop_duplicates_in_order(cands).where("not dropped").count() == 1


def test_duplicates_with_several_lengths(spark):
    rng = random.Random(33)
    pool = [[f"w{rng.randrange(9)}" for _ in range(5)] for _ in range(9)] + [[]]
    rows = [(o, p, p, n, " ".join(rng.choice(pool))) for o in range(3) for p in range(30) for n in rng.sample((1, 2, 3), rng.randint(1, 3))]
    want = {}
    for o in range(3):
        kept = []
        for p in range(30):
            mine = {n: set(t.split()) for oo, _, pp, n, t in rows if (oo, pp) == (o, p)}
            want[o, p] = any(n in mine and t and len(mine[n] & t) * 100 >= 80 * len(mine[n] | t) for k in kept for n, t in k.items())
            kept += [] if want[o, p] else [mine]
    got = gate.drop_duplicates_in_order(spark.createDataFrame(rows, "owner_id int, cand_id int, pos int, length int, text string"))
    assert {(r["owner_id"], r["pos"]): r["dropped"] for r in got.collect()} == want and any(want.values())


# --- passages


def located(docs, items):
    squeeze = lambda s: "".join(c for c in unicodedata.normalize("NFKC", s).replace("‐", "-").replace("‑", "-") if not c.isspace())
    lines = {d: [squeeze(x) for x in t.split("\n")] for d, t in docs if t is not None}
    first, ordered = {}, {}
    for d, ls in lines.items():
        def find(t, cursor, ls=ls):
            a = next((k for k in range(cursor, len(ls)) if t[:14] in ls[k]), None)
            if a is None:
                return None
            return next(((a, b) for b in range(a, min(a + 8, len(ls))) if t in "".join(ls[a : b + 1])), ())

        cursor = 0
        for i, text, _ in sorted(items, key=lambda x: x[2]):
            t = squeeze(text or "")
            if t and find(t, 0):
                first[d, i] = find(t, 0)
            if t and (at := find(t, cursor)):
                ordered[d, i] = at
                cursor = at[1] + 1
    return first, ordered


@pytest.mark.parametrize("buffer", [1 << 20, 40])
def test_passages(spark, monkeypatch, buffer):
    monkeypatch.setattr(passages, "_BUFFER", buffer)
    rng = random.Random(34)
    piece = lambda: "".join(rng.choice(["ab", "c", "é", "ﬁ", " ", "-", "‑", "x1", "日"]) for _ in range(rng.randint(1, 12)))
    docs = [(i, "\n".join(piece() for _ in range(rng.randint(1, 14)))) for i in range(80)] + [(90, None), (91, ""), (92, "x" * 5000 + "\n" + "x")]
    texts = ["c", "ab", " ", None, "", "x" * 20, "日x1"]
    for _ in range(60):
        _, t = rng.choice(docs[:80])
        at = rng.randrange(len(t))
        texts.append(t[at : at + rng.randint(1, 60)].replace("\n", rng.choice([" ", "", "\n"])) + rng.choice(["", "", "", "zz"]))
    items = [(i, t, (i * 7) % 67) for i, t in enumerate(texts)]
    hits = passages.passage_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, ord int"))
    first, ordered = located(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["first"], r["last"]) for r in passages.locate_passages(hits).collect()} == first and len(first) > 100
    got = passages.locate_in_order(hits, spark.createDataFrame([(i, o) for i, _, o in items], "item_id long, ord int"))
    assert {(r["doc_id"], r["item_id"]): (r["first"], r["last"]) for r in got.where("first is not null").collect()} == ordered
    monkeypatch.setattr(passages, "BLOCK", 9)
    again = passages.passage_hits(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string, ord int"))
    key = lambda h: sorted(str(tuple(r)) for r in h.collect())
    assert key(again) == key(hits)


# --- top k


def test_top_relevant(spark):
    rng = random.Random(35)
    named = [(i, f"t{t}") for i in range(12) for t in rng.sample(range(8), rng.randint(0, 4))]
    weights = [(d, f"t{t}", rng.choice([3, 5, 10])) for d in range(400) for t in rng.sample(range(8), rng.randint(0, 4))]
    x = [(i, f"s{s}", rng.randint(1, 3)) for i in range(14) for s in rng.sample(range(60), rng.randint(0, 9))]
    y = [(d, f"s{s}", rng.randint(1, 9)) for d in range(400) for s in rng.sample(range(60), rng.randint(0, 20))]
    frames = [spark.createDataFrame(*a) for a in ((named, "item_id long, canonical string"), (weights, "doc_id long, term string, w10 long"), (x, "item_id long, stem string, n long"), (y, "doc_id long, stem string, n long"))]
    total = frames[1].groupBy("doc_id").agg(F.sum("w10").alias("total"))
    hit = frames[1].join(frames[0].withColumnRenamed("canonical", "term"), "term").groupBy("item_id", "doc_id").agg(F.sum("w10").alias("hit")).join(total, "doc_id")
    size = lambda t, k, c: t.groupBy(k).agg(F.sum(F.col("n") * F.col("n")).alias(c))
    dots = frames[2].withColumnRenamed("n", "nx").join(frames[3], "stem").groupBy("item_id", "doc_id").agg(F.sum(F.col("nx") * F.col("n")).alias("dot"))
    cosine = dots.join(size(frames[2], "item_id", "sx"), "item_id").join(size(frames[3], "doc_id", "sy"), "doc_id").withColumn("cosine", F.col("dot") / (F.sqrt("sx") * F.sqrt("sy")))
    every = sim.relevance(hit, cosine.select("item_id", "doc_id", "cosine")).collect()
    for k in (1, 3):
        want = set()
        for i in range(14):
            best = sorted(((-r["bp"], r["doc_id"]) for r in every if r["item_id"] == i))[:k]
            want |= {(i, d, -b, n + 1) for n, (b, d) in enumerate(best)}
        assert {(r["item_id"], r["doc_id"], r["bp"], r["r"]) for r in top_relevant(*frames, k=k).collect()} == want
    assert top_relevant(frames[0].limit(0), frames[1], frames[2].limit(0), frames[3]).count() == 0


# --- ranges


def test_ranges(spark):
    rng = random.Random(36)
    rows = [(None if o == 5 else o, rng.randrange(40), rng.choice([1, 2, None]), i) for i in range(900) for o in [rng.choice([1, 1, 1, 2, 5])]]
    df = spark.createDataFrame(rows, "owner long, at long, v long, id long")
    for n in ("1", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        order = sorted(rows, key=lambda r: (r[1], r[3]))
        assert {r["id"]: r["place"] for r in numbered(df, [F.col("at"), F.col("id")]).collect()} == {r[3]: i + 1 for i, r in enumerate(order)}
        want, sums = {}, {}
        for r in order:
            sums[r[0]] = sums.get(r[0], 0) + (r[2] or 0)
            want[r[3]] = sums[r[0]]
        assert {r["id"]: r["running"] for r in running(df, ["owner"], [F.col("at"), F.col("id")], F.col("v")).collect()} == want
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert numbered(df.limit(0), [F.col("at")]).count() == 0 and running(df.limit(0), ["owner"], [F.col("at")], F.col("v")).count() == 0


# --- in-order matching, approximate search


def test_drift_in_order(spark):
    from lodestone.operators import audit

    rng = random.Random(37)
    before, after, edited = [], [], []
    for d in range(60):
        lines = [rng.choice("abcde") for _ in range(rng.randrange(1, 25))]
        before += [(d, i // 10, i, i * 12.0, x) for i, x in enumerate(lines)]
        edited += [(d, i) for i in range(len(lines)) if rng.random() < 0.1]
        kept = [x for x in lines if rng.random() < 0.93] + [rng.choice("abcde") for _ in range(rng.randrange(3))]
        after += [(d, i // 10, i, i * 12.0 + rng.choice([0.0, 0.25, 0.75]), x) for i, x in enumerate(kept)]
    want = {}
    for d in range(60):
        cursor, worst, problem, n = 0, None, None, 0
        mine = sorted(x for x in after if x[0] == d)
        mine.sort(key=lambda x: x[2])
        for _, page, i, y, x in sorted((b for b in before if b[0] == d), key=lambda b: b[2]):
            if (d, i) in edited:
                continue
            n += 1
            match = next((a for a in mine if a[2] >= cursor and a[4] == x), None)
            found = "missing" if match is None else "page" if match[1] != page else "shift" if abs(match[3] - y) > 0.5 else None
            problem = problem or found
            if match:
                cursor = match[2] + 1
                worst = max(worst or 0.0, abs(match[3] - y)) if match[1] == page else worst
        want[d] = (n, worst, problem) if n else None
    schema = "doc_id int, page int, line_no int, y double, line string"
    got = audit.drift_in_order(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), spark.createDataFrame(edited, "doc_id int, line_no int")).collect()
    assert {r["doc_id"]: (r["lines"], r["worst"], r["problem"]) for r in got} == {d: w for d, w in want.items() if w} and len({w[2] for w in want.values() if w}) > 2


def test_approximate_nearest(spark, monkeypatch):
    """Recall on clustered and on shapeless vectors, with a third of all items copies of one, and null and empty vectors."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(38))
    monkeypatch.setattr(sim, "PART_ITEMS", 100)
    centres = rng.normal(size=(20, 16)) * 3
    for vectors in (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)), rng.normal(size=(1500, 16))):
        vectors[:500] = vectors[0]
        rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(9000, None), (9001, [])]
        items = spark.createDataFrame(rows, "item_id long, v array<double>")
        queries = items.where("item_id % 50 = 0").withColumnRenamed("item_id", "query_id")
        got = {(r["query_id"], r["item_id"]): r["similarity"] for r in sim.approximate_nearest(queries, items).collect()}
        want = {(r["query_id"], r["item_id"]): r["similarity"] for r in sim.nearest(queries.where("size(v) > 0"), items.where("size(v) > 0")).collect()}
        assert len(got.keys() & want.keys()) >= 0.9 * len(want) and all(abs(got[p] - want[p]) < 1e-9 for p in got.keys() & want.keys())
    assert sim.approximate_nearest(queries, items.limit(0)).count() == 0


def test_recall_on_given_tables(spark):
    import os

    from lodestone.plans.registry import QUERIES

    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    pairs = lambda n: {(r["query_id"], r["item_id"]) for r in QUERIES[n](spark, sf).collect()}
    want = pairs("b5_nearest")
    assert len(want & pairs("b5_approximate_nearest")) >= 0.9 * len(want)


@pytest.mark.parametrize("block", [256, 3])
def test_similar_sets_leave_tasks_as_near_pairs_only(spark, monkeypatch, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    monkeypatch.setattr(dedup, "WIDE", block)
    rng, made, real = random.Random(36), {}, dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, label: made.setdefault(label, real(df, label)))
    sets = {}
    for i in range(400):
        old = dict(sets[rng.randrange(i)][1]) if i and rng.random() < 0.5 else {f"t{rng.randrange(60)}": rng.choice((3, 5, 10)) for _ in range(rng.randint(1, 25))}
        for _ in range(rng.randint(0, 2)):
            old[f"t{rng.randrange(60)}"] = rng.choice((3, 5, 10))
        sets[i] = (rng.randrange(2), old)
    want = set()
    for a in sets:
        for b in range(a + 1, len(sets)):
            (g, x), (h, y) = sets[a], sets[b]
            low = sum(min(x[t], y[t]) for t in x.keys() & y.keys())
            high = sum(x.values()) + sum(y.values()) - low
            if g == h and low * 10 >= high * 8:
                want.add((a, b, low, high))
    rows = spark.createDataFrame([(i, g, t, w) for i, (g, x) in sets.items() for t, w in x.items()], "doc_id long, g int, term string, w10 int")
    assert {tuple(r) for r in dedup.similar_sets(rows, 80, ("g",)).collect()} == want and len(want) > 100
    assert made["near"].count() < 2 * len(want)


def test_members_are_with_the_first_of_their_class(spark):
    """No link of ``d1_similar_postings`` is lost between different texts of equal terms, or of none."""
    posts = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "doc_id long")
    weights = spark.createDataFrame([(1, "x", 3), (3, "x", 3), (2, "y", 3)], "doc_id long, term string, w10 int")
    got = dedup.class_members(weights, dedup.posting_classes(weights, posts))
    assert sorted(map(tuple, got.collect())) == [(1, 3, 3, 3), (4, 5, 0, 0)]


def test_members_of_both_kinds_of_classes_hit(spark):
    """No member of ``d2_reuse_decision`` is lost: 1 to 4 have equal terms, 1 and 3, and 2 and 4, equal stems too."""
    pairs = lambda rows: spark.createDataFrame(rows, "doc_id long, cls long")
    got = dedup.member_hits(pairs([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]), pairs([(1, 1), (2, 2), (3, 1), (4, 2), (5, 5)]))
    assert sorted(map(tuple, got.collect())) == [(1, 2, "HIT"), (1, 3, "HIT"), (2, 4, "HIT")]
