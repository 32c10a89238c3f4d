"""What leaves the tasks stays in proportion to the input: rows of shuffles, and results against brute force where the way was changed."""

import random
from itertools import permutations

import pyarrow as pa
import pytest

from lodestone.operators import dedup, events, passages, selection, similarity


def shuffled(spark, run) -> int:
    """Rows that were written to shuffles while ``run`` ran."""
    sc = spark.sparkContext

    def so_far() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large for it
    try:
        before = so_far()
        run()
        return so_far() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def stem_of(name: str):
    from pyspark.sql import functions as F

    from lodestone.functions.text import stem

    return stem(F.col(name)).alias("s")


def matrix(spark, owners: int, projects: int, seed: int, most: int = 40):
    rng = random.Random(seed)
    rows = [(o, p, i, rng.randrange(most) or None) for o in range(owners) for p in (1, 2, 3) for i in range(projects)]
    return rows, spark.createDataFrame(rows, "owner_id int, position int, project int, bp long")


def test_forced_projects_brute_force(spark):
    rows, scores = matrix(spark, 6, 7, 3, 6)
    forced = spark.createDataFrame([(o, i) for o in range(6) for i in range(8)], "owner_id int, forced int")
    by = {(o, p, i): b for o, p, i, b in rows if b is not None}
    want = {}
    for o in range(6):
        for f in range(7):
            full = [([-by[o, p + 1, t[p]] for p in range(3)], list(t)) for t in permutations(range(7), 3) if f in t and all((o, p + 1, t[p]) in by for p in range(3))]
            if full:
                lost, best = min(full)
                want[o, f] = best, [-x for x in lost]
    got = selection.assign_projects(scores, 3, forced=forced).collect()
    assert {(r["owner_id"], r["forced"]): (r["projects"], r["scores"]) for r in got} == want and len(got) == len(want)


def test_alternatives_shuffle_a_project_a_few_times(spark):
    """Forcing each unused project made ten shuffled rows of each of its scores."""
    _, scores = matrix(spark, 4, 500, 5)
    best = selection.assign_projects(scores, 3)
    assert shuffled(spark, lambda: selection.alternatives(scores, 3, best).collect()) < 5 * 4 * 3 * 500


def test_rejections_shuffle_scores_once(spark):
    """Each round went over all scores again."""
    _, scores = matrix(spark, 4, 500, 7)
    rejected = scores.where("project % 2 = 0").select("owner_id", "position", "project")
    assert shuffled(spark, lambda: selection.resolve_with_rejections(scores, 3, rejected).collect()) < 2 * 4 * 3 * 500


def test_vector_searches_by_blocks(spark, monkeypatch):
    """Vectors of several lengths, with nulls and not a number, copies and ties, against Spark's own expressions; each task multiplies a few pairs at once."""
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3 if i % 9 else 2)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [float("nan"), 0.0, 0.0]), (204, [0.0, 0.0, 0.0])]
    items = spark.createDataFrame(rows, "item_id long, v array<float>").repartition(3)
    queries = items.where("item_id % 4 = 0").select(items["item_id"].alias("query_id"), "v")
    pairs = queries.withColumn("q", similarity.unit(queries["v"])).drop("v").crossJoin(items.withColumn("i", similarity.unit(items["v"])).drop("v")).where("query_id <> item_id")
    want = {(r["query_id"], r["item_id"]): r["s"] for r in pairs.withColumn("s", similarity.vector_similarity(pairs["q"], pairs["i"])).collect()}
    monkeypatch.setattr(similarity, "PAIRS", 50)
    got = similarity.against_all(queries, items).collect()
    assert len(got) == len(want) and all(abs(r["similarity"] - want[r["query_id"], r["item_id"]]) < 1e-12 for r in got)
    best = {}
    for (q, i), s in want.items():
        best.setdefault(q, []).append((-round(s, 6), i))
    near = similarity.nearest(queries, items)
    assert {(r["query_id"], r["item_id"]) for r in near.collect()} == {(q, i) for q, v in best.items() for _, i in sorted(v)[:3]}
    assert "NestedLoop" not in near._jdf.queryExecution().toString()


def test_placements_are_made_once(spark, tmp_path):
    """The score of a project read the placements anew for each part."""
    from lodestone.plans import selection as plans

    spark.createDataFrame([(o, n, 10.0 * n) for o in range(30) for n in range(5)], "l_orderkey long, l_linenumber int, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert "lineitem" not in plans.project_scores(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plans.project_scores(spark, str(tmp_path)).count() == 60


def test_weights_are_made_once(spark, tmp_path):
    """The weighted Jaccard similarity made the weights anew for each of its four uses."""
    spark.createDataFrame([(1, "a", 5), (2, "a", 3), (2, "b", 2)], "doc_id long, term string, w10 int").write.parquet(f"{tmp_path}/w")
    out = similarity.weighted_jaccard(spark.createDataFrame([(1, 2)], "a long, b long"), spark.read.parquet(f"{tmp_path}/w"))
    assert [tuple(r) for r in out.collect()] == [(1, 2, 3, 7)]
    assert not any(str(f).startswith(f"file://{tmp_path}") or f"{tmp_path}/w" in str(f) for f in out.inputFiles())


def test_hits_leave_a_task_in_small_batches(monkeypatch):
    """All hits of a batch of texts were held together."""
    monkeypatch.setattr(passages, "HITS", 10)
    finder = passages.Finder(["alpha beta gamma", "alpha beta gamma delta"])
    texts = pa.record_batch({"doc_id": [7, 8], "text": ["\n".join(["alpha beta gamma delta"] * 20), "alpha beta gamma"]})
    out = list(passages._found(iter([texts]), pa.array([1, 2]), finder))
    assert max(len(b) for b in out) == 10 and sum(len(b) for b in out) == 42
    rows = [r for b in out for r in b.to_pylist()]
    assert sum(r["doc_id"] == 7 and r["item_id"] == 2 and r["first"] == r["last"] for r in rows) == 20


def near_copies(copies: int, terms: int, seed: int):
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(terms)]
    return {i: {t: rng.randint(1, 3) if rng.random() < 0.05 else 2 for t in base if rng.random() > 0.03} for i in range(copies)}


@pytest.mark.parametrize("cell", [2048, 7])
def test_near_copies_are_shuffled_once_a_term(spark, monkeypatch, cell):
    """Each pair of near copies was shuffled for each term that both began with, and then with the terms of both."""
    monkeypatch.setattr(dedup, "CELL", cell)
    sets = near_copies(60, 40, 3)
    rows = spark.createDataFrame([(i, t, w) for i, x in sets.items() for t, w in x.items()], "doc_id long, term string, w10 int")
    want = set()
    for a in sets:
        for b in range(a + 1, len(sets)):
            low = sum(min(sets[a][t], sets[b][t]) for t in sets[a].keys() & sets[b].keys())
            high = sum(sets[a].values()) + sum(sets[b].values()) - low
            if low * 10 >= high * 8:
                want.add((a, b, low, high))
    got = []
    n = shuffled(spark, lambda: got.extend(tuple(r) for r in dedup.similar_sets(rows, 80).collect()))
    assert set(got) == want and len(got) == len(want) > 1500
    assert cell == 7 or n < 2 * sum(map(len, sets.values()))


def test_sets_that_meet_at_many_terms_go_out_once(spark, monkeypatch):
    """A set left the comparison once for each of its first terms that a like one had, and large sets also with chance partners, each time with all terms."""
    rng, real, made, sets = random.Random(41), dedup.written, {}, {}
    monkeypatch.setattr(dedup, "written", lambda df, label: made.setdefault(label, real(df, label)))
    words = [f"w{i}" for i in range(3000)]
    for i in range(60):
        base = dict.fromkeys(rng.sample(words, rng.choice((5, 60, 300, 700))), 2)
        for copy in range(3):
            sets[3 * i + copy] = {t: rng.choice((2, 2, 2, 3)) for t in base if rng.random() > 0.02 * copy}
    rows = spark.createDataFrame([(i, t, w) for i, x in sets.items() for t, w in x.items()], "doc_id long, term string, w10 int")
    want = set()
    for a in sets:
        for b in range(a + 1, len(sets)):
            low = sum(min(sets[a][t], sets[b][t]) for t in sets[a].keys() & sets[b].keys())
            high = sum(sets[a].values()) + sum(sets[b].values()) - low
            if low * 10 >= high * 8:
                want.add((a, b, low, high))
    got = [tuple(r) for r in dedup.similar_sets(rows, 80).collect()]
    assert set(got) == want and len(got) == len(want) > 100
    assert made["cells"].count() < 2 * len(sets)


@pytest.mark.parametrize("cell", [2048, 7])
def test_cosines_shuffle_texts_and_not_pairs(spark, monkeypatch, cell):
    """Each pair of the band was shuffled once for each stem of its first text."""
    monkeypatch.setattr(dedup, "CELL", cell)
    texts = near_copies(60, 40, 5) | {60: {"alone": 2}, 61: {}}
    counts = spark.createDataFrame([(i, t, w) for i, x in texts.items() for t, w in x.items()], "doc_id long, stem string, n long")
    pairs = [(a % 3, a, b) for a in texts for b in texts if a < b]
    got, band = [], spark.createDataFrame(pairs, "k long, a long, b long")
    n = shuffled(spark, lambda: got.extend(dedup.pair_cosines(band, counts).collect()))
    dot = lambda x, y: sum(x[t] * y[t] for t in x.keys() & y.keys())
    want = {(a, b): dot(texts[a], texts[b]) / (dot(texts[a], texts[a]) ** 0.5 * dot(texts[b], texts[b]) ** 0.5) for _, a, b in pairs if dot(texts[a], texts[b])}
    assert {(r["a"], r["b"]): r["cosine"] for r in got} == want and len(got) == len(want)
    assert cell == 7 or n < 10_000


@pytest.mark.parametrize("few", [1 << 16, 10])
def test_reports_shuffle_runs_and_not_answers(spark, monkeypatch, few):
    """Each section's line held every question, so all answers were shuffled and sorted."""
    monkeypatch.setattr(events, "QUESTIONS", few)
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.randrange(2000), float(i), rng.randrange(50)) for i in range(300)]
    asked = [(v,) for v in range(0, 2100, 10)]
    got = []
    n = shuffled(spark, lambda: got.extend(events.report_as_of(spark.createDataFrame(rows, "section int, version long, report double, started int"), spark.createDataFrame(asked, "version long")).collect()))
    want = {}
    for s, v, r, t in rows:
        for (q,) in asked:
            if v <= q:
                want[s, q] = max(want.get((s, q), (-1, -1, -1.0)), (t, v, r))
    assert {(r["section"], r["version"]): r["report"] for r in got} == {k: v[2] for k, v in want.items()} and len(got) == len(want) > 5000
    assert few == 10 or n < 3000


def test_words_are_made_bare_once(spark):
    """Each suffix made a word bare anew, twice."""
    from lodestone.functions.text import stems

    df = spark.createDataFrame([("'Running- tests' working-- PARTIES it's",)], "text string")
    out = df.select(stems(df["text"]).alias("s"))
    assert out._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
    assert out.first()[0] == df.selectExpr("explode(regexp_extract_all(text, \"[A-Za-z][A-Za-z'-]+\", 0)) as w").select(stem_of("w")).agg({"s": "collect_list"}).first()[0]


def test_plain_words_are_joined_without_a_search(spark):
    """Each line was searched with a pattern of its own for every word that the dictionary has."""
    import re

    from pyspark.sql import functions as F

    from lodestone.operators import terms

    rng = random.Random(6)
    parts = ["heat", "Heat", "heat+", "+heat", ".heat", "heat.", "#heat#", "heater", "_heat", "ünheat", "heatü", "Kheat", "heatİ", "İ", "io", "IO", "k8s", "-k8s-", "(K8s)", "a_1", "A_1,"]
    texts = spark.createDataFrame([(i, rng.choice(["", " ", "\n", "/"]).join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for i in range(400)] + [(400, None)], "doc_id long, text string")
    words = ["heat", "io", "k8s", "a_1", "8s"]
    plain = spark.createDataFrame([(w, w, w, f"(?i)(?<![\\w+#.]){w}(?![\\w+#])") for w in words], "canonical string, alias string, lead string, pattern string")
    searched = plain.withColumn("pattern", F.concat(F.lit("(?:)"), "pattern"))
    rows = lambda t: sorted(map(tuple, terms.match_terms(texts, t, ["doc_id"]).collect()))
    want = rows(searched)
    assert rows(plain) == want and len(want) > 200
    assert rows(plain.where("alias in ('io', 'heat')").unionByName(searched.where("alias not in ('io', 'heat')"))) == want
    plan = terms.match_terms(texts, plain, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"RLIKE\(\w+#\d+, pattern", plan)


def test_a_summary_makes_weights_once_and_stems_of_shared_classes_only(spark, tmp_path, monkeypatch):
    """The weights were made for the pairs and again for the top terms, and all texts were cut into stems."""
    from pyspark.sql import functions as F

    from lodestone.operators import terms
    from lodestone.plans.registry import QUERIES

    weights, stems, made, cut = terms.term_weights, similarity.stem_counts, [], []
    monkeypatch.setattr(terms, "term_weights", lambda *a, **k: made.append(1) or weights(*a, **k))
    monkeypatch.setattr(similarity, "stem_counts", lambda t, *a, **k: cut.extend(r["doc_id"] for r in t.select("doc_id").collect()) or stems(t, *a, **k))
    words = [f"word{i}" for i in range(60)]
    rng = random.Random(2)
    texts = [" ".join(rng.sample(words, 20)) for _ in range(8)]
    texts += [texts[0], texts[0] + " other", texts[1].replace(texts[1].split()[0], "else")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("s")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(words))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r["reused"] for r in QUERIES["e15_batch_summary"](spark, str(tmp_path)).collect()}
    assert got == {i: {8: 0, 9: 0, 10: 1}.get(i) for i in range(11)}
    assert len(made) == 1 and set(cut) <= {0, 8, 9, 1, 10}


def test_scores_shuffle_only_what_items_have(spark):
    """Each scoring of pairs shuffled all stems of all documents, also those that no item has."""
    from lodestone.operators.topk import top_relevant

    rng = random.Random(8)
    docs = {i: {f"own{i}x{j}": 1 for j in range(200)} | {f"s{rng.randrange(30)}": rng.randint(1, 9) for _ in range(6)} for i in range(50)}
    items = {i: {f"s{rng.randrange(30)}": rng.randint(1, 3) for _ in range(5)} for i in range(8)}
    weights = {(i, f"t{rng.randrange(6)}"): rng.choice((3, 5, 10)) for i in docs for _ in range(2)}
    named = {(i, f"t{rng.randrange(6)}") for i in items if i % 2 for _ in range(2)}
    rows = lambda t: [(i, s, n) for i, x in t.items() for s, n in x.items()]
    frames = [
        spark.createDataFrame(sorted(named), "item_id long, canonical string"), spark.createDataFrame([(*k, w) for k, w in weights.items()], "doc_id long, term string, w10 long"),
        spark.createDataFrame(rows(items), "item_id long, stem string, n long"), spark.createDataFrame(rows(docs), "doc_id long, stem string, n long"),
    ]
    got = []
    n = shuffled(spark, lambda: got.extend(tuple(r) for r in top_relevant(*frames).select("item_id", "doc_id", "bp", "r").collect()))
    want = []
    for i, x in items.items():
        scored = []
        for d, y in docs.items():
            total = sum(w for (e, _), w in weights.items() if e == d)
            hit = sum(w for (e, t), w in weights.items() if e == d and (i, t) in named)
            dot = sum(x[s] * y[s] for s in x.keys() & y.keys())
            if hit or dot:
                cosine = dot / (sum(v * v for v in x.values()) ** 0.5 * sum(v * v for v in y.values()) ** 0.5)
                scored.append((-int(round(0.7 * hit / total + 0.3 * cosine, 4) * 10_000 + 0.5), d))
        want += [(i, d, -s, r + 1) for r, (s, d) in enumerate(sorted(scored)[:3])]
    assert sorted(got) == sorted(want) and len(want) > 20
    assert n < 30_000
