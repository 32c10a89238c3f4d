"""Rules that SQL does not express, against hand-made cases and plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as V
from lodestone.functions.text import numbers, stems
from lodestone.operators import audit, dedup, events, gate, passages, selection
from lodestone.operators import similarity as sim
from lodestone.operators import terms as op


def test_titles(spark):
    cases = {
        1: ("About us\nJob title: Data Engineer\nMore", "Data Engineer"), 2: ("Senior Platform Engineer\nWe build things.", "Senior Platform Engineer"),
        3: ("One.\nTwo.\nThree.\nArea: Research > Test Analyst\ntext", "Test Analyst"), 4: ("We are great.\nWe are looking for a skilled backend developers to join.", "Backend developer"), 5: ("Nothing here", ""), 6: (None, ""),
    }
    docs = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "doc_id long, text string")
    assert {r["doc_id"]: r["title"] for r in op.extract_title(docs).collect()} == {k: v[1] for k, v in cases.items()}


def test_numbers(spark):
    cases = ["took 520 ms", "520ms", "4K users", "4,000", "v 1.2.3", "seven days", "one day", "twenty-one", "x2 a.5", None]
    docs = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r["i"]: [(n["value"], n["version"]) for n in r["n"] or []] for r in docs.select("i", numbers(F.col("t")).alias("n")).collect()}
    assert got == {0: [(520.0, None)], 1: [(520.0, None)], 2: [(4000.0, None)], 3: [(4000.0, None)], 4: [(None, "1.2.3")], 5: [(7.0, None)], 6: [], 7: [], 8: [], 9: []}


def test_stems(spark):
    got = spark.createDataFrame([("Reducing the reduced organisations' latencies, it's done.",)], "t string").select(stems(F.col("t")).alias("s")).first()["s"]
    assert got == ["reduc", "reduc", "organis", "latenci", "it's", "done"]


def test_labels(spark):
    df = spark.createDataFrame([("see p1 and p1-a, not p12",)], "t string")
    assert df.select(op.resolve_labels(F.col("t"), {"p1": "One", "p1-a": "One$A"}).alias("t")).first()["t"] == "see One and One$A, not p12"


def test_terms_borders(spark):
    terms = V.terms(spark, (("C", "C", True), ("C++", "C++", True), (".NET", ".NET", False), ("React", "react", False), ("React Native", "react native", False)))
    texts = spark.createDataFrame([(1, "C++ and .net"), (2, "a C# job"), (3, "React Native."), (4, "C, please"), (5, "reactive"), (6, None)], "doc_id long, text string")
    got = {(r[0], r[1]) for r in op.match_terms(texts, terms, ["doc_id"]).collect()}
    assert got == {(1, "C++"), (1, ".NET"), (3, "React"), (3, "React Native"), (4, "C")}


def test_guard(spark):
    terms, closure = V.terms(spark, (("SQL", "sql", False), ("Postgres", "postgres", False))), V.implies(spark, (("Postgres", "SQL"),))
    source = "Reduced the query latency of the Postgres service by 40 ms in 3 weeks"
    cases = {
        1: ("Reduced query latency by 40 ms", []), 2: ("", ["EMPTY"]), 3: ("Reduced query latency by 50 ms with sql", ["UNSUPPORTED_NUMBER:50"]),
        4: ("I reduced\nquery latency", ["MULTILINE", "FIRST_PERSON"]), 5: ("Bananas everywhere www.example.com", ["URL", "UNGROUNDED"]), 6: (None, ["EMPTY"]),
    }
    variants = spark.createDataFrame([(k, v[0], 100) for k, v in cases.items()], "k int, text string, budget int")
    sources = spark.createDataFrame([(k, source) for k in cases], "k int, text string")
    assert {r["k"]: r["reasons"] for r in gate.guard(variants, sources, terms, closure, ["k"], "budget").collect()} == {k: v[1] for k, v in cases.items()}


def test_siblings(spark):
    rows = [("o", "a", 1, "built parser"), ("o", "a", 2, "built parser quickly"), ("o", "a", 3, "painted houses"), ("o", "b", 1, "wrote docs"), ("o", "b", 2, "other thing"), ("o", "b", 3, "wrote docs twice")]
    got = {(r["cand_id"], r["length"]) for r in gate.sibling_consistency(spark.createDataFrame(rows, "owner_id string, cand_id string, length int, text string")).collect()}
    assert got == {("a", 1), ("a", 2), ("b", 1), ("b", 3)}


def test_drop_duplicates(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for owner in range(6):
        texts = []
        for i in range(12):
            t = list(rng.choice(texts)) if texts and rng.random() < 0.6 else [f"w{rng.randrange(40)}" for _ in range(10)]
            if rng.random() < 0.7:
                t[rng.randrange(len(t))] = f"w{rng.randrange(40)}"
            texts.append(t)
        kept = []
        for i, t in enumerate(texts):
            drop = any(len(set(t) & set(u)) * 100 >= 80 * len(set(t) | set(u)) for u in kept)
            want[owner, i] = drop
            kept += [] if drop else [t]
            rows.append((owner, i, i, 1, " ".join(t)))
    got = gate.drop_duplicates_in_order(spark.createDataFrame(rows, "owner_id int, cand_id int, pos int, length int, text string")).collect()
    assert {(r["owner_id"], r["cand_id"]): r["dropped"] for r in got} == want


def test_leaders_and_groups(spark):
    rng = random.Random(5)
    edges = sorted({(0, *sorted(rng.sample(range(25), 2))) for _ in range(40)})
    nodes = spark.createDataFrame([(0, i) for i in range(25)], "g int, node int")
    lead = set()
    for i in range(25):
        if not any((0, j, i) in edges for j in lead):
            lead.add(i)
    got = dedup.leaders(nodes, spark.createDataFrame(edges, "g int, a int, b int"), "g").collect()
    assert {r["node"] for r in got if r["leads"]} == lead
    root = {}
    for i in range(25):
        first = [j for j in range(i) if (0, j, i) in edges]
        root[i] = root[first[0]] if first else i
    got = dedup.achievement_groups(nodes.select(F.col("g").alias("owner_id"), F.col("node").alias("cand_id")), spark.createDataFrame(edges, "owner_id int, a int, b int"))
    assert {r["cand_id"]: r["root"] for r in got.collect()} == root


def test_live_reuse(spark):
    posts = spark.createDataFrame([("u", 1, 1), ("u", 2, 2), ("u", 3, 3), ("v", 4, 4)], "owner string, doc_id long, ord long")
    hits = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "a long, b long")
    assert {r["doc_id"]: r["reused"] for r in dedup.live_reuse(posts, hits).collect()} == {1: None, 2: 1, 3: None, 4: None}


def test_reuse_of_empty_postings(spark):
    """From weights to decisions, with several owners and an order that is not the ids': two postings without terms are a hit."""
    rows = [("u", 1, 9), ("u", 2, 3), ("v", 3, 8), ("v", 4, 2), ("v", 5, 5), ("w", 6, 1), ("w", 7, 4), ("w", 8, 6), ("u", 9, 7)]
    posts = spark.createDataFrame(rows, "owner string, doc_id long, ord long")
    terms = {7: {"x": 10}, 8: {"x": 10}}
    weights = spark.createDataFrame([(i, t, w) for i, ts in terms.items() for t, w in ts.items()], "doc_id long, term string, w10 long")
    classes = dedup.posting_classes(weights, posts)
    assert {r["doc_id"]: r["cls"] for r in classes.collect()} == {i: 7 if i in terms else 1 for i in range(1, 10)}
    pairs = dedup.similar_postings(weights, classes)
    assert pairs.count() == 0
    texts = dedup.text_classes(spark.createDataFrame([(7, "x", 1), (8, "x", 2)], "doc_id long, stem string, n long"), classes)
    decided = pairs.join(dedup.reuse_decision(pairs, spark.createDataFrame([], "a long, b long, cosine double")), ["a", "b"])
    members, links = dedup.memberships(decided, classes, texts)
    hit = lambda i, j: terms.get(i) == terms.get(j)
    batch, live, led = {}, {}, {}
    for owner, i, _ in (order := sorted(rows, key=lambda r: r[2])):
        batch[i] = next((j for _, j, _ in order if j in batch and hit(i, j)), None)
        live[i] = next((j for j in led.get(owner, [])[::-1] if hit(i, j)), None)
        if live[i] is None:
            led.setdefault(owner, []).append(i)
    assert live[3] == live[5] == 4 and live[9] == 2
    assert {r["doc_id"]: r["reused"] for r in dedup.live_reuse(posts, links, members).collect()} == live
    assert {r["doc_id"]: r["reused"] for r in dedup.batch_reuse(posts, links, members).collect()} == batch


def test_live_reuse_query_ties_empty_documents(spark, monkeypatch):
    from lodestone.plans import matching

    tables = {
        "documents": spark.createDataFrame([(1, "", "u"), (2, "zz", "v"), (3, "", "v"), (4, "", "u")], "doc_id long, text string, source string"),
        "benchmark": spark.createDataFrame([(1, "something else")], "item_id long, text string"),
    }
    monkeypatch.setattr(matching, "table", lambda spark, sf, name: tables[name])
    monkeypatch.setattr(matching, "docs", lambda spark, sf: tables["documents"].select("doc_id", "text"))
    assert {r["doc_id"]: r["reused"] for r in matching.d4(spark, "").collect()} == {1: None, 2: None, 3: 2, 4: 1}


def test_aliases(spark):
    pairs = {("K8s", "Kubernetes"): "numeronym", ("Node.js", "NodeJS"): "punctuation", ("NodeJS", "Node"): "affix", ("TS", "TypeScript"): "initialism", ("C", "C++"): None, ("Java", "JavaScript"): None}
    left, right = (spark.createDataFrame([(p[i],) for p in pairs], "name string") for i in (0, 1))
    got = {(r["a"], r["b"]): "+".join(r["rules"]) for r in dedup.alias_rules(left, right).collect()}
    assert {p: got.get(p) for p in pairs} == pairs


def test_nearest_names_brute_force(spark):
    """The best three of all names, also where the first characters differ or few names are alike."""
    left = ["ReactNative", "native-react", "testing", "Zzz", "x.y", "Data.Platform.Team", "Apple", "platforms"]
    right = ["Team.Data", "Platform", "Apple", "apple", "tested", "React.native", "Big.Data", "Data.Platform", "Aardvark", "Tests", "native-react", "Beta", "Platform.Data.Team"]
    table = lambda ns: spark.createDataFrame([(n, n) for n in ns], "id string, text string")
    every = {n: Counter(r["s"]) for n, r in zip(left + right, spark.createDataFrame([(n,) for n in left + right], "n string").select(stems(F.col("n")).alias("s")).collect(), strict=True)}

    def cosine(a, b):
        x, y = every[a], every[b]
        size = (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5
        return round(sum(n * y[w] for w, n in x.items()) / size, 6) if size else 0.0

    want = {a: sorted((b for b in right if b != a), key=lambda b: (-cosine(a, b), b))[:3] for a in left}
    assert any(cosine(a, b) > 0 and a[:5].lower() != b[:5].lower() for a, bs in want.items() for b in bs)
    found = {}
    for r in sim.nearest_texts(table(left), table(right)).collect():
        found.setdefault(r["query_id"], []).append((-r["similarity"], r["item_id"]))
    assert {a: [b for _, b in sorted(bs)] for a, bs in found.items()} == want


def test_alias_suggestions_take_all_names(spark, monkeypatch):
    """The query holds each name against all names, not only those with the same beginning."""
    from lodestone.plans import matching

    texts = {"conversations": ["Quality-testing and node.team"], "benchmark": ["team.node", "alpha beta gamma delta"]}
    monkeypatch.setattr(matching, "table", lambda spark, sf, name: spark.createDataFrame([(x,) for x in texts[name]], "text string"))
    got = {}
    for r in matching.d8(spark, "").where("tier = 'hint'").collect():
        got.setdefault(r["a"], set()).add(r["b"])
    assert got["node.team"] == {"team.node", "alpha", "beta"} and got["Quality-testing"] == {"alpha", "beta", "delta"}


def test_rate_limit_and_stream(spark, tmp_path):
    from lodestone.streaming import streams

    rng = random.Random(1)
    rows = sorted((rng.randrange(3), rng.randrange(0, 4000) * 1_000_000, i) for i in range(300))
    want, held = {}, {}
    for key, us, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        h = held[key] = [x for x in held.get(key, []) if x > us - 600_000_000]
        want[i] = len(h) < 4
        if want[i]:
            h.append(us)
    batch = events.rate_limit(spark.createDataFrame(rows, "key long, us long, id long"), 4, 600_000_000)
    assert {r["id"]: r["admitted"] for r in batch.collect()} == want
    files = str(tmp_path / "in")
    spark.createDataFrame(rows, "key long, us long, id long").select("key", "id", F.timestamp_micros("us").alias("ts")).write.parquet(files)
    got = streams.replayed(spark, files, "key long, id long, ts timestamp", lambda s: streams.rate_limit_stream(s, 4, 600_000_000), per_trigger=100)
    assert {r["id"]: r["admitted"] for r in got.collect()} == want


def test_idempotent(spark):
    h = 3_600_000_000
    rows = [("k", 0, 1), ("k", 23 * h, 2), ("k", 24 * h, 3), ("k", 47 * h, 4), ("j", 5, 5), (None, 1, 6)]
    got = events.idempotent_create(spark.createDataFrame(rows, "key string, us long, id long"), 24 * h).collect()
    assert {r["id"]: (r["created"], r["job"]) for r in got} == {1: (True, 1), 2: (False, 1), 3: (True, 3), 4: (False, 3), 5: (True, 5), 6: (True, 6)}


def test_clusters(spark):
    rows = [("k", t, t) for t in (0, 4, 8, 11, 12, 30)]
    got = audit.anchor_clusters(spark.createDataFrame(rows, "key string, at long, id long"), 10).collect()
    assert {r["id"]: r["cluster"] for r in got} == {0: 0, 4: 0, 8: 0, 11: 1, 12: 1, 30: 2}


def test_locate(spark):
    docs = spark.createDataFrame([(1, "intro\nalpha beta gamma del\nta epsilon zeta\nend\nsecond passage here now"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon", 2), (2, "second passage here", 1)], "item_id long, text string, ord int")
    hits = passages.passage_hits(docs, items)
    assert {(r["item_id"], r["first"], r["last"]) for r in passages.locate_passages(hits).collect()} == {(1, 1, 2), (2, 4, 4)}
    assert {(r["item_id"], r["first"]) for r in passages.locate_in_order(hits, items).collect()} == {(2, 4), (1, None)}


def test_assignment_brute_force(spark):
    rng = random.Random(7)
    rows = [(o, p, i, rng.randrange(5)) for o in range(20) for p in (1, 2, 3) for i in range(6)]
    got = selection.assign_projects(spark.createDataFrame(rows, "owner_id int, position int, project int, bp long"), 3).collect()
    score = {(o, p, i): b for o, p, i, b in rows}
    from itertools import permutations

    for r in got:
        o = r["owner_id"]
        best = min(permutations(range(6), 3), key=lambda t: ([-score[o, p + 1, t[p]] for p in range(3)], t))
        assert tuple(r["projects"]) == best


def test_rejections(spark):
    rows = [(0, p, i, 10 - i) for p in (1, 2) for i in range(4)]
    scores = spark.createDataFrame(rows, "owner_id int, position int, project int, bp long")
    bad = spark.createDataFrame([(0, 1, 0), (0, 1, 1)], "owner_id int, position int, project int")
    r = selection.resolve_with_rejections(scores, 2, bad).first()
    assert (r["projects"], r["degraded"]) == ([2, 0], [])
    bad = spark.createDataFrame([(0, 1, i) for i in range(4)], "owner_id int, position int, project int")
    r = selection.resolve_with_rejections(scores, 2, bad, rounds=1).first()
    assert r["degraded"] == [1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert op.term_weights(docs, V.terms(spark), **V.SAMPLE).count() == 0
    assert op.extract_title(docs).count() == 0
    assert events.rate_limit(spark.createDataFrame([], "key long, us long, id long"), 1, 1).count() == 0


@pytest.mark.parametrize("parts", ["1", "17"])
def test_partitions_do_not_matter(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    docs = spark.createDataFrame([(i, f"Skills needed:\nthat with der {i}\nfrom que") for i in range(9, 0, -1)], "doc_id long, text string")
    got = sorted(tuple(r) for r in op.top_terms(op.term_weights(docs, V.terms(spark), **V.SAMPLE)).collect())
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert got[0] == (1, "der, that, with") and len(got) == 9


def test_upsert(spark, tmp_path):
    from lodestone.streaming import streams

    path = str(tmp_path / "latest")
    schema = "job long, seq long, stage string, day string"
    streams.upsert(spark.createDataFrame([(1, 1, "a", "d1"), (1, 2, "b", "d1"), (2, 1, "a", "d2")], schema), path, ["job"], "seq", "day")
    streams.upsert(spark.createDataFrame([(1, 3, "c", "d1"), (3, 1, "a", "d1"), (1, 0, "z", "d1")], schema), path, ["job"], "seq", "day")
    got = {(r["job"], r["seq"], r["stage"], r["day"]) for r in spark.read.parquet(path).collect()}
    assert got == {(1, 3, "c", "d1"), (3, 1, "a", "d1"), (2, 1, "a", "d2")}


def test_lease_stream(spark, tmp_path):
    from lodestone.streaming import streams

    s = 1_000_000
    rows = [(1, 9 * s, 1, "claim"), (1, 59 * s, 2, "heartbeat"), (1, 109 * s, 3, "end"), (2, 9 * s, 4, "claim"), (2, 509 * s, 5, "claim"), (2, 1509 * s, 6, "end"), (3, 4009 * s, 7, "claim")]
    files = str(tmp_path / "in")
    spark.createDataFrame(rows, "key long, us long, id long, what string").select("key", "id", "what", F.timestamp_micros("us").alias("ts")).repartition(1).write.parquet(files)
    got = streams.replayed(spark, files, "key long, id long, what string, ts timestamp", lambda d: streams.lease_stream(d, lease=60 * s), per_trigger=10)
    assert {(r["key"], r["us"], r["outcome"]) for r in got.collect() if r["key"] < 3} == {(2, 69 * s, "queued"), (2, 569 * s, "WORKER_LOST")}


def test_session_and_late(spark):
    rows = [(0, "a"), (300, "a"), (1200, "a")]
    df = spark.createDataFrame(rows, "s long, event_type string").select(F.timestamp_seconds("s").alias("ts"), "event_type")
    got = sorted((r["start"].timestamp(), r["n"]) for r in events.windowed_counts(df, "session", "10 minutes").collect())
    assert [n for _, n in got] == [2, 1]


def test_purge_and_tokens(spark):
    t = spark.createDataFrame([(1, 7, 2.0, "x"), (2, 8, 3.0, "y")], "id long, user long, cost double, note string")
    left = events.purge({"a": t, "ledger": t}, spark.createDataFrame([(7,)], "user long"))
    assert [r["id"] for r in left["a"].collect()] == [2]
    assert {(r["id"], r["note"]) for r in left["ledger"].collect()} == {(1, None), (2, "y")}
    requests = spark.createDataFrame([("t", 1, 1, True), ("t", 2, 2, False), ("t", 3, 3, False), ("t", 99, 4, False), ("u", 1, 5, False)], "token string, us long, id long, peek boolean")
    got = events.token_use(requests, spark.createDataFrame([("t", 50)], "token string, expires long")).collect()
    assert {r["id"]: r["outcome"] for r in got} == {1: "valid", 2: "valid", 3: "used", 4: "expired", 5: "unknown"}


def test_streams_over_several_batches(spark):
    """State crosses micro-batches: the rate limit and the idempotent creation equal the batch rules, row by row."""
    from lodestone.durable import new_folder
    from lodestone.operators import events as ev
    from lodestone.streaming import streams

    rng = random.Random(12)
    us = sorted(rng.sample(range(1_700_000_000, 1_700_000_000 + 40_000), 160))
    rows = [(u * 10**6, rng.randrange(3), i) for i, u in enumerate(us)] + [(us[-1] * 10**6 + 10**12, 0, 999)]  # the last one ends all timers
    df = spark.createDataFrame(rows, "us long, key long, id long").withColumn("ts", F.timestamp_micros("us"))
    path = new_folder(spark, "input")
    for i in range(4):
        part = df.where((F.col("id") >= 40 * i) & ((F.col("id") < 40 * i + 40) | (F.lit(i) == 3)))
        part.select("ts", "key", "id").coalesce(1).write.mode("append").parquet(path)
    limit = streams.replayed(spark, path, "ts timestamp, key long, id long", lambda s: streams.rate_limit_stream(s, 4, ev.HOUR))
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(limit, ev.rate_limit(df.select("key", "us", "id"), 4, ev.HOUR)) and limit.where("not admitted").count() > 5
    made = streams.replayed(spark, path, "ts timestamp, key long, id long", lambda s: streams.idempotent_stream(s, ev.HOUR))
    assert same(made, ev.idempotent_create(df.select("key", "us", "id"), ev.HOUR)) and made.where("not created").count() > 5


def test_report_as_of_line(spark):
    from lodestone.operators import events as ev

    runs = spark.createDataFrame([("a", 1, "r1", 5), ("a", 3, "r3", 4), ("a", 3, "r3b", 9), ("b", 2, "q", 1), ("b", None, "x", 99)], "section string, version int, report string, started int")
    asked = spark.createDataFrame([(0,), (1,), (2,), (3,), (3,), (None,)], "version int")
    want = {}
    for s, v, r, t in runs.collect():
        for (q,) in asked.distinct().collect():
            if q is not None and v is not None and v <= q:
                want[s, q] = max(want.get((s, q), (-1, -1, "")), (t, v, r))
    got = {(r["section"], r["version"]): r["report"] for r in ev.report_as_of(runs, asked).collect()}
    assert got == {k: v[2] for k, v in want.items()} and len(got) == 5


def test_more_than_three_lengths_are_refused(spark):
    from lodestone.operators import selection as sel

    items = spark.createDataFrame([("p", i, i) for i in range(1, 5)], "project string, item int, length int")
    slots = spark.createDataFrame([("s", i, i) for i in range(1, 5)], "position string, slot_idx int, length int")
    with pytest.raises(Exception, match="more than three lengths"):
        sel.coverage(items, slots).collect()


def test_alternatives(spark):
    """The best two of all unused projects and all unused groups, against every assignment and every slot."""
    rng = random.Random(11)
    shape, scores, cands = [(0, 1), (1, 1), (2, 2)], [], []
    for owner in range(8):
        scores += [(owner, p, project, rng.randrange(0, 300, 20) or None) for p in (1, 2) for project in range(4)]
        for c in range(7 if owner else 0):  # owner 0 has none: slots stay empty
            cands += [(owner, f"c{c}", n, f"g{c // 2}" if c < 6 else None, rng.randrange(0, 300, 50)) for n in rng.sample((1, 2), rng.randint(1, 2))]
    slots = spark.createDataFrame([(o, i, n) for o in range(8) for i, n in shape], "owner_id int, slot_idx int, length int")
    c = spark.createDataFrame(cands, "owner_id int, cand_id string, length int, grp string, bp long")
    m = spark.createDataFrame(scores, "owner_id int, position int, project int, bp long")
    best, filled = selection.assign_projects(m, 2), selection.fill_slots(slots, c)
    got = selection.alternatives(m, 2, best, job=(slots, c, filled)).collect()
    taken = {(r["owner_id"], r["slot_idx"]): r["cand_id"] for r in filled.collect()}
    want = []
    for owner in range(8):
        by = {(p, project): bp for o, p, project, bp in scores if o == owner and bp is not None}
        full = [((by[1, a], by[2, b]), (a, b)) for a in range(4) for b in range(4) if a != b and (1, a) in by and (2, b) in by]
        first = lambda x: (tuple(-v for v in x[0]), x[1])
        if not full:
            continue
        usual = min(full, key=first)
        own = {(i, n): (g, bp) for o, i, n, g, bp in cands if o == owner}
        held = [taken[owner, i] for i, _ in shape]
        at = [own[held[i], n][1] if held[i] else 0 for i, n in shape]
        options = []
        for x in range(4):
            if x not in usual[1] and (with_x := [f for f in full if x in f[1]]):
                s, ps = min(with_x, key=first)
                gone = ", ".join(str(p) for p in sorted(set(usual[1]) - set(ps)))
                options.append((-sum(s) - sum(at), f"includes {x} instead of {gone}", ps, None, None))
        used = {own[k][0] for k in own if k[0] in held}
        for g in {g for g, _ in own.values() if g} - used:
            gain, i, cand = max((bp - at[i], -i, [-ord(ch) for ch in k]) for (k, n), (grp, bp) in own.items() if grp == g for i, length in shape if n == length)
            options.append((-sum(usual[0]) - sum(at) - gain, f"includes achievement {g}", usual[1], -i, "".join(chr(-ch) for ch in cand)))
        want += [(owner, r + 1, label, ps, i, k, -t) for r, (t, label, ps, i, k) in enumerate(sorted(options, key=lambda o: o[:2])[:2])]
    assert sorted((r["owner_id"], r["r"], r["label"], tuple(r["projects"]), r["slot_idx"], r["cand_id"], r["total"]) for r in got) == sorted(want)
    assert any("achievement" in w[2] for w in want) and any("instead" in w[2] for w in want)


def test_default_dictionary(spark):
    """A real posting with the default headings and terms: sections, weights, the title's terms at 10, what is implied."""
    from lodestone.functions import dictionary as D

    text = """Senior Data Engineer (Kafka)
About us
We love Redis and Excel.
What you'll do
Build pipelines in PySpark on AWS.
Requirements:
Python and postgres
Terraform is a plus
Nice to have:
k8s or Go"""
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    terms, closure = V.terms(spark, D.TERMS), V.implies(spark, D.IMPLIES)
    got = {r["term"]: r["w10"] for r in op.term_weights(docs, terms, op.extract_title(docs)).collect()}
    assert got == {"Kafka": 10, "PySpark": 5, "AWS": 5, "Python": 10, "PostgreSQL": 10, "Terraform": 5, "Kubernetes": 5, "Go": 5}
    named = op.match_terms(docs, terms, ["doc_id"])
    assert {r["canonical"] for r in op.implied_terms(named, closure, ["doc_id"]).collect()} == {*got, "Redis", "SQL", "Spark"}
    headings = spark.createDataFrame([("Work Experience",), ("PROJECTS",), ("Education",), ("Hobbies",)], "heading string")
    assert [r["role"] for r in op.section_role(headings).collect()] == ["experience", "projects", "education", "other"]


def test_terms_without_a_broadcast(spark, monkeypatch):
    rng = random.Random(39)
    rows = [(i % 40, " ".join(rng.choice(["that", "with", "der", "zz", "In", "is,", "de la"]) for _ in range(6))) for i in range(60)] + [(50, None), (51, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, op.match_terms(docs, V.terms(spark), ["doc_id"]).collect()))
    monkeypatch.setattr(op, "DICTIONARY", 0)
    assert sorted(map(tuple, op.match_terms(docs, V.terms(spark), ["doc_id"]).collect())) == want and len(want) > 50


def test_borders_beside_letters_that_are_not_ascii(spark):
    """As in the SQL twins: a border is one of ASCII words."""
    import duckdb

    from lodestone.plans.matching import reasons_sql
    from lodestone.plans.terms import HEADINGS_SQL, LINES_SQL, titles_sql

    cases = [(1, "Étion rest"), (2, "the ñthat"), (3, "x > yy ñheaté"), (4, "and as a ßbig withü"), (5, "a.comé"), (6, "éas a big tion."), (7, "that")]
    con = duckdb.connect()
    con.execute("create table documents(doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", cases)
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    titles = con.execute(f"WITH {LINES_SQL}, {HEADINGS_SQL}, {titles_sql(V.ROLE_NAMES)} SELECT doc_id, title FROM titles").fetchall()
    assert sorted(map(tuple, op.extract_title(docs, V.ROLE_NAMES).collect())) == sorted(titles)
    reasons = con.execute(f"SELECT doc_id, {reasons_sql('text', '2000')} FROM documents").fetchall()
    assert sorted(map(tuple, docs.select("doc_id", gate.format_reasons(F.col("text"), F.lit(2000))).collect())) == sorted(reasons)
