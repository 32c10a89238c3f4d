"""The pipeline against plain Python, stage by stage, on a small corpus."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import curriculum_mix, decontaminate, quality_classifier


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(12))) for i in range(5)]
    docs, labels = [], []
    for i in range(260):
        words = [word() for _ in range(rng.randint(20, 60))]
        if i % 4 == 0:
            words = [w + "***" for w in words]
        elif i % 9 == 0:
            words[5:5] = items[i % 5][1].split()
        elif i % 10 == 1 and i > 20:
            words = docs[rng.choice([j for j in range(i) if j % 4 and j % 9])][1].split()
            words[-1] = word()
        docs.append((i, " ".join(words), "en", f"src{i % 3}", 0))
        labels.append((i, int(i % 4 != 0), 0))
    docs += [(300, None, None, None, None), (301, docs[1][1], "en", "src1", 0), (302, "", "en", "src0", 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, labels, items


def test_stages(spark, folder):
    path, docs, labels, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixture", "sharding"]
    df = spark.read.parquet(f"{path}/documents.parquet")
    good = corpus_pipeline.quality(spark, df, path)
    assert good.columns == df.columns
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    model = quality_classifier.fitted(spark, df, path)
    assert set(kept) == {d[0] for d in docs if model.scores([d[1]])[0] >= 0.5} and {i for i, q, _ in labels if q} <= set(kept)

    one = corpus_pipeline.near_duplicates(spark, good, path)
    sets = {}
    for i, text in kept.items():
        w = (text or "").lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in kept:
        for b in kept:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    unique = {i for i in kept if find(i) == i}
    assert one.columns == df.columns and {r["doc_id"] for r in one.collect()} == unique and len(unique) < len(kept)

    clean = corpus_pipeline.decontamination(spark, one, path)
    leaks = {i for i in unique if any(decontaminate.normal(t) in decontaminate.normal(kept[i] or "") for _, t in items)}
    left = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == df.columns and left == unique - leaks and leaks

    mixed = corpus_pipeline.mixture(spark, clean, path)
    rows = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == df.columns and set(rows) <= left and max(rows.count(i) for i in set(rows)) <= 2

    shards = corpus_pipeline.sharding(spark, mixed, path)
    assert sorted(r["doc_id"] for r in shards.collect()) == sorted(rows)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()) == sorted(rows)


def test_empty(spark, folder, tmp_path):
    path, *_ = folder
    for t in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{path}/{t}.parquet")
        (df.limit(0) if t == "documents" else df).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mixture_moves_texts_twice(spark):
    """Rows with their texts go through the window of their bucket and the range sort; the buckets' starts are rows beside them."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a b "), 5).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(20).alias("n_chars"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = curriculum_mix.stream(docs, carry=True)
        assert "Join" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
