"""Every operator and the pipeline on tables with nulls, empty and very long texts, repeated ids and rows, and extra columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import registry

CLASH = ("size", "score", "license", "part", "row", "id", "key", "position", "bits", "host", "digest", "bad", "rank", "words", "x", "index", "length", "start", "ids", "n", "h", "guest", "sigs", "label")
ONE_ROW_A_ROW = (
    "op2_extendible_shards", "op4_quality_classifier", "op5_license_scan", "op6_secret_scan", "op7_ngram_jaccard", "op8_curriculum_mix", "op9_imatch", "op11_importance_resampling",
)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(51)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))
    docs = [(i, text(rng.randint(5, 40)) + (" fine plain words" if i % 4 else " ### *** %%%"), rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), i) for i in range(60)]
    docs += [(None, None, None, None, None), (None, docs[3][1], "en", "a", 0), (60, "", "en", "a", 0), (61, "w " * 1_500_000, "en", "b", 0), docs[5], docs[5], (7, text(9), "fr", None, 1)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(40)] + [(None, 1, 1), (3, None, None), (5, 0, 0)]
    pages = [(i, f"http://{rng.choice('abc')}.com/{i}", text(200)) for i in range(40)] + [(None, None, None), (None, "x", "y"), (1, "http://a.com/", "w " * 1_500_000), (41, "", ""), (2, "http://a.com/2", text(2))]
    items = [(1, docs[9][1]), (2, None), (None, "tiny"), (3, "")]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(30)] + [(None, None), (None, [0.0] * 5), (3, [1.0] * 5), (31, [])]
    path = str(tmp_path_factory.mktemp("odd"))
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"), "labels": (labels, "doc_id long, quality int, toxic int"),
        "pages": (pages, "page_id long, url string, html string"), "benchmark": (items, "item_id long, text string"), "embeddings": (vectors, "vec_id long, embedding array<float>"),
    }
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        df.withColumns({c: F.lit("clash") for c in CLASH if c not in df.columns}).repartition(3).write.parquet(f"{path}/{name}.parquet")
    return path, len(docs), len(pages)


@pytest.mark.parametrize("name", ONE_ROW_A_ROW)
def test_documents(spark, odd, name):
    path, rows, _ = odd
    out = registry.QUERIES[name](spark, path)
    assert out.count() == rows and out.where("doc_id is null").count() == 2


@pytest.mark.parametrize("name", ["op1_index_merge", "op10_url_reputation"])
def test_pages(spark, odd, name):
    path, _, rows = odd
    assert registry.QUERIES[name](spark, path).count() == rows


def test_others(spark, odd):
    path, rows, _ = odd
    assert registry.QUERIES["op3_decontaminate"](spark, path).count() >= 1
    assert registry.QUERIES["op12_whitening"](spark, path).count() == 4 * 32
    packed = registry.QUERIES["op13_cost_packing"](spark, path)
    assert packed.where("start = 0").count() == rows and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_pipeline(spark, odd):
    path, *_ = odd
    stages = [c for c, _ in spark.read.parquet(f"{path}/documents.parquet").dtypes]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == stages, name
    assert corpus_pipeline.run(spark, path).count() > 0
