"""Queries on similarity, the gate, and near-duplicates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.durable import written
from lodestone.functions import vocabulary as V
from lodestone.functions.text import stems
from lodestone.operators import dedup, gate
from lodestone.operators import similarity as sim
from lodestone.operators import terms as op
from lodestone.operators.topk import top_relevant
from lodestone.plans.catalog import query
from lodestone.plans.terms import CLOSURE_SQL, HEADINGS_SQL, LINES_SQL, TERMS_SQL, WEIGHTS_SQL, WITH_TERMS, docs, numbers_sql, stems_sql, weights
from lodestone.sources import table


def items(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", "text")


def turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def named_items(spark, sf):
    return op.implied_terms(op.match_terms(items(spark, sf), V.terms(spark), ["item_id"]), V.implies(spark), ["item_id"])


_COVERAGE = f"""{WITH_TERMS}, m AS (SELECT DISTINCT item_id, canonical FROM benchmark, terms WHERE regexp_matches(text, pattern)),
h AS (SELECT item_id, canonical FROM m UNION SELECT item_id, implied FROM m JOIN closure USING (canonical)),
coverage AS (SELECT item_id, doc_id, sum(w10)::BIGINT AS hit, any_value(total)::BIGINT AS total FROM tw JOIN h ON term = canonical JOIN (SELECT doc_id, sum(w10) AS total FROM tw GROUP BY 1) USING (doc_id) GROUP BY ALL)"""
_COSINE = f"""x AS (SELECT item_id, stem, count(*) AS n FROM (SELECT item_id, unnest({stems_sql('text')}) AS stem FROM benchmark) GROUP BY ALL),
y AS (SELECT doc_id, stem, count(*) AS n FROM (SELECT doc_id, unnest({stems_sql('text')}) AS stem FROM documents) GROUP BY ALL),
cosine AS (SELECT item_id, doc_id, sum(x.n * y.n) / (sqrt(any_value(sx)) * sqrt(any_value(sy))) AS cosine FROM x JOIN y USING (stem)
JOIN (SELECT item_id, sum(n * n) AS sx FROM x GROUP BY 1) USING (item_id) JOIN (SELECT doc_id, sum(n * n) AS sy FROM y GROUP BY 1) USING (doc_id) GROUP BY item_id, doc_id)"""
_RELEVANCE = "relevance AS (SELECT item_id, doc_id, (round(round(0.7::DOUBLE * coalesce(hit / total, 0) + 0.3::DOUBLE * coalesce(cosine, 0), 4) * 10000))::BIGINT AS bp FROM coverage FULL JOIN cosine USING (item_id, doc_id))"


@query("b1_keyword_coverage", f"{_COVERAGE} SELECT item_id, doc_id, hit, total FROM coverage")
def b1(spark, sf):
    return sim.keyword_coverage(named_items(spark, sf), weights(spark, sf))


@query("b2_stem_cosine", f"WITH {_COSINE} SELECT item_id, doc_id, round(cosine, 6) AS cosine FROM cosine")
def b2(spark, sf):
    return sim.stem_cosine(items(spark, sf), docs(spark, sf), "item_id", "doc_id").withColumn("cosine", F.round("cosine", 6))


@query("b3_relevance_top3", f"""{_COVERAGE}, {_COSINE}, {_RELEVANCE},
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY bp DESC, doc_id) AS r FROM relevance) SELECT item_id, doc_id, bp, r::INT AS r FROM r WHERE r <= 3""")
def b3(spark, sf):
    return top_relevant(named_items(spark, sf), weights(spark, sf), sim.stem_counts(items(spark, sf), "item_id"), sim.stem_counts(docs(spark, sf), "doc_id"))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"
_VECTORS = f"u AS (SELECT vec_id, label, {_UNIT} AS v FROM embeddings), pairs AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label = i.label AS same, least(greatest(list_dot_product(q.v, i.v), 0.0), 1.0) AS s FROM u q, u i WHERE q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id)"


def vector_pairs(spark, sf):
    """Vectors whose id is divisible by 50, a stated query set, against all."""
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"), "label")
    q = v.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "v", F.col("label").alias("ql"))
    return sim.against_all(q, v).select("query_id", "item_id", (F.col("ql") == F.col("label")).alias("same"), F.col("similarity").alias("s"))


@query("b4_vector_similarity", f"WITH {_VECTORS} SELECT query_id, item_id, round(s, 6) AS similarity FROM pairs")
def b4(spark, sf):
    return vector_pairs(spark, sf).select("query_id", "item_id", (F.floor(F.col("s") * 1e6 + 0.5) / 1e6).alias("similarity"))


@query("b5_nearest", f"""WITH {_VECTORS}, r AS (SELECT query_id, item_id, round(s, 6) AS similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 6) DESC, item_id) AS r FROM pairs)
SELECT query_id, item_id, similarity FROM r WHERE r <= 3""")
def b5(spark, sf):
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return sim.nearest(queries, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")))


@query("b5_approximate_nearest")
def b5a(spark, sf):
    """The same search through cells, for two large sides; tests hold its recall against ``b5_nearest``."""
    e = table(spark, sf, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    return sim.approximate_nearest(queries, e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")))


_ANSWERS = "SELECT a.conv_id, a.turn, a.text AS answer, s.text FROM conversations a JOIN conversations s ON a.conv_id = s.conv_id AND s.turn < a.turn WHERE a.role = 'assistant'"
_GROUND = f"""v AS (SELECT conv_id, turn, unnest({stems_sql('text')}) AS stem FROM conversations WHERE role = 'assistant'),
src AS (SELECT DISTINCT conv_id, turn, unnest({stems_sql('text')}) AS stem FROM ({_ANSWERS})),
g AS (SELECT conv_id, turn, count(*) AS words, count_if(EXISTS (SELECT 1 FROM src WHERE src.conv_id = v.conv_id AND src.turn = v.turn AND (src.stem = v.stem OR (len(src.stem) >= 5 AND len(v.stem) >= 5 AND left(src.stem, 5) = left(v.stem, 5)))))::BIGINT AS grounded FROM v GROUP BY ALL)"""


def answers(spark, sf):
    """Assistant turns as variants, and the turns before them as their sources."""
    all_ = turns(spark, sf)
    variants = all_.where("role = 'assistant'").select("conv_id", "turn", "text")
    before = all_.select("conv_id", F.col("turn").alias("t"), "text")
    return variants, variants.select("conv_id", "turn").join(before, "conv_id").where("t < turn").select("conv_id", "turn", "text")


@query("b6_grounding", f"WITH {_GROUND} SELECT conv_id, turn, words, grounded FROM g")
def b6(spark, sf):
    variants, sources = answers(spark, sf)
    rows = lambda t: t.select("conv_id", "turn", F.explode(stems(F.col("text"))).alias("stem"))
    return sim.grounding(rows(variants), rows(sources), ["conv_id", "turn"])


_TOK = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda t: t <> ''))"


@query("b7_token_jaccard", f"""SELECT conv_id, a.turn, len(list_intersect({_TOK.format('a.text')}, {_TOK.format('b.text')}))::INT AS common,
len(list_distinct(list_concat({_TOK.format('a.text')}, {_TOK.format('b.text')})))::INT AS all_ FROM conversations a JOIN conversations b USING (conv_id) WHERE b.turn = a.turn + 1""")
def b7(spark, sf):
    a = turns(spark, sf).select("conv_id", "turn", F.col("text").alias("x"))
    b = turns(spark, sf).select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return sim.token_jaccard(a.join(b, ["conv_id", "turn"]), "x", "y").select("conv_id", "turn", "common", "all_")


@query("b8_weighted_jaccard", f"""{WITH_TERMS}, p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1),
l AS (SELECT a, b, sum(least(x.w10, y.w10)) AS low FROM p JOIN tw x ON x.doc_id = a JOIN tw y ON y.doc_id = b AND y.term = x.term GROUP BY ALL), t AS (SELECT doc_id, sum(w10) AS t FROM tw GROUP BY 1)
SELECT a, b, coalesce(low, 0)::BIGINT AS low, (coalesce(ta.t, 0) + coalesce(tb.t, 0) - coalesce(low, 0))::BIGINT AS high FROM p LEFT JOIN l USING (a, b) LEFT JOIN t ta ON ta.doc_id = a LEFT JOIN t tb ON tb.doc_id = b""")
def b8(spark, sf):
    ids = docs(spark, sf).select(F.col("doc_id").alias("a"))
    pairs = ids.join(docs(spark, sf).select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b")), "a")
    return sim.weighted_jaccard(pairs, weights(spark, sf))


@query("b9_pair_separation", f"""WITH {_VECTORS}, s AS (SELECT round(s * 10000)::BIGINT AS bp, same FROM pairs), cnt AS (SELECT bp, count_if(same) AS yes, count_if(NOT same) AS no FROM s GROUP BY bp),
sw AS (SELECT bp, (sum(yes) OVER d + sum(no) OVER () - sum(no) OVER d)::BIGINT AS ok, yes + no AS n FROM cnt WINDOW d AS (ORDER BY bp DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
best AS (SELECT max(ok) AS ok, sum(n)::BIGINT AS pairs FROM sw)
SELECT (SELECT min(bp) FROM s WHERE same) AS same_min, (SELECT max(bp) FROM s WHERE same) AS same_max, (SELECT min(bp) FROM s WHERE NOT same) AS other_min, (SELECT max(bp) FROM s WHERE NOT same) AS other_max,
(SELECT min(bp) FROM sw WHERE ok = best.ok) AS threshold, ok AS "right", pairs, ok = pairs AS separates FROM best""")
def b9(spark, sf):
    return sim.pair_separation(vector_pairs(spark, sf).select(F.floor(F.col("s") * 10_000 + 0.5).alias("bp"), "same"))


# The fixed patterns of ``gate``; DuckDB's look neither ahead nor behind.
_URL = gate.URL
_FIRST = gate.FIRST_PERSON.replace("(?<![\\w'])", "(^|[^\\w''])").replace("(?![\\w'])", "($|[^\\w''])")


def reasons_sql(x: str, budget: str) -> str:
    t = f"regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g')"
    return f"""CASE WHEN {t} = '' THEN ['EMPTY'] ELSE list_filter([CASE WHEN regexp_matches({x}, '[\\r\\n]') THEN 'MULTILINE' END, CASE WHEN regexp_matches({t}, '{_URL}') THEN 'URL' END,
CASE WHEN regexp_matches({t}, '{_FIRST}') THEN 'FIRST_PERSON' END, CASE WHEN len({t}) > {budget} THEN 'OVER_BUDGET' END], lambda r: r IS NOT NULL) END"""


@query("c1_format_reasons", f"SELECT doc_id, array_to_string({reasons_sql('text', '2000')}, ',') AS reasons FROM documents")
def c1(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(gate.format_reasons(F.col("text"), F.lit(2000)), ",").alias("reasons"))


@query("c2_unsupported_numbers", f"""WITH a AS ({numbers_sql('documents', 'doc_id')}), b AS (SELECT doc_id + 1 AS doc_id, value, version FROM a)
SELECT doc_id, value, version FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND b.value IS NOT DISTINCT FROM a.value AND b.version IS NOT DISTINCT FROM a.version)""")
def c2(spark, sf):
    """Each document against the one before it as its source."""
    d = docs(spark, sf)
    return gate.unsupported_numbers(d, d.withColumn("doc_id", F.col("doc_id") + 1), ["doc_id"])


@query("c3_unsupported_terms", f"""WITH RECURSIVE {TERMS_SQL}, {CLOSURE_SQL}, s AS (SELECT DISTINCT conv_id, turn, canonical FROM ({_ANSWERS}), terms WHERE regexp_matches(text, pattern)),
h AS (SELECT * FROM s UNION SELECT conv_id, turn, implied FROM s JOIN closure USING (canonical))
SELECT DISTINCT conv_id, turn, canonical FROM conversations c, terms WHERE role = 'assistant' AND regexp_matches(text, pattern) AND NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = c.conv_id AND h.turn = c.turn AND h.canonical = terms.canonical)""")
def c3(spark, sf):
    return gate.unsupported_terms(*answers(spark, sf), V.terms(spark), V.implies(spark), ["conv_id", "turn"])


def guarded(spark, sf):
    variants, sources = answers(spark, sf)
    return gate.guard(variants.withColumn("budget", F.lit(400)), sources, V.terms(spark), V.implies(spark), ["conv_id", "turn"], "budget")


_SHOWN = "CASE WHEN version IS NOT NULL THEN version WHEN value = floor(value) THEN value::BIGINT::VARCHAR{} ELSE value::VARCHAR END"


@query("c4_guard", f"""WITH RECURSIVE {TERMS_SQL}, {CLOSURE_SQL}, {_GROUND}, sources AS ({_ANSWERS}), vn AS ({numbers_sql("(SELECT * FROM conversations WHERE role = 'assistant')", 'conv_id, turn')}), sn AS ({numbers_sql('sources', 'conv_id, turn')}),
s AS (SELECT DISTINCT conv_id, turn, canonical FROM sources, terms WHERE regexp_matches(text, pattern)), h AS (SELECT * FROM s UNION SELECT conv_id, turn, implied FROM s JOIN closure USING (canonical)),
more AS (SELECT conv_id, turn, 1 AS k, {_SHOWN.format(" || '.0'")} AS o, 'UNSUPPORTED_NUMBER:' || {_SHOWN.format('')} AS reason FROM vn
WHERE NOT EXISTS (SELECT 1 FROM sn WHERE sn.conv_id = vn.conv_id AND sn.turn = vn.turn AND sn.value IS NOT DISTINCT FROM vn.value AND sn.version IS NOT DISTINCT FROM vn.version)
UNION ALL SELECT DISTINCT conv_id, turn, 2, canonical, 'UNSUPPORTED_TECH:' || canonical FROM conversations c, terms WHERE role = 'assistant' AND regexp_matches(text, pattern) AND NOT EXISTS (SELECT 1 FROM h WHERE h.conv_id = c.conv_id AND h.turn = c.turn AND h.canonical = terms.canonical)
UNION ALL SELECT conv_id, turn, 3, '', 'UNGROUNDED' FROM g WHERE grounded < 0.4::DOUBLE * words),
form AS (SELECT conv_id, turn, {reasons_sql('text', '400')} AS f FROM conversations WHERE role = 'assistant'), m AS (SELECT conv_id, turn, list(reason ORDER BY k, o, reason) AS l FROM more GROUP BY ALL)
SELECT conv_id, turn, array_to_string(CASE WHEN list_contains(f, 'EMPTY') THEN f ELSE list_concat(f, coalesce(l, [])) END, ',') AS reasons FROM form LEFT JOIN m USING (conv_id, turn)""")
def c4(spark, sf):
    return guarded(spark, sf).select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"))


def variants(spark, sf):
    """Each three turns of a conversation as lengths 1 to 3 of one candidate."""
    return turns(spark, sf).select(F.col("conv_id").alias("owner_id"), F.expr("turn div 3").alias("cand_id"), (F.col("turn") % 3 + 1).cast("int").alias("length"), "text")


@query("c5_sibling_consistency")
def c5(spark, sf):
    return gate.sibling_consistency(variants(spark, sf))


@query("c6_drop_duplicates_in_order")
def c6(spark, sf):
    """Documents of one source are candidates of one owner, in order of id."""
    d = table(spark, sf, "documents")
    cands = d.select(F.col("source").alias("owner_id"), F.col("doc_id").alias("cand_id"), F.col("doc_id").alias("pos"), F.lit(1).alias("length"), "text")
    return gate.drop_duplicates_in_order(cands)


@query("c7_gate_report", f"""WITH r AS (SELECT source, doc_id, {reasons_sql('text', '2000')} AS r FROM documents)
SELECT source, reason, count(*) AS candidates FROM (SELECT source, coalesce(r[1], 'PASSED') AS reason FROM r) GROUP BY ROLLUP (source, reason)""")
def c7(spark, sf):
    d = table(spark, sf, "documents")
    results = d.select("source", F.col("doc_id").alias("cand_id"), F.lit(1).alias("length"), gate.format_reasons(F.col("text"), F.lit(2000)).alias("reasons"))
    return gate.gate_report(results, "source")


@query("c8_gate_vs_labels", f"""WITH b AS (SELECT len({reasons_sql('text', '20000')}) = 0 AS p, quality = 1 AS g FROM documents JOIN labels USING (doc_id))
SELECT count(*) AS n, count_if(p AND g)::BIGINT AS "both", count_if(p)::BIGINT AS passed, count_if(g)::BIGINT AS good, round(count_if(p AND g) / count_if(p), 6) AS precision, round(count_if(p AND g) / count_if(g), 6) AS recall FROM b""")
def c8(spark, sf):
    results = docs(spark, sf).select(F.col("doc_id").alias("id"), (F.size(gate.format_reasons(F.col("text"), F.lit(20_000))) == 0).alias("passed"))
    return gate.gate_vs_labels(results, table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good")))


_WORDS = "w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\w+')) AS word FROM benchmark), words AS (SELECT word, '(?i)(^|[^\\w+#.])' || word || '($|[^\\w+#])' AS pattern FROM w WHERE len(word) >= 4)"
RICH = f"""WITH RECURSIVE {LINES_SQL}, {HEADINGS_SQL}, {WEIGHTS_SQL}, {_WORDS}, hit AS (SELECT doc_id, w10, line, unnest(list_distinct(regexp_extract_all(lower(line), '\\w+'))) AS word FROM weighted),
tw AS (SELECT doc_id, word AS term, max(w10) AS w10 FROM hit JOIN words USING (word) WHERE regexp_matches(line, pattern) GROUP BY ALL)"""
_PAIRS = f"""{RICH}, t AS (SELECT doc_id, sum(w10) AS t FROM tw GROUP BY 1),
s AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.w10, y.w10)) AS low FROM tw x JOIN tw y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tw)),
pairs AS (SELECT * FROM (SELECT a, b, low::BIGINT AS low, (ta.t + tb.t - low)::BIGINT AS high FROM s JOIN t ta ON ta.doc_id = a JOIN t tb ON tb.doc_id = b) WHERE low * 10 >= high * 8
UNION ALL SELECT (SELECT min(doc_id) FROM e), doc_id, 0, 0 FROM e WHERE doc_id > (SELECT min(doc_id) FROM e))"""


_CLASSES = "classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS cls FROM (SELECT doc_id, coalesce(sig, '') AS sig FROM documents LEFT JOIN (SELECT doc_id, string_agg(term || ':' || w10, ' ' ORDER BY term) AS sig FROM tw GROUP BY 1) USING (doc_id)))"


def benchmark_terms(spark, sf):
    """A dictionary of the words of at least four characters in ``benchmark``."""
    word = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("\\w+"), F.lit(0))).alias("alias")).where("length(alias) >= 4").distinct()
    pattern = F.concat(F.lit("(?i)(?<![\\w+#.])"), "alias", F.lit("(?![\\w+#])"))
    return word.select(F.col("alias").alias("canonical"), "alias", F.col("alias").alias("lead"), pattern.alias("pattern"))


def rich_weights(spark, sf):
    return op.term_weights(docs(spark, sf), benchmark_terms(spark, sf), **V.SAMPLE)


@query("a12_missing_terms", f"""{RICH}, seen AS (SELECT p_name AS text, unnest(list_distinct(regexp_extract_all(lower(p_name), '\\w+'))) AS word FROM part), m AS (SELECT DISTINCT word FROM seen JOIN words USING (word) WHERE regexp_matches(text, pattern)),
{CLOSURE_SQL}, h AS (SELECT word FROM m UNION SELECT implied FROM m JOIN closure ON canonical = word) SELECT doc_id, term FROM tw WHERE w10 >= 10 AND term NOT IN (SELECT word FROM h)""")
def a12(spark, sf):
    """The material is the names of all parts."""
    found = op.match_terms(table(spark, sf, "part"), benchmark_terms(spark, sf), ["p_partkey"], "p_name")
    return op.missing_terms(rich_weights(spark, sf), op.implied_terms(found, V.implies(spark), ["p_partkey"]))


def postings(spark, sf):
    """All documents as postings, whose owner is the source."""
    return table(spark, sf, "documents").select("doc_id", F.col("doc_id").alias("ord"), F.col("source").alias("owner"), "text")


def posting_pairs(spark, sf, rich=None):
    """Pairs of classes of postings with their first common term, and the classes, each made once; ``rich``: the weights, if written."""
    rich = written(rich_weights(spark, sf), "rich_weights") if rich is None else rich
    classes = dedup.posting_classes(rich, postings(spark, sf))
    return dedup.similar_postings(rich, classes, keyed=True), classes


@query("d1_similar_postings", f"""{_PAIRS}, {_CLASSES} SELECT a, b, low, high FROM pairs WHERE a IN (SELECT cls FROM classes) AND b IN (SELECT cls FROM classes) AND high > 0
UNION ALL SELECT cls, doc_id, coalesce(t, 0)::BIGINT, coalesce(t, 0)::BIGINT FROM classes LEFT JOIN t USING (doc_id) WHERE doc_id <> cls""")
def d1(spark, sf):
    """Pairs of classes of postings with equal weighted terms, by their smallest ids, and each other member with the first of its class."""
    rich = written(rich_weights(spark, sf), "rich_weights")
    classes = dedup.posting_classes(rich, postings(spark, sf))
    return dedup.similar_postings(rich, classes).unionByName(dedup.class_members(rich, classes))


@query("d1_posting_classes", f"{RICH}, {_CLASSES} SELECT doc_id, cls FROM classes")
def d1c(spark, sf):
    return dedup.posting_classes(rich_weights(spark, sf), postings(spark, sf))


_HITS = f"""{_PAIRS}, n AS (SELECT doc_id, stem, count(*) AS n FROM (SELECT doc_id, unnest({stems_sql('text')}) AS stem FROM documents) GROUP BY ALL), z AS (SELECT doc_id, sum(n * n) AS s FROM n GROUP BY 1),
c AS (SELECT a, b, sum(x.n * y.n) / (sqrt(any_value(za.s)) * sqrt(any_value(zb.s))) AS cosine FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b AND y.stem = x.stem JOIN z za ON za.doc_id = a JOIN z zb ON zb.doc_id = b WHERE low * 10 < high * 9 GROUP BY a, b),
decided AS (SELECT a, b, low, high, CASE WHEN low * 10 >= high * 9 OR coalesce(cosine, 0) >= 0.95 THEN 'HIT' ELSE 'MISS' END AS decision FROM pairs LEFT JOIN c USING (a, b))"""
_TEXTS = """texts AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY cls, sig) AS cls FROM (SELECT doc_id, cls, coalesce(sig, '') AS sig FROM classes LEFT JOIN (SELECT doc_id, string_agg(stem || ':' || n, ' ' ORDER BY stem) AS sig FROM n GROUP BY 1) USING (doc_id)))"""


def decisions(spark, sf, rich=None):
    """(decided pairs with low and high, classes by terms, classes by terms and stems).

    Stems tell apart the members of one class by terms and decide pairs of the band, so only the texts of these are cut into stems.
    """
    pairs, classes = posting_pairs(spark, sf, rich)
    shared = written(classes.join(classes.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1"), "cls", "left_semi").select("doc_id"), "shared")
    counts = lambda ids: sim.stem_counts(docs(spark, sf).join(ids, "doc_id", "left_semi"), "doc_id")
    texts = dedup.text_classes(counts(shared), classes)
    wide = written(dedup.band_pairs(pairs, classes, texts), "band_pairs")
    band = wide.where("low * 10 < high * 9")
    cosines = dedup.pair_cosines(band, counts(written(band.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "band")))
    return wide.join(dedup.reuse_decision(wide, cosines), ["a", "b"]), classes, texts


@query("d2_reuse_decision", f"""{_HITS}, {_CLASSES}, {_TEXTS} SELECT a, b, decision FROM decided WHERE high > 0 AND
CASE WHEN low * 10 >= high * 9 THEN a IN (SELECT cls FROM classes) AND b IN (SELECT cls FROM classes) ELSE a IN (SELECT cls FROM texts) AND b IN (SELECT cls FROM texts) END
AND (SELECT cls FROM classes WHERE doc_id = a) <> (SELECT cls FROM classes WHERE doc_id = b)
UNION ALL SELECT cls, doc_id, 'HIT' FROM texts WHERE doc_id <> cls UNION ALL SELECT c.cls, x.doc_id, 'HIT' FROM texts x JOIN classes c USING (doc_id) WHERE x.doc_id = x.cls AND c.cls <> c.doc_id""")
def d2(spark, sf):
    """Pairs of classes by terms where these decide, else of classes by terms and stems, and the members of both kinds of classes.

    Members of one class hit each other. A row of a text with the first of its stems' class says that it shares that one's decisions;
    the first of a stems' class is in a row with that of its terms' class.
    """
    decided, classes, texts = decisions(spark, sf)
    return decided.select("a", "b", "decision").unionByName(dedup.member_hits(classes, texts))


@query("d3_batch_reuse", f"{_HITS} SELECT doc_id, (SELECT min(a) FROM decided WHERE b = doc_id AND decision = 'HIT') AS reused FROM documents")
def d3(spark, sf):
    members, links = dedup.memberships(*decisions(spark, sf))
    return dedup.batch_reuse(postings(spark, sf), links, members)


@query("d4_live_reuse")
def d4(spark, sf):
    members, links = dedup.memberships(*decisions(spark, sf))
    return dedup.live_reuse(postings(spark, sf), links, members)


@query("d5_leaders")
def d5(spark, sf):
    pairs, classes = posting_pairs(spark, sf)
    members = classes.select(F.lit("all").alias("g"), F.col("doc_id").alias("node"), "cls")
    return dedup.class_leaders(members, pairs.select("a", "b"), "g").select("node", "leads")


@query("d6_achievement_groups")
def d6(spark, sf):
    """Turns of a conversation as candidates, tied where either is half grounded in the other."""
    rows = turns(spark, sf).select(F.col("conv_id").alias("owner_id"), F.col("turn").alias("c"), F.explode(stems(F.col("text"))).alias("stem"))
    x, y = rows.withColumnRenamed("c", "x"), rows.withColumnRenamed("c", "y")
    ids = turns(spark, sf).select(F.col("conv_id").alias("owner_id"), F.col("turn").alias("x"))
    pairs = ids.join(ids.withColumnRenamed("x", "y"), "owner_id").where("x <> y")
    both = sim.grounding(pairs.join(x, ["owner_id", "x"]), pairs.join(y, ["owner_id", "y"]), ["owner_id", "x", "y"])
    ties = both.where("grounded * 2 >= words").select("owner_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return dedup.achievement_groups(turns(spark, sf).select(F.col("conv_id").alias("owner_id"), F.col("turn").alias("cand_id")), ties)




def _names_sql(source: str) -> str:
    """The names in a table and the keys of their spellings."""
    plain, parts = "regexp_replace(lower(name), '[\\s.-]', '', 'g')", "regexp_extract_all(regexp_replace(name, '([A-Z][a-z]+)', ' \\1 ', 'g'), '[A-Z][a-z]+|[a-z]+|[A-Z]+|\\d+')"
    return f"""SELECT *, CASE WHEN len(parts) >= 2 THEN upper(list_aggregate(list_transform(parts, lambda p: left(p, 1)), 'string_agg', '')) END AS initials, CASE WHEN upper(name) = name AND regexp_matches(name, '[A-Z]') THEN name END AS capitals,
CASE WHEN regexp_matches(plain, '^.{{2,}}(js|lang|ful)$') THEN regexp_replace(plain, '(js|lang|ful)$', '') END AS shorter, CASE WHEN regexp_matches(plain, '^[a-z]\\d+[a-z]$') THEN left(plain, 1) || regexp_replace(plain, '^.0*|.$', '', 'g') || right(plain, 1) END AS counted,
CASE WHEN len(plain) >= 2 THEN left(plain, 1) || (len(plain) - 2) || right(plain, 1) END AS spelled
FROM (SELECT name, {plain} AS plain, {parts} AS parts FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z.-]*[A-Za-z]')) AS name FROM {source}))"""


_SPELT = (("punctuation", "plain", "plain"), ("affix", "shorter", "plain"), ("affix", "plain", "shorter"), ("numeronym", "counted", "spelled"), ("numeronym", "spelled", "counted"), ("initialism", "initials", "capitals"), ("initialism", "capitals", "initials"))
_ALIASES = f"""l AS ({_names_sql('conversations')}), r AS ({_names_sql('benchmark')}),
alias AS (SELECT a, b, string_agg(DISTINCT rule, '+' ORDER BY rule) AS rules FROM ({' UNION ALL '.join(f"SELECT l.name AS a, r.name AS b, '{rule}' AS rule FROM l JOIN r ON l.{p} = r.{q}" for rule, p, q in _SPELT)}) WHERE a <> b GROUP BY a, b)"""


def names(spark, sf, source):
    found = table(spark, sf, source).select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z][A-Za-z.-]*[A-Za-z]"), F.lit(0)))).alias("name"))
    return found.distinct()


@query("d7_alias_rules", f"WITH {_ALIASES} SELECT a, b, rules FROM alias")
def d7(spark, sf):
    """Names in conversations that spell names in benchmark items otherwise."""
    return dedup.alias_rules(names(spark, sf, "conversations"), names(spark, sf, "benchmark")).select("a", "b", F.array_join("rules", "+").alias("rules"))


@query("d8_alias_suggestions", f"""WITH {_ALIASES}, x AS (SELECT name, stem, count(*) AS n FROM (SELECT name, unnest({stems_sql('name')}) AS stem FROM l) GROUP BY ALL), y AS (SELECT name, stem, count(*) AS n FROM (SELECT name, unnest({stems_sql('name')}) AS stem FROM r) GROUP BY ALL),
alike AS (SELECT x.name AS a, y.name AS b, round(sum(x.n * y.n) / (sqrt(any_value(sx)) * sqrt(any_value(sy))), 6) AS s FROM x JOIN y USING (stem)
JOIN (SELECT name, sum(n * n) AS sx FROM x GROUP BY 1) u ON u.name = x.name JOIN (SELECT name, sum(n * n) AS sy FROM y GROUP BY 1) v ON v.name = y.name GROUP BY x.name, y.name),
near AS (SELECT l.name AS a, r.name AS b FROM l JOIN r ON l.name <> r.name LEFT JOIN alike ON alike.a = l.name AND alike.b = r.name QUALIFY row_number() OVER (PARTITION BY l.name ORDER BY coalesce(s, 0.0) DESC, r.name) <= 3)
SELECT a, b, 'rule' AS tier, rules AS reason FROM alias UNION ALL SELECT a, b, 'hint', 'nearest' FROM near WHERE (a, b) NOT IN (SELECT (a, b) FROM alias)""")
def d8(spark, sf):
    """Rules, and as hints the three names with the most similar stems, of all names in benchmark items."""
    left, right = names(spark, sf, "conversations"), names(spark, sf, "benchmark")
    near = sim.nearest_texts(left.select(F.col("name").alias("id"), F.col("name").alias("text")), right.select(F.col("name").alias("id"), F.col("name").alias("text")))
    hints = near.select(F.col("query_id").alias("a"), F.col("item_id").alias("b"))
    return dedup.alias_suggestions(dedup.alias_rules(left, right), hints)


@query("d9_match_titles", """WITH s AS (SELECT lang AS owner_id, doc_id AS id, lower(trim(source)) AS key, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 0),
d AS (SELECT lang AS owner_id, doc_id AS id, doc_id AS ord, lower(trim(source)) AS key, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 1),
h AS (SELECT owner_id, count(*) AS have FROM s GROUP BY 1),
b AS (SELECT coalesce(s.owner_id, d.owner_id) AS owner_id, s.id AS section_id, d.id AS dataset_id, sum(CASE WHEN s.id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY coalesce(s.owner_id, d.owner_id) ORDER BY d.ord NULLS FIRST, d.id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS extra
FROM s FULL JOIN d ON s.owner_id = d.owner_id AND s.key = d.key AND s.n = d.n)
SELECT owner_id, section_id, dataset_id, CASE WHEN section_id IS NOT NULL AND dataset_id IS NOT NULL THEN 'matched' WHEN dataset_id IS NULL THEN 'unmatched section' WHEN coalesce(have, 0) + extra <= 100 THEN 'new section' ELSE 'unmatched dataset' END AS outcome FROM b LEFT JOIN h USING (owner_id)""")
def d9(spark, sf):
    """Documents of even ids as sections and of odd ids as datasets of their language, titled by source."""
    d = table(spark, sf, "documents").select(F.col("lang").alias("owner_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.concat("source", F.lit(": text")).alias("title"))
    return dedup.match_titles(d.where("id % 2 = 0"), d.where("id % 2 = 1"), most=100)
