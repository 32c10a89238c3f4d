"""Queries on constrained selection, over order lines as scored candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.durable import written
from lodestone.operators import dedup
from lodestone.operators import selection as sel
from lodestone.operators import terms as op
from lodestone.plans.catalog import query
from lodestone.plans.matching import _HITS, decisions, postings, rich_weights
from lodestone.sources import table

_BP = "(l_extendedprice * 100)::BIGINT"
_CANDS = f"c AS (SELECT l_suppkey AS owner_id, l_orderkey * 10 + l_linenumber AS cand_id, 1 + l_linenumber % 2 AS length, l_partkey % 20 AS grp, {_BP} * 7 % 10000 AS bp FROM lineitem)"
_SLOTS = "(VALUES (0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1), (1, 2, 1)) s(position, slot_idx, length)"


def price(factor: int = 1, mod: int = 10_000):
    return F.round(F.col("l_extendedprice") * 100).cast("long") * factor % mod


def lines(spark, sf):
    return table(spark, sf, "lineitem")


def cands(spark, sf):
    """Order lines as candidates of their supplier."""
    return lines(spark, sf).select(
        F.col("l_suppkey").alias("owner_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cand_id"), (1 + F.col("l_linenumber") % 2).alias("length"),
        (F.col("l_partkey") % 20).alias("grp"), price(7).alias("bp"),
    )


def slots(spark):
    return spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 2), (1, 1, 1), (1, 2, 1)], "position int, slot_idx int, length int")


def item_scores(spark, sf):
    """Lines as items of their order; each has a text of length 1, and all but every third one of length 2."""
    one = lines(spark, sf).select(F.col("l_orderkey").alias("project"), F.col("l_linenumber").alias("item"), F.lit(1).alias("length"), price(3).alias("bp"))
    two = lines(spark, sf).where("l_linenumber % 3 <> 0").select(F.col("l_orderkey").alias("project"), F.col("l_linenumber").alias("item"), F.lit(2).alias("length"), price(11).alias("bp"))
    return one.unionByName(two).groupBy("project", "item", "length").agg(F.max("bp").alias("bp"))


_ITEMS = f"""i AS (SELECT project, item, length, max(bp) AS bp FROM (SELECT l_orderkey AS project, l_linenumber AS item, 1 AS length, {_BP} * 3 % 10000 AS bp FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 2, {_BP} * 11 % 10000 FROM lineitem WHERE l_linenumber % 3 <> 0) GROUP BY ALL)"""
_PLACED = f"""{_ITEMS}, two AS (SELECT a.project, 0 AS position, [a.item, b.item] AS items, a.bp + b.bp AS total FROM i a JOIN i b ON a.project = b.project AND a.item <> b.item WHERE a.length = 1 AND b.length = 2),
three AS (SELECT a.project, 1 AS position, [a.item, b.item, c.item] AS items, a.bp + b.bp + c.bp AS total FROM i a JOIN i b ON a.project = b.project AND a.item <> b.item JOIN i c ON a.project = c.project AND c.item NOT IN (a.item, b.item)
WHERE a.length = 2 AND b.length = 1 AND c.length = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY project, position ORDER BY total DESC, items) AS r FROM (SELECT * FROM two UNION ALL SELECT * FROM three)),
placed AS (SELECT project, position, items, total, round(total / len(items))::BIGINT AS mean FROM r WHERE r = 1)"""


@query("e1_rank_candidates", f"WITH {_CANDS} SELECT owner_id, cand_id, length, bp, row_number() OVER (PARTITION BY owner_id, length ORDER BY bp DESC, cand_id)::INT AS r FROM c")
def e1(spark, sf):
    return sel.rank_candidates(cands(spark, sf)).select("owner_id", "cand_id", "length", "bp", "r")


@query("e2_fill_slots", f"""WITH {_CANDS}, s0 AS (SELECT owner_id, min(struct_pack(b := -bp, c := cand_id, g := grp)) AS x FROM c WHERE length = 1 GROUP BY 1),
s1 AS (SELECT c.owner_id, min(struct_pack(b := -bp, c := cand_id, g := grp)) AS x FROM c JOIN s0 ON s0.owner_id = c.owner_id WHERE length = 1 AND grp <> s0.x.g GROUP BY 1),
s2 AS (SELECT c.owner_id, min(struct_pack(b := -bp, c := cand_id, g := grp)) AS x FROM c LEFT JOIN s0 ON s0.owner_id = c.owner_id LEFT JOIN s1 ON s1.owner_id = c.owner_id WHERE length = 2 AND grp IS DISTINCT FROM s0.x.g AND grp IS DISTINCT FROM s1.x.g GROUP BY 1),
o AS (SELECT s_suppkey AS owner_id FROM supplier)
SELECT owner_id, 0 AS slot_idx, s0.x.c AS cand_id FROM o LEFT JOIN s0 USING (owner_id) UNION ALL SELECT owner_id, 1, s1.x.c FROM o LEFT JOIN s1 USING (owner_id) UNION ALL SELECT owner_id, 2, s2.x.c FROM o LEFT JOIN s2 USING (owner_id)""")
def e2(spark, sf):
    return sel.fill_slots(own_slots(spark, sf), cands(spark, sf))


def own_slots(spark, sf):
    """Three slots of every supplier."""
    shape = F.explode(F.array(*[F.struct(F.lit(i).alias("slot_idx"), F.lit(n).alias("length")) for i, n in ((0, 1), (1, 1), (2, 2))])).alias("s")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("owner_id"), shape).select("owner_id", "s.*")


@query("e3_place_items", f"WITH {_PLACED} SELECT project, position, array_to_string(items, ',') AS items, total, mean FROM placed")
def e3(spark, sf):
    return placed(spark, sf).select("project", "position", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "total", "mean")


def placed(spark, sf):
    return sel.place_items(item_scores(spark, sf), slots(spark))


_SCORED = "scored AS (SELECT project, position, CASE WHEN project % 2 = position OR position = 0 THEN mean + CASE WHEN position = 1 THEN round((project % 1000) * 3 / 10)::BIGINT ELSE 0 END END AS bp FROM placed)"


def project_scores(spark, sf):
    """Position 0 takes the section of every project, position 1 that of odd ones only; position 1 shows the detail."""
    p = written(placed(spark, sf), "placed")
    keys = p.select("project").distinct()
    pos = spark.createDataFrame([(0, "any", False), (1, "odd", True)], "position int, section string, shows_detail boolean")
    homes = p.select("project", "position").select("project", F.when(F.col("position") == 0, "any").when(F.col("project") % 2 == 1, "odd").otherwise("even").alias("section"), F.col("position").alias("at"))
    detail = keys.select("project", (F.col("project") % 1000).alias("detail_bp"))
    out = None
    for i in (0, 1):
        one = sel.project_score(p.where(F.col("position") == i), pos, homes.where(F.col("at") == i).drop("at"), detail)
        out = one if out is None else out.unionByName(one)
    return out


@query("e4_project_score", f"WITH {_PLACED}, {_SCORED} SELECT project, position, bp FROM scored")
def e4(spark, sf):
    return project_scores(spark, sf)


_MATRIX = f"m AS (SELECT l_suppkey AS owner_id, p AS position, l_partkey AS project, max({_BP} * (p * 13) % 10000) AS bp FROM lineitem, (VALUES (1), (2), (3)) v(p) GROUP BY ALL)"


def _assigned_sql(source: str, name: str) -> str:
    return f"""{name}k AS (SELECT *, row_number() OVER (PARTITION BY owner_id, position ORDER BY bp DESC, project) AS k FROM {source}),
{name}x AS (SELECT a.owner_id, [a.project, b.project, c.project] AS projects, [a.bp, b.bp, c.bp] AS scores FROM {name}k a JOIN {name}k b ON a.owner_id = b.owner_id JOIN {name}k c ON a.owner_id = c.owner_id
WHERE a.position = 1 AND b.position = 2 AND c.position = 3 AND a.k <= 3 AND b.k <= 3 AND c.k <= 3 AND a.project <> b.project AND c.project NOT IN (a.project, b.project)),
{name} AS (SELECT owner_id, projects, scores FROM (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY scores[1] DESC, scores[2] DESC, scores[3] DESC, projects) AS r FROM {name}x) WHERE r = 1)"""


def matrix(spark, sf):
    """Suppliers as owners, parts as projects, three positions."""
    rows = lines(spark, sf).select(F.col("l_suppkey").alias("owner_id"), F.col("l_partkey").alias("project"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("c"))
    wide = rows.repartition("owner_id").groupBy("owner_id", "project").agg(*[F.max(F.col("c") * (p * 13) % 10_000).alias(f"p{p}") for p in (1, 2, 3)])  # one shuffle, also for what goes by owner later
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("position"), F.col(f"p{p}").alias("bp")) for p in (1, 2, 3)])).alias("s")
    return wide.select("owner_id", at, "project").select("owner_id", "s.position", "project", "s.bp")


def _shown(df, *more):
    return df.select("owner_id", *more, F.array_join(F.col("projects").cast("array<string>"), ",").alias("projects"), F.array_join(F.col("scores").cast("array<string>"), ",").alias("scores"))


@query("e5_assign_projects", f"""WITH {_MATRIX}, u AS (SELECT owner_id, position, project, CASE WHEN project % 10 = 0 THEN bp // 2 ELSE bp END AS bp FROM m WHERE NOT (project % 7 = 0 AND position = 1)), {_assigned_sql('u', 'a')}
SELECT owner_id, array_to_string(projects, ',') AS projects, array_to_string(scores, ',') AS scores FROM a""")
def e5(spark, sf):
    """Parts divisible by 7 are excluded from position 1; those divisible by 10 are reused ones."""
    m = matrix(spark, sf)
    out = sel.assign_projects(m, 3, excluded=m.where("project % 7 = 0 and position = 1").select("owner_id", "position", "project"), reused=m.where("project % 10 = 0").select("owner_id", "project"))
    return _shown(out)


@query("e6_total_score", f"WITH {_MATRIX}, {_assigned_sql('m', 'a')} SELECT owner_id, list_sum(scores)::BIGINT AS total FROM a")
def e6(spark, sf):
    flat = sel.assign_projects(matrix(spark, sf), 3).select("owner_id", F.explode("scores").alias("bp"))
    return sel.total_score(flat, "owner_id")


@query("e7_alternatives")
def e7(spark, sf):
    m = matrix(spark, sf)
    own, c = own_slots(spark, sf), cands(spark, sf)
    out = sel.alternatives(m, 3, sel.assign_projects(m, 3), job=(own, c, sel.fill_slots(own, c)))
    return out.select("owner_id", "r", "label", F.array_join(F.col("projects").cast("array<string>"), ",").alias("projects"), "slot_idx", "cand_id", "total")


_FIT = f"""{_ITEMS}, have AS (SELECT project, count(DISTINCT item) AS n, count_if(length = 1) > 0 AS has1, count_if(length = 2) > 0 AS has2, count(DISTINCT CASE WHEN length = 1 THEN item END) AS n1, count(DISTINCT CASE WHEN length = 2 THEN item END) AS n2 FROM i GROUP BY 1),
checked AS (SELECT o_orderkey AS project, position, CASE WHEN position = 1 AND o_orderstatus = 'P' THEN 'section' WHEN coalesce(n, 0) < position + 2 THEN 'too few items' WHEN NOT has1 THEN 'no item at length 1' WHEN NOT has2 THEN 'no item at length 2'
WHEN n1 < position + 1 OR n2 < 1 OR n < position + 2 THEN 'not together' END AS reason FROM orders CROSS JOIN (VALUES (0), (1)) p(position) LEFT JOIN have ON project = o_orderkey)"""


def checked(spark, sf):
    """Orders as projects; position 1 takes no order in status P."""
    projects = table(spark, sf, "orders").select(F.col("o_orderkey").alias("project"), F.when(F.col("o_orderstatus") == "P", "p").otherwise("x").alias("section"))
    items = item_scores(spark, sf).select("project", "item", "length")
    pos1 = sel.infeasibility(projects, items, spark.createDataFrame([(1, "x")], "position int, section string"), slots(spark))
    pos0 = sel.infeasibility(projects.withColumn("section", F.lit("x")), items, spark.createDataFrame([(0, "x")], "position int, section string"), slots(spark))
    return pos0.unionByName(pos1)


@query("e8_infeasibility", f"WITH {_FIT} SELECT project, position, reason FROM checked")
def e8(spark, sf):
    return checked(spark, sf)


@query("e9_feasibility", f"WITH {_FIT} SELECT project, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM checked WHERE reason IS NULL GROUP BY project")
def e9(spark, sf):
    return sel.feasibility(checked(spark, sf)).select("project", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@query("e10_coverage", f"""WITH {_FIT} SELECT project, (n1 >= 1 AND n2 >= 1 AND n >= 2) OR (n1 >= 2 AND n2 >= 1 AND n >= 3) AS covered, array_to_string(list_filter([CASE WHEN NOT has1 THEN '1' END, CASE WHEN NOT has2 THEN '2' END], lambda x: x IS NOT NULL), ',') AS missing FROM have""")
def e10(spark, sf):
    out = sel.coverage(item_scores(spark, sf).select("project", "item", "length"), slots(spark))
    return out.select("project", "covered", F.array_join(F.col("missing").cast("array<string>"), ",").alias("missing"))


@query("e11_resolve_with_rejections")
def e11(spark, sf):
    m = matrix(spark, sf)
    rejected = m.where("(project + position) % 5 = 0").select("owner_id", "position", "project")
    out = sel.resolve_with_rejections(m, 3, rejected)
    return out.select("owner_id", F.array_join(F.col("projects").cast("array<string>"), ",").alias("projects"), F.array_join(F.col("degraded").cast("array<string>"), ",").alias("degraded"))


@query("e12_targets", """WITH s AS (SELECT l_suppkey AS grp, 1 + l_linenumber % 3 AS length, l_quantity AS budget FROM lineitem), n AS (SELECT grp, count(*) AS n FROM s GROUP BY 1)
SELECT grp, length, greatest(4, 2 * n) AS wanted, floor(quantile_cont(budget, 0.5) + 0.5)::BIGINT AS budget FROM s JOIN n USING (grp) GROUP BY grp, length, n""")
def e12(spark, sf):
    return sel.targets(lines(spark, sf).select(F.col("l_suppkey").alias("grp"), (1 + F.col("l_linenumber") % 3).alias("length"), F.col("l_quantity").alias("budget")))


@query("e13_eligible_length", f"WITH {_CANDS} SELECT owner_id, cand_id, length FROM c WHERE (owner_id + length) % 2 = 0 AND length <= 1 + cand_id % 2")
def e13(spark, sf):
    c = cands(spark, sf).withColumn("own_length", (1 + F.col("cand_id") % 2).cast("int"))
    needed = c.select("owner_id", "length").distinct().where("(owner_id + length) % 2 = 0")
    return sel.eligible_length(c, needed, existing_only=True).select("owner_id", "cand_id", "length")


@query("e14_round_robin", f"""WITH {_CANDS}, i AS (SELECT owner_id, cand_id AS item, length, row_number() OVER (PARTITION BY owner_id, length ORDER BY cand_id) - 1 AS n FROM c)
SELECT owner_id, item, CASE WHEN length = 2 THEN 2 ELSE n % 2 END::INT AS slot_idx FROM i""")
def e14(spark, sf):
    shape = F.explode(F.array(*[F.struct(F.lit(i).alias("slot_idx"), F.lit(n).alias("length")) for i, n in ((0, 1), (1, 1), (2, 2))])).alias("s")
    own = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("owner_id"), shape).select("owner_id", "s.*")
    return sel.round_robin(cands(spark, sf).select("owner_id", F.col("cand_id").alias("item"), "length"), own)


@query("e15_batch_summary", f"""{_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w10 DESC, term) AS r FROM tw), top AS (SELECT doc_id, string_agg(term, ', ' ORDER BY r) AS top FROM r WHERE r <= 5 GROUP BY doc_id)
SELECT doc_id, top, CASE WHEN len(text) > 5000 THEN 'JD_TOO_LONG' END AS reason, (SELECT min(a) FROM decided WHERE b = doc_id AND decision = 'HIT') AS reused FROM documents LEFT JOIN top USING (doc_id)""")
def e15(spark, sf):
    p, rich = postings(spark, sf), written(rich_weights(spark, sf), "rich_weights")
    members, links = dedup.memberships(*decisions(spark, sf, rich))
    reuse = dedup.batch_reuse(p, links, members)
    return sel.batch_summary(p, op.top_terms(rich), op.length_limit(p, 5000).select("doc_id", "reason"), reuse)


@query("e16_home_section", """WITH s AS (SELECT c_nationkey AS owner_id, c_custkey AS section, CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 50 = 0 THEN 'Projects' ELSE 'Work' END AS name, c_custkey % 4 AS positions FROM customer),
a AS (SELECT owner_id, min(section) AS x FROM s WHERE positions > 0 AND contains(lower(name), 'project') GROUP BY 1), b AS (SELECT owner_id, min_by(section, struct_pack(n := -positions, o := section)) AS y FROM s WHERE positions > 0 GROUP BY 1)
SELECT DISTINCT owner_id, coalesce(x, y) AS home FROM s LEFT JOIN a USING (owner_id) LEFT JOIN b USING (owner_id)""")
def e16(spark, sf):
    """Customers as sections of their nation."""
    name = F.when((F.col("c_mktsegment") == "MACHINERY") & (F.col("c_custkey") % 50 == 0), "Projects").otherwise("Work")
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("owner_id"), F.col("c_custkey").alias("section"), F.col("c_custkey").alias("ord"), name.alias("name"), (F.col("c_custkey") % 4).alias("positions"))
    return sel.home_section(c)
