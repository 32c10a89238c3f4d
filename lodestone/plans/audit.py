"""Queries on admission, audits, location and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import audit as au
from lodestone.operators import events as ev
from lodestone.operators import passages as ps
from lodestone.operators.terms import split_lines
from lodestone.plans.catalog import query
from lodestone.plans.terms import LINES_SQL, docs
from lodestone.sources import events, table


@query("g1_admit", """SELECT page_id, CASE WHEN url IS NULL THEN 'NO_URL' WHEN NOT starts_with(url, 'https://') THEN 'NOT_SECURE' WHEN contains(url, '?') THEN 'HAS_QUERY' WHEN len(html) < 1500 THEN 'TOO_SMALL' WHEN NOT contains(html, '<h1>') THEN 'NO_HEADING' END AS reason FROM pages""")
def g1(spark, sf):
    rules = [
        ("NO_URL", F.col("url").isNull()), ("NOT_SECURE", ~F.col("url").startswith("https://")), ("HAS_QUERY", F.contains("url", F.lit("?"))), ("TOO_SMALL", F.length("html") < 1500),
        ("NO_HEADING", ~F.contains("html", F.lit("<h1>"))),
    ]
    good, bad = au.admit(table(spark, sf, "pages"), rules)
    return good.select("page_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("page_id", "reason"))


@query("g2_constraint_audit", """SELECT 'one open order a customer' AS "check", (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1 HAVING count(*) > 1)) AS violations
UNION ALL SELECT 'status domain', (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')) UNION ALL SELECT 'posting length', (SELECT count(*) FROM documents WHERE len(text) > 20000)
UNION ALL SELECT 'unique line', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1))
UNION ALL SELECT 'unchanged after final', (SELECT count(*) FROM (SELECT o_orderpriority AS v, lag(o_orderpriority) OVER w AS p, lag(o_orderstatus = 'F') OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) WHERE f AND p IS DISTINCT FROM v)""")
def g2(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return au.constraint_audit({
        "one open order a customer": au.more_than_one(o.where("o_orderstatus = 'O'"), "o_custkey"), "status domain": o.where("o_orderstatus not in ('O', 'F')"),
        "posting length": docs(spark, sf).where("length(text) > 20000"), "unique line": au.more_than_one(li, "l_orderkey", "l_linenumber"),
        "unchanged after final": au.changed_after_final(o.withColumn("final", F.col("o_orderstatus") == "F"), "o_custkey", "o_orderkey", "final", "o_orderpriority"),
    })


@query("g3_allowlist_audit", "SELECT p_type || '/' || p_size AS value, count(*) AS n, min_by(p_name, p_partkey) AS sample FROM part WHERE p_type || '/' || p_size NOT IN (SELECT p_type || '/' || p_size FROM part WHERE p_partkey % 20 = 0) GROUP BY 1")
def g3(spark, sf):
    p = table(spark, sf, "part").withColumn("value", F.concat_ws("/", "p_type", F.col("p_size").cast("string")))
    return au.allowlist_audit(p, p.where("p_partkey % 20 = 0"), "p_partkey", "p_name")


@query("g4_anchor_clusters")
def g4(spark, sf):
    """Bursts of a user's events within a day of the burst's first."""
    return au.anchor_clusters(events(spark, sf).select(F.col("user_id").alias("key"), F.col("us").alias("at"), F.col("event_id").alias("id")), ev.DAY)


_SQUEEZE = "regexp_replace({0}, '\\s+', '', 'g')"
_HITS = f"""{LINES_SQL}, n AS (SELECT doc_id, line_no, {_SQUEEZE.format('line')} AS s FROM lines), p AS (SELECT item_id, {_SQUEEZE.format('text')} AS p FROM benchmark WHERE {_SQUEEZE.format('text')} <> ''),
starts AS (SELECT n.doc_id, item_id, p, line_no AS first FROM n JOIN p ON contains(s, left(p, {ps.START}))),
upto AS (SELECT doc_id, item_id, p, first, n.line_no AS last, string_agg(s, '' ORDER BY n.line_no) OVER (PARTITION BY doc_id, item_id, first ORDER BY n.line_no) AS body FROM starts JOIN n USING (doc_id) WHERE n.line_no BETWEEN first AND first + {ps.SPAN - 1}),
hits AS (SELECT doc_id, item_id, first, min(last) FILTER (contains(body, p)) AS last FROM upto GROUP BY ALL)"""


def hits(spark, sf):
    return ps.passage_hits(docs(spark, sf), table(spark, sf, "benchmark"))


@query("g5_locate_passages", f"WITH {_HITS}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY first) AS k FROM hits) SELECT doc_id, item_id, first::INT AS first, last::INT AS last FROM k WHERE k = 1 AND last IS NOT NULL")
def g5(spark, sf):
    return ps.locate_passages(hits(spark, sf))


@query("g6_locate_in_order")
def g6(spark, sf):
    return ps.locate_in_order(hits(spark, sf), table(spark, sf, "benchmark").select("item_id", (-F.col("item_id")).alias("ord")))


@query("g7_exclusive_span", f"WITH {_HITS}, b AS (SELECT doc_id, item_id, first, any_value(p) AS p, min_by(body, last) AS s FROM upto WHERE contains(body, p) GROUP BY ALL) SELECT doc_id, item_id, first::INT AS first, len(s) - len(p) <= 3 AND NOT regexp_matches(regexp_replace(left(s, position(p IN s) - 1) || substr(s, position(p IN s) + len(p)), '[-*•]', '', 'g'), '[\\p{{L}}\\p{{N}}]') AS exclusive FROM b")
def g7(spark, sf):
    found = hits(spark, sf).where("last is not null")
    return found.select("doc_id", "item_id", "first", ps.exclusive_span(F.col("span"), F.col("passage")).alias("exclusive"))


@query("g8_snapshot_drift", f"""WITH {LINES_SQL}, b AS (SELECT doc_id, line_no // 40 AS page, line_no, line_no * 12.0::DOUBLE AS y, line FROM lines),
a AS (SELECT doc_id, page, line_no, y + (doc_id % 8) * 0.125::DOUBLE AS y, line FROM b WHERE NOT (doc_id % 3 = 0 AND line_no % 17 = 5)),
kb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY page, line_no) AS nth FROM b), ka AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY page, line_no) AS nth FROM a),
j AS (SELECT kb.doc_id, kb.line_no, kb.page, kb.y, ka.page AS page2, ka.line_no AS line2, ka.y AS y2 FROM kb LEFT JOIN ka ON ka.doc_id = kb.doc_id AND ka.line = kb.line AND ka.nth = kb.nth WHERE kb.line_no % 10 <> 9),
p AS (SELECT *, max(line2) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM j),
q AS (SELECT *, CASE WHEN line2 IS NULL THEN 'missing' WHEN page2 <> page THEN 'page' WHEN abs(y2 - y) > 0.5 THEN 'shift' WHEN line2 < earlier THEN 'order' END AS problem FROM p)
SELECT doc_id, count(*) AS lines, max(CASE WHEN page2 = page THEN abs(y2 - y) END) AS worst, min_by(problem, CASE WHEN problem IS NOT NULL THEN line_no END) AS problem FROM q GROUP BY doc_id""")
def g8(spark, sf):
    """Lines as laid out on pages of 40, and again with some lines missing and all shifted a little; every tenth line was edited."""
    return au.snapshot_drift(*_snapshots(spark, sf))


@query("g8_drift_in_order", f"""WITH RECURSIVE {LINES_SQL}, b AS (SELECT doc_id, line_no // 40 AS page, line_no, line_no * 12.0::DOUBLE AS y, line FROM lines),
a AS (SELECT doc_id, page, line_no, y + (doc_id % 8) * 0.125::DOUBLE AS y, line FROM b WHERE NOT (doc_id % 3 = 0 AND line_no % 17 = 5)),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM b WHERE line_no % 10 <> 9),
walk AS (SELECT DISTINCT doc_id, 0::BIGINT AS k, -1::BIGINT AS cur, NULL::BIGINT AS hit FROM kept
  UNION ALL SELECT w.doc_id, kp.k, coalesce(min(a.line_no), any_value(w.cur)), min(a.line_no) FROM walk w JOIN kept kp ON kp.doc_id = w.doc_id AND kp.k = w.k + 1
  LEFT JOIN a ON a.doc_id = w.doc_id AND a.line = kp.line AND a.line_no > w.cur GROUP BY w.doc_id, kp.k),
j AS (SELECT kept.*, a.page AS page2, abs(a.y - kept.y) AS shift, hit FROM kept JOIN walk USING (doc_id, k) LEFT JOIN a ON a.doc_id = kept.doc_id AND a.line_no = hit),
q AS (SELECT *, CASE WHEN hit IS NULL THEN 'missing' WHEN page2 <> page THEN 'page' WHEN shift > 0.5 THEN 'shift' END AS problem FROM j)
SELECT doc_id, count(*) AS lines, max(CASE WHEN page2 = page THEN shift END) AS worst, min_by(problem, CASE WHEN problem IS NOT NULL THEN line_no END) AS problem FROM q GROUP BY doc_id""")
def g8o(spark, sf):
    """The snapshots of ``g8_snapshot_drift``, matched in order: some equal lines are fewer in the second."""
    return au.drift_in_order(*_snapshots(spark, sf))


def _snapshots(spark, sf):
    before = split_lines(docs(spark, sf)).select("doc_id", F.expr("line_no div 40").alias("page"), "line_no", (F.col("line_no") * F.lit(12.0)).alias("y"), "line")
    after = before.where("not (doc_id % 3 = 0 and line_no % 17 = 5)").withColumn("y", F.col("y") + (F.col("doc_id") % 8) * F.lit(0.125))
    return before, after, before.where("line_no % 10 = 9")


_W = "list_filter(list_transform(regexp_split_to_array(lower({0}), '\\s+'), lambda w: regexp_replace(w, '^[^a-z0-9]+|[^a-z0-9]+$', '', 'g')), lambda w: w <> '')"


@query("g9_words_added", f"""WITH p AS (SELECT a.conv_id, a.turn, a.text AS old, b.text AS new FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
o AS (SELECT conv_id, turn, w, count(*) AS o FROM (SELECT conv_id, turn, unnest({_W.format('old')}) AS w FROM p) GROUP BY ALL), n AS (SELECT conv_id, turn, w, count(*) AS n FROM (SELECT conv_id, turn, unnest({_W.format('new')}) AS w FROM p) GROUP BY ALL),
d AS (SELECT conv_id, turn, sum(greatest(n - coalesce(o, 0), 0))::BIGINT AS added FROM n LEFT JOIN o USING (conv_id, turn, w) GROUP BY ALL) SELECT conv_id, turn, coalesce(added, 0) AS added FROM (SELECT DISTINCT conv_id, turn FROM p) LEFT JOIN d USING (conv_id, turn)""")
def g9(spark, sf):
    c = table(spark, sf, "conversations")
    pairs = c.select("conv_id", "turn", F.col("text").alias("old")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("new")), ["conv_id", "turn"])
    return au.words_added(pairs, ["conv_id", "turn"], "old", "new")


_STATE = "SELECT {0} AS owner, l_linenumber AS slot, min(l_partkey % 3) AS project, min(l_returnflag) AS text, list_distinct(list(l_linestatus)) AS stack FROM lineitem GROUP BY ALL"


@query("g10_changes", f"""WITH a AS ({_STATE.format('l_orderkey')}), b AS ({_STATE.format('l_orderkey - 1')}), j AS (SELECT coalesce(a.owner, b.owner) AS owner, coalesce(a.slot, b.slot) AS slot, a.project AS p0, b.project, a.text AS t0, b.text,
list_sort(list_filter(list_transform(coalesce(a.stack, []), lambda x: lower(x)), lambda x: NOT list_contains(list_transform(coalesce(b.stack, []), lambda y: lower(y)), x))) AS gone FROM a FULL JOIN b ON a.owner = b.owner AND a.slot = b.slot)
SELECT owner, slot, 'project_placed' AS change, project::VARCHAR AS detail FROM j WHERE project IS NOT NULL AND project IS DISTINCT FROM p0 UNION ALL
SELECT owner, slot, 'bullet_rewritten', text FROM j WHERE project IS NOT DISTINCT FROM p0 AND text IS DISTINCT FROM t0 UNION ALL SELECT owner, slot, 'stack_trimmed', array_to_string(gone, ', ') FROM j WHERE project IS NOT DISTINCT FROM p0 AND len(gone) > 0""")
def g10(spark, sf):
    """Each order against the next one."""
    li = table(spark, sf, "lineitem")
    state = li.groupBy(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("slot")).agg(
        F.min(F.col("l_partkey") % 3).alias("project"), F.min("l_returnflag").alias("text"), F.array_sort(F.collect_set("l_linestatus")).alias("stack")
    )
    return au.changes(state, state.withColumn("owner", F.col("owner") - 1))


@query("g11_url_quality", """SELECT lower(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)) AS host, count(*) AS pages, count_if(coalesce(len(url) <= 2048 AND regexp_matches(url, '^[\\x21-\\x7E]+$') AND
(regexp_matches(url, '(?i)^https?://[^/?#@\\s:]+(:[0-9]+)?([/?#][^\\s]*)?$') OR regexp_matches(url, '(?i)^mailto:[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')), false))::BIGINT AS good FROM pages GROUP BY 1""")
def g11(spark, sf):
    return au.url_quality(table(spark, sf, "pages"))


@query("g12_notes_limits", """WITH n AS (SELECT source AS owner, doc_id AS id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth, doc_id % 7 = 0 AS bad FROM documents)
SELECT owner, id, CASE WHEN n > 1500 THEN 'NOTES_TOO_LONG' WHEN nth > 30 THEN 'TOO_MANY' WHEN bad THEN 'BAD_LINK' END AS reason FROM n""")
def g12(spark, sf):
    link = F.when(F.col("doc_id") % 7 == 0, "ftp://example.org/x").otherwise(F.concat(F.lit("https://example.org/"), "doc_id"))
    d = table(spark, sf, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("id"), "text", link.alias("link"))
    return au.notes_limits(d, most=30)
