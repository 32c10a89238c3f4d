"""Queries on events, usage and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import events as ev
from lodestone.plans.catalog import query
from lodestone.sources import events, micros, table

_US = "epoch_us(ts)"
_E = f"e AS (SELECT *, {_US} AS us FROM events)"


def keyed(spark, sf):
    return events(spark, sf).select(F.col("user_id").alias("key"), "us", F.col("event_id").alias("id"))


@query("f1_rate_limit")
def f1(spark, sf):
    """Five events a day a user."""
    return ev.rate_limit(keyed(spark, sf), 5, 24 * ev.HOUR)


@query("f3_offered_load", f"WITH {_E} SELECT user_id AS key, us, event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS load FROM e")
def f3(spark, sf):
    return ev.offered_load(keyed(spark, sf), ev.DAY)


def _windows(df):
    return df.select(micros("start").alias("start_us"), micros("end").alias("end_us"), "event_type", "n")


@query("f3s_tumbling_counts", f"WITH {_E} SELECT (us // 3600000000) * 3600000000 AS start_us, (us // 3600000000 + 1) * 3600000000 AS end_us, event_type, count(*) AS n FROM e GROUP BY ALL")
def f3t(spark, sf):
    return _windows(ev.windowed_counts(table(spark, sf, "events"), "tumbling"))


@query("f3s_sliding_counts", f"""WITH {_E}, s AS (SELECT us, event_type, unnest(range(4)) AS k FROM e)
SELECT (us // 900000000 - k) * 900000000 AS start_us, (us // 900000000 - k + 4) * 900000000 AS end_us, event_type, count(*) AS n FROM s GROUP BY ALL""")
def f3sl(spark, sf):
    return _windows(ev.windowed_counts(table(spark, sf, "events"), "sliding"))


@query("f3s_session_counts", f"""WITH {_E}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY event_type ORDER BY us) < 600000000 THEN 0 ELSE 1 END AS f FROM e),
s AS (SELECT *, sum(f) OVER (PARTITION BY event_type ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT min(us) AS start_us, max(us) + 600000000 AS end_us, event_type, count(*) AS n FROM s GROUP BY event_type, s""")
def f3se(spark, sf):
    return _windows(ev.windowed_counts(table(spark, sf, "events"), "session", "10 minutes"))


@query("f4_idempotent_create")
def f4(spark, sf):
    key = F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("key")
    return ev.idempotent_create(events(spark, sf).select(key, "us", F.col("event_id").alias("id")))


_NOW = 915148800_000000


@query("f5_lease_outcomes", f"""WITH j AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'queued' ELSE 'done' END AS status, CASE WHEN o_custkey % 10 = 0 THEN 'generate' ELSE 'match' END AS type,
1 + o_orderkey % 2 AS attempts, epoch_us(o_orderdate) + (o_orderkey % 5) * 86400000000 AS lease_until FROM orders)
SELECT id, CASE WHEN NOT (status = 'running' AND lease_until < {_NOW}) THEN status WHEN attempts < CASE WHEN type = 'generate' THEN 1 ELSE 2 END THEN 'queued' ELSE 'WORKER_LOST' END AS outcome FROM j""")
def f5(spark, sf):
    jobs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "queued").otherwise("done").alias("status"),
        F.when(F.col("o_custkey") % 10 == 0, "generate").otherwise("match").alias("type"), (1 + F.col("o_orderkey") % 2).alias("attempts"), (micros("o_orderdate") + (F.col("o_orderkey") % 5) * ev.DAY).alias("lease_until"),
    )
    return ev.lease_outcomes(jobs, _NOW).select("id", "outcome")


@query("f6_fenced_latest", f"""WITH {_E}, c AS (SELECT user_id AS job, us, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS attempt FROM e WHERE event_type = 'signup'),
w AS (SELECT user_id AS job, us, event_id AS id, 1 + event_id % 8 AS attempt FROM e WHERE event_type = 'view'),
o AS (SELECT w.*, (SELECT max(attempt) FROM c WHERE c.job = w.job AND c.us <= w.us) AS now FROM w) SELECT job, max_by(id, struct_pack(u := us, i := id)) AS id, max(us) AS us FROM o WHERE attempt = now GROUP BY job""")
def f6(spark, sf):
    from pyspark.sql import Window as W

    e = events(spark, sf)
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("us", "event_id")).cast("long")
    claims = e.where("event_type = 'signup'").select(F.col("user_id").alias("job"), "us", nth.alias("attempt"))
    writes = e.where("event_type = 'view'").select(F.col("user_id").alias("job"), "us", F.col("event_id").alias("id"), (1 + F.col("event_id") % 8).alias("attempt"))
    return ev.fenced_latest(claims, writes)


@query("f7_concurrency", f"""WITH {_E}, i AS (SELECT user_id AS key, event_id AS id, us AS s, us + 60000000 * (1 + event_id % 3000) AS t FROM e)
SELECT a.key, a.id, count(*)::BIGINT AS running, count(*) > 3 AS breach FROM i a JOIN i b ON a.key = b.key AND b.t > a.s AND (b.s < a.s OR (b.s = a.s AND b.id <= a.id)) GROUP BY a.key, a.id""")
def f7(spark, sf):
    i = events(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("us").alias("start"), (F.col("us") + ev.MINUTE * (1 + F.col("event_id") % 3000)).alias("end"))
    return ev.concurrency(i, 3)


@query("f8_backlog", f"WITH {_E}, r AS (SELECT event_type AS type, user_id % 3 AS priority, us, event_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY user_id % 3, us, event_id) AS r FROM e) SELECT type, priority, us, id, r::INT AS r FROM r WHERE r <= 25")
def f8(spark, sf):
    return ev.backlog(events(spark, sf).select(F.col("event_type").alias("type"), (F.col("user_id") % 3).alias("priority"), "us", F.col("event_id").alias("id")))


_LOG = f"{_E}, log AS (SELECT user_id AS job, event_id AS seq, event_type AS stage, CASE WHEN event_id % 2 = 0 THEN 'started' ELSE 'finished' END AS state, us FROM e)"


def log(spark, sf):
    state = F.when(F.col("event_id") % 2 == 0, "started").otherwise("finished")
    return events(spark, sf).select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), state.alias("state"), "us")


@query("f9_stage_durations", f"""WITH {_LOG}, o AS (SELECT *, sum(CASE WHEN state = 'started' THEN 1 ELSE 0 END) OVER (PARTITION BY job, stage ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS occurrence FROM log),
l AS (SELECT job, max_by(us, seq) AS last FROM log GROUP BY job), s AS (SELECT job, stage, occurrence, min(CASE WHEN state = 'started' THEN us END) AS began, min_by(us, CASE WHEN state = 'finished' THEN seq END) AS ended FROM o WHERE occurrence > 0 GROUP BY ALL)
SELECT job, stage, occurrence, coalesce(ended, last) - began AS us FROM s JOIN l USING (job)""")
def f9(spark, sf):
    return ev.stage_durations(log(spark, sf))


@query("f10_replay_after", f"WITH {_LOG} SELECT * FROM log WHERE seq > 500")
def f10a(spark, sf):
    return ev.replay_after(log(spark, sf), 500)


ORACLE_PROGRESS = f"WITH {_LOG} SELECT job, max(seq) AS seq, max_by(stage, seq) AS stage, max_by(state, seq) AS state FROM log GROUP BY job"


@query("f10_latest_progress", ORACLE_PROGRESS)
def f10b(spark, sf):
    return ev.latest_progress(log(spark, sf))


@query("f11_latency_report", "SELECT event_type AS type, count(*) AS n, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, count_if(value > 15)::BIGINT AS late FROM events GROUP BY ROLLUP (event_type)")
def f11(spark, sf):
    return ev.latency_report(table(spark, sf, "events").select(F.col("event_type").alias("type"), F.col("value").alias("seconds")), 15.0)


_KEY = "user_id || '/' || (event_id % 7)"


@query("f12_ledger_insert", f"""WITH n AS (SELECT {_KEY} AS key, event_id AS id, value, row_number() OVER (PARTITION BY {_KEY} ORDER BY event_id) AS r FROM events WHERE event_type = 'purchase')
SELECT key, id, value FROM n WHERE r = 1 AND key NOT IN (SELECT {_KEY} FROM events WHERE event_type = 'signup')""")
def f12(spark, sf):
    e = table(spark, sf, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), (F.col("event_id") % 7).cast("string")).alias("key"), F.col("event_id").alias("id"), "value", "event_type")
    return ev.ledger_insert(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'signup'"))


@query("f13_usage_summary", """SELECT user_id AS "user", count_if(event_type = 'view')::BIGINT AS n_view, count_if(event_type = 'purchase')::BIGINT AS n_purchase, coalesce(sum(CASE WHEN event_type = 'purchase' THEN value::DECIMAL(12,6) END), 0)::DECIMAL(22,6)::DOUBLE AS cost FROM events GROUP BY user_id""")
def f13(spark, sf):
    cost = F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(12,6)"))
    return ev.usage_summary(table(spark, sf, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("kind"), cost.alias("cost")), ["view", "purchase"]).withColumn("cost", F.col("cost").cast("double"))


_COST = "(l_quantity::BIGINT * 1000 * 300 + l_suppkey * 100 * 1500 + l_partkey * 30 + l_linenumber * 50 * 375)::DECIMAL(20,0) * 0.00000001::DECIMAL(9,8)"


def costs(spark, sf):
    """Lines as calls: four kinds of tokens at 3, 15, 0.30 and 3.75 dollars a million."""
    usage = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), (F.col("l_quantity").cast("long") * 1000).alias("input"), (F.col("l_suppkey") * 100).alias("output"),
        F.col("l_partkey").alias("read"), (F.col("l_linenumber") * 50).alias("written"),
    )
    return ev.call_cost(usage, {"input": 300, "output": 1500, "read": 30, "written": 375})


@query("f14_call_cost", f"SELECT l_orderkey AS run, l_linenumber AS seq, l_partkey AS part, ({_COST})::DECIMAL(28,8)::DOUBLE AS cost FROM lineitem")
def f14(spark, sf):
    return costs(spark, sf).select("run", "seq", "part", F.col("cost").cast("double").alias("cost"))


@query("f15_budget_cut", f"""WITH c AS (SELECT l_orderkey AS run, l_linenumber * 1000000 + l_partkey AS seq, l_suppkey, ({_COST})::DECIMAL(28,8) AS cost FROM lineitem), u AS (SELECT run, seq, max(cost) AS cost FROM c GROUP BY ALL),
b AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u) SELECT run, seq, CASE WHEN before < 0.5 THEN 'ran' ELSE 'COST_LIMIT' END AS outcome FROM b""")
def f15(spark, sf):
    calls = costs(spark, sf).select("run", (F.col("seq") * 1_000_000 + F.col("part")).alias("seq"), "cost").groupBy("run", "seq").agg(F.max("cost").alias("cost"))
    return ev.budget_cut(calls, F.lit("0.5").cast("decimal(3,1)")).select("run", "seq", "outcome")


def versions(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("version"), F.col("o_orderpriority").alias("payload"))


@query("f16_latest_version", "SELECT o_custkey AS owner, max(o_orderkey) AS version, max_by(o_orderpriority, o_orderkey) AS payload FROM orders GROUP BY 1")
def f16(spark, sf):
    return ev.latest_version(versions(spark, sf))


@query("f16_next_version", "SELECT c_custkey AS owner, coalesce(max(o_orderkey), 0) + 1 AS version FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def f16n(spark, sf):
    return ev.next_version(table(spark, sf, "customer").select(F.col("c_custkey").alias("owner")), versions(spark, sf))


_V1, _V2 = "SELECT l_suppkey AS section, l_partkey AS item FROM lineitem WHERE l_linenumber <= 4", "SELECT l_suppkey AS section, l_partkey AS item FROM lineitem WHERE l_linenumber >= 2"


def two_versions(spark, sf):
    li = table(spark, sf, "lineitem")
    pick = lambda c: li.where(c).select(F.col("l_suppkey").alias("section"), F.col("l_partkey").alias("item"))
    return pick("l_linenumber <= 4"), pick("l_linenumber >= 2")


@query("f17_version_diff", f"""SELECT 'removed' AS change, * FROM ({_V1} EXCEPT ALL {_V2}) UNION ALL SELECT 'added', * FROM ({_V2} EXCEPT ALL {_V1}) UNION ALL SELECT 'kept', * FROM ({_V1} INTERSECT ALL {_V2})""")
def f17(spark, sf):
    return ev.version_diff(*two_versions(spark, sf))


@query("f17_carry_over", f"SELECT * FROM ({_V2}) WHERE section % 3 = 0 UNION ALL SELECT * FROM ({_V1}) WHERE section NOT IN (SELECT section FROM ({_V2}) WHERE section % 3 = 0)")
def f17c(spark, sf):
    old, new = two_versions(spark, sf)
    return ev.carry_over(new.where("section % 3 = 0"), old, "section")


@query("f18_report_as_of", f"""WITH {_E}, v AS (SELECT DISTINCT (event_id // 1000) * 1000 AS version FROM events)
SELECT user_id AS section, v.version, max_by(value, struct_pack(s := us, v := event_id)) AS report FROM e JOIN v ON event_id <= v.version GROUP BY 1, 2""")
def f18(spark, sf):
    runs = events(spark, sf).select(F.col("user_id").alias("section"), F.col("event_id").alias("version"), F.col("value").alias("report"), F.col("us").alias("started"))
    asked = runs.select((F.floor(F.col("version") / 1000) * 1000).alias("version")).distinct()
    return ev.report_as_of(runs, asked)


_TREE = "t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderkey - 1 - (o_orderkey % 10) // 2 END AS parent, o_orderdate AS created FROM orders)"


def tree(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("id"), F.when(k % 10 != 0, k - 1 - F.expr("(o_orderkey % 10) div 2")).alias("parent"), F.col("o_orderdate").alias("created"))


@query("f19_latest_in_tree", f"""WITH RECURSIVE {_TREE}, r(id, root) AS (SELECT id, id FROM t WHERE parent IS NULL UNION ALL SELECT t.id, r.root FROM t JOIN r ON t.parent = r.id)
SELECT root, max_by(id, struct_pack(c := created, i := id)) AS id FROM r JOIN t USING (id) GROUP BY root""")
def f19(spark, sf):
    return ev.latest_in_tree(tree(spark, sf))


@query("f19_revisions_of", f"WITH {_TREE} SELECT id, parent FROM t WHERE parent = 10")
def f19r(spark, sf):
    return ev.revisions_of(tree(spark, sf), 10).select("id", "parent")


@query("f20_activate", """SELECT o_custkey AS owner, o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' THEN 'pending' WHEN row_number() OVER (PARTITION BY o_custkey, o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 THEN 'active' ELSE 'archived' END AS status FROM orders""")
def f20(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "accepted").otherwise("pending")
    return ev.activate(table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created")))


@query("f21_reusable_by_version", """SELECT o_custkey AS owner, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS r FROM orders JOIN customer ON c_custkey = o_custkey AND c_nationkey % 4 = o_orderkey % 4 WHERE o_orderkey % 3 <> 0""")
def f21(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("version"), F.col("o_orderdate").alias("created"), F.when(F.col("o_orderkey") % 3 == 0, 1).alias("cache_of")
    )
    return ev.reusable_by_version(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), (F.col("c_nationkey") % 4).alias("version")))


@query("f22_pending_deletions", "SELECT o_orderkey AS key FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def f22(spark, sf):
    marked = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"))
    return ev.pending_deletions(marked, table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key")))


@query("f22_purge", """SELECT 'orders' AS name, o_orderkey AS id, o_custkey AS "user", o_totalprice AS cost, o_orderpriority AS note FROM orders WHERE o_custkey % 5 <> 0
UNION ALL SELECT 'ledger', o_orderkey, o_custkey, o_totalprice, CASE WHEN o_custkey % 5 <> 0 THEN o_orderpriority END FROM orders""")
def f22p(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user"), F.col("o_totalprice").alias("cost"), F.col("o_orderpriority").alias("note"))
    left = ev.purge({"orders": o, "ledger": o}, o.where("user % 5 = 0"))
    return left["orders"].select(F.lit("orders").alias("name"), "id", "user", "cost", "note").unionByName(left["ledger"].select(F.lit("ledger").alias("name"), "id", "user", "cost", "note"))


@query("f23_posting_status", """WITH s AS (SELECT o_custkey AS owner, o_orderkey AS id, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') THEN 'ready' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'pending' END AS status,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS r FROM orders) SELECT * FROM s WHERE r <= 100""")
def f23(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created"), "o_orderstatus")
    return ev.posting_status(o, table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("id")), o.where("o_orderstatus = 'P'"), 500)


@query("f24_daily_quota", f"WITH {_E}, u AS (SELECT user_id AS key, us, event_id AS id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS used FROM e WHERE event_type = 'purchase') SELECT *, used > 1 AS over FROM u")
def f24(spark, sf):
    runs = events(spark, sf).where("event_type = 'purchase'").select(F.col("user_id").alias("key"), "us", F.col("event_id").alias("id"))
    return ev.daily_quota(runs, 1)


@query("f25_token_use", f"""WITH {_E}, r AS (SELECT user_id AS token, us, event_id AS id, event_type = 'view' AS peek FROM e), t AS (SELECT user_id AS token, min(us) + 86400000000 * (user_id % 5) AS expires FROM e WHERE event_type <> 'error' AND user_id % 11 <> 0 GROUP BY user_id),
j AS (SELECT r.*, expires, min(CASE WHEN us < expires AND NOT peek THEN struct_pack(u := us, i := id) END) OVER (PARTITION BY r.token) AS won FROM r LEFT JOIN t USING (token))
SELECT token, us, id, peek, CASE WHEN expires IS NULL THEN 'unknown' WHEN us >= expires THEN 'expired' WHEN won IS NULL OR struct_pack(u := us, i := id) <= won THEN 'valid' ELSE 'used' END AS outcome FROM j""")
def f25(spark, sf):
    e = events(spark, sf)
    requests = e.select(F.col("user_id").alias("token"), "us", F.col("event_id").alias("id"), (F.col("event_type") == "view").alias("peek"))
    tokens = e.where("event_type <> 'error' and user_id % 11 <> 0").groupBy(F.col("user_id").alias("token")).agg(F.min("us").alias("m")).select("token", (F.col("m") + ev.DAY * (F.col("token") % 5)).alias("expires"))
    return ev.token_use(requests, tokens)
