"""Events, usage and versions: limits, idempotency, leases, ledgers, budgets, versions, chains. Times are microseconds (us)."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.durable import remove, written
from lodestone.operators.chains import anchors
from lodestone.operators.folds import ordered_fold
from lodestone.operators.ranges import running

SECOND, MINUTE, HOUR, DAY = 10**6, 60 * 10**6, 3600 * 10**6, 86400 * 10**6
#: Questions that are sent to all tasks, at most; more are joined by shuffle.
QUESTIONS = 1 << 16


def rate_limit(events: DataFrame, limit: int, window: int) -> DataFrame:
    """Events (key, us, id) with ``admitted``: fewer than ``limit`` admitted ones of the key in (us - window, us].

    Refused events do not count. Ties in time go by id. The state of a key is its last ``limit`` admitted times.
    """

    def step(held: deque, row: tuple) -> tuple:
        us = row[1]
        while held and held[0] <= us - window:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(us)
        return held, (ok,)

    return ordered_fold(events.select("key", "us", "id"), ["key"], ["us", "id"], deque, step, "admitted boolean")


def trailing_count(rows: DataFrame, key: str, at: str, window: int, name: str) -> DataFrame:
    """``rows`` with how many of the key's rows lie in (at - window, at], as ``name``.

    A key's time line is cut into buckets of one window, each a group of its own with the bucket before it, so a key with
    many rows is many tasks. Rows are shuffled twice; nulls in ``key`` are a key.
    """
    bucket = F.expr(f"`{at}` div {window}")
    again = F.when(F.col(at).isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    both = rows.withColumn("_old", F.explode(again)).withColumn("_bucket", bucket + F.col("_old").cast("int"))
    frame = W.partitionBy(key, "_bucket").orderBy(at).rangeBetween(1 - window, W.currentRow)
    return both.withColumn(name, F.count("*").over(frame)).where("not _old").drop("_old", "_bucket")


def offered_load(events: DataFrame, window: int) -> DataFrame:
    """Events (key, us, id) with ``load``: events of the key in (us - window, us], admitted or not."""
    return trailing_count(events, "key", "us", window, "load")


def windowed_counts(events: DataFrame, kind: str = "tumbling", size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n) by tumbling, sliding or session windows of ``ts``; batch and stream alike.

    A stream drops rows that come after the watermark ``late`` has passed the end of their window.
    """
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("ts", ts)
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    by = {"tumbling": lambda: F.window("ts", size), "sliding": lambda: F.window("ts", size, slide), "session": lambda: F.session_window("ts", size)}[kind]()
    out = rows.groupBy(by.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n")


def idempotent_create(requests: DataFrame, window: int = DAY) -> DataFrame:
    """Requests (key, us, id) with ``created`` and ``job``: the first of a key creates; repeats within the window of that one return it."""
    out = anchors(requests.select("key", F.col("us").alias("at"), "id"), window)
    return out.select("key", F.col("at").alias("us"), "id", ((F.col("at") == F.col("anchor_at")) & (F.col("id") == F.col("anchor_id"))).alias("created"), F.col("anchor_id").alias("job"))


def lease_outcomes(jobs: DataFrame, now: int) -> DataFrame:
    """Adds ``outcome`` to jobs (status, type, attempts, lease_until): an expired running one is requeued if it has an attempt left.

    Two attempts are allowed, one for ``generate``.
    """
    allowed = F.when(F.col("type") == "generate", 1).otherwise(2)
    lost = (F.col("status") == "running") & (F.col("lease_until") < now)
    return jobs.withColumn("outcome", F.when(~lost, F.col("status")).when(F.col("attempts") < allowed, "queued").otherwise("WORKER_LOST"))


def fenced_latest(claims: DataFrame, writes: DataFrame) -> DataFrame:
    """(job, id, us): each job's latest write made by the attempt that owns it then.

    ``claims`` (job, attempt, us) start an ownership that lasts to the next; ``writes`` (job, attempt, us, id). The owner is
    carried along each job's time line, so claims and writes need one shuffle.
    """
    line = claims.select("job", "us", F.col("attempt").alias("owner"), F.lit(None).cast("long").alias("attempt"), F.lit(None).cast("long").alias("id"))
    line = line.unionByName(writes.select("job", "us", F.lit(None).cast("long").alias("owner"), F.col("attempt").cast("long"), F.col("id").cast("long")))
    owner = F.last("owner", ignorenulls=True).over(W.partitionBy("job").orderBy("us", F.col("id").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow))
    good = line.withColumn("now", owner).where("id is not null and attempt = now")
    return good.groupBy("job").agg(F.max(F.struct("us", "id")).alias("b")).select("job", "b.id", "b.us")


def concurrency(intervals: DataFrame, limit: int) -> DataFrame:
    """(key, id, running, breach) at the start of each interval (key, id, start, end), itself included; an end frees before a start."""
    edge = F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d"))))
    edges = intervals.where("end > start").select("key", "id", edge.alias("e")).select("key", "id", "e.at", "e.d")
    running = F.sum("d").over(W.partitionBy("key").orderBy("at", "d", "id").rowsBetween(W.unboundedPreceding, W.currentRow))
    return edges.withColumn("running", running).where("d = 1").select("key", "id", "running", (F.col("running") > limit).alias("breach"))


def backlog(jobs: DataFrame, n: int = 25) -> DataFrame:
    """Adds ``r`` <= n: the longest-waiting jobs of a type by priority, time and id."""
    order = F.row_number().over(W.partitionBy("type").orderBy("priority", "us", "id"))
    return jobs.withColumn("r", order).where(F.col("r") <= n)


def stage_durations(log: DataFrame) -> DataFrame:
    """(job, stage, occurrence, us) of each start of a stage: to its first finish before the next start, else to the job's last event.

    ``log``: (job, seq, stage, state, us) with states started and finished.
    """
    occurrence = F.sum(F.when(F.col("state") == "started", 1).otherwise(0)).over(W.partitionBy("job", "stage").orderBy("seq").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = log.withColumn("occurrence", occurrence).where("occurrence > 0")
    last = log.groupBy("job").agg(F.max_by("us", "seq").alias("last"))
    began = F.min(F.when(F.col("state") == "started", F.col("us")))
    ended = F.min_by(F.col("us"), F.when(F.col("state") == "finished", F.col("seq")))
    spans = rows.groupBy("job", "stage", "occurrence").agg(began.alias("began"), ended.alias("ended"))
    return spans.join(last, "job").select("job", "stage", "occurrence", (F.coalesce("ended", "last") - F.col("began")).alias("us"))


def replay_after(log: DataFrame, seq: int) -> DataFrame:
    """What a client that has seen ``seq`` has missed."""
    return log.where(F.col("seq") > seq)


def latest_progress(log: DataFrame) -> DataFrame:
    """(job, seq, stage, state): the newest event of each job."""
    return log.groupBy("job").agg(F.max(F.struct("seq", "stage", "state")).alias("b")).select("job", "b.*")


def latency_report(jobs: DataFrame, late: float) -> DataFrame:
    """(type, n, p50, p95, late) of durations (type, seconds), and of all by rollup."""
    return jobs.rollup("type").agg(
        F.count("*").alias("n"), F.round(F.percentile("seconds", 0.5), 4).alias("p50"), F.round(F.percentile("seconds", 0.95), 4).alias("p95"), F.count_if(F.col("seconds") > late).alias("late")
    )


def ledger_insert(new: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows of ``new`` (key, id, ...) to append: the first of each key that the ledger does not hold."""
    first = new.withColumn("_r", F.row_number().over(W.partitionBy("key").orderBy("id"))).where("_r = 1").drop("_r")
    return first.join(ledger.select("key").distinct(), "key", "left_anti")


def usage_summary(ledger: DataFrame, kinds: list[str]) -> DataFrame:
    """(user, one count for each kind, cost) of the ledger (user, kind, cost); a user without cost has 0."""
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds]
    return ledger.groupBy("user").agg(*counts, F.coalesce(F.sum("cost"), F.lit(0)).cast("decimal(22,6)").alias("cost"))


def call_cost(usage: DataFrame, cents: dict[str, int]) -> DataFrame:
    """Adds ``cost`` in dollars: each kind of token times its price in cents a million; exact to eight places."""
    total = sum((F.coalesce(F.col(k), F.lit(0)).cast("decimal(18,0)") * F.lit(v).cast("decimal(6,0)") for k, v in cents.items()), F.lit(0).cast("decimal(1,0)"))
    return usage.withColumn("cost", (total * F.expr("cast(0.00000001 as decimal(9,8))")).cast("decimal(28,8)"))


def budget_cut(calls: DataFrame, cap) -> DataFrame:
    """Adds ``before`` and ``outcome``: a call (run, seq, cost) runs while what was spent before it is under the cap, else COST_LIMIT.

    The call that crosses the cap still runs. Skipped calls would cost nothing, which leaves the sum over the cap.
    """
    before = F.coalesce(F.sum("cost").over(W.partitionBy("run").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return calls.withColumn("before", before).withColumn("outcome", F.when(F.col("before") < cap, "ran").otherwise("COST_LIMIT"))


def latest_version(versions: DataFrame) -> DataFrame:
    """(owner, version, payload): the newest version of each owner."""
    return versions.groupBy("owner").agg(F.max("version").alias("version"), F.max_by("payload", "version").alias("payload"))


def next_version(owners: DataFrame, versions: DataFrame) -> DataFrame:
    """(owner, version): one more than the newest, 1 for an owner without any."""
    top = versions.groupBy("owner").agg(F.max("version").alias("v"))
    return owners.select("owner").join(top, "owner", "left").select("owner", (F.coalesce("v", F.lit(0)) + 1).alias("version"))


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(change, columns): rows removed, added and kept between two versions, as multisets."""
    tag = lambda df, name: df.select(F.lit(name).alias("change"), "*")
    return tag(old.exceptAll(new), "removed").unionByName(tag(new.exceptAll(old), "added")).unionByName(tag(old.intersectAll(new), "kept"))


def carry_over(changed: DataFrame, previous: DataFrame, group: str) -> DataFrame:
    """The next version: the changed groups, and all groups of the previous one that did not change."""
    return changed.unionByName(previous.join(changed.select(group).distinct(), group, "left_anti"))


def report_as_of(runs: DataFrame, versions: DataFrame) -> DataFrame:
    """(section, version, report): for each section and asked version the newest run (section, version, report, started) at or before it.

    ``versions`` (version) is a short list of questions, which are numbered in order. A section's runs between two questions are one
    row, the newest run so far is carried along these rows, and each answers the questions up to the next: only runs are shuffled and
    sorted, and the answers, a row for each section and question, are made last. Sections without a run at or before a version have
    no row for it. A null version is never at or before another; equal runs give one.
    """
    runs = runs.where("version is not null")
    asked = versions.where("version is not null").select("version", F.lit(1).alias("asked"))
    marks = written(runs.select("version", F.lit(0).alias("asked")).unionByName(asked).groupBy("version").agg(F.max("asked").alias("asked")), "versions")
    placed = written(running(marks, [], [F.col("version")], F.col("asked"), "upto"), "questions")
    questions = placed.where("asked = 1").select(F.col("upto").alias("place"), "version")
    n = questions.count()
    best = runs.join(placed.select("version", (F.col("upto") - F.col("asked") + 1).alias("first")), "version")
    best = best.where(F.col("first") <= n).groupBy("section", "first").agg(F.max(F.struct("started", "version", "report")).alias("best"))
    line = W.partitionBy("section").orderBy("first")
    spans = best.select("section", "first", F.max("best").over(line).alias("newest"), F.coalesce(F.lead("first").over(line), F.lit(n + 1)).alias("next"))
    answers = spans.select("section", F.col("newest.report").alias("report"), F.explode(F.sequence("first", F.col("next") - 1)).alias("place"))
    return answers.join(F.broadcast(questions) if n <= QUESTIONS else questions, "place").select("section", "version", "report")


def roots(tree: DataFrame) -> DataFrame:
    """(id, root) of a forest (id, parent), by pointer jumping: rounds double the distance."""
    state = written(tree.select("id", F.coalesce("parent", "id").alias("root")), "roots")
    while True:
        up = state.select(F.col("id").alias("root"), F.col("root").alias("higher"))
        after = written(state.join(up, "root").select("id", F.col("higher").alias("root"), (F.col("root") != F.col("higher")).alias("moved")), "roots")
        remove(state)
        state = after
        if state.where("moved").isEmpty():
            return state.select("id", "root")


def latest_in_tree(snapshots: DataFrame) -> DataFrame:
    """(root, id): the newest descendant (by created, then id) of each original, itself included."""
    own = snapshots.select("id", "created").join(roots(snapshots), "id")
    return own.groupBy("root").agg(F.max(F.struct("created", "id")).alias("b")).select("root", "b.id")


def revisions_of(snapshots: DataFrame, parent: int) -> DataFrame:
    """The direct revisions of one snapshot."""
    return snapshots.where(F.col("parent") == parent)


def activate(items: DataFrame) -> DataFrame:
    """(owner, id, status): the newest accepted item is active, the other accepted ones archived, the rest as they were."""
    order = F.row_number().over(W.partitionBy("owner", F.col("status") == "accepted").orderBy(F.col("created").desc(), F.col("id").desc()))
    ranked = items.withColumn("_r", order)
    status = F.when(F.col("status") != "accepted", F.col("status")).when(F.col("_r") == 1, "active").otherwise("archived")
    return ranked.select("owner", "id", status.alias("status"))


def reusable_by_version(matches: DataFrame, libraries: DataFrame) -> DataFrame:
    """(owner, id, r): matches of the owner's library version that are no reuses themselves, newest first."""
    good = matches.where("cache_of is null").join(libraries, ["owner", "version"])
    return good.select("owner", "id", F.row_number().over(W.partitionBy("owner").orderBy(F.col("created").desc(), F.col("id").desc())).alias("r"))


def pending_deletions(marked: DataFrame, done: DataFrame) -> DataFrame:
    """Marked keys that are not deleted yet."""
    return marked.join(done.select("key"), "key", "left_anti")


def purge(tables: dict[str, DataFrame], users: DataFrame, ledger: str = "ledger", keep: tuple[str, ...] = ("id", "user", "cost")) -> dict[str, DataFrame]:
    """Tables without the rows of ``users`` (user); the ledger keeps its rows but only ids and amounts of those users."""
    gone = users.select("user").distinct()
    out = {name: df.join(gone, "user", "left_anti") for name, df in tables.items() if name != ledger}
    if ledger in tables:
        df = tables[ledger].join(gone.withColumn("_gone", F.lit(True)), "user", "left")
        out[ledger] = df.select(*[F.col(c) if c in keep else F.when(F.col("_gone").isNull(), F.col(c)).alias(c) for c in tables[ledger].columns])
    return out


def posting_status(postings: DataFrame, matches: DataFrame, failed: DataFrame, limit: int) -> DataFrame:
    """(owner, id, status, r): ready if matched, failed if its job failed, else pending; the newest of an owner, 1 to 100 of them."""
    n = max(1, min(100, limit))
    rows = postings.join(matches.select("id", F.lit(True).alias("_m")).distinct(), "id", "left").join(failed.select("id", F.lit(True).alias("_f")).distinct(), "id", "left")
    status = F.when(F.col("_m"), "ready").when(F.col("_f"), "failed").otherwise("pending")
    order = F.row_number().over(W.partitionBy("owner").orderBy(F.col("created").desc(), F.col("id").desc()))
    return rows.select("owner", "id", status.alias("status"), order.alias("r")).where(F.col("r") <= n)


def daily_quota(runs: DataFrame, limit: int = 5, window: int = DAY) -> DataFrame:
    """Adds ``used`` and ``over``: runs of the user in the last day, this one included, and whether they are more than the limit."""
    return offered_load(runs, window).withColumnRenamed("load", "used").withColumn("over", F.col("used") > limit)


def token_use(requests: DataFrame, tokens: DataFrame) -> DataFrame:
    """Adds ``outcome`` to requests (token, us, id, peek): used by the first that comes before the expiry; peeks do not consume.

    ``tokens``: (token, expires). The outcomes: valid (a peek, or the use), used, expired, unknown.
    """
    rows = requests.join(tokens, "token", "left")
    live = F.col("us") < F.col("expires")
    won = F.min(F.when(live & ~F.col("peek"), F.struct("us", "id"))).over(W.partitionBy("token"))
    own = F.struct("us", "id")
    outcome = (
        F.when(F.col("expires").isNull(), "unknown").when(~live, "expired").when(won.isNull() | (own < won) | (own == won), "valid").otherwise("used")
    )
    return rows.withColumn("outcome", outcome).drop("expires")
