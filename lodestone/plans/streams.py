"""Queries that run a stream over the events, a file a micro-batch, until all are read."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.durable import new_folder
from lodestone.operators.events import DAY, HOUR
from lodestone.plans import events as ev_plans
from lodestone.plans.catalog import query
from lodestone.sources import events, micros, table
from lodestone.streaming import streams


def _files(spark, sf, late: bool = False) -> str:
    """The events in files by time, one after the other, as a stream would bring them; if ``late``, every tenth comes with the file after its own."""
    e = events(spark, sf)
    low, high = e.agg(F.min("us"), F.max("us")).first()
    path = new_folder(spark, "events")
    own = F.expr(f"(us - {low}) * 4 div {high - low + 1}") if low is not None else F.lit(0)
    files = e.withColumn("file", own + F.when(F.col("event_id") % 10 == 3, 1).otherwise(0) if late else own)
    for n in range(5 if late else 4):  # a stream takes files by their time
        files.where(F.col("file") == n).drop("file", "us").repartition(1).write.mode("append").parquet(path)
        time.sleep(0.05)
    return path


_LATE = """WITH e AS (SELECT *, epoch_us(ts) AS us FROM events), b AS (SELECT min(us) AS low, max(us) AS high FROM e),
f AS (SELECT e.*, (us - low) * 4 // (high - low + 1) + CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS file FROM e, b),
m AS (SELECT file, max(us) AS most FROM f GROUP BY 1), w AS (SELECT a.file, max(b.most) // 1000 - 600000 AS mark FROM m a JOIN m b ON b.file < a.file GROUP BY 1),
late AS (SELECT f.* FROM f JOIN w USING (file) WHERE us // 1000 <= mark)"""


def _run(spark, sf, build) -> DataFrame:
    return streams.replayed(spark, _files(spark, sf), table(spark, sf, "events").schema, build)


@query("f2_rate_limit_stream")
def f2(spark, sf):
    return _run(spark, sf, lambda s: streams.rate_limit_stream(s.select("ts", F.col("user_id").alias("key"), F.col("event_id").alias("id")), 5, 24 * HOUR))


@query("f4_idempotent_stream")
def f4s(spark, sf):
    return _run(spark, sf, lambda s: streams.idempotent_stream(s.select("ts", F.col("user_id").alias("key"), F.col("event_id").alias("id")), DAY))


@query("f5_lease_stream")
def f5s(spark, sf):
    """Clicks claim, views are heartbeats, purchases end a user's job; a lease lasts a day."""
    what = F.when(F.col("event_type") == "click", "claim").when(F.col("event_type") == "view", "heartbeat").otherwise("end")
    return _run(spark, sf, lambda s: streams.lease_stream(s.select("ts", F.col("user_id").alias("key"), F.col("event_id").alias("id"), what.alias("what")), DAY))


@query("f2_late_rows", f"{_LATE} SELECT user_id AS key, event_id AS id, us FROM late")
def f2l(spark, sf):
    """Events that come after the watermark has passed them, in the sink for late rows of the rate limit."""
    limit = lambda s: streams.rate_limit_stream(s.select("ts", F.col("user_id").alias("key"), F.col("event_id").alias("id")), 5, 24 * HOUR)
    return streams.both(spark, _files(spark, sf, late=True), table(spark, sf, "events").schema, limit)[1].select("key", "id", "us")


@query("f3s_late_counts", f"{_LATE} SELECT event_type, epoch_us(time_bucket(INTERVAL 1 hour, ts)) AS start_us, count(*) AS n, count_if(event_id IN (SELECT event_id FROM late))::BIGINT AS late FROM events GROUP BY ALL")
def f3l(spark, sf):
    """Events in time and late by type and hour: the windows count the accepted sink of the split, and the late table is counted beside."""
    split = lambda s: streams.split_stream(s.select("ts", F.col("event_id").alias("id"), "event_type"), "10 minutes", "event_type")
    accepted, late = streams.both(spark, _files(spark, sf, late=True), table(spark, sf, "events").schema, split)
    hour = F.expr(f"us div {HOUR} * {HOUR}").alias("start_us")
    counts = accepted.withColumn("late", F.lit(0)).unionByName(late.withColumn("late", F.lit(1))).groupBy("event_type", hour)
    return counts.agg(F.count("*").alias("n"), F.sum("late").alias("late"))


@query("f10_progress_stream", ev_plans.ORACLE_PROGRESS)
def f10s(spark, sf):
    """The progress log as a stream of files, upserted by job: the newest event of each."""
    log = ev_plans.log(spark, sf)
    path, folder = new_folder(spark, "log"), new_folder(spark, "progress")
    log.repartitionByRange(6, "seq").write.parquet(path)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(path)
    streams.upsert_stream(stream, folder, ["job"], "seq", new_folder(spark, "marks"), compact=4)
    return streams.newest(spark, folder, log.schema, ["job"], "seq").select("job", "seq", "stage", "state")


@query("f3s_tumbling_stream")
def f3st(spark, sf):
    out = _run(spark, sf, lambda s: streams.counts_stream(s, "tumbling"))
    return out.select(micros("start").alias("start_us"), micros("end").alias("end_us"), "event_type", "n")
