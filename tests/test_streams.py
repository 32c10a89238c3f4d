"""Late rows and restarts of streams."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.durable import new_folder
from lodestone.operators import events as ev
from lodestone.streaming import streams

SCHEMA = "ts timestamp, key long, id long"


def files_of(spark, rows, parts):
    """Rows (us, key, id) in files one after the other; ``parts``: the file of each row."""
    df = spark.createDataFrame([(*r, p) for r, p in zip(rows, parts, strict=True)], "us long, key long, id long, part int").withColumn("ts", F.timestamp_micros("us"))
    path = new_folder(spark, "input")
    for p in sorted(set(parts)):
        df.where(F.col("part") == p).select("ts", "key", "id").coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture(scope="module")
def late_input(spark):
    rng = random.Random(41)
    rows = [((1_700_000_000 + rng.randrange(40_000)) * 10**6 + i, rng.choice([0, 0, 0, 1, 2]), i) for i in range(200)]
    own = [(r[0] // 10**6 - 1_700_000_000) // 10_000 for r in rows]
    parts = [min(3, p + (rng.random() < 0.3 and (r[0] // 10**6 - 1_700_000_000) % 10_000 < 8_000)) for r, p in zip(rows, own, strict=True)]  # so far behind that the others are in order
    mark, late = -(1 << 62), set()
    for p in range(4):
        mine = [r for r, q in zip(rows, parts, strict=True) if q == p]
        late |= {r[2] for r in mine if r[0] // 1000 <= mark}
        mark = max([mark, *[max(r[0] for r in rows_) // 1000 - 600_000 for rows_ in [mine] if rows_]])
    assert 5 < len(late) < 100
    return rows, late, files_of(spark, rows, parts)


def test_late_rows_are_kept(spark, late_input):
    rows, late, path = late_input
    ids = lambda df: sorted(r["id"] for r in df.select("id").collect())
    in_time = spark.createDataFrame([r for r in rows if r[2] not in late], "us long, key long, id long").select("key", "us", "id")
    for build, batch in (
        (lambda s: streams.rate_limit_stream(s, 4, ev.HOUR), lambda d: ev.rate_limit(d, 4, ev.HOUR)),
        (lambda s: streams.idempotent_stream(s, ev.HOUR), lambda d: ev.idempotent_create(d, ev.HOUR)),
        (lambda s: streams.split_stream(s, "10 minutes", "key"), None),
    ):
        accepted, behind = streams.both(spark, path, SCHEMA, build)
        assert ids(behind) == sorted(late) and ids(accepted) + ids(behind) and sorted(ids(accepted) + ids(behind)) == [r[2] for r in rows]
        if batch:  # late rows have changed no state
            assert sorted(map(str, accepted.select(*sorted(accepted.columns)).collect())) == sorted(map(str, batch(in_time).select(*sorted(accepted.columns)).collect()))
    counted = streams.replayed(spark, path, SCHEMA, lambda s: streams.split_stream(s))
    assert counted.count() == len(rows) - len(late)
    what = lambda s: s.withColumn("what", F.lit("claim"))
    _, behind = streams.both(spark, path, SCHEMA, lambda s: streams.lease_stream(what(s)))
    assert behind.count() == len(late)


def test_windows_count_every_accepted_row(spark, late_input):
    rows, late, path = late_input
    accepted, behind = streams.both(spark, path, SCHEMA, lambda s: streams.split_stream(s, "10 minutes", "key"))
    counts = accepted.groupBy(F.expr(f"us div {ev.HOUR}")).count()
    assert counts.agg(F.sum("count")).first()[0] + behind.count() == len(rows)


def test_upserts_survive_a_restart(spark):
    rng = random.Random(42)
    rows = [(i, rng.randrange(12), rng.choice("abc")) for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, job long, stage string")
    path, folder, marks = new_folder(spark, "input"), new_folder(spark, "kept"), new_folder(spark, "marks")
    for p in range(6):
        df.where((F.col("seq") >= 20 * p) & (F.col("seq") < 20 * p + 20)).coalesce(1).write.mode("append").parquet(path)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    plain, calls = streams._newest, []

    def dies(batch, keys, order):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return plain(batch, keys, order)

    streams._newest = dies
    try:
        with pytest.raises(Exception, match="lost"):
            streams.upsert_stream(stream(), folder, ["job"], "seq", marks, compact=2)
    finally:
        streams._newest = plain
    assert streams.newest(spark, folder, df.schema, ["job"], "seq").agg(F.max("seq")).first()[0] < 119
    for _ in range(2):  # to the end, and once more without news
        streams.upsert_stream(stream(), folder, ["job"], "seq", marks, compact=2)
        got = {r["job"]: (r["seq"], r["stage"]) for r in streams.newest(spark, folder, df.schema, ["job"], "seq").collect()}
        assert got == {j: max((s, t) for s, k, t in rows if k == j) for _, j, _ in rows}
    # a batch that runs again writes what it wrote
    again = new_folder(spark, "marks")
    streams.upsert_stream(stream(), folder, ["job"], "seq", again, compact=2)
    assert {r["job"]: (r["seq"], r["stage"]) for r in streams.newest(spark, folder, df.schema, ["job"], "seq").collect()} == got


def test_json_quarantine(spark):
    from lodestone.sources import quarantined_json, write_partitions

    folder = new_folder(spark, "json")
    lines = ['{"a": 1, "b": "x"}', '{"a": 2, "b": "y"', "junk", "", '{"a": "no number", "b": "z"}', '{"a": 3}', '{"b": "w", "c": 9}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(folder)
    good, bad = quarantined_json(spark, folder, "a long, b string")
    assert sorted((r["a"], r["b"]) for r in good.where("a is not null and b is not null").collect()) == [(1, "x")] and good.count() == 3
    assert {r["line"] for r in bad.collect()} == {lines[1], lines[2], lines[4]} and all(r["path"].startswith("file:") for r in bad.collect())
    kept = new_folder(spark, "kept")
    write_partitions(good.fillna({"b": "none"}), kept, "b")
    write_partitions(spark.createDataFrame([(7, "x")], "a long, b string"), kept, "b")  # only that partition is replaced
    assert sorted((r["a"] or -1, r["b"]) for r in spark.read.schema("a long, b string").parquet(kept).collect()) == [(-1, "w"), (3, "none"), (7, "x")]


def test_keys_share_calls(spark, monkeypatch):
    """Each key had a call and a state value of its own in every micro-batch; the null key and all keys in one part give the same."""
    rng = random.Random(43)
    rows = [((1_700_000_000 + 40 * i) * 10**6, None if i % 9 == 0 else rng.randrange(-3, 9) * 10**17, i) for i in range(300)]
    path, ids = files_of(spark, rows, [i // 100 for i in range(300)]), spark.createDataFrame(rows, "us long, key long, id long").select("key", "us", "id")
    monkeypatch.setattr(streams, "KEY_PARTS", 1)
    accepted, behind = streams.both(spark, path, SCHEMA, lambda s: streams.rate_limit_stream(s, 3, ev.HOUR))
    want = sorted(map(str, ev.rate_limit(ids, 3, ev.HOUR).select(*sorted(accepted.columns)).collect()))
    assert behind.count() == 0 and sorted(map(str, accepted.select(*sorted(accepted.columns)).collect())) == want
    plan = streams.rate_limit_stream(spark.readStream.schema(SCHEMA).parquet(path), 3, ev.HOUR)._jdf.queryExecution().analyzed().toString()
    assert "transformWithStateUDF(_part" in plan
