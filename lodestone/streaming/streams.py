"""Streams of events: admission limits, idempotent creation, expiring leases, windows, late rows, and upserts.

Each twin gives what the batch operator gives on the rows that are not later than the watermark. Later ones change no state and
are not lost: they come out with ``late`` set, and ``two_sinks`` writes them beside the accepted ones. Input streams have ``ts``
(a timestamp without zone is read as UTC), ``key`` and ``id``; the state of a key lives in the state store, with that of the other
keys of its part, in one task. Within a micro-batch a key's rows are taken in order of (ts, id).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.durable import new_folder, written
from lodestone.operators.events import MINUTE, windowed_counts

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts that keys are dealt to; a call and a state value are for a part, as each costs some 30 milliseconds.
KEY_PARTS = 512
#: The part of the null key.
NO_KEY = -1
#: The end of the lease of a job that waits to be claimed again.
WAITING = 1 << 62


def _ordered(batches: Iterator[pd.DataFrame], timers) -> tuple[pd.DataFrame, pd.DataFrame]:
    """A part's new rows of one micro-batch in order: those in time, and those that the watermark has passed."""
    frame = pd.concat(list(batches)).sort_values(["us", "id"], kind="stable")
    late = frame["us"] // 1000 <= timers.getCurrentWatermarkInMs()
    return frame[~late], frame[late]


class _Split(StatefulProcessor):
    """No state: rows with ``late``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame, late in zip(_ordered(rows, timerValues), (False, True), strict=True):
            yield frame.drop(columns=["_part"], errors="ignore").assign(late=late)

    def close(self) -> None:
        pass


class _Parted(StatefulProcessor):
    """State: rows of longs, the first their key, of all keys of one part, as one value that is read and written once a micro-batch."""

    width = 2

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "longs binary")

    def _load(self) -> list[list[int]]:
        return np.frombuffer(bytes(self.state.get()[0]), np.int64).reshape(-1, self.width).tolist() if self.state.exists() else []

    def _save(self, rows: list[tuple[int, ...]], timer: int | None = None) -> None:
        """Keep these rows, and a timer (microseconds) after which some are to be looked at."""
        if rows:
            self.state.update((np.array(rows, np.int64).tobytes(),))
            if timer is not None:
                self.handle.registerTimer(timer // 1000 + 1)
        else:
            self.state.clear()

    @staticmethod
    def _out(part, frame: pd.DataFrame, **more) -> pd.DataFrame:
        """(key, us, ...) of the rows of a part; that of the null key is NO_KEY."""
        key = frame["key"] if part[0] != NO_KEY else pd.Series([None] * len(frame), index=frame.index, dtype=object)
        return pd.DataFrame({"key": key, "us": frame["us"], **more})

    def close(self) -> None:
        pass


class _RateLimit(_Parted):
    """State: the times of a key's last admitted events, at most ``limit`` of them; those that have left the window go, by a timer at the latest."""

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, late = _ordered(rows, timerValues)
        held, admitted = {}, []
        for k, us in self._load():
            held.setdefault(k, []).append(us)
        for k, us in zip(frame["key"].tolist(), frame["us"].tolist(), strict=True):
            mine = [h for h in held.get(k, ()) if h > us - self.window]
            ok = len(mine) < self.limit
            if ok:
                mine.append(us)
            held[k] = mine
            admitted.append(ok)
        self._hold([(k, us) for k, mine in held.items() for us in mine], timerValues)
        yield self._out(key, frame, id=frame["id"], admitted=admitted, late=False)
        yield self._out(key, late, id=late["id"], admitted=None, late=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._hold(self._load(), timerValues)
        yield from ()

    def _hold(self, rows: list, timers) -> None:
        """Keep the times that events after the watermark may still count."""
        kept = [r for r in rows if r[1] > timers.getCurrentWatermarkInMs() * 1000 - self.window]
        self._save(kept, max((r[1] for r in kept), default=0) + self.window)


class _Idempotent(_Parted):
    """State: the job that a key created last, and when, as long as it counts for events after the watermark."""

    width = 3

    def __init__(self, window: int):
        self.window = window

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, late = _ordered(rows, timerValues)
        anchors, created, job = {k: (us, i) for k, us, i in self._load()}, [], []
        for k, us, i in zip(frame["key"].tolist(), frame["us"].tolist(), frame["id"].tolist(), strict=True):
            anchor = anchors.get(k)
            new = anchor is None or us - anchor[0] >= self.window
            if new:
                anchor = anchors[k] = (us, int(i))
            created.append(new)
            job.append(anchor[1])
        since = timerValues.getCurrentWatermarkInMs() * 1000 - self.window
        self._save([(k, us, i) for k, (us, i) in anchors.items() if us > since])
        yield self._out(key, frame, id=frame["id"], created=created, job=job, late=False)
        yield self._out(key, late, id=late["id"], created=None, job=None, late=True)


class _Lease(_Parted):
    """State: a running job's attempts and the end of its lease; a timer says what becomes of it then unless a heartbeat or an end comes first."""

    width = 3

    def __init__(self, lease: int):
        self.lease = lease

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        jobs, out = {k: (attempts, until) for k, attempts, until in self._load()}, []
        frame, late = _ordered(rows, timerValues)
        for k, us, what in zip(frame["key"].tolist(), frame["us"].tolist(), frame["what"].tolist(), strict=True):
            job = jobs.pop(k, None)
            if job is not None and us > job[1]:
                out.append((k, job[1], "queued" if job[0] < 2 else "WORKER_LOST"))
                job = (job[0], -1)
            if what == "claim":
                job = ((job[0] if job else 0) + 1, us + self.lease)
            elif job is not None and job[1] > 0:
                job = (job[0], us + self.lease) if what == "heartbeat" else (0, -1)
            if job is not None and job[1] < 0:
                job = None if job[0] == 0 or job[0] >= 2 else (job[0], WAITING)
            if job is not None:
                jobs[k] = job
        self._keep(jobs)
        yield self._out(key, late, outcome=None, late=True)
        yield self._ended(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs, now, out = {}, timerValues.getCurrentWatermarkInMs(), []
        for k, attempts, until in self._load():
            if until < WAITING and until // 1000 + 1 < now:
                out.append((k, until, "queued" if attempts < 2 else "WORKER_LOST"))
                until = WAITING if attempts < 2 else None
            if until is not None:
                jobs[k] = attempts, until
        self._keep(jobs)
        yield self._ended(key, out)

    def _keep(self, jobs: dict) -> None:
        """The part's jobs, and a timer for the first lease that ends."""
        self._save([(k, *job) for k, job in jobs.items()], min((until for _, until in jobs.values() if until < WAITING), default=None))

    def _ended(self, part, out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["key", "us", "outcome"])
        return self._out(part, frame, outcome=frame["outcome"], late=False)


def _stateful(stream: DataFrame, processor: StatefulProcessor, schema: str, late: str, extra: tuple[str, ...] = (), by: str = "") -> DataFrame:
    """The stream through a processor, by key in KEY_PARTS parts or by a column. The event time itself is left out, so Spark drops no late row before the processor."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    if not by:
        by, key = "_part", F.col("key").cast("long")
        part = F.when(key.isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64(key), F.lit(KEY_PARTS)))
        rows, extra = rows.select(F.coalesce(key, F.lit(0)).alias("key"), "ts", "id", *extra, part.cast("long").alias(by)), ("key", *extra)
    rows = rows.select(by, F.unix_micros("ts").alias("us"), "id", *extra)
    return rows.groupBy(by).transformWithStateInPandas(processor, schema, outputMode="Append", timeMode="EventTime")


def rate_limit_stream(stream: DataFrame, limit: int, window: int, late: str = "10 minutes") -> DataFrame:
    """Events with ``admitted``, as the batch rule ``rate_limit`` decides; null and ``late`` behind the watermark."""
    return _stateful(stream, _RateLimit(limit, window), "key long, us long, id long, admitted boolean, late boolean", late)


def idempotent_stream(stream: DataFrame, window: int, late: str = "10 minutes") -> DataFrame:
    """Requests with ``created`` and ``job``, as the batch rule ``idempotent_create`` decides; null and ``late`` behind the watermark."""
    return _stateful(stream, _Idempotent(window), "key long, us long, id long, created boolean, job long, late boolean", late)


def lease_stream(stream: DataFrame, lease: int = 2 * MINUTE, late: str = "10 minutes") -> DataFrame:
    """(key, us, outcome, late): jobs whose lease ran out, from a stream of (key, ts, id, what) with claim, heartbeat and end; events behind the watermark have no outcome."""
    return _stateful(stream, _Lease(lease), "key long, us long, outcome string, late boolean", late, ("what",))


def split_stream(stream: DataFrame, late: str = "10 minutes", *extra: str) -> DataFrame:
    """(us, id, extra, late): the rows (ts, id, extra) with whether the watermark had passed them when they came.

    For operators that would drop them, such as windowed counts: these read the accepted sink, whose rows are all in time. Rows
    are dealt by id, so no key is hot.
    """
    dealt = stream.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    kinds = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in extra)
    return _stateful(dealt, _Split(), f"us long, id long, {kinds + ', ' if kinds else ''}late boolean", late, extra, "_part")


def counts_stream(stream: DataFrame, kind: str, size: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Windowed counts of a stream; a window is given out once the watermark has passed it."""
    return windowed_counts(stream, kind, size, slide, late)


def two_sinks(result: DataFrame, accepted: str, late: str, marks: str) -> None:
    """Run a stream with ``late`` until its files are read: rows in time go to ``accepted``, the others to ``late``.

    Each micro-batch has a folder of its own in both, named by its number and overwritten if it is run again.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = written(batch, "batch")
        for path, part in ((accepted, rows.where("not late")), (late, rows.where("late"))):
            part.drop("late").write.mode("overwrite").parquet(f"{path}/batch={number}")

    result.writeStream.foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def upsert_stream(stream: DataFrame, folder: str, keys: list[str], order: str, marks: str, compact: int = 16) -> None:
    """Run a stream of versions until its files are read, keeping in ``folder`` the newest row of each key by ``order``.

    A micro-batch writes the newest row of its keys to a folder named by its number, so one that runs again after a failure only
    replaces what it wrote. Every ``compact`` batches what is there is merged to a new base; ``newest`` reads it only once it is complete.
    """

    def write(batch: DataFrame, number: int) -> None:
        _newest(batch, keys, order).write.mode("overwrite").parquet(f"{folder}/delta/batch={number}")
        if number % compact == compact - 1:
            written(newest(batch.sparkSession, folder, batch.schema, keys, order, number), "base").write.mode("overwrite").parquet(f"{folder}/base/upto={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()


def _newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")


def _complete(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the complete tables ``path/name=N``."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def newest(spark: SparkSession, folder: str, schema, keys: list[str], order: str, upto: int | None = None) -> DataFrame:
    """The newest row of each key that ``upsert_stream`` has kept: of the last complete base and the batches after it, up to a number."""
    upto = (1 << 62) if upto is None else upto
    base = [n for n in _complete(spark, f"{folder}/base", "upto") if n <= upto][-1:]
    paths = [f"{folder}/base/upto={n}" for n in base] + [f"{folder}/delta/batch={n}" for n in _complete(spark, f"{folder}/delta", "batch") if (base or [-1])[0] < n <= upto]
    return _newest(spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema), keys, order)


def upsert(batch: DataFrame, path: str, keys: list[str], order: str, day: str) -> None:
    """Write the newest row of each key of a micro-batch into partitions by ``day``, replacing those partitions whole.

    For ``foreachBatch``: the partitions touched are read, merged with the batch, and written beside before they replace the old.
    """
    spark = batch.sparkSession
    days = [r[0] for r in batch.select(day).distinct().collect()]  # the few days of a micro-batch
    try:
        old = spark.read.schema(batch.schema).parquet(path).where(F.col(day).isin(days))
        both = batch.unionByName(old.select(batch.columns))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        both = batch
    newest = both.groupBy(*keys).agg(F.max_by(F.struct("*"), order).alias("r")).select("r.*")
    written(newest, "upsert").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def replayed(spark: SparkSession, files: str, schema: str, build: Callable[[DataFrame], DataFrame], per_trigger: int = 1) -> DataFrame:
    """Run a stream over the files of a folder until all are read, and return what it gave out as a table.

    Sink and checkpoint are in the shared folder, so the stream can be resumed on any machine. Late rows are left out; see ``both``.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(files)
    out, marks = new_folder(spark, "out"), new_folder(spark, "marks")
    result = build(stream)
    if "late" in result.columns:
        return both(spark, files, schema, build, per_trigger)[0]
    query = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def both(spark: SparkSession, files: str, schema: str, build: Callable[[DataFrame], DataFrame], per_trigger: int = 1) -> tuple[DataFrame, DataFrame]:
    """(accepted, late): as ``replayed``, with the rows that were behind the watermark as a table of their own."""
    result = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(files))
    accepted, late = new_folder(spark, "accepted"), new_folder(spark, "late")
    two_sinks(result, accepted, late, new_folder(spark, "marks"))
    kind = result.drop("late").schema
    return tuple(spark.read.schema(kind).option("recursiveFileLookup", True).parquet(p) for p in (accepted, late))
