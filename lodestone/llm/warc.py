"""WARC archives and an external merge of their capture indexes.

Writing. Each page becomes one record. Among records whose payloads are equal and have at least ``REVISIT`` bytes, the one
with the largest page_id is the response and the others are revisits that refer to it; smaller payloads are always
responses. Spark's text writer lays the records out, gzipped, one archive a task; a record ends with two line breaks, which
are the writer's line separator. Archives go to the shared folder.

Reading. Each archive is parsed in a task by the records' own Content-Length. Its index entries, sorted by URL key and
timestamp, are a run.

Merging. The runs are range-partitioned by (URL key, timestamp, page_id), so that a much captured URL spreads over ranges.
In each range the runs' segments arrive in their local order and are merged by a loser tree: one comparison a level for
each entry given out. The ranges in order, and the places in them, give the global order of captures.

Null html is an empty payload. A null url has an empty URL key. Rows that repeat a page_id with the same payload are the
same record: all are responses if that id is the largest. Null ids never are the larger one. Pages have no time of capture, so
the timestamp is ``START`` plus as many seconds as page_id modulo ``CYCLE`` (some thirty years, so the year has four digits). An
empty table gives no rows; extra columns are not read; payloads of any length are whole.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.durable import new_folder, written
from lodestone.sources import table

REVISIT = 1000
START, CYCLE = 1_600_000_000, 1_000_000_000
END = "\r\n\r\n"
#: Records in an archive at most, and bytes of payload on average at most. A task that reads one holds it compressed, and of its records one at a time.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 4000, 256 << 20
#: Index entries in a merge range, on average.
RANGE_ENTRIES = 100_000


def url_key(url: Column) -> Column:
    """SURT form of the URL: host labels reversed, then path and query, in lower case and without scheme, www. and fragment."""
    rest = F.regexp_replace(F.regexp_replace(F.lower(url), "^[a-z][a-z0-9+.-]*://(www[0-9]*\\.)?", ""), "#.*$", "")
    host, path = F.regexp_extract(rest, "^([^/?]*)", 1), F.regexp_extract(rest, "^[^/?]*(.*)$", 1)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), path), F.lit(""))


def digested(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest (SHA-1 in hexadecimal), at (seconds)."""
    payload = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload.cast("binary")).alias("payload_digest"),
        (F.lit(START) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(CYCLE))).alias("at"),
    )


def records(pages: DataFrame) -> DataFrame:
    """(record): the text of each page's WARC record without its closing line breaks.

    The groups of equal payloads are found from digests alone and written; the join of them to the payloads then knows their
    size, sends them if few, and splits a payload that a large share of pages have.
    """
    rows = digested(pages)
    groups = rows.where(F.col("payload_bytes") >= REVISIT).groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = written(groups.where("n > 1 and first is not null").select(F.col("payload_digest").alias("digest"), "first"), "groups")
    joined = rows.join(groups, F.col("payload_digest") == F.col("digest"), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.coalesce(F.regexp_replace("url", "[\r\n]", ""), F.lit(""))), line("WARC-URL-Key", F.regexp_replace(url_key(F.col("url")), "[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))).otherwise(""),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))), F.lit("\r\n"),
    )
    return joined.select(F.concat(head, F.when(revisit, "").otherwise(F.col("payload"))).alias("record"))


def write(pages: DataFrame) -> str:
    """Write the pages' archives; the folder they are in."""
    folder = new_folder(pages.sparkSession, "warc")
    size = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 1
    most = max(1, min(ARCHIVE_RECORDS, int(ARCHIVE_BYTES // max(size, 1))))
    records(pages).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", most).text(folder)
    return folder


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive, read one after the other."""
    while archive.readline().startswith(b"WARC/"):
        fields = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().removesuffix("\r\n").partition(": ")
            fields[name] = value
        yield fields, archive.read(int(fields["Content-Length"]))
        archive.read(len(END))


_COLUMNS = "run string, seq long, url_key string, at string, page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, intact boolean"


def _urn(value: str | None) -> str | None:
    return value[len("<urn:page:") : -1] or None if value else None


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """The index entries of each archive, sorted by (URL key, timestamp, page_id) within it: ``seq`` counts them.

    ``intact``: the block has the digest that the record states, or none is stored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows = []
                for f, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content))):
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = f["WARC-Type"] == "revisit"
                    intact = revisit or hashlib.sha1(block).hexdigest() == digest
                    size = int(f["WARC-Payload-Length"]) if revisit else len(block)
                    rows.append((f["WARC-URL-Key"], f["WARC-Date"], _urn(f["WARC-Record-ID"]), size, digest, f["WARC-Type"], _urn(f.get("WARC-Refers-To")), intact))
                rows.sort(key=_order)
                yield pd.DataFrame([(path.rpartition("/")[2], i, *r) for i, r in enumerate(rows)], columns=[c.split()[0] for c in _COLUMNS.split(", ")])

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInPandas(run, _COLUMNS)


def _order(row: tuple) -> tuple:
    """URL key, timestamp, page_id as a number with null first."""
    return row[0].encode(), row[1], int(row[2]) if row[2] else -(1 << 63)


def merge(segments: list[list], key: Callable) -> Iterator:
    """The entries of sorted ``segments`` in order, by a loser tree; equal keys come in the order of the segments."""
    k = max(1, len(segments))
    at = [0] * k
    done = (1,)

    def head(i: int) -> tuple:
        return (0, key(segments[i][at[i]]), i) if segments and at[i] < len(segments[i]) else done

    heads = [head(i) for i in range(k)]
    loser = [-1] * k  # loser[node]: who lost there; loser[0]: the winner

    def play(i: int) -> None:
        """Entry i climbs to the root; at each node the loser stays."""
        node = (i + k) // 2
        while node > 0:
            if loser[node] < 0:  # while the tree is built, the first to come waits
                loser[node] = i
                return
            if heads[loser[node]] < heads[i]:
                loser[node], i = i, loser[node]
            node //= 2
        loser[0] = i

    for i in range(k):
        play(i)
    while heads[loser[0]] != done:
        i = loser[0]
        yield segments[i][at[i]]
        at[i] += 1
        heads[i] = head(i)
        play(i)


def merged(index: DataFrame) -> DataFrame:
    """The entries in global order: (range, place, url_key, at, ...); ``range`` and ``place`` in it give the order.

    Entries of equal keys go by their run and place there, also between ranges, so captures of one URL may fill many of them.
    """
    spark = index.sparkSession
    index = written(index, "runs")
    n = max(1, -(-index.count() // RANGE_ENTRIES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 64))
    number = F.coalesce(F.col("page_id").cast("decimal(20,0)"), F.lit(-(1 << 63)).cast("decimal(20,0)"))
    dealt = index.withColumn("number", number).repartitionByRange(n, "url_key", "at", "number", "run", "seq").sortWithinPartitions("run", "seq")
    names = index.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        segments: dict[str, list] = {}
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                segments.setdefault(row[0], []).append(row)
        part = TaskContext.get().partitionId()
        out = []
        for place, row in enumerate(merge(list(segments.values()), lambda r: _order(r[2:]))):
            out.append((part, place, *row))
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=["range", "place", *names])
                out = []
        yield pd.DataFrame(out, columns=["range", "place", *names])

    return dealt.select(*names).mapInPandas(run, f"range int, place long, {_COLUMNS}")


def capture_history(pages: DataFrame) -> DataFrame:
    """Write the archives, read them back, and merge their indexes."""
    index = runs(pages.sparkSession, write(pages))
    kind = pages.schema["page_id"].dataType
    out = merged(index)
    return out.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def op1_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capture history of all pages."""
    history = capture_history(table(spark, sf_dir, "pages"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "at")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, lower(sha1(coalesce(html, ''))) AS payload_digest, url FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1),
r AS (SELECT p.*, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000),
u AS (SELECT *, regexp_replace(regexp_replace(lower(url), '^[a-z][a-z0-9+.-]*://(www[0-9]*\\.)?', ''), '#.*$', '') AS rest FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to,
  coalesce(array_to_string(list_reverse(string_split(regexp_extract(rest, '^([^/?]*)', 1), '.')), ',') || ')' || regexp_extract(rest, '^[^/?]*(.*)$', 1), '') AS url_key,
  strftime(to_timestamp(1600000000 + (coalesce(page_id, 0) % 1000000000 + 1000000000) % 1000000000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS "at"
FROM u
"""
