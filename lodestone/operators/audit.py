"""Admission, audits, and comparison of snapshots."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.durable import written
from lodestone.operators.chains import anchors
from lodestone.operators.folds import ordered_fold
from lodestone.operators.ranges import running


def admit(records: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with ``reason``): the first rule (reason, condition) that holds names the reason; null is no hit."""
    reason = F.coalesce(*[F.when(c, r) for r, c in rules])
    judged = records.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def constraint_audit(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) of named tables of violating rows; those without any are listed with 0."""
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def more_than_one(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).count().where("count > 1")


def changed_after_final(rows: DataFrame, key: str, order: str, final: str, value: str) -> DataFrame:
    """Versions that differ, null-safely, from the one before although that was final."""
    w = W.partitionBy(key).orderBy(order)
    seen = rows.withColumn("_f", F.lag(final).over(w)).withColumn("_v", F.lag(value).over(w))
    return seen.where(F.col("_f") & ~F.col("_v").eqNullSafe(F.col(value))).drop("_f", "_v")


def allowlist_audit(rows: DataFrame, allowed: DataFrame, order: str, sample: str) -> DataFrame:
    """(value, n, sample): each value of ``rows`` (value, ...) that ``allowed`` (value) lacks, with its count and first sample."""
    bad = rows.join(allowed.select("value").distinct(), "value", "left_anti")
    return bad.groupBy("value").agg(F.count("*").alias("n"), F.min_by(sample, order).alias("sample"))


def anchor_clusters(points: DataFrame, threshold: int) -> DataFrame:
    """Points (key, at, id) with ``cluster``: a new one starts when the distance to the cluster's first point exceeds the threshold."""
    return anchors(points, threshold + 1).select("key", "at", "id", F.col("nth").alias("cluster"))


def snapshot_drift(before: DataFrame, after: DataFrame, edited: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(doc_id, lines, worst, problem): whether unedited lines (doc_id, page, line_no, y, line) are still there, in place and order.

    Equal lines are matched by occurrence. The first problem in line order: missing, moved page, shifted over the tolerance, out of order.
    ``edited``: (doc_id, line_no) of ``before`` that may differ.
    """
    nth = F.row_number().over(W.partitionBy("doc_id", "h").orderBy("page", "line_no"))
    side = lambda t: t.withColumn("h", F.xxhash64("line")).withColumn("nth", nth)
    kept = side(before).join(edited.select("doc_id", "line_no").distinct(), ["doc_id", "line_no"], "left_anti")
    now = side(after).select("doc_id", "h", "nth", F.col("page").alias("page2"), F.col("line_no").alias("line2"), F.col("y").alias("y2"))
    both = kept.join(now, ["doc_id", "h", "nth"], "left")
    earlier = F.max("line2").over(W.partitionBy("doc_id").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    shift = F.abs(F.col("y2") - F.col("y"))
    problem = F.when(F.col("line2").isNull(), "missing").when(F.col("page2") != F.col("page"), "page").when(shift > tolerance, "shift").when(F.col("line2") < F.col("earlier"), "order")
    judged = both.withColumn("earlier", earlier).withColumn("problem", problem).withColumn("shift", F.when(F.col("page2") == F.col("page"), shift))
    return judged.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.max("shift").alias("worst"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("line_no"))).alias("problem")
    )


def drift_in_order(before: DataFrame, after: DataFrame, edited: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """As ``snapshot_drift``, but each unedited line, in order, is matched to the first equal line of ``after`` beyond the last match.

    This holds for any counts of equal lines. A line without such a match is missing and leaves the place; order cannot be broken.
    The lines of ``after`` of one document are held while the document's lines stream by.
    """
    kept = before.join(edited.select("doc_id", "line_no").distinct(), ["doc_id", "line_no"], "left_anti")
    side = lambda t, n: t.select("doc_id", F.lit(n).alias("side"), "line_no", F.xxhash64("line").alias("h"), "page", "y")

    def step(state: tuple[dict, int], row: tuple) -> tuple:
        places, cursor = state
        _, which, line_no, h, page, y = row
        if which == 0:
            places.setdefault(h, []).append((line_no, page, y))
            return state, (None, None)
        at = bisect_left(places.get(h, ()), cursor, key=lambda p: p[0])
        if at == len(places.get(h, ())):
            return state, ("missing", None)
        line2, page2, y2 = places[h][at]
        off = abs(y2 - y)
        problem = "page" if page2 != page else "shift" if off > tolerance else None
        return (places, line2 + 1), (problem, off if page2 == page else None)

    rows = side(after, 0).unionByName(side(kept, 1))
    judged = ordered_fold(rows, ["doc_id"], ["side", "line_no"], lambda: ({}, 0), step, "problem string, shift double").where("side = 1")
    return judged.groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.max("shift").alias("worst"), F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("line_no"))).alias("problem")
    )


def word_list(text: Column) -> Column:
    """Lower-case words without punctuation at their ends."""
    bare = F.transform(F.split(F.lower(text), "\\s+"), lambda w: F.regexp_replace(w, "^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.filter(bare, lambda w: w != "")


def words_added(pairs: DataFrame, keys: list[str], old: str, new: str) -> DataFrame:
    """(keys, added): how many words of ``new``, as a multiset, ``old`` lacks."""
    count = lambda c, n: pairs.select(*keys, F.explode(word_list(F.col(c))).alias("w")).groupBy(*keys, "w").agg(F.count("*").alias(n))
    both = count(new, "n").join(count(old, "o"), [*keys, "w"], "left")
    added = both.groupBy(*keys).agg(F.sum(F.greatest(F.col("n") - F.coalesce("o", F.lit(0)), F.lit(0))).alias("added"))
    return pairs.select(*keys).distinct().join(added, keys, "left").fillna({"added": 0})


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(owner, slot, change, detail) between two states (owner, slot, project, text, stack).

    project_placed: another project, or one where there was none; else bullet_rewritten: another text; and stack_trimmed: items of
    the stack that are gone, without regard to case.
    """
    a = old.select("owner", "slot", F.col("project").alias("p0"), F.col("text").alias("t0"), F.col("stack").alias("s0"))
    both = a.join(new, ["owner", "slot"], "full")
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    gone = F.array_except(low("s0"), low("stack"))
    placed = F.col("project").isNotNull() & ~F.col("project").eqNullSafe(F.col("p0"))
    same = F.col("project").eqNullSafe(F.col("p0"))
    found = F.array_compact(F.array(
        F.when(placed, F.struct(F.lit("project_placed").alias("change"), F.col("project").cast("string").alias("detail"))),
        F.when(same & ~F.col("text").eqNullSafe(F.col("t0")), F.struct(F.lit("bullet_rewritten").alias("change"), F.col("text").alias("detail"))),
        F.when(same & (F.size(gone) > 0), F.struct(F.lit("stack_trimmed").alias("change"), F.array_join(gone, ", ").alias("detail"))),
    ))
    return both.select("owner", "slot", F.explode(found).alias("c")).select("owner", "slot", "c.change", "c.detail")


def url_ok(url: Column) -> Column:
    """At most 2,048 printable ASCII characters; http or https with a host and without user-info, or mailto:name@domain."""
    form = url.rlike("(?i)^https?://[^/?#@\\s:]+(:[0-9]+)?([/?#][^\\s]*)?$") | url.rlike("(?i)^mailto:[^@\\s]+@[^@\\s]+\\.[^@\\s]+$")
    return F.coalesce((F.length(url) <= 2048) & url.rlike("^[\\x21-\\x7E]+$") & form, F.lit(False))


def url_quality(pages: DataFrame) -> DataFrame:
    """(host, pages, good) by host."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1))
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.count_if(url_ok(F.col("url"))).alias("good"))


def notes_limits(rows: DataFrame, words: int = 1500, most: int = 8) -> DataFrame:
    """(owner, id, reason) of notes (owner, id, text, link): too long, more than ``most`` of the owner, or a bad link, in this order."""
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != ""))
    reason = F.when(F.col("n") > words, "NOTES_TOO_LONG").when(F.col("nth") > most, "TOO_MANY").when(F.col("link").isNotNull() & ~url_ok(F.col("link")), "BAD_LINK")
    slim = written(rows.select("owner", "id", n.alias("n"), "link"), "notes")
    return running(slim, ["owner"], [F.col("id")], F.lit(1), "nth").select("owner", "id", reason.alias("reason"))
