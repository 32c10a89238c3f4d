"""Checks of written texts against their sources: format, numbers, terms, grounding, consistency, copies, and reports on them.

Texts are rows (keys..., text); their sources are rows (keys..., text). A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.durable import remove, written
from lodestone.functions.text import ascii_borders, numbers, stems, tokens
from lodestone.operators.dedup import class_leaders, similar_lists
from lodestone.operators.similarity import grounding
from lodestone.operators.terms import implied_terms, match_terms

GROUNDED = 0.40
# Patterns of addresses and of the first person.
URL = "(?i)https?://|www\\.|\\b[\\w.+-]+@[\\w-]+\\.\\w|\\b[\\w-]+\\.(?:com|io|dev|org|net|ai|app|co|me|xyz)\\b(?:/\\S*)?"
FIRST_PERSON = "(?<![\\w'])(I|me|my|mine|we|our|ours|us)(?![\\w'])"


def format_reasons(text: Column, budget: Column | None = None) -> Column:
    """Array of EMPTY alone, or of MULTILINE, URL, FIRST_PERSON, OVER_BUDGET in this order."""
    raw = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(raw, "^\\s+|\\s+$", "")
    over = F.length(t) > budget if budget is not None else F.lit(False)
    rules = [(raw.rlike("[\\r\\n]"), "MULTILINE"), (t.rlike(ascii_borders(URL)), "URL"), (t.rlike(FIRST_PERSON), "FIRST_PERSON"), (over, "OVER_BUDGET")]
    return F.when(t == "", F.array(F.lit("EMPTY"))).otherwise(F.array_compact(F.array(*[F.when(c, r) for c, r in rules])))


def unsupported_numbers(variants: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value, version): numbers that a text's sources do not hold."""
    rows = lambda t: t.select(*keys, F.explode(numbers(F.col("text"))).alias("n")).select(*keys, "n.value", "n.version").distinct()
    a, b = rows(variants).alias("a"), rows(sources).alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "value", "version")]
    return a.join(b, same, "left_anti")


def unsupported_terms(variants: DataFrame, sources: DataFrame, terms: DataFrame, closure: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, canonical): terms that the sources neither name nor imply; implication never widens the text."""
    known = implied_terms(match_terms(sources, terms, keys), closure, keys)
    return match_terms(variants, terms, keys).join(known, [*keys, "canonical"], "left_anti")


def ungrounded(variants: DataFrame, sources: DataFrame, keys: list[str], least: float = GROUNDED) -> DataFrame:
    """(keys) of the texts whose share of grounded stems is under ``least``; a text without stems is grounded."""
    rows = lambda t: t.select(*keys, F.explode(stems(F.col("text"))).alias("stem"))
    return grounding(rows(variants), rows(sources), keys).where(F.col("grounded") < least * F.col("words")).select(*keys)


def guard(variants: DataFrame, sources: DataFrame, terms: DataFrame, closure: DataFrame, keys: list[str], budget: str | None = None) -> DataFrame:
    """(keys, reasons): every text with its reasons in a fixed order; an empty one has only EMPTY, a clean one none."""
    form = variants.select(*keys, format_reasons(F.col("text"), F.col(budget) if budget else None).alias("form"))
    whole = F.col("value") == F.floor("value")
    shown = F.coalesce("version", F.when(whole, F.col("value").cast("long").cast("string")).otherwise(F.col("value").cast("string")))
    order = F.coalesce("version", F.when(whole, F.concat(F.col("value").cast("long").cast("string"), F.lit(".0"))).otherwise(F.col("value").cast("string")))
    more = (
        unsupported_numbers(variants, sources, keys).select(*keys, F.lit(1).alias("_k"), order.alias("_o"), F.concat(F.lit("UNSUPPORTED_NUMBER:"), shown).alias("reason"))
        .unionByName(unsupported_terms(variants, sources, terms, closure, keys).select(*keys, F.lit(2).alias("_k"), F.col("canonical").alias("_o"), F.concat(F.lit("UNSUPPORTED_TECH:"), "canonical").alias("reason")))
        .unionByName(ungrounded(variants, sources, keys).select(*keys, F.lit(3).alias("_k"), F.lit("").alias("_o"), F.lit("UNGROUNDED").alias("reason")))
    )
    listed = more.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_o", "reason"))), lambda x: x["reason"]).alias("more"))
    none = F.array().cast("array<string>")
    out = form.join(listed, keys, "left")
    return out.select(*keys, F.when(F.array_contains("form", "EMPTY"), F.col("form")).otherwise(F.concat("form", F.coalesce("more", none))).alias("reasons"))


def sibling_consistency(variants: DataFrame) -> DataFrame:
    """The texts (owner_id, cand_id, length, text) without those whose kept shorter sibling is not grounded in them.

    Pairs go by ascending lengths. A pair is skipped once either side is gone. At most three lengths of a candidate count;
    more are refused.
    """
    ids = ["owner_id", "cand_id"]
    if variants.groupBy(*ids).count().where("count > 3").limit(1).count():
        raise ValueError("a candidate has more than three lengths")
    small, large = variants.select(*ids, F.col("length").alias("s"), "text"), variants.select(*ids, F.col("length").alias("l"), "text")
    pairs = small.join(large.drop("text"), ids).where("s < l")
    rows = pairs.select(*ids, "s", "l", F.explode(stems(F.col("text"))).alias("stem"))
    sources = small.drop("text").join(large, ids).where("s < l").select(*ids, "s", "l", F.explode(stems(F.col("text"))).alias("stem"))
    bad = grounding(rows, sources, [*ids, "s", "l"]).where(F.col("grounded") < GROUNDED * F.col("words"))
    order = F.array_sort(F.collect_set("length"))
    lengths = variants.groupBy(*ids).agg(order.alias("x"))
    verdicts = bad.groupBy(*ids).agg(F.collect_set(F.struct("s", "l")).alias("bad"))
    both = lengths.join(verdicts, ids)
    at = lambda i: F.get("x", F.lit(i))
    hit = lambda i, j: F.coalesce(F.array_contains("bad", F.struct(at(i).alias("s"), at(j).alias("l"))), F.lit(False))
    second = hit(0, 1)
    third = hit(0, 2) | (~second & hit(1, 2))
    dropped = both.select(*ids, F.explode(F.array_compact(F.array(F.when(second, at(1)), F.when(third, at(2))))).alias("length"))
    return variants.join(dropped, [*ids, "length"], "left_anti")


def drop_duplicates_in_order(cands: DataFrame, percent: int = 80) -> DataFrame:
    """(owner_id, cand_id, pos, dropped) of candidates (owner_id, cand_id, pos, length, text).

    One is dropped if it shares a length with an earlier kept one of its owner whose token Jaccard similarity is at least
    ``percent``. Texts of one owner and length with equal token sets are a class, which costs a row a text and no pair; classes are
    paired by their rarest tokens, of which a similar one must hold one. Texts are cut into tokens once, and these are kept as hashes
    that hold the owner and the length.
    """
    t = tokens(F.col("text"))
    made = cands.select("owner_id", "pos", "length", F.array_sort(t).alias("x")).withColumn("cls", F.md5(F.to_json(F.struct("owner_id", "length", F.col("x").alias("t")))))
    hashed = F.transform("x", lambda y: F.xxhash64("owner_id", "length", y))
    made = written(made.select("owner_id", "pos", F.size("x").alias("n"), "cls", hashed.alias("t"), F.monotonically_increasing_id().alias("id")), "hashed")
    texts = written(made.select("owner_id", "pos", "n", "cls"), "texts")
    kinds = written(made.where("n > 0").groupBy("cls").agg(F.min("id").alias("id")), "kinds")
    lists = written(made.join(kinds.select("id"), "id", "left_semi").select(F.col("id").alias("doc_id"), "t", F.array_repeat(F.lit(1).cast("long"), F.col("n")).alias("w")), "sets")
    remove(made)
    near = similar_lists(lists, percent)
    named = near.join(kinds.select(F.col("id").alias("a"), F.col("cls").alias("x")), "a").join(kinds.select(F.col("id").alias("b"), F.col("cls").alias("y")), "b")
    like = written(named.select(F.col("x").alias("a"), F.col("y").alias("b")), "like")
    remove(lists)
    nodes = written(cands.select("owner_id", "cand_id", "pos").distinct(), "candidates")
    alone = F.when(F.col("n") > 0, F.col("cls")).otherwise(F.concat("cls", F.lit(":"), F.col("pos").cast("string")))  # texts without tokens are like nothing
    kept = class_leaders(texts.select("owner_id", F.col("pos").alias("node"), alone.alias("cls")), like, "owner_id")
    return nodes.join(kept.select("owner_id", F.col("node").alias("pos"), "leads"), ["owner_id", "pos"]).select("owner_id", "cand_id", "pos", (~F.col("leads")).alias("dropped"))


def gate_report(results: DataFrame, group: str) -> DataFrame:
    """(group, reason, candidates): candidates by the first reason of their lowest length, PASSED if any length is clean.

    ``results``: (group, cand_id, length, reasons); a candidate without lengths (null) is NO_VALID_LENGTH. With totals by rollup.
    """
    first = F.coalesce(F.get("reasons", F.lit(0)), F.lit("PASSED"))
    one = results.groupBy(group, "cand_id").agg(
        F.when(F.count("length") == 0, "NO_VALID_LENGTH").when(F.bool_or(first == "PASSED"), "PASSED").otherwise(F.min_by(first, "length")).alias("reason")
    )
    return one.rollup(group, "reason").agg(F.count("*").alias("candidates"))


def gate_vs_labels(results: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: how verdicts (id, passed) meet human labels (id, good)."""
    both = results.join(labels, "id")
    hit = F.count_if(F.col("passed") & F.col("good"))
    return both.agg(
        F.count("*").alias("n"), hit.alias("both"), F.count_if("passed").alias("passed"), F.count_if("good").alias("good"),
        F.round(hit / F.count_if("passed"), 6).alias("precision"), F.round(hit / F.count_if("good"), 6).alias("recall"),
    )
