"""Constrained selection: slots, positions, alternatives, coverage. All owners advance together; scores are integers (bp).

Every choice has a total order, so results do not depend on partitions. Searches over combinations are pruned without loss:
with r things to choose, only the best r (and the forced one) of each can matter.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.durable import written

#: Positions in one assignment: the combinations after pruning are at most POSITIONS ** POSITIONS an owner.
POSITIONS = 6
#: Parts of an owner's options, for each that is asked for, whose greatest totals bound the totals that count.
PARTS = 8


def rank_candidates(scores: DataFrame) -> DataFrame:
    """Adds ``r``: the place of (owner_id, cand_id, length, bp) by falling score, then id, within owner and length."""
    return scores.withColumn("r", F.row_number().over(W.partitionBy("owner_id", "length").orderBy(F.col("bp").desc(), "cand_id")))


def fill_slots(slots: DataFrame, cands: DataFrame) -> DataFrame:
    """(owner_id, slot_idx, cand_id): each slot (owner_id, slot_idx, length) takes the best free candidate of its length.

    Slots go by length, then index; a candidate (owner_id, cand_id, length, grp, bp) is free while nothing of its group is
    taken. A slot without one keeps null. A round fills the k-th slot of all owners.
    """
    order = F.row_number().over(W.partitionBy("owner_id").orderBy("length", "slot_idx"))
    ranked = written(slots.withColumn("k", order), "slots")
    cands = written(_pool(cands), "pool")
    most = ranked.agg(F.max("k")).first()[0] or 0
    taken = None
    for k in range(1, most + 1):
        free = ranked.where(F.col("k") == k).join(cands, ["owner_id", "length"])
        if taken is not None:
            free = free.join(taken.select("owner_id", "grp").distinct(), ["owner_id", "grp"], "left_anti")
        best = free.groupBy("owner_id", "slot_idx").agg(F.min(F.struct(-F.col("bp"), "cand_id", "grp")).alias("b")).select("owner_id", "slot_idx", "b.cand_id", "b.grp")
        taken = written(best if taken is None else taken.unionByName(best), "taken")
    if taken is None:
        return slots.select("owner_id", "slot_idx", F.lit(None).cast(cands.schema["cand_id"].dataType).alias("cand_id"))
    return slots.select("owner_id", "slot_idx").join(taken.drop("grp"), ["owner_id", "slot_idx"], "left")


def _pool(cands: DataFrame) -> DataFrame:
    """Of the candidates of one owner, length and group only the best: no other can be taken while it is free, nor once its group is."""
    best = cands.groupBy("owner_id", "length", "grp").agg(F.min(F.struct((-F.col("bp")).alias("lost"), "cand_id")).alias("b"))
    return best.select("owner_id", "b.cand_id", "length", "grp", (-F.col("b.lost")).alias("bp"))


def place_items(scores: DataFrame, slots: DataFrame) -> DataFrame:
    """(project, position, items, total, mean): distinct items for a position's slots with the greatest total score.

    ``scores``: (project, item, length, bp), ``slots``: (position, slot_idx, length), a small table of shapes. Ties go to the
    smallest tuple of items. Projects that cannot fill a position are absent. mean is total / slots, rounded to whole bp.
    """
    shapes = slots.groupBy("position").agg(F.count("*").alias("r"))
    counts = sorted(row["r"] for row in shapes.select("r").distinct().collect())  # the different numbers of slots
    out = []
    for r in counts:
        if r > POSITIONS:
            raise ValueError(f"a position has more than {POSITIONS} slots")
        nth = F.row_number().over(W.partitionBy("position").orderBy("slot_idx"))
        here = slots.join(shapes.where(F.col("r") == r), "position").withColumn("n", nth)
        options = scores.join(F.broadcast(here), "length")
        best = F.row_number().over(W.partitionBy("project", "position", "n").orderBy(F.col("bp").desc(), "item"))
        kept = options.withColumn("k", best).where(F.col("k") <= r).select("project", "position", "n", "item", "bp")
        chain = kept.where("n = 1").select("project", "position", F.array("item").alias("items"), F.col("bp").alias("total"))
        for n in range(2, r + 1):
            more = kept.where(F.col("n") == n).drop("n")
            chain = chain.join(more, ["project", "position"]).where(~F.array_contains("items", F.col("item")))
            chain = chain.select("project", "position", F.concat("items", F.array("item")).alias("items"), (F.col("total") + F.col("bp")).alias("total"))
        top = chain.groupBy("project", "position").agg(F.min(F.struct((-F.col("total")).alias("t"), F.col("items"))).alias("b"))
        out.append(top.select("project", "position", "b.items", (-F.col("b.t")).alias("total"), F.round(-F.col("b.t") / r).cast("long").alias("mean")))
    return reduce(DataFrame.unionByName, out)


def project_score(placements: DataFrame, positions: DataFrame, homes: DataFrame, detail: DataFrame) -> DataFrame:
    """(project, position, bp): null where the project's home section is another; else mean plus 0.3 of the detail's coverage where shown.

    ``positions``: (position, section, shows_detail), ``homes``: (project, section), ``detail``: (project, detail_bp).
    """
    rows = placements.join(F.broadcast(positions), "position").join(homes.withColumnRenamed("section", "home"), "project").join(detail, "project", "left")
    shown = F.when(F.col("shows_detail"), F.round(F.coalesce("detail_bp", F.lit(0)) * 3 / 10).cast("long")).otherwise(F.lit(0).cast("long"))
    return rows.select("project", "position", F.when(F.col("home") == F.col("section"), F.col("mean") + shown).alias("bp"))


def assign_projects(scores: DataFrame, positions: int, excluded: DataFrame | None = None, reused: DataFrame | None = None, forced: DataFrame | None = None) -> DataFrame:
    """(owner_id, [forced,] projects, scores): each position 1..positions gets one project, each project at most once.

    Maximises the score of position 1, then of 2, and so on; ties go to the smallest tuple of ids. ``scores``: (owner_id,
    position, project, bp), null bp is infeasible. ``excluded``: (owner_id, position, project) pairs left out. ``reused``:
    (owner_id, project), whose scores count half. ``forced``: (owner_id, forced), one result for each forced project, which must be used.
    Owners without a full assignment are absent.
    """
    if positions > POSITIONS:
        raise ValueError(f"more than {POSITIONS} positions")
    usable = scores.where("bp is not null")
    if excluded is not None:
        usable = usable.join(excluded, ["owner_id", "position", "project"], "left_anti")
    if reused is not None:
        usable = usable.join(reused.select("owner_id", "project", F.lit(True).alias("old")).distinct(), ["owner_id", "project"], "left")
        usable = usable.withColumn("bp", F.when(F.col("old"), F.floor(F.col("bp") / 2)).otherwise(F.col("bp"))).drop("old")
    kept = written(_best(usable, positions), "kept")
    if forced is not None:
        asked = forced.select("owner_id", F.col("forced").alias("project")).distinct()
        own = _by_project(usable.join(asked, ["owner_id", "project"], "left_semi"), positions)
        return _forced(own, written(_owners(kept, positions), "owners"), kept, positions)
    top = _chain(kept, ["owner_id"], range(1, positions + 1)).groupBy("owner_id").agg(F.min(F.struct("lost", "projects")).alias("b"))
    return top.select("owner_id", "b.projects", _gained("b.lost"))


def _gained(lost: str) -> Column:
    return F.transform(lost, lambda x: -x).alias("scores")


def _best(scores: DataFrame, most: int) -> DataFrame:
    """(owner_id, position, project, bp): the first ``most`` projects of each position that have a score."""
    rank = F.row_number().over(W.partitionBy("owner_id", "position").orderBy(F.col("bp").desc(), "project"))
    return scores.where("bp is not null").select("owner_id", "position", "project", "bp").withColumn("k", rank).where(F.col("k") <= most).drop("k")


def _by_project(scores: DataFrame, positions: int) -> DataFrame:
    """(owner_id, forced, b1, b2...): the scores of each project at all positions."""
    at = [F.max(F.when(F.col("position") == p, F.col("bp"))).alias(f"b{p}") for p in range(1, positions + 1)]
    return scores.groupBy("owner_id", F.col("project").alias("forced")).agg(*at)


def _chain(kept: DataFrame, keys: list[str], places: Iterable[int]) -> DataFrame:
    """(keys, projects, lost): all ways to give each of ``places`` a project of ``kept``, none twice."""
    kinds = kept.schema["project"].dataType.simpleString(), kept.schema["bp"].dataType.simpleString()
    chain = kept.select(*keys).distinct().select(*keys, F.array().cast(f"array<{kinds[0]}>").alias("projects"), F.array().cast(f"array<{kinds[1]}>").alias("lost"))
    for n, p in enumerate(places):
        here = kept.where(F.col("position") == p).select(*keys, "project", "bp")
        if n == 0:
            chain = here.select(*keys, F.array("project").alias("projects"), F.array(-F.col("bp")).alias("lost"))
        else:
            chain = chain.join(here, keys).where(~F.array_contains("projects", F.col("project")))
            chain = chain.select(*keys, F.concat("projects", F.array("project")).alias("projects"), F.concat("lost", F.array(-F.col("bp"))).alias("lost"))
    return chain


def _owners(kept: DataFrame, positions: int) -> DataFrame:
    """(owner_id, inside, h1, h2...): an owner's projects in ``kept``, and the best way to fill all positions but one."""
    out = kept.groupBy("owner_id").agg(F.collect_set("project").alias("inside"))  # at most positions ** 2
    for p in range(1, positions + 1):
        rest = _chain(kept, ["owner_id"], [q for q in range(1, positions + 1) if q != p])
        out = out.join(rest.groupBy("owner_id").agg(F.min(F.struct("lost", "projects")).alias(f"h{p}")), "owner_id", "left")
    return out


def _put(positions: int) -> Column:
    """The best (lost, projects) with ``forced`` at one position and the best way to fill the others; null if there is none."""
    places = [(p, F.col(f"h{p}"), F.col(f"b{p}")) for p in range(1, positions + 1)]
    return F.array_min(F.array(*[
        F.when(h.isNotNull() & b.isNotNull(), F.struct(F.array_insert(h["lost"], p, -b).alias("lost"), F.array_insert(h["projects"], p, F.col("forced")).alias("projects"))) for p, h, b in places
    ]))


def _outside(own: DataFrame, owners: DataFrame, positions: int) -> DataFrame:
    """(owner_id, forced, b1..., projects, scores) of forced projects that are not among the owner's best: what else is taken does not depend on them."""
    rows = own.join(owners.hint("shuffle_hash"), "owner_id").where(~F.array_contains("inside", F.col("forced"))).withColumn("b", _put(positions)).where("b is not null")
    return rows.select(*own.columns, "b.projects", _gained("b.lost"))


def _inside(own: DataFrame, owners: DataFrame, kept: DataFrame, positions: int) -> DataFrame:
    """(owner_id, forced, projects, scores) of forced projects that are among the owner's best, of which there are few."""
    rows = written(own.join(owners.select("owner_id", "inside").hint("shuffle_hash"), "owner_id").where(F.array_contains("inside", F.col("forced"))).drop("inside"), "inside")
    at = F.explode(F.array(*[F.struct(F.lit(p).alias("position"), F.col(f"b{p}").alias("bp")) for p in range(1, positions + 1)])).alias("s")
    more = rows.select("owner_id", "forced", F.col("forced").alias("project"), at).select("owner_id", "forced", "s.position", "project", "s.bp").where("bp is not null")
    every = written(kept.join(rows.select("owner_id", "forced"), "owner_id").select(*more.columns).unionByName(more).distinct(), "options")
    chain = _chain(every, ["owner_id", "forced"], range(1, positions + 1)).where(F.array_contains("projects", F.col("forced")))
    return chain.groupBy("owner_id", "forced").agg(F.min(F.struct("lost", "projects")).alias("b")).select("owner_id", "forced", "b.projects", _gained("b.lost"))


def _forced(own: DataFrame, owners: DataFrame, kept: DataFrame, positions: int) -> DataFrame:
    return _outside(own, owners, positions).select("owner_id", "forced", "projects", "scores").unionByName(_inside(own, owners, kept, positions))


def total_score(selection: DataFrame, key: str, bp: str = "bp") -> DataFrame:
    """(key, total): summed scores of slots and positions."""
    return selection.groupBy(key).agg(F.coalesce(F.sum(bp), F.lit(0)).alias("total"))


def group_options(slots: DataFrame, cands: DataFrame, filled: DataFrame) -> DataFrame:
    """(owner_id, label, slot_idx, cand_id, gain): each group that no slot of its owner has taken, in the slot where it adds most.

    ``slots`` and ``cands`` as in ``fill_slots``, ``filled`` its result. gain is the candidate's score less that of the one it
    replaces (nothing: 0). Ties go to the smaller slot, then the smaller candidate. Candidates without a group are no options.
    """
    own = written(_taken(cands, filled), "taken")
    used = own.where("grp is not null").select("owner_id", "grp").distinct()
    free = _pool(cands.where("grp is not null")).join(used, ["owner_id", "grp"], "left_anti").join(_places(slots, own, filled), ["owner_id", "length"])
    best = F.min(F.struct((F.col("usual") - F.col("bp")).alias("loss"), "slot_idx", "cand_id")).alias("b")
    label = F.concat(F.lit("includes achievement "), F.col("grp").cast("string"))
    return free.groupBy("owner_id", "grp").agg(best).select("owner_id", label.alias("label"), "b.slot_idx", "b.cand_id", (-F.col("b.loss")).alias("gain"))


def _taken(cands: DataFrame, filled: DataFrame) -> DataFrame:
    """The rows of the candidates that fill slots; a few an owner."""
    return cands.join(filled.select("owner_id", "cand_id").distinct(), ["owner_id", "cand_id"], "left_semi")


def _places(slots: DataFrame, own: DataFrame, filled: DataFrame) -> DataFrame:
    """(owner_id, slot_idx, length, usual): the slots with the score of what fills them, 0 if nothing does; ``own`` as from ``_taken``."""
    scored = own.groupBy("owner_id", "cand_id", "length").agg(F.max("bp").alias("usual"))
    rows = slots.join(filled, ["owner_id", "slot_idx"], "left").join(scored, ["owner_id", "cand_id", "length"], "left")
    return rows.select("owner_id", "slot_idx", "length", F.coalesce("usual", F.lit(0)).alias("usual"))


def alternatives(scores: DataFrame, positions: int, best: DataFrame, n: int = 2, job: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """(owner_id, label, projects, slot_idx, cand_id, total, r): the n best results that bring in a project or group the best one leaves out.

    ``job``: (slots, cands, filled) as in ``group_options``, whose scores then count in the totals too; without it only projects
    are options. A group's option keeps the projects and puts cand_id into slot_idx; a project's keeps the slots (both null).
    """
    best = written(best, "best")
    kept = written(_best(scores, positions), "kept")
    owners = written(_owners(kept, positions).join(best.select("owner_id", F.col("projects").alias("usual")), "owner_id"), "owners")
    total = F.aggregate("scores", F.lit(0).cast("long"), lambda a, x: a + x)
    own = _by_project(scores.where("bp is not null"), positions).join(owners.select("owner_id", "usual").hint("shuffle_hash"), "owner_id").where(~F.array_contains("usual", F.col("forced"))).drop("usual")
    outside = _outside(own, owners, positions).select("owner_id", "forced", "projects", total.alias("total"))
    least = written(_least(outside.select("owner_id", "forced", "total"), n), "least")
    first = outside.join(least.hint("shuffle_hash"), "owner_id", "left").where(F.col("least").isNull() | (F.col("total") >= F.col("least"))).drop("least")
    found = written(first.unionByName(_inside(own, owners, kept, positions).select("owner_id", "forced", "projects", total.alias("total"))), "found")
    both = found.join(best.select("owner_id", F.col("projects").alias("usual")), "owner_id")
    gone = F.array_join(F.array_sort(F.array_except("usual", "projects")), ", ")
    label = F.concat(F.lit("includes "), F.col("forced").cast("string"), F.lit(" instead of "), gone)
    options = both.select("owner_id", label.alias("label"), "projects", "total")
    if job is None:
        options = options.select("owner_id", "label", "projects", F.lit(None).cast("int").alias("slot_idx"), F.lit(None).cast("string").alias("cand_id"), "total")
    else:
        slots, cands, filled = job
        filled = written(filled, "filled")
        none = [F.lit(None).cast(df.schema[c].dataType).alias(c) for df, c in ((slots, "slot_idx"), (cands, "cand_id"))]
        options = options.select("owner_id", "label", "projects", *none, "total")
        groups = group_options(slots, cands, filled).join(best.select("owner_id", "projects", total.alias("total")), "owner_id")
        options = options.unionByName(groups.select("owner_id", "label", "projects", "slot_idx", "cand_id", (F.col("total") + F.col("gain")).alias("total")))
        usual = total_score(_places(slots, _taken(cands, filled), filled), "owner_id", "usual").withColumnRenamed("total", "slots_total")
        options = options.join(usual, "owner_id", "left").withColumn("total", F.col("total") + F.coalesce("slots_total", F.lit(0))).drop("slots_total")
    rank = F.row_number().over(W.partitionBy("owner_id").orderBy(F.col("total").desc(), "label"))
    return options.withColumn("r", rank).where(F.col("r") <= n)


def _least(rows: DataFrame, n: int) -> DataFrame:
    """(owner_id, least): what at least n of the owner's rows (owner_id, forced, total) have as total, by the greatest of parts; owners of few rows are absent."""
    parts = rows.groupBy("owner_id", F.pmod(F.xxhash64("forced"), F.lit(PARTS * n)).alias("part")).agg(F.max("total").alias("least"))
    rank = F.row_number().over(W.partitionBy("owner_id").orderBy(F.col("least").desc()))
    return parts.withColumn("k", rank).where(F.col("k") == n).select("owner_id", "least")


def infeasibility(projects: DataFrame, items: DataFrame, positions: DataFrame, slots: DataFrame) -> DataFrame:
    """(project, position, reason) of every project (project, section) and position (position, section); null where it fits.

    The first of: ``section``, ``too few items``, ``no item at length n``, ``not together``. ``items``: (project, item, length).
    Positions and shapes are small tables.
    """
    have = items.groupBy("project").agg(F.count_distinct("item").alias("items"), F.collect_set("length").alias("lengths"), F.collect_set(F.struct("item", "length")).alias("pairs"))
    need = slots.groupBy("position").agg(F.count("*").alias("slots"), F.array_sort(F.collect_set("length")).alias("asked"), F.collect_list("length").alias("all_"))
    rows = projects.withColumnRenamed("section", "home").crossJoin(F.broadcast(positions.join(need, "position"))).join(have, "project", "left")  # a few positions
    none = F.array().cast("array<int>")
    lacking = F.get(F.array_sort(F.array_except("asked", F.coalesce("lengths", none))), F.lit(0))
    reason = (
        F.when(F.col("home") != F.col("section"), "section").when(F.coalesce("items", F.lit(0)) < F.col("slots"), "too few items")
        .when(lacking.isNotNull(), F.concat(F.lit("no item at length "), lacking.cast("string"))).when(~hall("asked", "all_", "pairs"), "not together")
    )
    return rows.select("project", "position", reason.alias("reason"))


def hall(asked: str, slots: str, pairs: str) -> Column:
    """Whether distinct items can fill the slots: for every set of asked lengths, items with one of them are at least the slots asking for them.

    ``asked`` holds at most three different lengths; more are an error.
    """
    sets = F.filter(
        F.array(*[F.transform(F.filter(F.array(*[F.struct(F.get(asked, F.lit(i)).alias("v"), F.lit(bool(m >> i & 1)).alias("on")) for i in range(3)]), lambda x: x["on"] & x["v"].isNotNull()), lambda x: x["v"]) for m in range(1, 8)]),
        lambda s: F.size(s) > 0,
    )
    enough = lambda s: F.size(F.array_distinct(F.transform(F.filter(F.col(pairs), lambda p: F.array_contains(s, p["length"])), lambda p: p["item"]))) >= F.size(F.filter(F.col(slots), lambda n: F.array_contains(s, n)))
    return F.when(F.size(asked) > 3, F.raise_error(F.lit("a shape has more than three lengths")).cast("boolean")).otherwise(F.forall(sets, enough))


def feasibility(checked: DataFrame) -> DataFrame:
    """(project, positions): where each project fits."""
    return checked.where("reason is null").groupBy("project").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def coverage(items: DataFrame, slots: DataFrame) -> DataFrame:
    """(project, covered, missing): whether distinct items fill at least one shape, and lengths asked for that no item has."""
    have = items.groupBy("project").agg(F.collect_set("length").alias("lengths"), F.collect_set(F.struct("item", "length")).alias("pairs"))
    shapes = slots.groupBy("position").agg(F.array_sort(F.collect_set("length")).alias("asked"), F.collect_list("length").alias("all_"))
    rows = have.crossJoin(F.broadcast(shapes))  # shapes: a small table
    lacking = F.array_except("asked", "lengths")
    return rows.groupBy("project").agg(F.bool_or(hall("asked", "all_", "pairs")).alias("covered"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(lacking)))).alias("missing"))


def resolve_with_rejections(scores: DataFrame, positions: int, rejected: DataFrame, rounds: int = 3) -> DataFrame:
    """(owner_id, projects, degraded): assign, drop pairs that are rejected, assign again, at most ``rounds`` times more.

    ``rejected``: (owner_id, position, project). A pair still rejected after that leaves its position as it was: it is listed.
    """
    scores = written(_best(scores, positions + rounds), "scores")  # a round leaves out one project of a position at most
    pairs = rejected.join(scores.select("owner_id", "position", "project"), ["owner_id", "position", "project"], "left_semi")
    pairs = written(pairs.select("owner_id", "position", "project").distinct(), "pairs")
    out_now, known = None, None
    for _ in range(rounds + 1):
        got = written(assign_projects(scores, positions, excluded=known), "assigned")
        flat = got.select("owner_id", F.posexplode("projects").alias("position", "project")).withColumn("position", F.col("position") + 1)
        hit = written(flat.join(pairs, ["owner_id", "position", "project"], "left_semi"), "rejected")
        out_now = got
        if hit.isEmpty():
            break
        known = written(hit.select("owner_id", "position", "project") if known is None else known.unionByName(hit.select("owner_id", "position", "project")), "known")
    bad = hit.groupBy("owner_id").agg(F.array_sort(F.collect_list("position")).alias("degraded"))
    return out_now.select("owner_id", "projects").join(bad, "owner_id", "left").withColumn("degraded", F.coalesce("degraded", F.array().cast("array<int>")))


def targets(slots: DataFrame, wide: bool = True) -> DataFrame:
    """(grp, length, wanted, budget): lengths of a group's slots, candidates to ask for, and the median budget of a length.

    ``slots``: (grp, length, budget). ``wanted`` is max(4, 2n) for n slots, or n where not ``wide``.
    """
    n = F.count("*").over(W.partitionBy("grp"))
    wanted = F.greatest(F.lit(4), 2 * F.col("n")) if wide else F.col("n")
    middle = F.floor(F.percentile("budget", 0.5) + 0.5).cast("long")
    return slots.withColumn("n", n).groupBy("grp", "n", "length").agg(middle.alias("budget")).select("grp", "length", wanted.alias("wanted"), "budget")


def eligible_length(cands: DataFrame, needed: DataFrame, existing_only: bool = False) -> DataFrame:
    """Candidates (owner_id, cand_id, length, own_length) of a needed length (owner_id, length); not above their own where only existing ones count."""
    kept = cands.join(needed.select("owner_id", "length").distinct(), ["owner_id", "length"], "left_semi")
    return kept.where(F.col("length") <= F.coalesce("own_length", F.col("length"))) if existing_only else kept


def round_robin(items: DataFrame, slots: DataFrame) -> DataFrame:
    """(owner_id, item, slot_idx): the nth item of a length goes to slot n mod the number of slots of that length."""
    by = W.partitionBy("owner_id", "length")
    nth = items.withColumn("n", F.row_number().over(by.orderBy("item")) - 1)
    placed = slots.withColumn("s", F.row_number().over(by.orderBy("slot_idx")) - 1).withColumn("all_", F.count("*").over(by))
    sizes = placed.select("owner_id", "length", "all_").distinct()
    return nth.join(sizes, ["owner_id", "length"]).withColumn("s", F.pmod("n", "all_")).join(placed.drop("all_"), ["owner_id", "length", "s"]).select("owner_id", "item", "slot_idx")


def batch_summary(postings: DataFrame, *parts: DataFrame) -> DataFrame:
    """One row for every posting (doc_id), the failed ones too, with what the parts (doc_id, ...) say of it."""
    return reduce(lambda acc, p: acc.join(p, "doc_id", "left"), parts, postings.select("doc_id"))


def home_section(sections: DataFrame) -> DataFrame:
    """(owner_id, home): the first section, in order, named "project" with a usable position; else the one with most, first on a tie; else null.

    ``sections``: (owner_id, section, ord, name, positions).
    """
    usable = F.col("positions") > 0
    named = F.min_by("section", F.when(usable & F.contains(F.lower("name"), F.lit("project")), F.col("ord")))
    most = F.min_by("section", F.when(usable, F.struct((-F.col("positions")).alias("n"), F.col("ord"))))
    return sections.groupBy("owner_id").agg(F.coalesce(named, most).alias("home"))
