"""Near-duplicate postings, leaders and groups, reuse decisions, aliases, and matching of titles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.durable import remove, written
from lodestone.operators.ranges import running

HIT10, BAND10 = 9, 8
BAND_SIMILARITY = 0.95
#: Words of 64 bits in the sketch of a set, and the block of rows that are compared at once with as many others.
SKETCH = 6
BLOCK, WIDE = 256, 4096
#: Sets of one side that a task holds at once where pairs are compared term by term.
CELL = 2048
#: Pairs that leave such a comparison at once.
PAIRS = 1 << 16
#: Terms of sets, or pairs of rows, that a task has in arrays at once.
HELD = 1 << 20
#: Terms whose counts are sent to all tasks, at most.
COMMON = 1_000_000
#: Terms of a set that its rows carry, by which a pair is seen to have met at an earlier one.
FIRST = 4


def posting_classes(weights: DataFrame, postings: DataFrame) -> DataFrame:
    """(doc_id, cls): the smallest id of the postings with the same weighted terms; those without terms are one class.

    Sets are compared by 128-bit fingerprints, so a class of any size is one row a posting and no pair.
    """
    return _classes(weights.select("doc_id", F.col("term").alias("x"), "w10"), postings)


def text_classes(counts: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_id, cls): the smallest id of the postings of one class with the same stem counts (doc_id, stem, n)."""
    own = classes.select("doc_id", F.col("cls").cast("string").alias("x"), F.lit(-1).cast("long").alias("n"))
    return _classes(counts.select("doc_id", F.col("stem").alias("x"), "n").unionByName(own), classes)


def _classes(rows: DataFrame, postings: DataFrame) -> DataFrame:
    own = [c for c in rows.columns if c != "doc_id"]  # a row each once
    sides = [F.bit_xor(F.xxhash64(*own, F.lit(seed))).cast("string") for seed in (17, 71)]
    prints = rows.groupBy("doc_id").agg(F.concat_ws(" ", *sides, F.count("*").cast("string")).alias("print"))
    marked = written(postings.select("doc_id").distinct().join(prints, "doc_id", "left").fillna(""), "prints")
    first = marked.groupBy("print").agg(F.min("doc_id").alias("cls"))
    return written(marked.join(first, "print").select("doc_id", "cls"), "classes")


def similar_postings(weights: DataFrame, classes: DataFrame, tenths: int = BAND10, keyed: bool = False) -> DataFrame:
    """(a, b, low, high), a < b: classes of postings whose weighted Jaccard similarity low / high is at least tenths / 10.

    A class goes by its smallest id; its members are alike and make no rows here. ``keyed`` as in ``similar_sets``.
    """
    own = weights.join(classes.where("doc_id = cls").select("doc_id"), "doc_id", "left_semi")
    return similar_sets(own, tenths * 10, keyed=keyed)


def class_members(weights: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, low, high): each member b of a class but the first, a, with their common weight; 0 where they have no terms."""
    total = weights.groupBy("doc_id").agg(F.sum("w10").cast("long").alias("t"))
    low = F.coalesce("t", F.lit(0).cast("long"))
    return classes.where("doc_id <> cls").join(total, "doc_id", "left").select(F.col("cls").alias("a"), F.col("doc_id").alias("b"), low.alias("low"), low.alias("high"))


def similar_sets(sets: DataFrame, percent: int, group: tuple[str, ...] = (), keyed: bool = False) -> DataFrame:
    """(a, b, low, high), a < b: sets of one group whose weighted Jaccard similarity low / high is at least ``percent``.

    ``sets``: (doc_id, *group, term, w10), a term once in a set, weights of at least 1. Terms go by 64-bit hashes that hold the group.
    A set's terms are ordered from rare to common; the terms after which what remains weighs less than the threshold's share of all
    cannot be the only common ones, so pairs come from the rows of one term among those before. A set that may be like another leaves
    the term's task as one row, whatever the number of the others, see ``_comparing``; with their terms these meet again by the term,
    and a pair is the result's at the first term that both have, so each pair is made once, with exact sums. Any order is right: the
    counts of at most COMMON terms go to all tasks. ``keyed`` adds k, the hash of that first term, by which pairs of many sets meet.
    """
    term = F.xxhash64(*group, "term")
    lists = written(sets.groupBy("doc_id").agg(F.collect_list(term).alias("t"), F.collect_list(F.col("w10").cast("long")).alias("w")), "sets")  # one set's terms
    return similar_lists(lists, percent, keyed)


def similar_lists(lists: DataFrame, percent: int, keyed: bool = False) -> DataFrame:
    """``similar_sets`` of sets that are written as lists (doc_id, t, w): a set's terms as 64-bit hashes, each once, and their weights.

    A term that only one set begins with makes no pair, so only the hashes are shuffled to find those of several sets; these rows
    alone get the set's sketch and the first FIRST of its terms that are left. A sketch of one size says little of large sets, so the
    rows that it lets pass are compared again by sketches that grow with the set, of some 3 bits a term, before terms are shuffled.
    """
    kind = lists.schema["doc_id"].dataType.simpleString()
    every = lists.agg(F.sum(F.size("t"))).first()[0] or 0
    often = lists.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") > every / COMMON)
    common = written(often, "df").toPandas().sort_values("term")  # fewer than COMMON, as all counts add up to ``every``
    known = lists.sparkSession.sparkContext.broadcast((common["term"].to_numpy(np.int64), common["df"].to_numpy(np.int64)))
    heads = lists.mapInPandas(_heads(percent, known), f"k long, doc_id {kind}, at int, rest long")
    of = W.partitionBy("k").orderBy("doc_id")
    live = heads.withColumn("near", F.coalesce(F.lag("at").over(of), F.lead("at").over(of))).where("near is not null")
    keys = written(live.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "k", "rest"))).alias("keys")), "keys")  # one set's first terms
    bits = [f"s{i}" for i in range(SKETCH)]
    sketches = written(lists.mapInPandas(_sketches, f"doc_id {kind}, total long, least long, {', '.join(f'{x} long' for x in bits)}, bits binary"), "sketches")
    first = [F.coalesce(F.get("keys", F.lit(i))["k"], F.lit(0)).alias(f"f{i}") for i in range(FIRST)]
    rows = keys.join(sketches.drop("bits"), "doc_id").select("*", F.posexplode("keys").alias("at", "x"))
    rows = rows.select(F.col("x.k").alias("k"), "doc_id", "total", "least", F.col("x.rest").alias("rest"), "at", F.size("keys").alias("n"), *bits, *first)
    by = lambda t: t.repartition("k").sortWithinPartitions("k", "total", "doc_id")
    alike = written(by(rows).mapInPandas(_comparing(percent, _rows), rows.schema), "alike")
    cells = by(alike.join(sketches.select("doc_id", "bits"), "doc_id")).mapInPandas(_comparing(percent, _cells), f"k long, i int, j int, part int, doc_id {kind}")
    held = written(cells, "cells").join(lists, "doc_id").repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    out = written(held.mapInPandas(_summing(percent, known), f"a {kind}, b {kind}, low long, high long, k long"), "near")
    return out if keyed else out.drop("k")


def _flat(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, starts, row of each term, terms, weights) of some sets (doc_id, t, w) at once, of some HELD terms, or of one set."""
    for x in batches:
        x = x[x["t"].map(len) > 0]
        sizes = x["t"].map(len).to_numpy(np.int64)
        for i, j in _cuts(sizes, HELD):
            part, n = x.iloc[i:j], sizes[i:j]
            t, w = np.concatenate(part["t"].tolist()).astype(np.int64), np.concatenate(part["w"].tolist()).astype(np.int64)
            yield part["doc_id"].to_numpy(), np.cumsum(n) - n, np.repeat(np.arange(len(n)), n), t, w


def _cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of ``sizes`` that add up to about ``most`` each; one alone may have more."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return []
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], most), side="right")).tolist()
    return list(zip(cuts, [*cuts[1:], len(ends)], strict=True))


def _heads(percent: int, known: Broadcast) -> Callable:
    """(k, doc_id, at, rest) of sets (doc_id, t, w): a row for each of a set's first terms, with its place and the weight from there on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, counts = known.value
        for ids, starts, row, t, w in _flat(batches):
            near = np.minimum(np.searchsorted(terms, t), max(len(terms) - 1, 0))
            df = np.where(terms[near] == t, counts[near], 0) if len(terms) else np.zeros(len(t), np.int64)
            order = np.lexsort((t, df, row))
            t, w = t[order], w[order]
            total, before = np.add.reduceat(w, starts), np.cumsum(w) - w
            rest = total[row] - (before - before[starts][row])
            head = np.flatnonzero(rest * 100 >= total[row] * percent)  # rest falls
            yield pd.DataFrame({"k": t[head], "doc_id": ids[row[head]], "at": (head - starts[row[head]]).astype(np.int32), "rest": rest[head]})

    return run


def _parities(row: np.ndarray, t: np.ndarray, rows: int, n: int) -> np.ndarray:
    """The parities of each row's terms by hash, ``n`` bits a row."""
    odd = np.bincount(row * n + t % n, minlength=rows * n).reshape(rows, n) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little")


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(doc_id, total, least, s0..., bits): the weight of sets (doc_id, t, w), that of the lightest term, and the parity of the terms by hash.

    ``bits`` is the larger sketch of sets of more terms than SKETCH has room for; its bits are a power of two, 2 to 4 a term.
    """
    for ids, starts, row, t, w in _flat(batches):
        sizes, sketch = np.diff(np.append(starts, len(t))), np.empty((len(ids), SKETCH), np.int64)
        for i in range(0, len(ids), 4096):
            j = min(i + 4096, len(ids))
            own = slice(starts[i], starts[j] if j < len(ids) else len(t))
            sketch[i:j] = _parities(row[own] - i, t[own], j - i, 64 * SKETCH).view(np.int64)
        bits, width = np.full(len(ids), b"", object), 2 << np.ceil(np.log2(sizes)).astype(np.int64)
        for n in np.unique(width[sizes > 16 * SKETCH]):
            at = np.flatnonzero((width == n) & (sizes > 16 * SKETCH))
            place = np.full(len(ids), -1)
            place[at] = np.arange(len(at))
            own = place[row] >= 0
            bits[at] = [x.tobytes() for x in _parities(place[row[own]], t[own], len(at), int(n))]
        yield pd.DataFrame({"doc_id": ids, "total": np.add.reduceat(w, starts), "least": np.minimum.reduceat(w, starts)} | {f"s{i}": sketch[:, i] for i in range(SKETCH)} | {"bits": bits})


def _near(bits: np.ndarray, y: np.ndarray, z: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs of rows y and z have sketches ``bits`` that differ in at most ``most`` bits; a larger one is folded, none fits any."""
    width = np.array([len(b) for b in bits], np.int64)
    ok = np.ones(len(y), bool)
    words = lambda at, n: np.bitwise_xor.reduce(np.frombuffer(b"".join(bits[at]), np.uint64).reshape(len(at), -1, n), axis=1)
    for a, b in {*zip(width[y].tolist(), width[z].tolist(), strict=True)}:
        n = min(a, b) // 8
        pairs = np.flatnonzero((width[y] == a) & (width[z] == b)) if n else []
        for i in range(0, len(pairs), max(1, HELD // max(n, 1))):
            own = pairs[i : i + max(1, HELD // n)]
            ok[own] = np.bitwise_count(words(y[own], n) ^ words(z[own], n)).sum(axis=1, dtype=np.int64) <= most[own]
    return ok


def _alike(x: pd.DataFrame, percent: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which rows may be like another of their k; ``start`` and ``size`` are those of their run of one k."""
    k, total, least, rest, at, n = (x[c].to_numpy().astype(np.int64) for c in ("k", "total", "least", "rest", "at", "n"))
    bits = [x[f"s{i}"].to_numpy().astype(np.int64).view(np.uint64) for i in range(SKETCH)]
    first = [x[f"f{i}"].to_numpy().astype(np.int64) for i in range(FIRST)]
    spare, whole = rest * (100 + percent) - total * percent, total * percent  # spare of either is at least the whole of the other
    sized = x["bits"].to_numpy() if "bits" in x else None
    alike = np.zeros(len(x), bool)

    def pairs(y: np.ndarray, z: np.ndarray) -> None:
        met = np.zeros(len(y), bool)  # pairs that have a term in common before k, so that this one is not their first
        for i in range(FIRST):
            for j in range(FIRST):
                met |= (at[y] > i) & (n[z] > j) & (first[i][y] == first[j][z])
        y, z = y[~met], z[~met]
        most, apart = (total[y] + total[z]) * (100 - percent) // (np.minimum(least[y], least[z]) * (100 + percent)), np.zeros(len(y), np.int64)
        for s in bits:
            apart += np.bitwise_count(s[y] ^ s[z])
            fine = apart <= most
            y, z, most, apart = y[fine], z[fine], most[fine], apart[fine]
        if sized is not None and len(y):
            fine = _near(sized, y, z, most)
            y, z = y[fine], z[fine]
        alike[y] = alike[z] = True

    need = -(-whole // 100)  # the least total that a row's total allows
    large = size > BLOCK
    for i in np.flatnonzero(large & (start == np.arange(len(x)))):
        end = i + size[i]
        least_z = i + np.searchsorted(total[i:end], need[i:end])
        for r in range(i, end, BLOCK):
            rows = np.arange(r, min(r + BLOCK, end))
            for c in range(least_z[r - i], rows[-1], WIDE):
                cols = np.arange(c, min(c + WIDE, rows[-1]))
                y, z = rows[:, None], cols[None, :]
                ok = (z < y) & (z >= least_z[rows - i][:, None]) & (spare[y] >= whole[z]) & (spare[z] >= whole[y]) & ((at[y] == 0) | (first[0][y] != first[0][z]))
                p, q = np.nonzero(ok)
                pairs(rows[p], cols[q])
    low = start.copy()
    few = np.flatnonzero(~large)
    if len(few):
        run = np.cumsum(start[few] == few)
        wide = int(total[few].max()) + 1
        low[few] = few[np.searchsorted(run * wide + total[few], run * wide + need[few])]
    count = np.where(large, 0, np.arange(len(x)) - low)
    for i, j in _cuts(count, HELD):
        y = np.repeat(np.arange(i, j), count[i:j])
        z = np.arange(len(y)) + np.repeat(low[i:j] - (np.cumsum(count[i:j]) - count[i:j]), count[i:j])
        ok = (spare[y] >= whole[z]) & (spare[z] >= whole[y])
        pairs(y[ok], z[ok])
    return alike


def _rows(x: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
    return x.iloc[at]


def _cells(x: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
    """(k, i, j, part, doc_id): the rows ``at`` of each k, dealt to parts of CELL by their totals; a cell (i, j) holds parts i and j, so a set is a row for each part."""
    k = x["k"].to_numpy()
    _, begin, run, n = np.unique(k[at], return_index=True, return_inverse=True, return_counts=True)
    parts = -(-n // CELL)[run]
    part = np.repeat((np.arange(len(at)) - begin[run]) // CELL, parts).astype(np.int32)
    other = (np.arange(len(part)) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.int32)
    row = np.repeat(at, parts)
    return pd.DataFrame({"k": k[row], "i": np.minimum(part, other), "j": np.maximum(part, other), "part": part, "doc_id": x["doc_id"].to_numpy()[row]})


def _comparing(percent: int, out: Callable) -> Callable:
    """What ``out`` makes of the sets of a stream of heads (k, doc_id, total, least, rest, at, n, s0..., f0..., maybe bits), sorted by k and total, that may be like another of their k.

    Totals must be near, what either side has from the term on must suffice, and so must the sketches: a sketch is the parity of a
    set's terms by hash, so the bits in which two differ are at most the terms that only one set has. Pairs that are seen to have a
    term in common before k are left to that one. Rows of one k are held, some 150 bytes each; all runs of a batch are compared at once.
    """

    def found(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        k = x["k"].to_numpy()
        heads = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(heads, len(k)))
        at = np.flatnonzero(_alike(x, percent, np.repeat(heads, size), np.repeat(size, size)))
        if len(at):
            yield out(x, at)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []  # the rows of the last k so far
        for batch in batches:
            if not len(batch):
                continue
            k = batch["k"].to_numpy()
            if kept and kept[0]["k"].iat[0] == k[-1]:
                kept.append(batch)
                continue
            cut = int(np.searchsorted(k, k[-1]))
            whole = [*kept, batch.iloc[:cut]]
            kept = [batch.iloc[cut:]]
            yield from found(pd.concat(whole)) if any(map(len, whole)) else ()
        if kept:
            yield from found(pd.concat(kept))

    return run


def _runs(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The rows with the same ``names``, which come one after the other, as one frame each."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch[names].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1), len(batch)]
        for n, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if kept and (n or (kept[0][names].iloc[0].to_numpy() != key[0]).any()):
                yield pd.concat(kept) if len(kept) > 1 else kept[0]
                kept = []
            kept.append(batch.iloc[x:y])
    if kept:
        yield pd.concat(kept) if len(kept) > 1 else kept[0]


def _summing(percent: int, known: Broadcast) -> Callable:
    """(a, b, low, high, k) of the sets (k, i, j, part, doc_id, t, w) of cells: pairs of parts i and j alike by ``percent`` whose first common term is k.

    Terms are in the order of ``_heads``. A set is held against those of smaller totals at once.
    """

    def pairs(x: pd.DataFrame) -> Iterator[pd.DataFrame]:
        terms, counts = known.value
        total = np.array([w.sum() for w in x["w"]], np.int64)
        order = np.argsort(total, kind="stable")
        x, total = x.iloc[order], total[order]
        k, whole, part, ids = x["k"].iat[0], x["i"].iat[0] == x["j"].iat[0], x["part"].to_numpy(), x["doc_id"].to_numpy()
        starts = np.concatenate([[0], np.cumsum([len(t) for t in x["t"]])])
        names, at = np.unique(np.concatenate(x["t"].tolist()), return_inverse=True)
        near = np.minimum(np.searchsorted(terms, names), max(len(terms) - 1, 0))
        df = np.where(terms[near] == names, counts[near], 0) if len(terms) else np.zeros(len(names), np.int64)
        place = np.empty(len(names), np.int64)
        place[np.lexsort((names, df))] = np.arange(len(names))
        at, w, here = place[at], np.concatenate(x["w"].tolist()), place[np.searchsorted(names, k)]
        mine, found, n = np.zeros(len(names), np.int64), [], 0
        for y in range(1, len(x)):
            first = int(np.searchsorted(total, -(-total[y] * percent // 100)))
            if first >= y:
                continue
            own, others, ends = slice(starts[y], starts[y + 1]), slice(starts[first], starts[y]), starts[first:y] - starts[first]
            mine[at[own]] = w[own]
            common = np.minimum(mine[at[others]], w[others])
            low = np.add.reduceat(common, ends)
            high = total[y] + total[first:y] - low
            ok = (low * 100 >= high * percent) & (whole | (part[first:y] != part[y]))
            if ok.any():
                ok &= np.minimum.reduceat(np.where(common > 0, at[others], len(names)), ends) == here
                z = np.flatnonzero(ok)
                a, b = np.repeat(ids[y : y + 1], len(z)), ids[first + z]
                found.append(pd.DataFrame({"a": np.where(a < b, a, b), "b": np.where(a < b, b, a), "low": low[z], "high": high[z], "k": k}))
                n += len(z)
            mine[at[own]] = 0
            if n > PAIRS:
                yield pd.concat(found)
                found, n = [], 0
        if found:
            yield pd.concat(found)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for x in _runs(batches, ["k", "i", "j"]):
            for out in pairs(x) if len(x) > 1 else ():
                held.append(out)
                n += len(out)
                if n > PAIRS:
                    yield pd.concat(held)
                    held, n = [], 0
        if held:
            yield pd.concat(held)

    return run


def band_pairs(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, low, high, ...) of classes that are sure hits, and for those of the band the pairs of their text classes.

    ``classes`` and ``texts``: (doc_id, cls) by terms, and by terms and stem counts.
    """
    sure = F.col("low") * 10 >= F.col("high") * HIT10
    kinds = texts.where("doc_id = cls").select("doc_id").join(classes, "doc_id")
    left, right = kinds.select(F.col("doc_id").alias("x"), F.col("cls").alias("a")), kinds.select(F.col("doc_id").alias("y"), F.col("cls").alias("b"))
    wide = pairs.where(~sure).join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), *pairs.columns[2:])
    return pairs.where(sure).unionByName(wide)


def pair_cosines(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(a, b, cosine) of the pairs (k, a, b) of one type of ids by stem counts (doc_id, stem, n); pairs without a common stem are absent.

    Pairs of one k meet in one task, in cells of CELL ids a side if they have more, so what is shuffled is each id's stems once for each
    part of its k and no longer for each pair. Stems go by 64-bit hashes.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    pairs = written(pairs.select("k", "a", "b"), "cosine_pairs")
    members = written(pairs.select("k", F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "cosine_members")
    parts = written(members.groupBy("k").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("parts")).where("parts > 1"), "cosine_parts")
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("parts", F.lit(1))).cast("int")
    rows = members.join(parts, "k", "left").select("k", "doc_id", part("doc_id").alias("p"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("c"))
    cell = lambda x, y: F.struct(F.col(x).alias("i"), F.col(y).alias("j"))
    rows = rows.select("k", "doc_id", F.explode(F.array_distinct(F.array(cell("p", "c"), cell("c", "p")))).alias("x")).select("k", "x.i", "x.j", "doc_id")
    lists = counts.join(members.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.xxhash64("stem")).alias("t"), F.collect_list(F.col("n").cast("long")).alias("n"))  # one text's stems
    held = rows.join(lists, "doc_id").groupBy("k", "i", "j")
    asked = pairs.join(parts, "k", "left").select("k", part("a").alias("i"), part("b").alias("j"), "a", "b").groupBy("k", "i", "j")

    def run(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": x["a"][:0], "b": x["b"][:0], "cosine": np.zeros(0)})
        starts = np.concatenate([[0], np.cumsum([len(t) for t in y["t"]])])
        names, at = np.unique(np.concatenate(y["t"].tolist()), return_inverse=True)
        n, size = np.concatenate(y["n"].tolist()), np.array([v @ v for v in y["n"]], np.int64)
        row, mine = pd.Series(np.arange(len(y)), y["doc_id"].to_numpy()), np.zeros(len(names), np.int64)
        x = x.sort_values("a", kind="stable")
        x = x[x["a"].isin(row.index) & x["b"].isin(row.index)]
        p, q, last = row.loc[x["a"]].to_numpy(), row.loc[x["b"]].to_numpy(), -1
        dots = np.zeros(len(x), np.int64)
        for m, (i, j) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
            if i != last:
                mine[:] = 0
                mine[at[starts[i] : starts[i + 1]]] = n[starts[i] : starts[i + 1]]
                last = i
            dots[m] = mine[at[starts[j] : starts[j + 1]]] @ n[starts[j] : starts[j + 1]]
        found = pd.DataFrame({"a": x["a"].to_numpy(), "b": x["b"].to_numpy(), "cosine": dots / (np.sqrt(size[p]) * np.sqrt(size[q]))})
        return found[dots > 0]

    return asked.cogroup(held).applyInPandas(run, f"a {kind}, b {kind}, cosine double")


def reuse_decision(pairs: DataFrame, similarity: DataFrame) -> DataFrame:
    """(a, b, decision): HIT at 0.9; in the band from 0.8 HIT if the requirements' similarity is 0.95; else MISS.

    ``similarity``: (a, b, cosine), needed only for the pairs of the band.
    """
    sure = F.col("low") * 10 >= F.col("high") * HIT10
    out = pairs.join(similarity, ["a", "b"], "left")
    return out.select("a", "b", F.when(sure | (F.coalesce("cosine", F.lit(0.0)) >= BAND_SIMILARITY), "HIT").otherwise("MISS").alias("decision"))


def memberships(decided: DataFrame, classes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members (doc_id, cls), links (a, b)) in one space of class names: t of equal terms, s of equal terms and stem counts.

    ``decided``: (a, b, low, high, decision) of ``band_pairs``. Members of one class of equal terms hit each other.
    """
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    kind = F.when(F.col("low") * 10 >= F.col("high") * HIT10, "t").otherwise("s")
    links = decided.where("decision = 'HIT'").select(F.concat(kind, F.col("a").cast("string")).alias("a"), F.concat(kind, F.col("b").cast("string")).alias("b"))
    members = classes.select("doc_id", name("t", "cls").alias("cls")).unionByName(texts.select("doc_id", name("s", "cls").alias("cls")))
    return written(members, "members"), written(links, "links")


def member_hits(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, decision): HIT of each member b of a class of equal terms and stems with the first, and of these with the first of equal terms."""
    first = texts.where("doc_id = cls").select("doc_id").join(classes, "doc_id")
    rows = texts.unionByName(first).where("doc_id <> cls")
    return rows.select(F.col("cls").alias("a"), F.col("doc_id").alias("b"), F.lit("HIT").alias("decision"))


def _around(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, near): each class with itself and the classes linked to it."""
    pairs = links.select("a", "b")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = classes.select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    return both.unionByName(own).distinct().select(F.col("a").alias("cls"), F.col("b").alias("near"))


def _members(postings: DataFrame, members: DataFrame | None) -> DataFrame:
    return postings.select("doc_id", F.col("doc_id").alias("cls")) if members is None else members


def batch_reuse(postings: DataFrame, links: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(doc_id, reused): for each posting the earliest one before it in input order (``ord``) that it hits, else null.

    Postings of one class, or of two linked ones (a, b), hit each other; without ``members`` each is its own class.
    Of a class only its first posting can be the earliest, so no pairs of postings are made.
    """
    inside = _members(postings, members).join(postings.select("doc_id", "ord"), "doc_id")
    first = inside.groupBy("cls").agg(F.min(F.struct("ord", "doc_id")).alias("first"))
    near = _around(links, first).join(first.select(F.col("cls").alias("near"), "first"), "near").groupBy("cls").agg(F.min("first").alias("first"))
    found = inside.join(near, "cls").where(F.col("first")["ord"] < F.col("ord")).groupBy("doc_id").agg(F.min("first")["doc_id"].alias("reused"))
    return postings.select("doc_id").join(found, "doc_id", "left")


def class_leaders(members: DataFrame, links: DataFrame, group: str) -> DataFrame:
    """(group, node, leads): a node leads iff no earlier node of its classes, or of classes linked to them, leads in its group.

    ``members``: (group, node, cls), ``links``: (a, b) of classes. In each round a class tells its earliest leading and its earliest
    undecided node, so a class of any size costs a row a member and round. A node is decided once a leader is before it or all
    before it are decided. Each round is written and its lineage cut.
    """
    members = written(members.select(group, "node", "cls").distinct(), "members")
    around = written(_around(links, members.select("cls").distinct()), "around")
    state = written(members.select(group, "node").distinct().withColumn("leads", F.lit(None).cast("boolean")), "leaders")
    while True:
        told = members.join(state, [group, "node"]).groupBy(group, "cls").agg(F.min(F.when(F.col("leads"), F.col("node"))).alias("lead"), F.min(F.when(F.col("leads").isNull(), F.col("node"))).alias("open"))
        near = told.withColumnRenamed("cls", "near").join(around, "near").groupBy(group, "cls").agg(F.min("lead").alias("lead"), F.min("open").alias("open"))
        seen = members.join(near, [group, "cls"]).groupBy(group, "node").agg(F.min("lead").alias("lead"), F.min("open").alias("open"))
        led, free = F.coalesce(F.col("lead") < F.col("node"), F.lit(False)), F.coalesce(F.col("open") >= F.col("node"), F.lit(True))
        leads = F.when(F.col("leads").isNotNull(), F.col("leads")).when(led, False).when(free, True)
        after = written(state.join(seen, [group, "node"]).select(group, "node", leads.alias("leads")), "leaders")
        remove(state)
        state = after
        if state.where("leads is null").isEmpty():
            return state


def leaders(nodes: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """(group, node, leads): a node leads iff no earlier neighbour (smaller node) leads; the sequential rule in parallel rounds.

    ``edges``: (group, a, b) with a < b. Each round decides every node all of whose earlier neighbours are decided or of
    which one leads. Rounds are as many as the longest chain of alternating decisions; each is written and its lineage cut.
    """
    state = written(nodes.select(group, "node").distinct().withColumn("leads", F.lit(None).cast("boolean")), "leaders")
    edges = written(edges.select(group, "a", "b").distinct(), "edges")
    while True:
        seen = edges.join(state.select(group, F.col("node").alias("a"), F.col("leads").alias("la")), [group, "a"])
        around = seen.groupBy(group, F.col("b").alias("node")).agg(F.coalesce(F.bool_or("la"), F.lit(False)).alias("led"), F.count_if(F.col("la").isNull()).alias("open"))
        new = state.join(around, [group, "node"], "left")
        leads = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        after = written(new.select(group, "node", leads.alias("leads")), "leaders")
        remove(state)
        state = after
        if state.where("leads is null").isEmpty():
            return state


def live_reuse(postings: DataFrame, links: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(doc_id, reused): the newest earlier posting of the same owner that was not itself reused and that it hits.

    ``postings``: (owner, doc_id, ord). Those not reused are the leaders of the hits within an owner; a class has one leader
    an owner, as its members hit each other. ``links`` and ``members`` as in ``batch_reuse``.
    """
    inside = _members(postings, members).join(postings.select("owner", "doc_id", "ord"), "doc_id")
    lead = class_leaders(inside.select("owner", F.col("ord").alias("node"), "cls"), links, "owner").where("leads").select("owner", F.col("node").alias("ord"))
    led = inside.join(lead, ["owner", "ord"]).select("owner", F.col("cls").alias("near"), F.struct("ord", "doc_id").alias("lead"))
    near = led.join(_around(links, inside.select("cls").distinct()), "near").groupBy("owner", "cls").agg(F.array_sort(F.collect_set("lead")).alias("leads"))  # a lead a linked class
    newest = F.array_max(F.filter("leads", lambda x: x["ord"] < F.col("ord")))
    found = inside.join(near, ["owner", "cls"]).groupBy("doc_id").agg(F.max(newest)["doc_id"].alias("reused"))
    return postings.select("doc_id").join(found, "doc_id", "left")


def achievement_groups(nodes: DataFrame, ties: DataFrame) -> DataFrame:
    """(owner_id, cand_id, root): each candidate joins the group of the first earlier candidate it is tied to, in id order.

    ``ties``: (owner_id, a, b), a < b, of mutually or one-sidedly grounded candidates. The parent is the smallest tied
    id below one's own; roots follow by pointer jumping, in rounds that double the distance.
    """
    parent = ties.groupBy("owner_id", F.col("b").alias("cand_id")).agg(F.min("a").alias("root"))
    state = written(nodes.select("owner_id", "cand_id").join(parent, ["owner_id", "cand_id"], "left").withColumn("root", F.coalesce("root", "cand_id")), "groups")
    while True:
        up = state.select("owner_id", F.col("cand_id").alias("root"), F.col("root").alias("higher"))
        after = written(state.join(up, ["owner_id", "root"]).select("owner_id", "cand_id", "root", "higher"), "groups")
        done = after.where("root <> higher").isEmpty()
        remove(state)
        state = written(after.select("owner_id", "cand_id", F.col("higher").alias("root")), "groups")
        remove(after)
        if done:
            return state


# Fixed value: the parts of a name in mixed case.
_PARTS = "[A-Z][a-z]+|[a-z]+|[A-Z]+(?![a-z])|\\d+"


def _alias_keys(name: Column) -> dict[str, Column]:
    plain = F.regexp_replace(F.lower(name), "[\\s.\\-]", "")
    parts = F.regexp_extract_all(name, F.lit(_PARTS), F.lit(0))
    initials = F.when(F.size(parts) >= 2, F.upper(F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), "")))
    capitals = F.when((F.upper(name) == name) & name.rlike("[A-Z]"), name)
    shorter = F.when(plain.rlike("^.{2,}(js|lang|ful)$"), F.regexp_replace(plain, "(js|lang|ful)$", ""))
    counted = F.when(plain.rlike("^[a-z]\\d+[a-z]$"), F.concat(F.substring(plain, 1, 1), F.regexp_replace(plain, "^.0*|.$", ""), F.substring(plain, F.length(plain), F.lit(1))))
    spelled = F.when(F.length(plain) >= 2, F.concat(F.substring(plain, 1, 1), (F.length(plain) - 2).cast("string"), F.substring(plain, F.length(plain), F.lit(1))))
    return {"plain": plain, "shorter": shorter, "counted": counted, "spelled": spelled, "initials": initials, "capitals": capitals}


def alias_rules(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, rules): names of two tables (name) that one is likely an alias of the other, with the sorted rules that say so.

    punctuation: equal without spaces, dots and hyphens; affix: equal but for a final js, lang or ful; numeronym: first letter,
    count, last letter; initialism: capitals that are the initials of the other's parts. Each rule is an equi-join on a derived key.
    """
    k = _alias_keys(F.col("name"))
    x = left.select(F.col("name").alias("a"), *[v.alias(f"a_{n}") for n, v in k.items()]).distinct()
    y = right.select(F.col("name").alias("b"), *[v.alias(f"b_{n}") for n, v in k.items()]).distinct()
    rules = [("punctuation", "plain", "plain"), ("affix", "shorter", "plain"), ("affix", "plain", "shorter"), ("numeronym", "counted", "spelled"), ("numeronym", "spelled", "counted"), ("initialism", "initials", "capitals"), ("initialism", "capitals", "initials")]
    found = [x.join(y, F.col(f"a_{p}") == F.col(f"b_{q}")).select("a", "b", F.lit(rule).alias("rule")) for rule, p, q in rules]
    every = reduce(DataFrame.unionByName, found).where("a <> b")
    return every.groupBy("a", "b").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def alias_suggestions(rules: DataFrame, hints: DataFrame) -> DataFrame:
    """(a, b, tier, reason): rule matches first ('rule'), then nearest neighbours as hints ('hint'); never applied by themselves."""
    sure = rules.select("a", "b", F.lit("rule").alias("tier"), F.array_join("rules", "+").alias("reason"))
    more = hints.join(rules.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.lit("hint").alias("tier"), F.lit("nearest").alias("reason"))
    return sure.unionByName(more)


def title_key(title: Column) -> Column:
    """The text before a colon, trimmed, in lower case."""
    return F.lower(F.trim(F.substring_index(title, ":", 1)))


def match_titles(sections: DataFrame, datasets: DataFrame, most: int = 8) -> DataFrame:
    """(section_id, dataset_id, outcome): the nth section with a key takes the nth dataset with that key.

    Both tables are (owner_id, id, ord, title). What is left is an ``unmatched section``, a ``new section`` while the owner has
    fewer than ``most``, or an ``unmatched dataset``.
    """
    first = F.lit(1)
    side = lambda t, name: running(t.withColumn("key", title_key(F.col("title"))).select("owner_id", "key", "ord", "id"), ["owner_id", "key"], [F.col("ord"), F.col("id")], first, "n").select("owner_id", "key", "n", F.col("id").alias(name), F.col("ord").alias(f"{name}_ord"))
    keys = [F.col(f"s.{k}").eqNullSafe(F.col(f"d.{k}")) for k in ("owner_id", "key", "n")]
    both = side(sections, "section_id").alias("s").join(side(datasets, "dataset_id").alias("d"), keys, "full")
    both = written(both.select(F.coalesce("s.owner_id", "d.owner_id").alias("owner_id"), "section_id", "dataset_id", "dataset_id_ord"), "titles")
    kept = both.where("section_id is not null").select("owner_id", "section_id", "dataset_id", F.when(F.col("dataset_id").isNotNull(), "matched").otherwise("unmatched section").alias("outcome"))
    extra = running(both.where("section_id is null"), ["owner_id"], [F.col("dataset_id_ord").asc_nulls_first(), F.col("dataset_id")], first, "extra").alias("e")
    own = sections.groupBy("owner_id").agg(F.count("*").alias("have")).alias("o")
    new = extra.join(own, F.col("e.owner_id").eqNullSafe(F.col("o.owner_id")), "left")
    outcome = F.when(F.coalesce("have", F.lit(0)) + F.col("extra") <= most, "new section").otherwise("unmatched dataset")
    return kept.unionByName(new.select("e.owner_id", "section_id", "dataset_id", outcome.alias("outcome")))
