"""Exact Jaccard self-join of documents' word n-grams by PartEnum signatures, and its connected components.

Sets. A document's set holds the hashes of its distinct n-word shingles (ASCII letters in lower case; a text with fewer
words is one shingle; without words the set is empty and links with nothing). Documents with equal sets form a class;
from then on only one representative of each class takes part.

Signatures. Jaccard similarity of at least t bounds the symmetric difference of two sets by k, which follows from their
sizes. Sizes are banded by powers of the root of two; a set signs in its own band and, if a partner could lie there, in the
one below. In a band the domain of hashes is cut into groups of ``sub`` parts, and each subset of sub - 1 parts of a group is
enumerated: its content is a signature. k differences cannot spoil all the signatures of a group unless enough fall into it
(sub = 2: one for each; sub = 3: one for the first two, another for the third), so two similar sets agree in some.

There are ``SPARE`` times the groups that k calls for, and a set keeps only its rarest signatures: ordered by the number of
sets that share them, counted over all, it keeps the shortest beginning of that order that k differences cannot spoil. As
the order is the same for all, two similar sets still share a kept one. Signatures that nobody shares come first in it, so
a set with enough of these has no partner and drops out, and crowded signatures (common passages) are left aside.

Joining. Buckets with the same members count once. First each member is tested against its bucket's most connected one;
that joins most copies. Where a bucket still holds several components, the pairs across them are listed if it has at most
``FEW`` members, but for those whose sketches of ``SKETCH`` bits differ in more bits than similar sets could in elements. Larger ones are cut finer, in rounds: in the first those with the same most connected member are one group
(joined to another whose most connected member is higher and shares it), then each is one. A group has a centre c: the elements that most of a few of its members hold (any set would do). D(x) is the symmetric difference of x
and c, and x has room (100 - t) |x| - (100 + t) |D(x)|. Two members are similar exactly if D(x) and D(y) have so much in
common as their rooms leave missing, -(room(x) + room(y)) / (2 (100 + t)) elements. All members are tested against the one
with most room. Other similar pairs in different components share one of the first |D| - need + 1 elements of each, the rarest
in the group first, where need is what the best partner in another component would leave. Such elements are the next buckets,
but for those in one member's D alone and those in every member's: two similar members that share nothing but the latter are
both similar to the one with most room. So buckets get smaller and the rounds end. Buckets wholly inside one component are
dropped.

Nulls: a null text has an empty set; rows with a null id are returned with a null component and link nothing. Rows that
repeat an id are separate rows: where their sets differ, each class has a key of its own in place of the id. Exact up to 64-bit
collisions of hashes. A set of more than 2 ** (PLACE - 2) signatures (a text of some hundred megabytes) is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.durable import Scratch, written
from lodestone.llm.components import components, sized
from lodestone.llm.words import mix, shingle_set
from lodestone.sources import table

#: A list of ids with up to so many rows is sent to all tasks (about 16 MB there); a longer one is joined by shuffle.
SMALL_IDS = 1 << 18
#: Lists of up to so many elements in all (16 bytes each at most) are sent to all tasks.
SMALL_LISTS = 1 << 19
#: Members of a bucket whose pairs are all verified: at most (FEW - 1) / 2 pairs a member.
FEW = 32
#: Bits of a set's sketch: each is the parity of the elements that fall to it, so sketches differ in no more bits than their sets in elements.
SKETCH = 1024
#: How many times the groups that k calls for there are.
SPARE = 1.15
#: Members of a group, at most, whose majority is its centre.
CENTRE = 7
#: Elements of a group, on average at most, that are counted at once.
SLICE = 1 << 18
#: Low bits of a signature that tell its band (modulo 4, so t is 30 percent at least) and place.
PLACE = 26
#: Bytes of text whose sets a task holds at once (one text more may start).
CHUNK = 1 << 22
_CLASS = np.uint64(0xD1B54A32D192ED03)
_SETS = "id long, n long, f1 long, f2 long"


def most_different(a: int, b: int, t: int) -> int:
    """The largest symmetric difference of sets of sizes a and b whose Jaccard similarity is at least t percent."""
    return (100 - t) * (a + b) // (100 + t)


def _band(size: int) -> int:
    """The j with 2 ** (j / 2) <= size < 2 ** ((j + 1) / 2)."""
    return (size * size).bit_length() - 1


def instances(a: int, t: int, sub: int) -> list[tuple[int, int, int]]:
    """(band, k, groups) in which a set of size a signs; none if only equal sets are similar to it.

    Two similar sets meet in the band of the smaller one, whose groups allow for a larger partner.
    """
    out = []
    if most_different(a, 100 * a // t, t) == 0:
        return out
    own = _band(a)
    for band in range(_band(-(-t * a // 100)), own + 1):
        top = math.isqrt((2 << band) - 1)  # the largest size in the band
        k = most_different(a, 100 * a // t if band == own else top, t)
        groups = math.ceil(SPARE * (most_different(top, 100 * top // t, t) // 2 + 1))
        if groups * sub > 1 << PLACE - 2:
            raise ValueError(f"a set of {a} shingles needs more signatures than there are places")
        out.append((band, k, groups))
    return out


@lru_cache(maxsize=64)
def _layout(band: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The borders of the n parts of a band, what tells their places apart in a hash, and the low bits."""
    place = np.arange(n, dtype=np.uint64)
    borders = (np.arange(1, n, dtype=np.float64) / n * 2.0**64).astype(np.uint64)
    return borders, mix(place * np.uint64(256) + np.uint64(band)), np.uint64((band & 3) << PLACE - 2) | place


def signatures(s: np.ndarray, t: int, sub: int) -> np.ndarray:
    """All PartEnum signatures of a sorted set of uint64 hashes, as uint64: groups * sub for each instance.

    The low PLACE bits hold the band modulo 4 and the signature's place in it, the others a hash of its content and the band.
    Signatures that agree by chance only cost a test.
    """
    run = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(mix(s), out=run[1:])
    out = [np.zeros(0, np.uint64)]
    for band, _, groups in instances(len(s), t, sub):
        borders, salt, low = _layout(band, groups * sub)
        at = np.concatenate([[0], np.searchsorted(s, borders), [len(s)]])
        content = mix(run[at[1:]] - run[at[:-1]] + np.diff(at).astype(np.uint64))
        if sub == 3:  # the i-th subset leaves the i-th part out
            c = content.reshape(-1, 3)
            content = mix(c[:, [1, 0, 0]] + np.uint64(3) * c[:, [2, 2, 1]]).ravel()
        out.append(mix(content + salt) >> np.uint64(PLACE) << np.uint64(PLACE) | low)
    return np.concatenate(out)


def rarest(a: int, sharers: np.ndarray, shared: np.ndarray, t: int, sub: int) -> list[int]:
    """The signatures to keep of a set of size a, of those that others have too: ``shared`` (uint64), each with its ``sharers``."""
    kept = []
    bands, groups_of = shared >> np.uint64(PLACE - 2) & np.uint64(3), (shared & np.uint64((1 << PLACE - 2) - 1)).astype(np.int64) // sub
    worth = np.array((0, 1, 2) if sub == 2 else (0, 1, 1, 2))
    for band, k, groups in instances(a, t, sub):
        here = np.flatnonzero(bands == band & 3)
        left = sub - np.bincount(groups_of[here], minlength=groups)  # signatures of each group in the beginning so far
        cost = int(worth[left].sum())
        if cost > k:
            continue
        for i in here[np.lexsort((shared[here], sharers[here]))].tolist():
            g = groups_of[i]
            cost += int(worth[left[g] + 1] - worth[left[g]])
            left[g] += 1
            kept.append(int(shared[i]))
            if cost > k:
                break
    return kept


def _set(data: bytes | None, n: int) -> np.ndarray:
    return shingle_set(data.lower(), n) if data else np.zeros(0, np.uint64)


def _sizes(sets: list[np.ndarray]) -> list[pa.Array]:
    """The sizes of the sets and their fingerprints of 128 bits in two halves."""
    halves = [np.array([mix(s ^ x).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for x in (np.uint64(0), _CLASS)]
    return [pa.array([len(s) for s in sets], pa.int64()), *map(pa.array, halves)]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)))


def _of_sets(rows: DataFrame, n: int, of: Callable[[list[np.ndarray]], list[pa.Array]], schema: str) -> DataFrame:
    """The columns of ``rows`` before its last, ``data`` (a text's bytes), and those that ``of`` gives for the sets of the texts.

    The sets are made for CHUNK bytes at a time.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("data")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(upto, CHUNK + (upto[at - 1] if at else 0), "right")))
                part = batch.slice(at, end - at)
                sets = [_set(x, n) for x in part.column("data").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *of(sets)], names=names)
                at = end

    return rows.mapInArrow(run, schema)


def signed(docs: DataFrame, n: int, t: int, sub: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, f1, f2, sigs) of each row: its set's size, class fingerprint of 128 bits and signatures."""

    def of(sets: list[np.ndarray]) -> list[pa.Array]:
        return [*_sizes(sets), _lists([signatures(s, t, sub) if len(s) else s for s in sets])]

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("data"))
    return _of_sets(rows, n, of, f"{_SETS}, sigs array<long>")


def _sketches(sets: list[np.ndarray]) -> pa.Array:
    """The sketches of the sets, as longs."""
    odd = [np.bincount((s % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH).astype(np.uint8) & 1 for s in sets]
    return _lists([np.packbits(x).view(np.uint64) for x in odd])


def sets_of(docs: DataFrame, ids: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, s, bits): the sets of the listed ids and their sketches."""
    small = F.broadcast(ids) if ids.count() <= SMALL_IDS else ids
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("data")).join(small, "id", "left_semi")
    return _of_sets(rows, n, lambda sets: [_lists(sets), _sketches(sets)], "id long, s array<long>, bits array<long>")


def keyed(docs: DataFrame, several: DataFrame, reps: DataFrame, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) rows of ``docs`` in which the ids of ``several``, whose rows have different sets, give way to the keys of the classes
    they stand for, one row each; the other rows of such ids are left out.

    ``reps``: (id, rep, n, f1, f2), the key and the smallest id of each class.
    """
    ids = (F.broadcast(several) if several.count() <= SMALL_IDS else several).select(F.col("id").alias("rep"))
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rep"), F.col(text).alias(text))
    plain = rows.join(ids, "rep", "left_anti").select(F.col("rep").alias(key), text)
    again = rows.join(ids, "rep", "left_semi").select("rep", F.col(text).alias("text"), F.col(text).cast("binary").alias("data"))
    again = _of_sets(again, n, _sizes, "rep long, text string, n long, f1 long, f2 long").join(reps, ["rep", "n", "f1", "f2"])
    again = again.groupBy("id").agg(F.min("text").alias("text"))  # texts of one class have equal sets
    return plain.unionByName(again.select(F.col("id").alias(key), F.col("text").alias(text)))


def _kept(held: DataFrame, t: int, sub: int) -> DataFrame:
    """(id, n, keys): the signatures to keep of the sets (id, n, x) with shared signatures x (m, key); sets that keep none are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            ends, m, keys = x.offsets.to_numpy(), x.values.field("m").to_numpy(), x.values.field("key").to_numpy().view(np.uint64)
            kept = [np.array(rarest(size, m[a:b], keys[a:b], t, sub), np.uint64) for size, a, b in zip(batch.column("n").to_pylist(), ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), _lists(kept)], names=["id", "n", "keys"]).filter(pa.array([len(k) > 0 for k in kept]))

    return held.select("id", "n", "x").mapInArrow(run, "id long, n long, keys array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, t: int) -> DataFrame:
    """(a, b) of the pairs (p, id) that are similar."""
    both = pairs.join(sets.select(F.col("id").alias("p"), F.col("s").alias("ps")), "p").join(sets, "id")
    common = F.size(F.array_intersect("s", "ps"))
    return both.where(common * 100 >= t * (F.size("s") + F.size("ps") - common)).select(F.col("p").alias("a"), F.col("id").alias("b"))


def _fitting(lists: DataFrame, column: str) -> DataFrame:
    """``lists``, a written table, marked to be sent to all tasks if all its lists together are short."""
    total = lists.agg(F.sum(F.size(column) + F.lit(8))).first()[0] or 0
    return F.broadcast(lists) if total <= SMALL_LISTS else lists


def _majority(few: DataFrame) -> DataFrame:
    """(g, c): the elements that more than half of a group's few sets (g, few) hold."""

    def of(sets: pa.ListScalar) -> np.ndarray:
        e, m = np.unique(sets.values.flatten().to_numpy(), return_counts=True)
        return e[m * 2 > len(sets.values)].view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("g"), _lists([of(x) for x in batch.column("few")])], names=["g", "c"])

    return few.mapInArrow(run, "g long, c array<long>")


def _spread(groups: DataFrame, sets: DataFrame, t: int, scratch: Scratch) -> DataFrame:
    """(g, id, room, gone, new): the members' differences to their group's centre, its elements they lack and those it lacks."""
    order = F.struct(F.xxhash64("id").alias("h"), "id")
    some = groups.groupBy("g", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(CENTRE)).alias("slot")).agg(F.min(order)["id"].alias("id"))
    few = some.join(sets, "id").groupBy("g").agg(F.collect_list("s").alias("few"))  # at most CENTRE sets
    centres = _fitting(scratch.written(_majority(few), "centres"), "c")
    held = groups.join(sets, "id").join(centres, "g").select("g", "id", F.size("s").alias("n"), F.array_except("c", "s").alias("gone"), F.array_except("s", "c").alias("new"))
    room = (100 - t) * F.col("n") - (100 + t) * (F.size("gone") + F.size("new"))
    return held.select("g", "id", room.cast("long").alias("room"), "gone", "new")


def _beginnings(rows: DataFrame) -> DataFrame:
    """(g, id, keys): of the elements of D by (members that have it, element) the first ``first``, without those in one D alone or in all.

    ``rows``: (g, id, b, n, first, gone, lost, own), where ``lost`` (e, f), sorted, are the centre's elements that several members
    lack, ``own`` (e, f) the others of this D that several have; f of the b members. n is the size of D.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            parts = [(x.offsets.to_numpy(), x.values) for x in (batch.column(c) for c in ("gone", "lost", "own"))]
            gone, lost_e, lost_f, own_e, own_f = parts[0][1].to_numpy(), *(parts[i][1].field(c).to_numpy() for i in (1, 2) for c in ("e", "f"))
            for i, (b, n, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("b", "n", "first")), strict=True)):
                mine, lost, own = (slice(ends[i], ends[i + 1]) for ends, _ in parts)
                here = np.isin(lost_e[lost], gone[mine])
                e, f = np.concatenate([lost_e[lost][here], own_e[own]]), np.concatenate([lost_f[lost][here], own_f[own]])
                at = np.lexsort((e, f))[: max(0, first - (n - len(e)))]  # those in one D alone come first
                keys.append(e[at[f[at] < b]].view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("id"), _lists(keys)], names=["g", "id", "keys"])

    return rows.mapInArrow(run, "g long, id long, keys array<long>")


def _tally(g: np.ndarray, e: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The groups, the ends of their lists, and the elements and summed counts of all lists, from rows (group, element, count)."""
    order = np.lexsort((e, g))
    g, e, f = g[order], e[order], f[order]
    first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (e[1:] != e[:-1])])) if len(g) else np.zeros(0, np.int64)
    g, e, f = g[first], e[first], np.add.reduceat(f, first) if len(first) else f
    heads = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[heads], np.append(heads, len(g)), e, f


def _lacked(rows: DataFrame) -> DataFrame:
    """(g, lost): for each group the elements, sorted, that at least two of its members (g, gone) lack, with how many do: (e, f).

    Each task counts by itself and gives a row for each group, so what is shuffled does not grow with the members' differences.
    """
    names = ["g", "e", "f"]

    def listed(g: np.ndarray, ends: np.ndarray, e: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g), *(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in (e, f))], names=names)

    def flat(batch: pa.RecordBatch, *columns: str) -> list[np.ndarray]:
        ends = batch.column(columns[0]).offsets.to_numpy()
        return [np.repeat(batch.column("g").to_numpy(), np.diff(ends)), *(batch.column(c).values.to_numpy()[ends[0] : ends[-1]] for c in columns)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, e = flat(batch, "gone")
            yield listed(*_tally(g, e, np.ones(len(e), np.int64)))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the last group so far
        for batch in batches:
            g, ends, e, f = _tally(*(np.concatenate(x) for x in zip(held, flat(batch, "e", "f"), strict=True)))
            if len(g):
                last = ends[-2]
                held = [np.full(len(e) - last, g[-1]), e[last:], f[last:]]
                yield kept(g[:-1], ends[:-1], e[:last], f[:last])
        yield kept(*_tally(*held))

    def kept(g: np.ndarray, ends: np.ndarray, e: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        owner = np.repeat(g, np.diff(ends))
        return listed(*_tally(owner[f > 1], e[f > 1], f[f > 1]))

    schema = "g long, e array<long>, f array<long>"
    parts = rows.select("g", "gone").mapInArrow(counted, schema)
    return parts.repartition("g").sortWithinPartitions("g").mapInArrow(merged, schema).select("g", F.arrays_zip("e", "f").alias("lost"))


def _shared(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, id, own): of the elements that members (g, id, new) have beside their centre's those that several of the group have: (e, f).

    A group's elements are dealt by hash to slices of some SLICE elements. A task sends its members' elements of a slice as one row,
    and each slice is counted whole, so rows do not grow with the members' differences, and a group of any size is as many tasks.
    """
    sizes = rows.groupBy("g").agg(F.sum(F.size("new")).alias("all"))
    slices = scratch.written(sizes.where("all > 0").select("g", F.ceil(F.col("all") / F.lit(SLICE)).alias("n")), "slices")

    def row(g: np.ndarray, part: np.ndarray, ids: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((part, g))
        g, part, ids, e = g[order], part[order], ids[order], e[order]
        heads = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (part[1:] != part[:-1])])) if len(g) else np.zeros(0, np.int64)
        ends = pa.array(np.append(heads, len(g)), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(g[heads]), pa.array(part[heads]), *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (ids, e))], names=["g", "part", "ids", "e"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = batch.column("new")
            n = np.diff(new.offsets.to_numpy())
            e = new.values.to_numpy()[new.offsets[0].as_py() : new.offsets[len(new)].as_py()]
            g, ids, of = (np.repeat(batch.column(c).to_numpy(), n) for c in ("g", "id", "n"))
            yield row(g, (mix(e.view(np.uint64)) % of.astype(np.uint64)).astype(np.int64), ids, e)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def done() -> pa.RecordBatch:
            ids, e = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in (0, 1))
            _, at, f = np.unique(e, return_inverse=True, return_counts=True)
            f = f[at] if len(e) else np.zeros(0, np.int64)
            ids, e, f = ids[f > 1], e[f > 1], f[f > 1]
            order = np.argsort(ids, kind="stable")
            ids, e, f = ids[order], e[order], f[order]
            heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
            pairs = pa.StructArray.from_arrays([pa.array(e), pa.array(f.astype(np.int64))], names=["e", "f"])
            own = pa.ListArray.from_arrays(pa.array(np.append(heads, len(ids)), pa.int32()), pairs)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), last[0] if last else 0, np.int64)), pa.array(ids[heads]), own], names=["g", "id", "own"])

        for batch in batches:
            columns = zip(batch.column("g").to_pylist(), batch.column("part").to_pylist(), batch.column("ids"), batch.column("e"), strict=True)
            for g, part, ids, e in columns:
                if (g, part) != last:
                    if held:
                        yield done()
                    last, held = (g, part), []
                held.append((ids.values.to_numpy(), e.values.to_numpy()))
        yield done()

    parts = rows.join(sized(slices), "g").select("g", "id", "n", "new").mapInArrow(dealt, "g long, part long, ids array<long>, e array<long>")
    found = parts.repartition("g", "part").sortWithinPartitions("g", "part").mapInArrow(counted, "g long, id long, own array<struct<e:bigint,f:bigint>>")
    return found.groupBy("g", "id").agg(F.flatten(F.collect_list("own")).alias("own"))  # at most D itself


def _finer(members: DataFrame, sizes: DataFrame, t: int, scratch: Scratch) -> DataFrame:
    """(key, id) of the next buckets, from the members (g, id, comp, room, gone, new) of groups and the groups' sizes (g, b).

    How many members lack an element of the centre is one list a group, counted in the tasks, which its members look their elements
    up in; elements that the centre lacks are counted in slices, see ``_shared``.
    """
    best = members.groupBy("g", "comp").agg(F.max(F.struct("room", (-F.col("id")).alias("o"))).alias("best"))
    best = scratch.written(best, "best")
    top = scratch.written(best.groupBy("g").agg(F.max_by("comp", "best").alias("main"), F.max("best.room").alias("room_in")), "top")
    others = best.join(sized(top), "g").where("comp <> main").groupBy("g", "main", "room_in").agg(F.max("best.room").alias("room_out"))
    open_ = scratch.written(others.join(sizes, "g"), "open")
    partner = F.when(F.col("comp") == F.col("main"), F.col("room_out")).otherwise(F.col("room_in"))
    need = F.greatest(F.lit(1), F.ceil(-(F.col("room") + partner) / (2.0 * (100 + t)) - 1e-9)).cast("int")
    rows = members.join(sized(open_), "g").withColumn("n", F.size("gone") + F.size("new"))
    rows = rows.select("g", "id", "b", "n", (F.col("n") - need + 1).alias("first"), "gone", "new").where("first > 0")
    lost = _fitting(scratch.written(_lacked(rows), "lost"), "lost")  # a group's list is at most its centre
    own = _shared(rows.select("g", "id", "new"), scratch)
    none = F.array().cast("array<struct<e:bigint,f:bigint>>")
    rows = rows.drop("new").join(lost, "g", "left").join(own, ["g", "id"], "left").withColumns({c: F.coalesce(c, none) for c in ("lost", "own")})
    return _beginnings(rows).select("id", "g", F.explode("keys").alias("e")).select(F.xxhash64("g", "e").alias("key"), "id").distinct()


def similar(docs: DataFrame, n: int, t: int, sub: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row: its component in the graph of pairs of at least t percent similarity."""
    if not 30 <= t <= 100:
        raise ValueError("t is a percentage from 30 to 100")
    own = ["n", "f1", "f2"]
    with Scratch() as scratch:
        made = scratch.written(signed(docs, n, t, sub, key, text), "signed")
        rows = scratch.written(made.drop("sigs"), "rows")
        live = made.where("n > 0 and id is not null")
        classes = rows.where("n > 0 and id is not null").groupBy(*own).agg(F.min("id").alias("rep"))
        both = rows.where("id is not null").groupBy("id").agg(F.min(F.struct(*own)).alias("x"), F.max(F.struct(*own)).alias("y")).where("x <> y").select("id")
        several = scratch.written(both, "several")
        repeats = not several.isEmpty()
        if repeats:
            marked = classes.join(several.select(F.col("id").alias("rep"), F.lit(True).alias("many")), "rep", "left")
            classes = marked.select(*own, "rep", F.when(F.col("many"), F.xxhash64("rep", *own)).otherwise(F.col("rep")).alias("id"))
        else:
            classes = classes.withColumn("id", F.col("rep"))
        classes = scratch.written(classes, "classes")
        spare = rows.where("n > 0 and id is not null").select("id").distinct().join(classes.select(F.col("rep").alias("id")), "id", "left_anti")
        single = live.select("id", "sigs").join(sized(scratch.written(spare, "spare")), "id", "left_anti")
        if repeats:
            docs = scratch.written(keyed(docs, several, classes, n, key, text), "keyed")
            again = live.join(several, "id", "left_semi").select(F.col("id").alias("rep"), *own, "sigs").join(classes, ["rep", *own]).select("id", "sigs")
            single = single.join(several, "id", "left_anti").unionByName(again)
        single = single.select("id", F.explode("sigs").alias("key"))
        shared = scratch.written(single.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "shared")
        held = single.join(shared, "key").groupBy("id").agg(F.collect_set(F.struct("m", "key")).alias("x"))  # at most a set's own signatures
        held = held.join(classes.select("id", "n"), "id")
        rare = scratch.written(_kept(held, t, sub), "rare")
        scratch.drop(made, shared)
        roots = _linked(rare, docs, n, t, key, text, scratch)

        named = classes.join(roots.select(F.col("node").alias("id"), "root"), "id", "left") if roots is not None else classes.withColumn("root", F.lit(None).cast("long"))
        named = named.withColumn("root", F.coalesce("root", "id"))
        if repeats:  # a root may be a class's key
            named = scratch.written(named, "roots")
            least = scratch.written(named.groupBy("root").agg(F.min("rep").alias("component")), "least")
            named = named.join(least, "root")
        else:
            named = named.withColumn("component", F.col("root"))
        named = scratch.written(named.select(*own, "component"), "named")
        out = rows.join(named, own, "left")
        return written(out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id")), "similar")


def _linked(rare: DataFrame, docs: DataFrame, n: int, t: int, key: str, text: str, scratch: Scratch) -> DataFrame | None:
    """(node, root) of all representatives that some similar pair joins; None if there is no pair. ``rare``: (id, n, keys)."""
    buckets = rare.select("id", F.explode("keys").alias("key"))
    again = scratch.written(buckets.groupBy("key").count().where("count > 1").select("key"), "again")
    buckets = scratch.written(buckets.join(sized(again), "key").distinct(), "buckets")
    nodes = scratch.written(buckets.join(rare.select("id", "n"), "id").groupBy("id", "n").agg(F.count("*").alias("rank")), "nodes")
    sets = scratch.written(sets_of(docs, nodes.select("id"), n, key, text).groupBy("id").agg(F.first("s").alias("s"), F.first("bits").alias("bits")), "sketched")
    sets, sketches = sets.select("id", "s"), sets.select("id", "bits")
    scratch.drop(rare, again)
    alike = f"least(n, n_p) * 100 >= greatest(n, n_p) * {t}"
    unlike = " + ".join(f"bit_count(bits[{i}] ^ bits_p[{i}])" for i in range(SKETCH // 64))
    near = f"({unlike}) * {100 + t} <= (n + n_p) * {100 - t}"
    comp, roots, turn = nodes.withColumn("comp", F.col("id")), None, 0
    while True:
        with Scratch() as here:
            inside = buckets.join(sized(comp), "id")
            lead, low, high = F.max(F.struct("rank", (-F.col("id")).alias("o"), "n")), F.min("comp").alias("low"), F.max("comp").alias("high")
            whole = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (0, 1)]  # tells which members there are
            stats = inside.groupBy("key").agg(F.count("*").alias("members"), lead.alias("lead"), low, high, *whole).where("low < high")
            stats = stats.groupBy("members", "x0", "x1").agg(F.min("key").alias("key"), F.max("lead").alias("lead"))
            stats = here.written(stats.select("key", "members", (-F.col("lead.o")).alias("p"), F.col("lead.n").alias("n_p")), "stats")
            if stats.isEmpty():
                return roots
            inside = here.written(inside.join(sized(stats), "key"), "inside")
            star = inside.where(f"p <> id and {alike}")
            large = None
            if turn > 0:
                small = here.written(inside.where(F.col("members") <= FEW).select("key", "id", "n", "comp").join(sketches, "id"), "small")
                other = small.select("key", F.col("id").alias("p"), F.col("n").alias("n_p"), F.col("comp").alias("comp_p"), F.col("bits").alias("bits_p"))
                listed = small.join(other, "key").where(f"p < id and comp <> comp_p and {alike} and {near}").select("p", "id")
                star = star.where(F.col("members") > FEW).select("p", "id").unionByName(listed)
                label = F.col("p") if turn == 1 else F.col("key")
                groups = here.written(inside.where(F.col("members") > FEW).select(label.alias("g"), "id").distinct(), "groups")
                if not groups.isEmpty():
                    if turn == 1:
                        groups = _merged(groups, nodes, here)
                    large = here.written(_spread(groups, sets, t, here), "large")
                    middle = large.groupBy("g").agg(F.max(F.struct("room", (-F.col("id")).alias("o")))["o"].alias("o"), F.count("*").alias("b"))
                    middle = here.written(middle.select("g", (-F.col("o")).alias("p"), "b"), "middle")
                    star = star.unionByName(large.select("g", "id").join(sized(middle), "g").where("p <> id").select("p", "id"))
            pairs = here.written(star.select("p", "id").distinct(), "pairs")
            new = here.written(_verified(pairs, sets, t), "tests")
            if not new.isEmpty():
                links = new if roots is None else new.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
                joined = components(links, scratch)
                after = nodes.join(joined.select(F.col("node").alias("id"), "root"), "id", "left")
                after = scratch.written(after.select("id", "n", "rank", F.coalesce("root", "id").alias("comp")), "comp")
                if roots is not None:
                    scratch.drop(comp, roots)
                roots, comp = joined, after
            if turn == 0:
                after = inside.select("key", "id")
            elif large is None:
                return roots
            else:
                after = _finer(large.join(sized(comp).select("id", "comp"), "id"), middle.select("g", "b"), t, here)
            after = scratch.written(after, "buckets")
            scratch.drop(buckets)
            buckets, turn = after, turn + 1


def _merged(groups: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, id) in which a group whose lead is itself in groups of leads ranked higher joins the highest one's."""
    ranks = nodes.select(F.col("id").alias("g"), "rank")
    leads = groups.join(groups.select(F.col("g").alias("id")).distinct(), "id", "left_semi").join(ranks, "g")
    highest = leads.groupBy("id").agg(F.max(F.struct("rank", (-F.col("g")).alias("o")))["o"].alias("o"))
    highest = scratch.written(highest.select(F.col("id").alias("g"), (-F.col("o")).alias("top")), "highest")
    return scratch.written(groups.join(sized(highest), "g", "left").select(F.coalesce("top", "g").alias("g"), "id").distinct(), "merged")


def deduplicated(docs: DataFrame, n: int = 5, t: int = 80, sub: int = 2) -> DataFrame:
    """``docs`` with one document of each component, that of the smallest doc_id; all columns kept.

    Rows with a null id stay. An id that repeats is one document: it stays if one of its rows does, as one row for each
    different text.
    """
    found = similar(docs, n, t, sub)
    winners = found.where("id = component_id")
    lost = written(found.where("id <> component_id").select("id").join(winners.select("id"), "id", "left_anti").distinct(), "lost")
    repeats = written(winners.groupBy("id").count().where("count > 1").select("id"), "repeats")
    small = F.broadcast(lost) if lost.count() <= SMALL_IDS else lost
    kept = docs.join(small, docs["doc_id"] == small["id"], "left_anti")
    if repeats.isEmpty():
        return kept
    again = kept.join(repeats, kept["doc_id"] == repeats["id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeats, kept["doc_id"] == repeats["id"], "left_anti").unionByName(again)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by 3-word shingles at 90 percent."""
    out = similar(table(spark, sf_dir, "documents"), n=3, t=90)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
