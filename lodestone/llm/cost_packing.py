"""Packing of tokenised documents into sequences of equal attention cost.

A document is its token ids and an end id. Whole runs of ``length`` ids from its start are sequences of their own; the rest, with
all shorter documents, is dealt by hash to groups of about ``GROUP`` sequences, whatever the input's size, so a group fits in a
task. In a group the cost of a piece of n ids is ``n + n * n / WIDTH``: linear layers and attention. Pieces go by falling cost to the
lowest-cost sequence that has room for them; those that fit nowhere are cut, and fill the sequences' rooms by rising cost. What is
left then is shorter than a sequence; it goes to one sequence for each binary digit of its length, as sequences at a power of two are not
padded. So nothing is padded at all, and a group has at most a few short sequences.

Token ids come from the vocabulary's own tokenizer; a Python worker remembers the words of its tasks, about ``CACHE`` that it
has seen once and as many that it has seen again.

Null and empty texts have the end id alone. Null and repeated ids and equal rows are packed row by row: a piece belongs to its row,
and ``start`` tells rows of one id apart only by their own counts. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.durable import Scratch, written
from lodestone.sources import table

LENGTH, END, GROUP = 1024, 0, 512
#: The number of ids at which attention costs as much as the linear layers.
WIDTH = 4096
CACHE = 1 << 18
#: Characters up to here are split here: their kinds are the same in all of Unicode's versions.
_LAST = 0x36F


def _kind(kind: str) -> str:
    """The characters up to _LAST of a general category, for a class of a pattern."""
    return "".join(re.escape(chr(c)) for c in range(_LAST + 1) if unicodedata.category(chr(c)).startswith(kind))


_L, _N, _S = _kind("L"), _kind("N"), "\t-\r \x85\xa0"
#: Byte-level vocabularies write a byte as itself where it is a visible character, and the others, in order, from U+0100 on.
_SEEN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {b: chr(b) for b in _SEEN} | {b: chr(0x100 + n) for n, b in enumerate(sorted(set(range(256)).difference(_SEEN)))}
# Fixed value: the split pattern of byte-level pre-tokenizers.
_UNITS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit numbers in bytes.

    With the usual byte-level pre-tokenizer no token crosses the units of its split pattern, so each different unit goes to the
    tokenizer's merges once and is remembered. Texts with the vocabulary's special tokens or letters beyond U+036F, where Unicode's versions
    may differ, and all texts of other vocabularies are given to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        shape = json.loads(self.tokenizer.to_str())
        kind = shape["pre_tokenizer"] or {}
        self.by_unit = kind.get("type") == "ByteLevel" and kind["use_regex"] and not kind["add_prefix_space"] and not shape["normalizer"] and not shape["post_processor"]
        special = [re.escape(t["content"]) for t in shape["added_tokens"]]
        self.odd = re.compile("|".join([f"[^\\x00-{chr(_LAST)}]", *special]))
        self.young: set[str] = set()  # units that have not been seen again since they were learned

    def _encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, units: set[str]) -> None:
        merged = self.tokenizer.model.tokenize
        for u in units:
            self.known[u] = array("I", [t.id for t in merged(u.encode().decode("latin-1").translate(_BYTES))]).tobytes()
        self.young |= units

    def encode(self, texts: list[str | None]) -> list[bytes]:
        rows = [_UNITS.findall(t) if self.by_unit and t and not self.odd.search(t) else None for t in texts]
        every = set().union(*(r for r in rows if r))
        self.young -= every
        new = every.difference(self.known)
        if len(self.young) + len(new) > CACHE:
            for u in self.young:
                del self.known[u]
            self.young = set()
            if len(self.known) > CACHE:
                self.known, new = {}, every
        self._learn(new)
        get = self.known.__getitem__
        return [b"".join(map(get, r)) if r is not None else self._encode(t) if t else b"" for t, r in zip(texts, rows, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each vocabulary in a Python worker; it lives as long as the worker, through many tasks."""
    return Encoder(path)


def tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(row, key, doc_tokens, start, length, ids_crc32, whole, ids): whole sequences without their ids, and each row's rest with them; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tail = encoder(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                rows, out = [], []
                for i, body in enumerate(known.encode(part.column(2).to_pylist())):
                    ids = body + tail
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        piece = ids[4 * start : 4 * (start + length)]
                        m = len(piece) // 4
                        rows.append(i)
                        out.append((n, start, m, crc32(piece), m == length, None if m == length else piece))
                columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.select([0, 1]).take(pa.array(rows, pa.int32())).columns, *columns], names=names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    names = ["row", key, "doc_tokens", "start", "length", "ids_crc32", "whole", "ids"]
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"row long, `{key}` {kind}, doc_tokens long, start long, length long, ids_crc32 long, whole boolean, ids binary")


def cost(n: np.ndarray | int, width: int = WIDTH) -> np.ndarray | float:
    """Linear layers and attention of a piece of n ids."""
    return n + n * n / width


def assign(lengths: list[int], length: int = LENGTH, width: int = WIDTH) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, ids, sequence, offset) for lengths in falling order, each under ``length``."""
    full, left = divmod(sum(lengths), length)
    room, paid, out, late = np.full(full, length), np.zeros(full), [], []
    for i, n in enumerate(lengths):
        fits = np.where(room >= n, paid, np.inf)
        s = int(fits.argmin()) if full else 0
        if full and room[s] >= n:
            out.append((i, 0, n, s, int(length - room[s])))
            room[s] -= n
            paid[s] += cost(n, width)
        else:
            late.append(i)
    bits = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    rooms = [(int(s), int(length - room[s]), int(room[s])) for s in np.argsort(paid, kind="stable") if room[s]] + [(full + j, 0, b) for j, b in enumerate(bits)]
    at = 0
    for i in late:
        start = 0
        while start < lengths[i]:
            s, offset, free = rooms[at]
            take = min(free, lengths[i] - start)
            out.append((i, start, take, s, offset))
            rooms[at] = s, offset + take, free - take
            start += take
            at += rooms[at][2] == 0
    return out


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of each row."""
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = docs.schema[key].dataType.simpleString()

    def one(rows: list[tuple]) -> pa.RecordBatch:
        """The pieces of one group's (group, key, doc_tokens, start, length, ids)."""
        out = []
        for i, start, n, s, offset in assign([r[4] for r in rows], length, width):
            g, _, total, before, _, ids = rows[i]
            out.append((rows[i][1], before + start, n, crc32(ids[4 * start : 4 * (start + n)]), total, 2 * (g << 20 | s), offset))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), [key_type, *[pa.int64()] * 6], strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # one group: about ``group`` sequences of ids
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != r[0]:
                    yield one(held)
                    held = []
                held.append(r)
        if held:
            yield one(held)

    from pyspark.sql.pandas.types import to_arrow_type

    key_type = to_arrow_type(docs.schema[key].dataType)
    with Scratch() as here:
        made = here.written(tokens(docs, path, key, text, length, end), "tokens")
        rest = made.where("not whole")
        total = rest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        groups = max(1, round(total / (length * group)))
        dealt = rest.select(F.pmod(F.xxhash64("row", "start"), F.lit(groups)).alias("group"), key, "doc_tokens", "start", "length", "ids", "row")
        dealt = dealt.repartition(F.col("group")).sortWithinPartitions("group", F.desc("length"), "row").drop("row")
        shared = dealt.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
        alone = made.where("whole").select(key, "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
        return written(alone.unionByName(shared), "packed")


def op13_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 ids of a byte-level vocabulary."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
