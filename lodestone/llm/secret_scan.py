"""Secret scan with structural confirmation.

Patterns find candidates; what is reported beyond the plain patterns is first decoded and parsed:

- ``jwt``: three base64url parts whose first decodes to a JSON object with a text ``alg`` and whose second to a JSON object;
- ``pem``: a BEGIN/END block whose base64 body is a private-key encoding, or which its header lines call encrypted; line breaks
  may be written ``\\n``;
- ``der``: a private-key encoding in bare base64 or base64url, also wrapped over lines or behind other characters of the run;
- ``hexkey``: a bare hexadecimal run that decodes to a private-key encoding.

A private-key encoding is DER whose nested lengths fill their parents exactly and whose outer sequence has the shape of a
PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or DSA private key, or the OpenSSH container, whose fields must end where the data
ends. Public keys are no secrets and are not reported.

Plain kinds, leftmost and non-overlapping per kind: ``assign`` (a credential name, a sign, a value of 8 or more characters),
``access`` (an access key id of 16 or more), ``hex`` (32 or more hexadecimal digits). Spans are in code points, end
exclusive. Null text counts as empty; every row gives one row, repeated rows and null ids too; long texts are scanned whole;
extra columns are not carried.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import table

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem", "der", "hexkey")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # runs are maximal, so this is "runs, then drop the short ones"
_JWT = re.compile(r"e[w-z0-3][A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")  # an opening brace is e and one of these in base64
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]*KEY)-----")
_B64_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:(?:\r?\n|\\r\\n|\\n)[A-Za-z0-9+/_-]+)*")
_B64_CHAR = re.compile(r"(?:\r?\n|\\r\\n|\\n)|([A-Za-z0-9+/_-])")
_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjE")  # a DER sequence or the OpenSSH mark
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_URL_SAFE = str.maketrans("-_", "+/")
_MARK = b"openssh-key-v1\0"


def _decoded(text: str) -> bytes | None:
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """(length, where the value begins) of the DER element whose length stands at ``at``."""
    if at >= len(data):
        return None
    n = data[at]
    if n < 0x80:
        return n, at + 1
    k = n & 0x7F
    if not 1 <= k <= 4 or at + 1 + k > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + k], "big"), at + 1 + k


def _tlvs(data: bytes, depth: int = 0) -> list | None:
    """The DER elements that fill ``data`` exactly, as (tag, value or children); None if a length does not fit."""
    out, at = [], 0
    while at < len(data):
        got = _length(data, at + 1)
        if got is None or got[1] + got[0] > len(data):
            return None
        tag, value = data[at], data[got[1] : got[1] + got[0]]
        if tag & 0x20 and depth < 8:
            value = _tlvs(value, depth + 1)
            if value is None:
                return None
        out.append((tag, value))
        at = got[1] + got[0]
    return out


def _openssh_end(data: bytes) -> int | None:
    """Where the fields of an OpenSSH container end: cipher, key derivation, its options, the public keys, the private part."""
    at = len(_MARK)
    for field in range(4):
        if field == 3:
            if at + 4 > len(data):
                return None
            keys = int.from_bytes(data[at : at + 4], "big")
            at += 4
            if not 1 <= keys <= 64:
                return None
        for _ in range(keys + 1 if field == 3 else 1):
            if at + 4 > len(data):
                return None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            if at > len(data):
                return None
    return at


def is_key(data: bytes | None) -> bool:
    """Whether the bytes are a private-key encoding."""
    if not data or len(data) < 24:
        return False
    if data.startswith(_MARK):
        return _openssh_end(data) == len(data)
    if data[0] != 0x30:
        return False
    top = _tlvs(data)
    if not top or len(top) != 1 or not isinstance(top[0][1], list):
        return False
    parts = top[0][1]
    tags = [t for t, _ in parts]
    names = [isinstance(v, list) and bool(v) and v[0][0] == 0x06 for _, v in parts]  # sequences that begin with an object identifier
    pkcs1 = len(tags) >= 9 and set(tags[:9]) == {0x02}
    dsa = tags == [0x02] * 6
    pkcs8 = tags[:3] == [0x02, 0x30, 0x04] and names[1]
    encrypted = tags == [0x30, 0x04] and names[0]
    sec1 = tags[:2] == [0x02, 0x04] and parts[0][1] == b"\x01"
    return pkcs1 or dsa or pkcs8 or encrypted or sec1


def _need(head: bytes) -> int | None:
    """How many bytes an encoding that begins with ``head`` has, if it may be a private key in DER."""
    got = _length(head, 1)
    if head[0] != 0x30 or got is None or got[1] + 1 >= len(head) or head[got[1]] not in (0x02, 0x30):
        return None
    return got[0] + got[1]


def _bare_keys(text: str) -> Iterator[tuple[int, int]]:
    """The spans of private keys in runs of base64 or base64url, wrapped or not, wherever in the run they begin."""
    for run in _B64_RUN.finditer(text):
        where = [m.start(1) for m in _B64_CHAR.finditer(run[0]) if m[1]]
        packed = "".join(run[0][i] for i in where).translate(_URL_SAFE)
        at = 0
        while m := _START.search(packed, at):
            at = m.start() + 1
            if m[0][0] == "M":
                head = _decoded(packed[m.start() : m.start() + 24])
                need = _need(head) if head and len(head) == 18 else None
            else:
                data = _decoded(packed[m.start() : m.start() + (len(packed) - m.start()) // 4 * 4])
                need = _openssh_end(data) if data else None
            if not need:
                continue
            stop = m.start() + -(-need * 4 // 3)
            if stop <= len(packed) and is_key(_decoded(packed[m.start() : stop])):
                end = run.start() + where[stop - 1] + 1
                while end < len(text) and text[end] == "=" and (end - run.start() - where[stop - 1] - 1) < -need % 3:
                    end += 1
                yield run.start() + where[m.start()], end
                at = stop


def _pem_keys(text: str) -> Iterator[tuple[int, int]]:
    """The spans of BEGIN/END blocks of private keys."""
    for m in _BEGIN.finditer(text):
        stop, close = text.find("-----", m.end()), f"-----END {m[1]}-----"
        if stop < 0 or not text.startswith(close, stop):
            continue
        lines = re.sub(r"\\r\\n|\\n|\r", "\n", text[m.end() : stop]).split("\n")
        headers = [x for x in lines if ":" in x]
        body = "".join("".join(x.split()) for x in lines if ":" not in x).rstrip("=")
        data = _decoded(body)
        locked = data is not None and len(data) >= 24 and any("ENCRYPTED" in h for h in headers)
        if locked or is_key(data):
            yield m.start(), stop + len(close)


def is_token(text: str) -> bool:
    """Whether the text is a signed token: its header names an algorithm and its body is an object."""
    parts = text.split(".")
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(p + "=" * (-len(p) % 4))) for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def find(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, sorted. Cheap tests first leave most texts without a regex."""
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    longest = max(map(len, text.split()), default=0)
    if longest >= 32:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if longest >= 20 and "." in text:
        out += [(m.start(), 3, m.end()) for m in _JWT.finditer(text) if is_token(m[0])]
    blocks = list(_pem_keys(text)) if "KEY-----" in text else []
    out += [(a, 4, b) for a, b in blocks]
    if longest >= 40:
        out += [(a, 5, b) for a, b in _bare_keys(text) if not any(x <= a < y for x, y in blocks)]
    if longest >= 64:
        out += [(m.start(), 6, m.end()) for m in _HEX_RUN.finditer(text) if is_key(bytes.fromhex(m[0][: len(m[0]) // 2 * 2]))]
    return sorted(out)


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_confirmed, base_sha256, spans) of each row; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [find(t) if isinstance(t, str) else [] for t in batch["text"]]
            base = [[s for s in f if s[1] < len(BASE)] for f in found]
            yield pd.DataFrame({
                key: batch["key"],
                **{f"n_{name}": [sum(s[1] == k for s in b) for b in base] for k, name in enumerate(BASE)},
                "n_confirmed": [len(f) - len(b) for f, b in zip(found, base, strict=True)],
                "base_sha256": [hashlib.sha256(_line(b).encode()).hexdigest() for b in base],
                "spans": [_line(f) for f in found],
            })

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    out = rows.mapInPandas(run, f"`{key}` string, n_assign long, n_access long, n_hex long, n_confirmed long, base_sha256 string, spans string")
    return out.withColumn(key, F.col(key).cast(docs.schema[key].dataType))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scanned."""
    return scan(table(spark, sf_dir, "documents"))
