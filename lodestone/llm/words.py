"""Vectorised hashes of words: bytes in, numpy arrays out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: A word is a run of other bytes than space and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
#: Bytes handled at once, cut at a space where there is one.
PIECE = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_BASE, 2 * PIECE + 2), _powers(_BACK, 2 * PIECE + 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """``data`` in parts of at most ``size`` bytes, cut after a space, or anywhere if a word is longer."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(c, at, at + size) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        cut = cut + 1 if cut > at else at + size
        yield data[at:cut]
        at = cut
    yield data[at:]


def _sums(data: bytes) -> tuple[np.ndarray, int, int]:
    """The sum of each word before the finaliser, and the lengths of the first and the last word."""
    b = np.frombuffer(data, np.uint8)
    edge = np.ones(len(b) + 2, bool)
    edge[1:-1] = IS_SPACE[b]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    start, end = at[::2], at[1::2]
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _POW[: len(b)], out=total[1:])
    n = (end - start)[[0, -1]].tolist() if len(at) else (0, 0)
    return (total[end] - total[start]) * _INV[start], *n


def _hashes(data: bytes) -> np.ndarray:
    return mix(_sums(data)[0])


def word_hashes(data: bytes) -> np.ndarray:
    """A uint64 for each word, in order; equal words have equal hashes wherever they stand.

    Exact up to 64-bit collisions. The sum of a word that a piece's end cuts is carried on to the next piece.
    """
    if len(data) <= PIECE:
        return _hashes(data)
    out, carried, length = [], 0, 0  # the unfinished word's sum and bytes
    for p in pieces(data):
        sums, first, last = _sums(p)
        if length and IS_SPACE[p[0]]:
            out.append(np.array([carried], np.uint64))
            length = 0
        if length:
            sums[0] = (carried + int(sums[0]) * pow(_BASE, length, 1 << 64)) % (1 << 64)
        whole = len(sums) == 1 and first == len(p)
        if IS_SPACE[p[-1]]:
            length = 0
        else:
            carried, length, sums = int(sums[-1]), last + (length if whole else 0), sums[:-1]
        out.append(sums)
    if length:
        out.append(np.array([carried], np.uint64))
    return mix(np.concatenate(out))


def shingle_set(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct uint64 hashes of the n-word shingles; with fewer words the whole sequence is one; empty without words."""
    w = word_hashes(data)
    if not len(w):
        return w
    n_ = min(n, len(w))
    m = len(w) - n_ + 1
    h = np.full(m, n_, np.uint64)
    for i in range(n_):
        h *= np.uint64(_BASE)
        h += w[i : i + m]
    h = np.sort(mix(h))
    new = np.ones(m, bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]
