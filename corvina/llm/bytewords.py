"""Vectorised word hashing over the UTF-8 bytes of a text, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes handled at once; a longer text goes in pieces cut between words, so memory stays bounded.
SPAN = 1 << 20

NOT_SPACE = bytes(x not in (9, 10, 11, 12, 13, 32) for x in range(256))
LETTER = bytes(65 <= x < 91 or 97 <= x < 123 or x >= 128 for x in range(256))

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << max(12, (n - 1).bit_length())
        _powers = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, BASE, np.uint64)], dtype=np.uint64)
        _inverse = np.cumprod(np.r_[np.uint64(1), np.full(size - 1, pow(BASE, -1, 1 << 64), np.uint64)], dtype=np.uint64)
    return _powers, _inverse


def segments(data: bytes, span: int = SPAN) -> Iterator[bytes]:
    """``data`` in pieces of about ``span`` bytes, cut at ASCII white space (a single longer word stays whole)."""
    at, n = 0, len(data)
    while n - at > span:
        cut = at + span
        while cut < n and NOT_SPACE[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def spans(data: bytes, inside: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that ``inside`` (a translation table to 0 or 1) holds for."""
    m = np.frombuffer(b"\0" + data.translate(inside) + b"\0", np.bool_)
    edge = np.flatnonzero(m[1:] != m[:-1])
    return edge[::2], edge[1::2]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; faster than ``np.unique`` on short integer arrays."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def running(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``between`` takes the hash of any run."""
    powers, _ = _power(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers[: len(values)], out=total[1:])
    return total


def between(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each run values[start:end]."""
    h = (total[ends] - total[starts]) * _inverse[starts]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``between`` over the runs of one array."""
    return between(running(values), starts, ends)
