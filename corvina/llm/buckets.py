"""Comparing rows within sorted buckets, a batch at a time and in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Groups up to SMALL are compared all at once by shifts; larger ones block by block.
SMALL = 8
BLOCK = 512

Columns = dict[str, np.ndarray]


def to_columns(batch: pa.RecordBatch) -> Columns:
    """Flat columns as arrays; a list column of one length for all rows as a matrix."""
    out = {}
    for name, col in zip(batch.schema.names, batch.columns, strict=True):
        if pa.types.is_list(col.type):
            flat = col.flatten().to_numpy(zero_copy_only=False)
            out[name] = flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)
        else:
            out[name] = col.to_numpy(zero_copy_only=False)
    return out


def _cat(parts: list[Columns]) -> Columns:
    parts = [p for p in parts if len(p["key"])]
    if len(parts) < 2:
        return parts[0] if parts else {"key": np.zeros(0, np.int64)}
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _take(c: Columns, which: np.ndarray | slice) -> Columns:
    return {k: v[which] for k, v in c.items()}


def whole_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[Columns, Columns]]:
    """Pairs (rows of whole groups of at most ``limit`` rows, rows of larger groups), from batches sorted by ``key``.

    A group that passes the limit is handed on row by row, never held.
    """
    carry: Columns = {"key": np.zeros(0, np.int64)}
    hot = None
    for batch in batches:
        c = _cat([carry, to_columns(batch)])
        key = c["key"]
        if not len(key):
            continue
        lead = int(np.searchsorted(key, hot, "right")) if hot is not None else 0
        large = [_take(c, slice(0, lead))]
        c, key = _take(c, slice(lead, None)), key[lead:]
        if len(key):
            hot = None
            last = int(np.searchsorted(key, key[-1]))
            carry, c = _take(c, slice(last, None)), _take(c, slice(0, last))
            if len(carry["key"]) > limit:
                hot = carry["key"][0]
                large.append(carry)
                carry = _take(carry, slice(0, 0))
            if last:
                start = np.flatnonzero(np.r_[True, key[1:last] != key[: last - 1]])
                size = np.diff(np.r_[start, last])
                over = np.repeat(size > limit, size)
                if over.any():
                    large.append(_take(c, over))
                    c = _take(c, ~over)
        else:
            carry = c
        yield c, _cat(large)
    yield carry, {"key": np.zeros(0, np.int64)}


def pairs(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within groups of at most SMALL rows of a sorted key, a shift at a time."""
    if len(key) < 2:
        return
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[start, len(key)])
    rest = np.repeat(size, size) - (np.arange(len(key)) - np.repeat(start, size)) - 1  # rows of its group after each
    i = np.flatnonzero((rest > 0) & (np.repeat(size, size) <= SMALL))
    for d in range(1, SMALL):
        i = i[rest[i] >= d]
        if not len(i):
            return
        yield i, i + d


def large_groups(key: np.ndarray) -> Iterator[slice]:
    """Slices of the groups of more than SMALL rows of a sorted key."""
    if not len(key):
        return
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    end = np.r_[start[1:], len(key)]
    for k in np.flatnonzero(end - start > SMALL):
        yield slice(int(start[k]), int(end[k]))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Component label (its least index) of 0..n-1 under the links, which come in pieces and aren't kept."""
    label = np.arange(n)
    for i, j in links:
        while len(i):
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while True:  # shorten chains, so that labels are roots again
                up = label[label]
                if (up == label).all():
                    break
                label = up
    return label


def blocks(n: int, compare: Callable[[slice, slice], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j that ``compare`` (a boolean matrix for two blocks of rows) holds for."""
    for a in range(0, n, BLOCK):
        for b in range(a, n, BLOCK):
            rows, cols = slice(a, min(n, a + BLOCK)), slice(b, min(n, b + BLOCK))
            i, j = np.nonzero(compare(rows, cols))
            i, j = i + a, j + b
            keep = i < j
            yield i[keep], j[keep]
