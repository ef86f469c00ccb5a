"""Vectorised text kernels on Arrow string columns.

All of them read the UTF-8 bytes of a whole record batch at once, in blocks of
bounded size, so that memory does not follow the number of rows in a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
SEGMENT = 1 << 18
UPPER48 = _U(0xFFFFFFFFFFFF0000)
_BASE = 0x9E3779B97F4A7C15 | 1


Batches = Iterator[pa.RecordBatch]
_CACHES: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """What an operator keeps between tasks of a worker; tasks of another operator empty it."""
    return _CACHES.setdefault(owner, {})


def _drop_others(owner: str) -> None:
    for name, held in _CACHES.items():
        if name != owner:
            held.clear()


def _give_back() -> None:
    """Return freed memory to the system: a worker that waits shares its executor's limit with the others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def tidied(run: Callable[[Batches], Batches], owner: str = "") -> Callable[[Batches], Batches]:
    """``run`` over batches, leaving no memory behind but the caches of its own operator."""

    def whole(batches: Batches) -> Batches:
        _drop_others(owner)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return whole


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    separator = np.zeros(256, dtype=bool)
    separator[[0x20, *range(0x09, 0x0E)]] = True
    value = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    return lower, separator, value


LOWER, IS_SPACE, _VALUE = _tables()
_VALUE = _VALUE[LOWER]  # hashing folds A-Z
_POW = np.ones(1, dtype=np.uint64)
_INV = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        inverse = pow(_BASE, -1, 1 << 64)
        size = max(n, SEGMENT + 1)
        with np.errstate(over="ignore"):
            made = []
            for factor in (_BASE, inverse):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                made.append(np.cumprod(steps, dtype=np.uint64))
            _POW, _INV = made
    return _POW, _INV


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (the murmur3 finaliser)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(33))
        x = x * _U(0xFF51AFD7ED558CCD)
        x = x ^ (x >> _U(33))
        x = x * _U(0xC4CEB9FE1A85EC53)
        return x ^ (x >> _U(33))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int, rows: int = 1 << 12) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and ``limit`` bytes, or of a single longer row."""
    start, n = 0, len(offsets) - 1
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + rows, n)
        yield start, end
        start = end


def _segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts before separators, so that no word is divided."""
    start, n = 0, len(data)
    while start < n:
        end = min(start + SEGMENT, n)
        if end < n and not IS_SPACE[data[end]]:
            back = np.flatnonzero(IS_SPACE[data[start:end]])
            if len(back):
                end = start + int(back[-1]) + 1
            else:
                step = end
                while step < n:
                    ahead = np.flatnonzero(IS_SPACE[data[step : step + SEGMENT]])
                    if len(ahead):
                        step += int(ahead[0])
                        break
                    step = min(step + SEGMENT, n)
                end = step
        yield start, end
        start = end


def hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all rows, with A-Z folded.

    Returns 64-bit hashes, first and past-last byte positions, and for each row
    the index of its first word (n+1 values).  A row's end also ends a word.
    """
    hashes, firsts, lasts = [], [], []
    edges = offsets[1:-1]
    for lo, hi in _segments(data):
        part = data[lo:hi]
        word = (part != 32) & ((part - np.uint8(9)) > 4)
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        a, b = np.searchsorted(edges, (lo, hi))
        cut = edges[a:b] - lo
        cut = cut[cut < len(part)]
        begin[cut] = word[cut]
        first = np.flatnonzero(begin)
        if not len(first):
            continue
        last = word.copy()
        last[:-1] &= ~word[1:]
        cut = cut[cut > 0] - 1
        last[cut] = word[cut]
        stop = np.flatnonzero(last) + 1
        power, inverse = _powers(len(part) + 1)
        with np.errstate(over="ignore"):
            run = np.zeros(len(part) + 1, np.uint64)
            term = np.take(_VALUE, part, mode="clip")
            term *= power[: len(part)]
            np.cumsum(term, out=run[1:])
            value = (run[stop] - run[first]) * inverse[first]
        hashes.append(value)
        firsts.append(first + lo)
        lasts.append(stop + lo)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    first = np.concatenate(firsts)
    return mix(np.concatenate(hashes)), first, np.concatenate(lasts), np.searchsorted(first, offsets)


def row_of(index: np.ndarray) -> np.ndarray:
    """Row numbers of the elements whose first indexes by row are given."""
    return np.repeat(np.arange(len(index) - 1), np.diff(index))


def shingles(hashes: np.ndarray, index: np.ndarray, width: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's word shingles, repeats included, and their first indexes.

    A row with fewer words than ``width``, but not none, has one shingle: all of them.
    """
    count = np.diff(index)
    have = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    out_index = np.concatenate([[0], np.cumsum(have)])
    start = np.repeat(index[:-1] - out_index[:-1], have) + np.arange(out_index[-1])
    used = np.repeat(np.minimum(count, width), have)
    with np.errstate(over="ignore"):
        out = np.full(len(start), _U(0x243F6A8885A308D3)) + used.astype(np.uint64)
        for k in range(width):
            here = used > k
            take = hashes[np.minimum(start + k, max(len(hashes) - 1, 0))] if len(hashes) else out
            out = np.where(here, mix(out * _U(3) + take + _U(k)), out)
    return out, out_index


def distinct_by_row(values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values cut to their upper 48 bits, and their first indexes.

    Rows are sorted together under one 64-bit key, the row number above the
    value's low bits; a row long enough for those bits to collide goes alone.
    """
    rows = len(index) - 1
    if not len(values):
        return values, index
    bits = max(rows - 1, 1).bit_length()
    if rows > 1 and (bits > 16 or np.diff(index).max() > 1 << 16):
        half = rows // 2
        a, ai = distinct_by_row(values[: index[half]], index[: half + 1])
        b, bi = distinct_by_row(values[index[half] :], index[half:] - index[half])
        return np.concatenate([a, b]), np.concatenate([ai, bi[1:] + ai[-1]])
    if rows == 1:
        out = np.unique(values) & UPPER48
        return out, np.array([0, len(out)])
    shift = _U(64 - bits)
    key = (row_of(index).astype(np.uint64) << shift) | (values >> _U(bits))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    starts = np.searchsorted(key, np.arange(rows, dtype=np.uint64) << shift)
    return (key << _U(bits)) & UPPER48, np.concatenate([starts, [len(key)]])
