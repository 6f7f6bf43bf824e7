"""Vectorised work on Arrow text batches: words, rolling hashes, windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone and whole.
CHUNK = 1 << 20
#: The same for what takes many numbers a byte.
LESS = 1 << 18
_U = np.uint64
_rng = np.random.default_rng(20240501)
_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base^i modulo 2^64, for range_hash()."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def range_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the values in [start, end), equal for equal sequences wherever they stand."""
    return mix((pre[end] - pre[start]) * _power(_INVERSE, len(pre))[start] + (end - start).astype(np.uint64))


def batches(rows: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches to `most` bytes of text: (batch, bytes, offsets); a null text has no bytes."""
    for whole in rows:
        if not whole.num_rows:
            continue
        text = pc.fill_null(whole.column(whole.schema.get_field_index(column)), "").cast(pa.large_binary())
        offs = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        low = 0
        while low < len(text):
            high = max(low + 1, int(np.searchsorted(offs, offs[low] + most, "right")) - 1)
            yield whole.slice(low, high - low), data[offs[low] : offs[high]], offs[low : high + 1] - offs[low]
            low = high


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and per text the index of its first word (one more at the end)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offs] = True
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, offs: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word, and the index of each text's first word."""
    starts, ends, first = word_spans(data, offs)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    return range_hash(prefix(_CODE[_LOWER[data] if lower else data]), starts, ends), first


def byte_values(data: np.ndarray) -> np.ndarray:
    return _CODE[data]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values."""
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64, copy=False), pa.int64())


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
