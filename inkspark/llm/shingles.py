"""Words and word shingles of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Words are maximal runs of bytes other than space and tab to carriage return, after A-Z are lower-cased.
A word's fingerprint is a polynomial over random values of its bytes (mod 2**64), finished by a mixer, and a
shingle's is a mixed combination of its words' fingerprints: equal texts give equal values in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
with np.errstate(over="ignore"):
    _BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95))
    _BYTE[0x41:0x5B] = _BYTE[0x61:0x7B]
    _PLACE = _mix(np.arange(1, 65, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(0, _U), np.ones(0, _U))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        tables = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, _U)
            steps[0] = 1
            tables.append(np.cumprod(steps, dtype=_U))
        _powers = (tables[0], tables[1])
    return _powers[0][:n], _powers[1][:n]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: the first row's number, their bytes and the rows' offsets. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, data = column.buffers()
    ends = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(ends, ends[row] + limit, "right")) - 1)
        yield row, raw[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row]
        row = stop


def words(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each row's words begin (one more entry than rows)."""
    inside = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[ends] = True
    before = np.empty(len(raw), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(raw), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    stops = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, stops, np.searchsorted(starts, ends)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A fingerprint of each word, the same wherever it stands."""
    up, down = _power_tables(len(raw))
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_BYTE[raw] * up, out=sums[1:])
    return _mix((sums[stops] - sums[starts]) * down[starts]) if len(starts) else np.zeros(0, _U)


def shingles(hashes: np.ndarray, rows: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all `width`-word shingles in order, and where each row's begin.

    A row with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    counts = np.diff(rows)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(made)])
    at = np.repeat(rows[:-1] - first[:-1], made) + np.arange(first[-1])
    out = np.zeros(len(at), _U)
    if len(at):
        short = np.repeat(counts, made)
        padded = np.concatenate([hashes, np.zeros(width, _U)])
        for j in range(width):
            part = padded[at + j] * _PLACE[j]
            if (counts < width).any():
                part[short <= j] = 0
            out += part
        out = _mix(out + np.minimum(short, width).astype(_U) * _PLACE[-1])
    return out, first


def shingle_sets(column: pa.Array | pa.ChunkedArray, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle fingerprints of each row, in the rows' order."""
    for _, raw, ends in slices(column):
        starts, stops, rows = words(raw, ends)
        made, first = shingles(word_hashes(raw, starts, stops), rows, width)
        for i in range(len(first) - 1):
            yield np.unique(made[first[i] : first[i + 1]])


def fold(values: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit fingerprints of a set of values."""
    a = int(_mix(values + _U(0x2545F4914F6CDD1D)).sum(dtype=_U)) if len(values) else 0
    b = int(_mix(values ^ _U(0x9FB21C651E98DF25)).sum(dtype=_U)) if len(values) else 0
    return a - (a >> 63 << 64), b - (b >> 63 << 64)
