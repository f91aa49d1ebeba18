"""Words, shingles and set fingerprints of Arrow text columns, as numpy over the columns' bytes.

A word is a run of bytes other than space and 09-0D, with A-Z lower-cased. Words get a 64-bit
polynomial hash of randomly coded bytes, from one prefix sum over a passage; no Python object is
made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rowloom.llm.common import CHUNK_BYTES

_U = np.uint64
_BASE, _FOLD = _U(0x9E3779B97F4A7C15 | 5), _U(0xD6E8FEB86659FD93)
_CODES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FLAT = np.arange(256, dtype=np.uint8)
_FLAT[ord("A") : ord("Z") + 1] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        both = []
        for b in (int(_BASE), pow(int(_BASE), -1, 2**64)):
            p = np.full(size, _U(b))
            p[0] = _U(1)
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without copying them, and the rows' offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf, at


def passages(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one longer row."""
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end
        row = end


def words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words of a passage; at: its rows' offsets, from 0."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    inside = ~_SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[at[at <= len(buf)]] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_CODES[_FLAT[buf]] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def hash_words(texts: list[str]) -> np.ndarray:
    """The hashes of single words, as word_hashes() gives them."""
    buf, at = column_bytes(pa.array(texts, pa.string()))
    return word_hashes(buf, at[:-1], at[1:]) if len(texts) else np.zeros(0, np.uint64)


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted, and the rows' offsets among them.

    A row of fewer words has its whole sequence as one shingle; a row without words has none.
    """
    n = len(hashes)
    folds = np.multiply.accumulate(np.full(width, _FOLD))
    full = np.zeros(0, np.int64)
    if n >= width:
        full = np.flatnonzero(rows[: n - width + 1] == rows[width - 1 :])
    long = np.zeros(len(full), np.uint64)
    for k in range(width):
        long += hashes[full + k] * folds[k]
    count = np.bincount(rows, minlength=n_rows) if n else np.zeros(n_rows, np.int64)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    few = np.flatnonzero((count > 0) & (count < width))
    short = count[few].astype(np.uint64)
    for k in range(width - 1):
        has = count[few] > k
        short[has] += hashes[first[few[has]] + k] * folds[k]
    every, row = mix(np.concatenate((long, short))), np.concatenate((rows[full] if n else full, few))
    order = np.lexsort((every, row))
    every, row = every[order], row[order]
    keep = np.ones(len(every), bool)
    keep[1:] = (every[1:] != every[:-1]) | (row[1:] != row[:-1])
    every, row = every[keep], row[keep]
    return every, np.searchsorted(row, np.arange(n_rows + 1))


def text_sets(column: pa.Array, width: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, shingles, offsets) for passage after passage of a column."""
    buf, at = column_bytes(column)
    for a, b in passages(at, limit):
        part, local = buf[at[a] : at[b]], at[a : b + 1] - at[a]
        starts, ends, rows = words(part, local)
        shingles, offsets = shingle_sets(word_hashes(part, starts, ends), rows, b - a, width)
        yield a, b, shingles, offsets
