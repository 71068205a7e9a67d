"""Words of a batch of texts as numpy arrays over its UTF-8 bytes.

The Arrow buffers are used as they are: no Python string is made per word, so a batch costs a
few passes over its bytes. Work arrays are bounded by cutting batches into row ranges of about
`budget` bytes; a longer text is a range of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The six bytes that separate words: space and \x09 to \x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (xor-shift and multiply rounds)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    have = _tables.get("power")
    if have is None or len(have) < n:
        size = max(n, 2 * _CHUNK)
        for name, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["power"], _tables["inverse"]


def texts_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def ranges(batch: pa.RecordBatch, column: str = "text", budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """`batch` in row ranges of about `budget` bytes of text, one row at least; nothing is copied."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // budget
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end[:-1] &= ~inside[1:] | first[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def span_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and don't overlap."""
    out = np.empty(len(s), np.uint64)
    i = 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + _CHUNK, "right")))
        at, n = s[i], int(e[j - 1] - s[i])
        power, inverse = _powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTER[data[at : at + n]] * power[:n], out=total[1:])
        a, b = s[i:j] - at, e[i:j] - at
        out[i:j] = mix64((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out


def sort_rows(values: np.ndarray, bounds: np.ndarray) -> None:
    """Sort `values` in place within each row; bounds[i] to bounds[i + 1] is row i."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()


def counts_to_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each of `n` rows in an array whose entries belong to the sorted `rows`."""
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))]).astype(np.int64)
