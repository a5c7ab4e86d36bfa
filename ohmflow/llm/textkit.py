"""Vectorised text work on Arrow string columns, used inside Spark tasks.

Every helper works on the UTF-8 bytes of a slice of rows at once (numpy, no
per-word Python objects).  ``chunked`` bounds the bytes handled together, so a
task's memory depends on its longest text, never on its partition.

Hashes are 64-bit and depend on content alone (fixed seeds), so equal words
or windows get equal hashes on every executor and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (_rng.integers(0, 2**61, 8, dtype=np.uint64) * np.uint64(8) + np.uint64(5))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags, true inside the given inclusive byte ranges."""
    out = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        out[lo:hi + 1] = True
    return out


#: words of ``[^\x20\x09-\x0D]+``
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on text whose A-Z are lower-cased
ALNUM_LOWER = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: lower-cases A-Z, byte by byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: bytes that begin a code point
LEAD = ~byte_class((0x80, 0xBF))


def chunked(batches, column: str, max_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose ``column`` holds at most ``max_bytes`` bytes (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        i = 0
        while i < batch.num_rows:
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + max_bytes, side="right")))
            yield batch.slice(i, j - i)
            i = j


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows end to end, and row offsets into them; a null row is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    if bufs[2] is None or offs[-1] == offs[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(arr) + 1, dtype=np.int64)
    return np.frombuffer(bufs[2], dtype=np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``member`` bytes inside each row.

    Returns byte starts, byte ends (exclusive) and, per row, the index of its
    first run (one more entry than rows).
    """
    n = len(data)
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offs), dtype=np.int64)
    mask = member[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = mask[:-1]
    before &= ~edge[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = mask[1:]
    after &= ~edge[1:]
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def rows_of(first: np.ndarray) -> np.ndarray:
    """Row number of each run, from the ``first`` of ``spans``."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits (the splitmix64 finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n (kept for the next chunk)."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK_BYTES)
        c = int(_BASES[base])
        up, down = np.full(size, c, dtype=np.uint64), np.full(size, pow(c, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        got = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 2 * CHUNK_BYTES:                        # longer texts are rare: not kept
            _powers[base] = got
    return got


def sums0(x: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero."""
    out = np.zeros(len(x) + 1, dtype=x.dtype)
    np.cumsum(x, out=out[1:])
    return out


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] (order matters) for many ranges, from one prefix sum."""
    up, down = _power(base, len(values) + 1)
    p = sums0(values * up[:len(values)])
    h = (p[ends] - p[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Content hash of byte ranges (words, lines)."""
    return range_hash(_BYTE[data], starts, ends, 0)


def windows(first: np.ndarray, n: int) -> np.ndarray:
    """Start indices of all windows of n consecutive runs that stay inside one row."""
    total = int(first[-1])
    if total < n:
        return np.zeros(0, dtype=np.int64)
    last = np.repeat(first[1:], np.diff(first))          # end of each run's row
    i = np.arange(total)
    return i[i + n <= last]


def cover(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Flags of the positions inside at least one [start, end)."""
    d = np.zeros(size + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.subtract.at(d, ends, 1)
    return np.cumsum(d[:-1]) > 0


def per_row(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` (one per run) for each row."""
    p = sums0(flags.astype(np.int64))
    return p[first[1:]] - p[first[:-1]]


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray,
           keep: np.ndarray) -> list[bytes]:
    """Per row, its kept runs joined by one space."""
    n_rows = len(first) - 1
    if not len(starts):
        return [b""] * n_rows
    rows = rows_of(first)
    ks, ke, kr = starts[keep], ends[keep], rows[keep]
    if not len(ks):
        return [b""] * n_rows
    more = np.zeros(len(ks), dtype=bool)                   # another kept run follows in this row
    more[:-1] = kr[1:] == kr[:-1]
    out = data.copy()
    out[ke[more]] = 0x20                                   # the byte after such a run is a separator
    d = np.zeros(len(data) + 2, dtype=np.int8)
    d[ks] += 1
    d[ke + more] -= 1                                      # kept runs are disjoint even with their separator
    flat = out[np.cumsum(d[:len(data)]) > 0].tobytes()
    sizes = np.bincount(kr, weights=(ke - ks + more), minlength=n_rows).astype(np.int64)
    at = sums0(sizes)
    return [flat[at[i]:at[i + 1]] for i in range(n_rows)]
