"""Numpy kernels over the UTF-8 bytes of a few texts at a time.

All word patterns of this package exclude only ASCII characters, so splitting the
bytes is the same as splitting the characters.  Words never cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once (one text may be longer); keeps temporaries small.
PIECE_BYTES = (1 << 19) - 64

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (of lower-cased text)
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_TABLES: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_codes(seed: int) -> np.ndarray:
    key = ("codes", seed)
    if key not in _TABLES:
        _TABLES[key] = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed * 0x9E3779B9 + 1)) | U64(1)
    return _TABLES[key]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    have = _TABLES.get("powers")
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        if have is None:
            have = (np.ones(1, U64), np.ones(1, U64))
        out = []
        for table, base in zip(have, (_BASE, pow(_BASE, -1, 1 << 64))):
            while len(table) < size:
                table = np.concatenate([table, table * U64(pow(base, len(table), 1 << 64))])
            out.append(table)
        have = tuple(out)
        if size <= 1 << 20:
            _TABLES["powers"] = have
    return have


def texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and each row's end in them; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset: col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets[1:] - offsets[0]


def pieces(data: np.ndarray, ends: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, their bytes, their ends) of runs of whole texts of at most ``size`` bytes, or one longer text."""
    i, n, at = 0, len(ends), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, at + size, "right")))
        yield i, j, data[at: int(ends[j - 1])], ends[i:j] - at
        at, i = int(ends[j - 1]), j


def words(data: np.ndarray, ends: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each maximal run of bytes of ``kind`` within a text."""
    inside = kind[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = ends[:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(ends, starts, "right")


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(byte_codes(seed)[data] * up[: len(data)], out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U64))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive 64-bit values (order counts)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[width:] - sums[:n]) * down[:n])


def count_by_text(numbers: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(numbers, minlength=n)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... (count values) of each pair, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
