"""Small vectorised helpers that run inside Spark tasks on one Arrow batch at a time.

They only turn texts into hash arrays (numpy); partitioning, joining and grouping stay in Spark.
All hashes depend on content alone, so retries and partitioning never change them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15  # odd multiplier of the rolling polynomial
_SEED = 20240229

_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift-multiply), so that low and high bits are uniform."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``_MULT**i`` and its inverse modulo 2**64 for i <= n (kept per worker, grown on demand)."""
    have = _tables.get("pow")
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        inv = pow(_MULT, -1, 1 << 64)
        for name, base in (("pow", _MULT), ("inv", inv)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _tables[name] = np.multiply.accumulate(steps)
    return _tables["pow"], _tables["inv"]


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value per byte."""
    if "bytes" not in _tables:
        rng = np.random.Generator(np.random.PCG64(_SEED))
        _tables["bytes"] = rng.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    return _tables["bytes"]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[j]-P[i] = sum of values[i:j] * _MULT**position (modulo 2**64)."""
    power, _ = _powers(len(values))
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * power[:len(values)], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] that does not depend on the position."""
    _, inverse = _powers(len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


def gram_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Mixed hash of every run of ``k`` values."""
    n = len(prefix) - k
    if n <= 0:
        return np.empty(0, U64)
    _, inverse = _powers(len(prefix))
    return mix((prefix[k:] - prefix[:n]) * inverse[:n])


def _order_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Cheaper hash of every run of ``k`` values whose high bits order the runs at random."""
    n = len(prefix) - k
    if n <= 0:
        return np.empty(0, U64)
    _, inverse = _powers(len(prefix))
    out = prefix[k:] - prefix[:n]
    out *= inverse[:n]
    out ^= out >> U64(32)
    out *= U64(0xD6E8FEB86659FD93)
    return out


def gram_key(prefix: np.ndarray, k: int) -> np.ndarray:
    """The segment key that each run of ``k`` values gives as a minimal gram."""
    return mix(_order_hash(prefix, k))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values (block prefix and suffix minima)."""
    n = len(x)
    if n < w:
        return np.empty(0, x.dtype)
    pad = -n % w
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], ahead[w - 1:n])


def window_segments(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                    window: int, gram: int):
    """Maximal runs of windows that share their minimal gram.

    ``starts``/``ends`` delimit the items (documents or pieces) inside the hashed sequence; a
    window never crosses them. Every window of ``window`` values belongs to exactly one run, and
    equal windows have the same key (the hash of their minimal gram), wherever they stand.
    Returns key, first value and end of the run (the run's windows start at first .. end-window),
    and the item's index.
    """
    n = len(prefix) - 1
    empty = np.empty(0, np.int64)
    sized = (ends - starts) >= window
    if n < window or not sized.any():
        return np.empty(0, U64), empty, empty, empty
    if n >= 1 << 24:
        raise ValueError("hash at most 2**24 values at a time")
    hashes = _order_hash(prefix, gram)
    packed = (hashes & ~U64((1 << 24) - 1)) | np.arange(len(hashes), dtype=U64)
    least = sliding_min(packed, window - gram + 1)  # by window start
    valid = np.zeros(n + 2, np.int32)
    np.add.at(valid, starts[sized], 1)
    np.add.at(valid, ends[sized] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(valid[:len(least)]) > 0)
    chosen = least[at]
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    begin, end = at[first], at[last] + window
    key = mix(hashes[(chosen[first] & U64((1 << 24) - 1)).astype(np.int64)])
    item = np.searchsorted(starts, begin, side="right") - 1
    return key, begin, end, item


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column (null: empty), without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if column.null_count == 0 else \
        column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body, off


def doc_chunks(offsets: np.ndarray, limit: int):
    """Consecutive row ranges whose bytes stay near ``limit`` (a longer row stands alone)."""
    n = len(offsets) - 1
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(data: np.ndarray, row_offsets: np.ndarray):
    """Words ``[^\\x20\\x09-\\x0D]+`` of concatenated rows: starts, ends, first word per row."""
    gap = np.ones(len(data) + 2, bool)
    gap[1:-1] = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # a row starts here: no word runs across it
    edge[row_offsets[(row_offsets >= 0) & (row_offsets <= len(data))]] = True
    body = ~gap[1:-1]
    starts = np.flatnonzero(body & (gap[:-2] | edge[:-1]))
    ends = np.flatnonzero(body & (gap[2:] | edge[1:])) + 1
    rows = np.searchsorted(starts, row_offsets)
    return starts, ends, rows


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def blocks_at_space(data: np.ndarray, size: int = 1 << 20):
    """Cut a byte range into blocks of about ``size`` that end before a blank (never in a word)."""
    lo = 0
    while lo < len(data):
        hi = min(lo + size, len(data))
        while hi < len(data):
            gap = np.flatnonzero(_SPACE[data[hi:hi + 4096]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(hi + 4096, len(data))
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, row_offsets: np.ndarray):
    """64-bit hash of every word of concatenated rows, and the first word of each row."""
    if len(row_offsets) == 2 and len(data) > 1 << 21:  # one very long text: block by block
        blocks = list(blocks_at_space(data))
        if len(blocks) > 1:  # a single word of that length cannot be cut
            values = np.concatenate([word_hashes(data[a:b], np.array([0, b - a]))[0] for a, b in blocks])
            return values, np.array([0, len(values)])
    starts, ends, rows = word_bounds(data, row_offsets)
    return mix(range_hash(prefix_hash(byte_values()[data]), starts, ends)), rows


def pieces(start: int, end: int, window: int, size: int = 1 << 21):
    """Cover ``start:end`` by ranges that overlap so that every window lies in exactly one."""
    lo = start
    while lo < end:
        hi = min(lo + size + window - 1, end)
        yield lo, hi
        if hi == end:
            break
        lo += size
