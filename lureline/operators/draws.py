"""Sampled rows per cell, for fits of hundreds of trees that each draw their own rows (M9).

Rows with equal columns form a *cell*. A fit that sees a row only through its cell needs, per cell, the
number of rows that each tree drew: :func:`sampled_counts` counts them for all trees in one pass over the
rows. Its two kinds of draws are computed by the batch in numpy, bit for bit those of the row-wise forms:

* :class:`KeyedDraws`: ``keyed_uniform(f"{seed}-rows-{tree}", *keys) < share``;
* :class:`BaggedDraws`: what Spark ML draws for its trees (``BaggedPoint``), a generator per partition and
  tree that is asked once per row, in the order of the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most counts (cells x trees) that one process holds; a fit with more of them works on Spark's tables.
MOST_COUNTS = 10_000_000
#: Rows whose draws are computed together.
CHUNK = 16384


def _width(trees: int) -> int:
    """Columns of a table of draws: whole words of eight (``_add``)."""
    return -(-trees // 8) * 8


# ---- md5 of short texts, column-wise ---------------------------------------------------------------

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2 ** 32)) for i in range(64)]
_WORDS = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]
_START = tuple(np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))


def _md5_block(state, added, steps: int, rows: int):
    """One block of 64 bytes; ``added[i]`` is the word of step i plus its constant. In place: numpy's
    temporaries would cost as much as the sums."""
    a, b, c, d = (np.full(rows, x, np.uint32) if np.ndim(x) == 0 else x.copy() for x in state)
    f, g = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for i in range(steps):
        if i < 16:
            np.bitwise_xor(c, d, f), np.bitwise_and(f, b, f), np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f), np.bitwise_and(f, d, f), np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f), np.bitwise_xor(f, d, f)
        else:
            np.bitwise_not(d, f), np.bitwise_or(f, b, f), np.bitwise_xor(f, c, f)
        np.add(f, a, f), np.add(f, added[i], f)
        np.left_shift(f, np.uint32(_SHIFTS[i]), g), np.right_shift(f, np.uint32(32 - _SHIFTS[i]), f)
        np.bitwise_or(f, g, f), np.add(f, b, a)
        a, d, c, b = d, c, b, a
    return a, b, c, d


def _padded(texts: list[bytes], before: int, blocks: int) -> np.ndarray:
    """The texts, each behind ``before`` free bytes, padded as md5 asks, as words (word, row)."""
    size, end = 64 * blocks, lambda t: before + len(t)
    rows = b"".join(bytes(before) + t + b"\x80" + bytes(size - 9 - end(t)) + (8 * end(t)).to_bytes(8, "little") for t in texts)
    return np.ascontiguousarray(np.frombuffer(rows, "<u4").reshape(len(texts), -1).T)


def md5_heads(prefixes: list[bytes], texts: list[bytes]):
    """Per prefix the first 32 bits of the md5 of prefix + text, for every text."""
    prefix_sizes = sorted({len(p) for p in prefixes})
    out = [np.empty(len(texts), np.uint32) for _ in prefixes]
    with np.errstate(over="ignore"):
        for before in prefix_sizes:
            sizes = np.array([(before + len(t) + 8) // 64 + 1 for t in texts])
            for blocks in np.unique(sizes):
                at = np.flatnonzero(sizes == blocks)
                words = _padded([texts[i] for i in at], before, int(blocks))
                own = -(-before // 4)  # words that hold bytes of the prefix
                steps = [[words[16 * k + w] + _SINES[i] for i, w in enumerate(_WORDS)] for k in range(blocks)]
                for n, prefix in enumerate(prefixes):
                    if len(prefix) != before:
                        continue
                    head = np.frombuffer(prefix + bytes(-before % 4), "<u4")
                    state = _START
                    for k in range(blocks):
                        added = list(steps[k])
                        for i, w in enumerate(_WORDS):
                            if 16 * k + w < own:
                                added[i] = added[i] + head[16 * k + w]
                        # the last three steps of the last block do not touch the first word
                        last = k == blocks - 1
                        a, b, c, d = _md5_block(state, added, 61 if last else 64, len(at))
                        state = (b + state[0],) if last else (a + state[0], b + state[1], c + state[2], d + state[3])
                    out[n][at] = state[0].byteswap()
    return out


@dataclass(frozen=True)
class KeyedDraws:
    """``keyed_uniform(f"{seed}-rows-{tree}", *keys) < share``; the rows carry :meth:`text` of their keys."""
    seed: int
    share: float
    trees: int

    @staticmethod
    def text(keys) -> Column:
        """What follows the seed in the hashed text: each key that is not null behind a bar."""
        return F.concat_ws("|", F.lit(""), *[F.col(k).cast("string") for k in keys]).cast("binary")

    def start(self, partition: int):
        prefixes = [f"{self.seed}-rows-{t}".encode() for t in range(self.trees)]
        limit = math.ceil(self.share * 2 ** 32)

        def drawn(texts: list[bytes]) -> np.ndarray:
            out = np.zeros((len(texts), _width(self.trees)), bool)
            for t, head in enumerate(md5_heads(prefixes, texts)):
                out[:, t] = head < limit
            return out
        return drawn


# ---- Spark's XORShiftRandom ------------------------------------------------------------------------

_M32 = 0xFFFFFFFF


def _bytes_hash(data: bytes, seed: int) -> int:
    """``scala.util.hashing.MurmurHash3.bytesHash`` of whole words."""
    rotl = lambda x, r: ((x << r) | (x >> (32 - r))) & _M32
    h = seed
    for i in range(0, len(data), 4):
        k = int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & _M32
        h = (rotl(h ^ (rotl(k, 15) * 0x1B873593 & _M32), 13) * 5 + 0xE6546B64) & _M32
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & _M32
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & _M32
    return h ^ (h >> 16)


def hash_seed(seed: int) -> int:
    """``XORShiftRandom.hashSeed``."""
    data = (seed & (2 ** 64 - 1)).to_bytes(8, "big")
    low = _bytes_hash(data, 0x3C074A61)
    return _bytes_hash(data, low) << 32 | low


def _step(s: np.ndarray) -> np.ndarray:
    s = s ^ (s << np.uint64(21))
    s ^= s >> np.uint64(35)
    s ^= s << np.uint64(4)
    return s


def _apply(columns: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A linear map of 64 bits, given by the images of the single bits."""
    out = np.zeros_like(s)
    for i in range(64):
        out ^= np.where(s >> np.uint64(i) & np.uint64(1), columns[i], np.uint64(0))
    return out


@lru_cache(maxsize=None)
def _jump(steps: int) -> np.ndarray:
    """The map that ``steps`` steps of the generator amount to (a step is linear)."""
    if steps == 0:
        return np.uint64(1) << np.arange(64, dtype=np.uint64)
    if steps == 1:
        return _step(_jump(0))
    half = _jump(steps // 2)
    whole = _apply(half, half)
    return _apply(_jump(1), whole) if steps % 2 else whole


def uniform_from(seed: int):
    """``nextDouble`` of ``XORShiftRandom(seed)``, for few draws."""
    s, mask = hash_seed(seed), 2 ** 64 - 1

    def step():
        nonlocal s
        s ^= s << 21 & mask
        s ^= s >> 35
        s ^= s << 4 & mask
        return s
    while True:
        high = (step() & (2 ** 26 - 1)) << 27
        yield (high + (step() & (2 ** 27 - 1))) / 2 ** 53


@dataclass(frozen=True)
class BaggedDraws:
    """Spark ML's draws without replacement: tree t of partition k asks ``XORShiftRandom(seed + t + k + 1)``."""
    seed: int
    share: float
    trees: int
    lanes: int = 16

    def start(self, partition: int):
        state = np.array([hash_seed(self.seed + t + partition + 1) for t in range(self.trees)], np.uint64)
        limit, high, low = math.ceil(self.share * 2 ** 53), np.uint64(2 ** 26 - 1), np.uint64(2 ** 27 - 1)

        def drawn(rows: list) -> np.ndarray:
            nonlocal state
            size = -(-len(rows) // self.lanes)  # the rows are dealt to lanes; each starts where the one before ends
            starts = [state]
            for _ in range(self.lanes - 1):
                starts.append(_apply(_jump(2 * size), starts[-1]))
            s = np.stack(starts)
            out = np.zeros((self.lanes, size, _width(self.trees)), bool)
            for j in range(size):
                s = _step(s)
                first = (s & high) << np.uint64(27)
                s = _step(s)
                out[:, j, :self.trees] = (first | (s & low)) < limit
            state = _apply(_jump(2 * len(rows)), state)
            return out.reshape(self.lanes * size, -1)[:len(rows)]
        return drawn


# ---- counts per cell -------------------------------------------------------------------------------

class _Cells:
    """Numbers the distinct rows of record batches in the order they are met."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        codes, kinds = np.zeros(batch.num_rows, np.int64), 1
        for column in batch.columns:
            found = column.dictionary_encode(null_encoding="encode")
            if kinds * len(found.dictionary) >= 2 ** 62:
                codes = np.unique(codes, return_inverse=True)[1]
                kinds = batch.num_rows
            kinds *= len(found.dictionary)
            codes = codes * len(found.dictionary) + found.indices.to_numpy(zero_copy_only=False)
        _, first, number = np.unique(codes, return_index=True, return_inverse=True)
        rows = zip(*[c.to_pylist() for c in batch.take(pa.array(first)).columns])
        return np.array([self.numbers.setdefault(r, len(self.numbers)) for r in rows], np.int64)[number]


def _room(counts: np.ndarray, cells: int) -> np.ndarray:
    if cells <= len(counts):
        return counts
    return np.concatenate([counts, np.zeros((max(cells - len(counts), len(counts)), counts.shape[1]), np.int64)])


def _add(counts: np.ndarray, cells: np.ndarray, drawn: np.ndarray) -> None:
    """The drawn rows of each cell, added in words of eight trees: 255 rows at most, so no byte runs over."""
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    starts = np.concatenate([np.arange(a, b, 255) for a, b in zip(first, [*first[1:], len(cells)])])
    sums = np.add.reduceat(drawn[order].view(np.uint64), starts, axis=0).view(np.uint8)
    np.add.at(counts, cells[starts], sums[:, :counts.shape[1]])


def _cell_rows(cells: _Cells, counts: np.ndarray, names: list[str], schema: pa.Schema):
    rows = list(cells.numbers)
    for at in range(0, len(rows), 256):
        some = rows[at:at + 256]
        columns = [pa.array([r[i] for r in some], schema.field(n).type) for i, n in enumerate(names)]
        columns.append(pa.array([counts[at + i] for i in range(len(some))], pa.list_(pa.int64())))
        yield pa.RecordBatch.from_arrays(columns, names=[*names, "drawn"])


def fits_in_memory(rows: DataFrame, columns, trees: int) -> bool:
    """Whether the cells of these columns are few enough to be counted for all trees at once."""
    most = MOST_COUNTS // max(1, trees)
    return rows.select(*columns).distinct().limit(most + 1).count() <= most


def sampled_counts(rows: DataFrame, columns: list[str], draws, text: str | None = None) -> DataFrame:
    """``*columns, drawn``: one row per distinct combination of ``columns`` with the number of its rows that
    each tree drew. ``text`` names the column that the draws hash."""
    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("drawn", T.ArrayType(T.LongType()))])

    def count(batches):
        cells, counts = _Cells(), np.zeros((16, draws.trees), np.int64)
        drawn = draws.start(TaskContext.get().partitionId())
        met, texts, fields = [], [], None
        waiting = 0
        for batch in batches:
            fields = batch.schema
            met.append(cells.of(batch.select(columns)))
            texts.extend(batch.column(text).to_pylist() if text else [None] * batch.num_rows)
            waiting += batch.num_rows
            if waiting >= CHUNK:
                numbers = np.concatenate(met)
                whole = waiting - waiting % CHUNK
                counts = _room(counts, len(cells.numbers))
                for at in range(0, whole, CHUNK):
                    _add(counts, numbers[at:at + CHUNK], drawn(texts[at:at + CHUNK]))
                met, texts, waiting = [numbers[whole:]], texts[whole:], waiting - whole
        if waiting:
            counts = _room(counts, len(cells.numbers))
            _add(counts, np.concatenate(met), drawn(texts))
        if fields is not None:
            yield from _cell_rows(cells, counts, columns, fields)

    def merge(batches):
        cells, counts, fields = _Cells(), np.zeros((16, draws.trees), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            fields = batch.schema
            numbers = cells.of(batch.select(columns))
            counts = _room(counts, len(cells.numbers))
            np.add.at(counts, numbers, batch.column("drawn").flatten().to_numpy().reshape(-1, draws.trees))
        if fields is not None:
            yield from _cell_rows(cells, counts, columns, fields)

    wanted = rows.select(*columns, *([text] if text else []))
    return wanted.mapInArrow(count, schema).repartition(*columns).mapInArrow(merge, schema)
