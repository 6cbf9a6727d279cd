"""A minimal perfect hash of distinct 64-bit keys, built in shards by Spark (used by operator 12).

Keys are dealt to shards by a hash. In a shard, level after level, the keys that are left hash into
a bit array of ``GAMMA`` bits a key; a bit is set where exactly one key fell, and the others go to
the next level. A key's number is the rank of its bit among all set bits of its shard, so the n keys
of a shard have the numbers 0 to n-1. The keys are stored in that order: a look-up verifies them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.llm.kernels import mix

GAMMA = 1.5
SHARD_KEYS = 1 << 15
_SALT = 0x9E3779B97F4A7C15

INDEX = "shard int, n long, sizes array<long>, bits binary, keys binary"


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    return mix(keys.astype(np.uint64) * np.uint64(2) + np.uint64(_SALT * (2 * level + 1) % 2 ** 64))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_hash(keys, 63) % np.uint64(shards)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes of the levels, their bits one after the other, and the keys in the order of their numbers."""
    left, sizes, bits, order = keys, [], [], []
    while len(left):
        size = max(8, int(GAMMA * len(left)))
        at = (_hash(left, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        placed = alone[at]
        order.append(left[placed][np.argsort(at[placed])])
        sizes.append(size)
        bits.append(alone)
        left = left[~placed]
    return sizes, np.concatenate([*bits, np.empty(0, bool)]), np.concatenate([*order, np.empty(0, np.int64)])


def build_shards(distinct: DataFrame, key: str, shards: int) -> DataFrame:
    """One row per shard (``INDEX``) over the distinct, non-null values of the long column ``key``."""
    def deal(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard_of(keys, shards), pa.int32()),
                                              "key": pa.array(keys)})

    def run(table: pa.Table) -> pa.Table:
        keys = np.sort(table.column("key").to_numpy())
        sizes, bits, order = build(keys)
        return pa.table({"shard": table.column("shard")[:1], "n": pa.array([len(keys)], pa.int64()),
                         "sizes": pa.array([sizes], pa.list_(pa.int64())),
                         "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
                         "keys": pa.array([order.astype("<i8").tobytes()], pa.binary())})

    dealt = distinct.select(F.col(key).cast("long")).mapInArrow(deal, "shard int, key long")
    return dealt.groupBy("shard").applyInArrow(run, INDEX)


class PerfectHash:
    """Look-ups over some shards of one index (``rows``: dicts of ``INDEX``)."""

    def __init__(self, rows: list[dict], shards: int):
        self.shards = shards
        rows = sorted(rows, key=lambda r: r["shard"])
        self.ids = [r["shard"] for r in rows]
        levels = max((len(r["sizes"]) for r in rows), default=0)
        self.first = np.zeros(shards + 1, np.int64)  # number of a shard's first key
        self.size = np.zeros((levels, shards), np.int64)
        self.offset = np.zeros((levels, shards), np.int64)
        held, bits, n = 0, [], 0
        for r in rows:
            self.first[r["shard"]] = n
            n += r["n"]
            for level, size in enumerate(r["sizes"]):
                self.size[level, r["shard"]] = size
                self.offset[level, r["shard"]] = held
                held += size
            bits.append(np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=sum(r["sizes"])).astype(bool))
        self.count = n
        self.bits = np.concatenate([*bits, np.empty(0, bool)])
        self.rank = np.concatenate([[0], np.cumsum(self.bits, dtype=np.int32)])
        self.keys = np.concatenate([*[np.frombuffer(r["keys"], "<i8") for r in rows], np.empty(0, np.int64)])

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of every key; -1 for a key that is not among the shards' keys (verified)."""
        out = np.full(len(keys), -1, np.int64)
        shard, todo = shard_of(keys, self.shards), np.arange(len(keys))
        for level in range(len(self.size)):
            size = self.size[level, shard[todo]]
            todo, size = todo[size > 0], size[size > 0]
            if not len(todo):
                break
            at = self.offset[level, shard[todo]] + (_hash(keys[todo], level) % size.astype(np.uint64)).astype(np.int64)
            found = self.bits[at]
            out[todo[found]] = self.rank[at[found]]
            todo = todo[~found]
        known = out >= 0
        out[known] = np.where(self.keys[out[known]] == keys[known], out[known], -1)
        return out
