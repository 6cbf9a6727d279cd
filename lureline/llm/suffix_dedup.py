"""Repeated byte strings by threshold-bounded interval expansion on a BWT (operator 8).

Texts are UTF-8 bytes. Every byte covered by a ``window``-byte string that also starts anywhere
else (same document included) is removed; matches never cross documents, overlaps count, and all
is judged on the input. :mod:`lureline.llm.repeats` deals the windows out to bounded shards by
content; each shard is decided here:

* suffixes of the shard's distinct segments (unique separators) are sorted by prefix doubling up to
  the threshold, which gives the Burrows-Wheeler transform and the backward step LF;
* common prefixes are derived breadth-first by increasing value: a boundary between neighbouring
  suffixes found at length ``l`` is extended backwards by every character whose interval spans it
  and fixes boundaries of length ``l + 1``; the expansion stops at the threshold, and every
  boundary without a value then has at least that length;
* the intervals left are the strings of threshold length; one that holds more than one occurrence
  (segments count as often as they occur in the corpus) is repeated.

Cases: null and empty texts have no bytes; rows that repeat an id are documents of their own, so
equal long rows remove each other; an empty table gives no rows; ``kept`` may cut a character in
the middle, ``kept_text`` drops such torn bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm import repeats
from lureline.llm.common import add_columns, keyed_rows

def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """First position of every suffix's group in the order by the first ``depth`` symbols or more.

    Symbol 0 is a separator, each one different from all others (by position). The first key packs
    as many symbols as 63 bits hold; every further round triples the sorted depth by joining the
    ranks of three neighbouring pieces (doubles it where ranks need more than 21 bits). Only groups
    of more than one suffix are sorted again.
    """
    n = len(text)
    joined, width = (3, 21) if n < 1 << 21 else (2, 31)
    used = np.zeros(int(text.max(initial=0)) + 1, bool)
    used[text] = True
    used[0] = True
    code = (np.cumsum(used) - 1).astype(np.int64)  # dense, in symbol order
    bits = max(1, int(code[-1]).bit_length())
    h = min(63 // bits, depth)
    dense = np.concatenate([code[text], np.zeros(h, np.int64)])
    key = dense[:n].copy()
    alive = dense[:n] != 0
    for k in range(1, h):
        symbol = dense[k:k + n] * alive
        key <<= bits
        key |= symbol
        alive &= symbol != 0
    order = np.argsort(key, kind="stable") if n < 64 else _stable(key)
    ordered = key[order]
    new = np.ones(n, bool)
    new[1:] = (ordered[1:] != ordered[:-1]) | ~alive[order[1:]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new.copy()
    alone[:-1] &= new[1:]
    active = order[~alone]
    while h < depth and len(active):
        key = rank[active].astype(np.int64)
        for k in range(1, joined):
            key <<= width
            key |= rank[np.minimum(active + k * h, n - 1)]
        by = np.argsort(key)
        active, key = active[by], key[by]
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        old = key >> (width * (joined - 1))
        first = np.ones(len(active), bool)
        first[1:] = old[1:] != old[:-1]
        i = np.arange(len(active))
        start = np.maximum.accumulate(np.where(new, i, 0))
        start -= np.maximum.accumulate(np.where(first, i, 0))
        rank[active] = old + start
        alone = new.copy()
        alone[:-1] &= new[1:]
        active = active[~alone]
        h *= joined
    return rank


def _stable(key: np.ndarray) -> np.ndarray:
    """Stable argsort: a fast sort, then ties put in the order of their positions."""
    order = np.argsort(key)
    tie = np.zeros(len(key) + 1, bool)
    tie[1:-1] = key[order[1:]] == key[order[:-1]]
    group = np.cumsum(~tie[:-1])
    inside = tie[:-1] | tie[1:]
    part = order[inside]
    order[inside] = np.sort((group[inside] << 32) | part) & ((1 << 32) - 1)
    return order


def repeated_starts(contents: list[bytes], counts, window: int) -> list[np.ndarray]:
    """Per content, one flag per window start: does the window occur more than once?"""
    sizes = np.array([len(c) for c in contents], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    text = np.zeros(int(begin[-1]), np.int16)
    raw = np.frombuffer(b"".join(contents), np.uint8)
    inside = np.ones(len(text), bool)
    inside[begin[1:] - 1] = False
    text[inside] = raw.astype(np.int16) + 1
    n = len(text)

    rank = suffix_ranks(text, window)
    suffix = np.sort((rank.astype(np.int64) << 32) | np.arange(n)).astype(np.int32)  # low half: position
    bwt = text[suffix - 1]  # the symbol before each suffix (the first suffix follows a separator)
    back = rank[suffix - 1]  # LF: group of the suffix extended by that symbol
    order = np.argsort(bwt, kind="stable").astype(np.int32)
    ordered = bwt[order]
    before = np.full(n, -1, np.int32)  # previous suffix with the same symbol before it
    before[order[1:]] = np.where(ordered[1:] == ordered[:-1], order[:-1], -1)
    can = (bwt != 0) & (before >= 0)
    near = before == np.arange(-1, n - 1, dtype=np.int32)
    near &= can
    far = np.flatnonzero(can & ~near).astype(np.int32)
    far_before = before[far]

    known = np.zeros(n, bool)
    head = text[suffix]
    edge = np.ones(n, bool)
    edge[1:] = (head[1:] != head[:-1]) | (head[1:] == 0)
    known[edge] = True
    frontier = np.flatnonzero(edge).astype(np.int32)  # boundaries with a common prefix of length 0
    for _ in range(window - 1):
        if not len(frontier):
            break
        reached = [back[frontier[near[frontier]]]]
        if len(far):
            if len(far) > n // 16:
                seen = np.zeros(n + 1, np.int32)
                seen[frontier + 1] = 1
                seen = np.cumsum(seen, dtype=np.int32)
                spans = seen[far + 1] > seen[far_before + 1]
            else:
                spans = np.searchsorted(frontier, far, side="right") > \
                    np.searchsorted(frontier, far_before, side="right")
            reached.append(back[far[spans]])
            far, far_before = far[~spans], far_before[~spans]
        found = np.concatenate(reached)
        found = np.sort(found[~known[found]])
        if len(found):  # ties of suffixes beyond the threshold may name a boundary twice
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        known[found] = True
        frontier = found
    interval = np.cumsum(known) - 1  # boundaries left unknown share at least ``window`` symbols
    owner = np.searchsorted(begin, suffix, side="right") - 1
    weight = np.bincount(interval, weights=np.asarray(counts)[owner], minlength=int(interval[-1]) + 1)
    flag = np.zeros(n, bool)
    flag[suffix] = weight[interval] > 1
    return [flag[b:b + max(0, s - window + 1)] for b, s in zip(begin[:-1].tolist(), sizes.tolist())]


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
          T.StructField("spans", SPANS), T.StructField("kept_sha256", T.StringType()),
          T.StructField("kept_text", T.StringType())]


def _remove(with_text: bool):
    def make(batch):
        sizes, removed, spans, digests, kept = [], [], [], [], []
        for text, own in zip(batch.column("text"), batch.column("_spans")):
            raw = (text.as_py() or "").encode("utf-8", "replace")
            runs = repeats.merge_spans((x["start"], x["end"]) for x in own.as_py() or ())
            edges = [0, *[e for run in runs for e in run], len(raw)]
            left = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
            sizes.append(len(raw))
            removed.append(len(raw) - len(left))
            spans.append([{"start": a, "end": b} for a, b in runs])
            digests.append(hashlib.sha256(left).hexdigest())
            kept.append(left.decode("utf-8", "ignore") if with_text else None)
        kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kinds),
                pa.array(digests, pa.string()), pa.array(kept, pa.string())]

    return make


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200,
                   gram: int = 64, shard_bytes: int = 1 << 18, heavy: int = 8000,
                   with_text: bool = True, rest: bool = False) -> DataFrame:
    """One row per document: ``<id>, text, n_bytes, n_removed, spans, kept_sha256, kept_text``.

    ``rest`` adds the input's other columns as the struct ``_rest``.
    """
    rows = keyed_rows(docs, id_col, text_col, rest).withColumnRenamed(text_col, "text")
    decide = lambda contents, counts: repeated_starts(contents, counts, window)
    seen, _, runs = repeats.repeated_runs(rows, "byte", window, gram, decide, False, shard_bytes, heavy)
    at = F.shiftright("pos", repeats.SIZE_BITS)
    copies = seen.join(runs.filter("n > 1").select("key", "seg", "a", "b"), ["key", "seg"]).select(
        "_rid", (at + F.col("a")).alias("start"), (at + F.col("b")).alias("end"))
    spans = repeats.unit_spans(runs.filter("n = 1")).unionByName(copies)
    return add_columns(repeats.with_spans(rows, spans), FIELDS, _remove(with_text)).drop("_spans", "_rid")
