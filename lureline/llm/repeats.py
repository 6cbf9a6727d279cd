"""Where do windows of a text occur more than once? The Spark side shared by operators 6 and 8.

A window is ``window`` consecutive units (words or bytes) of one document. All windows of the
corpus cannot meet in one index, so they are dealt out by content:

1. one scan cuts each document into segments: maximal runs of windows that share their minimal
   ``gram``-unit hash (a window's minimal gram depends on its content alone, so equal windows
   always get the same key, in any document and at any cluster size);
2. keys that occur once cannot hold a repeated window: one narrow count (combined map-side) and a
   semi-join that AQE may split leave the candidate segments, written to the shared folder;
3. equal segments collapse to their first occurrence and a count (combined map-side), so a passage
   copied a billion times travels once;
4. the distinct segments' contents are cut from the texts (one join by document) and grouped into
   bounded shards by key. A key with more than ``heavy`` distinct segments is split first: the
   windows left and right of the middle get keys of their own from the longer core that they
   share, again and again, until groups are small or the core is the window itself;
5. the operator's index (a suffix automaton, a Burrows-Wheeler transform) decides every shard and
   returns runs of windows per distinct segment; all occurrences of the segment inherit them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.llm import kernels as K
from lureline.llm.common import drop_scratch, scratch

CHUNK = 1 << 19
SIZE_BITS = 12  # a position packs (first unit, number of units) of a segment


def _values(data: np.ndarray, offsets: np.ndarray, unit: str):
    """Hash values of the units of concatenated texts and the first value of each text."""
    if unit == "word":
        return K.word_hashes(data, offsets)
    return None, offsets


def _segments(unit: str, window: int, gram: int):
    if 2 * window >= 1 << SIZE_BITS:
        raise ValueError(f"windows of at most {(1 << SIZE_BITS) // 2 - 1} units")

    def cut(values, rows, ids, data):
        """Segments of whole texts; a very long text is cut into overlapping pieces."""
        total = rows[-1] - rows[0]
        spans = [(int(rows[0]), int(rows[-1]))] if total <= 1 << 22 else \
            list(K.pieces(int(rows[0]), int(rows[-1]), window))
        for lo, hi in spans:
            part = values[lo:hi] if values is not None else K.byte_values()[data[lo:hi]]
            prefix = K.prefix_hash(part)
            edges = rows - lo if len(spans) == 1 else np.array([0, hi - lo])
            key, begin, end, item = K.window_segments(prefix, edges[:-1], edges[1:], window, gram)
            size = end - begin
            seg = K.mix(K.range_hash(prefix, begin, end) + size.astype(np.uint64))
            at = begin - edges[item] + (lo - int(rows[0]) if len(spans) > 1 else 0)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(key.astype(np.int64)), "seg": pa.array(seg.astype(np.int64)),
                "_rid": pa.array(ids[item]), "pos": pa.array((at << SIZE_BITS) | size)})

    def run(batches):
        for batch in batches:
            ids = batch.column("_rid").to_numpy(zero_copy_only=False)
            data, offsets = K.text_bytes(batch.column("text"))
            for i, j in K.doc_chunks(offsets, CHUNK):
                part = data[offsets[i]:offsets[j]]
                values, rows = _values(part, offsets[i:j + 1] - offsets[i], unit)
                yield from cut(values, rows, ids[i:j], part)

    return run


def candidates(rows: DataFrame, unit: str, window: int, gram: int) -> DataFrame:
    """``key, seg, _rid, pos`` of every segment whose key occurs more than once (steps 1, 2)."""
    found = scratch(rows.select("_rid", "text").mapInArrow(
        _segments(unit, window, gram), "key long, seg long, _rid long, pos long"), "cut")
    # written first: a join of two plain exchanges is one whose hot keys AQE can split
    often = scratch(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "often")
    out = scratch(found.join(often, "key", "left_semi"), "segments")
    drop_scratch(found, often)
    return out


def distinct_segments(occurrences: DataFrame) -> DataFrame:
    """``key, seg, n, _rid, pos``: equal segments once, at their first occurrence (step 3)."""
    return scratch(occurrences.groupBy("key", "seg").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("_rid", "pos")).alias("first"))
        .select("key", "seg", "n", "first._rid", "first.pos"), "distinct")


_CONTENT = "key long, seg long, n long, _rid long, pos long, skip long, content binary"


def contents(distinct: DataFrame, rows: DataFrame, unit: str) -> DataFrame:
    """The distinct segments with their bytes (words: joined by one blank)."""
    wanted = distinct.groupBy("_rid").agg(F.collect_list(F.struct("key", "seg", "n", "pos")).alias("s"))
    joined = rows.select("_rid", "text").join(wanted, "_rid")

    def run(batches):
        for batch in batches:
            data, offsets = K.text_bytes(batch.column("text"))
            ids = batch.column("_rid").to_pylist()
            lists = batch.column("s")
            flat, bounds = lists.flatten(), lists.offsets.to_numpy()
            bounds = bounds - bounds[0]
            key, seg, n, pos = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("key", "seg", "n", "pos"))
            for i, rid in enumerate(ids):
                text = data[offsets[i]:offsets[i + 1]]
                a, b = int(bounds[i]), int(bounds[i + 1])
                first = pos[a:b] >> SIZE_BITS
                last = first + (pos[a:b] & ((1 << SIZE_BITS) - 1))
                if unit == "word":
                    words = text.tobytes().split()  # ASCII white space only
                    body = [b" ".join(words[f:l]) for f, l in zip(first.tolist(), last.tolist())]
                else:
                    raw = text.tobytes()
                    body = [raw[f:l] for f, l in zip(first.tolist(), last.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key[a:b]), "seg": pa.array(seg[a:b]), "n": pa.array(n[a:b]),
                    "_rid": pa.array(np.full(b - a, rid)), "pos": pa.array(pos[a:b]),
                    "skip": pa.array(np.zeros(b - a, np.int64)), "content": pa.array(body, pa.binary())})

    return joined.mapInArrow(run, _CONTENT)


def _units(content: bytes, unit: str):
    return content.split(b" ") if unit == "word" else content


def _halve(unit: str, window: int, gram: int):
    """Split segments of heavy keys: rows gain ``lo, hi`` (range of the gram's offset in a window)."""
    def hashed(content):
        data = np.frombuffer(content, np.uint8)
        if unit == "word":
            return K.prefix_hash(K.word_hashes(data, np.array([0, len(data)]))[0])
        return K.prefix_hash(K.byte_values()[data])

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                prefix, parts = hashed(r["content"]), _units(r["content"], unit)
                grams = K.gram_key(prefix, gram).astype(np.int64)
                size = len(parts)
                least = max(0, size - window)  # every window holds the gram
                anchor = r["anchor"]
                if anchor is None:
                    anchor = least + int(np.flatnonzero(grams[least:window - gram + 1] == r["key"])[0])
                lo, hi = (0, window - gram) if r["lo"] is None else (r["lo"], r["hi"])
                mid = (lo + hi) // 2
                for a, b in ((lo, mid), (mid + 1, hi)):
                    # windows that start at anchor-b .. anchor-a
                    begin, end = max(0, anchor - b), min(size, anchor - a + window)
                    if a > b or end - begin < window:
                        continue
                    core = K.range_hash(prefix, np.array([anchor - a]), np.array([anchor - b + window]))
                    group = K.mix(core + np.uint64(r["key"] & (2 ** 64 - 1)) * np.uint64(3)
                                  + np.uint64(a * 4096 + b)).astype(np.int64)
                    body = parts[begin:end]
                    out.append(r | {"group": int(group[0]), "lo": a, "hi": b, "anchor": anchor - begin,
                                    "skip": r["skip"] + begin,
                                    "content": b" ".join(body) if unit == "word" else body})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_schema())

    return run


def _schema():
    return pa.schema([("key", pa.int64()), ("seg", pa.int64()), ("n", pa.int64()), ("_rid", pa.int64()),
                      ("pos", pa.int64()), ("skip", pa.int64()), ("content", pa.binary()),
                      ("group", pa.int64()), ("anchor", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])


_SPLIT = _CONTENT + ", group long, anchor long, lo long, hi long"


def split_heavy(segments: DataFrame, unit: str, window: int, gram: int,
                heavy: int) -> tuple[DataFrame, DataFrame | None]:
    """Step 4: rows in groups of at most ``heavy``, and rows of groups that are one window.

    A group that is still heavy when its key covers a whole window holds nothing but that window:
    a count decides it (:func:`decide_same`), so it is never collected.
    """
    null = F.lit(None).cast("long")
    current = scratch(segments.select("*", F.col("key").alias("group"), null.alias("anchor"),
                                      null.alias("lo"), null.alias("hi")), "contents")
    bounded, same = [], []
    while True:
        large = scratch(current.groupBy("group").agg(F.count(F.lit(1)).alias("rows"))
                        .filter(F.col("rows") > heavy).select("group"), "heavy")
        if large.isEmpty():
            bounded.append(current)
            break
        bounded.append(current.join(large, "group", "left_anti"))
        big = current.join(large, "group", "left_semi")
        same.append(big.filter("lo = hi"))
        current = scratch(big.filter("lo is null or lo < hi").select(*_schema().names)
                          .mapInArrow(_halve(unit, window, gram), _SPLIT), "halves")
    union = lambda frames: reduce(DataFrame.unionByName, frames) if frames else None
    return union(bounded), union(same)


def decide_same(same: DataFrame, window: int, keep_first: bool) -> DataFrame:
    """Runs for groups that are a single window (all rows equal): repeated, but for the first."""
    at = F.struct("_rid", (F.shiftright("pos", SIZE_BITS) + F.col("skip")).alias("u"))
    firsts = same.groupBy("group").agg(F.min(at).alias("least"))
    rows = same.join(firsts, "group")
    if keep_first:
        rows = rows.filter(at != F.col("least"))
    return rows.select("key", "seg", "n", "_rid", "pos", F.col("skip").alias("a"),
                       (F.col("skip") + window).alias("b"))


_RUNS = "key long, seg long, n long, _rid long, pos long, a long, b long"


def repeated_runs(rows: DataFrame, unit: str, window: int, gram: int, decide, keep_first: bool,
                  shard_units: int, heavy: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Steps 1 to 5: ``(occurrences, distinct segments, runs)``.

    ``decide(contents, counts)`` gets whole groups of about ``shard_units`` units (at most one group
    more, of ``heavy`` segments), each in the order of first occurrence, and returns per segment an
    array of flags, one per window start.
    """
    occurrences = candidates(rows, unit, window, gram)
    distinct = distinct_segments(occurrences)
    total, most = distinct.groupBy("key").agg(
        F.count(F.lit(1)).alias("c"), F.sum(F.col("pos").bitwiseAND(F.lit((1 << SIZE_BITS) - 1))).alias("u")) \
        .agg(F.coalesce(F.sum("u"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    segments = contents(distinct, rows, unit)
    same = None
    if most > heavy:
        segments, same = split_heavy(segments, unit, window, gram, heavy)
    else:
        segments = segments.withColumn("group", F.col("key"))
    shards = max(1, -(-int(total) // shard_units))

    def run(table: pa.Table) -> pa.Table:
        """Equal windows share a group, so a shard is decided a few whole groups at a time."""
        table = table.sort_by([(c, "ascending") for c in ("group", "_rid", "pos", "skip")])
        group, skip = table.column("group").to_numpy(), table.column("skip").to_numpy()
        content, counts = table.column("content").to_pylist(), table.column("n").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
        row, a, b = [], [], []
        lo, held = 0, 0
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist()):
            size = sum(len(_units(c, unit)) for c in content[first:last])
            if held and held + size > shard_units:
                _decided(decide, content, counts, skip, window, lo, first, row, a, b)
                lo, held = first, 0
            held += size
        _decided(decide, content, counts, skip, window, lo, len(content), row, a, b)
        join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        chosen = table.select(["key", "seg", "n", "_rid", "pos"]).take(pa.array(join(row).astype(np.int64)))
        return chosen.append_column("a", pa.array(join(a).astype(np.int64))) \
            .append_column("b", pa.array(join(b).astype(np.int64)))

    dealt = segments.select("key", "seg", "n", "_rid", "pos", "skip", "content", "group",
                            F.pmod(F.xxhash64("group"), F.lit(shards)).alias("shard"))
    runs = dealt.groupBy("shard").applyInArrow(run, _RUNS)
    if same is not None:
        runs = runs.unionByName(decide_same(same, window, keep_first))
    return occurrences, distinct, scratch(runs, "runs")


def _decided(decide, content, counts, skip, window, lo, hi, row, a, b) -> None:
    """Decide the segments lo:hi and append their runs of flagged windows."""
    for i, own in enumerate(decide(content[lo:hi], counts[lo:hi]), lo):
        edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
        starts = np.flatnonzero(edge == 1)
        row.append(np.full(len(starts), i))
        a.append(starts + skip[i])
        b.append(np.flatnonzero(edge == -1) - 1 + window + skip[i])


def unit_spans(runs: DataFrame) -> DataFrame:
    """Runs at their segment's first occurrence as ``_rid, start, end`` in units."""
    at = F.shiftright("pos", SIZE_BITS)
    return runs.select("_rid", (at + F.col("a")).alias("start"), (at + F.col("b")).alias("end"))


def merge_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of a document's spans (overlapping or touching ones join)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` plus ``_spans``: the document's spans (bounded by its own length), or null."""
    own = spans.groupBy("_rid").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    return rows.join(own, "_rid", "left")
