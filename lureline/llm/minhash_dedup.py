"""Near-duplicate documents by an LSH forest over MinHash signatures (operator 9).

1. One scan hashes every document's distinct word shingles (whole texts) to ``trees * depth``
   minima; documents with equal shingle sets collapse to one representative (combined map-side).
2. Each tree is one sorted order: the representative's minima of that tree, concatenated. All
   trees are sorted at once by range partitioning, so a region that holds a third of all rows is
   split by its deeper minima. In sorted order the rows next to each other have the longest common
   prefixes; a row is compared with those of its ``neighbours`` predecessors that share at least
   ``min_prefix`` minima. Where a region is sparse that is everything sharing the short prefix;
   where it is dense only the deepest prefixes stay next to each other: the depth adapts by region.
   Pairs whose sizes exclude the threshold, or of whose minima too few agree in their last bits (a
   pair at the threshold has fewer with probability 0.000005), are dropped there.
   Neighbours across a partition's edge are compared from the first and last rows of partitions.
3. Candidate pairs are confirmed on the full shingle sets, rebuilt from the texts: first the
   best partners among the four nearest rows; then, from the whole neighbourhood, the four best
   partners left, and at last every candidate left. Pairs whose two documents are connected by then
   are not made again (a link inside a component cannot change it).
4. Where more rows share ``min_prefix`` minima than the window holds and are not connected by then
   (documents with a long template in common), the window may have left pairs out. All documents of
   such runs that share one of their rarest shingles (prefix filtering, which leaves out no pair) are
   compared in bounded groups over an inverted index of the full sets; only links leave a task.
5. Connected components by hooking and contraction; the smallest document of each stays.

A pair at the threshold 0.75 shares two minima in at least one of twelve trees with probability
1 - (1 - 0.75^2)^12 = 0.99995.

Cases: a null or empty text has no shingles and is linked with nothing; a text of fewer words than
a shingle is one shingle; rows that repeat an id are documents of their own (ordered by text);
an empty table gives no rows; input columns that clash with a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.llm import kernels as K
from lureline.llm.common import components, keyed_rows, scratch, then

CHUNK = 1 << 19


def shingle_sets(texts: pa.Array, words: int):
    """For each text the sorted distinct hashes of its word shingles."""
    data, offsets = K.text_bytes(texts)
    for i, j in K.doc_chunks(offsets, CHUNK):
        part = K.lower_ascii(data[offsets[i]:offsets[j]])
        starts, ends, rows = K.word_bounds(part, offsets[i:j + 1] - offsets[i])
        prefix = K.prefix_hash(K.mix(K.range_hash(K.prefix_hash(K.byte_values()[part]), starts, ends)))
        grams = K.gram_hash(prefix, words)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
            if b - a >= words:
                yield np.unique(grams[a:b - words + 1])
            elif b > a:
                whole = K.range_hash(prefix, np.array([a]), np.array([b])) + np.uint64(b - a)
                yield K.mix(whole)
            else:
                yield np.empty(0, np.uint64)


def _sketches(trees: int, depth: int, words: int, seed: int):
    rng = np.random.Generator(np.random.PCG64(seed))
    salts = rng.integers(0, 1 << 63, trees * depth, dtype=np.int64).astype(np.uint64)
    mults = rng.integers(0, 1 << 62, trees * depth, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches):
        for batch in batches:
            ids = batch.column("_rid")
            sets = list(shingle_sets(batch.column("text"), words))
            sizes = np.array([len(s) for s in sets], np.int64)
            sums = np.zeros((len(sets), 2), np.uint64)
            sig = np.zeros((len(sets), trees * depth), ">u4")
            full = np.flatnonzero(sizes)
            for lo in range(0, len(full), 256):  # bounded work arrays
                part = full[lo:lo + 256]
                flat = np.concatenate([sets[i] for i in part])
                at = np.concatenate([[0], np.cumsum(sizes[part])[:-1]])
                sums[part, 0] = np.add.reduceat(K.mix(flat), at)
                sums[part, 1] = np.add.reduceat(K.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                for t in range(trees * depth):
                    sig[part, t] = np.minimum.reduceat((flat ^ salts[t]) * mults[t], at) >> np.uint64(32)
            bits = ((sig[:, ::2] & 15) << 4 | sig[:, 1::2] & 15).astype(np.uint8)
            raw = sig.tobytes()
            width = 4 * trees * depth
            yield pa.RecordBatch.from_pydict({
                "_rid": ids, "n_shingles": pa.array(sizes),
                "ha": pa.array(sums[:, 0].astype(np.int64)), "hb": pa.array(sums[:, 1].astype(np.int64)),
                "sig": pa.array([raw[i * width:(i + 1) * width] for i in range(len(sets))], pa.binary()),
                "bits": pa.array([b.tobytes() for b in bits], pa.binary())})

    return run


def _least_alike(minima: int, threshold_pct: int) -> int:
    """Minima whose last four bits agree, which a pair at the threshold misses with probability
    0.000005 (a pair of similarity s agrees in one with probability s + (1 - s) / 16)."""
    agree = threshold_pct / 100 + (1 - threshold_pct / 100) / 16
    return int(np.floor(minima * agree - 4.5 * np.sqrt(minima * agree * (1 - agree))))


def _neighbours(depth: int, min_prefix: int, lag: int, edges: bool, minima_all: int, threshold_pct: int):
    """Sorted stream of (key, _rid, n, bits) -> candidate pairs; with ``edges`` also its ends."""
    width, least = 1 + 4 * depth, _least_alike(minima_all, threshold_pct)

    def pairs_of(keys, ids, n, known, bits, fresh: int):
        """Rows from ``fresh`` on against up to ``lag`` rows before each; pairs that their sizes or
        the last bits of all their minima rule out, or that are known to be connected, go at once. The score is the number that agree."""
        found = []
        tree, minima = keys[:, 0], np.ascontiguousarray(keys[:, 1:]).view(">u4").reshape(len(keys), depth)
        for step in range(1, lag + 1):
            a, b = np.arange(fresh, len(keys)) - step, np.arange(fresh, len(keys))
            ok = a >= 0
            a, b = a[ok], b[ok]
            same = (tree[a] == tree[b])[:, None] & (minima[a] == minima[b])
            common = np.cumprod(same, axis=1).sum(axis=1)
            hit = common >= min_prefix
            if not hit.any():
                break
            a, b, common = a[hit], b[hit], common[hit]
            like = 100 * np.minimum(n[a], n[b]) >= threshold_pct * np.maximum(n[a], n[b])
            like &= known[a] != known[b]
            differ = bits[a] ^ bits[b]
            alike = ((differ & 15) == 0).sum(axis=1) + ((differ & 240) == 0).sum(axis=1)
            like &= alike >= least
            found.append((ids[a[like]], ids[b[like]], alike[like]))
        return found

    def run(batches):
        part = TaskContext.get().partitionId()
        size = minima_all // 2
        none = np.empty(0, np.int64)
        held = (np.empty((0, width), np.uint8), none, none, none, np.empty((0, size), np.uint8))
        first = None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            raw = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(rows, -1)
                   for c in ("key", "bits")]
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_rid", "n", "known")]
            state = tuple(np.concatenate(x) for x in zip(held, (raw[0], *own, raw[1])))
            if edges and first is None:
                first = tuple(x[:lag] for x in state)
            for src, dst, common in pairs_of(*state, len(held[1])):
                k = len(src)
                yield pa.RecordBatch.from_pydict({
                    "src": pa.array(np.minimum(src, dst)), "dst": pa.array(np.maximum(src, dst)),
                    "common": pa.array(common.astype(np.int64)), "key": pa.nulls(k, pa.binary()),
                    "n": pa.nulls(k, pa.int64()), "known": pa.nulls(k, pa.int64()), "bits": pa.nulls(k, pa.binary())})
            held = tuple(x[-lag:] for x in state)
        if edges and first is not None:
            keys, ids, n, known, bits = (np.concatenate(x) for x in zip(first, held))
            yield pa.RecordBatch.from_pydict({
                "src": pa.array(ids), "dst": pa.array(ids),
                "common": pa.array(np.full(len(ids), -1 - part, np.int64)),
                "key": pa.array([bytes(k) for k in keys], pa.binary()), "n": pa.array(n),
                "known": pa.array(known),
                "bits": pa.array([bytes(k) for k in bits], pa.binary())})

    return run


_PAIR = "src long, dst long, common long, key binary, n long, known long, bits binary"


def candidate_pairs(signatures: DataFrame, trees: int, depth: int, min_prefix: int,
                    neighbours: int, threshold_pct: int) -> DataFrame:
    """``signatures(_rid, n, known, sig, bits)`` -> distinct ``(src, dst, common)``: minima that
    agree; pairs of one known component are left out."""
    step = 4 * depth
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = signatures.select("_rid", "n", "known", "bits", "sig", tree.alias("tree")).select(
        "_rid", "n", "known", "bits", F.concat(F.unhex(F.lpad(F.hex("tree"), 2, "0")),
                         F.substring(F.col("sig"), F.col("tree") * step + 1, F.lit(step))).alias("key"))
    ordered = rows.repartitionByRange("key", "_rid").sortWithinPartitions("key", "_rid")
    scan = lambda edges: _neighbours(depth, min_prefix, neighbours, edges, trees * depth, threshold_pct)
    found = scratch(ordered.mapInArrow(scan(True), _PAIR), "pairs")
    ends = found.filter("common < 0").select(F.col("src").alias("_rid"), "n", "known", "bits", "key").distinct() \
        .repartition(1).sortWithinPartitions("key", "_rid")  # a few rows per partition
    across = ends.mapInArrow(scan(False), _PAIR)
    return found.filter("common >= 0").unionByName(across).filter("src <> dst") \
        .groupBy("src", "dst").agg(F.max("common").alias("common"))


def confirmed(pairs: DataFrame, rows: DataFrame, words: int, threshold_pct: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold (texts joined, compared per pair)."""
    texts = rows.select("_rid", "text")

    def check(batches):
        for batch in batches:
            keep = []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for a, b in zip(shingle_sets(part.column("ta"), words), shingle_sets(part.column("tb"), words)):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= threshold_pct * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays(
                [batch.column("src"), batch.column("dst")], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    first = pairs.select("src", "dst").join(
        texts.select(F.col("_rid").alias("src"), F.col("text").alias("ta")), "src")
    both = first.join(texts.select(F.col("_rid").alias("dst"), F.col("text").alias("tb")), "dst")
    return both.select("src", "dst", "ta", "tb").mapInArrow(check, "src long, dst long")


def _shingle_rows(words: int):
    """(_rid, known, n, text) -> one row per distinct shingle."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # bounded work arrays
                part = batch.slice(lo, 64)
                sets = list(shingle_sets(part.column("text"), words))
                at = pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(at) for c in ("_rid", "known", "n")]
                    + [pa.array(np.concatenate(sets).astype(np.int64))], names=["_rid", "known", "n", "shingle"])

    return run


def crowded(signatures: DataFrame, trees: int, depth: int, min_prefix: int, neighbours: int) -> DataFrame:
    """``_rid, known, n`` of the rows that, in some tree, share ``min_prefix`` minima with more rows
    than the window holds, not all of one known component: both rows of any pair that the window
    left out are among them."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    runs = signatures.select("_rid", "known", "n", "sig", tree.alias("tree")).select(
        "_rid", "known", "n", "tree",
        F.substring(F.col("sig"), F.col("tree") * 4 * depth + 1, F.lit(4 * min_prefix)).alias("prefix"))
    full = runs.groupBy("tree", "prefix").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("known").alias("_low"), F.max("known").alias("_high")) \
        .filter((F.col("_rows") > neighbours + 1) & (F.col("_low") < F.col("_high")))
    return runs.join(full.select("tree", "prefix"), ["tree", "prefix"], "left_semi") \
        .select("_rid", "known", "n").distinct()


def _gram_sets(words: int):
    """(_rid, known, text) -> the sorted shingle hashes of every document as one value."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # bounded work arrays
                part = batch.slice(lo, 64)
                sets = [s.tobytes() for s in shingle_sets(part.column("text"), words)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_rid"), part.column("known"), pa.array(sets, pa.binary())],
                    names=["_rid", "known", "grams"])

    return run


def linked_rows(sets: list[np.ndarray], known: np.ndarray, side: np.ndarray, threshold_pct: int):
    """Index pairs of ``sets`` (sorted distinct values) that reach the threshold, are not of one
    known component and, where ``side`` holds two values, stand on different sides.

    Intersections are counted exactly, for a bounded number of rows at a time: values that at least an
    eighth of the sets hold by a product of 0/1 matrices, the others over their inverted index. No
    pair is kept but a link.
    """
    count, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    crossing = len(np.unique(side)) > 1
    row = np.repeat(np.arange(count), sizes)
    _, value, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = (often > 1) & (8 * often >= count)
    place = np.cumsum(common) - 1
    mass = np.zeros((count, int(common.sum())), np.float32)  # at most eight times the given values
    mass[row[common[value]], place[value[common[value]]]] = 1.0
    rare = ((often > 1) & ~common)[value]
    row, value = row[rare], value[rare]
    start = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=len(often)))])
    holders, width = row[np.argsort(value, kind="stable")], (start[1:] - start[:-1])[value]
    work = np.concatenate([[0], np.cumsum(np.bincount(row, weights=width, minlength=count).astype(np.int64))])
    at = np.searchsorted(row, np.arange(count + 1))
    lo = 0
    while lo < count:
        hi = int(np.searchsorted(work, work[lo] + (1 << 21), side="right")) - 1
        hi = max(lo + 1, min(hi, lo + max(1, (1 << 21) // count)))
        both = mass[lo:hi] @ mass.T  # counts below 2^24 are exact
        part = slice(at[lo], at[hi])
        many = width[part]
        if len(many):
            inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            partner = holders[np.repeat(start[value[part]], many) + inside]
            both += np.bincount(np.repeat(row[part] - lo, many) * count + partner,
                                minlength=(hi - lo) * count).reshape(hi - lo, count)
        # n >= t (a + b - n), first in single precision with a margin, then exactly
        a, b = np.nonzero(both * ((100 + threshold_pct) / threshold_pct * 1.0001)
                          >= sizes[lo:hi, None].astype(np.float32) + sizes.astype(np.float32))
        n, a = both[a, b].astype(np.int64), a + lo
        ok = (a < b) & (known[a] != known[b]) & (100 * n >= threshold_pct * (sizes[a] + sizes[b] - n))
        if crossing:
            ok &= side[a] != side[b]
        yield a[ok], b[ok]
        lo = hi


def _link_groups(threshold_pct: int):
    """Rows in the order of (shingle, i, j) -> the links inside each such group."""
    def links(group):
        ids, known, side, sets = zip(*group)
        if len(set(known)) == 1:
            return
        ids, known, side = np.array(ids), np.array(known), np.array(side)
        for a, b in linked_rows(list(sets), known, side, threshold_pct):
            if len(a):
                x, y = ids[a], ids[b]
                yield pa.RecordBatch.from_pydict({"src": np.minimum(x, y), "dst": np.maximum(x, y)})

    def run(batches):
        key, group = None, []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("shingle", "i", "j", "_rid", "known", "side")]
            for k, (shingle, i, j, rid, known, side) in enumerate(zip(*cols)):
                if (shingle, i, j) != key:
                    if len(group) > 1:
                        yield from links(group)
                    key, group = (shingle, i, j), []
                group.append((rid, known, side, np.frombuffer(batch.column("grams")[k].as_buffer(), np.uint64)))
        if len(group) > 1:
            yield from links(group)

    return run


def prefix_links(dense: DataFrame, rows: DataFrame, words: int, threshold_pct: int,
                 block: int = 1 << 20) -> DataFrame:
    """Distinct links ``(src, dst)`` of ``dense(_rid, known, n)`` between different known components
    by prefix filtering, which is exact: with the shingles of every set ordered by rising frequency,
    a pair at the threshold shares one among the first n - ceil(2t / (1 + t) n) + 1 of the smaller and
    the first n - ceil(t n) + 1 of the larger set.

    The rows that hold a shingle in such a prefix are one group; shingles with the same rows (a
    passage has many) are one group together. Groups are compared inside tasks over an inverted index
    of the full sets (:func:`linked_rows`) and give links only, never a row per pair. A group of more
    than ``block`` shingles in all is dealt out in blocks, each pair of blocks a group of its own, so
    memory is bounded by two blocks (and the longest document).
    """
    pct = threshold_pct
    texts = dense.join(rows.select("_rid", "text"), "_rid").select("_rid", "known", "n", "text")
    each = scratch(texts.mapInArrow(_shingle_rows(words), "_rid long, known long, n long, shingle long"), "shingles")
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("_df")).filter("_df > 1")
    place = F.row_number().over(Window.partitionBy("_rid").orderBy(F.col("_df").asc_nulls_first(), "shingle"))
    need = lambda top, low: F.expr(f"n - (({top}) * n + ({low}) - 1) div ({low}) + 1")
    first = each.join(often, "shingle", "left").withColumn("_at", place).filter(F.col("_at") <= need(pct, 100)) \
        .withColumn("small", F.col("_at") <= need(2 * pct, 100 + pct)).filter("_df is not null") \
        .select("_rid", "known", "n", "shingle", "small")
    first = scratch(first, "prefixes")
    groups = first.groupBy("shingle").agg(
        F.min("known").alias("_low"), F.max("known").alias("_high"), F.max("small").alias("small"),
        F.count(F.lit(1)).alias("_rows"), F.sum("n").alias("_size"),
        F.bit_xor(F.xxhash64("_rid")).alias("_ha"), F.bit_xor(F.xxhash64("_rid", F.lit(9))).alias("_hb")) \
        .filter("_low < _high and small")
    chosen = groups.groupBy("_rows", "_size", "_ha", "_hb").agg(F.min("shingle").alias("shingle")).select(
        "shingle", F.ceil(F.col("_size") / block).cast("long").alias("_blocks"))
    own = F.pmod(F.xxhash64("_rid", "shingle"), F.col("_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    members = first.select("_rid", "shingle").join(chosen, "shingle").withColumn("side", own) \
        .withColumn("_other", other).select(
            "_rid", "shingle", F.least("side", "_other").alias("i"), F.greatest("side", "_other").alias("j"), "side")
    grams = scratch(texts.select("_rid", "known", "text").mapInArrow(
        _gram_sets(words), "_rid long, known long, grams binary"), "grams")
    dealt = members.join(grams, "_rid").repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return dealt.select("shingle", "i", "j", "_rid", "known", "side", "grams").mapInArrow(
        _link_groups(pct), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    threshold_pct: int = 75, trees: int = 12, depth: int = 8, min_prefix: int = 2,
                    neighbours: int = 24, seed: int = 9) -> DataFrame:
    """One row per document: ``<id>, n_shingles, component_id, kept`` (and ``_rid``)."""
    keyed = keyed_rows(docs, id_col, text_col)
    rows = keyed.withColumnRenamed(text_col, "text")
    sketch = scratch(rows.select("_rid", "text").mapInArrow(
        _sketches(trees, depth, words, seed),
        "_rid long, n_shingles long, ha long, hb long, sig binary, bits binary"), "sketch")
    sets = scratch(sketch.filter("n_shingles > 0").groupBy("ha", "hb", "n_shingles").agg(
        F.min("_rid").alias("rep"), F.first("sig").alias("sig"), F.first("bits").alias("bits")), "sets")
    signed = sets.select(F.col("rep").alias("_rid"), F.col("n_shingles").alias("n"), "sig", "bits")
    labels = None  # id -> component of the documents linked so far
    for lag, best in ((4, 1), (neighbours, 4), (None, None), (0, None)):
        if labels is None:
            tag = lambda rows, side, out: rows.withColumn(out, F.col(side))
        else:
            tag = lambda rows, side, out: rows.join(
                labels.select(F.col("id").alias(side), F.col("component").alias(out)), side, "left") \
                .withColumn(out, F.coalesce(out, side))  # noqa: B023
        if lag:
            left = scratch(candidate_pairs(tag(signed, "_rid", "known"), trees, depth, min_prefix, lag,
                                           threshold_pct), "candidates")
            left = tag(tag(left, "src", "_src"), "dst", "_dst")
        elif lag == 0:  # pairs that a full window left out
            dense = scratch(crowded(tag(signed, "_rid", "known"), trees, depth, min_prefix, neighbours), "crowded")
            if dense.isEmpty():
                break
            left = scratch(prefix_links(dense, rows, words, threshold_pct), "links")
            left = tag(tag(left, "src", "_src"), "dst", "_dst")
        else:  # the components of the last round, on the components before it
            for side in ("_src", "_dst"):
                onto = found.select(F.col("id").alias(side), F.col("component").alias("_to"))
                left = left.join(onto, side, "left").withColumn(side, F.coalesce("_to", side)).drop("_to")
        open_pairs = scratch(left.filter("_src <> _dst"), "open")
        now = open_pairs
        if best:
            rank = lambda side: F.row_number().over(
                Window.partitionBy(side).orderBy(F.col("common").desc(), "src", "dst"))
            now = open_pairs.withColumns({"_a": rank("src"), "_b": rank("dst")}).filter(
                (F.col("_a") <= best) | (F.col("_b") <= best))
        now = scratch(now.select("src", "dst", "_src", "_dst"), "now")
        links = now if lag == 0 else confirmed(now, rows, words, threshold_pct).join(now, ["src", "dst"])
        found = scratch(components(links.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))), "comp")
        if labels is None:
            labels = found
        else:
            known = labels.unionByName(found.select("id", F.col("id").alias("component")).join(
                labels.select("id"), "id", "left_anti"))
            labels = scratch(then(known, found), "comp")
        left = open_pairs.join(now.select("src", "dst"), ["src", "dst"], "left_anti")
    final = labels
    member = sketch.select("_rid", "n_shingles", "ha", "hb").join(
        sets.select("ha", "hb", "n_shingles", "rep"), ["ha", "hb", "n_shingles"], "left")
    out = member.join(final.withColumnRenamed("id", "rep"), "rep", "left").select(
        "_rid", "n_shingles", F.coalesce("component", "rep", "_rid").alias("_root")).withColumn("kept", F.col("_root") == F.col("_rid"))
    if keyed.ids_serve:
        return out.select(F.col("_rid").alias(id_col), "n_shingles",
                          F.col("_root").alias("component_id"), "kept", "_rid")
    names = rows.select("_rid", id_col)
    return out.join(names, "_rid").join(
        names.select(F.col("_rid").alias("_root"), F.col(id_col).alias("component_id")), "_root") \
        .select(id_col, "n_shingles", "component_id", "kept", "_rid")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that another of their component stands for."""
    rows = keyed_rows(docs, id_col, text_col, rest=True)
    classes = near_duplicates(rows.select(F.col("_rid").alias(id_col), text_col), id_col, text_col, **options)
    kept = classes.filter("kept").select(F.col(id_col).alias("_rid"))
    return rows.join(kept, "_rid", "left_semi").select(
        *[(F.col(c) if c in (id_col, text_col) else F.col(f"_rest.`{c}`")).alias(c) for c in docs.columns])
