"""Near-duplicate embeddings by sorted projection passes (operator 2).

Each pass hashes every vector to the signs of its projections on random directions; the signs,
concatenated, order the vectors of a label lexicographically, so near vectors tend to stand close
together. Vectors are compared within bounded windows of that order (a block of :data:`BLOCK`
neighbours and the next block), exactly, by cosine in double precision. Windows widen block by
block, over whole buckets (vectors that agree on the ``m`` leading signs the bound below needs) and
for as long as links still reach their far end, so neither a label whose vectors share a direction
nor a large group of near copies loses a link to the window's bound. A label whose buckets would
cost more than comparing all of its vectors once is compared whole. Pairs found in any pass are
united.

All passes are one distributed sort of narrow rows (pass, label, key, id); a hot label is split by
its keys. The number of passes follows from the largest label so that a pair at the threshold is
missed with probability ``miss`` whatever the size and however the vectors lie: a pair that agrees
on ``m`` leading signs is compared, and one sign agrees with probability
``1 - acos(threshold) / pi``. ``2^m`` buckets of half a block would cover an evenly spread label; the
measured buckets decide how far windows widen.

Equal vectors of a label collapse to one before (a hot vector is one row) and count as linked with
each other.

Cases: a vector that is null, zero, empty, or holds null or non-finite components, or has no
label, links with nothing; vectors of different lengths do not link; rows that repeat an id are
vectors of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.llm.common import components, keyed_rows, scratch
from lureline.operators.ranking import with_global_rank

BLOCK = 1024
SIGNS = 48


def passes_needed(largest: int, threshold: float, miss: float) -> int:
    """Passes so that a pair at the threshold is missed in all of them with probability ``miss``."""
    if largest <= BLOCK:
        return 1
    agree = 1 - math.acos(threshold) / math.pi
    together = agree ** math.log2(2 * largest / BLOCK)
    return max(1, math.ceil(math.log(miss) / math.log1p(-together)))


def signs_needed(largest: int) -> int:
    """Leading signs that :func:`passes_needed` lets a pair agree on (rounded down: no fewer pairs)."""
    return 0 if largest <= BLOCK else min(SIGNS, int(math.log2(2 * largest / BLOCK)))


def _vectors(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(v, kind).astype(np.float64) for v in column.to_pylist()]


def _unit(rows: list[np.ndarray]) -> np.ndarray:
    x = np.stack(rows)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _keys(passes: int, seed: int, kind: str):
    """(rep, label, vec) -> one narrow row per pass: the concatenated signs as a sort key."""
    def run(batches):
        shift = np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            reps = batch.column("rep").to_numpy(zero_copy_only=False)
            vectors = _vectors(batch.column("vec"), kind)
            dims = np.array([len(v) for v in vectors], np.int64)
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                unit = _unit([vectors[i] for i in mine])
                for p in range(passes):
                    rng = np.random.Generator(np.random.PCG64([seed, p, int(dim)]))
                    key = ((unit @ rng.standard_normal((int(dim), SIGNS))) > 0) @ shift
                    yield pa.RecordBatch.from_pydict({
                        "rep": pa.array(reps[mine]), "label": batch.column("label").take(pa.array(mine)),
                        "pass": pa.array(np.full(len(mine), p, np.int32)),
                        "dim": pa.array(np.full(len(mine), dim, np.int32)), "key": pa.array(key)})

    return run


def _compare(threshold: float, kind: str, inner: bool):
    """One block (``left``) against itself (``inner``) and against a later block."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_rank")
        reps, left = table.column("rep").to_numpy(), table.column("left").to_numpy()
        code = np.stack([table.column(c).to_numpy() for c in ("pass", "label", "dim")])
        change = np.flatnonzero(np.any(code[:, 1:] != code[:, :-1], axis=0)) + 1
        vectors = _vectors(table.column("vec"), kind)
        block = int(table.column("pair")[0].as_py())
        src, dst, far = [], [], []
        for lo, hi in zip([0, *change], [*change, len(reps)]):
            own = np.flatnonzero(left[lo:hi]) + lo
            later = np.flatnonzero(~left[lo:hi].astype(bool)) + lo
            if not len(own) or (not inner and not len(later)):
                continue
            unit = _unit(vectors[lo:hi])
            for other, within in ((own, True), (later, False)):
                if (within and not inner) or not len(other):
                    continue
                close = unit[own - lo] @ unit[other - lo].T >= threshold
                i, j = np.nonzero(np.triu(close, 1) if within else close)
                src.append(np.minimum(reps[own[i]], reps[other[j]]))
                dst.append(np.maximum(reps[own[i]], reps[other[j]]))
                far.append(np.full(len(i), not within))
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        src = join(src, np.int64)
        return pa.table({"src": pa.array(src.astype(np.int64)), "dst": pa.array(join(dst, np.int64).astype(np.int64)),
                         "far": pa.array(join(far, bool).astype(bool)),
                         "pair": pa.array(np.full(len(src), block, np.int64))})

    return run


_LINKS = "src long, dst long, far boolean, pair long"


def _wide_pairs(placed: DataFrame, signs: int) -> DataFrame:
    """``(pair, step)``: blocks two or more apart that hold rows of one bucket; for labels where that
    is more than all pairs of their blocks, these, once."""
    span = scratch(placed.groupBy("pass", "label", "dim", "block").agg(
        F.min(F.shiftright("key", SIGNS - signs)).alias("low"),
        F.max(F.shiftright("key", SIGNS - signs)).alias("high")), "spans")
    group = ["label", "dim"]
    on = ["pass", *group]
    mine = span.select(*on, F.col("block").alias("pair"), F.col("high").alias("bucket"))
    apart = F.col("block") > F.col("pair") + 1
    wide = scratch(mine.join(span.withColumnRenamed("low", "bucket"), [*on, "bucket"]).filter(apart)
                   .select(*group, "pair", (F.col("block") - F.col("pair")).alias("step")), "wide")
    blocks = span.filter(F.col("pass") == 0).groupBy(*group).agg(F.count(F.lit(1)).alias("blocks"))
    whole = wide.groupBy(*group).count().join(blocks, group) \
        .filter("2 * count > blocks * (blocks - 1)").select(*group)
    every = mine.filter(F.col("pass") == 0).join(span, on).filter(apart).join(whole, group, "left_semi") \
        .select("pair", (F.col("block") - F.col("pair")).alias("step"))
    return scratch(wide.join(whole, group, "left_anti").select("pair", "step").unionByName(every).distinct(), "wide")


def linked_pairs(classes: DataFrame, threshold: float, passes: int, seed: int, kind: str,
                 signs: int = 0) -> DataFrame:
    """``classes(rep, label, vec)`` -> distinct linked pairs ``(src, dst)``, src < dst."""
    keys = classes.select("rep", "label", "vec").mapInArrow(
        _keys(passes, seed, kind), "rep long, label long, pass int, dim int, key long")
    ranked = with_global_rank(keys, ["pass", "label", "dim", "key", "rep"], rank_col="_rank")
    ranked = ranked.withColumn("block", F.floor((F.col("_rank") - 1) / BLOCK))
    wide = _wide_pairs(ranked, signs)
    farthest = wide.agg(F.max("step")).first()[0] or 0
    placed = scratch(ranked.select("rep", "label", "pass", "dim", "_rank", "block")
                     .join(classes.select("rep", "vec"), "rep"), "placed")
    left = placed.withColumns({"pair": F.col("block"), "left": F.lit(True)})
    right = placed.withColumns({"pair": F.col("block") - 1, "left": F.lit(False)}).filter("pair >= 0")
    found = scratch(left.unionByName(right).groupBy("pair").applyInArrow(
        _compare(threshold, kind, True), _LINKS), "links")
    links, step = [found.select("src", "dst")], 2
    while True:  # widen the windows whose far end still links, and those that end inside a bucket
        reach = found.filter("far").select("pair")
        if step <= farthest:
            reach = reach.unionByName(wide.filter(F.col("step") == step).select("pair"))
        reach = reach.distinct()
        if step > farthest and reach.isEmpty():
            break
        left = placed.join(reach, placed.block == reach.pair).withColumn("left", F.lit(True))
        right = placed.join(reach, placed.block == reach.pair + step).withColumn("left", F.lit(False))
        found = scratch(left.unionByName(right).groupBy("pair").applyInArrow(
            _compare(threshold, kind, False), _LINKS), "links")
        links.append(found.select("src", "dst"))
        step += 1
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return scratch(out.distinct(), "links")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label", threshold: float = 0.93, miss: float = 1e-4,
                 seed: int = 2) -> DataFrame:
    """One row per vector: ``<id>, n_links, component_id, kept``."""
    narrow = isinstance(vectors.schema[vec_col].dataType, T.ArrayType) and \
        isinstance(vectors.schema[vec_col].dataType.elementType, T.FloatType)
    kind = "<f4" if narrow else "<f8"
    plain = vectors.select(F.col(id_col), F.col(vec_col).cast("array<float>" if narrow else "array<double>").alias("v"),
                           F.col(label_col).cast("long").alias("label"))
    rows = keyed_rows(plain, id_col, "v", rest=True, cast=None).select(
        id_col, "_rid", "v", F.col("_rest.label").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("v").isNotNull() & finite
                        & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("_ok", usable)
    classes = rows.filter("_ok").groupBy("label", "v").agg(
        F.min("_rid").alias("rep"), F.count(F.lit(1)).alias("n"))

    def pack(batches):
        for batch in batches:
            lists = batch.column("v")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype(kind), lists.offsets.to_numpy()
            at = at - at[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("label"), batch.column("n"),
                 pa.array([flat[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())],
                names=["rep", "label", "n", "vec"])

    packed = scratch(classes.mapInArrow(pack, "rep long, label long, n long, vec binary"), "classes")
    largest = packed.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    pairs = linked_pairs(packed, threshold, passes_needed(largest, threshold, miss), seed, kind,
                         signs_needed(largest))
    weight = packed.select("rep", "n")
    both = pairs.select(F.col("src").alias("rep"), F.col("dst").alias("other")).unionByName(
        pairs.select(F.col("dst").alias("rep"), F.col("src").alias("other")))
    degree = both.join(weight.select(F.col("rep").alias("other"), "n"), "other") \
        .groupBy("rep").agg(F.sum("n").alias("linked"))
    comp = components(pairs).withColumnRenamed("id", "rep")
    known = weight.join(degree, "rep", "left").join(comp, "rep", "left").select(
        "rep", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("_root"))
    member = rows.filter("_ok").select(id_col, "_rid", "label", "v") \
        .join(classes.select("label", "v", "rep"), ["label", "v"]).join(known, "rep") \
        .select(id_col, "_rid", "n_links", "_root")
    alone = rows.filter("not _ok").select(id_col, "_rid", F.lit(0).cast("long").alias("n_links"),
                                          F.col("_rid").alias("_root"))
    out = member.unionByName(alone).withColumn("kept", F.col("_root") == F.col("_rid"))
    names = rows.select(F.col("_rid").alias("_root"), F.col(id_col).alias("component_id"))
    return out.join(names, "_root").select(id_col, "n_links", "component_id", "kept")
