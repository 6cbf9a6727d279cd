"""Mixing sources to target weights by subset-sum budget fitting (operator 5).

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``. The mix takes each document zero,
one or two times, so that the words taken from a source come as near to its target as whole
documents allow:

1. documents are counted by exact size per source (a Spark aggregate, combined map-side): the
   histogram is all that the fitting sees;
2. where the target is at least the source's size every document is taken once and the rest of
   the target is the budget, else the target itself is;
3. the budget is spread over the sizes in proportion to their counts, and what remains is fitted
   exactly by bounded-knapsack dynamic programming over the counts left (the largest sizes first
   bring it below ``dp_budget`` words);
4. the fitted number of documents per (source, size) is drawn by a keyed hash of the document.
   A group of many equal sizes is split into hash ranges that are counted first; whole ranges are
   taken, and only the one range where the count runs out is ranked, so no group is one task.

Targets: source weights repeat ``weights`` over the sources in code point order (null last); a
target is bounded by twice the source's size and the excess goes to the others by weight, which is
the level ``t`` with ``sum(min(weight * t, 2 * size)) = budget``.

Cases: a null or empty text has size 0 and is never taken; a null source is a source of its own;
repeated rows are documents of their own (rows equal in id and text are interchangeable); an
empty table gives no rows; reruns agree, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.llm.common import scratch

#: Documents that one hash range of an equal-size group holds on average.
RANGE_ROWS = 4096


def word_count(text):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")),
                          F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """``source, source_size`` -> the same plus ``target`` (one row per source)."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    rows = sizes.withColumn("w", F.element_at(
        cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    rows = rows.withColumns({"cap": 2.0 * F.col("source_size"), "level": 2.0 * F.col("source_size") / F.col("w")})
    total = Window.partitionBy()
    upto = Window.orderBy("level", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "budget": F.lit(float(share)) * F.sum("source_size").over(total),
        "capped": F.sum("cap").over(upto) - F.col("cap"),
        "free": F.sum("w").over(total) - (F.sum("w").over(upto) - F.col("w"))})
    # the sources before this one (by level) are at their bound: does the rest fit below mine?
    rows = rows.withColumn("t", (F.col("budget") - F.col("capped")) / F.col("free"))
    level = F.min(F.when(F.col("t") <= F.col("level"), F.struct("level", "t"))).over(total)["t"]
    return rows.withColumn("target", F.when(level.isNull(), F.col("cap"))
                           .otherwise(F.least(F.col("cap"), F.col("w") * level))) \
        .select("source", "source_size", "target")


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: float,
               dp_budget: int = 1 << 17) -> np.ndarray:
    """How many documents of each size bring the sum nearest to ``budget`` words."""
    total = int((sizes * counts).sum())
    budget = min(max(budget, 0.0), float(total))
    if total == 0:
        return np.zeros(len(sizes), np.int64)
    taken = np.floor(counts * (budget / total)).astype(np.int64)
    rest = budget - float((taken * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:  # large sizes first, until the dynamic programme can take over
        if rest <= dp_budget:
            break
        more = min(int(counts[i] - taken[i]), int((rest - dp_budget // 2) // sizes[i])) if sizes[i] else 0
        if more > 0:
            taken[i] += more
            rest -= more * float(sizes[i])
    # bounded knapsack: bits of ``reach`` are the sums within range, counts split into powers of two
    top = int(rest) + int(sizes.max())  # the nearest sum above lies within one document
    limit = (1 << (top + 1)) - 1
    reach, goal = 1, int(round(rest))
    parent = np.full(top + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    for i in order:
        left = int(min(counts[i] - taken[i], top // sizes[i])) if sizes[i] else 0
        part = 1
        while left > 0:
            use = min(part, left)
            grown = reach | ((reach << (use * int(sizes[i]))) & limit)
            new = grown & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(
                    new.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")
                parent[np.flatnonzero(bits[:top + 1])] = len(items)
            items.append((int(i), use))
            reach, left, part = grown, left - use, part * 2
        if reach >> goal & 1:
            break
    bits = np.flatnonzero(np.unpackbits(np.frombuffer(
        reach.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little")[:top + 1])
    best = int(bits[np.argmin(np.abs(bits - rest))])
    while best > 0:
        i, use = items[parent[best]]
        taken[i] += use
        best -= use * int(sizes[i])
    return taken


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        seed: int = 5, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: ``<id>, <keep...>, source, size, source_size, target, copies, taken``."""
    clash = {"source", "size", "source_size", "target", "copies", "taken"}
    extra = [c for c in keep if c not in clash and c != id_col]
    sized = scratch(docs.select(
        F.col(id_col), *extra, F.monotonically_increasing_id().alias("_k"), F.col(source_col).cast("string").alias("source"),
        word_count(F.col(text_col)).alias("size"),
        (F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).alias("_u")), "sized")
    rows = sized.select("_k", id_col, "source", "size", "_u")  # the kept columns are joined last
    histogram = scratch(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    per_source = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    targets = scratch(source_targets(per_source, weights, share), "targets")

    def plan(group: pd.DataFrame) -> pd.DataFrame:
        """One source: its distinct sizes and counts (bounded by the longest text, not by rows)."""
        group = group.sort_values("size")
        size, n = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        whole, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        base = 1 if target >= whole else 0
        take = fit_counts(size, n, target - base * whole)
        return group.assign(base=base, take=take)[["source", "size", "n", "source_size", "target", "base", "take"]]

    plans = histogram.join(targets, histogram.source.eqNullSafe(targets.source)).drop(targets.source) \
        .groupBy("source").applyInPandas(
            plan, "source string, size long, n long, source_size long, target double, base long, take long")
    plans = scratch(plans, "plans")
    ranges = F.ceil(F.col("n") / F.lit(RANGE_ROWS)).cast("long")

    def placed(df: DataFrame) -> DataFrame:
        """Join the plan of the row's (source, size); ``_b`` is the row's hash range there."""
        p = plans.select(F.col("source").alias("_s"), F.col("size").alias("_z"), "n", "source_size",
                         "target", "base", "take")
        return df.join(p, df.source.eqNullSafe(F.col("_s")) & (df["size"] == F.col("_z"))).drop("_s", "_z") \
            .withColumn("_b", F.floor(F.col("_u") * ranges))

    edge = placed(rows.select("source", "size", "_u")).filter("take > 0 and take < n") \
        .groupBy("source", "size", "_b").agg(F.count(F.lit(1)).alias("in_range"), F.first("take").alias("take"))
    before = Window.partitionBy("source", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("quota", F.col("take") - F.coalesce(F.sum("in_range").over(before), F.lit(0))) \
        .select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_b").alias("_r"),
                "in_range", "quota")
    joined = placed(rows).join(
        edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
        & (F.col("_b") == F.col("_r")), "left").drop("_s", "_z", "_r")
    whole = F.when(F.col("take") >= F.col("n"), True).when(F.col("take") <= 0, False) \
        .when(F.col("quota") >= F.col("in_range"), True).when(F.col("quota") <= 0, False)
    joined = joined.withColumn("_whole", whole)
    clear = joined.filter("_whole is not null").withColumn("_more", F.col("_whole").cast("long"))
    order = Window.partitionBy("source", "size", "_b").orderBy("_u", id_col)
    split = joined.filter("_whole is null").withColumn(
        "_more", (F.row_number().over(order) <= F.col("quota")).cast("long"))
    out = clear.unionByName(split).withColumn(
        "copies", F.when(F.col("size") > 0, F.col("base") + F.col("_more")).otherwise(F.lit(0)).cast("long"))
    out = out.select("_k", id_col, "source", "size", "source_size", "target", "copies",
                     (F.col("copies") * F.col("size")).alias("taken"))
    if extra:
        out = out.join(sized.select("_k", *extra), "_k")
    return out.select(id_col, *extra, "source", "size", "source_size", "target", "copies", "taken")
