"""Global rank and running sums without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` moves every row to one task; ``partitionBy(score)``
puts a hot score value into one task. Instead:

1. a global sort (range partitioning on the full order key, so a hot score is split over
   partitions by the tie-break columns);
2. ``monotonically_increasing_id`` right after the sort encodes (partition index, position in
   partition) -- partition order equals global order after a range sort;
3. a reliable ``checkpoint`` freezes that layout, so the two uses below see the same rows in
   the same partitions even after an executor loss;
4. per-partition totals (one row per partition) are prefixed with a window over that tiny
   table and joined back by partition id (broadcast: its size is the partition count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.session import ensure_checkpoint_dir

_LOW_BITS = (1 << 33) - 1


def with_global_rank(df: DataFrame, order_cols, sum_cols=(), rank_col: str = "_rank") -> DataFrame:
    """Adds a 1-based global position ``rank_col`` and inclusive running sums ``_cum_<c>``.

    ``order_cols`` must make the order total (add a unique tie-breaker), or ties get an
    arbitrary but consistent order.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    ordered = ordered.checkpoint(eager=True)
    ordered = ordered.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_local", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
    totals = ordered.groupBy("_pid").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    prefix = totals.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_tot_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sum_cols])
    out = ordered.join(F.broadcast(prefix), "_pid", "inner")
    out = out.withColumn(rank_col, (F.col("_off_n") + F.col("_local") + 1).cast("bigint"))
    if sum_cols:
        running = Window.partitionBy("_pid").orderBy("_local").rowsBetween(Window.unboundedPreceding, 0)
        for c in sum_cols:
            out = out.withColumn(f"_cum_{c}", F.col(f"_off_{c}") + F.sum(c).over(running))
    drop = ["_mid", "_pid", "_local", "_off_n"] + [f"_off_{c}" for c in sum_cols]
    return out.drop(*drop)


def carry_forward_last(df: DataFrame, key: str, order_cols, value_col: str,
                       out_col: str = "_latest") -> DataFrame:
    """Per ``key``, the last non-null ``value_col`` at or before each row in ``order_cols`` order.

    A segmented scan without a window per key (so one key holding a third of all rows does not
    become one task):

    1. global sort on ``(key, *order_cols)`` (range partitioning; a hot key is split over
       partitions by its order columns), positions frozen by a reliable ``checkpoint``;
    2. one row per partition: first key, last key and the last non-null value of the last key;
       a window over that tiny table gives the value carried into each partition for its first
       key (a key that continues from earlier partitions always ends the partition before);
    3. a running ``last`` inside each (partition, key), seeded with the carried value.

    ``order_cols`` must make the order within a key total.
    """
    ensure_checkpoint_dir(df.sparkSession)
    ordered = df.orderBy(key, *order_cols).withColumn("_mid", F.monotonically_increasing_id())
    ordered = ordered.checkpoint(eager=True)
    ordered = ordered.withColumn("_pid", F.shiftright("_mid", 33)).withColumn(
        "_local", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
    val = F.col(value_col)
    # max_by on (key, has value, position): the row of the partition's last key, preferring
    # its last row that has a value
    ends = ordered.groupBy("_pid").agg(
        F.min(key).alias("_first"), F.max(key).alias("_last"),
        F.max_by(val, F.struct(F.col(key), val.isNotNull(), F.col("_local"))).alias("_end_val"))
    same_last = (Window.partitionBy("_last").orderBy("_pid")
                 .rowsBetween(Window.unboundedPreceding, 0))
    ends = ends.withColumn("_end_val", F.last("_end_val", ignorenulls=True).over(same_last))
    by_pid = Window.orderBy("_pid")  # one row per partition
    seeds = ends.select(
        "_pid", "_first",
        F.when(F.lag("_last").over(by_pid) == F.col("_first"),
               F.lag("_end_val").over(by_pid)).alias("_seed"))
    out = ordered.join(F.broadcast(seeds), "_pid", "inner")
    running = (Window.partitionBy("_pid", key).orderBy("_local")
               .rowsBetween(Window.unboundedPreceding, 0))
    seed = F.when(F.col(key) == F.col("_first"), F.col("_seed"))
    out = out.withColumn(out_col, F.coalesce(F.last(val, ignorenulls=True).over(running), seed))
    return out.drop("_mid", "_pid", "_local", "_first", "_seed")
