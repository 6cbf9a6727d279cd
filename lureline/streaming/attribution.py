"""Structured Streaming attribution (T1) of resolved hits.

T1 re-aims the tracker: deliveries and resolved hits arrive as one stream keyed by target. Targets are
hashed into a fixed number of buckets, so a micro-batch calls Python once per bucket and not once per
target, and a call credits the hits of all its targets at once. ``applyInPandasWithState`` keeps, per
target, the deliveries still inside the lateness window (plus the latest older one). Each micro-batch is ordered by event time (deliveries before hits at
equal time) and a hit is credited on arrival to the latest delivery at or before it; a delivery
that arrives later does not re-credit an earlier hit. A target's state expires by event-time timeout
once the watermark passes its newest delivery plus ``ttl``.

Sources and sinks are files under the shared ``spark.checkpoint.dir`` (never a machine-local
folder); the checkpoint makes the query restartable after a driver or executor loss.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lureline.session import ensure_checkpoint_dir

STREAM_SCHEMA = T.StructType([
    T.StructField("target_id", T.LongType()),
    T.StructField("kind", T.IntegerType()),          # 0 delivery, 1 hit
    T.StructField("ts", T.TimestampType()),
    T.StructField("id", T.LongType()),               # event id (delivery) or hit id
    T.StructField("campaign_id", T.LongType()),
    T.StructField("template_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("uid", T.StringType()),
])

OUTPUT_SCHEMA = T.StructType([
    T.StructField("hit_id", T.LongType()),
    T.StructField("campaign_id", T.LongType()),
    T.StructField("target_id", T.LongType()),
    T.StructField("template_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("occurred_at", T.TimestampType()),
    T.StructField("delivery_id", T.LongType()),
    T.StructField("uid", T.StringType()),
])

#: The deliveries of a bucket of targets: int64 rows target_id, ts, id, campaign_id, template_id.
STATE_SCHEMA = T.StructType([T.StructField("deliveries", T.BinaryType())])

#: Fixed value: buckets that the targets are hashed into (groups of a micro-batch, rows of state).
BUCKETS = 1024

US = 1_000_000


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one streaming run inside the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def stream_rows(deliveries: DataFrame, resolved_hits: DataFrame) -> DataFrame:
    """Deliveries (from the event log) and resolved hits in the stream's row shape."""
    d = deliveries.where(F.col("event_type") == "delivered").select(
        "target_id", F.lit(0).alias("kind"), F.col("occurred_at").cast("timestamp").alias("ts"),
        "id", "campaign_id", "template_id", F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("string").alias("uid"))
    h = resolved_hits.select(
        "target_id", F.lit(1).alias("kind"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("hit_id").alias("id"), F.lit(None).cast("long").alias("campaign_id"),
        F.lit(None).cast("long").alias("template_id"), "event_type", "uid")
    return d.unionByName(h)


def _to_us(s: pd.Series) -> np.ndarray:
    return s.astype("datetime64[us]").astype("int64").to_numpy()


def _credit(deliveries: np.ndarray, target: np.ndarray, ts: np.ndarray) -> np.ndarray:
    """For each hit the column of ``deliveries`` that it is credited to, -1 where there is none: the latest
    delivery of its target at or before it (deliveries first at equal time, the larger id winning a tie)."""
    n, m = deliveries.shape[1], len(target)
    kind = np.repeat([0, 1], [n, m])
    order = np.lexsort((np.concatenate([deliveries[2], np.zeros(m, dtype=np.int64)]), kind,
                        np.concatenate([deliveries[1], ts]), np.concatenate([deliveries[0], target])))
    latest = np.maximum.accumulate(np.where(kind[order] == 0, np.arange(n + m), -1))
    at = np.full(n + m, -1)
    at[order] = np.where(latest >= 0, order[latest], -1)
    at = at[n:]
    return np.where((at >= 0) & (deliveries[0][at] == target), at, -1) if n else at


def _prune(deliveries: np.ndarray, lateness_us: int) -> np.ndarray:
    """Of deliveries ordered by (target, time, id) those inside the lateness window of their target's newest
    one, and the latest before that window."""
    target, ts = deliveries[:2]
    last = np.searchsorted(target, target, side="right") - 1
    newest = np.maximum(ts[last], np.iinfo(np.int64).min + lateness_us)
    keep = ts >= newest - lateness_us
    keep[:-1] |= keep[1:] & (target[:-1] == target[1:])
    return deliveries[:, keep]


def _make_update(lateness_us: int, ttl_us: int | None):
    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = np.frombuffer(state.get[0], dtype=np.int64).reshape(5, -1) if state.exists else \
            np.empty((5, 0), dtype=np.int64)
        pdf = None if state.hasTimedOut else pd.concat(list(batches), ignore_index=True)
        seen = np.empty(0, dtype=np.int64) if pdf is None else pdf["target_id"].to_numpy().astype(np.int64)
        if ttl_us is not None:  # forget targets of which nothing came and that the watermark has passed
            last = np.searchsorted(kept[0], kept[0], side="right") - 1
            over = (kept[1][last] + ttl_us) // 1000 < state.getCurrentWatermarkMs()
            kept = kept[:, ~over | np.isin(kept[0], seen)]
        if pdf is not None:
            t_us = _to_us(pdf["ts"])
            is_dlv = (pdf["kind"] == 0).to_numpy()
            new = [seen[is_dlv], t_us[is_dlv]] + [pdf[c].to_numpy()[is_dlv].astype(np.int64)
                                                  for c in ("id", "campaign_id", "template_id")]
            kept = np.concatenate([kept, np.stack(new)], axis=1)
            kept = kept[:, np.lexsort((kept[2], kept[1], kept[0]))]  # by (target, ts, id)
            at = _credit(kept, seen[~is_dlv], t_us[~is_dlv])
            found = at >= 0
            if found.any():
                hits, credited = pdf[~is_dlv][found], kept[:, at[found]]
                yield pd.DataFrame({
                    "hit_id": hits["id"].to_numpy(), "campaign_id": credited[3], "target_id": credited[0],
                    "template_id": credited[4], "event_type": hits["event_type"].to_numpy(),
                    "occurred_at": hits["ts"].to_numpy(), "delivery_id": credited[2], "uid": hits["uid"].to_numpy()})
        if kept.shape[1]:
            kept = _prune(kept, lateness_us)
            state.update((kept.tobytes(),))
            if ttl_us is not None:  # a timeout must lie after the watermark
                last = np.searchsorted(kept[0], kept[0], side="right") - 1
                first_over = int(kept[1][last].min() + ttl_us) // 1000
                state.setTimeoutTimestamp(max(first_over, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
    return update


def start_attribution(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                      lateness: str = "10 minutes", ttl_days: int | None = None,
                      max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start T1: file source -> watermark -> per-target state -> parquet sink (append).

    ``lateness`` is any interval Spark can read. Without ``ttl_days`` a target's latest delivery
    stays in state for ever (one small row per target), as the batch form credits any later hit;
    with it, hits that come later than that after the newest delivery are not credited.
    """
    reader = spark.readStream.schema(STREAM_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reader.parquet(source_dir).withWatermark("ts", lateness)
    base = F.timestamp_seconds(F.lit(0))
    late = spark.range(1).select(F.unix_micros(base + F.expr(f"INTERVAL {lateness}"))).first()[0]
    fn = _make_update(late, None if ttl_days is None else ttl_days * 86400 * US)
    rows = rows.where("target_id is not null").withColumn("bucket", F.pmod(F.xxhash64("target_id"), F.lit(BUCKETS)))
    attributed = rows.groupBy("bucket").applyInPandasWithState(
        fn, OUTPUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.NoTimeout if ttl_days is None else GroupStateTimeout.EventTimeTimeout)
    writer = (attributed.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def attribution_via_stream(spark: SparkSession, deliveries: DataFrame, resolved_hits: DataFrame,
                           ranges: int = 4) -> DataFrame:
    """Add the input one time range after the other, let T1 finish each (``availableNow``, from its
    checkpoint) and read the sink."""
    from lureline.streaming.tracker import feed
    run = run_folder(spark, "stream-attribution")
    feed(spark, stream_rows(deliveries, resolved_hits), f"{run}/in",
         lambda: start_attribution(spark, f"{run}/in", f"{run}/out", f"{run}/chk"), ranges)
    out = spark.read.schema(OUTPUT_SCHEMA).parquet(f"{run}/out")
    return out.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))
