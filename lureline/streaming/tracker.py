"""T1 from raw hits and T2, exactly once.

One stream carries deliveries and raw tracker hits (a URL and a time). Every micro-batch

1. parses the URLs (C10), resolves uids against the targets table (J5) and sends the hits whose uid
   names no target to the *quarantine* table;
2. credits each resolved hit to its target's latest delivery at or before it (J6): the deliveries
   still in *state* and those of the batch go through the same range-sorted scan as the batch form,
   so a target that owns a third of a batch is spread over tasks;
3. writes attributed hits, quarantine and the pruned state, and publishes the three together under
   the batch id (``CommitLog``). A batch that is replayed after a crash changes nothing.

State is a table: per target the deliveries within ``lateness`` of its newest one, and the latest
before those. A hit is credited on arrival: micro-batches must come in event-time order up to
``lateness``, and a delivery that arrives later does not credit an earlier hit again. Input is read
in the order in which files are added; :func:`feed` adds one time range after the other and lets
the stream finish it, so the order never depends on modification times.

Running totals (T2) use update mode: a micro-batch carries the new totals of the event types that
it changed, which replace those rows of the last published snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lureline.operators import attribution
from lureline.sources.commits import CommitLog
from lureline.streaming.attribution import OUTPUT_SCHEMA

RAW_SCHEMA = "kind int, ts timestamp, id long, target_id long, campaign_id long, template_id long, url string"
STATE = "target_id long, ts timestamp, id long, campaign_id long, template_id long"
QUARANTINE = "hit_id long, uid string, event_type string, ts timestamp"
TOTALS = "event_type string, events long"


def raw_rows(event_log: DataFrame, hits: DataFrame) -> DataFrame:
    """Deliveries of the event log and raw hits in the stream's shape."""
    deliveries = event_log.where("event_type = 'delivered'").select(
        F.lit(0).alias("kind"), F.col("occurred_at").cast("timestamp").alias("ts"), "id", "target_id", "campaign_id",
        "template_id", F.lit(None).cast("string").alias("url"))
    none = F.lit(None).cast("long")
    return deliveries.unionByName(hits.select(
        F.lit(1).alias("kind"), F.col("ts").cast("timestamp").alias("ts"), F.col("hit_id").alias("id"),
        none.alias("target_id"), none.alias("campaign_id"), none.alias("template_id"), "url"))


def prune(deliveries: DataFrame, lateness: str, ttl: str | None = None) -> DataFrame:
    """The deliveries that a later hit may still be credited to."""
    newest = deliveries.groupBy("target_id").agg(F.max("ts").alias("_newest"))
    if ttl is not None:
        last = newest.agg(F.max("_newest").alias("_last"))
        newest = newest.join(F.broadcast(last), F.col("_newest") >= F.col("_last") - F.expr(f"INTERVAL {ttl}"), "left_semi")
    rows = deliveries.join(newest, "target_id")
    recent = F.col("ts") >= F.col("_newest") - F.expr(f"INTERVAL {lateness}")
    columns = ["ts", "id", "campaign_id", "template_id"]
    before = rows.where(~recent).groupBy("target_id").agg(F.max(F.struct(*columns)).alias("_d")) \
        .select("target_id", *[f"_d.{c}" for c in columns])
    return rows.where(recent).select("target_id", *columns).unionByName(before)


def attribute_batch(batch: DataFrame, state: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(attributed, quarantine, deliveries)`` of one micro-batch; times are UTC wall clock."""
    hits = attribution.parse_hits(batch.where("kind = 1").select(F.col("id").alias("hit_id"), "url", "ts"))
    deliveries = state.unionByName(batch.where("kind = 0").select(*state.columns))
    log = deliveries.select("id", "target_id", "campaign_id", "template_id", F.col("ts").alias("occurred_at"),
                            F.lit("delivered").alias("event_type"))
    attributed = attribution.attribute_hits(attribution.resolve_uids(hits, targets), log)
    unknown = attribution.unknown_uid_hits(hits, targets)
    return (attributed.select(*[F.col(f.name).cast(f.dataType) for f in OUTPUT_SCHEMA.fields]),
            unknown.select("hit_id", "uid", "event_type", "ts"), deliveries)


def start_tracker(spark: SparkSession, source: str, base: str, targets: DataFrame, lateness: str = "10 minutes",
                  ttl: str | None = None, max_files_per_trigger: int | None = None, available_now: bool = True):
    """Start T1 over the files under ``source``; tables and checkpoint live under ``base``."""
    log = CommitLog(spark, f"{base}/tables")

    def process(batch: DataFrame, epoch: int) -> None:
        if log.has(epoch):
            return
        attributed, unknown, deliveries = attribute_batch(batch, log.latest("state", STATE), targets)
        log.publish(epoch, {"attributed": log.stage(attributed, "attributed"),
                            "quarantine": log.stage(unknown, "quarantine"),
                            "state": log.stage(prune(deliveries, lateness, ttl), "state")})

    reader = spark.readStream.schema(RAW_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = reader.parquet(source).writeStream.foreachBatch(process).option("checkpointLocation", f"{base}/checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def time_ranges(rows: DataFrame, ranges: int) -> list:
    """At most ``ranges - 1`` inner bounds that split the rows' times evenly (approximate quantiles)."""
    at = [k / ranges for k in range(1, ranges)]
    micros = rows.agg(F.percentile_approx(F.unix_micros("ts"), at, 1000).alias("q")).first().q if at else None
    return sorted(set(micros or ()))


def feed(spark: SparkSession, rows: DataFrame, source: str, run, ranges: int = 4) -> None:
    """Add the rows to ``source`` one time range after the other; ``run()`` starts the stream anew
    (from its checkpoint) and it finishes each range before the next one is added. The rows are
    computed once, into a folder beside ``source``."""
    staged = f"{source.rstrip('/')}-staged"
    rows.write.mode("errorifexists").parquet(staged)
    rows = spark.read.schema(rows.schema).parquet(staged)
    bounds = time_ranges(rows, ranges)
    micros = F.coalesce(F.unix_micros("ts"), F.lit(2 ** 62))  # rows without a time come last
    for k in range(len(bounds) + 1):
        part = rows if not bounds else rows.where(
            (micros > bounds[k - 1] if k else F.lit(True)) & (micros <= bounds[k] if k < len(bounds) else F.lit(True)))
        part.write.mode("append").parquet(source)
        run().awaitTermination()


def track(spark: SparkSession, event_log: DataFrame, hits: DataFrame, targets: DataFrame, base: str,
          ranges: int = 4) -> CommitLog:
    """The whole tracker over given tables: staged in time ranges, streamed, published."""
    rows = raw_rows(event_log, hits)
    feed(spark, rows, f"{base}/in", lambda: start_tracker(spark, f"{base}/in", base, targets), ranges)
    return CommitLog(spark, f"{base}/tables")


def start_totals(spark: SparkSession, source: str, base: str, max_files_per_trigger: int | None = None):
    """Running counts per event type, in update mode; ``totals`` is a snapshot table."""
    log = CommitLog(spark, f"{base}/tables")

    def merge(changed: DataFrame, epoch: int) -> None:
        if log.has(epoch):  # published before a crash; the counts must still reach the state store
            changed.write.format("noop").mode("overwrite").save()
            return
        kept = log.latest("totals", TOTALS).join(changed.select("event_type"), "event_type", "left_anti")
        log.publish(epoch, {"totals": log.stage(kept.unionByName(changed.select("event_type", "events")), "totals")})

    reader = spark.readStream.schema("id long, event_type string, ts timestamp")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    counts = reader.parquet(source).groupBy("event_type").agg(F.count(F.lit(1)).cast("bigint").alias("events"))
    return (counts.writeStream.outputMode("update").foreachBatch(merge)
            .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())


def totals(spark: SparkSession, event_log: DataFrame, base: str, ranges: int = 3) -> DataFrame:
    """T2 over a given log, one time range after the other."""
    rows = event_log.select("id", "event_type", F.col("occurred_at").cast("timestamp").alias("ts"))
    feed(spark, rows, f"{base}/in", lambda: start_totals(spark, f"{base}/in", base), ranges)
    return CommitLog(spark, f"{base}/tables").latest("totals", TOTALS)


def local_time(df: DataFrame, *columns: str) -> DataFrame:
    """Timestamps as wall-clock times without a zone, as the event log has them."""
    return df.withColumns({c: F.col(c).cast(T.TimestampNTZType()) for c in columns})
