"""Hit parsing and attribution of hits to the latest delivery.

A tracker hit carries only a ``uid``. It is credited to the target's latest delivery at the
time of the hit; a hit with no earlier delivery is dropped, and a ``uid`` that names no target is
quarantined (the tracker answered 404).

The as-of step is written for skew: a single target may own a large share of all hits (even
within one hour), so a window partitioned by target would funnel that share into one task.
Deliveries and hits are unioned and handed to ``ranking.carry_forward_last``: a global range
sort on (target, time, kind, id) splits a hot target over partitions, and the latest delivery is
carried across partition boundaries through a table with one row per partition. Every window
then runs inside one range partition, whose size is bounded whatever the key distribution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.constants import HIT_ROUTES
from lureline.operators.ranking import carry_forward_last


def parse_hits(hits: DataFrame, url_col: str = "url") -> DataFrame:
    """``uid`` and event type from a tracker URL; unknown routes get a null type."""
    path = F.parse_url(F.col(url_col), F.lit("PATH"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in HIT_ROUTES.items() for x in kv]), path)
    return hits.select(
        "hit_id",
        F.parse_url(F.col(url_col), F.lit("QUERY"), F.lit("uid")).alias("uid"),
        kind.alias("event_type"),
        F.col("ts"),
    )


def resolve_uids(parsed_hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Hits whose ``uid`` names a target, with its ``target_id`` (inner join on uid).

    Targets grow with the input and a computed uid is wider than the columns it is estimated by, so
    they are merged, never gathered on the driver for a broadcast."""
    t = targets.where(F.col("uid").isNotNull()).select(
        F.col("uid"), F.col("id").alias("target_id")).hint("merge")
    return parsed_hits.where(F.col("event_type").isNotNull()).join(t, "uid", "inner")


def unknown_uid_hits(parsed_hits: DataFrame, targets: DataFrame) -> DataFrame:
    """J5 quarantine: hits whose uid matches no target (``left_anti``, merged as in :func:`resolve_uids`)."""
    t = targets.where(F.col("uid").isNotNull()).select("uid").hint("merge")
    return parsed_hits.join(t, "uid", "left_anti")


def attribute_hits(resolved_hits: DataFrame, event_log: DataFrame) -> DataFrame:
    """Credit each resolved hit to the target's latest delivery at or before the hit.

    Order inside a target: (time, kind, id) with deliveries before hits at equal time, and the
    delivery with the larger id winning a time tie. Output: one attributed event per hit.
    """
    deliveries = event_log.where(F.col("event_type") == "delivered").select(
        "target_id",
        F.col("occurred_at").alias("ts"),
        F.lit(0).alias("_kind"),
        F.col("id").alias("_id"),
        F.struct(F.col("occurred_at").alias("ts"), F.col("id").alias("id"),
                 "campaign_id", "template_id").alias("dlv"),
        F.lit(None).cast("string").alias("event_type"),
        F.lit(None).cast("string").alias("uid"),
    )
    hits = resolved_hits.select(
        "target_id", "ts", F.lit(1).alias("_kind"), F.col("hit_id").alias("_id"),
        F.lit(None).cast(deliveries.schema["dlv"].dataType).alias("dlv"), "event_type", "uid",
    )
    rows = deliveries.unionByName(hits)
    resolved = carry_forward_last(rows, "target_id", ("ts", "_kind", "_id"), "dlv", "latest")
    return resolved.where((F.col("_kind") == 1) & F.col("latest").isNotNull()).select(
        F.col("_id").alias("hit_id"),
        F.col("latest.campaign_id").alias("campaign_id"),
        "target_id",
        F.col("latest.template_id").alias("template_id"),
        "event_type",
        F.col("ts").alias("occurred_at"),
        F.col("latest.id").alias("delivery_id"),
        "uid",
    )


def attribute_hits_sql(hits_view: str = "resolved", log_view: str = "event_log") -> str:
    """The same attribution as one DuckDB window (oracle side)."""
    return f"""SELECT hit_id, latest.campaign_id AS campaign_id, target_id,
    latest.template_id AS template_id, event_type, ts AS occurred_at, latest.id AS delivery_id, uid
  FROM (
    SELECT *, last_value(dlv IGNORE NULLS) OVER (PARTITION BY target_id ORDER BY ts, kind, oid
           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest
    FROM (
      SELECT target_id, occurred_at AS ts, 0 AS kind, id AS oid,
             {{'id': id, 'campaign_id': campaign_id, 'template_id': template_id}} AS dlv,
             NULL AS hit_id, NULL AS event_type, NULL AS uid
        FROM {log_view} WHERE event_type = 'delivered'
      UNION ALL
      SELECT target_id, ts, 1, hit_id, NULL, hit_id, event_type, uid FROM {hits_view}
    ) u
  ) w
  WHERE kind = 1 AND latest IS NOT NULL"""
