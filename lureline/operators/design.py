"""Experiment design.

The plan tables are dimension-sized (templates x repetitions), so the few global orderings here
run over a bounded number of rows; the expansion to deliveries (X4) is the part that grows with
the targets and is a plain equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.operators.facts import template_dimension
from lureline.operators.quality import template_validation


def _hash_order(seed: int, *cols: str) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def sampling_plan(segments: DataFrame, templates: DataFrame, targets: DataFrame,
                  campaigns_per_template: int = 2, seed: int = 42) -> DataFrame:
    """Balanced randomised assignment of segments to (email template, repetition) slots.

    Slots are numbered in template/repetition order; slot s falls in block s div S at position
    s mod S, where S is the number of segments that have targets. Each block is an independent
    keyed-hash permutation of those segments (W4), so within a block every segment is used once
    and counts per segment differ by at most one. The final execution order is a keyed shuffle
    (W3). Fails when there is no segment, email template or eligible segment.
    """
    counts = targets.groupBy(F.col("segment_id").alias("id")).agg(
        F.count(F.lit(1)).cast("bigint").alias("segment_target_count"))
    eligible = segments.join(counts, "id", "inner")
    tpl = template_dimension(templates.where(F.col("channel") == "email"))
    n_seg, n_eligible = segments.count(), eligible.count()
    n_tpl = tpl.count()
    if n_seg == 0:
        raise ValueError("no segments")
    if n_tpl == 0:
        raise ValueError("no email templates")
    if n_eligible == 0:
        raise ValueError("no segment has targets")
    slots = tpl.select("*", F.explode(F.sequence(F.lit(1), F.lit(campaigns_per_template))).alias("repetition"))
    # plan-sized ordering (templates x repetitions rows)
    slots = slots.withColumn("_slot", F.row_number().over(Window.orderBy("template_id", "repetition")) - 1)
    slots = slots.withColumn("_block", F.floor(F.col("_slot") / n_eligible).cast("int")).withColumn(
        "_pos", (F.col("_slot") % n_eligible).cast("int"))
    n_blocks = -(-n_tpl * campaigns_per_template // n_eligible)
    perm = eligible.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block"))
    perm = perm.withColumn("_pos", (F.row_number().over(
        Window.partitionBy("_block").orderBy(_hash_order(seed, "_block", "id"), "id")) - 1).cast("int"))
    plan = slots.join(perm.select(F.col("id").alias("segment_id"), "age_bracket", "gender", "education",
                                  "segment_target_count", "_block", "_pos"), ["_block", "_pos"], "inner")
    plan = plan.withColumn("assignment_id", (F.col("_slot") + 1).cast("bigint"))
    plan = plan.withColumn("execution_order", F.row_number().over(
        Window.orderBy(_hash_order(seed, "assignment_id"), "assignment_id")).cast("bigint"))
    return plan.select(
        "assignment_id", "template_id", "template_name", "template_subject",
        "signal_urgency", "signal_authority", "signal_reward", "signal_personalization",
        "segment_id", "age_bracket", "gender", "education", "segment_target_count",
        F.lit("email").alias("campaign_channel"), F.col("repetition").cast("int").alias("repetition"),
        F.lit(seed).alias("random_seed"), F.lit("planned").alias("status"), "execution_order",
    )


def plan_balance(plan: DataFrame) -> DataFrame:
    """Assignments per segment, with the spread (max - min) the balance rule bounds by 1."""
    per = plan.groupBy("segment_id").agg(F.count(F.lit(1)).cast("bigint").alias("assignments"))
    everything = Window.partitionBy()  # one row per segment: a bounded frame
    spread = F.max("assignments").over(everything) - F.min("assignments").over(everything)
    return per.select("segment_id", "assignments", (spread <= 1).alias("balanced"))


def materialize_plan(plan: DataFrame, templates: DataFrame, segments: DataFrame,
                     campaigns: DataFrame, limit: int | None = None) -> DataFrame:
    """Plan -> new draft campaigns; returns the map assignment -> campaign
    (:func:`draft_campaigns` gives the campaign rows).

    K4 (first ``limit`` rows by execution order) is the feature here, then J8 keeps rows whose
    template and segment exist (two semi-joins), and new ids continue after the current max.
    """
    rows = plan
    if limit is not None:
        rows = rows.orderBy("execution_order").limit(limit)
    rows = (rows.join(templates.select(F.col("id").alias("template_id")), "template_id", "left_semi")
                .join(segments.select(F.col("id").alias("segment_id")), "segment_id", "left_semi"))
    start = campaigns.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_start")).first()["_start"]
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy("execution_order")))
    return numbered.select(
        F.col("assignment_id").cast("bigint").alias("assignment_id"),
        (F.lit(start) + F.col("_n")).cast("bigint").alias("campaign_id"),
        F.col("template_id").cast("bigint").alias("template_id"),
        F.col("segment_id").cast("bigint").alias("segment_id"),
        F.col("execution_order").cast("bigint").alias("execution_order"),
        F.lit("created").alias("status"),
    )


def draft_campaigns(created: DataFrame) -> DataFrame:
    """The campaign rows of a materialised plan, in the shape of the campaigns table."""
    return created.select(
        F.col("campaign_id").alias("id"), F.lit("email").alias("channel"),
        F.lit(None).cast("timestamp_ntz").alias("launched_at"), F.lit("draft").alias("status"),
        "template_id", "segment_id")


def assigned_uids(targets: DataFrame) -> DataFrame:
    """The targets with a uid where it was null or empty (repeatable: md5 of the id)."""
    fresh = F.md5(F.concat(F.lit("uid|"), F.col("id").cast("string")))
    return targets.withColumn("uid", F.when(F.coalesce("uid", F.lit("")) == "", fresh).otherwise(F.col("uid")))


def expand_deliveries(campaigns: DataFrame, templates: DataFrame, targets: DataFrame) -> DataFrame:
    """One ``delivered`` event row per target of each launchable campaign.

    Launchable = not yet launched and its template passes validation (Q1). A target without a
    uid gets a repeatable one (md5 of its id) instead of a random uuid. Produces event rows
    only; nothing is rendered or sent.
    """
    valid = template_validation(templates).where("valid").select(F.col("template_id").alias("_vt"))
    camp = campaigns.where(F.col("status") != "launched").join(
        valid, F.col("template_id") == F.col("_vt"), "left_semi")
    camp = camp.select(F.col("id").alias("campaign_id"), "template_id", F.col("segment_id").alias("_cseg"))
    tg = assigned_uids(targets).select(F.col("id").alias("target_id"), "segment_id", "uid")
    rows = tg.join(camp, F.col("segment_id") == F.col("_cseg"), "inner")
    return rows.select(
        "campaign_id", "target_id", F.col("template_id").cast("bigint").alias("template_id"),
        F.lit("delivered").alias("event_type"),
        "uid",
    )
