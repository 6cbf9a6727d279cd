"""Event counts, the interaction fact and dataset cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.constants import (
    CLEAN_TEXT_COLUMNS,
    EVENT_TYPES,
    FEATURE_COLUMNS,
    SIGNAL_COLUMNS,
    SIGNAL_KEYS,
    SOURCE_OBSERVED,
    TARGET_COLUMN,
)
from lureline.functions.expressions import normalize_label, signal_flag, strip_ws

FACT_COLUMNS = (
    "source", "campaign_id", "campaign_status", "campaign_channel", "campaign_launched_at",
    "template_id", "template_name", "template_subject", "template_description",
    "signal_urgency", "signal_authority", "signal_reward", "signal_personalization",
    "segment_id", "age_bracket", "gender", "education",
    "target_id", "target_recipient", "target_uid",
    "delivered", "opened", "clicked", "reported",
    "opened_flag", "clicked_flag", "reported_flag",
)


def event_counts(event_log: DataFrame) -> DataFrame:
    """A2: one row per (campaign, target) with counts of the four counted event types.

    The type filter reaches the scan; ``count_if`` makes it a single pivot that Spark splits
    into a map-side partial aggregate and a final aggregate, so only one small row per pair
    and map task is shuffled, whatever the skew of a pair.
    """
    counted = event_log.where(F.col("event_type").isin(*EVENT_TYPES))
    return counted.groupBy("campaign_id", "target_id").agg(
        *[F.count_if(F.col("event_type") == t).cast("bigint").alias(t) for t in EVENT_TYPES]
    )


def template_dimension(templates: DataFrame) -> DataFrame:
    """Templates with the four signal flags parsed out of the JSON."""
    return templates.select(
        F.col("id").alias("template_id"),
        F.col("name").alias("template_name"),
        F.col("subject").alias("template_subject"),
        F.col("description").alias("template_description"),
        *[signal_flag("signals", key).alias(col) for col, key in SIGNAL_KEYS.items()],
    )


def campaign_dimension(campaigns: DataFrame, templates: DataFrame,
                       segments: DataFrame) -> DataFrame:
    """J1 + J2: campaigns left-joined to template and segment (missing -> nulls, signals 0).

    Keeps the campaign's own ``segment_id`` as ``_seg_key`` for the target fan-out; the output
    ``template_id`` / ``segment_id`` come from the dimension, null when it is missing.
    """
    # templates / segments are dimension tables: Catalyst broadcasts them from their size
    # estimate (autoBroadcastJoinThreshold) and AQE re-checks with the real size at run time.
    tpl = template_dimension(templates)
    seg = segments.select(F.col("id").alias("_seg_id"), "age_bracket", "gender", "education")
    c = campaigns.select(
        F.col("id").alias("campaign_id"),
        F.col("status").alias("campaign_status"),
        F.col("channel").alias("campaign_channel"),
        F.col("launched_at").alias("campaign_launched_at"),
        F.col("template_id").alias("_tpl_key"),
        F.col("segment_id").alias("_seg_key"),
    )
    out = (c.join(tpl, c._tpl_key == tpl.template_id, "left")
            .join(seg, c._seg_key == seg._seg_id, "left"))
    return out.select(
        "campaign_id", "campaign_status", "campaign_channel", "campaign_launched_at",
        "template_id", "template_name", "template_subject", "template_description",
        *[F.coalesce(F.col(s), F.lit(0)).cast("int").alias(s) for s in SIGNAL_COLUMNS],
        F.col("_seg_id").alias("segment_id"), "age_bracket", "gender", "education", "_seg_key",
    )


def target_pairs(campaigns: DataFrame, targets: DataFrame) -> DataFrame:
    """Narrow (campaign, target) rows, one per target of the campaign's segment.

    No hint: Catalyst broadcasts the campaign keys from their size and AQE splits a segment that
    holds most targets where they are not small.
    """
    keys = campaigns.select(F.col("id").alias("campaign_id"), F.col("segment_id").alias("_seg"))
    members = targets.select(F.col("segment_id").alias("_seg"), F.col("id").alias("target_id"),
                             F.col("recipient").alias("target_recipient"), F.col("uid").alias("target_uid"))
    return members.join(keys, "_seg").drop("_seg")


def fact_rows(campaigns: DataFrame, templates: DataFrame, segments: DataFrame,
              targets: DataFrame, source: str = SOURCE_OBSERVED) -> DataFrame:
    """The grain and dimension columns of F1 without its event counts, for consumers that
    replace the counts (scenario cohorts)."""
    dim = campaign_dimension(campaigns, templates, segments)
    pairs = target_pairs(campaigns, targets).join(dim, "campaign_id")
    return pairs.select(
        F.lit(source).alias("source"),
        *[c for c in FACT_COLUMNS[1:] if c not in (
            *EVENT_TYPES, "opened_flag", "clicked_flag", "reported_flag")])


def interaction_fact(campaigns: DataFrame, templates: DataFrame, segments: DataFrame,
                     targets: DataFrame, event_log: DataFrame,
                     source: str = SOURCE_OBSERVED) -> DataFrame:
    """one row per (campaign, target of the campaign's segment), 27 columns.

    Plan: narrow (campaign, target) pairs, one left join with the pair counts (A2, combined
    map-side) on both keys, and the dimension columns attached last by campaign, so no wide row is
    ever sorted or shuffled. Events that name no campaign or target match nothing. The N+1
    per-pair count queries of the original become one aggregate and one join.
    """
    counted = target_pairs(campaigns, targets).join(
        event_counts(event_log), ["campaign_id", "target_id"], "left")
    fact = counted.join(campaign_dimension(campaigns, templates, segments), "campaign_id")
    zero = {t: F.coalesce(F.col(t), F.lit(0)).cast("bigint") for t in EVENT_TYPES}
    return fact.select(
        F.lit(source).alias("source"),
        "campaign_id", "campaign_status", "campaign_channel", "campaign_launched_at",
        "template_id", "template_name", "template_subject", "template_description",
        *SIGNAL_COLUMNS,
        "segment_id", "age_bracket", "gender", "education",
        "target_id", "target_recipient", "target_uid",
        *[zero[t].alias(t) for t in EVENT_TYPES],
        *[(zero[t] > 0).cast("int").alias(f"{t}_flag") for t in ("opened", "clicked", "reported")],
    )


def clean_dataset(df: DataFrame) -> DataFrame:
    """categorical/text null -> 'unknown'; signal and label null -> 0 (int).

    Only columns present are touched, as in the original.
    """
    out = []
    for name in df.columns:
        c = F.col(name)
        if name in CLEAN_TEXT_COLUMNS:
            c = F.coalesce(c.cast("string"), F.lit("unknown"))
        elif name in SIGNAL_COLUMNS or name == TARGET_COLUMN:
            c = F.coalesce(c.cast("int"), F.lit(0))
        out.append(c.alias(name))
    return df.select(*out)


def clean_strict(df: DataFrame) -> DataFrame:
    """Signals as double, non-numeric -> 0.0; categorical null -> 'unknown', trimmed."""
    out = []
    for name in df.columns:
        c = F.col(name)
        if name in SIGNAL_COLUMNS:
            c = F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))
        elif name in ("age_bracket", "gender", "education"):
            c = strip_ws(F.coalesce(c.cast("string"), F.lit("unknown")))
        out.append(c.alias(name))
    return df.select(*out)


def normalize_labels(df: DataFrame, column: str = TARGET_COLUMN, drop_null: bool = True) -> DataFrame:
    """P5 + P10: label to 0/1 by its type; rows whose label is null are dropped."""
    dtype = dict(df.dtypes)[column]
    if dtype == "boolean":
        label = F.col(column).cast("int")
    else:
        label = normalize_label(column, numeric=dtype != "string")
    out = df.withColumn(column, label)
    return out.dropna(subset=[column]) if drop_null else out


def require_columns(df: DataFrame, required) -> None:
    """Q5: fail at plan time (no job) when required columns are missing; lists them sorted."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"dataset lacks required columns: {missing}")


def feature_matrix(df: DataFrame, keys=("source", "campaign_id", "target_id")) -> DataFrame:
    """P9 + P11: features, label and the natural row key that links predictions back."""
    require_columns(df, list(FEATURE_COLUMNS) + [TARGET_COLUMN])
    key_cols = [k for k in keys if k in df.columns]
    return df.select(*key_cols, *FEATURE_COLUMNS, TARGET_COLUMN)


def combine_sources(observed: DataFrame, synthetic: DataFrame) -> DataFrame:
    """Union by name, absent columns null, duplicates kept; ``source`` filled first."""
    def with_source(df: DataFrame, default: str) -> DataFrame:
        if "source" in df.columns:
            return df.withColumn("source", F.coalesce(F.col("source"), F.lit(default)))
        return df.withColumn("source", F.lit(default))
    return with_source(observed, SOURCE_OBSERVED).unionByName(
        with_source(synthetic, "synthetic"), allowMissingColumns=True)
