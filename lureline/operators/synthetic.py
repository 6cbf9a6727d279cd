"""Synthetic outcomes with known effects (X5-X8) and the contrasts that must recover them
(A14-A16).

Randomness is a keyed hash of (seed, row key), never ``rand()``: the same row gets the same draw
at any partitioning, on any cluster size, and in the DuckDB oracle. Cohorts are built on rows
Spark derives from the input tables (the interaction fact, the targets), so they grow with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline import constants as K
from lureline.functions.expressions import clamp, keyed_uniform, lookup, sigmoid

PROB_DECIMALS = 10


def _signal(name: str) -> F.Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def open_score(age: F.Column, education: F.Column, gender: F.Column) -> F.Column:
    score = (F.lit(K.OPEN_INTERCEPT) + lookup(age, K.AGE_EFFECT)
             + lookup(education, K.EDUCATION_EFFECT) * F.lit(K.OPEN_EDUCATION_SCALE)
             + lookup(gender, K.GENDER_EFFECT))
    for col, w in K.OPEN_SIGNAL_WEIGHTS.items():
        score = score + F.lit(w) * _signal(col)
    return score


def click_score(age: F.Column, education: F.Column, gender: F.Column) -> F.Column:
    score = (F.lit(K.CLICK_INTERCEPT) + lookup(age, K.AGE_EFFECT) * F.lit(K.CLICK_AGE_SCALE)
             + lookup(education, K.EDUCATION_EFFECT) + lookup(gender, K.GENDER_EFFECT))
    for col, w in K.CLICK_SIGNAL_WEIGHTS.items():
        score = score + F.lit(w) * _signal(col)
    both = (F.col("signal_urgency") == 1) & (F.col("signal_authority") == 1)
    return score + F.when(both, F.lit(K.CLICK_URGENCY_AUTHORITY_BONUS)).otherwise(F.lit(0.0))


def score_probabilities(df: DataFrame) -> DataFrame:
    """Closed-form open and click probabilities of any fact-shaped frame."""
    age, edu, gen = F.col("age_bracket"), F.col("education"), F.col("gender")
    p_open = clamp(sigmoid(open_score(age, edu, gen)), *K.OPEN_CLAMP)
    p_click = clamp(sigmoid(click_score(age, edu, gen)), *K.CLICK_CLAMP)
    return df.withColumn("open_probability", F.bround(p_open, PROB_DECIMALS)).withColumn(
        "click_probability", F.bround(p_click, PROB_DECIMALS))


def scenario_probabilities(scenario: F.Column, personalized: F.Column,
                           experimental: F.Column) -> tuple[F.Column, F.Column]:
    """X6 design: (p_open, p_click_given_open) per scenario; an unknown scenario raises."""
    p_open = (
        F.when(scenario == "control", F.lit(K.CONTROL_P[0]))
        .when(scenario == "personalization",
              F.when(personalized, F.lit(K.PERSONALIZATION_P_OPEN["personalized"]))
              .otherwise(F.lit(K.PERSONALIZATION_P_OPEN["other"])))
        .when(scenario == "segment", F.lit(K.SEGMENT_P_OPEN))
        .when(scenario == "interaction",
              F.when(experimental & personalized, F.lit(K.INTERACTION_P_OPEN["experimental_personalized"]))
              .when(personalized, F.lit(K.INTERACTION_P_OPEN["personalized"]))
              .when(experimental, F.lit(K.INTERACTION_P_OPEN["experimental"]))
              .otherwise(F.lit(K.INTERACTION_P_OPEN["other"])))
        .otherwise(F.raise_error(F.concat(F.lit("unknown scenario: "), scenario)).cast("double"))
    )
    p_click = (
        F.when(scenario == "control", F.lit(K.CONTROL_P[1]))
        .when(scenario == "personalization", F.lit(K.PERSONALIZATION_P_CLICK))
        .when(scenario == "segment",
              F.when(experimental, F.lit(K.SEGMENT_P_CLICK["experimental"]))
              .otherwise(F.lit(K.SEGMENT_P_CLICK["other"])))
        .when(scenario == "interaction", F.lit(K.INTERACTION_P_CLICK))
        .otherwise(F.raise_error(F.concat(F.lit("unknown scenario: "), scenario)).cast("double"))
    )
    return p_open, p_click


def scenario_cohort(fact: DataFrame, scenarios=K.SCENARIOS, seed: int = 42,
                    experimental_segment: int = K.EXPERIMENTAL_SEGMENT_ID) -> DataFrame:
    """Every fact row once per scenario with planted open/click probabilities and draws.

    Click only after an open; reported = 0; delivered = 1. The scenario copy is a generator
    (``explode``) on each row, so the cohort is built map-side with no shuffle.
    """
    for s in scenarios:
        if s not in K.SCENARIOS:
            raise ValueError(f"unknown scenario: {s}")
    base = fact.select("*", F.explode(F.array(*[F.lit(s) for s in scenarios])).alias("scenario"))
    experimental = F.coalesce(F.col("segment_id") == experimental_segment, F.lit(False))
    personalized = F.coalesce(F.col("signal_personalization") == 1, F.lit(False))
    p_open, p_click = scenario_probabilities(F.col("scenario"), personalized, experimental)
    u_open = keyed_uniform(seed, "scenario", "campaign_id", "target_id", F.lit("open"))
    u_click = keyed_uniform(seed, "scenario", "campaign_id", "target_id", F.lit("click"))
    opened = (u_open < p_open).cast("int")
    clicked = F.when(opened == 1, (u_click < p_click).cast("int")).otherwise(F.lit(0))
    out = base.select(
        F.lit(K.SOURCE_SCENARIO).alias("source"), "scenario", F.lit(seed).alias("scenario_seed"),
        *[c for c in fact.columns if c not in (
            "source", "delivered", "opened", "clicked", "reported",
            "opened_flag", "clicked_flag", "reported_flag")],
        experimental.cast("int").alias("experimental_target_segment"),
        F.lit(1).cast("bigint").alias("delivered"),
        opened.cast("bigint").alias("opened"),
        clicked.cast("bigint").alias("clicked"),
        F.lit(0).cast("bigint").alias("reported"),
        opened.alias("opened_flag"), clicked.cast("int").alias("clicked_flag"),
        F.lit(0).alias("reported_flag"),
        p_open.alias("expected_open_probability"),
        p_click.alias("expected_click_given_open_probability"),
    )
    return out


def _rate(cond: F.Column, flag: str) -> F.Column:
    """sum(flag) / rows * 100 over the rows meeting ``cond``; 0.0 for an empty group (unrounded)."""
    n = F.count_if(cond)
    s = F.sum(F.when(cond, F.col(flag))).cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise(F.coalesce(s, F.lit(0.0)) / n.cast("double") * 100.0)


def scenario_validation(cohort: DataFrame) -> DataFrame:
    """A14 + A15 + A16: the three two-group contrasts and the difference-in-differences.

    One aggregate per scenario (grouped by scenario, so one shuffle of a handful of partial
    rows); rates are unrounded until the difference is taken, then rounded half-even to 2.
    """
    pers = F.col("signal_personalization") == 1
    nopers = F.col("signal_personalization") == 0
    exp_ = F.col("experimental_target_segment") == 1
    other = F.col("experimental_target_segment") == 0
    agg = cohort.groupBy("scenario").agg(
        _rate(pers, "opened_flag").alias("open_with"),
        _rate(nopers, "opened_flag").alias("open_without"),
        _rate(exp_, "clicked_flag").alias("click_exp"),
        _rate(other, "clicked_flag").alias("click_other"),
        _rate(exp_ & pers, "opened_flag").alias("tp"),
        _rate(exp_ & nopers, "opened_flag").alias("tn"),
        _rate(other & pers, "opened_flag").alias("op"),
        _rate(other & nopers, "opened_flag").alias("on"),
    )
    sc = F.col("scenario")
    a = (F.when(sc.isin("control", "personalization"), F.col("open_with"))
         .when(sc == "segment", F.col("click_exp"))
         .otherwise(F.col("tp") - F.col("tn")))
    b = (F.when(sc.isin("control", "personalization"), F.col("open_without"))
         .when(sc == "segment", F.col("click_other"))
         .otherwise(F.col("op") - F.col("on")))

    def label(i: int) -> F.Column:
        m = F.create_map(*[F.lit(x) for s, row in K.SCENARIO_ROWS.items() for x in (s, row[i])])
        return F.element_at(m, sc)

    return agg.select(
        label(0).alias("scenario"), label(1).alias("comparison"),
        label(2).alias("group_a"), F.bround(a, 2).alias("group_a_rate_pct"),
        label(3).alias("group_b"), F.bround(b, 2).alias("group_b_rate_pct"),
        F.bround(a - b, 2).alias("difference_pp"),
        label(4).alias("expected_pattern"),
    )


def synthetic_population(segments: DataFrame, templates: DataFrame, targets: DataFrame,
                         campaigns_per_template: int = 10, seed: int = 42) -> DataFrame:
    """Synthetic campaigns (email template x repetition, keyed-random segment each) over
    the real targets of the chosen segment, with X8 probabilities and X5 draws.

    The segment pick joins a small ranked segment dimension; the fan-out over targets is an
    equi-join on segment_id without a hint.
    """
    from lureline.operators.facts import template_dimension

    n_seg = segments.count()
    if n_seg == 0:
        raise ValueError("no segments")
    seg_rank = segments.select(
        F.row_number().over(_by_id()).alias("_rank"),
        F.col("id").alias("segment_id"), "age_bracket", "gender", "education")
    tpl = template_dimension(templates.where(F.col("channel") == "email"))
    camp = tpl.select("*", F.explode(F.sequence(F.lit(1), F.lit(campaigns_per_template))).alias("repetition"))
    camp = camp.select(
        "*",
        ((F.col("template_id") - 1) * campaigns_per_template + F.col("repetition")).cast("bigint").alias("campaign_id"),
        (F.floor(keyed_uniform(seed, F.lit("segment"), "template_id", "repetition") * n_seg) + 1)
        .cast("int").alias("_rank"),
    ).join(seg_rank, "_rank", "inner")
    tg = targets.select(F.col("id").alias("target_id"), F.col("segment_id").alias("_tseg"),
                        F.col("recipient").alias("target_recipient"), F.col("uid").alias("target_uid"))
    rows = score_probabilities(tg.join(camp, F.col("_tseg") == F.col("segment_id"), "inner"))
    u_open = keyed_uniform(seed, "campaign_id", "target_id", F.lit("open"))
    u_click = keyed_uniform(seed, "campaign_id", "target_id", F.lit("click"))
    opened = (u_open < F.col("open_probability")).cast("int")
    clicked = F.when(opened == 1, (u_click < F.col("click_probability")).cast("int")).otherwise(F.lit(0))
    return rows.select(
        F.lit(K.SOURCE_SYNTHETIC).alias("source"), "campaign_id",
        F.lit("launched").alias("campaign_status"), F.lit("email").alias("campaign_channel"),
        F.lit(None).cast("timestamp_ntz").alias("campaign_launched_at"),
        "template_id", "template_name", "template_subject", "template_description",
        *K.SIGNAL_COLUMNS, "segment_id", "age_bracket", "gender", "education",
        "target_id", "target_recipient", "target_uid",
        F.lit(1).cast("bigint").alias("delivered"), opened.cast("bigint").alias("opened"),
        clicked.cast("bigint").alias("clicked"), F.lit(0).cast("bigint").alias("reported"),
        opened.alias("opened_flag"), clicked.cast("int").alias("clicked_flag"),
        F.lit(0).alias("reported_flag"),
    )


def _by_id():
    from pyspark.sql import Window
    # Ranking the segment dimension (bounded: one row per segment).
    return Window.orderBy("id")
