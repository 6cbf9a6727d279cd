"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the driver's tables through the fixture mapping (or data Spark derives from
them), so its work grows with the tables. Names match the keys of ``oracle_sql``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.constants import RECOMMENDED_PLACEHOLDERS, REQUIRED_PLACEHOLDERS
from lureline.functions.expressions import na_to_null, sanitize_name
from lureline.operators import (
    attribution, design, evaluation, facts, mixed, quality, summaries, synthetic, text,
)
from lureline.sources import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        _REGISTRY[name] = fn
        return fn
    return deco


def queries() -> dict[str, Query]:
    import lureline.plans.registry_models  # noqa: F401  (registers model, streaming, mixed queries)
    return dict(_REGISTRY)


def _fact(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.load(spark, sf)
    return facts.interaction_fact(t.campaigns, t.templates, t.segments, t.targets, t.event_log)


def _fact_rows(spark: SparkSession, sf: str) -> DataFrame:
    """F1's rows and dimension columns without the event counts (no shuffle)."""
    t = fx.load(spark, sf)
    return facts.fact_rows(t.campaigns, t.templates, t.segments, t.targets)


# ---- facts and summaries (A2-A17, F1) ---------------------------------------------------------

@register("event_counts")
def q_event_counts(spark, sf):
    return facts.event_counts(fx.event_log(spark, sf))


@register("interaction_fact")
def q_interaction_fact(spark, sf):
    return _fact(spark, sf)


@register("campaign_summary")
def q_campaign_summary(spark, sf):
    """Flagship: A6 straight from the event log (no fan-out fact materialised)."""
    t = fx.load(spark, sf)
    return summaries.in_report_order(summaries.campaign_summary_from_log(
        t.campaigns, t.templates, t.segments, t.targets, t.event_log))


@register("campaign_summary_fact")
def q_campaign_summary_fact(spark, sf):
    return summaries.campaign_summary(_fact(spark, sf))


@register("signal_flags")
def q_signal_flags(spark, sf):
    """The four signal flags of each campaign's template (JSON truthiness rule)."""
    t = fx.load(spark, sf)
    dim = facts.campaign_dimension(t.campaigns, t.templates, t.segments)
    return dim.select("campaign_id", "template_id", *facts.SIGNAL_COLUMNS)


@register("segment_summary")
def q_segment_summary(spark, sf):
    """From the per-campaign rollup (no fan-out rows are built)."""
    t = fx.load(spark, sf)
    return summaries.in_report_order(summaries.segment_summary_from_log(
        t.campaigns, t.templates, t.segments, t.targets, t.event_log))


@register("segment_summary_fact")
def q_segment_summary_fact(spark, sf):
    return summaries.segment_summary(_fact(spark, sf))


@register("template_summary")
def q_template_summary(spark, sf):
    """From the per-campaign rollup (no fan-out rows are built)."""
    t = fx.load(spark, sf)
    return summaries.in_report_order(summaries.template_summary_from_log(
        t.campaigns, t.templates, t.segments, t.targets, t.event_log))


@register("template_summary_fact")
def q_template_summary_fact(spark, sf):
    return summaries.template_summary(_fact(spark, sf))


@register("signal_summary")
def q_signal_summary(spark, sf):
    """From the per-campaign rollup (no fan-out rows are built)."""
    t = fx.load(spark, sf)
    return summaries.signal_summary_from_log(t.campaigns, t.templates, t.segments, t.targets, t.event_log)


@register("signal_summary_fact")
def q_signal_summary_fact(spark, sf):
    return summaries.signal_summary(_fact(spark, sf))


@register("global_summary")
def q_global_summary(spark, sf):
    """A4 of the observed fact from the per-campaign rollup (no fan-out rows are built)."""
    t = fx.load(spark, sf)
    return summaries.global_summary_from_log(t.campaigns, t.templates, t.segments, t.targets,
                                             t.event_log)


@register("general_table")
def q_general_table(spark, sf):
    """A5 of the observed fact from the per-campaign rollup (no fan-out rows are built)."""
    t = fx.load(spark, sf)
    return summaries.general_table_from_log(t.campaigns, t.templates, t.segments, t.targets,
                                            t.event_log)


@register("global_summary_fact")
def q_global_summary_fact(spark, sf):
    return summaries.global_summary(_fact(spark, sf))


@register("general_table_fact")
def q_general_table_fact(spark, sf):
    return summaries.general_table(_fact(spark, sf))


@register("global_summary_bitmap")
def q_global_summary_bitmap(spark, sf):
    """A4 over the fact, exact distinct counts from bitmaps."""
    return summaries.bitmap_global_summary(_fact(spark, sf))


@register("general_table_bitmap")
def q_general_table_bitmap(spark, sf):
    """A5 over the fact, exact distinct counts from bitmaps."""
    return summaries.bitmap_general_table(_fact(spark, sf))


@register("operational_totals")
def q_operational_totals(spark, sf):
    t = fx.load(spark, sf)
    return summaries.operational_totals(t.campaigns, t.targets, t.templates, t.segments, t.event_log)


@register("source_distribution")
def q_source_distribution(spark, sf):
    return summaries.value_distribution(q_combined_dataset(spark, sf), "source")


@register("label_distribution")
def q_label_distribution(spark, sf):
    return summaries.value_distribution(_fact(spark, sf), "clicked_flag")


@register("targets_per_segment")
def q_targets_per_segment(spark, sf):
    return summaries.targets_per_segment(fx.targets(spark, sf))


@register("campaign_context")
def q_campaign_context(spark, sf):
    """A13 over the campaigns of the fact (the per-campaign rollup holds exactly those)."""
    t = fx.load(spark, sf)
    return summaries.campaign_context(
        summaries.campaign_rollup(t.campaigns, t.templates, t.segments, t.targets, t.event_log))


@register("top_findings")
def q_top_findings(spark, sf):
    """A17 from the rollup-based summaries (no fan-out rows are built)."""
    t = fx.load(spark, sf)
    return summaries.top_findings_from_log(t.campaigns, t.templates, t.segments, t.targets,
                                           t.event_log)


@register("top_findings_fact")
def q_top_findings_fact(spark, sf):
    return summaries.top_findings(_fact(spark, sf))


# ---- attribution, quality, text (C1, C2, C10, J5-J7, N1, Q1-Q6) --------------------------------

@register("parse_hits")
def q_parse_hits(spark, sf):
    return attribution.parse_hits(fx.hits(spark, sf))


@register("unknown_uid_hits")
def q_unknown_uid_hits(spark, sf):
    return attribution.unknown_uid_hits(attribution.parse_hits(fx.hits(spark, sf)), fx.targets(spark, sf))


@register("attribute_hits")
def q_attribute_hits(spark, sf):
    resolved = attribution.resolve_uids(attribution.parse_hits(fx.hits(spark, sf)), fx.targets(spark, sf))
    return attribution.attribute_hits(resolved, fx.event_log(spark, sf))


def page_templates(spark, sf):
    """Raw pages seen as candidate message templates: body = html, subject = <title>."""
    pages = fx.read_table(spark, sf, "pages").select("page_id", "html")
    # every third page ends with all placeholders of a message, every third with the required ones
    wanted = F.when(F.col("page_id") % 3 == 0, F.lit(" ".join(REQUIRED_PLACEHOLDERS + RECOMMENDED_PLACEHOLDERS))) \
        .when(F.col("page_id") % 3 == 1, F.lit(" ".join(REQUIRED_PLACEHOLDERS))).otherwise(F.lit(""))
    return pages.select(F.col("page_id").alias("id"), F.concat("html", wanted).alias("html_body"),
                        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("subject"))


@register("template_validation")
def q_template_validation(spark, sf):
    return quality.template_validation(page_templates(spark, sf))


@register("unique_violations")
def q_unique_violations(spark, sf):
    u = fx.users(spark, sf)
    return quality.unique_violations([("users", u, "username"), ("users", u, "email"),
                                      ("targets", fx.targets(spark, sf), "uid")])


@register("null_violations")
def q_null_violations(spark, sf):
    return quality.null_violations([
        ("targets", fx.targets(spark, sf), ["segment_id", "recipient", "uid"]),
        ("campaigns", fx.campaigns(spark, sf), ["channel", "status", "template_id", "segment_id", "launched_at"]),
        ("event_log", fx.raw_event_log(spark, sf), ["campaign_id", "target_id", "template_id", "event_type", "occurred_at"]),
    ])


@register("fk_violations")
def q_fk_violations(spark, sf):
    t = replace(fx.load(spark, sf), event_log=fx.raw_event_log(spark, sf))
    return quality.fk_violations([
        ("campaigns.template_id", t.campaigns, "id", "template_id", t.templates, "id"),
        ("campaigns.segment_id", t.campaigns, "id", "segment_id", t.segments, "id"),
        ("targets.segment_id", t.targets, "id", "segment_id", t.segments, "id"),
        ("event_log.campaign_id", t.event_log, "id", "campaign_id", t.campaigns, "id"),
        ("event_log.target_id", t.event_log, "id", "target_id", t.targets, "id"),
        ("event_log.template_id", t.event_log, "id", "template_id", t.templates, "id"),
    ])


@register("cascade_delete")
def q_cascade_delete(spark, sf):
    t = replace(fx.load(spark, sf), event_log=fx.raw_event_log(spark, sf))
    erase = t.segments.where(F.col("gender") == "N/A")
    left = quality.cascade_delete(t.segments, t.targets, t.campaigns, t.event_log, erase)
    return left["event_log"].select("id", "campaign_id", "target_id", "event_type")


@register("sanitize_name")
def q_sanitize_name(spark, sf):
    part = fx.read_table(spark, sf, "part").select("p_partkey", "p_name")
    return part.select("p_partkey", sanitize_name("p_name").alias("safe_name"))


@register("html_to_text")
def q_html_to_text(spark, sf):
    return text.page_text(fx.read_table(spark, sf, "pages").select("page_id", "html"))


@register("text_fact")
def q_text_fact(spark, sf):
    t = fx.load(spark, sf)
    return text.text_fact(t.campaigns, t.templates, t.segments, t.targets, t.event_log)


# ---- synthetic cohorts, contrasts, design (X1-X8, A14-A16, U1) ---------------------------------

SCORE_COLUMNS = ("campaign_id", "target_id", "age_bracket", "gender", "education",
                 "signal_urgency", "signal_authority", "signal_reward", "signal_personalization",
                 "open_probability", "click_probability")
COHORT_COLUMNS = ("source", "scenario", "scenario_seed", "campaign_id", "target_id", "template_id",
                  "segment_id", "signal_personalization", "experimental_target_segment", "delivered",
                  "opened_flag", "clicked_flag", "reported_flag", "expected_open_probability",
                  "expected_click_given_open_probability")


@register("score_probabilities")
def q_score_probabilities(spark, sf):
    return synthetic.score_probabilities(_fact_rows(spark, sf)).select(*SCORE_COLUMNS)


@register("scenario_cohort")
def q_scenario_cohort(spark, sf):
    return synthetic.scenario_cohort(_fact_rows(spark, sf)).select(*COHORT_COLUMNS)


@register("scenario_validation")
def q_scenario_validation(spark, sf):
    return synthetic.scenario_validation(synthetic.scenario_cohort(_fact_rows(spark, sf)))


def _contrasts(spark, sf, name):
    return summaries.observed_contrasts(_fact(spark, sf)).where(F.col("contrast") == name)


@register("contrast_signal")
def q_contrast_signal(spark, sf):
    """A14 on the observed fact: open rate with and without each signal."""
    return _contrasts(spark, sf, "signal")


@register("contrast_segment")
def q_contrast_segment(spark, sf):
    """A14 on the observed fact: click rate in and outside the experimental segment."""
    return _contrasts(spark, sf, "segment")


@register("did_interaction")
def q_did_interaction(spark, sf):
    """A15 on the observed fact: effect of each signal on opens, inside minus outside the segment."""
    return _contrasts(spark, sf, "interaction")


@register("synthetic_population")
def q_synthetic_population(spark, sf):
    return synthetic.synthetic_population(fx.segments(spark, sf), fx.templates(spark),
                                          fx.targets(spark, sf))


@register("combined_dataset")
def q_combined_dataset(spark, sf):
    return facts.combine_sources(_fact(spark, sf), q_synthetic_population(spark, sf))


def _plan(spark, sf):
    return design.sampling_plan(fx.segments(spark, sf), fx.templates(spark), fx.targets(spark, sf))


@register("sampling_plan")
def q_sampling_plan(spark, sf):
    return _plan(spark, sf)


@register("plan_balance")
def q_plan_balance(spark, sf):
    return design.plan_balance(_plan(spark, sf))


@register("materialize_plan")
def q_materialize_plan(spark, sf):
    return design.materialize_plan(_plan(spark, sf), fx.templates(spark), fx.segments(spark, sf),
                                   fx.campaigns(spark, sf), limit=12)


@register("expand_deliveries")
def q_expand_deliveries(spark, sf):
    return design.expand_deliveries(fx.campaigns(spark, sf), fx.templates(spark), fx.targets(spark, sf))


# ---- evaluation (E1-E10, W1, W2) ------------------------------------------------------------------

#: The closed-form click scores lie between 0.09 and 0.36; this threshold has hits on both sides.
THRESHOLD = 0.2


def _ev(spark, sf, score="click_probability"):
    scored = synthetic.score_probabilities(_fact(spark, sf))
    return evaluation.evaluation_frame(scored, score_col=score)


@register("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(_ev(spark, sf), THRESHOLD)


@register("classification_metrics")
def q_classification_metrics(spark, sf):
    return evaluation.classification_metrics(_ev(spark, sf), THRESHOLD)


@register("roc_auc")
def q_roc_auc(spark, sf):
    return evaluation.roc_auc(_ev(spark, sf))


@register("brier_score")
def q_brier_score(spark, sf):
    return evaluation.brier_score(_ev(spark, sf))


def _predictions(spark, sf):
    """The scored rows as a stored table of predictions (narrow), which these reports read."""
    from lureline.streaming.attribution import run_folder
    path = f"{run_folder(spark, 'predictions')}/scores"
    _ev(spark, sf).write.parquet(path)
    return spark.read.parquet(path)


@register("calibration_curve")
def q_calibration_curve(spark, sf):
    return evaluation.calibration_curve(_predictions(spark, sf))


@register("lift_table")
def q_lift_table(spark, sf):
    return evaluation.lift_table(_predictions(spark, sf))


def _comparison(spark, sf):
    return evaluation.compare_scores(
        synthetic.score_probabilities(_fact(spark, sf)),
        {"x8_click": "click_probability", "x8_open": "open_probability"}, THRESHOLD)


@register("model_comparison")
def q_model_comparison(spark, sf):
    return _comparison(spark, sf)


@register("metric_winners")
def q_metric_winners(spark, sf):
    return evaluation.metric_winners(_comparison(spark, sf), "x8_click", "x8_open")


# ---- dataset preparation (P1, P2, P5, P7, P8, S3) ------------------------------------------------

@register("list_newest")
def q_list_newest(spark, sf):
    """Targets newest first (whole listing; the order is the feature)."""
    return fx.targets(spark, sf).orderBy(F.col("id").desc()).select("id", "segment_id", "recipient", "uid")


@register("lookup_uid")
def q_lookup_uid(spark, sf):
    """Point lookup of targets by the uids seen in hits (an equi-join, not a loop)."""
    seen = attribution.parse_hits(fx.hits(spark, sf)).select("uid").distinct()
    return fx.targets(spark, sf).join(seen, "uid", "left_semi").select("id", "uid", "segment_id")


@register("label_normalize")
def q_label_normalize(spark, sf):
    """P5 + P10 on ``labels``: text branch for quality (as read from CSV), numeric for toxic."""
    lab = fx.read_table(spark, sf, "labels").select(
        "doc_id", F.col("quality").cast("string").alias("quality"), "toxic")
    out = facts.normalize_labels(lab, "quality")
    return facts.normalize_labels(out, "toxic")


@register("na_tokens")
def q_na_tokens(spark, sf):
    """S3: the fact's text columns as ``read_csv`` would see them (NA tokens -> null)."""
    cols = ("age_bracket", "gender", "education", "template_subject", "template_description", "target_uid")
    f = _fact(spark, sf)
    return f.select("campaign_id", "target_id", *[na_to_null(c).alias(c) for c in cols])


@register("clean_dataset")
def q_clean_dataset(spark, sf):
    """P7 after S3 (the N/A gender becomes 'unknown')."""
    return facts.clean_dataset(q_na_tokens(spark, sf))


@register("clean_strict")
def q_clean_strict(spark, sf):
    """P8 over the fact's features after S3."""
    f = _fact(spark, sf)
    cols = ("signal_urgency", "signal_authority", "signal_reward", "signal_personalization",
            "age_bracket", "gender", "education")
    return facts.clean_strict(f.select("campaign_id", "target_id", *[
        na_to_null(c).alias(c) if c in ("age_bracket", "gender", "education") else F.col(c)
        for c in cols]))


# ---- further operators (P9, K2, K3, C7, U2, X3, X4) ---------------------------------------------

@register("feature_matrix")
def q_feature_matrix(spark, sf):
    return facts.feature_matrix(_fact(spark, sf))


@register("stacked_predictions")
def q_stacked_predictions(spark, sf):
    return evaluation.stack_scores(synthetic.score_probabilities(_fact(spark, sf)),
                                   {"x8_click": "click_probability", "x8_open": "open_probability"})


def _signal_odds(spark, sf):
    return summaries.signal_odds(_fact(spark, sf))


@register("signal_odds")
def q_signal_odds(spark, sf):
    return _signal_odds(spark, sf)


@register("top_terms")
def q_top_terms(spark, sf):
    """K2 on the observed log odds: the two largest by absolute value."""
    return summaries.first_rows(_signal_odds(spark, sf), 2, F.col("abs_log_odds").desc(), "term")


@register("extreme_terms")
def q_extreme_terms(spark, sf):
    """K3 on the observed log odds: the most positive and the most negative term."""
    return mixed.extreme_terms(_signal_odds(spark, sf).withColumnRenamed("log_odds", "posterior_mean"), 1)


@register("draft_campaigns")
def q_draft_campaigns(spark, sf):
    return design.draft_campaigns(q_materialize_plan(spark, sf))


@register("assigned_uids")
def q_assigned_uids(spark, sf):
    tg = fx.targets(spark, sf)
    return design.assigned_uids(tg.withColumn("uid", F.when(F.col("id") % 7 == 0, "").otherwise(F.col("uid")))) \
        .select("id", "segment_id", "uid")
