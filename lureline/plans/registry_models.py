"""Registered queries for model training, the mixed model, text classification and streaming.

Model fits have no exact SQL oracle (iterative optimisers); the split, class weights and
imputation do. The tests assert the properties of the rest.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import functions as F

from lureline.operators import attribution
from lureline.operators import boosting
from lureline.operators import facts as facts_ops
from lureline.operators import mixed
from lureline.operators import quality
from lureline.operators import runs
from lureline.operators import summaries
from lureline.operators import text as text_ops
from lureline.sources import files
from lureline.sources.commits import CommitLog
from lureline.sources import fixtures as fx
from lureline.streaming import attribution as stream_attr
from lureline.streaming import tracker
from lureline.streaming.attribution import OUTPUT_SCHEMA, run_folder
from lureline.constants import DEMOGRAPHIC_COLUMNS, SIGNAL_COLUMNS, TARGET_COLUMN
from lureline.functions.expressions import na_to_null
from lureline.operators import evaluation, models
from lureline.plans.registry import _fact, q_combined_dataset, register
from lureline.session import ensure_checkpoint_dir

SPLIT_KEYS = ("source", "campaign_id", "target_id")


def observed_sources(fact):
    """Two given subsets of the observed fact as the two sources of a training table (U1): campaigns
    with an even and with an odd id."""
    part = lambda rest, name: fact.where(F.col("campaign_id") % 2 == rest).withColumn("source", F.lit(name))
    return facts_ops.combine_sources(part(0, "observed_a"), part(1, "observed_b"))


def _combined(spark, sf):
    """The training table: observed fact + synthetic population, NA tokens as the CSV reader sees them."""
    return q_combined_dataset(spark, sf).withColumn("gender", na_to_null("gender"))


def _observed(spark, sf):
    """The training table of M9 and G2 (map): two sources of observed rows, NA tokens as the CSV reader
    sees them."""
    return observed_sources(_fact(spark, sf)).withColumn("gender", na_to_null("gender"))


@register("combined_observed")
def q_combined_observed(spark, sf):
    """U1 on given rows."""
    return observed_sources(_fact(spark, sf))


@register("observed_source_distribution")
def q_observed_source_distribution(spark, sf):
    """A10 on given rows."""
    return summaries.value_distribution(q_combined_observed(spark, sf), "source")


def _split(spark, sf):
    return models.stratified_split(_combined(spark, sf), keys=SPLIT_KEYS)


@register("stratified_split")
def q_stratified_split(spark, sf):
    return _split(spark, sf).select(*SPLIT_KEYS, TARGET_COLUMN, "split")


@register("class_weights")
def q_class_weights(spark, sf):
    return models.class_weights(_split(spark, sf).where("split = 'train'"))


@register("impute_mode")
def q_impute_mode(spark, sf):
    split = _split(spark, sf)
    cols = ("age_bracket", "gender", "education")
    filled = models.impute_mode(split.where("split = 'train'"), split, cols)
    return filled.select(*SPLIT_KEYS, *cols)


#: What a fit and the scored rows take from the training table.
MODEL_COLUMNS = (*SPLIT_KEYS, "template_id", "segment_id", *SIGNAL_COLUMNS, *DEMOGRAPHIC_COLUMNS, TARGET_COLUMN)


def _frozen_split(rows):
    """The split of the training table's narrow rows, which are built once (reliable checkpoint): the
    split takes several passes, and none of them joins and counts the events again."""
    ensure_checkpoint_dir(rows.sparkSession)
    return models.stratified_split(rows.select(*MODEL_COLUMNS).checkpoint(eager=True), keys=SPLIT_KEYS)


def _train_test(spark, sf):
    # freeze the prepared table once (reliable checkpoint): every fit pass reads it, not the lineage
    df = models._prepare(_frozen_split(_combined(spark, sf))).checkpoint(eager=True)
    train, test = df.where("split = 'train'"), df.where("split = 'test'")
    n_train, _ = models.check_trainable(train, min_rows=10)
    w = models.class_weights(train)
    return models.with_weights(train, w), models.with_weights(test, w), n_train


def _metrics(scored, name):
    return evaluation.model_metrics(scored.select("y", "p"), name, materialize=True)


@register("logreg_metrics")
def q_logreg_metrics(spark, sf):
    train, test, n = _train_test(spark, sf)
    m = models.fit(models.logistic_pipeline(n), train)
    return _metrics(models.score(m, test), "logistic_regression")


@register("ml_comparison")
def q_ml_comparison(spark, sf):
    train, test, n = _train_test(spark, sf)
    lr = models.fit(models.logistic_pipeline(n, scale=True), train)
    dt = models.fit(models.tree_pipeline(), train)
    return _metrics(models.score(lr, test), "logistic_regression_scaled").unionByName(
        _metrics(models.score(dt, test), "decision_tree"))


@register("gbt_metrics")
def q_gbt_metrics(spark, sf):
    train, test, _ = _train_test(spark, sf)
    m = models.fit(models.gbt_pipeline(), train)
    return _metrics(models.score(m, test), "gradient_boosted_trees")


#: The registered boosted fit: all 500 rounds.
BOOST = boosting.BoostParams()


def _boost_split(spark, sf):
    return models.stratified_split(_observed(spark, sf), keys=SPLIT_KEYS)


def _boost_train(spark, sf):
    return facts_ops.clean_dataset(_boost_split(spark, sf)).where("split = 'train'")


def _boost(spark, sf):
    """M9 on the observed rows: ``(model, test rows)``."""
    data = facts_ops.clean_dataset(_frozen_split(_observed(spark, sf))).checkpoint(eager=True)
    train, test = data.where("split = 'train'"), data.where("split = 'test'")
    models.check_trainable(train, min_rows=10)
    return boosting.fit(train, SIGNAL_COLUMNS, DEMOGRAPHIC_COLUMNS, params=BOOST), test


@register("boosted_metrics")
def q_boosted_metrics(spark, sf):
    """M9: held-out metrics of the regularised boosted trees."""
    model, test = _boost(spark, sf)
    return _metrics(model.score(test), "regularised_boosted_trees")


@register("boosted_terms")
def q_boosted_terms(spark, sf):
    """Gain per feature, greatest first."""
    return _boost(spark, sf)[0].importances(spark)


@register("boost_histogram")
def q_boost_histogram(spark, sf):
    """M9: gradient and hessian histogram of the first tree's root."""
    return boosting.root_histogram(_boost_train(spark, sf), SIGNAL_COLUMNS, DEMOGRAPHIC_COLUMNS, params=BOOST)


@register("boost_root_splits")
def q_boost_root_splits(spark, sf):
    """M9: gain of every admissible split of that root."""
    return boosting.root_splits(q_boost_histogram(spark, sf), BOOST)


@register("model_terms")
def q_model_terms(spark, sf):
    train, _, n = _train_test(spark, sf)
    m = models.fit(models.logistic_pipeline(n), train)
    return models.model_terms(m, train, top_k=10)


@register("scored_rows")
def q_scored_rows(spark, sf):
    train, test, n = _train_test(spark, sf)
    m = models.fit(models.logistic_pipeline(n), train)
    return models.score(m, test)


# ---- streaming (T1, T2) --------------------------------------------------------------------------


@register("stream_attribution")
def q_stream_attribution(spark, sf):
    resolved = attribution.resolve_uids(attribution.parse_hits(fx.hits(spark, sf)), fx.targets(spark, sf))
    return stream_attr.attribution_via_stream(spark, fx.event_log(spark, sf), resolved)


@register("stream_totals")
def q_stream_totals(spark, sf):
    return tracker.totals(spark, fx.event_log(spark, sf), run_folder(spark, "stream-totals"))


def _tracked(spark, sf):
    return tracker.track(spark, fx.event_log(spark, sf), fx.hits(spark, sf), fx.targets(spark, sf),
                         run_folder(spark, "tracker"))


@register("stream_raw_hits")
def q_stream_raw_hits(spark, sf):
    """T1 from raw URLs: the attributed hits."""
    return tracker.local_time(_tracked(spark, sf).read("attributed", OUTPUT_SCHEMA), "occurred_at")


@register("stream_quarantine")
def q_stream_quarantine(spark, sf):
    """T1 from raw URLs: the hits whose uid names no target."""
    return tracker.local_time(_tracked(spark, sf).read("quarantine", tracker.QUARANTINE), "ts")


# ---- mixed model (G1-G5, K3) -----------------------------------------------------------------------


def _cells(spark, sf):
    return mixed.mixed_cells(_combined(spark, sf), group="segment_id")


def _mixed_fit(spark, sf):
    return mixed.fit_mixed(_cells(spark, sf), component="re_segment_id")


@register("mixed_cells")
def q_mixed_cells(spark, sf):
    return _cells(spark, sf)


@register("mixed_fit")
def q_mixed_fit(spark, sf):
    return mixed.variance_components(_mixed_fit(spark, sf), spark)


@register("mixed_terms")
def q_mixed_terms(spark, sf):
    return mixed.fixed_effects(_mixed_fit(spark, sf), spark)


@register("mixed_extremes")
def q_mixed_extremes(spark, sf):
    return mixed.extreme_terms(mixed.fixed_effects(_mixed_fit(spark, sf), spark))


def _mixed_map(spark, sf):
    cells = mixed.mixed_cells(_observed(spark, sf), group="segment_id")
    return mixed.fit_mixed_map(cells, component="re_segment_id")


@register("mixed_map_terms")
def q_mixed_map_terms(spark, sf):
    """G2 (map), G3."""
    return mixed.fixed_effects(_mixed_map(spark, sf), spark)


@register("mixed_map_gradient")
def q_mixed_map_gradient(spark, sf):
    """G2 (map): the gradient at the optimum, which is zero."""
    return mixed.map_gradient(_mixed_map(spark, sf), spark)


@register("mixed_scores")
def q_mixed_scores(spark, sf):
    return mixed.predict_cells(_mixed_fit(spark, sf), _cells(spark, sf))


# ---- text classifier (N2) ------------------------------------------------------------------------


@register("text_classifier")
def q_text_classifier(spark, sf):
    docs = fx.read_table(spark, sf, "documents").select("doc_id", "text")
    labels = fx.read_table(spark, sf, "labels").select("doc_id", "toxic", "quality")
    joined = docs.join(labels, "doc_id", "inner")
    toxic = text_ops.train_text_classifier(joined, "text", "toxic", "tfidf_logreg_toxic")
    quality = text_ops.train_text_classifier(joined, "text", "quality", "tfidf_logreg_quality")
    return toxic.unionByName(quality)


@register("text_fact_classifier")
def q_text_fact_classifier(spark, sf):
    t = fx.load(spark, sf)
    tf = text_ops.text_fact(t.campaigns, t.templates, t.segments, t.targets, t.event_log)
    return text_ops.train_text_classifier(tf, "text_input", "clicked_flag", "tfidf_logreg_clicked",
                                          keys=("campaign_id", "target_id"))


# ---- file sources (S2, S3, S4) -------------------------------------------------------------------


@register("source_default")
def q_source_default(spark, sf):
    """The fact exported as CSV without a ``source`` column, read back: NA tokens -> null and
    source taken from the file name (an observed export)."""
    t = fx.load(spark, sf)
    fact = facts_ops.interaction_fact(t.campaigns, t.templates, t.segments, t.targets, t.event_log)
    run = run_folder(spark, "csv-export")
    path = f"{run}/analytic_dataset_observed.csv"
    files.write_csv(fact.drop("source"), path)
    return files.read_dataset_csv(spark, path)


@register("dataset_choice")
def q_dataset_choice(spark, sf):
    """Of two observed exports and a legacy file the newest one is found and read."""
    fact = _fact(spark, sf).drop("source")
    base = run_folder(spark, "exports")
    files.write_csv(fact.where("campaign_id % 2 = 0"), f"{base}/analytic_dataset_observed_20240101_000000.csv")
    files.write_csv(fact, f"{base}/analytic_dataset_observed_20240102_000000.csv")
    files.write_csv(fact.limit(1), f"{base}/analytic_dataset.csv")
    return files.load_dataset(spark, "observed-export", base)


@register("observed_validation")
def q_observed_validation(spark, sf):
    """A16 on the observed fact."""
    return summaries.observed_validation(_fact(spark, sf))


# ---- sinks and versioned runs, read back (S5-S8, S10), test rows by source (E7) ------------------

@register("parquet_round_trip")
def q_parquet_round_trip(spark, sf):
    """The pair counts written partitioned by campaign and read again."""
    path = f"{run_folder(spark, 'parquet')}/pairs"
    files.write_parquet(facts_ops.event_counts(fx.event_log(spark, sf)), path, partition_by=["campaign_id"])
    return spark.read.parquet(path).withColumn("campaign_id", F.col("campaign_id").cast("bigint"))


@register("latest_run")
def q_latest_run(spark, sf):
    """S7 + S8: two runs of one table; the newer one is read."""
    base, per = run_folder(spark, "runs"), fx.targets(spark, sf).groupBy("segment_id").agg(
        F.count(F.lit(1)).alias("targets"))
    files.write_versioned(per.where("targets < 0"), base, "Targets per segment", "20240101_000000")
    files.write_versioned(per, base, "Targets per segment", "20240102_000000")
    return files.read_latest(spark, base, "targets per segment")


@register("metrics_json")
def q_metrics_json(spark, sf):
    """A metrics row written as JSON and read with its schema."""
    from lureline.plans.registry import q_classification_metrics
    base, metrics = run_folder(spark, "metrics"), q_classification_metrics(spark, sf)
    files.write_metrics(metrics, base, "metrics", "20240101_000000")
    return files.read_metrics(spark, base, "metrics", metrics.schema)


@register("append_deliveries")
def q_append_deliveries(spark, sf):
    """New deliveries (X4) appended to the log; events per type afterwards."""
    from lureline.plans.registry import q_expand_deliveries
    path = f"{run_folder(spark, 'log')}/events"
    cols = ["campaign_id", "target_id", "template_id", "event_type"]
    files.write_parquet(fx.event_log(spark, sf).select(*cols), path)
    files.write_parquet(q_expand_deliveries(spark, sf).select(*cols), path, mode="append")
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def _stored_runs(spark, sf):
    """E8's given runs: the metrics of both closed-form scores as stored documents. An older run of
    the first model is superseded; the second one has its metrics nested, no Brier score, a test
    size of its own and a field that the first one lacks."""
    from lureline.plans.registry import q_model_comparison
    base = run_folder(spark, "model-runs")
    comparison = q_model_comparison(spark, sf).checkpoint(eager=True)
    first, second = comparison.where("model = 'x8_click'"), comparison.where("model = 'x8_open'")
    metrics = ["accuracy", "precision", "recall", "f1", "roc_auc", "brier_score"]
    sizes = lambda share: [F.col("n_rows"), (F.col("n_rows") - F.col("n_rows") % share).alias("train_rows"),
                           (F.col("n_rows") % share).alias("test_rows")]
    runs.store_run(first.select(F.lit(0.25).alias("accuracy")), base, "x8_click", "20240101_000000")
    runs.store_run(first.select(*metrics, *sizes(7), F.col("positives").alias("positive_cases_total"),
                                F.array(F.lit("a"), F.lit("b")).alias("features")), base, "x8_click", "20240103_000000")
    runs.store_run(second.select(F.struct(*metrics[:-1], F.lit("none").alias("brier_score")).alias("metrics"), *sizes(11),
                                 F.lit("held-out").alias("mode")), base, "x8_open", "20240102_000000")
    return runs.newest_runs(runs.scan_runs(spark, base))


@register("stored_run_table")
def q_stored_run_table(spark, sf):
    """E8 from stored runs: the newest run per model, absent metrics null."""
    return runs.run_table(_stored_runs(spark, sf))


@register("stored_run_winners")
def q_stored_run_winners(spark, sf):
    """E9, E10 from stored runs."""
    return runs.run_winners(runs.run_table(_stored_runs(spark, sf)), "x8_click", "x8_open")


def _erased(spark, sf, table, keep):
    """Q6: keys of the surviving rows of all tables after some rows of ``table`` are erased."""
    t = replace(fx.load(spark, sf), event_log=fx.raw_event_log(spark, sf))
    tables = {n: getattr(t, n) for n in ("segments", "templates", "targets", "campaigns", "event_log")}
    log = CommitLog(spark, run_folder(spark, "erase"))
    quality.erase_and_publish(log, 0, tables, {table: tables[table].where(keep).select("id")})
    left = [log.latest(n, df.schema).select(F.lit(n).alias("table_name"), F.col("id").cast("bigint").alias("id"))
            for n, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), left)


@register("erase_segment")
def q_erase_segment(spark, sf):
    return _erased(spark, sf, "segments", "gender = 'N/A'")


@register("erase_template")
def q_erase_template(spark, sf):
    return _erased(spark, sf, "templates", "id = 3")


@register("erase_campaign")
def q_erase_campaign(spark, sf):
    return _erased(spark, sf, "campaigns", "id % 5 = 0")


@register("erase_target")
def q_erase_target(spark, sf):
    return _erased(spark, sf, "targets", "id % 4 = 1")


@register("append_once")
def q_append_once(spark, sf):
    """S10, exactly once: the log and the new deliveries as two batches, the second one written
    again, and a third one killed before it was published."""
    from lureline.plans.registry import q_expand_deliveries
    log, cols = CommitLog(spark, run_folder(spark, "log")), ["campaign_id", "target_id", "template_id", "event_type"]
    new = q_expand_deliveries(spark, sf).select(*cols)
    log.append(0, fx.event_log(spark, sf).select(*cols), "events")
    log.append(1, new, "events")
    log.append(1, new, "events")
    log.stage(new, "events")
    events = log.read("events", "campaign_id long, target_id long, template_id long, event_type string")
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


@register("test_rows_by_source")
def q_test_rows_by_source(spark, sf):
    """Rows of the test split per source."""
    return summaries.value_distribution(_split(spark, sf).where("split = 'test'"), "source")


@register("scored_keys")
def q_scored_keys(spark, sf):
    """P11 + M11: the keys and labels that a scored test split carries (the scores are not exact)."""
    train, test, n = _train_test(spark, sf)
    m = models.fit(models.logistic_pipeline(n), train)
    return models.score(m, test).select(*SPLIT_KEYS, F.col("y").cast("int").alias("y"))
