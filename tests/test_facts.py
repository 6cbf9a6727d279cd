"""Interaction fact and summaries on hand-made operational tables."""

import datetime as dt

from pyspark.sql import functions as F

from lureline.operators import facts, summaries
from lureline.sources.fixtures import TEMPLATE_SCHEMA

SEG = "id long, age_bracket string, gender string, education string"
TGT = "id long, segment_id long, recipient string, uid string, meta string"
CAMP = "id long, channel string, launched_at timestamp_ntz, status string, template_id long, segment_id long"
EV = "id long, campaign_id long, target_id long, template_id long, event_type string, occurred_at timestamp_ntz, meta string"


def _tables(spark):
    t0 = dt.datetime(2024, 1, 1)
    segments = spark.createDataFrame([(1, "18-24", None, "Tecnica"), (2, "25-34", None, "Posgrado"),
                                      (3, "55+", "F", "Secundaria")], SEG)
    templates = spark.createDataFrame([(1, "email", "A", "s", "d", "<p>x</p>", '{"urgencia": true}', 1)],
                                      TEMPLATE_SCHEMA)
    targets = spark.createDataFrame([(10, 1, "a@x", "u10", None), (11, 1, "b@x", None, None),
                                     (20, 2, "c@x", "u20", None)], TGT)
    campaigns = spark.createDataFrame([
        (1, "email", t0, "launched", 1, 1),     # two targets
        (2, "email", None, "draft", 1, 2),      # no events -> zero rates
        (3, "email", t0, "launched", 1, 3),     # segment without targets -> no rows
        (4, "email", t0, "launched", 99, 2),    # dangling template -> nulls, signals 0
    ], CAMP)
    events = spark.createDataFrame(
        [(i, 1, 10, 1, t, t0, None) for i, t in enumerate(
            ["delivered", "delivered", "delivered", "clicked", "clicked", "other"])]
        + [(100, 1, 11, 1, "opened", t0, None)], EV)
    return segments, templates, targets, campaigns, events


def test_fact_grain_and_counts(spark):
    segments, templates, targets, campaigns, events = _tables(spark)
    fact = facts.interaction_fact(campaigns, templates, segments, targets, events)
    rows = {(r.campaign_id, r.target_id): r for r in fact.collect()}
    assert set(rows) == {(1, 10), (1, 11), (2, 20), (4, 20)}
    r = rows[(1, 10)]
    assert (r.delivered, r.clicked, r.clicked_flag, r.opened_flag) == (3, 2, 1, 0)
    assert r.signal_urgency == 1 and r.signal_authority == 0
    dangling = rows[(4, 20)]
    assert dangling.template_id is None and dangling.template_name is None
    assert (dangling.signal_urgency, dangling.segment_id) == (0, 2)
    assert len(fact.columns) == 27


def test_summaries(spark):
    segments, templates, targets, campaigns, events = _tables(spark)
    fact = facts.interaction_fact(campaigns, templates, segments, targets, events)
    camp = {r.campaign_id: r for r in summaries.campaign_summary(fact).collect()}
    assert camp[1].observaciones == 2 and camp[1].delivered == 3 and camp[1].clicked == 1
    assert camp[1].tasa_clic_pct == 33.33  # one clicked flag over three deliveries
    assert camp[2].tasa_clic_pct == 0.0 and camp[2].delivered == 0
    log = {r.campaign_id: r for r in summaries.campaign_summary_from_log(
        campaigns, templates, segments, targets, events).collect()}
    assert {k: tuple(v) for k, v in camp.items()} == {k: tuple(v) for k, v in log.items()}
    seg = summaries.segment_summary(fact).collect()
    assert len(seg) == 2 and all(r.gender is None for r in seg)  # null key kept as a group
    ctx = summaries.campaign_context
    assert ctx(fact).first().campaign_context == "campaigns-1-4-n3"
    assert ctx(fact.where("campaign_id = 2")).first().campaign_context == "campaign-2"
    assert ctx(fact.where("campaign_id = 0")).first().campaign_context == "no-campaigns"


def test_general_table_without_reported(spark):
    segments, templates, targets, campaigns, events = _tables(spark)
    fact = facts.interaction_fact(campaigns, templates, segments, targets, events).drop("reported_flag")
    g = {r.indicador: r.valor for r in summaries.general_table(fact).collect()}
    assert g["Reportes registrados"] == 0 and g["Total de observaciones"] == 4


def test_clean_and_required_columns(spark):
    df = spark.createDataFrame([(None, None, " M "), ("18-24", 1, None)],
                               "age_bracket string, signal_urgency int, gender string")
    assert [tuple(r) for r in facts.clean_dataset(df).collect()] == [("unknown", 0, " M "), ("18-24", 1, "unknown")]
    strict = facts.clean_strict(df.withColumn("signal_urgency", F.lit("x"))).collect()
    assert strict[0].signal_urgency == 0.0 and strict[0].gender == "M"
    try:
        facts.require_columns(df, ["age_bracket", "zeta", "alpha"])
        raise AssertionError("expected ValueError")
    except ValueError as e:
        assert "['alpha', 'zeta']" in str(e)


def test_fk_violations_one_pass_per_child(spark):
    from lureline.operators import quality
    parents = spark.createDataFrame([(1,), (1,), (2,)], "id long")   # duplicate key: no duplicated rows
    others = spark.createDataFrame([(7,)], "id long")
    child = spark.createDataFrame([(100, 1, 7), (101, 3, 7), (102, None, 8), (103, 4, None),
                                   (103, 4, None)], "id long, a long, b long")
    other_child = spark.createDataFrame([(5, 9)], "id long, a long")
    got = sorted(tuple(r) for r in quality.fk_violations([
        ("child.a", child, "id", "a", parents, "id"),
        ("child.b", child, "id", "b", others, "id"),
        ("other.a", other_child, "id", "a", parents, "id"),
    ]).collect())
    assert got == [("child.a", 101, 3), ("child.a", 103, 4), ("child.a", 103, 4),
                   ("child.b", 102, 8), ("other.a", 5, 9)]


def test_totals_from_rollup_equal_fact_totals(spark):
    """A4/A5/A7/A8/A9 from the per-campaign rollup equal the fact-based forms, including a campaign
    whose segment key is missing from ``segments`` (null segment in the fact, targets still
    joined), two campaigns sharing a segment key, and a segment without targets."""
    segments, templates, targets, campaigns, events = _tables(spark)
    t0 = dt.datetime(2024, 1, 1)
    targets = targets.unionByName(spark.createDataFrame([(30, 9, "d@x", "u30", None)], TGT))
    campaigns = campaigns.unionByName(spark.createDataFrame(
        [(5, "email", t0, "launched", 1, 9), (6, "email", t0, "launched", 1, 1)], CAMP))
    events = events.unionByName(spark.createDataFrame(
        [(200, 5, 30, 1, "delivered", t0, None), (201, 5, 30, 1, "reported", t0, None),
         (202, 6, 11, 1, "delivered", t0, None), (203, 6, 20, 1, "clicked", t0, None)], EV))
    tables = (campaigns, templates, segments, targets, events)
    fact = facts.interaction_fact(*tables)
    for from_log, on_fact in ((summaries.global_summary_from_log, summaries.global_summary),
                              (summaries.general_table_from_log, summaries.general_table),
                              (summaries.segment_summary_from_log, summaries.segment_summary),
                              (summaries.template_summary_from_log, summaries.template_summary),
                              (summaries.signal_summary_from_log, summaries.signal_summary),
                              (summaries.top_findings_from_log, summaries.top_findings)):
        assert sorted(from_log(*tables).collect(), key=repr) == sorted(on_fact(fact).collect(), key=repr)


def test_first_rows_is_a_top_k(spark):
    df = spark.range(0, 1000).select((F.col("id") % 10).alias("g"), F.col("id")).repartition(7)
    head = summaries.first_rows(df, 15, F.col("g").desc(), "id")
    assert [(r.g, r.id) for r in head.collect()] == [(9, 9 + 10 * i) for i in range(15)]
    assert "TakeOrderedAndProject" in head._jdf.queryExecution().executedPlan().toString()


def test_summary_plans_carry_no_size_hint(spark):
    """Joins are left to Catalyst and AQE; the summary equals the one over the fact."""
    segments, templates, targets, campaigns, events = _tables(spark)
    tables = (campaigns, templates, segments, targets, events)
    rollup = summaries.campaign_summary_from_log(*tables)
    assert "ResolvedHint" not in rollup._jdf.queryExecution().analyzed().toString()
    assert sorted(rollup.collect()) == sorted(summaries.campaign_summary(facts.interaction_fact(*tables)).collect())


def test_events_without_campaign_do_not_stop_the_fact(spark):
    segments, templates, targets, campaigns, events = _tables(spark)
    odd = spark.createDataFrame([(None, None), (None, 1)], "campaign_id long, target_id long")
    odd = odd.selectExpr("-1L as id", "campaign_id", "target_id", "1L as template_id", "'clicked' as event_type")
    more = events.unionByName(odd, allowMissingColumns=True)
    want = sorted(facts.interaction_fact(campaigns, templates, segments, targets, events).collect(), key=str)
    got = sorted(facts.interaction_fact(campaigns, templates, segments, targets, more).collect(), key=str)
    assert got == want


def test_labels_of_every_type(spark):
    bools = spark.createDataFrame([(True,), (False,), (None,)], "clicked_flag boolean")
    assert sorted(r[0] for r in facts.normalize_labels(bools).collect()) == [0, 1]
    texts = spark.createDataFrame([("yes\t",), ("no\n",), (" True ",), ("maybe",)], "clicked_flag string")
    got = sorted(r[0] for r in facts.normalize_labels(texts).collect())
    plain = spark.createDataFrame([("yes",), ("no",), ("true",), ("maybe",)], "clicked_flag string")
    assert got == sorted(r[0] for r in facts.normalize_labels(plain).collect()) and len(got) >= 2


def test_scan_sees_files_added_later(spark, tmp_path):
    from lureline.sources.fixtures import read_table
    path = f"{tmp_path}/region.parquet"
    spark.range(10).write.parquet(path)
    assert read_table(spark, str(tmp_path), "region").count() == 10
    spark.range(10).write.mode("append").parquet(path)
    assert read_table(spark, str(tmp_path), "region").count() == 20


def test_cascade_keeps_orphans_of_nothing_erased(spark):
    from lureline.operators.quality import cascade_delete
    segments, templates, targets, campaigns, events = _tables(spark)
    orphan = spark.createDataFrame([(-5, 10**9, 10**9)], "id long, campaign_id long, target_id long")
    log = events.unionByName(orphan, allowMissingColumns=True)
    none = spark.createDataFrame([(-1,)], "id long")
    assert cascade_delete(segments, targets, campaigns, log, none)["event_log"].count() == log.count()
    first = segments.limit(1).select("id")
    left = cascade_delete(segments, targets, campaigns, log, first)["event_log"]
    assert left.filter("id = -5").count() == 1 and left.count() <= log.count()


def test_summaries_in_report_order(spark):
    segments, templates, targets, campaigns, events = _tables(spark)
    rows = summaries.in_report_order(summaries.campaign_summary_from_log(
        campaigns, templates, segments, targets, events)).collect()
    ids = [r.campaign_id for r in rows]
    assert ids == sorted(ids) and ids
