"""Known-effect recovery, partition invariance and plan balance."""

from pyspark.sql import functions as F

from lureline.operators import design, synthetic
from lureline.sources import fixtures as fx
from lureline.sources.fixtures import TEMPLATE_SCHEMA, TEMPLATE_ROWS
from tests.conftest import SF_SMALL


def _fact_like(spark, n_per_cell):
    """8 template patterns x 5 segments x n rows, as the scenario design of the original."""
    tpl = [(t, int(t in (4, 6, 7))) for t in range(1, 9)]
    rows = [(c, s, t, p, i) for c, (t, p) in enumerate(tpl) for s in range(1, 6) for i in range(n_per_cell)]
    return spark.createDataFrame(rows, "campaign_id long, segment_id long, template_id long, signal_personalization int, k long") \
        .withColumn("target_id", F.col("k") + F.col("segment_id") * 1000000)


def test_known_effects_recovered(spark):
    cohort = synthetic.scenario_cohort(_fact_like(spark, 500))
    v = {r.scenario: r for r in synthetic.scenario_validation(cohort).collect()}
    # planted: control 0, personalization +22 pp, segment click +7.36 pp, interaction +15 pp
    assert abs(v["Control"].difference_pp - 0.0) < 3.0
    assert abs(v["Personalización"].difference_pp - 22.0) < 3.0
    assert abs(v["Segmento"].difference_pp - 7.36) < 2.5
    assert abs(v["Interacción"].difference_pp - 15.0) < 6.0


def test_cohort_partition_invariance(spark):
    base = _fact_like(spark, 50)
    outs = []
    for parts in (1, 4, 13):
        c = synthetic.scenario_cohort(base.repartition(parts))
        outs.append(sorted(tuple(r) for r in c.select("scenario", "campaign_id", "target_id",
                                                      "opened_flag", "clicked_flag").collect()))
    assert outs[0] == outs[1] == outs[2]


def test_click_only_after_open(spark):
    c = synthetic.scenario_cohort(_fact_like(spark, 50))
    assert c.where("clicked_flag = 1 AND opened_flag = 0").count() == 0


def test_plan_balance_three_segments(spark):
    segments = spark.createDataFrame([(i, "18-24", "F", "Tecnica") for i in (1, 2, 3)],
                                     "id long, age_bracket string, gender string, education string")
    templates = spark.createDataFrame([r for r in TEMPLATE_ROWS if r[0] <= 4], TEMPLATE_SCHEMA)
    targets = spark.createDataFrame([(i, 1 + i % 3, "r", None, None) for i in range(9)],
                                    "id long, segment_id long, recipient string, uid string, meta string")
    plan = design.sampling_plan(segments, templates, targets, campaigns_per_template=2)
    counts = sorted((r.assignments for r in design.plan_balance(plan).collect()), reverse=True)
    assert counts == [3, 3, 2]
    assert sorted(r.execution_order for r in plan.collect()) == list(range(1, 9))


def test_expand_deliveries_only_drafts_with_valid_templates(spark):
    camp = fx.campaigns(spark, SF_SMALL)
    out = design.expand_deliveries(camp, fx.templates(spark), fx.targets(spark, SF_SMALL))
    ids = {r.campaign_id for r in out.select("campaign_id").distinct().collect()}
    drafts = {r.id for r in camp.where("status = 'draft'").collect()}
    assert ids and ids <= drafts
    assert out.where(F.col("uid").isNull()).count() == 0
