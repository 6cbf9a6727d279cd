"""As-of attribution, ranking and evaluation properties on hand-made frames."""

import contextlib
import datetime as dt

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from lureline.operators import attribution, evaluation
from lureline.operators.ranking import with_global_rank

EV = "id long, campaign_id long, target_id long, template_id long, event_type string, occurred_at timestamp_ntz, meta string"


@contextlib.contextmanager
def _many_partitions(spark, n):
    """Keep ``n`` range partitions (AQE would merge them at this size), so carries and offsets
    really cross partition boundaries."""
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    prev = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[0], str(n))
    spark.conf.set(keys[1], "false")
    try:
        yield
    finally:
        for k, v in zip(keys, prev):
            spark.conf.set(k, v)


def _t(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_asof_latest_delivery(spark):
    log = spark.createDataFrame([(1, 1, 7, 1, "delivered", _t(60), None),
                                 (2, 2, 7, 2, "delivered", _t(300), None)], EV)
    hits = spark.createDataFrame([(10, "opened", "u", 7, _t(0)), (11, "clicked", "u", 7, _t(60)),
                                  (12, "clicked", "u", 7, _t(180)), (13, "reported", "u", 7, _t(420))],
                                 "hit_id long, event_type string, uid string, target_id long, ts timestamp_ntz")
    got = {r.hit_id: r.campaign_id for r in attribution.attribute_hits(hits, log).collect()}
    # t=0 before any delivery -> dropped; t=60 ties with delivery 1 -> credited; later -> latest
    assert got == {11: 1, 12: 1, 13: 2}


def test_asof_hot_target_spans_partitions(spark):
    """One target owns most rows (all within one hour): the carry crosses range partitions and
    the result equals a brute-force as-of over the same rows."""
    dlv = [(i, 100 + i % 5, 7 if i % 4 else 8, 1, "delivered", _t((i * 7) % 50), None)
           for i in range(1, 400)]
    hit = [(10_000 + i, "clicked", "u", 7 if i % 3 else 9, _t((i * 11) % 55)) for i in range(1, 3000)]
    log = spark.createDataFrame(dlv, EV)
    hits = spark.createDataFrame(hit, "hit_id long, event_type string, uid string, target_id long, ts timestamp_ntz")
    with _many_partitions(spark, 23):
        got = {r.hit_id: r.delivery_id for r in attribution.attribute_hits(hits, log).collect()}
    want = {}
    for hid, _, _, tgt, ts in hit:
        cands = [(d[5], d[0]) for d in dlv if d[2] == tgt and d[5] <= ts]
        if cands:
            want[hid] = max(cands)[1]
    assert got == want


def test_unknown_uid_quarantine(spark):
    hits = spark.createDataFrame([(1, "http://t.example/r?uid=abc", _t(1)),
                                  (2, "http://t.example/open.gif?uid=zzz", _t(2))],
                                 "hit_id long, url string, ts timestamp_ntz")
    targets = spark.createDataFrame([(5, 1, "a", "abc", None)],
                                    "id long, segment_id long, recipient string, uid string, meta string")
    parsed = attribution.parse_hits(hits)
    assert {r.hit_id: r.event_type for r in parsed.collect()} == {1: "clicked", 2: "opened"}
    assert [r.hit_id for r in attribution.unknown_uid_hits(parsed, targets).collect()] == [2]
    assert [r.target_id for r in attribution.resolve_uids(parsed, targets).collect()] == [5]


def test_global_rank_matches_sort(spark):
    df = spark.range(0, 5000).select((F.col("id") % 7).alias("p"), F.col("id").alias("k"), F.lit(1).alias("one"))
    with _many_partitions(spark, 13):
        ranked = with_global_rank(df.repartition(13), ["p", "k"], sum_cols=["one"]).collect()
    expected = sorted((r.p, r.k) for r in ranked)
    got = sorted(ranked, key=lambda r: r._rank)
    assert [(r.p, r.k) for r in got] == expected
    assert [r._rank for r in got] == list(range(1, 5001))
    assert all(r._cum_one == r._rank for r in got)


def _ev(spark, n, positives=None):
    rows = [(i, 0, (1 if (positives and i in positives) else 0), 1.0 - i / max(n, 1)) for i in range(n)]
    return spark.createDataFrame(rows, "campaign_id long, target_id long, y int, p double")


@pytest.mark.parametrize("n,sizes", [
    (724, [73, 72, 72, 73, 72, 72, 73, 72, 72, 73]),
    (731, [74] + [73] * 9),
    (5, [1] * 5),
    (1, [1]),
])
def test_lift_bucket_sizes(spark, n, sizes):
    lift = evaluation.lift_table(_ev(spark, n, positives={0, 3}), n_bins=10).orderBy("bucket").collect()
    assert [r.rows for r in lift] == sizes
    assert lift[-1].cumulative_rows == n
    assert lift[-1].cumulative_positive_capture_rate == pytest.approx(1.0 if n > 3 else lift[-1].cumulative_positive_capture_rate)


def test_single_class(spark):
    ev = _ev(spark, 20)
    assert evaluation.roc_auc(ev).first().roc_auc is None
    lift = evaluation.lift_table(ev).collect()
    assert all(r.lift != r.lift for r in lift)  # NaN
    assert all(r.cumulative_positive_capture_rate == 0.0 for r in lift)


def test_auc_against_spark_evaluator(spark):
    rows = [(i, 0, int((i * 7919) % 13 < 5), round(((i * 104729) % 1000) / 1000.0, 2)) for i in range(3000)]
    ev = spark.createDataFrame(rows, "campaign_id long, target_id long, y int, p double")
    ours = evaluation.roc_auc(ev).first().roc_auc
    vec = ev.select(F.col("y").cast("double").alias("label"), F.col("p").alias("rawPrediction"))
    ref = BinaryClassificationEvaluator(metricName="areaUnderROC", numBins=0).evaluate(vec)
    assert ours == pytest.approx(ref, abs=1e-9)


def test_calibration_bins_cover_all_rows(spark):
    rows = [(i, 0, i % 3 == 0, (i % 50) / 50.0) for i in range(1000)]
    ev = spark.createDataFrame(rows, "campaign_id long, target_id long, y boolean, p double").withColumn("y", F.col("y").cast("int"))
    cal = evaluation.calibration_curve(ev, n_bins=10).collect()
    assert [r.bin for r in cal] == list(range(1, len(cal) + 1))
    assert all(0.0 <= r.observed_positive_rate <= 1.0 for r in cal)


def test_targets_are_not_gathered_on_the_driver(spark):
    """Every micro-batch broadcast the targets twice (stream_raw_hits, stream_quarantine)."""
    from lureline.operators import attribution
    hits = spark.createDataFrame([(1, "a", "clicked"), (2, "x", "clicked"), (3, None, "clicked")], "hit_id long, uid string, event_type string")
    targets = spark.createDataFrame([(7, "a"), (8, None)], "id long, uid string")
    for df in (attribution.resolve_uids(hits, targets), attribution.unknown_uid_hits(hits, targets)):
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert [(r.hit_id, r.target_id) for r in attribution.resolve_uids(hits, targets).collect()] == [(1, 7)]
    assert sorted(r.hit_id for r in attribution.unknown_uid_hits(hits, targets).collect()) == [2, 3]
