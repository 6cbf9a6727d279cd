"""File sinks/sources, model guards and persistence, mixed model, streaming = batch."""

import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from lureline.operators import attribution, mixed, models
from lureline.sources import files
from lureline.sources import fixtures as fx
from lureline.streaming import attribution as stream_attr
from tests.conftest import SF_SMALL


def test_whole_numbers_written_as_decimals(spark):
    base = tempfile.mkdtemp(prefix="lureline-csv-")
    rows = [("1.0", "2", "x"), ("0.0", "3.5", "N/A"), ("", "4", None)]
    files.write_csv(spark.createDataFrame(rows, "clicked_flag string, campaign_id string, gender string"), f"{base}/a")
    back = files.read_dataset_csv(spark, f"{base}/a").select("clicked_flag", "campaign_id").collect()
    assert sorted((r.clicked_flag is None, r.clicked_flag or 0, r.campaign_id or 0) for r in back) == \
        [(False, 0, 0), (False, 1, 2), (True, 0, 4)]


def test_parquet_sink_and_append(spark):
    base = tempfile.mkdtemp(prefix="lureline-pq-")
    files.write_parquet(spark.range(5).selectExpr("id", "id % 2 as campaign_id"), f"{base}/d", partition_by=["campaign_id"])
    assert spark.read.parquet(f"{base}/d").filter("campaign_id = 1").count() == 2
    files.write_parquet(spark.range(3).selectExpr("id", "0L as campaign_id"), f"{base}/d", mode="append",
                        partition_by=["campaign_id"])
    assert spark.read.parquet(f"{base}/d").count() == 8


def _stream(spark, rows, lateness, ttl_days=None):
    """Each row list is one file, read as one micro-batch."""
    base = tempfile.mkdtemp(prefix="lureline-st-")
    for i, part in enumerate(rows):
        spark.createDataFrame(part, stream_attr.STREAM_SCHEMA).coalesce(1).write.parquet(f"{base}/in{i}")
        src = [f for f in os.listdir(f"{base}/in{i}") if f.startswith("part-")][0]
        os.makedirs(f"{base}/in", exist_ok=True)
        os.link(f"{base}/in{i}/{src}", f"{base}/in/part-{i:05d}.parquet")
        os.utime(f"{base}/in/part-{i:05d}.parquet", (1e9 + i, 1e9 + i))
    q = stream_attr.start_attribution(spark, f"{base}/in", f"{base}/out", f"{base}/chk", lateness=lateness,
                                      ttl_days=ttl_days, max_files_per_trigger=1)
    q.awaitTermination()
    return sorted((r.hit_id, r.delivery_id) for r in
                  spark.read.schema(stream_attr.OUTPUT_SCHEMA).parquet(f"{base}/out").collect())


def _at(minutes):
    from datetime import datetime, timedelta
    return datetime(2024, 1, 1) + timedelta(minutes=minutes)


def _dlv(target, minute, i):
    return (target, 0, _at(minute), i, 1, 1, None, None)


def _hit(target, minute, i):
    return (target, 1, _at(minute), i, None, None, "clicked", "u")


def test_stream_keeps_late_hits_inside_the_lateness(spark):
    rows = [[_dlv(1, 0, 10)], [_dlv(1, 100, 11)], [_hit(1, 12, 20)], [_hit(1, 101, 21)]]
    assert _stream(spark, rows, "2 hours") == [(20, 10), (21, 11)]


def test_stream_credits_a_hit_long_after_its_delivery(spark):
    day = 24 * 60
    rows = [[_dlv(1, 0, 10)], [_dlv(2, 40 * day, 11)], [_dlv(2, 40 * day + 60, 12)], [_hit(1, 41 * day, 20)]]
    assert _stream(spark, rows, "10 minutes") == [(20, 10)]
    assert _stream(spark, rows, "10 minutes", ttl_days=30) == []


def test_versioned_write_and_latest(spark):
    base = tempfile.mkdtemp(prefix="lureline-art-")
    a = spark.createDataFrame([(1, 0.5)], "run long, auc double")
    b = spark.createDataFrame([(2, 0.7)], "run long, auc double")
    files.write_versioned(a, base, "Metrics", "20240101_000000")
    files.write_versioned(b, base, "Metrics", "20240102_000000")
    with pytest.raises(Exception):
        files.write_versioned(b, base, "Metrics", "20240102_000000")  # a run never overwrites
    latest = files.read_latest(spark, base, "metrics")
    assert [r.run for r in latest.collect()] == [2]
    assert files.read_latest(spark, base, "absent") is None
    legacy = os.path.join(base, "legacy")
    a.write.parquet(legacy)
    assert files.read_latest(spark, base, "absent", legacy=legacy).count() == 1


def test_metrics_json_missing_is_empty(spark):
    base = tempfile.mkdtemp(prefix="lureline-met-")
    schema = "model string, roc_auc double"
    from pyspark.sql.types import _parse_datatype_string
    st = _parse_datatype_string(schema)
    assert files.read_metrics(spark, base, "nothing", st).count() == 0
    files.write_metrics(spark.createDataFrame([("lr", 0.6)], schema), base, "m", "20240101_000000")
    assert files.read_metrics(spark, base, "m", st).first().roc_auc == 0.6


def test_csv_source_from_file_name(spark):
    base = tempfile.mkdtemp(prefix="lureline-csv-")
    df = spark.createDataFrame([(1, "N/A", "x")], "campaign_id long, gender string, template_name string")
    files.write_csv(df, f"{base}/analytic_dataset_synthetic_20240101_000000.csv")
    back = files.read_dataset_csv(spark, f"{base}/analytic_dataset_synthetic_20240101_000000.csv").first()
    assert back.source == "synthetic" and back.gender is None and back.campaign_id == 1
    assert files.choose_dataset(spark, "nope", {}).count() == 0


def test_guards(spark):
    one_class = spark.createDataFrame([(0,)] * 30, "clicked_flag int")
    with pytest.raises(ValueError):
        models.check_trainable(one_class)
    with pytest.raises(ValueError):
        models.check_trainable(spark.createDataFrame([(0,), (1,)], "clicked_flag int"))


def _train_frame(spark, n=200):
    rows = []
    for i in range(n):
        age = ["18-24", "25-34", "35-44"][i % 3]
        rows.append((i, float(i % 2), float((i // 2) % 2), 0.0, 1.0, age, ["F", "M"][i % 2], "Tecnica", int(i % 7 == 0), 1.0))
    return spark.createDataFrame(rows, "target_id long, signal_urgency double, signal_authority double, "
                                       "signal_reward double, signal_personalization double, age_bracket string, "
                                       "gender string, education string, clicked_flag int, weight double")


def test_unseen_level_and_persist(spark):
    train = _train_frame(spark)
    model = models.fit(models.logistic_pipeline(200), train)
    unseen = train.limit(1).withColumn("age_bracket", F.lit("99+"))
    out = model.transform(unseen).first()
    assert out.prediction in (0.0, 1.0)
    encoded = [n for n in out.asDict() if n.endswith("age_bracket_ohe")][0]
    assert out[encoded].size > 0 and out[encoded].numNonzeros() == 0  # an unseen level is the zero vector
    assert not [r for r in models.model_terms(model, train, top_k=99).collect() if "__unknown" in str(r)]
    path = os.path.join(tempfile.mkdtemp(prefix="lureline-model-"), "lr")
    models.save(model, path)
    again = models.load(path)
    a = [r.p for r in models.score(model, train).orderBy("target_id").collect()]
    b = [r.p for r in models.score(again, train).orderBy("target_id").collect()]
    assert a == pytest.approx(b)
    terms = models.model_terms(model, train, top_k=3).collect()
    assert len(terms) == 3 and terms[0].magnitude >= terms[-1].magnitude


def test_stratified_split_shares(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "target_id long, clicked_flag int")
    s = models.stratified_split(df, keys=("target_id",))
    counts = {(r.clicked_flag, r.split): r["count"] for r in s.groupBy("clicked_flag", "split").count().collect()}
    assert counts[(1, "test")] == 30 and counts[(0, "test")] == 270


def test_mixed_recovers_group_spread(spark):
    # groups with a planted random-intercept sd of 0.8, 60 groups, discrete covariates
    from lureline.functions.expressions import keyed_uniform
    rows = spark.range(0, 60000).select(
        (F.col("id") % 60).cast("string").alias("grp"), (F.col("id") % 2).cast("int").alias("signal_urgency"))
    u = F.expr("(conv(substr(md5(concat('g|', grp)), 1, 8), 16, 10) / 4294967296.0)")
    # an approximate normal from 12 uniforms would be costly; use a spread of fixed values instead
    eff = (u - 0.5) * 2.8  # uniform(-1.4, 1.4): sd ~ 0.81
    eta = F.lit(-1.0) + 0.5 * F.col("signal_urgency") + eff
    p = 1.0 / (1.0 + F.exp(-eta))
    data = rows.withColumn("clicked_flag", (keyed_uniform(7, F.col("grp"), F.monotonically_increasing_id()) < p).cast("int"))
    for c in ("signal_authority", "signal_reward", "signal_personalization"):
        data = data.withColumn(c, F.lit(0))
    data = data.withColumn("age_bracket", F.lit("18-24")).withColumn("gender", F.lit("F")).withColumn(
        "education", F.lit("Tecnica")).withColumnRenamed("grp", "segment_id")
    cells = mixed.mixed_cells(data)
    fit = mixed.fit_mixed(cells, max_iter=150)
    sd = math.exp(fit.m_s)
    assert 0.5 < sd < 1.2
    b_urg = fit.mean[fit.terms.index("signal_urgency")]
    assert abs(b_urg - 0.5) < 0.15


def test_stream_equals_batch(spark):
    resolved = attribution.resolve_uids(attribution.parse_hits(fx.hits(spark, SF_SMALL)), fx.targets(spark, SF_SMALL))
    log = fx.event_log(spark, SF_SMALL)
    batch = sorted(tuple(r) for r in attribution.attribute_hits(resolved, log).collect())
    stream = sorted(tuple(r) for r in stream_attr.attribution_via_stream(spark, log, resolved).collect())
    assert batch == stream and len(batch) > 0


def test_stream_state_carries_across_micro_batches(spark):
    """Five time-ordered files, one per trigger: hits are credited from deliveries kept in the
    per-target state of earlier micro-batches, including one older than the lateness window
    (the newest older delivery is kept)."""
    import datetime as dt
    import time

    t0 = dt.datetime(2024, 1, 1)

    def m(minutes):
        return t0 + dt.timedelta(minutes=minutes)

    def d(target, minute, eid, camp):
        return (target, 0, m(minute), eid, camp, camp * 10, None, None)

    def h(target, minute, hid):
        return (target, 1, m(minute), hid, None, None, "clicked", f"u{target}")

    files = [
        [d(7, 0, 1, 1)],
        [h(7, 1, 101), d(7, 3, 2, 2)],
        [h(7, 3, 102), h(7, 2, 103)],
        [h(7, 30, 104), h(8, 30, 105), d(8, 31, 3, 3), h(8, 32, 106), d(7, 100, 4, 4)],
        [h(7, 95, 107)],
    ]
    run = stream_attr.run_folder(spark, "stream-multibatch")
    for rows in files:
        spark.createDataFrame(rows, stream_attr.STREAM_SCHEMA).coalesce(1).write.mode("append").parquet(f"{run}/in")
        time.sleep(1.1)  # distinct modification times keep the file order
    q = stream_attr.start_attribution(spark, f"{run}/in", f"{run}/out", f"{run}/chk",
                                      max_files_per_trigger=1)
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == len(files)
    got = {r.hit_id: r.delivery_id for r in spark.read.parquet(f"{run}/out").collect()}
    assert got == {101: 1, 102: 2, 103: 1, 104: 2, 106: 3, 107: 2}


def test_stream_state_is_one_row_per_bucket(spark):
    """A micro-batch called Python once per target; now at most once per bucket (stream_attribution)."""
    n = stream_attr.BUCKETS + 500
    at = "timestamp'2024-01-01 00:00:00'"
    rows = spark.range(n).select(F.col("id").alias("target_id"), F.lit(0).alias("kind"), F.expr(at).alias("ts"), "id",
                                 F.lit(1).cast("long").alias("campaign_id"), F.lit(2).cast("long").alias("template_id"),
                                 F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("string").alias("uid"))
    hits = rows.select("target_id", F.lit(1).alias("kind"), F.expr(f"{at} + INTERVAL 1 MINUTE").alias("ts"), (F.col("id") + n).alias("id"),
                       F.lit(None).cast("long").alias("campaign_id"), F.lit(None).cast("long").alias("template_id"),
                       F.lit("clicked").alias("event_type"), F.lit("u").alias("uid"))
    run = stream_attr.run_folder(spark, "bucket-test")
    rows.unionByName(hits).write.parquet(f"{run}/in")
    q = stream_attr.start_attribution(spark, f"{run}/in", f"{run}/out", f"{run}/chk")
    q.awaitTermination()
    out = spark.read.schema(stream_attr.OUTPUT_SCHEMA).parquet(f"{run}/out")
    assert out.where("delivery_id = target_id and hit_id = target_id + %d" % n).count() == out.count() == n
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]) <= stream_attr.BUCKETS


def test_frozen_split_is_built_once_and_narrow(spark):
    """The passes of the split and the fit read frozen narrow rows, not the joined events (boosted_terms)."""
    from lureline.plans import registry_models as rm
    rows = spark.createDataFrame(
        [("a" if i % 2 else "b", 1, i, 1, 1, 1, 0, 0, 0, "18-24", "F", "T", int(i % 3 == 0), "wide") for i in range(40)],
        "source string, campaign_id long, target_id long, template_id long, segment_id long, signal_urgency int, "
        "signal_authority int, signal_reward int, signal_personalization int, age_bracket string, gender string, "
        "education string, clicked_flag int, template_subject string")
    joined = rows.join(spark.range(1, 2).withColumnRenamed("id", "campaign_id"), "campaign_id")
    split = rm._frozen_split(joined)
    assert split.columns == [*rm.MODEL_COLUMNS, "split"]
    assert "Join" not in split._jdf.queryExecution().optimizedPlan().toString()
    want = models.stratified_split(joined, keys=rm.SPLIT_KEYS).select(*split.columns)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, want.collect()))
