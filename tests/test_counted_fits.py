"""Fits from counts of equal rows: the draws and trees of the row-wise fits, in few jobs."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lureline.operators import draws, gbt, models

TRAIN = ("target_id long, signal_urgency double, signal_authority double, signal_reward double, signal_personalization double, "
         "age_bracket string, gender string, education string, clicked_flag int, weight double")


@pytest.fixture(scope="module")
def train(spark):
    rng, rows = random.Random(5), []
    for i in range(1500):
        flags, age, y = [float(rng.random() < 0.4) for _ in range(3)], rng.choice(["18-24", "25-34", "45-54"]), 0
        y = int(rng.random() < 0.15 + 0.3 * flags[0] + 0.2 * (age == "25-34"))
        rows.append((i, *flags, 1.0, age, rng.choice("FM"), rng.choice(["Tecnica", "Primaria", "unknown"]), y, 2.5 if y else 0.6))
    return spark.createDataFrame(rows + rows[:40], TRAIN).repartition(5).cache()


def jobs_of(spark, name, work):
    spark.sparkContext.setJobGroup(name, name)
    try:
        return work(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def parts(model):
    text = model.stages[-1].toDebugString.split("\n", 1)[1]
    number = r"Predict: (\S+)"
    return re.sub(number, "Predict", text), [float(x) for x in re.findall(number, text)]


def test_counted_trees_are_those_of_spark(spark, train):
    """gbt_metrics: Spark took a job per level of each of 500 trees."""
    made = models.gbt_pipeline(max_iter=30)
    ours, jobs = jobs_of(spark, "counted", lambda: models.fit(made, train))
    want = made.fit(train)
    (shape, values), (other, wanted) = parts(ours), parts(want)
    assert shape == other and shape.count("If (") > 200
    assert np.allclose(values, wanted, rtol=1e-8)
    assert np.allclose(ours.stages[-1].featureImportances.toArray(), want.stages[-1].featureImportances.toArray())
    assert ours.stages[-1].treeWeights == want.stages[-1].treeWeights and jobs < 20
    a, b = ({r.target_id: r.p for r in models.score(m, train, ("target_id",)).collect()} for m in (ours, want))
    assert a == pytest.approx(b) and len(a) == 1500


def test_more_cells_than_memory_holds_are_fitted_by_spark(spark, train, monkeypatch):
    made = models.gbt_pipeline(max_iter=3)
    ours = models.fit(made, train)
    monkeypatch.setattr(draws, "MOST_COUNTS", 3)
    monkeypatch.setattr(gbt, "spark_model", None)
    assert parts(models.fit(made, train))[0] == parts(ours)[0]


def test_numbers_as_signals(spark, train):
    """A signal of several values is cut between them; a level that the training rows lack scores as in Spark."""
    data = train.withColumn("signal_reward", (F.col("target_id") % 5).cast("double") - 1)
    made = models.gbt_pipeline(max_iter=8)
    ours, want = models.fit(made, data), made.fit(data)
    assert parts(ours)[0] == parts(want)[0]
    odd = data.limit(20).withColumn("gender", F.lit("X")).withColumn("signal_reward", F.lit(9.5))
    a, b = ([r.p for r in models.score(m, odd, ("target_id",)).orderBy("target_id").collect()] for m in (ours, want))
    assert a == pytest.approx(b) and len(a) == 20


def test_draws_are_those_of_the_rows(spark):
    random_of = spark._jvm.org.apache.spark.util.random.XORShiftRandom
    drawn = draws.BaggedDraws(42, 0.8, 11).start(2)
    got = np.concatenate([drawn([None] * n) for n in (70, 1, 33)])
    for t in range(11):
        java = random_of(42 + t + 2 + 1)
        assert [java.nextDouble() < 0.8 for _ in range(len(got))] == got[:, t].tolist()
    rng = random.Random(1)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in [*range(130), 0, 44, 45]]
    prefixes = [f"42-rows-{t}".encode() for t in (0, 10, 499)]
    for prefix, heads in zip(prefixes, draws.md5_heads(prefixes, texts)):
        assert [int(hashlib.md5(prefix + t).hexdigest()[:8], 16) for t in texts] == heads.tolist()


def test_counts_of_keyed_draws(spark):
    """Null keys, rows that come twice and keys of more than one block, against the expression itself."""
    from lureline.functions.expressions import keyed_uniform
    rows = [(None if i % 7 == 0 else "s" * (i % 90), None if i % 5 == 0 else i // 2, "a" if i % 3 else None, i % 2 == 0) for i in range(900)]
    df = spark.createDataFrame(rows, "k1 string, k2 long, c string, y boolean").repartition(3)
    keyed = draws.KeyedDraws(7, 0.6, 13)
    counted = draws.sampled_counts(df.withColumn("_t", draws.KeyedDraws.text(["k1", "k2"])), ["c", "y"], keyed, "_t")
    want = df.groupBy("c", "y").agg(F.array(*[F.count_if(keyed_uniform(f"7-rows-{t}", "k1", "k2") < 0.6) for t in range(13)]).alias("drawn"))
    assert sorted(map(str, counted.collect())) == sorted(map(str, want.collect())) and counted.count() == 4


def test_registered_boosted_terms_take_all_rounds(spark, train, monkeypatch):
    """boosted_terms ran 12 of the 500 rounds."""
    from lureline.plans import registry_models as rm
    ids = [F.col("target_id").alias(c) for c in ("campaign_id", "template_id", "segment_id")]
    rows = train.select(F.when(F.col("target_id") % 2 == 0, "a").otherwise("b").alias("source"), "*", *ids)
    monkeypatch.setattr(rm, "_observed", lambda s, sf: rows)
    (model, test), jobs = jobs_of(spark, "boosted", lambda: rm._boost(spark, ""))
    assert len(model.trees) == 500 and jobs < 60
    assert all(t.leaves for t in model.trees) and len({tuple(sorted(t.splits.items())) for t in model.trees}) > 400
    scores = model.score(test, context=("target_id",)).collect()
    assert len(scores) == test.count() and all(0 < r.p < 1 for r in scores)
    names, bins = [f.name for f in model.features], []
    for r in test.select(*models.SIGNAL_COLUMNS, *models.DEMOGRAPHIC_COLUMNS).collect():
        bins.append([int(r[f.column] > f.cuts[0]) if f.cuts else 0 if f.level is None else int(r[f.column] == f.level)
                     for f in model.features])
    margin = sum(t.values(np.array(bins)) for t in model.trees)
    assert np.allclose(sorted(1 / (1 + np.exp(-margin))), sorted(r.p for r in scores))
    terms = rm.q_boosted_terms(spark, "").collect()
    gain = {n: sum(s[2] for t in model.trees for s in t.splits.values() if names[s[0]] == n) for n in names}
    assert {r.feature: r.value for r in terms} == pytest.approx(gain)


def test_boosting_by_jobs_and_in_memory_agree(spark, train, monkeypatch):
    """Labels and keys that are null, rows that come twice."""
    from lureline.operators import boosting
    params = boosting.BoostParams(rounds=4, block=3, rate=0.3)
    rows = train.withColumn("clicked_flag", F.when(F.col("target_id") % 31 != 0, F.col("clicked_flag"))) \
        .withColumn("source", F.when(F.col("target_id") % 3 != 0, "s")).withColumn("campaign_id", F.col("target_id") % 7) \
        .withColumn("age_bracket", F.when(F.col("target_id") % 11 != 0, F.col("age_bracket")))
    fit = lambda: boosting.fit(rows, models.SIGNAL_COLUMNS, models.DEMOGRAPHIC_COLUMNS, params=params)
    one = fit()
    monkeypatch.setattr(draws, "MOST_COUNTS", 0)
    two = fit()
    for a, b in zip(one.trees, two.trees, strict=True):
        assert {k: s[:2] for k, s in a.splits.items()} == {k: s[:2] for k, s in b.splits.items()}
        assert a.leaves == pytest.approx(b.leaves)
    assert sum(len(t.splits) for t in one.trees) > 20
