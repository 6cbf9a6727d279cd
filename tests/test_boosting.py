"""M9: boosted trees against a brute force over rows; M11: native scores against Spark ML's."""

import hashlib
import math
import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lureline.operators import boosting, models
from lureline.operators.boosting import BoostParams

PARAMS = BoostParams(rounds=7, block=3, rate=0.3)


def uniform(seed, *keys):
    return int(hashlib.md5("|".join([seed, *map(str, keys)]).encode()).hexdigest()[:8], 16) / 2 ** 32


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(400):
        urgency, age, n = rng.randint(0, 1), rng.choice(["18-24", "25-34", "35+", None]), rng.choice([0.0, 1.5, 2.0, 7.0, None])
        z = -1 + 1.5 * urgency + (age == "25-34") - (0.4 * (n or 0) if urgency else 0)
        out.append((i, urgency, age, n, int(rng.random() < 1 / (1 + math.exp(-z))), "clash"))
    return out + [(900, 1, "18-24", 1.0, None, "no label"), (901, 0, None, None, 1, "x"), (901, 0, None, None, 1, "x")]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "target_id long, urgency int, age string, n double, clicked_flag int, f0 string") \
        .repartition(5)


def brute(rows, model, params):
    """The same trees from one numpy row per row, no cells."""
    rows = [r for r in rows if r[4] is not None]
    y = np.array([r[4] for r in rows], float)
    x = np.array([[_bin(f, r) for f in model.features] for r in rows])
    scale = (y == 0).sum() / (y == 1).sum()
    weight = np.where(y == 1, scale, 1.0)
    margin, trees = np.zeros(len(rows)), []
    T = lambda g: math.copysign(max(0, abs(g) - params.alpha), g)
    S = lambda g, h: T(g) ** 2 / (h + params.lam)
    for t in range(params.rounds):
        names = [f.name for f in model.features]
        rank = sorted(range(len(names)), key=lambda i: hashlib.md5(f"42-columns-{t}|{names[i]}".encode()).hexdigest())
        allowed = sorted(rank[:max(1, math.floor(0.8 * len(names)))])
        inside = np.array([uniform(f"42-rows-{t}", r[0]) < 0.8 for r in rows])
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        splits, leaves, value = {}, {}, np.zeros(len(rows))

        def go(node, mask, depth):
            own = mask & inside
            G, H, best = g[own].sum(), h[own].sum(), None
            if not own.any():
                return
            if depth < params.depth:
                for f in allowed:
                    for b in sorted(set(x[own, f]))[:-1]:
                        left = own & (x[:, f] <= b)
                        hl = h[left].sum()
                        if hl < params.min_child_weight or H - hl < params.min_child_weight:
                            continue
                        gain = float(f"{S(g[left].sum(), hl) + S(G - g[left].sum(), H - hl) - S(G, H):.9g}")
                        if gain > 1e-6 and (best is None or gain > best[2]):
                            best = (f, int(b), gain)
            if best is None:
                leaves[node] = -params.rate * T(G) / (H + params.lam)
                value[mask] = leaves[node]
                return
            splits[node] = best
            go(2 * node + 1, mask & (x[:, best[0]] <= best[1]), depth + 1)
            go(2 * node + 2, mask & (x[:, best[0]] > best[1]), depth + 1)

        go(0, np.ones(len(rows), bool), 0)
        margin = margin + value
        trees.append((splits, leaves))
    return trees, {(r[0], i): 1 / (1 + math.exp(-m)) for i, (r, m) in enumerate(zip(rows, margin))}


def _bin(f, r):
    if f.level is not None:
        return int(r[2] == f.level)
    value = {"urgency": r[1], "n": r[3]}[f.column]
    return 0 if value is None else sum(value > c for c in f.cuts)


def test_trees_equal_brute_force(frame, rows):
    model = boosting.fit(frame, ["urgency", "n"], ["age"], keys=("target_id",), params=PARAMS)
    assert [f.name for f in model.features] == ["urgency", "n", "age=18-24", "age=25-34", "age=35+"]
    assert model.features[1].cuts == (0.0, 1.5, 2.0)
    trees, p = brute(rows, model, PARAMS)
    assert len(model.trees) == 7 and any(len(t.splits) > 4 for t in model.trees)
    for tree, (splits, leaves) in zip(model.trees, trees):
        assert {k: s[:2] for k, s in tree.splits.items()} == {k: s[:2] for k, s in splits.items()}
        assert all(math.isclose(tree.splits[k][2], splits[k][2], rel_tol=1e-7) for k in splits)
        assert tree.leaves.keys() == leaves.keys()
        assert all(math.isclose(tree.leaves[k], leaves[k], rel_tol=1e-9, abs_tol=1e-12) for k in leaves)
    want = sorted(v for _, v in p.items())
    got = sorted(r.p for r in model.score(frame.where("clicked_flag is not null")).collect())
    assert np.allclose(got, want)


def test_a_fit_does_not_depend_on_partitions_or_blocks(spark, frame):
    one = boosting.fit(frame, ["urgency", "n"], ["age"], keys=("target_id",), params=PARAMS)
    two = boosting.fit(frame.coalesce(1), ["urgency", "n"], ["age"], keys=("target_id",), params=replace(PARAMS, block=100))
    assert [t.splits.keys() for t in one.trees] == [t.splits.keys() for t in two.trees]
    a = [r.p for r in one.score(frame).orderBy("p").collect()]
    assert np.allclose(a, [r.p for r in two.score(frame).orderBy("p").collect()])


def test_a_model_survives_a_table(spark, frame, tmp_path):
    model = boosting.fit(frame, ["urgency"], ["age"], keys=("target_id",), params=replace(PARAMS, rounds=3))
    model.nodes(spark).write.parquet(f"{tmp_path}/model")
    again = boosting.BoostedTrees.from_nodes(spark.read.parquet(f"{tmp_path}/model"))
    assert again.features == model.features and again.trees == model.trees
    unseen = frame.withColumn("age", F.lit("99+"))
    assert unseen.count() == again.score(unseen).where("p > 0 and p < 1").count()
    top = model.importances(spark).first()
    assert top.magnitude == max(sum(s[2] for t in model.trees for s in t.splits.values() if s[0] == i)
                                for i in range(len(model.features)))


def test_guards_of_boosting(spark, frame):
    with pytest.raises(ValueError):
        boosting.fit(frame, [], [], keys=("target_id",), params=PARAMS)
    with pytest.raises(ValueError):
        boosting.find_features(frame, [], ["age"], replace(PARAMS, max_levels=2))
    alike = frame.withColumn("urgency", F.lit(1))  # nothing to split on: every tree is one leaf
    model = boosting.fit(alike, ["urgency"], [], keys=("target_id",), params=replace(PARAMS, rounds=2))
    assert all(not t.splits and list(t.leaves) == [0] for t in model.trees)


def test_histogram_rows_are_bounded_by_bins(frame):
    h = boosting.root_histogram(frame, ["urgency", "n"], ["age"], keys=("target_id",), params=PARAMS).collect()
    assert len(h) <= 2 + 4 + 3 * 2 and len({(r.feature, r.bin) for r in h}) == len(h)


def test_a_fitted_model_travels_after_an_observed_query(spark):
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    rows = [(float(i % 2), 0.0, 1.0, float(i % 3), "a", "F", "T", i % 2, 1.0) for i in range(40)]
    train = spark.createDataFrame(rows, "signal_urgency double, signal_authority double, signal_reward double, "
                                        "signal_personalization double, age_bracket string, gender string, education string, "
                                        "clicked_flag int, weight double")
    model = models.fit(models.logistic_pipeline(40), train)
    assert model.transform(train).select(vector_to_array("probability")[1].alias("p")).where("p > 0").count() == 40


@pytest.mark.parametrize("kind", ["logistic", "scaled", "tree", "boosted"])
def test_native_scores_equal_the_transformers(spark, kind):
    rows = [(i, float(i % 2), float((i // 2) % 2), float((i // 5) % 2), 1.0, ["18-24", "25-34", "35-44"][i % 3], ["F", "M"][i % 2],
             "Tecnica", int((i * 7919) % 11 < 3 + 4 * (i % 2)), 1.0 + i % 2) for i in range(220)]
    train = spark.createDataFrame(rows, "target_id long, signal_urgency double, signal_authority double, signal_reward double, "
                                        "signal_personalization double, age_bracket string, gender string, education string, "
                                        "clicked_flag int, weight double")
    made = {"logistic": models.logistic_pipeline(220), "scaled": models.logistic_pipeline(220, scale=True),
            "tree": models.tree_pipeline(), "boosted": models.gbt_pipeline(max_iter=5)}[kind]
    model = models.fit(made, train)
    data = train.unionByName(train.limit(3).withColumn("age_bracket", F.lit("99+"))).coalesce(1)
    want = model.transform(data).select("target_id", vector_to_array("probability")[1].alias("q"), "prediction")
    both = models.score(model, data).join(want, "target_id")
    assert both.count() >= 220
    assert both.where("abs(p - q) > 1e-9 or predicted_class <> prediction").where("target_id > 2").count() == 0
    assert both.groupBy("target_id").agg(F.min(F.abs(F.col("p") - F.col("q"))).alias("d")).where("d > 1e-9").count() == 0


def test_scores_of_hundreds_of_trees(spark):
    """A chain of 500 trees in one expression overflowed the stack (gbt_metrics)."""
    rows = [(i, float(i % 2), float((i // 2) % 2), 0.0, None if i == 7 else 1.0, ["18-24", "25-34"][i % 2], None if i == 9 else "F",
             "Tecnica", int((i * 7919) % 11 < 3 + 4 * (i % 2)), 1.0) for i in range(60)]
    data = spark.createDataFrame(rows, "target_id long, signal_urgency double, signal_authority double, signal_reward double, "
                                       "signal_personalization double, age_bracket string, gender string, education string, "
                                       "clicked_flag int, weight double")
    model = models.fit(models.gbt_pipeline(max_iter=2), data.where("target_id <> 7"))
    small = model.stages[-1]
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, 500)
    weights = gateway.new_array(jvm.double, 500)
    for i in range(500):
        trees[i] = small._java_obj.trees()[i % 2]
        weights[i] = small.treeWeights[i % 2] / 250
    java = jvm.org.apache.spark.ml.classification.GBTClassificationModel("gbtc_500", trees, weights)
    for name in ("featuresCol", "labelCol"):
        java.set(java.getParam(name), small._java_obj.getOrDefault(small._java_obj.getParam(name)))
    large = PipelineModel([*model.stages[:-1], GBTClassificationModel(java)])
    a = {r.target_id: r.p for r in models.score(model, data, context=("target_id",)).collect()}
    b = {r.target_id: r.p for r in models.score(large, data, context=("target_id",)).collect()}
    assert len(b) == 60 and a == pytest.approx(b)
