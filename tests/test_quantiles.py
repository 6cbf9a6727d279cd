"""Exact order statistics and buckets without a sort, against sorted lists."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lureline.operators import evaluation, quantiles


def test_order_statistics_equal_a_sorted_list(spark, monkeypatch):
    rng = random.Random(1)
    values = [rng.choice([0.5, rng.random(), rng.gauss(0, 1), -3.0]) for _ in range(30_000)] + [None] * 5
    groups = [rng.randrange(3) for _ in values]
    df = spark.createDataFrame(list(zip(values, groups)), "v double, g int").repartition(7)
    parts = {g: sorted(v for v, h in zip(values, groups) if h == g and v is not None) for g in range(3)}
    ranks = {g: {"n": len(p), "ranks": [1, 2, 777, len(p) // 2, len(p) - 1, len(p)]} for g, p in parts.items()}
    for accuracy, interior in ((10_000, 20_000), (20, 50)):  # a coarse sketch: brackets in brackets
        monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
        monkeypatch.setattr(quantiles, "INTERIOR", interior)
        got = quantiles.order_statistics(df, "v", ranks, "g")
        for g, p in parts.items():
            for r in ranks[g]["ranks"]:
                v = p[r - 1]
                assert got[g, r] == (v, sum(x < v for x in p), p.count(v))
    assert quantiles.order_statistics(df, "v", {0: {"n": 0, "ranks": []}}) == {}


def buckets(rows, q):
    """W1 by sorting: rank of the descending score, ties by keys, then label."""
    n = len(rows)
    ordered = sorted(rows, key=lambda r: (-r[3], r[0] or "", -2 ** 63 if r[1] is None else r[1], r[2], r[4]))
    q = min(q, n)
    out = {}
    for i, r in enumerate(ordered):
        b = 1 if n == 1 else max(1, -(-(i * q) // (n - 1)))
        out.setdefault(b, []).append(r)
    return out


@pytest.mark.parametrize("n,scores,bins", [(1, 5, 10), (2, 1, 10), (7, 3, 10), (100, 100, 10), (724, 6, 10), (3000, 4, 7), (999, 1, 10),
                                           (501, 10 ** 9, 3), (50, 2, 1)])
def test_lift_equals_sorted_buckets(spark, n, scores, bins):
    rng = random.Random(n)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1, 2, 3]), rng.randrange(max(1, n // 3)), rng.randrange(scores) / scores, rng.randint(0, 1))
            for _ in range(n)]
    if n == 999:  # rows alike in everything
        rows = [("a", 1, 1, 0.25, i % 2) for i in range(n)]
    ev = spark.createDataFrame(rows, "source string, campaign_id long, target_id long, p double, y int").repartition(3)
    got = {r.bucket: r for r in evaluation.lift_table(ev, bins).collect()}
    want = buckets(rows, bins)
    assert set(got) == set(want)
    pos = sum(r[4] for r in rows)
    for b, held in want.items():
        r = got[b]
        p = [x[3] for x in held]
        assert (r.rows, r.positives, r.min_score, r.max_score) == (len(held), sum(x[4] for x in held), min(p), max(p))
        assert math.isclose(r.avg_score, np.mean(p), abs_tol=1e-9)
        assert r.cumulative_rows == sum(len(want[x]) for x in want if x <= b)
        if pos:
            assert math.isclose(r.lift, (r.positives / r.rows) / (pos / n))


def test_calibration_equals_linear_percentiles(spark):
    rng = random.Random(9)
    for n in (1, 2, 30, 5000):
        rows = [(rng.choice([0.25, rng.random()]), rng.randint(0, 1)) for _ in range(n)]
        ev = spark.createDataFrame(rows, "p double, y int")
        p, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        edges = np.percentile(p, np.linspace(0, 100, 11))
        at = np.searchsorted(edges[1:-1], p)
        want = [(p[at == b].mean(), y[at == b].mean()) for b in sorted(set(at))]
        got = [(r.predicted_probability_mean, r.observed_positive_rate) for r in evaluation.calibration_curve(ev).orderBy("bin").collect()]
        assert np.allclose(got, want, atol=1e-9)


def test_no_row_is_sorted(spark):
    ev = spark.range(1000).select((F.rand(1)).alias("p"), (F.col("id") % 2).cast("int").alias("y"), F.col("id").alias("target_id"))
    plan = evaluation.lift_table(ev.checkpoint())._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and plan.count("Sort [") <= 1  # the window over the buckets


def test_nothing_to_rank(spark):
    ev = spark.createDataFrame([], "p double, y int, target_id long")
    assert evaluation.lift_table(ev).count() == 0 and evaluation.calibration_curve(ev).count() == 0
