"""G2 (map) against a dense fit; A4, A5 with exact distinct counts from bitmaps."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lureline.operators import mixed, summaries


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(5)
    effect = [rng.gauss(0, 0.9) for _ in range(40)]
    rows = []
    for i in range(4000):
        g = rng.randrange(40) if i % 3 else 0  # a third of all rows in one group
        x = [rng.randint(0, 1) for _ in range(4)]
        age = rng.choice(["18-24", "25-34", "35+"])
        z = -1 + 0.8 * x[0] - 0.5 * x[1] + 0.4 * (age == "35+") + effect[g]
        rows.append((*x, age, "F", "Tecnica", f"g{g}", int(rng.random() < 1 / (1 + math.exp(-z)))))
    rows += [(0, 0, 0, 0, "35+", "F", "Tecnica", "lonely", 1)]
    data = spark.createDataFrame(rows, "signal_urgency int, signal_authority int, signal_reward int, signal_personalization int, "
                                       "age_bracket string, gender string, education string, segment_id string, clicked_flag int")
    return mixed.mixed_cells(data)


def test_map_equals_a_dense_fit(spark, cells):
    fit = mixed.fit_mixed_map(cells)
    rows = cells.collect()
    names = sorted({r.grp for r in rows})
    X = np.array([[1.0, r.signal_urgency, r.signal_authority, r.signal_reward, r.signal_personalization,
                   r.age_bracket == "25-34", r.age_bracket == "35+"] for r in rows], float)
    assert fit.terms == ["Intercept", "signal_urgency", "signal_authority", "signal_reward", "signal_personalization",
                         "C(age_bracket)[T.25-34]", "C(age_bracket)[T.35+]"]
    Z = np.array([[r.grp == g for g in names] for r in rows], float)
    A, n, k = np.hstack([X, Z]), np.array([r.n for r in rows], float), np.array([r.k for r in rows], float)
    p, s, theta = X.shape[1], 0.0, np.zeros(X.shape[1] + len(names))
    for _ in range(500):
        prior = np.diag([0.25] * p + [math.exp(-2 * s)] * len(names))
        for _ in range(100):
            mu = 1 / (1 + np.exp(-A @ theta))
            H = (A * (n * mu * (1 - mu))[:, None]).T @ A + prior
            step = np.linalg.solve(H, A.T @ (k - n * mu) - prior @ theta)
            theta = theta + step / max(1, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-13:
                break
        cov = np.linalg.inv(H)
        S2 = (theta[p:] ** 2 + np.diag(cov)[p:]).sum()
        low, high = -20.0, 20.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if -len(names) + S2 * math.exp(-2 * mid) - mid > 0 else (low, mid)
        if abs(low - s) < 1e-12:
            break
        s = low
    assert np.allclose(fit.mean, theta[:p], atol=1e-6) and abs(fit.m_s - s) < 1e-6
    assert np.allclose(fit.cov, cov[:p, :p], atol=1e-6)
    got = {r.grp: (r.m_g, r.v_g) for r in fit.groups.collect()}
    assert sorted(got) == names
    assert np.allclose([got[g][0] for g in names], theta[p:], atol=1e-6)
    assert np.allclose([got[g][1] for g in names], np.diag(cov)[p:], atol=1e-6)
    assert np.abs(fit.gradient).max() < 1e-6
    assert all(r.gradient == 0 for r in mixed.map_gradient(fit, spark).collect())
    assert 0.4 < math.exp(fit.m_s) < 1.6  # planted 0.9
    scored = mixed.predict_cells(fit, cells)
    assert scored.where("p > 0 and p < 1").count() == cells.count()


def test_map_of_separated_groups_stays_finite(spark, cells):
    fit = mixed.fit_mixed_map(cells.withColumn("k", F.col("n")))  # every trial a success
    assert np.isfinite(fit.mean).all() and np.isfinite(fit.m_s)
    assert all(math.isfinite(r.m_g) and r.v_g > 0 for r in fit.groups.collect())


def test_bitmaps_count_exactly(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, -7, 0, 1, 32767, 32768, 10 ** 12, rng.randrange(10 ** 6)]), rng.randrange(70000), i % 3, None,
             1, i % 2, 0, "x") for i in range(3000)]
    fact = spark.createDataFrame(rows, "campaign_id long, target_id long, segment_id int, template_id long, delivered long, "
                                       "opened_flag int, clicked_flag int, bits string")
    got = summaries.exact_distinct(fact, sums=("delivered", "opened_flag")).first().asDict()
    want = {"rows": 3000, "delivered": 3000, "opened_flag": 1500}
    for i, c in enumerate(summaries.ID_COLUMNS):
        want[c] = len({r[i] for r in rows} - {None})
    assert got == want
    for new, old in ((summaries.bitmap_global_summary, summaries.global_summary), (summaries.bitmap_general_table, summaries.general_table)):
        for data in (fact, fact.limit(0)):
            assert sorted(map(tuple, new(data).collect())) == sorted(map(tuple, old(data).collect()))
    plan = summaries.bitmap_global_summary(fact)._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan
