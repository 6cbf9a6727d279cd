"""Random-intercept logistic model fitted by mean-field variational Bayes.

Model: y ~ Bernoulli(sigmoid(x'b + u_g)), u_g ~ N(0, exp(2 s)), b ~ N(0, fe_sd^2 I),
s ~ N(0, vc_sd^2). q = N(m_b, V_b) x prod_g N(m_g, v_g) x N(m_s, v_s).

All covariates are discrete, so the data collapse to *cells* (covariate pattern x group) with
trials n and successes k (G1): sufficient statistics whose size does not grow with repeated rows.
The logistic likelihood uses the Jaakkola-Jordan bound
log sigmoid(z) >= log sigmoid(xi) + (z - xi)/2 - lambda(xi)(z^2 - xi^2), lambda = tanh(xi/2)/(4 xi),
which makes every coordinate update closed form:

* groups: v_g = 1 / (E[e^{-2s}] + 2 sum n lambda), m_g = v_g (sum (k - n/2) - 2 sum n lambda x'm_b)
  -- a distributed ``groupBy(group)`` whose result stays a (checkpointed) DataFrame;
* fixed effects: one aggregate of sum n lambda x x' (p x p, p ~ 14) and sum x (...) -> driver solve;
* log-sd: two scalars (number of groups, sum m_g^2 + v_g) -> a 2-parameter Newton step.

Each iteration is two passes over the cells; nothing group-sized goes through the driver.
The joint mode over (u, s) is not used: with u = 0 it pulls the variance to zero.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.constants import DEMOGRAPHIC_COLUMNS, SIGNAL_COLUMNS, TARGET_COLUMN
from lureline.session import ensure_checkpoint_dir


def mixed_cells(df: DataFrame, group: str = "segment_id", label: str = TARGET_COLUMN) -> DataFrame:
    """G1: clean, drop null label/group, group as string, collapse to (covariates, group) cells."""
    from lureline.operators.facts import clean_dataset
    d = clean_dataset(df).dropna(subset=[label, group])
    return d.groupBy(*SIGNAL_COLUMNS, *DEMOGRAPHIC_COLUMNS, F.col(group).cast("string").alias("grp")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.sum(F.col(label)).cast("bigint").alias("k"))


@dataclass
class MixedFit:
    terms: list[str]
    mean: np.ndarray
    cov: np.ndarray
    m_s: float
    v_s: float
    groups: DataFrame           # grp, m_g, v_g
    component: str
    iterations: int


def _design(cells: DataFrame) -> tuple[list[str], list[F.Column]]:
    """Treatment coding: intercept, signals, one column per non-base level (base = first alphabetically)."""
    terms, cols = ["Intercept"], [F.lit(1.0)]
    for s in SIGNAL_COLUMNS:
        terms.append(s)
        cols.append(F.col(s).cast("double"))
    for c in DEMOGRAPHIC_COLUMNS:
        levels = sorted(r[0] for r in cells.select(c).distinct().collect())  # a categorical's levels
        for lv in levels[1:]:
            terms.append(f"C({c})[T.{lv}]")
            cols.append((F.col(c) == lv).cast("double"))
    return terms, cols


def _lambda(xi: np.ndarray) -> np.ndarray:
    return np.where(xi < 1e-8, 0.125, np.tanh(xi / 2.0) / (4.0 * np.maximum(xi, 1e-8)))


def _whole_groups(batches):
    """Rows sorted by group -> frames that hold whole groups (the last group is carried on)."""
    rest = None
    for pdf in batches:
        if pdf.empty:
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = int(np.searchsorted(pdf["grp"].to_numpy(), pdf["grp"].iloc[-1]))
        if last:
            yield pdf.iloc[:last]
        rest = pdf.iloc[last:]
    if rest is not None:
        yield rest


def _group_effects(pdf: pd.DataFrame, m_b: np.ndarray, V_b: np.ndarray, e_inv_var: float):
    """Group means and variances at their optimum for the given fixed effects."""
    X = np.stack(pdf["x"].to_numpy())
    n, k = pdf["n"].to_numpy(dtype=float), pdf["k"].to_numpy(dtype=float)
    xb = X @ m_b
    quad = np.einsum("ij,jk,ik->i", X, V_b, X)
    starts = np.flatnonzero(np.concatenate([[True], pdf["grp"].to_numpy()[1:] != pdf["grp"].to_numpy()[:-1]]))
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
    m, v = np.zeros(len(starts)), np.full(len(starts), 1.0 / e_inv_var)
    for _ in range(200):
        lam = _lambda(np.sqrt((xb + m[of]) ** 2 + quad + v[of]))
        a = e_inv_var + np.add.reduceat(2.0 * n * lam, starts)
        new = np.add.reduceat((k - n / 2.0) - 2.0 * n * lam * xb, starts) / a
        done = np.max(np.abs(new - m)) < 1e-10
        m, v = new, 1.0 / a
        if done:
            break
    return X, n, k, xb, quad, starts, of, m, v


def _sums(m_b: np.ndarray, V_b: np.ndarray, e_inv_var: float):
    """Per frame of groups one row: the sums that the fixed effects and the variance need."""
    def fn(batches):
        for pdf in _whole_groups(batches):
            X, n, k, xb, quad, _, of, m, v = _group_effects(pdf, m_b, V_b, e_inv_var)
            w = n * _lambda(np.sqrt((xb + m[of]) ** 2 + quad + v[of]))
            P = (X * w[:, None]).T @ X
            r = X.T @ ((k - n / 2.0) - 2.0 * w * m[of])
            tail = [float(len(m)), m.sum(), (m * m + v).sum()]
            yield pd.DataFrame({"v": [np.concatenate([P.reshape(-1), r, tail]).tolist()]})
    return fn


def fit_mixed(cells: DataFrame, component: str = "re_segment_id", fe_sd: float = 2.0,
              vc_sd: float = 1.0, max_iter: int = 200, tol: float = 1e-5) -> MixedFit:
    """Variational fit on the cell table (see module doc).

    The cells are dealt out by group and sorted once (a group has at most one cell per covariate
    combination), so each iteration is one job: every group's effect is brought to its optimum for
    the current fixed effects, and the p x p sums of all groups are added up by Spark; p^2 + p + 3
    numbers reach the driver. The intercept absorbs the mean group effect after each sweep
    (centering), which removes the slow ridge between the intercept and the group effects.
    """
    spark = cells.sparkSession
    ensure_checkpoint_dir(spark)
    terms, xcols = _design(cells)
    p = len(terms)
    base = cells.select("grp", "n", "k", F.array(*xcols).alias("x")) \
        .repartition("grp").sortWithinPartitions("grp").checkpoint(eager=True)
    m_b, V_b = np.zeros(p), np.eye(p) * fe_sd ** 2
    m_s, v_s = 0.0, 1.0
    it, e_inv_var = 0, 1.0
    for it in range(1, max_iter + 1):
        e_inv_var = math.exp(-2.0 * m_s + 2.0 * v_s)
        parts = base.mapInPandas(_sums(m_b, V_b, e_inv_var), "v array<double>")
        rows = parts.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
        total = np.zeros(p * p + p + 3)
        total[[x["pos"] for x in rows]] = [x["s"] for x in rows]
        V_new = np.linalg.inv(np.eye(p) / fe_sd ** 2 + 2.0 * total[:p * p].reshape(p, p))
        m_new = V_new @ total[p * p:p * p + p]
        G, S1, S2 = total[-3:]
        shift = S1 / G if G else 0.0
        m_new[0] += shift                       # centering: intercept takes the mean group effect
        m_s, v_s = _update_log_sd(G, S2 - 2.0 * shift * S1 + G * shift * shift, m_s, v_s, vc_sd)
        delta = float(np.max(np.abs(m_new - m_b)))
        m_b, V_b = m_new, V_new
        if delta < tol:
            break

    def effects(batches):
        for pdf in _whole_groups(batches):
            _, _, _, _, _, starts, _, m, v = _group_effects(pdf, m_b, V_b, e_inv_var)
            yield pd.DataFrame({"grp": pdf["grp"].to_numpy()[starts], "m_g": m, "v_g": v})

    groups = base.mapInPandas(effects, "grp string, m_g double, v_g double")
    return MixedFit(terms, m_b, V_b, m_s, v_s, groups, component, it)


def _profile(pdf: pd.DataFrame, b: np.ndarray, inv_var: float):
    """Every group's effect at its mode for the given fixed effects (a Newton step per group), and
    what block elimination needs: weights, the groups' diagonal block and their coupling to ``b``."""
    X = np.stack(pdf["x"].to_numpy())
    n, k = pdf["n"].to_numpy(dtype=float), pdf["k"].to_numpy(dtype=float)
    starts = np.flatnonzero(np.concatenate([[True], pdf["grp"].to_numpy()[1:] != pdf["grp"].to_numpy()[:-1]]))
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
    u, xb = np.zeros(len(starts)), X @ b
    for _ in range(200):
        mu = 1.0 / (1.0 + np.exp(-(xb + u[of])))
        diagonal = np.add.reduceat(n * mu * (1.0 - mu), starts) + inv_var
        step = (np.add.reduceat(k - n * mu, starts) - inv_var * u) / diagonal
        u = u + np.clip(step, -2.0, 2.0)  # the objective is concave; long steps could overshoot
        if np.max(np.abs(step)) < 1e-13:
            break
    mu = 1.0 / (1.0 + np.exp(-(xb + u[of])))
    weight = n * mu * (1.0 - mu)
    diagonal = np.add.reduceat(weight, starts) + inv_var
    coupling = np.add.reduceat(X * weight[:, None], starts, axis=0)
    return X, k - n * mu, weight, starts, u, diagonal, coupling


def _map_sums(b: np.ndarray, V: np.ndarray, inv_var: float):
    def fn(batches):
        for pdf in _whole_groups(batches):
            X, residual, weight, _, u, diagonal, coupling = _profile(pdf, b, inv_var)
            schur = (X * weight[:, None]).T @ X - (coupling / diagonal[:, None]).T @ coupling
            spread = 1.0 / diagonal + np.einsum("ij,jk,ik->i", coupling, V, coupling) / diagonal ** 2
            tail = [float(len(u)), (u * u + spread).sum()]
            yield pd.DataFrame({"v": [np.concatenate([schur.reshape(-1), X.T @ residual, tail]).tolist()]})
    return fn


def fit_mixed_map(cells: DataFrame, component: str = "re_segment_id", fe_sd: float = 2.0, vc_sd: float = 1.0,
                  max_iter: int = 100, tol: float = 1e-9) -> MixedFit:
    """G2, method ``map``: posterior mode of fixed and group effects, variance by Laplace.

    For a given log-sd s the mode of (b, u) solves a concave problem whose group block of the
    Hessian is diagonal. Groups are eliminated where their cells are: each is brought to its own
    mode, and the Schur complement ``X'WX - sum c c' / d`` and the gradient are added up by Spark
    (p^2 + p + 2 numbers reach the driver), which takes a Newton step in b. The log-sd solves
    ``-G + sum(u^2 + var u) e^(-2s) - s / vc_sd^2 = 0`` with the Laplace variances of the group
    effects; the joint mode over (u, s) is of no use, as u = 0 with s to minus infinity beats it.
    ``gradient`` on the result holds the gradient of the log posterior in b at the optimum.
    """
    ensure_checkpoint_dir(cells.sparkSession)
    terms, xcols = _design(cells)
    p = len(terms)
    base = cells.select("grp", "n", "k", F.array(*xcols).alias("x")) \
        .repartition("grp").sortWithinPartitions("grp").checkpoint(eager=True)
    b, V, s, it, close = np.zeros(p), np.zeros((p, p)), 0.0, 0, False
    while True:
        parts = base.mapInPandas(_map_sums(b, V, math.exp(-2.0 * s)), "v array<double>")
        rows = parts.select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
        total = np.zeros(p * p + p + 2)
        total[[x["pos"] for x in rows]] = [x["s"] for x in rows]
        gradient = total[p * p:p * p + p] - b / fe_sd ** 2
        V = np.linalg.inv(total[:p * p].reshape(p, p) + np.eye(p) / fe_sd ** 2)
        if close or it >= max_iter:  # the last job measured the gradient at the returned point
            break
        it += 1
        step = V @ gradient
        b = b + step / max(1.0, float(np.max(np.abs(step))) / 2.0)
        s_new = _laplace_log_sd(total[-2], total[-1], s, vc_sd)
        close = float(np.max(np.abs(step))) < tol and abs(s_new - s) < tol
        s = s if close else s_new
    inv_var = math.exp(-2.0 * s)

    def effects(batches):
        for pdf in _whole_groups(batches):
            _, _, _, starts, u, diagonal, coupling = _profile(pdf, b, inv_var)
            v = 1.0 / diagonal + np.einsum("ij,jk,ik->i", coupling, V, coupling) / diagonal ** 2
            yield pd.DataFrame({"grp": pdf["grp"].to_numpy()[starts], "m_g": u, "v_g": v})

    v_s = 1.0 / (2.0 * total[-1] * inv_var + 1.0 / vc_sd ** 2)
    fit = MixedFit(terms, b, V, s, v_s, base.mapInPandas(effects, "grp string, m_g double, v_g double"), component, it)
    fit.gradient = gradient
    return fit


def _laplace_log_sd(G: float, S2: float, s: float, vc_sd: float) -> float:
    """Root of -G + S2 e^(-2s) - s / vc^2 (it falls in s): Newton from a point left of the root."""
    prec = 1.0 / vc_sd ** 2
    if G <= 0:
        return 0.0
    s = min(s, 0.5 * math.log(max(S2, 1e-300) / G) if S2 > 0 else s, 0.0)
    for _ in range(200):
        e = S2 * math.exp(-2.0 * s)
        step = (-G + e - prec * s) / (2.0 * e + prec)
        s += step
        if abs(step) < 1e-14:
            break
    return s


def map_gradient(fit: MixedFit, spark) -> DataFrame:
    """Size of the log posterior's gradient per fixed effect at the optimum of ``fit_mixed_map``."""
    return spark.createDataFrame([(t, abs(float(g))) for t, g in zip(fit.terms, fit.gradient)], "term string, gradient double") \
        .select("term", F.round("gradient", 5).alias("gradient"))


def _update_log_sd(G: float, S2: float, m: float, v: float, vc_sd: float) -> tuple[float, float]:
    """Maximise -G m - S2/2 e^{-2m+2v} - (m^2 + v)/(2 vc^2) + log(v)/2 over (m, v > 0)."""
    prec = 1.0 / vc_sd ** 2
    for _ in range(50):
        e = S2 * math.exp(-2.0 * m + 2.0 * v)
        gm, hm = -G + e - prec * m, -2.0 * e - prec
        m -= gm / hm
        e = S2 * math.exp(-2.0 * m + 2.0 * v)
        lv = math.log(v)  # Newton in log v keeps v positive
        gv = (-e - prec / 2.0) * v + 0.5
        hv = (-2.0 * e) * v * v + (-e - prec / 2.0) * v
        lv -= gv / hv if hv < 0 else -0.1
        v = math.exp(lv)
        if abs(gm) < 1e-12 and abs(gv) < 1e-12:
            break
    return m, v


def fixed_effects(fit: MixedFit, spark) -> DataFrame:
    """Term, posterior mean and sd, approximate odds ratio, sorted by term."""
    rows = [(t, float(fit.mean[i]), float(math.sqrt(fit.cov[i, i])), float(math.exp(fit.mean[i])))
            for i, t in enumerate(fit.terms)]
    return spark.createDataFrame(sorted(rows), "term string, posterior_mean double, posterior_sd double, "
                                               "odds_ratio_approx double")


def variance_components(fit: MixedFit, spark) -> DataFrame:
    """Posterior mean and sd of the log standard deviation, and exp(mean)."""
    return spark.createDataFrame(
        [(fit.component, float(fit.m_s), float(math.sqrt(fit.v_s)), float(math.exp(fit.m_s)))],
        "component string, posterior_mean_log_sd double, posterior_sd_log_sd double, sd_approx double")


def extreme_terms(fe: DataFrame, k: int = 5) -> DataFrame:
    """K3: the k most positive and k most negative fixed effects (intercept excluded)."""
    body = fe.where(F.col("term") != "Intercept")
    pos = body.where(F.col("posterior_mean") > 0).orderBy(F.col("posterior_mean").desc(), "term").limit(k)
    neg = body.where(F.col("posterior_mean") < 0).orderBy(F.col("posterior_mean").asc(), "term").limit(k)
    return pos.withColumn("direction", F.lit("positive")).unionByName(neg.withColumn("direction", F.lit("negative")))


def predict_cells(fit: MixedFit, cells: DataFrame, threshold: float = 0.5) -> DataFrame:
    """p = sigmoid(x'm_b + m_g) per cell (unseen group -> m_g = 0), class at p >= threshold."""
    _, xcols = _design_from_terms(fit.terms)
    eta = sum(c * float(fit.mean[i]) for i, c in enumerate(xcols))
    out = cells.join(fit.groups, "grp", "left").withColumn(
        "_eta", eta + F.coalesce(F.col("m_g"), F.lit(0.0)))
    prob = 1.0 / (1.0 + F.exp(-F.col("_eta")))
    return out.select(*SIGNAL_COLUMNS, *DEMOGRAPHIC_COLUMNS, "grp", "n", "k",
                      prob.alias("p"), (prob >= threshold).cast("int").alias("predicted_class"))


def _design_from_terms(terms: list[str]) -> tuple[list[str], list[F.Column]]:
    cols = []
    for t in terms:
        if t == "Intercept":
            cols.append(F.lit(1.0))
        elif t.startswith("C("):
            c, lv = t[2:].split(")[T.", 1)
            cols.append((F.col(c) == lv[:-1]).cast("double"))
        else:
            cols.append(F.col(t).cast("double"))
    return terms, cols
