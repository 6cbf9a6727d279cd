"""Model evaluation as DataFrame aggregates.

Inputs are frames with a label ``y`` (0/1), a score ``p`` and key columns. Every metric is a
distributed aggregate; ranks come from bracketing (``quantiles``), running sums over distinct scores
from ``with_global_rank`` (no single-partition window over rows).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lureline.operators.quantiles import after, key_order, order_statistics, rows_at_ranks
from lureline.operators.ranking import with_global_rank
from lureline.session import ensure_checkpoint_dir

MEAN_DECIMALS = 10
NAN = float("nan")


def evaluation_frame(fact: DataFrame, score_col: str = "click_probability",
                     keys=("source", "campaign_id", "target_id")) -> DataFrame:
    """All rows of the fact; y = clicked_flag, p = the closed-form score (X8) or any score column."""
    from lureline.operators.synthetic import score_probabilities
    rows = fact
    if score_col not in rows.columns:
        rows = score_probabilities(rows)
    return rows.select(*[k for k in keys if k in rows.columns],
                       F.col("clicked_flag").cast("int").alias("y"), F.col(score_col).cast("double").alias("p"))


def confusion_matrix(ev: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Tn, fp, fn, tp with labels fixed to [0, 1], in one aggregate."""
    pred = F.col("p") >= threshold
    pos = F.col("y") == 1
    return ev.agg(
        F.count_if(~pos & ~pred).cast("bigint").alias("tn"),
        F.count_if(~pos & pred).cast("bigint").alias("fp"),
        F.count_if(pos & ~pred).cast("bigint").alias("fn"),
        F.count_if(pos & pred).cast("bigint").alias("tp"),
    )


def _div(a: F.Column, b: F.Column) -> F.Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def classification_metrics(ev: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall, F1; zero division -> 0."""
    cm = confusion_matrix(ev, threshold)
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return cm.select(
        (tn + fp + fn + tp).alias("n_rows"),
        (fn + tp).alias("positives"),
        _div(tp + tn, tn + fp + fn + tp).alias("accuracy"),
        _div(tp, tp + fp).alias("precision"),
        _div(tp, tp + fn).alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def roc_auc(ev: DataFrame) -> DataFrame:
    """Exact ROC-AUC (ties count one half), null when only one class is present.

    Aggregate to one row per distinct score first, then a distributed running sum of the
    negatives in ascending score order: sum_s pos_s * (neg below s + neg_s / 2) / (P * N).
    """
    per = ev.groupBy("p").agg(F.count_if(F.col("y") == 1).cast("bigint").alias("pos"),
                              F.count_if(F.col("y") == 0).cast("bigint").alias("neg"))
    ranked = with_global_rank(per, ["p"], sum_cols=["neg"])
    below = F.col("_cum_neg") - F.col("neg")
    terms = ranked.agg(
        F.sum(F.col("pos").cast("double") * below.cast("double")
              + 0.5 * F.col("pos").cast("double") * F.col("neg").cast("double")).alias("s"),
        F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return terms.select(
        F.when((F.col("P") > 0) & (F.col("N") > 0),
               F.bround(F.col("s") / (F.col("P").cast("double") * F.col("N").cast("double")), 12))
        .alias("roc_auc"))


def brier_score(ev: DataFrame) -> DataFrame:
    """Mean squared error of the probability, null on an empty input."""
    return ev.agg(F.bround(F.avg((F.col("p") - F.col("y")) ** 2), MEAN_DECIMALS).alias("brier_score"))


def calibration_curve(ev: DataFrame, n_bins: int = 10) -> DataFrame:
    """E5: quantile-binned calibration: edges at the 0..100 percentiles (linear interpolation
    between order statistics), bin = number of interior edges below p, empty bins dropped
    and the rest numbered 1..k.

    The order statistics come from a sketch and an exact counting pass (``quantiles``): no row is
    sorted. ``ev`` is read a few times, so it should be a stored table of predictions.
    """
    rows = ev.select(F.col("p").cast("double").alias("p"), "y").where("p is not null")
    n = rows.count()
    if n == 0:
        return ev.sparkSession.createDataFrame(
            [], "bin int, predicted_probability_mean double, observed_positive_rate double")
    plan = []
    for k in range(1, n_bins):
        h = (n - 1) * (k / n_bins)
        plan.append((int(h // 1) + 1, h - int(h // 1)))
    ranks = sorted({r for lo, _ in plan for r in (lo, min(lo + 1, n))})
    at = {r: v for (_, r), (v, _, _) in order_statistics(rows, "p", {0: {"n": n, "ranks": ranks}}).items()}
    edges = [at[lo] + (at[min(lo + 1, n)] - at[lo]) * part for lo, part in plan]
    interior = F.array(*[F.lit(float(e)) for e in edges]) if edges else F.array().cast("array<double>")
    binned = rows.withColumn("_bin", F.size(F.filter(interior, lambda e: e < F.col("p"))))
    per = binned.groupBy("_bin").agg(F.count(F.lit(1)).alias("_n"), F.sum("p").alias("_sp"),
                                     F.sum("y").alias("_sy"))
    order = Window.orderBy("_bin")  # at most n_bins rows
    return per.select(
        F.row_number().over(order).cast("int").alias("bin"),
        F.bround(F.col("_sp") / F.col("_n"), MEAN_DECIMALS).alias("predicted_probability_mean"),
        (F.col("_sy").cast("double") / F.col("_n").cast("double")).alias("observed_positive_rate"),
    )


def lift_table(ev: DataFrame, n_bins: int = 10, keys=("source", "campaign_id", "target_id")) -> DataFrame:
    """E6 + W1 + W2: gains / lift by quantile bucket of the descending score rank.

    Bucket of rank r among n rows with q = min(n_bins, n): max(1, ceil((r-1) q / (n-1))) -- the
    quantile cut of ranks 1..n, computed exactly in integers (not ``ntile``, whose bucket sizes
    differ). Ties in the score are broken by the key columns.

    No row is sorted: the last row of each bucket is found by bracketing its rank in the order of
    (score, keys) (``quantiles.rows_at_ranks``), and a row's bucket is one plus the number of those
    rows that it stands after.
    """
    key_cols = [k for k in keys if k in ev.columns]
    rows = ev.select((-F.col("p").cast("double")).alias("_down"), F.col("p").cast("double").alias("p"),
                     F.coalesce(F.col("y").cast("int"), F.lit(0)).alias("y"),
                     *[key_order(k, ev.schema[k].dataType).alias(f"_k{i}") for i, k in enumerate(key_cols)]).where("p is not null")
    named = [f"_k{i}" for i in range(len(key_cols))]
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"),
                      *[(F.min(k) < F.max(k)).alias(k) for k in named]).first()
    n, total_pos = int(totals["n"]), int(totals["pos"] or 0)
    if n == 0:
        return ev.sparkSession.createDataFrame([], _LIFT_SCHEMA)
    q = min(n_bins, n)
    order = ["_down", *[k for k in named if totals[k]], "y"]  # a key that is the same everywhere decides nothing
    last = sorted({b * (n - 1) // q + 1 for b in range(1, q)})  # last rank of each bucket but the lowest
    ends = rows_at_ranks(rows, order, last, n)
    bucket, parted, alike, extra = F.lit(1), F.lit(True), set(), []
    for r in last:
        values, before, equal = ends[r]
        bucket = bucket + after(order, values).cast("int")
        if before + equal > r:  # rows alike in score, keys and label on both sides: parted by number
            parted = parted & ~reduce(lambda x, y: x & y, [F.col(c) == F.lit(v) for c, v in zip(order, values)])
            alike.add(ends[r])
    for values, before, equal in alike:
        edges = [0, *last, n]
        for b in range(1, len(edges)):
            held = min(edges[b], before + equal) - max(edges[b - 1], before)
            if held > 0:
                extra.append((b, held, held * int(values[-1]), -values[0], -values[0], -values[0] * held))
    sums = rows.where(parted).select("p", "y", bucket.alias("bucket")).groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.min("p").alias("lo"), F.max("p").alias("hi"), F.sum("p").alias("sp"))
    if extra:
        sums = sums.unionByName(ev.sparkSession.createDataFrame(
            extra, "bucket int, n long, pos long, lo double, hi double, sp double"))
    per = sums.groupBy("bucket").agg(
        F.sum("n").cast("bigint").alias("rows"), F.sum("pos").cast("bigint").alias("positives"),
        F.min("lo").alias("min_score"), F.max("hi").alias("max_score"),
        F.bround(F.sum("sp") / F.sum("n"), MEAN_DECIMALS).alias("avg_score"))
    overall = total_pos / n
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # <= n_bins rows
    rate = F.col("positives").cast("double") / F.col("rows").cast("double")
    out = per.select(
        "bucket", "rows", "positives", "min_score", "max_score", "avg_score",
        rate.alias("positive_rate"),
        (rate / F.lit(overall) if overall > 0 else F.lit(NAN)).alias("lift"),
        F.sum("rows").over(running).cast("bigint").alias("cumulative_rows"),
        F.sum("positives").over(running).cast("bigint").alias("cumulative_positives"),
    )
    capture = (F.col("cumulative_positives").cast("double") / F.lit(float(total_pos))
               if total_pos > 0 else F.lit(0.0))
    return out.withColumn("cumulative_positive_capture_rate", capture)


_LIFT_SCHEMA = ("bucket int, rows bigint, positives bigint, min_score double, max_score double, "
                "avg_score double, positive_rate double, lift double, cumulative_rows bigint, "
                "cumulative_positives bigint, cumulative_positive_capture_rate double")


def model_metrics(ev: DataFrame, model: str, threshold: float = 0.5,
                  materialize: bool = False) -> DataFrame:
    """One metrics row per model run (the content of a metrics artifact).

    The metrics read ``ev`` in three branches. ``materialize=True`` freezes the narrow (y, p)
    rows once with a reliable checkpoint, for scores that come from a fitted model, so the
    model's transform (tokenising, feature assembly, prediction) runs once, not per metric.
    """
    if materialize:
        ensure_checkpoint_dir(ev.sparkSession)
        ev = ev.select("y", "p").checkpoint(eager=True)
    m = classification_metrics(ev, threshold)
    auc = roc_auc(ev)
    brier = brier_score(ev)
    both = _one_row(m, auc, brier)
    return both.select(F.lit(model).alias("model"), "*")


def _one_row(*frames: DataFrame) -> DataFrame:
    """Put single-row frames side by side via a constant key (an equi-join, each side one row)."""
    keyed = [f.withColumn("_k", F.lit(1)) for f in frames]
    return reduce(lambda a, b: a.join(b, "_k", "inner"), keyed).drop("_k")


def stack_scores(rows: DataFrame, scores: dict[str, str], label: str = "clicked_flag",
                 keys=("source", "campaign_id", "target_id")) -> DataFrame:
    """The predictions of several models on the same rows, stacked: ``model, keys, y, p``."""
    each = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).cast("double").alias("p"))
                     for name, c in scores.items()])
    kept = [k for k in keys if k in rows.columns]
    return rows.select(*kept, F.col(label).cast("int").alias("y"), F.explode(each).alias("m")) \
        .select("m.model", *kept, "y", "m.p")


def compare_scores(rows: DataFrame, scores: dict[str, str], threshold: float = 0.5) -> DataFrame:
    """One metrics row per model. The stacked predictions are aggregated once to counts per
    (model, score, label); every metric follows from these."""
    ev = stack_scores(rows, scores, keys=())
    per = ev.groupBy("model", "p").agg(F.count_if(F.col("y") == 1).cast("bigint").alias("pos"),
                                       F.count_if(F.col("y") == 0).cast("bigint").alias("neg"))
    ranked = with_global_rank(per, ["model", "p"], sum_cols=["neg"])
    pred = F.col("p") >= threshold
    d = lambda c: F.col(c).cast("double")
    first = F.min(F.struct("_rank", (F.col("_cum_neg") - F.col("neg")).alias("below")))["below"]
    agg = ranked.groupBy("model").agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.when(pred, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(pred, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(d("pos") * (d("_cum_neg") - d("neg")) + 0.5 * d("pos") * d("neg")).alias("s"),
        first.alias("before"),
        F.sum(d("pos") * (F.col("p") - 1) ** 2 + d("neg") * F.col("p") ** 2).alias("sq"))
    n, tp, fp = F.col("P") + F.col("N"), F.col("tp"), F.col("fp")
    fn, tn = F.col("P") - tp, F.col("N") - fp
    area = (F.col("s") - d("P") * d("before")) / (d("P") * d("N"))  # negatives of earlier models off
    return agg.select(
        "model", n.alias("n_rows"), F.col("P").alias("positives"), _div(tp + tn, n).alias("accuracy"),
        _div(tp, tp + fp).alias("precision"), _div(tp, tp + fn).alias("recall"),
        _div(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.when((F.col("P") > 0) & (F.col("N") > 0), F.bround(area, 12)).alias("roc_auc"),
        F.bround(F.col("sq") / n, MEAN_DECIMALS).alias("brier_score"))


METRIC_DIRECTIONS = {"accuracy": True, "precision": True, "recall": True, "f1": True,
                     "roc_auc": True, "brier_score": False}


def metric_winners(comparison: DataFrame, a: str, b: str) -> DataFrame:
    """E9 + E10: per metric the better of two runs (Brier: lower wins), 'tie' when equal,
    null when a value is missing; plus whether the runs are comparable (same rows/positives)."""
    wide = comparison.where(F.col("model").isin(a, b))
    rows = []
    for metric, higher in METRIC_DIRECTIONS.items():
        va = F.max(F.when(F.col("model") == a, F.col(metric)))
        vb = F.max(F.when(F.col("model") == b, F.col(metric)))
        better_a = va > vb if higher else va < vb
        better_b = vb > va if higher else vb < va
        rows.append(F.struct(
            F.lit(metric).alias("metric"),
            va.cast("double").alias("value_a"), vb.cast("double").alias("value_b"),
            F.when(va.isNull() | vb.isNull(), F.lit(None).cast("string"))
            .when(better_a, F.lit(a)).when(better_b, F.lit(b)).otherwise(F.lit("tie")).alias("winner")))
    same = (F.max(F.when(F.col("model") == a, F.col("n_rows"))) == F.max(F.when(F.col("model") == b, F.col("n_rows")))) & \
           (F.max(F.when(F.col("model") == a, F.col("positives"))) == F.max(F.when(F.col("model") == b, F.col("positives"))))
    agg = wide.agg(F.array(*rows).alias("r"), same.alias("comparable"))
    return agg.select(F.explode("r").alias("x"), "comparable").select("x.*", "comparable")
