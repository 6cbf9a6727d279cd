"""Model training with Spark ML.

Features: the four signal flags plus one-hot demographics; label: ``clicked_flag``. The split is
a keyed hash (never ``randomSplit``), class weights come from one aggregate, and fitted
pipelines are Spark ML ``PipelineModel``s that persist with ``write().save``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.constants import DEMOGRAPHIC_COLUMNS, SIGNAL_COLUMNS, TARGET_COLUMN
from lureline.functions.expressions import keyed_uniform, sigmoid
from lureline.operators import gbt
from lureline.operators.quantiles import after, key_order, order_statistics, rows_at_ranks

KEYS = ("source", "campaign_id", "target_id")


def check_trainable(df: DataFrame, label: str = TARGET_COLUMN, min_rows: int = 10) -> tuple[int, int]:
    """M1: at least ``min_rows`` rows and two label classes, from one aggregate; else ValueError."""
    r = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("k")).first()
    if r["n"] < min_rows:
        raise ValueError(f"need at least {min_rows} rows, got {r['n']}")
    if r["k"] < 2:
        raise ValueError("need two label classes")
    return int(r["n"]), int(r["k"])


def stratified_split(df: DataFrame, label: str = TARGET_COLUMN, test_size: float = 0.3,
                     seed: int = 42, keys=KEYS, exact: bool = True) -> DataFrame:
    """M2: adds ``split`` = 'train' / 'test'.

    exact=True: per class, rows ordered by a keyed hash; the first round(test_size * n_class)
    are test (the class shares of the original split). The last test row of each class is found by
    bracketing its rank (``quantiles``) over the narrow columns (label, hash, keys): no row is
    sorted, shuffled or written, and a class may hold nearly all rows. Rows without a label are a
    class of their own; rows equal in hash and all keys fall on the same side.
    exact=False: per-row hash u < test_size -- one pass, for shares that need not be exact.
    """
    key_cols = [k for k in keys if k in df.columns]
    h = keyed_uniform(seed, *key_cols)
    if not exact:
        return df.withColumn("split", F.when(h < test_size, "test").otherwise("train"))
    narrow = df.select(F.col(label).alias("_label"), h.alias("_h"), *[F.col(k) for k in key_cols])
    counts = [(r["_label"], r["n"]) for r in narrow.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()]
    quota = {i: _round_half_even(test_size * n) for i, (_, n) in enumerate(counts)}
    of_class = [F.col("_label").eqNullSafe(F.lit(c)) for c, _ in counts]
    number = F.lit(None).cast("int")
    for i, match in enumerate(of_class):
        number = F.when(match, i).otherwise(number)
    found = order_statistics(narrow.select(number.alias("_class"), "_h"), "_h",
                             {i: {"n": counts[i][1], "ranks": [q] if q else []} for i, q in quota.items()}, "_class")
    test = F.lit(False)
    for i, (c, n) in enumerate(counts):
        mine = F.col(label).eqNullSafe(F.lit(c))
        if not quota[i]:
            continue
        value, less, equal = found[i, quota[i]]
        behind = F.col("_h") > F.lit(value)
        if less + equal > quota[i]:  # rows of equal hash on both sides: the keys decide
            order = ["_h", *[f"_k{j}" for j in range(len(key_cols))]]
            rows = narrow.where(of_class[i]).select("_h", *[
                key_order(k, df.schema[k].dataType).alias(f"_k{j}") for j, k in enumerate(key_cols)])
            values = rows_at_ranks(rows, order, [quota[i]], n)[quota[i]][0]
            behind = after([F.col("_h"), *[key_order(k, df.schema[k].dataType) for k in key_cols]], values)
        test = test | (mine & ~behind)
    return df.withColumn("_h", h).withColumn("split", F.when(test, "test").otherwise("train")).drop("_h")


def _round_half_even(x: float) -> int:
    return int(round(x))


def class_weights(train: DataFrame, label: str = TARGET_COLUMN) -> DataFrame:
    """M6: balanced weight n / (2 n_c) per class and scale_pos_weight = neg / pos (1.0 if no pos)."""
    per = train.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("n_class"))
    tot = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("pos"),
                    F.count_if(F.col(label) == 0).alias("neg")).first()
    spw = (tot["neg"] / tot["pos"]) if tot["pos"] else 1.0
    return per.select(
        F.col(label).cast("int").alias(label), "n_class",
        (F.lit(float(tot["n"])) / (F.lit(2.0) * F.col("n_class").cast("double"))).alias("weight"),
        F.lit(float(spw)).alias("scale_pos_weight"))


def with_weights(df: DataFrame, weights: DataFrame, label: str = TARGET_COLUMN) -> DataFrame:
    """Attach the class weight as ``weight`` (the weights table has one row per class)."""
    return df.join(F.broadcast(weights.select(label, "weight")), label, "left")


def impute_mode(train: DataFrame, df: DataFrame, columns) -> DataFrame:
    """M4: fill nulls with the most frequent training value (ties: smallest value)."""
    modes = train.agg(*[F.mode(c, deterministic=True).alias(c) for c in columns]).first()
    return df.fillna({c: modes[c] for c in columns if modes[c] is not None})


def feature_stages(scale: bool = False, prefix: str = "") -> tuple[list, str, list[str]]:
    """M3 (+M5): one-hot demographics with unseen -> all-zero vector; optional scaled signals.

    ``StringIndexer(handleInvalid='keep', stringOrderType='alphabetAsc')`` puts unseen values in
    the last index; the encoder treats that index as its last category, which ``dropLast`` drops,
    so every seen level keeps its column and an unseen one is the zero vector.
    """
    stages, names = [], []
    idx = [f"{prefix}{c}_idx" for c in DEMOGRAPHIC_COLUMNS]
    ohe = [f"{prefix}{c}_ohe" for c in DEMOGRAPHIC_COLUMNS]
    stages.append(StringIndexer(inputCols=list(DEMOGRAPHIC_COLUMNS), outputCols=idx,
                                handleInvalid="keep", stringOrderType="alphabetAsc"))
    stages.append(OneHotEncoder(inputCols=idx, outputCols=ohe, dropLast=True))
    sig_vec = f"{prefix}signals_vec"
    stages.append(VectorAssembler(inputCols=list(SIGNAL_COLUMNS), outputCol=sig_vec))
    signal_out = sig_vec
    if scale:
        signal_out = f"{prefix}signals_scaled"
        stages.append(StandardScaler(inputCol=sig_vec, outputCol=signal_out, withMean=True, withStd=True))
    features = f"{prefix}features"
    stages.append(VectorAssembler(inputCols=[signal_out, *ohe], outputCol=features))
    return stages, features, names


def _prepare(df: DataFrame) -> DataFrame:
    from lureline.operators.facts import clean_dataset
    out = clean_dataset(df)
    return out.select(*[F.col(c).cast("double").alias(c) if c in SIGNAL_COLUMNS else F.col(c) for c in out.columns])


def logistic_pipeline(n_train: int, scale: bool = False, max_iter: int = 2000) -> Pipeline:
    """M7: L2 logistic regression with C = 1 (regParam = 1 / n_train), balanced weights."""
    stages, features, _ = feature_stages(scale=scale)
    lr = LogisticRegression(featuresCol=features, labelCol=TARGET_COLUMN, weightCol="weight",
                            regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter)
    return Pipeline(stages=stages + [lr])


def tree_pipeline(seed: int = 42) -> Pipeline:
    """M8: decision tree, depth 4, at least 2 rows per leaf, balanced weights."""
    stages, features, _ = feature_stages()
    dt = DecisionTreeClassifier(featuresCol=features, labelCol=TARGET_COLUMN, weightCol="weight",
                                maxDepth=4, minInstancesPerNode=2, seed=seed)
    return Pipeline(stages=stages + [dt])


def gbt_pipeline(max_iter: int = 500, seed: int = 42) -> Pipeline:
    """M9: gradient-boosted trees: rate 0.05, depth 4, min rows per node 2, row and feature
    sampling 0.8 (Spark GBT has no leaf L1/L2 penalties)."""
    stages, features, _ = feature_stages()
    trees = GBTClassifier(featuresCol=features, labelCol=TARGET_COLUMN, weightCol="weight",
                          maxIter=max_iter, stepSize=0.05, maxDepth=4, minInstancesPerNode=2,
                          subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return Pipeline(stages=stages + [trees])


def fit(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    """Boosted trees are fitted from counts of equal rows (``gbt``), all else by the pipeline itself."""
    *before, last = pipeline.getStages()
    if isinstance(last, GBTClassifier):
        front = Pipeline(stages=before).fit(train)
        return PipelineModel([*front.stages, gbt.fit(last, front, train, [*SIGNAL_COLUMNS, *DEMOGRAPHIC_COLUMNS])])
    return without_summaries(pipeline.fit(train))


def without_summaries(model: PipelineModel) -> PipelineModel:
    """The fitted pipeline without training summaries. A summary holds the session, which cannot be
    serialised once any query of it was observed; the model that holds it would then fail to travel
    to a task."""
    for stage in model.stages:
        if getattr(stage, "hasSummary", False):
            jvm = SparkSession.active()._jvm
            stage._java_obj.setSummary(jvm.scala.Option.apply(None))
    return model


def feature_slots(model: PipelineModel) -> list[Column]:
    """The assembled feature vector of :func:`feature_stages` as plain columns, slot by slot."""
    by_kind = {type(stage).__name__: stage for stage in model.stages}
    signals = [F.col(c).cast("double") for c in SIGNAL_COLUMNS]
    scaler = by_kind.get("StandardScalerModel")
    if scaler is not None:
        signals = [(x - float(m)) / float(s) if s else F.lit(0.0)
                   for x, m, s in zip(signals, scaler.mean.toArray(), scaler.std.toArray())]
    indexer = by_kind["StringIndexerModel"]
    levels = [F.when(F.col(c) == level, 1.0).otherwise(0.0)
              for c, labels in zip(indexer.getInputCols(), indexer.labelsArray) for level in labels]
    return [*signals, *levels]


def _tree_value(node, slots: list[Column], leaf) -> Column:
    """A fitted tree as nested CASE expressions."""
    kind = node.getClass().getSimpleName()
    if kind == "LeafNode":
        return F.lit(float(leaf(node)))
    split, x = node.split(), slots[node.split().featureIndex()]
    if split.getClass().getSimpleName() == "ContinuousSplit":
        goes_left = x <= float(split.threshold())
    else:
        goes_left = x.isin([float(v) for v in split.leftCategories()])
    return F.when(goes_left, _tree_value(node.leftChild(), slots, leaf)).otherwise(
        _tree_value(node.rightChild(), slots, leaf))


def probability(model: PipelineModel) -> Column:
    """P(label = 1) of a fitted linear or single-tree pipeline as one expression of built-in functions."""
    last, slots = model.stages[-1], feature_slots(model)
    if hasattr(last, "coefficients"):
        z = F.lit(float(last.intercept))
        for coefficient, x in zip(last.coefficients.toArray(), slots):
            z = z + float(coefficient) * x
        return sigmoid(z)

    def share(node):
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats[:2]) if sum(stats[:2]) else 0.0
    return _tree_value(last._java_obj.rootNode(), slots, share)


def _lenient(model: PipelineModel) -> PipelineModel:
    """The pipeline with null signals taken as NaN, which goes right at every split, as a null does in a
    CASE of :func:`probability`."""
    return PipelineModel([stage.copy({stage.handleInvalid: "keep"}) if isinstance(stage, VectorAssembler) else stage
                          for stage in model.stages])


def score(model: PipelineModel, df: DataFrame, context=("source", "campaign_id", "target_id", "template_id",
                                                        "segment_id")) -> DataFrame:
    """M11 + P12: class and positive-class probability per row, with the context columns present.

    The fitted pipeline becomes one expression over the raw columns: no vectors, no object
    functions, so the scan, the scoring and what follows are one generated stage. Hundreds of
    boosted trees are too deep and too long for one expression; there the model itself, which goes
    to the tasks as one broadcast, scores the distinct rows of the features, and each row takes its
    probability from there.
    """
    ctx = [c for c in context if c in df.columns]
    if hasattr(model.stages[-1], "treeWeights"):
        used = [*SIGNAL_COLUMNS, *DEMOGRAPHIC_COLUMNS]
        rows = df.select(*dict.fromkeys([*ctx, TARGET_COLUMN, *DEMOGRAPHIC_COLUMNS]),
                         *[F.col(c).cast("double").alias(c) for c in SIGNAL_COLUMNS])
        scored = _lenient(model).transform(rows.select(*used).distinct()).select(
            *[F.col(c).alias(f"_{c}") for c in used], vector_to_array("probability")[1].alias("_p"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in used]
        df, p = rows.join(scored, reduce(and_, same)), F.col("_p")
    else:
        p = probability(model)
    out = df.select(*ctx, F.col(TARGET_COLUMN).cast("int").alias("y"), p.alias("p"))
    return out.select(*ctx, "y", (F.col("p") > 0.5).cast("int").alias("predicted_class"), "p")


def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the assembled feature slots, read from the vector's ML attribute metadata."""
    out = model.transform(df.limit(1))
    features = model.stages[-1].getFeaturesCol()
    meta = out.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    slots = []
    for kind in meta.values():
        slots.extend((a["idx"], a["name"]) for a in kind)
    return [name for _, name in sorted(slots)]


def model_terms(model: PipelineModel, df: DataFrame, top_k: int | None = None) -> DataFrame:
    """M10 + K2: coefficients (|coef| descending) or importances (descending) by feature name."""
    spark = df.sparkSession
    names = feature_names(model, df)
    last = model.stages[-1]
    if hasattr(last, "coefficients"):
        values = list(last.coefficients.toArray())
        rows = [(n, float(v), abs(float(v))) for n, v in zip(names, values)]
        terms = spark.createDataFrame(rows, "feature string, value double, magnitude double")
    else:
        values = list(last.featureImportances.toArray())
        rows = [(n, float(v), float(v)) for n, v in zip(names, values)]
        terms = spark.createDataFrame(rows, "feature string, value double, magnitude double")
    ordered = terms.orderBy(F.col("magnitude").desc(), F.col("feature"))
    return ordered.limit(top_k) if top_k else ordered


def save(model: PipelineModel, path: str) -> None:
    """Persist the fitted pipeline (``errorifexists`` semantics: a run never overwrites)."""
    model.write().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
