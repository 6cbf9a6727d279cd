"""Spark ML's ``GBTClassifier`` fitted from counts of equal rows (M9).

Spark grows every level of every tree by a job over all rows: 500 trees are some 2,500 passes. The rows
of a fit on flags and levels are few distinct ones, and the statistics of a node are sums over rows, so
this fit counts the rows of each distinct (features, label, weight) that each tree draws
(``draws.sampled_counts``, one pass) and grows the same trees from the counts: same row and feature draws,
splits, minimum node size, pruning and learning rate as ``ml.tree.impl.GradientBoostedTrees``. Only the
order of floating sums differs, by which Spark decides between splits of equal gain; here gains are
compared to twelve digits of the node's impurity and the feature drawn first wins a tie. Split points lie
between all values seen (Spark looks at some 10,000 rows for them).

What the counts do not cover is fitted by Spark itself: more distinct rows than memory holds, numbers with
more values than bins, levels that are not one-hot, other losses, labels or weights that Spark rejects.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lureline.operators import draws

EPSILON = 2.0 ** -52  # Spark's Utils.EPSILON: children of less impurity are not split


@dataclass
class Node:
    stats: np.ndarray  # weight, weight * label, weight * label^2, rows
    impurity: float
    gain: float | None = None  # of an inner node
    feature: int = -1
    left_bins: frozenset = frozenset()
    left: "Node | None" = None
    right: "Node | None" = None

    @property
    def prediction(self) -> float:
        return self.stats[1] / self.stats[0] if self.stats[0] else 0.0


class JavaRandom:
    """``java.util.Random.nextLong``."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & (2 ** 48 - 1)

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & (2 ** 48 - 1)
        bits = self.state >> 16
        return bits - 2 ** 32 if bits >= 2 ** 31 else bits

    def long(self) -> int:
        return ((self._next() << 32) + self._next()) & (2 ** 64 - 1)


def reservoir(size: int, keep: int, seed: int) -> list[int]:
    """``SamplingUtils.reservoirSampleAndCount`` of 0..size-1."""
    kept, uniform = list(range(keep)), draws.uniform_from(seed)
    for item in range(keep, size):
        at = int(next(uniform) * (item + 1))
        if at < keep:
            kept[at] = item
    return kept


def variance(stats: np.ndarray) -> float:
    w, wy, wyy = float(stats[0]), float(stats[1]), float(stats[2])
    return (wyy - wy * wy / w) / w if w else 0.0


def per_node(strategy: str, size: int) -> int | None:
    """Features that a node may split on; None for the strategies by name, which Spark reads."""
    if strategy == "all":
        return size
    if strategy.isdigit() and int(strategy) > 0:
        return min(int(strategy), size)
    try:
        share = float(strategy)
    except ValueError:
        return None
    return math.ceil(share * size) if 0.0 < share <= 1.0 else None


class Grower:
    """Trees over cells: ``bins`` (cell, feature) from 0; ``binary`` names the one-hot features."""

    def __init__(self, bins: np.ndarray, binary: set[int], keep: int, depth: int, least: int, least_gain: float):
        self.bins, self.binary, self.keep, self.depth, self.least, self.least_gain = bins, binary, keep, depth, least, least_gain
        self.sizes = [2 if f in binary else int(bins[:, f].max()) + 1 for f in range(bins.shape[1])]
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(int)
        self.hot = np.zeros((len(bins), self.first[-1]))
        self.hot[np.arange(len(bins))[:, None], bins + self.first[:-1]] = 1.0

    def best(self, node: Node, stats: np.ndarray, allowed: list[int]):
        """``(feature, left bins, gain, left stats, right stats)`` of the split of greatest gain, or None."""
        found, at = None, 0.0
        for f in allowed:
            size = self.sizes[f]
            if size < 2:
                continue
            part = stats[self.first[f]:self.first[f] + size]
            order = list(range(size))
            if f in self.binary:  # the level of lower mean is on the left, an empty one on the right
                mean = [p[1] / p[0] if p[0] else math.inf for p in part]
                order = [0, 1] if mean[0] <= mean[1] else [1, 0]
            left = np.zeros(4)
            for i in range(size - 1):
                left = left + part[order[i]]
                right = node.stats - left
                if left[3] < self.least or right[3] < self.least:
                    continue
                total = left[0] + right[0]
                gain = node.impurity - left[0] / total * variance(left) - right[0] / total * variance(right)
                rounded = round(gain / node.impurity, 12) if node.impurity else 0.0
                if gain >= self.least_gain and rounded > at:
                    found, at = (f, frozenset(order[:i + 1]), gain, left, right), rounded
        return found

    def grow(self, label: np.ndarray, weight: np.ndarray, rows: np.ndarray, seed: int) -> tuple[Node, np.ndarray]:
        """One regression tree on ``rows`` drawn rows per cell; and its prediction for every cell."""
        w = weight * rows
        each = np.stack([w, w * label, w * label * label, rows.astype(float)], axis=1)
        total = each.sum(axis=0)
        root = Node(total, variance(total))
        random, value = JavaRandom(seed), np.zeros(len(label))
        level, cells = [root], {id(root): np.arange(len(label))}
        leaves = []
        for depth in range(self.depth + 1):
            following = []
            for node in level:
                own = cells.pop(id(node))
                split = None
                if depth < self.depth and (depth == 0 or abs(node.impurity) >= EPSILON):
                    size = self.bins.shape[1]
                    allowed = reservoir(size, self.keep, random.long()) if self.keep < size else list(range(size))
                    split = self.best(node, self.hot[own].T @ each[own], allowed)
                if split is None:
                    leaves.append((node, own))
                    continue
                node.feature, node.left_bins, node.gain, left, right = split
                node.left, node.right = Node(left, variance(left)), Node(right, variance(right))
                goes_left = np.isin(self.bins[own, node.feature], list(node.left_bins))
                cells[id(node.left)], cells[id(node.right)] = own[goes_left], own[~goes_left]
                following = [node.right, node.left] + following  # Spark's stack: the last one first
            level = following
        for node, own in leaves:
            value[own] = node.prediction
        return pruned(root), value


def pruned(node: Node) -> Node:
    """Inner nodes whose children predict the same are leaves."""
    if node.left is None:
        return node
    node.left, node.right = pruned(node.left), pruned(node.right)
    if node.left.left is None and node.right.left is None and node.left.prediction == node.right.prediction:
        node.left = node.right = node.gain = None
    return node


def binary_slots(data: DataFrame, column: str) -> tuple[int, set[int]] | None:
    """Number of the assembled features and those that are one-hot, from the vector's attributes; None where
    there are other levels or no attributes."""
    meta = data.schema[column].metadata.get("ml_attr", {})
    attrs = meta.get("attrs", {})
    size = meta.get("num_attrs", sum(len(a) for a in attrs.values()))
    if not size or attrs.get("nominal"):
        return None
    return size, {a["idx"] for a in attrs.get("binary", [])}


def fit(gbt: GBTClassifier, front: PipelineModel, train: DataFrame, columns: list[str]) -> GBTClassificationModel:
    """``gbt.fit(front.transform(train))``; ``front`` makes the feature vector of ``columns``, row by row."""
    data = front.transform(train)
    slots = binary_slots(data, gbt.getFeaturesCol())
    label, weight = gbt.getLabelCol(), gbt.getWeightCol() if gbt.isSet("weightCol") else None
    keep = per_node(gbt.getFeatureSubsetStrategy(), slots[0]) if slots else None
    plain = gbt.getLossType() == "logistic" and gbt.getImpurity() == "variance" and not gbt.isSet("validationIndicatorCol") \
        and gbt.getMinWeightFractionPerNode() == 0.0 and not gbt.isSet("thresholds")
    rounds = gbt.getMaxIter()
    key = [*columns, "_label", "_weight"]
    rows = train.select(*columns, F.col(label).cast("double").alias("_label"),
                       (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_weight"))
    if keep is None or not plain or not draws.fits_in_memory(rows, key, rounds):
        return gbt.fit(data)
    drawn = draws.BaggedDraws(gbt.getSeed(), gbt.getSubsamplingRate(), rounds)
    counted = draws.sampled_counts(rows, key, drawn).toArrow()
    y, w = (np.array(counted.column(c).to_pylist(), float) for c in ("_label", "_weight"))
    fine = len(y) and np.isin(y, (0.0, 1.0)).all() and (w >= 0).all() and np.isfinite(w).all()
    if not fine:
        return gbt.fit(data)
    cells = train.sparkSession.createDataFrame(counted.select(columns).append_column("_at", pa.array(range(len(y)), pa.int64())))
    found = front.transform(cells).select("_at", vector_to_array(gbt.getFeaturesCol()).alias("_x")).orderBy("_at")
    x = np.array(found.toArrow().column("_x").to_pylist())
    values = [np.unique(x[:, f]) for f in range(x.shape[1])]
    if not np.isfinite(x).all() or any(len(v) > gbt.getMaxBins() for f, v in enumerate(values) if f not in slots[1]) \
            or any(not np.isin(values[f], (0.0, 1.0)).all() for f in slots[1]):
        return gbt.fit(data)
    counts = counted.column("drawn").combine_chunks().flatten().to_numpy().reshape(-1, rounds)
    order = np.lexsort((w, y, *x.T))  # cells in a given order: so are the sums
    x, y, w, counts = x[order], y[order], w[order], counts[order]
    bins = np.stack([x[:, f].astype(int) if f in slots[1] else np.searchsorted(v, x[:, f]) for f, v in enumerate(values)], axis=1)
    grower = Grower(bins, slots[1], keep, gbt.getMaxDepth(), gbt.getMinInstancesPerNode(), gbt.getMinInfoGain())
    trees, margin, sign = [], None, 2.0 * y - 1.0
    for t in range(rounds):
        target = sign if t == 0 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
        tree, value = grower.grow(target, w, counts[:, t], gbt.getSeed() + t)
        margin = value if t == 0 else margin + gbt.getStepSize() * value
        trees.append(tree)
    cuts = [None if f in slots[1] else [(a + b) / 2.0 for a, b in zip(v, v[1:])] for f, v in enumerate(values)]
    return spark_model(gbt, trees, cuts, data.sparkSession)


def spark_model(gbt: GBTClassifier, trees: list[Node], cuts: list[list[float] | None], spark) -> GBTClassificationModel:
    """The trees as Spark's own model, with the parameters of the estimator."""
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    tree = jvm.org.apache.spark.ml.tree
    estimator = gbt._java_obj
    gbt._transfer_params_to_java()
    calculator = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
    kinds: dict = {}

    def doubles(values):
        out = gateway.new_array(jvm.double, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return out

    def split(node: Node):
        at = node.feature, node.left_bins
        if at not in kinds:
            kinds[at] = tree.CategoricalSplit(node.feature, doubles(sorted(node.left_bins)), 2) if cuts[node.feature] is None \
                else tree.ContinuousSplit(node.feature, float(cuts[node.feature][max(node.left_bins)]))
        return kinds[at]

    every: list[Node] = []

    def walk(node):
        every.append(node)
        if node.left is not None:
            walk(node.left)
            walk(node.right)
    for root in trees:
        walk(root)
    # all statistics go over at once
    packed = bytearray(np.array([n.stats[:3] for n in every], ">f8").tobytes())
    buffer, numbers = jvm.java.nio.ByteBuffer.wrap(packed).asDoubleBuffer(), gateway.new_array(jvm.double, 3 * len(every))
    buffer.get(numbers)
    where = {id(n): 3 * i for i, n in enumerate(every)}
    copy = jvm.java.util.Arrays.copyOfRange

    def made(node: Node):
        stats = calculator(copy(numbers, where[id(node)], where[id(node)] + 3), int(node.stats[3]))
        if node.left is None:
            return tree.LeafNode(float(node.prediction), float(node.impurity), stats)
        return tree.InternalNode(float(node.prediction), float(node.impurity), float(node.gain), made(node.left),
                                 made(node.right), split(node), stats)

    size = len(cuts)
    kind = jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    array, weights = gateway.new_array(kind, len(trees)), gateway.new_array(jvm.double, len(trees))
    for i, root in enumerate(trees):
        array[i] = kind(f"{gbt.uid}_{i}", made(root), size)
        weights[i] = 1.0 if i == 0 else gbt.getStepSize()
    model = jvm.org.apache.spark.ml.classification.GBTClassificationModel(gbt.uid, array, weights, size, 2)
    estimator.copyValues(model, jvm.org.apache.spark.ml.param.ParamMap())
    return gbt._copyValues(GBTClassificationModel(model))
