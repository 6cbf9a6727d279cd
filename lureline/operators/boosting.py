"""Regularised second-order boosted trees (M9) as Spark aggregates.

Every feature is a small bin number: a 0/1 indicator per categorical level, or the position of a
number among its cut points. Rows with equal bins share every margin, so the table that the rounds
work on has one row per distinct combination of bins (a *cell*) with the sampled positives and
negatives of each tree. Where the cells of all trees fit in memory they are counted from the rows in one
pass (``draws``) and the trees are grown on the driver; else they are counted once per ``block`` of
trees and a level of a tree is one job. Either way:

* a CASE over the tree so far gives each cell's node, its margin the gradient and hessian
  ``g = w * (p - y)``, ``h = w * p * (1 - p)`` (``w`` is ``scale_pos_weight`` for positives);
* the cells' features are exploded and summed per (node, feature, bin), map-side first, so the
  driver gets at most ``nodes x features x bins`` rows;
* every node takes the split of greatest gain ``s(GL,HL) + s(GR,HR) - s(G,H)`` with
  ``s(G,H) = T(G)^2 / (H + lambda)`` and ``T`` shrinking G by alpha towards zero; both children need
  a hessian of ``min_child_weight``. Gains are compared to nine digits, ties go to the feature named
  first and the lower bin, so the order of floating sums does not choose.

A leaf adds ``-rate * T(G) / (H + lambda)``. Rows (per tree, by a keyed hash of the row's keys) and
features (per tree, by a keyed hash of the name) are sampled, so a fit does not depend on
partitioning. Scoring walks the trees once per distinct combination of bins in a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lureline.functions.expressions import keyed_uniform, sigmoid
from lureline.operators import draws
from lureline.session import ensure_checkpoint_dir

EPS = 1e-6  # least gain of a split
KNOWN = 100_000  # combinations of bins whose margin a scoring task keeps


@dataclass(frozen=True)
class BoostParams:
    rounds: int = 500
    rate: float = 0.05
    depth: int = 4
    min_child_weight: float = 2.0
    row_share: float = 0.8
    column_share: float = 0.8
    alpha: float = 0.5
    lam: float = 2.0
    seed: int = 42
    max_bins: int = 32
    max_levels: int = 1000
    block: int = 20


@dataclass(frozen=True)
class Feature:
    """``level`` given: indicator of that level of ``column``; else a number cut at ``cuts``."""
    column: str
    level: str | None = None
    cuts: tuple[float, ...] = ()

    @property
    def name(self) -> str:
        return self.column if self.level is None else f"{self.column}={self.level}"

    def bin(self) -> Column:
        """Bin number of a row; an unseen or null level is 0 everywhere, a null number is in bin 0."""
        if self.level is not None:
            return F.coalesce((F.col(self.column).cast("string") == self.level).cast("int"), F.lit(0))
        value = F.col(self.column).cast("double")
        above = [F.when(value > c, 1).otherwise(0) for c in self.cuts]
        return sum(above[1:], above[0]) if above else F.lit(0)


@dataclass
class Tree:
    """Nodes by heap number (children of k: 2k+1, 2k+2)."""
    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)  # node: feature, last bin on the left, gain
    leaves: dict[int, float] = field(default_factory=dict)

    def walk(self, bins: list[Column], at_leaf, node: int = 0) -> Column:
        if node not in self.splits:
            return at_leaf(node)
        feature, last, _ = self.splits[node]
        return F.when(bins[feature] <= last, self.walk(bins, at_leaf, 2 * node + 1)).otherwise(
            self.walk(bins, at_leaf, 2 * node + 2))

    def value(self, bins: list[Column]) -> Column:
        return self.walk(bins, lambda k: F.lit(self.leaves.get(k, 0.0)))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row of ``bins`` (row, feature)."""
        node = np.zeros(len(bins), np.int64)
        for k in sorted(self.splits):  # parents first
            feature, last, _ = self.splits[k]
            at = np.flatnonzero(node == k)
            node[at] = np.where(bins[at, feature] <= last, 2 * k + 1, 2 * k + 2)
        return node

    def values(self, bins: np.ndarray) -> np.ndarray:
        found, at = np.unique(self.places(bins), return_inverse=True)
        return np.array([self.leaves.get(int(k), 0.0) for k in found])[at]


def find_features(df: DataFrame, numbers, levels, params: BoostParams = BoostParams()) -> list[Feature]:
    """Cut points of the number columns and the levels of the categorical ones, as seen in ``df``."""
    out = []
    if numbers:
        at = [k / params.max_bins for k in range(1, params.max_bins)]
        cuts = df.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(c) for c in numbers],
                      *[F.max(F.col(c).cast("double")).alias(f"max_{c}") for c in numbers]).first()
        for c in numbers:
            seen = sorted({v for v in cuts[c] or () if v is not None and v < cuts[f"max_{c}"]})
            out.append(Feature(c, cuts=tuple(seen)))
    for c in levels:
        found = df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct() \
            .orderBy("v").limit(params.max_levels + 1).collect()
        if len(found) > params.max_levels:
            raise ValueError(f"{c} has more than {params.max_levels} levels")
        out.extend(Feature(c, r.v) for r in found)
    return out


def sampled_features(features: list[Feature], tree: int, params: BoostParams) -> list[int]:
    """The share of features that a tree may split on: those of least keyed hash."""
    def draw(name):
        return hashlib.md5(f"{params.seed}-columns-{tree}|{name}".encode()).hexdigest()
    keep = max(1, math.floor(params.column_share * len(features)))
    return sorted(sorted(range(len(features)), key=lambda i: (draw(features[i].name), i))[:keep])


def in_sample(tree: int, keys, params: BoostParams) -> Column:
    return keyed_uniform(f"{params.seed}-rows-{tree}", *keys) < params.row_share


def soft(g: float, alpha: float) -> float:
    return math.copysign(max(0.0, abs(g) - alpha), g)


def strength(g: float, h: float, params: BoostParams) -> float:
    return soft(g, params.alpha) ** 2 / (h + params.lam)


def best_split(histogram: dict[int, list[tuple[int, float, float]]], params: BoostParams):
    """``(feature, last bin on the left, gain)`` from feature -> (bin, g, h) in order, or None."""
    best = None
    for feature in sorted(histogram):
        bins = sorted(histogram[feature])
        total_g, total_h = sum(b[1] for b in bins), sum(b[2] for b in bins)
        g = h = 0.0
        for number, bin_g, bin_h in bins[:-1]:
            g, h = g + bin_g, h + bin_h
            if h < params.min_child_weight or total_h - h < params.min_child_weight:
                continue
            gain = strength(g, h, params) + strength(total_g - g, total_h - h, params) - strength(total_g, total_h, params)
            gain = float(f"{gain:.9g}")
            if gain > EPS and (best is None or gain > best[2]):
                best = (feature, number, gain)
    return best


def histograms(cells: DataFrame, tree: Tree, nodes: list[int], margin: Column, scale: float, chosen: list[int],
               features: list[Feature], pos: str, neg: str) -> DataFrame:
    """``node, feature, bin, n, g, h`` of the given nodes: one row per non-empty bin."""
    bins = [F.col(f"f{i}") for i in range(len(features))]
    node = tree.walk(bins, lambda k: F.lit(k))
    p = sigmoid(margin)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), bins[i].alias("bin")) for i in chosen]))
    weight = F.col(pos) * scale + F.col(neg)
    rows = cells.where((F.col(pos) + F.col(neg)) > 0).select(
        node.alias("node"), (F.col(pos) + F.col(neg)).alias("n"),
        (F.col(pos) * scale * (p - 1.0) + F.col(neg) * p).alias("g"), (weight * p * (1.0 - p)).alias("h"), *bins)
    return rows.where(F.col("node").isin(nodes)).select("node", "n", "g", "h", each.alias("_e")) \
        .groupBy("node", F.col("_e.feature").alias("feature"), F.col("_e.bin").alias("bin")) \
        .agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"))


def grow(read, params: BoostParams) -> Tree:
    """One tree, level by level; ``read(tree, nodes)`` gives ``(node, feature, bin, g, h)`` of the nodes'
    non-empty bins."""
    tree, open_nodes = Tree(), [0]
    for level in range(params.depth + 1):
        found: dict[int, dict[int, list]] = {k: {} for k in open_nodes}
        for node, feature, number, g, h in read(tree, open_nodes):
            found[node].setdefault(feature, []).append((number, g, h))
        following = []
        for node in open_nodes:
            if not found[node]:
                continue
            split = best_split(found[node], params) if level < params.depth else None
            if split is None:
                some = next(iter(found[node].values()))  # every feature sums to the node's totals
                g, h = sum(b[1] for b in some), sum(b[2] for b in some)
                tree.leaves[node] = -params.rate * soft(g, params.alpha) / (h + params.lam)
            else:
                tree.splits[node] = split
                following += [2 * node + 1, 2 * node + 2]
        open_nodes = following
        if not open_nodes:
            break
    return tree


def bin_columns(features: list[Feature]) -> list[Column]:
    return [f.bin().cast("tinyint").alias(f"f{i}") for i, f in enumerate(features)]


def count_cells(df: DataFrame, features: list[Feature], label: str, trees: range, keys, params: BoostParams) -> DataFrame:
    """``f0.., pos_t, neg_t`` per combination of bins: sampled rows of each tree in ``trees``."""
    rows = df.where(F.col(label).isNotNull()).select(
        *bin_columns(features), (F.col(label) == 1).alias("_y"), *[in_sample(t, keys, params).alias(f"_s{t}") for t in trees])
    return rows.groupBy(*[f"f{i}" for i in range(len(features))]).agg(
        *[F.count_if(F.col("_y") & F.col(f"_s{t}")).alias(f"pos_{t}") for t in trees],
        *[F.count_if(~F.col("_y") & F.col(f"_s{t}")).alias(f"neg_{t}") for t in trees])


class BoostedTrees:
    """A fitted model: features and trees (small, on the driver)."""

    def __init__(self, features: list[Feature], trees: list[Tree], scale_pos_weight: float):
        self.features, self.trees, self.scale_pos_weight = features, trees, scale_pos_weight

    def score(self, df: DataFrame, label: str = "clicked_flag", context=(
            "source", "campaign_id", "target_id", "template_id", "segment_id")) -> DataFrame:
        """Class and positive-class probability per row, with the context columns present."""
        kept = [c for c in context if c in df.columns]
        bins = F.struct(*[f.bin().cast("int").alias(f"f{i}") for i, f in enumerate(self.features)])
        binned = df.select(*kept, F.col(label).cast("int").alias("y"), self.margin(bins).alias("_m"))
        return binned.select(*kept, "y", sigmoid(F.col("_m")).alias("p")).select(
            *kept, "y", (F.col("p") >= 0.5).cast("int").alias("predicted_class"), "p")

    def margin(self, bins: Column) -> Column:
        """The sum of the trees' values for a struct of bins (hundreds of trees are too deep for an expression)."""
        trees = self.trees

        @F.pandas_udf("double")
        def margins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            known: dict[bytes, float] = {}
            for batch in batches:
                rows, at = np.unique(batch.to_numpy(np.int32), axis=0, return_inverse=True)
                if len(known) > KNOWN:
                    known.clear()
                new = [r for r in rows if r.tobytes() not in known]
                if new:
                    found = np.stack(new)
                    total = sum((tree.values(found) for tree in trees), np.zeros(len(new)))
                    known.update((r.tobytes(), m) for r, m in zip(new, total))
                yield pd.Series(np.array([known[r.tobytes()] for r in rows])[at])
        return margins(bins)

    def importances(self, spark: SparkSession) -> DataFrame:
        """Total gain per feature."""
        gain = [0.0] * len(self.features)
        for tree in self.trees:
            for feature, _, g in tree.splits.values():
                gain[feature] += g
        rows = [(f.name, g, g) for f, g in zip(self.features, gain)]
        return spark.createDataFrame(rows, "feature string, value double, magnitude double") \
            .orderBy(F.col("magnitude").desc(), "feature")

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table (one row per node; tree -1 lists the features), for any sink."""
        rows = [(-1, i, None, None, None, None, f.column, f.level, list(f.cuts)) for i, f in enumerate(self.features)]
        for t, tree in enumerate(self.trees):
            rows += [(t, k, s[0], s[1], s[2], None, None, None, None) for k, s in tree.splits.items()]
            rows += [(t, k, None, None, None, v, None, None, None) for k, v in tree.leaves.items()]
        rows.append((-2, 0, None, None, None, self.scale_pos_weight, None, None, None))
        return spark.createDataFrame(rows, "tree int, node int, feature int, bin int, gain double, value double, "
                                           "column string, level string, cuts array<double>")

    @classmethod
    def from_nodes(cls, table: DataFrame) -> "BoostedTrees":
        rows = sorted(table.collect(), key=lambda r: (r.tree, r.node))  # a model: nodes x trees rows
        features = [Feature(r.column, r.level, tuple(r.cuts)) for r in rows if r.tree == -1]
        trees = [Tree() for _ in range(1 + max((r.tree for r in rows), default=-1))]
        for r in rows:
            if r.tree >= 0 and r.feature is not None:
                trees[r.tree].splits[r.node] = (r.feature, r.bin, r.gain)
            elif r.tree >= 0:
                trees[r.tree].leaves[r.node] = r.value
        return cls(features, trees, next(r.value for r in rows if r.tree == -2))


def scale_pos_weight(train: DataFrame, label: str = "clicked_flag") -> float:
    """Negatives per positive (1 where there is no positive)."""
    r = train.agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")).first()
    return r.neg / r.pos if r.pos else 1.0


def fit(train: DataFrame, numbers, levels, label: str = "clicked_flag",
        keys=("source", "campaign_id", "target_id"), params: BoostParams = BoostParams(),
        scale: float | None = None) -> BoostedTrees:
    """Boost ``params.rounds`` trees on ``train``; rows without a label are left out."""
    ensure_checkpoint_dir(train.sparkSession)
    features = find_features(train, numbers, levels, params)
    if not features:
        raise ValueError("no features")
    scale = scale_pos_weight(train, label) if scale is None else scale
    names = [f"f{i}" for i in range(len(features))]
    rows = train.where(F.col(label).isNotNull()).select(
        *bin_columns(features), (F.col(label) == 1).alias("_y"), draws.KeyedDraws.text(keys).alias("_text"))
    if draws.fits_in_memory(rows, [*names, "_y"], params.rounds):
        return BoostedTrees(features, _fit_in_memory(rows, features, scale, params), scale)
    bins = [F.col(n) for n in names]
    trees: list[Tree] = []
    margins = None
    for first in range(0, params.rounds, params.block):
        block = range(first, min(first + params.block, params.rounds))
        cells = count_cells(train, features, label, block, keys, params)
        cells = cells.withColumn("margin", F.lit(0.0)) if margins is None else cells.join(margins, names)
        cells = cells.checkpoint(eager=True)
        margin = F.col("margin")
        for t in block:
            chosen = sampled_features(features, t, params)

            def read(tree, nodes):
                found = histograms(cells, tree, nodes, margin, scale, chosen, features, f"pos_{t}", f"neg_{t}")
                return [(r.node, r.feature, r.bin, r.g, r.h) for r in found.collect()]
            tree = grow(read, params)
            trees.append(tree)
            margin = margin + tree.value(bins)
        margins = cells.select(*names, margin.alias("margin"))
    return BoostedTrees(features, trees, scale)


def _fit_in_memory(rows: DataFrame, features: list[Feature], scale: float, params: BoostParams) -> list[Tree]:
    """The trees from the counts of all of them at once; ``rows`` have bins, ``_y`` and ``_text``."""
    names = [f"f{i}" for i in range(len(features))]
    keyed = draws.KeyedDraws(params.seed, params.row_share, params.rounds)
    # the draws go by the keys, so the rows may be dealt out: they cost far more than their reading
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = draws.sampled_counts(dealt, [*names, "_y"], keyed, "_text").toArrow()
    found = np.stack([table.column(n).to_numpy() for n in names], axis=1).astype(np.int64)
    bins, cell = np.unique(found, axis=0, return_inverse=True)  # in order, so the order of the sums is given
    counts = table.column("drawn").combine_chunks().flatten().to_numpy().reshape(-1, params.rounds)
    clicked = np.array(table.column("_y").to_pylist(), bool)
    pos, neg = (np.zeros((len(bins), params.rounds), np.int64) for _ in range(2))
    pos[cell[clicked]], neg[cell[~clicked]] = counts[clicked], counts[~clicked]
    sizes = bins.max(axis=0, initial=0) + 1
    margin, trees = np.zeros(len(bins)), []
    for t in range(params.rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        inside = np.flatnonzero(pos[:, t] + neg[:, t])
        n_pos, n_neg, q = pos[inside, t], neg[inside, t], p[inside]
        g = n_pos * scale * (q - 1.0) + n_neg * q
        h = (n_pos * scale + n_neg) * q * (1.0 - q)
        chosen = sampled_features(features, t, params)

        def read(tree, nodes):
            place = tree.places(bins[inside])
            for node in nodes:
                own = np.flatnonzero(place == node)
                for f in chosen if len(own) else ():
                    number = bins[inside[own], f]
                    some = np.bincount(number, minlength=sizes[f])
                    sums = [np.bincount(number, weights=x[own]) for x in (g, h)]
                    yield from ((node, f, int(b), float(sums[0][b]), float(sums[1][b])) for b in np.flatnonzero(some))
        tree = grow(read, params)
        trees.append(tree)
        margin = margin + tree.values(bins)
    return trees


def root_histogram(train: DataFrame, numbers, levels, label: str = "clicked_flag",
                   keys=("source", "campaign_id", "target_id"), params: BoostParams = BoostParams()) -> DataFrame:
    """``feature, bin, n, gradient, hessian`` of the first tree's root over all features."""
    features = find_features(train, numbers, levels, params)
    scale = scale_pos_weight(train, label)
    cells = count_cells(train, features, label, range(1), keys, params)
    found = histograms(cells, Tree(), [0], F.lit(0.0), scale, list(range(len(features))), features, "pos_0", "neg_0")
    names = F.array(*[F.lit(f.name) for f in features])
    return found.select(F.element_at(names, F.col("feature") + 1).alias("feature"), F.col("bin").cast("int").alias("bin"),
                        F.col("n").cast("bigint").alias("n"), F.round("g", 6).alias("gradient"),
                        F.round("h", 6).alias("hessian"))


def root_splits(histogram: DataFrame, params: BoostParams = BoostParams()) -> DataFrame:
    """Gain of every admissible split of that root, as columns (the same formula as ``best_split``)."""
    from pyspark.sql import Window
    upto = Window.partitionBy("feature").orderBy("bin")
    whole = Window.partitionBy("feature")
    soft_col = lambda g: F.greatest(F.abs(g) - params.alpha, F.lit(0.0))  # noqa: E731  (squared: the sign is gone)
    power = lambda g, h: soft_col(g) * soft_col(g) / (h + params.lam)
    sums = histogram.select(
        "feature", "bin", F.sum("gradient").over(upto).alias("gl"), F.sum("hessian").over(upto).alias("hl"),
        F.sum("gradient").over(whole).alias("g"), F.sum("hessian").over(whole).alias("h"))
    gr, hr = F.col("g") - F.col("gl"), F.col("h") - F.col("hl")
    fine = (F.col("hl") >= params.min_child_weight) & (hr >= params.min_child_weight)
    gain = power(F.col("gl"), F.col("hl")) + power(gr, hr) - power(F.col("g"), F.col("h"))
    return sums.where(fine).select("feature", "bin", F.round(gain, 4).alias("gain"))
