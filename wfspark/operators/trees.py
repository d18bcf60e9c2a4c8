"""Boosted trees and their Shapley values: MLlib fits, numpy attributes in Arrow batches.

A tree's contributions are exact: with the features outside a coalition averaged by the numbers of training rows in each branch, the tree is evaluated for every
coalition of the features that it splits on (at most 2 ** 7 for a depth of 3), and the values are weighted as Shapley's are.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wfspark.functions.pay import col
from wfspark.operators.quantiles import percentiles

_LINE = re.compile(r"(If|Else) \(feature (\d+) (<=|>) (\S+)\)|Predict: (\S+)")


@dataclass
class Tree:
    """Nodes as arrays: split feature (-1: leaf), threshold, children, value of a leaf, and training rows below."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def parsed(cls, lines: list[str]) -> Tree:
        """From MLlib's text of one tree: a split's two sides follow it, each by its own line."""
        nodes: list[list] = []
        marks = iter([m for m in map(_LINE.search, lines) if m])

        def node(m: re.Match) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, 0.0])
            if m[5]:
                nodes[at][4] = float(m[5])
                return at
            nodes[at][0], nodes[at][1] = int(m[2]), float(m[4])
            nodes[at][2] = node(next(marks))
            next(marks)  # the Else of this split
            nodes[at][3] = node(next(marks))
            return at

        node(next(marks))
        f, t, left, right, v = zip(*nodes)
        return cls(np.array(f), np.array(t), np.array(left), np.array(right), np.array(v), np.zeros(len(nodes)))

    def counts(self, x: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Rows that pass each node; ``times``: how often each row of x is there."""
        out, todo = np.zeros(len(self.feature)), [(0, np.arange(len(x)))]
        while todo:
            n, rows = todo.pop()
            out[n] = times[rows].sum()
            if self.feature[n] >= 0:
                low = x[rows, self.feature[n]] <= self.threshold[n]
                todo += [(self.left[n], rows[low]), (self.right[n], rows[~low])]
        return out

    def expected(self, x: np.ndarray, known: frozenset[int], n: int = 0) -> np.ndarray:
        """Mean prediction where only the ``known`` features are given."""
        f = self.feature[n]
        if f < 0:
            return np.full(len(x), self.value[n])
        low, high = (self.expected(x, known, c) for c in (self.left[n], self.right[n]))
        if f in known:
            return np.where(x[:, f] <= self.threshold[n], low, high)
        share = self.cover[self.left[n]] / max(self.cover[n], 1)
        return share * low + (1 - share) * high

    def coalitions(self, x: np.ndarray) -> tuple[list[int], dict[frozenset[int], np.ndarray]]:
        used = sorted(set(self.feature[self.feature >= 0].tolist()))
        return used, {frozenset(s): self.expected(x, frozenset(s)) for k in range(len(used) + 1) for s in combinations(used, k)}

    def contributions(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Shapley value of each feature (rows by features), and interaction of each pair (rows by features by features, off the diagonal)."""
        used, v = self.coalitions(x)
        m, one, two = len(used), np.zeros((len(x), width)), np.zeros((len(x), width, width))
        for s in v:
            for i in (k for k in used if k not in s):
                one[:, i] += factorial(len(s)) * factorial(m - len(s) - 1) / factorial(m) * (v[s | {i}] - v[s])
            for i, j in combinations([k for k in used if k not in s], 2):
                part = factorial(len(s)) * factorial(m - len(s) - 2) / (2 * factorial(m - 1)) * (v[s | {i, j}] - v[s | {i}] - v[s | {j}] + v[s])
                two[:, i, j] += part
                two[:, j, i] += part
        return one, two


def _times(weight: str | None) -> Column:
    return (col(weight) if weight else F.lit(1)).cast("long").alias("times")


@dataclass
class BoostedTrees:
    """A weighted sum of trees on named features."""

    features: list[str]
    weights: list[float]
    trees: list[Tree]

    @classmethod
    def fit(cls, df: DataFrame, target: str, features: list[str], depth: int = 3, rounds: int = 20, rate: float = 0.1, seed: int = 42, weight: str | None = None) -> BoostedTrees:
        """Squared errors of rows with equal features differ from those of their mean by a constant, so the trees are fitted on their means, weighted by their
        numbers: one pass over the rows. ``weight``: times that a row counts."""
        rows = df.select(*[col(f).cast("double").alias(f"x{k}") for k, f in enumerate(features)], col(target).cast("double").alias("y"), _times(weight)).na.drop()
        # equal targets have just their own value as mean
        rows = rows.groupBy(*[f"x{k}" for k in range(len(features))]).agg(F.min("y").alias("low"), F.sum(F.col("y") * F.col("times")).alias("s"), F.max("y").alias("high"), F.sum("times").alias("times"))
        mean = F.greatest("low", F.least("high", F.col("s") / F.col("times")))
        rows = rows.select(*[f"x{k}" for k in range(len(features))], mean.alias("y"), "times").persist(StorageLevel.MEMORY_AND_DISK)
        few = rows.coalesce(max(1, rows.count() // 20_000))
        ready = VectorAssembler(inputCols=[f"x{k}" for k in range(len(features))], outputCol="x").transform(few).select("x", "y", "times")
        model = GBTRegressor(featuresCol="x", labelCol="y", weightCol="times", maxDepth=depth, maxIter=rounds, stepSize=rate, seed=seed).fit(ready)
        trees = [Tree.parsed(t.toDebugString.split("\n")[1:]) for t in model.trees]

        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = [np.zeros(len(t.feature)) for t in trees]
            for batch in batches:
                x = batch.to_numpy(float)
                total = [a + t.counts(x[:, :-1], x[:, -1]) for a, t in zip(total, trees)]
            yield pd.DataFrame([(k, n, c) for k, counts in enumerate(total) for n, c in enumerate(counts)], columns=["tree", "node", "n"])

        for r in few.drop("y").mapInPandas(count, "tree int, node int, n double").groupBy("tree", "node").agg(F.sum("n").alias("n")).collect():
            trees[r["tree"]].cover[r["node"]] = r["n"]
        rows.unpersist()
        return cls(features, [float(w) for w in model.treeWeights], trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        every = frozenset(range(len(self.features)))
        return sum((w * t.expected(x, every) for w, t in zip(self.weights, self.trees)), np.zeros(len(x)))

    def contributions(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, two = np.zeros((len(x), len(self.features))), np.zeros((len(x), len(self.features), len(self.features)))
        for w, t in zip(self.weights, self.trees):
            a, b = t.contributions(x, len(self.features))
            one, two = one + w * a, two + w * b
        return one, two

    def shap(self, df: DataFrame) -> DataFrame:
        """The rows with ``shap_`` and each feature's name; rows with a gap in a feature get nulls."""
        shared, n = df.sparkSession.sparkContext.broadcast(self), len(self.features)

        @F.pandas_udf("array<double>")
        def values(x: pd.Series) -> pd.Series:
            v = np.stack(x).astype(float) if len(x) else np.empty((0, n))
            out = shared.value.contributions(np.nan_to_num(v))[0]
            return pd.Series([None if gap else row for gap, row in zip(np.isnan(v).any(axis=1), out.tolist())])

        found = df.withColumn("__s", values(F.array(*[F.coalesce(col(f).cast("double"), F.lit(float("nan"))) for f in self.features])))
        return found.select(*df.columns, *[F.col("__s")[k].alias(f"shap_{f}") for k, f in enumerate(self.features)])

    def interactions(self, df: DataFrame) -> DataFrame:
        """Mean absolute interaction of each pair (both halves together) over all complete rows, strongest first: tasks add up, no row comes to the driver."""
        shared, n = df.sparkSession.sparkContext.broadcast(self), len(self.features)
        pairs = list(combinations(range(n), 2))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, rows = np.zeros((n, n)), 0
            for batch in batches:
                x = batch.to_numpy(float)
                rows += int(x[:, -1].sum())
                total += np.einsum("rij,r->ij", np.abs(shared.value.contributions(x[:, :-1])[1]), x[:, -1])
            yield pd.DataFrame([(i, j, 2 * total[i, j], rows) for i, j in pairs], columns=["i", "j", "total", "n"])

        rows = df.select(*[col(f).cast("double").alias(f"x{k}") for k, f in enumerate(self.features)]).na.drop()
        rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("times"))
        sums = rows.mapInPandas(run, "i int, j int, total double, n long").groupBy("i", "j").agg((F.sum("total") / F.sum("n")).alias("strength")).collect()
        out = sorted(((self.features[r["i"]], self.features[r["j"]], r["strength"] or 0.0) for r in sums), key=lambda r: (-r[2], r[0], r[1]))
        return df.sparkSession.createDataFrame(out, "feature_a string, feature_b string, strength double")

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "weights": self.weights, "trees": [[getattr(t, k).tolist() for k in Tree.__dataclass_fields__] for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> BoostedTrees:
        d = json.loads(text)
        return cls(d["features"], d["weights"], [Tree(*map(np.array, t)) for t in d["trees"]])


def threshold_table(shap: DataFrame, features: list[str], points: int = 200, depth: int = 3, rounds: int = 20, weight: str | None = None) -> DataFrame:
    """One row a feature, from rows with the features and their ``shap_`` columns (``weight``: times that a row counts): where a boosted surrogate of the contribution crosses zero, the steepest of
    the crossings between the 5th and 95th percentile (or of all), mean and median, and whether high values add."""
    out = []
    for f in features:
        rows = shap.select(col(f).cast("double").alias("x"), F.col(f"shap_{f}").alias("s"), _times(weight)).na.drop()
        grouped = rows.groupBy("x", "s").agg(F.sum("times").alias("times")).persist(StorageLevel.MEMORY_AND_DISK)
        rows = grouped.coalesce(max(1, grouped.count() // 20_000))
        q = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), (F.sum(F.col("x") * F.col("times")) / F.sum("times")).alias("mean")).first()
        if q["lo"] is None:
            out.append((f, None, [], None, None, None))
            continue
        p5, p95, median = percentiles(rows, {"x": [0.05, 0.95, 0.5]}, "times")["x"]
        grid = np.linspace(q["lo"], q["hi"], points)
        y = BoostedTrees.fit(rows, "s", ["x"], depth, rounds, weight="times").predict(grid[:, None])
        grouped.unpersist()
        at = np.flatnonzero(y[:-1] * y[1:] < 0)
        zeros = [float(grid[k] - y[k] * (grid[k + 1] - grid[k]) / (y[k + 1] - y[k])) for k in at]

        def slope(z: float) -> float:
            c = int(np.argmin(np.abs(grid - z)))  # noqa: B023
            a, b = max(0, c - 2), min(points - 1, c + 2)
            return abs((y[b] - y[a]) / (grid[b] - grid[a])) if grid[b] > grid[a] else 0.0  # noqa: B023

        inner = [z for z in zeros if p5 <= z <= p95] or zeros
        out.append((f, round(max(inner, key=slope), 2) if inner else None, [round(z, 2) for z in zeros], round(q["mean"], 2), round(median, 2), bool(y[-1] > 0)))
    return shap.sparkSession.createDataFrame(out, "feature string, primary_threshold double, thresholds array<double>, mean double, median double, high_value_adds boolean")
