"""Treatment effects: doubly robust scores, synthetic controls, causal forests, fair classifiers.

Nuisance models take their moments from Spark; scores are columns. Folds are hashes of the row id, so a rerun gives the same result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wfspark.functions.pay import col
from wfspark.operators.linear import joined_moments, linear, moments, ridge


#: Units times periods that synthetic controls take.
MOST_CELLS = 2_000_000


def logits(df: DataFrame, targets: dict[object, Column], features: list[str], weights: dict[object, Column] | None = None, c: float = 1.0, rounds: int = 25) -> dict[object, tuple[float, np.ndarray]]:
    """Several logistic regressions on the same features, each with its own target and row weights, with an L2 penalty of 1 / c on the
    coefficients. A Newton step of all models is one aggregation over packed blocks of rows, which numpy multiplies."""
    names = list(targets)
    p, k = len(features), len(names)
    values = [*[targets[n] for n in names], *[(weights or {}).get(n, F.lit(1.0)) for n in names]]
    rows = df.select(*[col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], *[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rows": [batch.to_numpy(float).tobytes()]})

    def sums(blocks: Iterator, b: np.ndarray) -> Iterator[np.ndarray]:
        """Gradient and second derivative of each model over a partition, side by side."""
        total = np.zeros((k, p + 1, p + 2))
        for block in blocks:
            m = np.frombuffer(block[0]).reshape(-1, p + 2 * k)
            x = np.column_stack([np.ones(len(m)), m[:, :p]])
            for j in range(k):
                y, w = m[:, p + j], m[:, p + k + j]
                ok = (w != 0) & ~np.isnan(w) & ~np.isnan(y) & ~np.isnan(x).any(axis=1)
                xj, yj, wj = (x, y, w) if ok.all() else (x[ok], y[ok], w[ok])
                e = 1 / (1 + np.exp(-np.clip(xj @ b[j], -500, 500)))
                total[j, :, 0] += xj.T @ (wj * (yj - e))
                total[j, :, 1:] += xj.T @ (xj * (wj * e * (1 - e))[:, None])
        yield total

    packed = rows.mapInPandas(pack, "rows binary").rdd.persist(StorageLevel.MEMORY_AND_DISK)
    b, penalty = np.zeros((k, p + 1)), np.diag([1e-9] + [1 / c] * p)
    moving = np.ones(k, bool)
    for _ in range(rounds):
        now = b.copy()
        total = packed.mapPartitions(lambda blocks, now=now: sums(blocks, now)).treeReduce(np.add, 2) if packed.getNumPartitions() else np.zeros((k, p + 1, p + 2))
        for j in np.flatnonzero(moving):
            step = np.linalg.solve(total[j, :, 1:] + penalty, total[j, :, 0] - penalty @ b[j])
            b[j] += np.clip(step, -5, 5)
            moving[j] = np.abs(step).max() >= 1e-7
        if not moving.any():
            break
    packed.unpersist()
    return {n: (float(b[j, 0]), b[j, 1:]) for j, n in enumerate(names)}


def logit(df: DataFrame, target: str, features: list[str], weight: str | None = None, c: float = 1.0, rounds: int = 25) -> tuple[float, np.ndarray]:
    """One logistic regression."""
    return logits(df, {0: col(target)}, features, {0: col(weight)} if weight else None, c, rounds)[0]


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


#: Fits a model on some rows and gives its prediction as a column: fit(rows, target, features).
Learner = Callable[[DataFrame, str, list[str]], Column]


def ridge_learner(alpha: float = 1.0) -> Learner:
    return lambda rows, target, features: linear(*ridge(moments(rows, [target, *features])[None], target, features, alpha), features)


def logistic_learner(c: float = 1.0) -> Learner:
    return lambda rows, target, features: _sigmoid(linear(*logit(rows, target, features, c=c), features))


def _folded(work: DataFrame, outcome: str, treatment: str, features: list[str], folds: int, alpha: float) -> list[tuple[Column, Column, Column]]:
    """Propensity and both outcome predictions for each fold, from models of the other folds: sums of products by fold and arm come from one
    aggregation, and all logistic models take their steps together."""
    by = moments(work.withColumn("__cell", F.col("__fold") * 2 + col(treatment)), [outcome, *features], "__cell")
    keep = lambda k: F.when(F.col("__fold") != k, 1.0).otherwise(0.0) if folds > 1 else F.lit(1.0)
    fitted = logits(work, {k: col(treatment) for k in range(folds)}, features, {k: keep(k) for k in range(folds)})
    out = []
    for k in range(folds):
        arms = [joined_moments([m for cell, m in by.items() if cell % 2 == arm and (folds == 1 or cell // 2 != k)]) for arm in (0, 1)]
        if None in arms:
            raise ValueError("every training fold needs treated and control rows")
        zero, one = (linear(*ridge(m, outcome, features, alpha), features) for m in arms)
        out.append((_sigmoid(linear(*fitted[k], features)), zero, one))
    return out


def doubly_robust(
    df: DataFrame, row: str, outcome: str, treatment: str, features: list[str], clip: tuple[float, float] = (0.01, 0.99), folds: int = 5, alpha: float = 1.0,
    propensity: Learner | None = None, regression: Learner | None = None,
) -> DataFrame:
    """Rows with ``propensity``, ``mu0``, ``mu1`` and ``psi``, the doubly robust score of each, from models fitted on the other folds. The models are
    logistic and ridge regressions unless learners are given. The treatment must be 0 or 1, with at least two rows of each."""
    work = df.withColumn("__fold", F.pmod(F.xxhash64(row), F.lit(folds)))
    arms = {r[0]: r[1] for r in df.groupBy(col(treatment).cast("double")).count().collect()}
    if set(arms) != {0.0, 1.0}:
        raise ValueError("the treatment must be 0 or 1, and both must occur")
    if folds > 1 and min(arms.values()) < 2:
        raise ValueError("each arm needs at least two rows")
    if propensity is None and regression is None:
        models = _folded(work, outcome, treatment, features, folds, alpha)
    else:
        models = []
        for k in range(folds):
            part = work.where(F.col("__fold") != k) if folds > 1 else work
            fit = regression or ridge_learner(alpha)
            models.append(((propensity or logistic_learner())(part, treatment, features), *(fit(part.where(col(treatment) == v), outcome, features) for v in (0, 1))))

    def chosen(which: int) -> Column:
        out = F.lit(None).cast("double")
        for k, model in enumerate(models):
            out = F.when(F.col("__fold") == k, model[which]).otherwise(out)
        return out

    scored = work.withColumns({"propensity": F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), chosen(0))), "mu0": chosen(1), "mu1": chosen(2)})
    t, y, e = col(treatment), col(outcome), F.col("propensity")
    psi = F.col("mu1") - F.col("mu0") + t * (y - F.col("mu1")) / e - (1 - t) * (y - F.col("mu0")) / (1 - e)
    return scored.withColumn("psi", psi).drop("__fold")


def _two_sided(z: Column) -> Column:
    return F.pandas_udf(lambda v: v.abs().map(lambda x: math.erfc(x / math.sqrt(2))), "double")(z)


def aipw(df: DataFrame, row: str, outcome: str, treatment: str, features: list[str], **options: object) -> DataFrame:
    """Average treatment effect with its standard error, z, interval and p-value, and the plain difference of the arms' means."""
    scored = doubly_robust(df, row, outcome, treatment, features, **options)
    mean = lambda v: F.avg(F.when(col(treatment) == v, col(outcome)))
    r = scored.agg(F.avg("psi").alias("ate"), (F.stddev_pop("psi") / F.sqrt(F.count("psi"))).alias("se"), F.count("psi").alias("n"), (mean(1) - mean(0)).alias("naive_ate"))
    r = r.withColumn("z", F.coalesce(F.try_divide("ate", "se"), F.lit(0.0)))
    return r.select("n", "ate", "se", "z", (F.col("ate") - 1.96 * F.col("se")).alias("ci_low"), (F.col("ate") + 1.96 * F.col("se")).alias("ci_high"), _two_sided(F.col("z")).alias("p_value"), "naive_ate")


def uplift_mse(df: DataFrame, row: str, outcome: str, treatment: str, features: list[str], score: str) -> DataFrame:
    """Mean squared distance of uplift scores from in-sample doubly robust scores."""
    return doubly_robust(df, row, outcome, treatment, features, folds=1).agg(F.avg(F.pow(col(score) - F.col("psi"), 2)).alias("dr_mse"))


def simplex_weights(a: np.ndarray, y: np.ndarray, l2: float = 1e-4, intercept: bool = True, rounds: int = 4000) -> tuple[np.ndarray, float]:
    """Weights on the simplex for the columns of ``a`` that come closest to ``y``, and the level between them."""
    if intercept:
        am, ym = a.mean(axis=0), y.mean()
        ac, yc = a - am, y - ym
    else:
        am, ym, ac, yc = np.zeros(a.shape[1]), 0.0, a, y
    g, h = ac.T @ ac + l2 * np.eye(a.shape[1]), ac.T @ yc
    rate = 1 / max(np.linalg.eigvalsh(g)[-1], 1e-12)
    w = np.full(a.shape[1], 1 / a.shape[1])
    v, t = w, 1.0
    for _ in range(rounds):
        u = v - rate * (g @ v - h)
        s = np.sort(u)[::-1]
        c = (np.cumsum(s) - 1) / np.arange(1, len(s) + 1)
        new = np.maximum(u - c[np.flatnonzero(s > c)[-1]], 0)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / nt * (new - w)
        if np.abs(new - w).max() < 1e-12:
            w = new
            break
        w, t = new, nt
    return w, float(ym - am @ w)


def _wide(df: DataFrame, unit: str, time: str, outcome: str) -> pd.DataFrame:
    """Units by periods; units with a missing period go. One number for each unit and period comes to the driver, at most ``MOST_CELLS`` of them."""
    cells = df.groupBy(unit, time).agg(F.avg(col(outcome)).alias("y"))
    if cells.limit(MOST_CELLS + 1).count() > MOST_CELLS:
        raise ValueError(f"synthetic controls take at most {MOST_CELLS} pairs of unit and period")
    rows = cells.toPandas()
    return rows.pivot(index=unit, columns=time, values="y").sort_index(axis=1).dropna()


def sdid(df: DataFrame, unit: str, time: str, outcome: str, treated: list, post: object, l2: float = 1e-4) -> DataFrame:
    """Synthetic difference in differences: unit and time weights, the effect on the treated and its jackknife error. No rows without complete treated
    and control units on both sides."""
    w = _wide(df, unit, time, outcome)
    is_post = np.array([t >= post for t in w.columns])
    tr, co = w[w.index.isin(treated)].to_numpy(), w[~w.index.isin(treated)].to_numpy()
    schema = "att double, se double, t_stat double, p_value double, ci_low double, ci_high double, treated_pre double, treated_post double, synthetic_pre double, synthetic_post double, n_controls int, n_treated int"
    if not len(tr) or not len(co) or is_post.all() or not is_post.any():
        return df.sparkSession.createDataFrame([], schema)
    omega, _ = simplex_weights(co[:, ~is_post].T, tr[:, ~is_post].mean(axis=0), l2)
    lam, _ = simplex_weights(co[:, ~is_post], co[:, is_post].mean(axis=1), l2)

    def att(o: np.ndarray, c: np.ndarray) -> float:
        t = tr.mean(axis=0)
        s = o @ c
        return float((t[is_post].mean() - s[is_post].mean()) - (t[~is_post] @ lam - s[~is_post] @ lam))

    effect, left = att(omega, co), []
    for k in range(len(co)):
        o = np.delete(omega, k)
        left.append(att(o / o.sum() if o.sum() > 0 else np.full(len(o), 1 / len(o)), np.delete(co, k, axis=0)))
    n = len(left)
    se = (math.sqrt((n - 1) / n * np.sum((np.array(left) - np.mean(left)) ** 2)) if n >= 3 else 0.0) or 0.01
    mean, twin = tr.mean(axis=0), omega @ co
    sides = [float(x) for x in (mean[~is_post] @ lam, mean[is_post].mean(), twin[~is_post] @ lam, twin[is_post].mean())]
    z = effect / se
    return df.sparkSession.createDataFrame([(effect, se, z, math.erfc(abs(z) / math.sqrt(2)), effect - 1.96 * se, effect + 1.96 * se, *sides, n, len(tr))], schema)


def synthetic_controls(df: DataFrame, unit: str, time: str, outcome: str, pilots: list, post: object, l2: float = 1e-4) -> DataFrame:
    """For each pilot its synthetic twin from units that are no pilots: trajectory, lift, fit before, largest donors."""
    w = _wide(df, unit, time, outcome)
    pre = np.array([t < post for t in w.columns])
    donors = w[~w.index.isin(pilots)]
    rows = []
    for p in pilots:
        if p not in w.index or donors.empty or not pre.any():
            continue
        y = w.loc[p].to_numpy()
        weights, level = simplex_weights(donors.to_numpy()[:, pre].T, y[pre], l2)
        twin = level + weights @ donors.to_numpy()
        rmspe = float(np.sqrt(np.mean((y[pre] - twin[pre]) ** 2)))
        top = ", ".join(f"{donors.index[k]} ({weights[k]:.2f})" for k in np.argsort(-weights, kind="stable")[:3])
        for t, a, s, before in zip(w.columns, y, twin, pre):
            rows.append((p.item() if hasattr(p, "item") else p, t, bool(not before), round(float(a), 3), round(float(s), 3), round(float(a - s), 3), rmspe, top))
    kinds = df.select(unit, time).schema
    return df.sparkSession.createDataFrame(rows, f"unit {kinds[0].dataType.simpleString()}, time {kinds[1].dataType.simpleString()}, is_post boolean, actual double, synthetic double, lift double, rmspe double, donors string")


def _drawn(h: np.ndarray, k: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from hashes of row ids, others for each k."""
    v = h.view(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        v = (v ^ (v >> np.uint64(shift))) * np.uint64(factor)
    return ((v ^ (v >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def _effects(sums: np.ndarray) -> np.ndarray:
    """Effect from sums (rows, t * t, t * y)."""
    return sums[..., 2] / (sums[..., 1] + 1e-6)


def _split(h: np.ndarray, features: np.ndarray, edges: list[np.ndarray], leaf: int) -> tuple[int, int, float] | None:
    """The best split of one node among some features: feature, bin and gain. h: feature, bin, half, sums. All bins of all features are weighed at
    once from cumulative sums of half 0; candidates are the bins that hold a decile."""
    below = h[features, :, 0].cumsum(axis=1)
    all_ = below[:, -1:, :]
    n = below[:, :, 0]
    wanted = np.arange(0.1, 0.91, 0.1) * all_[:, :, 0]
    at_decile = np.zeros(n.shape, bool)
    for row, counts in enumerate(n):
        at_decile[row, np.minimum(np.searchsorted(counts, wanted[row]), len(counts) - 1)] = True
    last = np.array([len(edges[f]) for f in features])[:, None]
    ok = at_decile & (np.arange(n.shape[1]) < last) & (np.minimum(n, all_[:, :, 0] - n) >= leaf)
    rest = all_ - below
    gain = np.where(ok, n * rest[:, :, 0] / np.maximum(all_[:, :, 0], 1) * (_effects(below) - _effects(rest)) ** 2, 0.0)
    best = gain.max(initial=0.0)
    if best <= 0:
        return None
    row, c = max(zip(*np.nonzero(gain == best)), key=lambda x: (features[x[0]], x[1]))
    return int(features[row]), int(c), float(best)


def _splits(h: np.ndarray, k: int, edges: list[np.ndarray], leaf: int, seed: int) -> list[tuple]:
    """Splits of the nodes of one level of tree k: node, feature, threshold, effect left, effect right, gain; and (0, -1, 0, effect, 0, 0) for the root.
    h: node, feature, bin, half, sums; splits come from half 0, effects from half 1."""
    first = len(h) - 1
    out: list[tuple] = [(0, -1, 0.0, float(_effects(h[0, 0, :, 1].sum(axis=0))), 0.0, 0.0)] if first == 0 else []
    for node in range(len(h)):
        if h[node, 0, :, 0, 0].sum() < 2 * leaf:
            continue
        r = np.random.default_rng([seed, k, first + node])
        found = _split(h[node], r.choice(len(edges), max(1, int(math.sqrt(len(edges)))), replace=False), edges, leaf)
        if found:
            f, c, gain = found
            lo, hi = h[node, f, : c + 1, 1].sum(axis=0), h[node, f, c + 1 :, 1].sum(axis=0)
            if lo[0] and hi[0]:
                out.append((first + node, f, float(edges[f][c]), float(_effects(lo)), float(_effects(hi)), gain))
    return out


@dataclass
class HonestTree:
    """One tree as arrays over nodes (children of node n: 2n + 1 and 2n + 2): split feature (-1: leaf), threshold, effect, gain."""

    features: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    effect: np.ndarray
    gain: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            f = self.feature[at]
            at = np.where(inner, np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], 2 * at + 1, 2 * at + 2), at)
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.effect[self.leaves(np.asarray(x, float))]

    def predict_instance(self, x: np.ndarray) -> tuple[float, int]:
        """Effect of one row, and its leaf."""
        leaf = int(self.leaves(np.asarray(x, float).reshape(1, -1))[0])
        return float(self.effect[leaf]), leaf

    def importances(self, kind: str = "gain") -> np.ndarray:
        """Share of each feature in the gains, or in the number of splits."""
        if kind not in ("gain", "split"):
            raise ValueError(f"unknown importance {kind}")
        inner = self.feature >= 0
        total = np.bincount(self.feature[inner], self.gain[inner] if kind == "gain" else None, len(self.features)).astype(float)
        return total / total.sum() if total.sum() > 0 else total

    def flatten(self) -> list[tuple[int, int, int, int, float, float]]:
        """Reached nodes as (node, left, right, feature, threshold, effect), -1 where there is none; the root first."""
        out, todo = [], [0]
        while todo:
            n = todo.pop(0)
            inner = self.feature[n] >= 0
            out.append((n, 2 * n + 1 if inner else -1, 2 * n + 2 if inner else -1, int(self.feature[n]), float(self.threshold[n]), float(self.effect[n])))
            todo += [2 * n + 1, 2 * n + 2] if inner else []
        return out


@dataclass
class CausalForest:
    """Honest trees on residuals of outcome and treatment. ``trees`` predict the effect of any row from its features."""

    features: list[str]
    trees: list[HonestTree]

    @classmethod
    def fit(cls, df: DataFrame, row: str, outcome: str, treatment: str, features: list[str], trees: int = 50, depth: int = 4, leaf: int = 10, share: float = 0.7, bins: int = 512, seed: int = 42) -> CausalForest:
        """Each tree is fitted on the ``share`` of all complete rows that hashes of their ids choose, half for the splits and half for the effects. A level
        of all trees is one pass: tasks sum histograms of at most ``bins`` quantile bins of each feature."""
        spark = df.sparkSession
        b = moments(df, [outcome, *features])[None]
        left = df.withColumn("__y", col(outcome) - linear(*ridge(b, outcome, features, 1.0), features)).withColumn("__t", col(treatment) - _sigmoid(linear(*logit(df, treatment, features), features)))
        rows = left.select(F.xxhash64(row).alias("__h"), "__y", "__t", *[col(f).cast("double").alias(f) for f in features]).na.drop()
        cuts = rows.agg(*[F.percentile_approx(f, [k / (bins - 1) for k in range(bins)], 100 * bins).alias(f) for f in features]).first()
        edges = [np.unique(np.array(c or [], float)) for c in cuts]

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                yield pd.DataFrame({"h": [x["__h"].to_numpy(np.int64).tobytes()], "x": [x.drop(columns="__h").to_numpy(float).tobytes()]})

        packed = rows.mapInPandas(pack, "h binary, x binary").rdd.persist(StorageLevel.MEMORY_AND_DISK)
        nodes = 2 ** (depth + 1) - 1
        forest = [HonestTree(features, np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes), np.zeros(nodes)) for _ in range(trees)]

        def count(blocks: Iterator, level: int) -> Iterator[tuple[int, np.ndarray]]:
            p, first = len(features), 2**level - 1
            shape = (2**level, p, bins + 1, 2)
            total: dict[int, np.ndarray] = {}
            for block in blocks:
                h, x = np.frombuffer(block[0], np.int64), np.frombuffer(block[1]).reshape(-1, p + 2)
                where = np.column_stack([np.searchsorted(e, x[:, 2 + f]) for f, e in enumerate(edges)])
                for k, tree in enumerate(forest):
                    u = _drawn(h, seed * 1_000_003 + k)
                    i = np.flatnonzero(u < share)
                    at = tree.leaves(x[i, 2:])
                    i, at = i[at >= first], at[at >= first] - first
                    half, t, y = (u[i] >= share / 2).astype(int), x[i, 1], x[i, 0]
                    to = (((at[:, None] * p + np.arange(p)) * (bins + 1) + where[i]) * 2 + half[:, None]).ravel()
                    sums = [np.bincount(to, np.repeat(s, p), math.prod(shape)).reshape(shape) for s in (np.ones(len(i)), t * t, t * y)]
                    total[k] = total.get(k, 0) + np.stack(sums, axis=-1)
            yield from total.items()

        for level in range(depth):
            sums = packed.mapPartitions(lambda blocks, level=level: count(blocks, level)).reduceByKey(np.add, min(trees, spark.sparkContext.defaultParallelism * 2))
            found = sums.map(lambda kh: (kh[0], _splits(kh[1], kh[0], edges, leaf, seed))).collect()
            for k, splits in found:
                tree = forest[k]
                for node, f, c, lo, hi, gain in splits:
                    if f < 0:
                        tree.effect[0] = lo
                    else:
                        tree.feature[node], tree.threshold[node], tree.gain[node] = f, c, gain
                        tree.effect[[2 * node + 1, 2 * node + 2]] = lo, hi
        packed.unpersist()
        return cls(features, forest)

    def predict(self, df: DataFrame, level: float = 0.05) -> DataFrame:
        """Rows with ``effect``, ``se``, ``ci_low`` and ``ci_high``: the mean of the trees and a normal interval from their spread. Missing features count
        as 0."""
        shared = df.sparkSession.sparkContext.broadcast(self.trees)
        width = len(self.features)

        @F.pandas_udf("effect double, se double")
        def effects(x: pd.Series) -> pd.DataFrame:
            v = np.stack(x) if len(x) else np.empty((0, width))
            e = np.array([tree.predict(v) for tree in shared.value])
            spread = e.var(axis=0, ddof=1) if len(e) > 1 else np.zeros(e.shape[1])
            return pd.DataFrame({"effect": e.mean(axis=0), "se": np.sqrt(spread / len(e) + 1e-8)})

        z = NormalDist().inv_cdf(1 - level / 2)
        found = df.withColumn("__p", effects(F.array(*[F.coalesce(col(f).cast("double"), F.lit(0.0)) for f in self.features])))
        e, se = F.col("__p.effect"), F.col("__p.se")
        return found.withColumns({"effect": e, "se": se, "ci_low": e - z * se, "ci_high": e + z * se}).drop("__p")

    def persuadables(self, df: DataFrame, least: float = 0.0, level: float = 0.05) -> DataFrame:
        """Predictions with whether the effect is over ``least`` and surely positive, and what that makes of the row."""
        found = self.predict(df, level)
        up = (F.col("effect") > least) & (F.col("ci_low") > 0)
        down = (F.col("effect") < -least) & (F.col("ci_high") < 0)
        kind = F.when(down, "Do Not Disturb (Adverse Effect)").when(up, "Persuadable (High Priority)").otherwise("Lost Cause / Sure Thing")
        return found.withColumn("is_persuadable", up).withColumn("archetype", kind)

    def importances(self, spark: SparkSession, kind: str = "gain") -> DataFrame:
        """Share of each feature, mean of the trees, largest first."""
        mean = np.mean([tree.importances(kind) for tree in self.trees], axis=0)
        mean = mean / mean.sum() if mean.sum() > 0 else mean
        return spark.createDataFrame(sorted(((f, float(v)) for f, v in zip(self.features, mean)), key=lambda r: (-r[1], r[0])), "feature string, importance double")

    def to_json(self) -> str:
        return json.dumps({"features": self.features, "trees": [[getattr(t, k).tolist() for k in ("feature", "threshold", "effect", "gain")] for t in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> CausalForest:
        d = json.loads(text)
        return cls(d["features"], [HonestTree(d["features"], *map(np.array, t)) for t in d["trees"]])


def causal_forest(df: DataFrame, row: str, outcome: str, treatment: str, features: list[str], **options: object) -> DataFrame:
    """Effect of each row that the forest was fitted on, with its interval."""
    return CausalForest.fit(df, row, outcome, treatment, features, **options).predict(df).select(row, "effect", "ci_low", "ci_high")


def fair_classifier(df: DataFrame, row: str, target: str, group: str, features: list[str], eps: float = 0.01, rounds: int = 20, rate: float = 0.5, constraint: str = "parity", most_groups: int = 1000) -> DataFrame:
    """Logistic classifiers on rows reweighted toward equal rates of the groups; the mean of all rounds' probabilities. ``parity``: equal shares of positive
    predictions; ``odds``: equal shares among the positives and among the negatives. Groups, at most ``most_groups``, are pairs of multipliers."""
    if constraint not in ("parity", "odds"):
        raise ValueError(f"unknown constraint {constraint}")
    cell = [F.col(group), *([col(target).cast("int").alias("__y")] if constraint == "odds" else [F.lit(0).alias("__y")])]
    counted = df.where(F.col(group).isNotNull()).groupBy(*cell).count().limit(2 * most_groups + 1).collect()
    if len(counted) > 2 * most_groups:
        raise ValueError(f"fair classifiers take at most {most_groups} groups")
    size = {(r[group], r["__y"]): r["count"] for r in counted}
    total = sum(size.values())
    cells = sorted(size)
    pairs = [(a, b) for k, a in enumerate(cells) for b in cells[k + 1 :] if a[1] == b[1]]
    lam = {p: [1 / max(1, 2 * len(pairs))] * 2 for p in pairs}
    fitted = []
    for _ in range(rounds):
        mod = dict.fromkeys(cells, 0.0)
        for (a, b), (up, down) in lam.items():
            mod[a] += (up - down) / (size[a] / total)
            mod[b] -= (up - down) / (size[b] / total)
        m = F.lit(0.0)
        for y in {c[1] for c in cells}:
            table = F.create_map(*[F.lit(x) for c, v in mod.items() if c[1] == y for x in (c[0], v)])[F.col(group)]
            m = F.when((col(target).cast("int") == y) if constraint == "odds" else F.lit(True), F.coalesce(table, F.lit(0.0))).otherwise(m)
        w = F.greatest(F.lit(0.01), F.when(col(target) == 1, 1 - 0.5 * m).otherwise(1 + 0.5 * m))
        b0, b = logit(df.withColumn("__w", w), target, features, "__w")
        fitted.append((b0, b))
        found = df.where(F.col(group).isNotNull()).groupBy(*cell).agg(F.avg((linear(b0, b, features) > 0).cast("double")).alias("r")).collect()
        rates = {(r[group], r["__y"]): r["r"] or 0.0 for r in found}
        gaps = {(a, c): rates[a] - rates[c] for a, c in pairs}
        if max(map(abs, gaps.values()), default=0.0) <= eps:
            break
        for p, g in gaps.items():
            lam[p] = [lam[p][0] * math.exp(rate * (g - eps)), lam[p][1] * math.exp(rate * (-g - eps))]
        scale = sum(sum(v) for v in lam.values())
        lam = {p: [x / scale for x in v] for p, v in lam.items()}
    mean = sum((_sigmoid(linear(b0, b, features)) for b0, b in fitted), F.lit(0.0)) / len(fitted)
    return df.select(row, mean.alias("probability"), (mean >= 0.5).cast("int").alias("predicted"))


def linear_shap(df: DataFrame, row: str, target: str, features: list[str]) -> DataFrame:
    """Exact Shapley contributions of a linear model: coefficient times the distance from the mean."""
    m = moments(df, [target, *features])[None]
    _, b = ridge(m, target, features, 1e-9)
    return df.select(row, target, *[(F.lit(float(w)) * (col(f) - F.lit(float(mu)))).alias(f"shap_{f}") for f, w, mu in zip(features, b, m.mean[1:])])


def shap_by_class(shap: DataFrame, label: str, features: list[str]) -> DataFrame:
    """Mean contribution of each feature in the two classes."""
    means = shap.groupBy(F.col(label).cast("int").alias("__c")).agg(*[F.avg(f"shap_{f}").alias(f) for f in features])
    long = means.select("__c", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("v")) for f in features])).alias("x"))
    pick = lambda c: F.max(F.when(F.col("__c") == c, F.col("x.v")))
    return long.groupBy(F.col("x.feature").alias("feature")).agg(pick(0).alias("retained"), pick(1).alias("terminated"))


def shap_interactions(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Strength of pairwise interactions: mean absolute contribution of each product term of a linear model with all pairs."""
    pairs = [(a, b) for k, a in enumerate(features) for b in features[k + 1 :]]
    means = df.agg(*[F.avg(col(f)).alias(f) for f in features]).first()
    work = df.select(col(target).alias(target), *[(col(f) - F.lit(means[f])).alias(f) for f in features])
    work = work.select("*", *[(F.col(a) * F.col(b)).alias(f"__{a}__{b}") for a, b in pairs])
    names = [*features, *[f"__{a}__{b}" for a, b in pairs]]
    _, w = ridge(moments(work, [target, *names])[None], target, names, 1e-6)
    size = work.agg(*[F.avg(F.abs(F.col(n) * F.lit(float(v)))).alias(n) for n, v in zip(names, w)]).first()
    rows = [(a, b, 2 * float(size[f"__{a}__{b}"])) for a, b in pairs]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, strength double")


def inflection_thresholds(df: DataFrame, value: str, shap: str, bins: int = 40) -> DataFrame:
    """Where the binned mean contribution of a feature changes sign, and where it is steepest between the 5th and 95th percentile."""
    from pyspark.sql import Window

    edges = df.agg(F.percentile(col(value), 0.05).alias("__lo"), F.percentile(col(value), 0.95).alias("__hi"))
    inside = df.crossJoin(F.broadcast(edges)).where(col(value).between(F.col("__lo"), F.col("__hi")))
    bin_ = F.least(F.lit(bins - 1), F.floor(bins * F.try_divide(col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))))
    means = inside.groupBy(bin_.alias("bin")).agg(F.avg(col(value)).alias("at"), F.avg(col(shap)).alias("m"))
    w = Window.orderBy("bin")
    steps = means.select("at", "m", F.lag("at").over(w).alias("pa"), F.lag("m").over(w).alias("pm")).where("pa is not null and at > pa")
    slope = steps.withColumn("slope", (F.col("m") - F.col("pm")) / (F.col("at") - F.col("pa")))
    cross = slope.where("sign(m) <> sign(pm)").select(F.lit("zero_crossing").alias("kind"), (F.col("pa") - F.col("pm") / F.col("slope")).alias("threshold"), "slope")
    steep = slope.agg(F.max_by(F.struct(((F.col("at") + F.col("pa")) / 2).alias("threshold"), "slope"), F.abs("slope")).alias("x")).select(F.lit("steepest").alias("kind"), "x.threshold", "x.slope")
    return cross.union(steep)
