"""Linear models from one distributed pass: moments are summed in Spark, the small systems solved here."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wfspark.functions.pay import col
from wfspark.operators.quantiles import percentiles


@dataclass(frozen=True)
class Moments:
    """Row count, means and centred cross products of some columns."""

    names: list[str]
    n: float
    mean: np.ndarray
    cross: np.ndarray

    def covariance(self) -> np.ndarray:
        return self.cross / (self.n - 1)

    def second(self) -> np.ndarray:
        """Uncentred second moments."""
        return self.cross / self.n + np.outer(self.mean, self.mean)


def joined_moments(parts: list[Moments]) -> Moments | None:
    """Moments of several sets of rows together."""
    if not parts:
        return None
    n = sum(m.n for m in parts)
    mean = sum(m.n * m.mean for m in parts) / n
    cross = sum(m.cross + m.n * np.outer(m.mean - mean, m.mean - mean) for m in parts)
    return Moments(parts[0].names, n, mean, cross)


def moments(df: DataFrame, names: list[str], by: str | None = None) -> dict[object, Moments]:
    """Moments of the rows without a gap, for each value of ``by`` (None: of all). Sums of products are taken around a common
    shift, the first pass's means, so that large values don't cancel."""
    rows = df.where(" and ".join(f"`{c}` is not null" for c in names)).select(*([by] if by else []), *[col(c).alias(c) for c in names])
    shift = rows.agg(*[F.avg(c).alias(c) for c in names]).first()
    at = [F.col(c) - F.lit(shift[c] or 0.0) for c in names]
    sums = [F.sum(x).alias(f"s{i}") for i, x in enumerate(at)] + [F.sum(at[i] * at[j]).alias(f"p{i}_{j}") for i in range(len(at)) for j in range(i, len(at))]
    out = {}
    for r in rows.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), *sums).collect():
        k, n = len(names), r["n"]
        if not n:
            continue
        s = np.array([r[f"s{i}"] for i in range(k)])
        p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        out[r[by] if by else None] = Moments(names, n, s / n + np.array([shift[c] or 0.0 for c in names]), p - np.outer(s, s) / n)
    return out


def ridge(m: Moments, target: str, features: list[str], alpha: float = 0.0) -> tuple[float, np.ndarray]:
    """Intercept and coefficients; the intercept is not penalised."""
    at = [m.names.index(f) for f in features]
    y = m.names.index(target)
    b = np.linalg.solve(m.cross[np.ix_(at, at)] + alpha * np.eye(len(at)), m.cross[at, y]) if at else np.empty(0)
    return float(m.mean[y] - m.mean[at] @ b), b


def linear(intercept: float, coefficients: np.ndarray, features: list[str]) -> Column:
    out = F.lit(float(intercept))
    for b, f in zip(coefficients, features):
        out = out + F.lit(float(b)) * col(f)
    return out


def oaxaca(df: DataFrame, outcome: str, group: str, features: list[str], majority: object = 1, minority: object = 0, reference: str = "pooled") -> DataFrame:
    """Gap of mean outcomes, split into what features explain and what coefficients leave; one row for each part and feature, none where a group has no
    complete rows."""
    by = moments(df.where(F.col(group).isin(majority, minority)), [outcome, *features], group)
    if majority not in by or minority not in by:
        return df.sparkSession.createDataFrame([], "part string, feature string, value double")
    a, b = by[majority], by[minority]
    fits = {"majority": ridge(a, outcome, features), "minority": ridge(b, outcome, features)}
    if reference == "pooled":
        fits["pooled"] = ridge(moments(df, [outcome, *features])[None], outcome, features)
    beta = fits[reference][1]
    gap = a.mean[1:] - b.mean[1:]
    raw, explained = float(a.mean[0] - b.mean[0]), gap * beta
    rows = [("raw_gap", None, raw), ("explained", None, float(explained.sum())), ("unexplained", None, raw - float(explained.sum()))]
    rows += [("explained", f, float(x)) for f, x in zip(features, explained)]
    return df.sparkSession.createDataFrame(rows, "part string, feature string, value double")


def loo_expected_differential(df: DataFrame, entity: str, target: str, context: list[str], alpha: float = 1.0, most_levels: int = 200) -> DataFrame:
    """Mean and spread of each entity's residuals from a ridge fit on context columns. Text columns are 0/1 columns of their levels but the first, at
    most ``most_levels``."""
    work, names = df, []
    for c in context:
        if df.schema[c].dataType.simpleString() not in ("string", "boolean"):
            names.append(c)
            continue
        levels = [r[0] for r in df.select(F.col(c).cast("string").alias("v")).where("v is not null").distinct().orderBy("v").limit(most_levels + 1).collect()]
        if len(levels) > most_levels:
            raise ValueError(f"{c} has more than {most_levels} levels")
        work = work.withColumns({f"__{c}_{k}": (F.col(c).cast("string") == F.lit(v)).cast("double") for k, v in enumerate(levels[1:], 1)})
        names += [f"__{c}_{k}" for k in range(1, len(levels))]
    b0, b = ridge(moments(work, [target, *names])[None], target, names, alpha)
    left = work.withColumn("__r", col(target) - linear(b0, b, names))
    return left.groupBy(entity).agg(F.count("__r").alias("n"), F.avg("__r").alias("mean_residual"), F.stddev_samp("__r").alias("std_residual"))


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f = c = 1.0
    d = 0.0
    for k in range(300):
        m = k // 2
        num = 1.0 if k == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or 1e-30)
        c = 1 + num / c or 1e-30
        f *= c * d
        if abs(1 - c * d) < 1e-13:
            break
    return front * (f - 1)


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return total * scale
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for k in range(1, 500):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return 1 - scale * h


def _adjusted(p: np.ndarray, how: str) -> np.ndarray:
    n, order = len(p), np.argsort(p)
    out, rank = np.empty(n), np.arange(1, n + 1)
    s = p[order]
    if how == "bonf":
        s = s * n
    elif how == "sidak":
        s = 1 - (1 - s) ** n
    elif how == "holm":
        s = np.maximum.accumulate(s * (n - rank + 1))
    elif how in ("fdr_bh", "fdr_by"):
        scale = n / rank * (np.sum(1 / rank) if how == "fdr_by" else 1)
        s = np.minimum.accumulate((s * scale)[::-1])[::-1]
    elif how != "none":
        raise ValueError(f"unknown adjustment {how}")
    out[order] = np.minimum(s, 1)
    return out


def t_quantile(p: float, dof: float) -> float:
    """The value that a t variable stays under with probability p >= 0.5."""
    low, high = 0.0, 1.0
    below = lambda t: 1 - betainc(dof / 2, 0.5, dof / (dof + t * t)) / 2
    while below(high) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def correlation_power(r: float, n: int, level: float = 0.05) -> float:
    """Chance that a correlation of r in n rows is found to differ from 0, by Fisher's transformation with its bias taken out."""
    if n < 4 or abs(r) >= 1:
        return float("nan") if n < 4 else 1.0
    t = t_quantile(1 - level / 2, n - 2)
    bound = math.atanh(math.sqrt(t * t / (t * t + n - 2)))
    z = math.atanh(r) + r / (2 * (n - 1))
    tail = NormalDist().cdf
    return tail((z - bound) * math.sqrt(n - 3)) + tail((-z - bound) * math.sqrt(n - 3))


def average_ranks(rows: DataFrame, columns: list[str], ranges: int = 64) -> DataFrame:
    """Columns replaced by their average ranks. Values are counted first and cut at quantiles, which one pass finds for all columns; each range adds the
    totals of the ranges below it, so no task sorts them all."""
    cuts = rows.agg(*[F.percentile_approx(c, [k / ranges for k in range(1, ranges)]).alias(c) for c in columns]).first()
    for c in columns:
        edges = F.array(*[F.lit(float(v)) for v in sorted(set(cuts[c] or []))] or [F.lit(float("inf"))])
        values = rows.groupBy(c).agg(F.count("*").alias("__k")).withColumn("__p", F.size(F.filter(edges, lambda e: e < F.col(c))))  # noqa: B023
        totals = values.groupBy("__p").agg(F.sum("__k").alias("__all"))
        below = totals.select(F.col("__p").alias("__q"), (F.sum("__all").over(Window.orderBy("__p")) - F.col("__all")).alias("__below"))
        inside = F.sum("__k").over(Window.partitionBy("__p").orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranks = values.withColumn("__in", inside).join(F.broadcast(below), F.col("__p") == F.col("__q"))
        ranks = ranks.select(F.col(c).alias("__v"), (F.col("__below") + F.col("__in") - (F.col("__k") - 1) / 2).alias("__r"))
        rows = rows.join(ranks, F.col(c) == F.col("__v")).withColumn(c, F.col("__r")).drop("__v", "__r")
    return rows


def rank_correlations(rows: DataFrame, target: str, features: list[str], few: int = 100_000) -> tuple[int, np.ndarray]:
    """Number of rows and Spearman's correlation of each feature with the target. Ranks of features of few values are sent to the rows; rows are then added up by the
    value of the target, so only its values are ranked, in ranges, and the rows are never joined with them."""
    first = rows.agg(F.count("*").alias("n"), *[F.approx_count_distinct(f).alias(f"d{i}") for i, f in enumerate(features)]).first()
    n = first["n"]
    if not n:
        return 0, np.full(len(features), np.nan)
    named = rows.select(F.col(target).alias("y"), *[F.col(f).alias(f"x{i}") for i, f in enumerate(features)])
    small = [f"x{i}" for i in range(len(features)) if first[f"d{i}"] <= few]
    ranked = average_ranks(named, large) if (large := [f"x{i}" for i in range(len(features)) if f"x{i}" not in small]) else named
    for x in small:
        counts = named.groupBy(x).agg(F.count("*").alias("k")).toPandas().sort_values(x)
        table = pd.DataFrame({"__v": counts[x], "__r": counts["k"].cumsum() - (counts["k"] - 1) / 2})
        ranks = rows.sparkSession.createDataFrame(table, "__v double, __r double")
        ranked = ranked.join(F.broadcast(ranks), F.col(x) == F.col("__v")).withColumn(x, F.col("__r")).drop("__v", "__r")
    middle = (n + 1) / 2
    sums = [g for i in range(len(features)) for d in [F.col(f"x{i}") - middle] for g in (F.sum(d).alias(f"s{i}"), F.sum(d * d).alias(f"q{i}"))]
    values = ranked.groupBy("y").agg(F.count("*").alias("k"), *sums).persist(StorageLevel.MEMORY_AND_DISK)
    cuts = values.agg(F.percentile_approx("y", [k / 64 for k in range(1, 64)])).first()[0]
    part = F.size(F.filter(F.array(*[F.lit(float(v)) for v in sorted(set(cuts))]), lambda e: e < F.col("y")))
    parts = values.withColumn("part", part)
    below, done = {}, 0
    for p, k in sorted(parts.groupBy("part").agg(F.sum("k")).collect()):
        below[p], done = done, done + k
    inside = F.sum("k").over(Window.partitionBy("part").orderBy("y").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.create_map(*[F.lit(v) for pair in below.items() for v in pair])[F.col("part")]
    d = F.col("rank") - middle
    terms = [t for i in range(len(features)) for t in (F.sum(d * F.col(f"s{i}")).alias(f"xy{i}"), F.sum(f"q{i}").alias(f"xx{i}"))]
    m = parts.withColumn("rank", before + inside - (F.col("k") - 1) / 2).agg(F.sum(d * d * F.col("k")).alias("yy"), *terms).first()
    values.unpersist()
    return n, np.array([m[f"xy{i}"] / math.sqrt(m["yy"] * m[f"xx{i}"]) if m["yy"] and m[f"xx{i}"] else float("nan") for i in range(len(features))])


def _deviations(rows: DataFrame, centres: dict[str, float]) -> DataFrame:
    return rows.select(*[F.abs(F.col(c) - F.lit(m)).alias(c) for c, m in centres.items()])


def _biweight(rows: DataFrame, names: list[str]) -> DataFrame:
    """Deviations from the median with biweights: rows further than 9 median deviations count for nothing."""
    medians = {c: v[0] for c, v in percentiles(rows, dict.fromkeys(names, [0.5])).items()}
    spread = {c: v[0] for c, v in percentiles(_deviations(rows, medians), dict.fromkeys(names, [0.5])).items()}

    def weighed(c: str) -> Column:
        u = (F.col(c) - F.lit(medians[c])) / F.lit(9 * spread[c]) if spread[c] else F.lit(0.0)
        return F.when(F.abs(u) < 1, (F.col(c) - F.lit(medians[c])) * F.pow(1 - u * u, 2)).otherwise(0.0)

    return rows.select(*[weighed(c).alias(c) for c in names])


def _bent(rows: DataFrame, names: list[str], beta: float = 0.2) -> DataFrame:
    """Deviations from the percentage-bend centre in units of the (1 - beta) order statistic of absolute deviations, cut at 1."""
    n = rows.count()
    k = math.floor((1 - beta) * n + 0.5)
    medians = {c: v[0] for c, v in percentiles(rows, dict.fromkeys(names, [0.5])).items()}
    omega = {c: v[0] for c, v in percentiles(_deviations(rows, medians), dict.fromkeys(names, [(k - 1) / (n - 1) if n > 1 else 0.0]), nearest=True).items()}  # the k-th smallest
    u = {c: (F.col(c) - F.lit(medians[c])) / F.lit(omega[c] or 1.0) for c in names}
    parts = [x for c in names for x in (F.sum((u[c] < -1).cast("int")).alias(f"lo_{c}"), F.sum((u[c] > 1).cast("int")).alias(f"hi_{c}"), F.sum(F.when(F.abs(u[c]) <= 1, F.col(c)).otherwise(0.0)).alias(f"in_{c}"))]
    r = rows.agg(*parts).first()
    centre = {c: (omega[c] * (r[f"hi_{c}"] - r[f"lo_{c}"]) + r[f"in_{c}"]) / max(1, n - r[f"hi_{c}"] - r[f"lo_{c}"]) for c in names}
    return rows.select(*[F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col(c) - F.lit(centre[c])) / F.lit(omega[c] or 1.0))).alias(c) for c in names])


def _raw_correlations(rows: DataFrame, x: str, others: list[str]) -> np.ndarray:
    """Sums of products by the roots of the sums of squares, without centring."""
    product = lambda a, b, name: F.sum(F.col(a) * F.col(b)).alias(name)
    r = rows.agg(product(x, x, "xx"), *[p for i, y in enumerate(others) for p in (product(x, y, f"xy{i}"), product(y, y, f"yy{i}"))]).first()
    return np.array([r[f"xy{i}"] / math.sqrt(r["xx"] * r[f"yy{i}"]) if r["xx"] and r[f"yy{i}"] else float("nan") for i in range(len(others))])


def _inversions(a: np.ndarray, weight: np.ndarray) -> float:
    """Sum of weight_i * weight_j over i < j with a_i > a_j, by merging halves."""
    total, width, n = 0.0, 1, len(a)
    a, weight = a.copy(), weight.astype(float)
    while width < n:
        for low in range(0, n - width, 2 * width):
            mid, high = low + width, min(low + 2 * width, n)
            left, wl = a[low:mid], weight[low:mid]
            after = np.concatenate([np.cumsum(wl[::-1])[::-1], [0.0]])
            total += float(np.sum(weight[mid:high] * after[np.searchsorted(left, a[mid:high], side="right")]))
            order = np.argsort(a[low:high], kind="stable")
            a[low:high], weight[low:high] = a[low:high][order], weight[low:high][order]
        width *= 2
    return total


def kendall(rows: DataFrame, x: str, y: str, most: int = 2_000_000) -> tuple[float, float]:
    """Tau-b and its p-value by the normal approximation with ties. Pairs of values are counted in Spark; the counts, at most ``most``, come to the driver."""
    counts = rows.groupBy(x, y).agg(F.count("*").alias("k"))
    if counts.limit(most + 1).count() > most:
        raise ValueError(f"Kendall's tau takes at most {most} distinct pairs; round the columns")
    c = counts.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), "k").toPandas().sort_values(["x", "y"])
    k = c["k"].to_numpy(float)
    n = k.sum()
    ties = lambda g: g.to_numpy(float)
    tx, ty = ties(c.groupby("x")["k"].sum()), ties(c.groupby("y")["k"].sum())
    pairs = lambda t: float(np.sum(t * (t - 1) / 2))
    discordant = _inversions(c["y"].to_numpy(), k)
    concordant = n * (n - 1) / 2 - pairs(tx) - pairs(ty) + pairs(k) - discordant
    spread = math.sqrt((n * (n - 1) / 2 - pairs(tx)) * (n * (n - 1) / 2 - pairs(ty)))
    if spread <= 0:
        return float("nan"), float("nan")
    v = lambda t: float(np.sum(t * (t - 1) * (2 * t + 5)))
    three = lambda t: float(np.sum(t * (t - 1) * (t - 2)))
    two = lambda t: float(np.sum(t * (t - 1)))
    var = (n * (n - 1) * (2 * n + 5) - v(tx) - v(ty)) / 18 + two(tx) * two(ty) / (2 * n * (n - 1)) + (three(tx) * three(ty) / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0.0)
    z = (concordant - discordant) / math.sqrt(var)
    return (concordant - discordant) / spread, math.erfc(abs(z) / math.sqrt(2))


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
_DRAWN = np.searchsorted(_POISSON, np.arange(65537) / 65536, side="right").astype(float)
_DRAWN = np.where(_DRAWN[:-1] == _DRAWN[1:], _DRAWN[:-1], np.nan)  # unknown where 16 bits don't tell


def _poisson(r: np.random.Generator, shape: tuple[int, int]) -> np.ndarray:
    """Poisson numbers of mean 1: by 16 random bits, and by as many more as a double holds where these fall on a bound between two numbers."""
    u = np.frombuffer(r.bytes(2 * shape[0] * shape[1]), np.uint16)
    out = _DRAWN[u]
    open_ = np.flatnonzero(np.isnan(out))
    out[open_] = np.searchsorted(_POISSON, (u[open_] + r.random(len(open_))) / 65536, side="right")
    return out.reshape(shape)


def shepherd(rows: DataFrame, x: str, features: list[str], boots: int = 200, seed: int = 42) -> list[tuple[float, float, int]]:
    """For each feature: Spearman's correlation with x of the rows whose mean bootstrap Mahalanobis distance is under 6, its p-value doubled, and how many rows
    those are.

    Resampling gives every row a Poisson weight in each of the bootstraps, the same for all features; tasks add up weighted moments of all of them. The mean of
    quadratic forms is one quadratic form, so rows need no second look at the bootstraps."""
    names, width = [x, *features], 3 + 3 * len(features)
    shift = rows.agg(*[F.avg(c).alias(f"v{i}") for i, c in enumerate(names)]).first()
    named = rows.select(*[(F.col(c).cast("double") - F.lit(shift[f"v{i}"])).alias(f"v{i}") for i, c in enumerate(names)])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, part = np.zeros((boots, width)), TaskContext.get().partitionId()
        for batch, frame in enumerate(batches):
            v = frame.to_numpy(float)
            r = np.random.default_rng([seed, part, batch])
            terms = np.column_stack([np.ones(len(v)), v[:, 0], v[:, 0] ** 2, *[t for k in range(1, v.shape[1]) for t in (v[:, k], v[:, 0] * v[:, k], v[:, k] ** 2)]])
            for a in range(0, len(v), 2000):
                total += _poisson(r, (boots, len(terms[a : a + 2000]))) @ terms[a : a + 2000]
        yield pd.DataFrame({"boot": np.arange(boots), **{f"s{k}": total[:, k] for k in range(width)}})

    parts = named.mapInPandas(sums, "boot long, " + ", ".join(f"s{k} double" for k in range(width)))
    found = parts.groupBy("boot").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(width)]).toPandas().to_numpy()[:, 1:]
    n = found[:, 0]
    mx, vxx = found[:, 1] / n, found[:, 2] / n - (found[:, 1] / n) ** 2
    out = []
    for i in range(len(features)):
        sy, sxy, syy = found[:, 3 + 3 * i], found[:, 4 + 3 * i], found[:, 5 + 3 * i]
        my, vxy, vyy = sy / n, sxy / n - mx * sy / n, syy / n - (sy / n) ** 2
        det = vxx * vyy - vxy**2
        a, b, c = vyy / det, -vxy / det, vxx / det
        quadratic = a.mean(), 2 * b.mean(), c.mean()
        line = -2 * (a * mx + b * my).mean(), -2 * (b * mx + c * my).mean()
        rest = (a * mx**2 + 2 * b * mx * my + c * my**2).mean()
        lit = lambda v: F.lit(float(v))
        X, Y = F.col("v0"), F.col(f"v{i + 1}")
        far = lit(quadratic[0]) * X * X + lit(quadratic[1]) * X * Y + lit(quadratic[2]) * Y * Y + lit(line[0]) * X + lit(line[1]) * Y + lit(rest)
        count, (r, *_) = rank_correlations(named.where(far < 6), "v0", [f"v{i + 1}"])
        if count < 3:
            out.append((float("nan"), float("nan"), 0))
            continue
        t = r * r * (count - 2) / max(1 - r * r, 1e-300)
        out.append((r, min(1.0, 2 * betainc((count - 2) / 2, 0.5, (count - 2) / (count - 2 + t))), int(count)))
    return out


METHODS = ("pearson", "spearman", "kendall", "bicor", "percbend", "shepherd")


def correlation_table(
    df: DataFrame, target: str, features: list[str], method: str = "pearson", threshold: float = 0.05, adjust: str = "none",
    drop_insignificant: bool = False, drop_ci_contain_0: bool = False, power: bool = False,
) -> DataFrame:
    """Correlation of each feature with the target by one of ``METHODS``, its 95 % interval, p-value, flags and (on request) power, the largest
    first. Rows with a gap in any of the columns go."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    names = [target, *features]
    rows = df.select(*[col(c).cast("double").alias(c) for c in names]).na.drop()
    p = None
    if method == "spearman":
        count, r = rank_correlations(rows, target, features)
        n = np.full(len(features), count)
    elif method == "pearson":
        m = moments(rows, names)[None]
        r, n = m.cross[0, 1:] / np.sqrt(m.cross[0, 0] * np.diag(m.cross)[1:]), np.full(len(features), m.n)
    elif method in ("bicor", "percbend"):
        turned = _biweight(rows, names) if method == "bicor" else _bent(rows, names)
        r, n = _raw_correlations(turned, target, features), np.full(len(features), rows.count())
    elif method == "kendall":
        found = [kendall(rows, target, f) for f in features]
        r, p, n = np.array([x[0] for x in found]), np.array([x[1] for x in found]), np.full(len(features), rows.count())
    else:
        found = shepherd(rows, target, features)
        r, p, n = (np.array([x[k] for x in found]) for k in range(3))
    spread = 1.959963984540054 / np.sqrt(np.maximum(n - 3, 1))
    z = np.arctanh(np.clip(r, -1 + 1e-15, 1 - 1e-15))
    if p is None:
        t2 = r**2 * (n - 2) / np.maximum(1 - r**2, 1e-300)
        p = np.array([betainc((k - 2) / 2, 0.5, (k - 2) / (k - 2 + x)) for k, x in zip(n, t2)])
    p = _adjusted(p, adjust)
    out = []
    for f, k, a, low, high, v in zip(features, n, r, np.tanh(z - spread), np.tanh(z + spread), p):
        if not (drop_insignificant and v >= threshold or drop_ci_contain_0 and low <= 0 <= high):
            out.append((f, int(k), float(a), float(low), float(high), float(v), bool(round(v, 4) < threshold), bool(low <= 0 <= high), *([correlation_power(float(a), int(k))] if power else [])))
    out.sort(key=lambda x: -x[2] if x[2] == x[2] else np.inf)
    return df.sparkSession.createDataFrame(out, "feature string, n bigint, r double, ci_low double, ci_high double, p double, is_significant boolean, contains_0 boolean" + (", power double" if power else ""))


def style_bands(table: DataFrame, threshold: float = 0.05) -> DataFrame:
    """A correlation table with ``style_band``: insignificant, spans zero, or the size of the correlation."""
    size = F.abs("r")
    steps = F.when(size < 0.1, "negligible").when(size < 0.25, "weak").when(size < 0.5, "moderate").when(size < 0.75, "strong").otherwise("very strong")
    return table.withColumn("style_band", F.when(F.col("p").isNull() | F.isnan("p") | (F.col("p") > threshold), "insignificant").when(F.col("contains_0"), "spans zero").otherwise(steps))


def robust_moments(df: DataFrame, features: list[str], starts: int = 20, rounds: int = 10, seed: int = 42) -> Moments:
    """Mean and covariance of the half of the rows that lies closest together (minimum covariance determinant), scaled to all rows.

    Each start takes p + 1 rows by hash order and then, a pass a round, the half of all rows nearest the present centre; all starts go side by side.
    Cuts are approximate medians of distances, so the half is exact up to their error."""
    rows = df.select(*[col(f).cast("double").alias(f) for f in features]).na.drop()
    p, n = len(features), rows.count()
    if n <= p + 1:
        raise ValueError("too few complete rows")
    share = (n + p + 1) / (2 * n)
    first = rows.orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(starts * (p + 1)).toPandas().to_numpy(float)
    states = []
    for k in range(0, len(first) - p, p + 1):
        x = first[k : k + p + 1]
        states.append((x.mean(axis=0), np.cov(x, rowvar=False).reshape(p, p) + 1e-9 * np.eye(p)))

    def square(state: tuple[np.ndarray, np.ndarray]) -> Column:
        inv = np.linalg.inv(state[1])
        dev = [F.col(f) - F.lit(float(c)) for f, c in zip(features, state[0])]
        return sum((dev[i] * dev[j] * F.lit(float(inv[i, j])) for i in range(p) for j in range(p)), F.lit(0.0))

    def step(states: list) -> list[tuple[float, np.ndarray, np.ndarray]]:
        far = rows.select(*features, *[square(s).alias(f"__d{k}") for k, s in enumerate(states)])
        cuts = far.agg(*[F.percentile_approx(f"__d{k}", share, 10_000).alias(f"c{k}") for k in range(len(states))]).first()
        ok = [(F.col(f"__d{k}") <= F.lit(cuts[k])).cast("double") for k in range(len(states))]
        sums = [x for k, w in enumerate(ok) for x in (F.sum(w).alias(f"n{k}"), *[F.sum(w * F.col(f)).alias(f"s{k}_{i}") for i, f in enumerate(features)], *[F.sum(w * F.col(f) * F.col(g)).alias(f"q{k}_{i}_{j}") for i, f in enumerate(features) for j, g in enumerate(features) if i <= j])]
        r = far.agg(*sums).first()
        out = []
        for k in range(len(states)):
            mean = np.array([r[f"s{k}_{i}"] for i in range(p)]) / r[f"n{k}"]
            cov = np.array([[r[f"q{k}_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) / r[f"n{k}"] - np.outer(mean, mean)
            out.append((float(np.linalg.slogdet(cov + 1e-12 * np.eye(p))[1]), mean, cov + 1e-12 * np.eye(p)))
        return out

    best = [(np.inf, *s) for s in states]
    for number in range(rounds):
        new = step([b[1:] for b in best])
        done = all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(new, best))
        best = sorted(new, key=lambda x: x[0])[: max(1, len(new) // 2) if number == 1 else len(new)]
        if done:
            break
    _, mean, cov = min(best, key=lambda x: x[0])
    # consistent for normal rows: the median squared distance should be the chi-square median
    middle = rows.agg(F.percentile_approx(square((mean, cov)), 0.5, 10_000)).first()[0]
    return Moments(features, n, mean, cov * (n - 1) * middle / chi_square(0.5, p))


def chi_square(p: float, dof: int) -> float:
    """Quantile of the chi-square distribution."""
    low, high = 0.0, 1.0
    while gammainc(dof / 2, high / 2) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if gammainc(dof / 2, mid / 2) < p else (low, mid)
    return high


#: Groups whose means and matrices may go to every task.
MOST_GROUPS = 100_000


def mahalanobis(
    df: DataFrame, features: list[str], by: str | None = None, regularization: float = 1e-6, level: float = 0.05, reference: DataFrame | None = None,
    mean: list[float] | None = None, covariance: list[list[float]] | None = None, robust: bool = False,
) -> DataFrame:
    """Distance of each row from the centre of all rows, of its group, of ``reference`` rows, or from a given mean and covariance; its chi-square
    p-value and flag. ``robust``: centre and covariance of the closest half. The quadratic form is a column."""
    if not 0 < level < 1 or regularization < 0:
        raise ValueError("the level must lie in (0, 1), the regularization must not be negative")
    k = len(features)
    spark = df.sparkSession
    if covariance is not None:
        fitted = {None: Moments(features, 2.0, np.array(mean if mean is not None else [0.0] * k, float), np.array(covariance, float))}
    elif robust and by is None:
        fitted = {None: robust_moments(df if reference is None else reference, features)}
    elif robust:
        keys = [r[0] for r in df.select(by).where(F.col(by).isNotNull()).distinct().limit(1001).collect()]
        if len(keys) > 1000:
            raise ValueError("robust distances take at most 1000 groups")
        fitted = {key: robust_moments(df.where(F.col(by) == F.lit(key)), features) for key in keys}
    else:
        fitted = moments(df if reference is None else reference, features, by)
    if len(fitted) > MOST_GROUPS:
        raise ValueError(f"distances take at most {MOST_GROUPS} groups")
    if mean is not None and covariance is None:
        fitted = {key: Moments(m.names, m.n, np.array(mean, float), m.cross) for key, m in fitted.items()}
    rows = [(key, [float(x) for x in m.mean], [float(x) for x in np.linalg.pinv(m.covariance() + regularization * np.eye(k)).ravel()]) for key, m in fitted.items() if m.n > 1]
    kind = df.schema[by].dataType.simpleString() if by else "string"
    state = F.broadcast(spark.createDataFrame(rows, f"__key {kind}, __mean array<double>, __inv array<double>"))
    joined = df.join(state, F.col(by) == F.col("__key"), "left") if by else df.crossJoin(state)
    dev = [col(f) - F.col("__mean")[i] for i, f in enumerate(features)]
    square = sum((dev[i] * dev[j] * F.col("__inv")[i * k + j] for i in range(k) for j in range(k)), F.lit(0.0))
    work = joined.withColumn("mahalanobis", F.sqrt(F.greatest(square, F.lit(0.0)))).drop("__key", "__mean", "__inv")
    x = F.pow("mahalanobis", 2)
    if k == 2:
        return work.withColumn("p_value", F.exp(-x / 2)).withColumn("is_outlier", F.col("p_value") < level)
    tail = F.pandas_udf(lambda s: s.map(lambda v: 1 - gammainc(k / 2, v / 2)), "double")
    return work.withColumn("p_value", tail(x)).withColumn("is_outlier", x > chi_square(1 - level, k))


def _expm(a: np.ndarray) -> np.ndarray:
    """Matrix exponential: scaling and squaring of its Taylor sum."""
    squarings = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(axis=1).max(initial=0.0), 1e-12)))) + 4)
    x, out = a / 2**squarings, np.eye(len(a))
    term = np.eye(len(a))
    for k in range(1, 18):
        term = term @ x / k
        out = out + term
    for _ in range(squarings):
        out = out @ out
    return out


def notears(df: DataFrame, names: list[str], penalty: float = 0.05, threshold: float = 0.25, rounds: int = 30) -> DataFrame:
    """Weights of a linear acyclic graph by a continuous acyclicity constraint; only second moments leave Spark. Weak edges and what still closes a cycle go."""
    c = moments(df, names)[None].second()
    d = len(names)
    free = ~np.eye(d, dtype=bool)
    # a start off the symmetric saddle, where an edge and its reverse would shrink together
    w, dual, rho, before = np.where(free, np.random.default_rng(0).normal(0, 0.05, (d, d)), 0.0), 0.0, 1.0, np.inf
    scale = 1 / max(np.diag(c).max(), 1e-12)
    for _ in range(rounds):
        # steps are tried and halved until the penalised loss falls
        def loss(v: np.ndarray) -> float:
            h = np.trace(_expm(v * v)) - d
            left = np.eye(d) - v
            return float(scale * np.sum((c @ left) * left) / 2 + dual * h + rho / 2 * h * h + penalty * scale * np.abs(v).sum())  # noqa: B023

        size, now = 1.0, loss(w)
        for _ in range(300):
            e = _expm(w * w)
            grad = (c @ (w - np.eye(d))) * scale + (dual + rho * (np.trace(e) - d)) * 2 * w * e.T
            while size > 1e-12:
                v = w - size * grad
                v = np.where(free, np.sign(v) * np.maximum(np.abs(v) - size * penalty * scale, 0), 0.0)
                then = loss(v)
                if then <= now:
                    break
                size /= 2
            if size <= 1e-12 or now - then < 1e-10:
                break
            w, now, size = v, then, size * 1.5
        h = np.trace(_expm(w * w)) - d
        dual += rho * h
        if h < 1e-6:
            break
        rho, before = (rho * 4 if h > 0.5 * before else rho), h
    w = np.where(np.abs(w) < threshold, 0.0, w)
    while np.trace(np.linalg.matrix_power((w != 0).astype(float) + np.eye(d), d)) - d > 0.5 and _has_cycle(w):
        edges = np.argwhere(w != 0)
        i, j = min(map(tuple, edges), key=lambda x: abs(w[x]) if _reaches(w, x[1], x[0]) else np.inf)
        w[i, j] = 0
    rows = [(names[i], names[j], float(w[i, j])) for i in range(d) for j in range(d) if w[i, j]]
    return df.sparkSession.createDataFrame(rows, "cause string, effect string, weight double")


def _reaches(w: np.ndarray, a: int, b: int) -> bool:
    seen, todo = set(), [a]
    while todo:
        v = todo.pop()
        if v == b:
            return True
        if v not in seen:
            seen.add(v)
            todo += np.flatnonzero(w[v]).tolist()
    return False


def _has_cycle(w: np.ndarray) -> bool:
    return any(_reaches(w, int(j), int(i)) for i, j in np.argwhere(w != 0))


def total_effects(weights: DataFrame, names: list[str]) -> DataFrame:
    """Direct and total effect of every ordered pair: powers of the weights summed up."""
    at, w = {n: k for k, n in enumerate(names)}, np.zeros((len(names),) * 2)
    for r in weights.collect():
        w[at[r["cause"]], at[r["effect"]]] = r["weight"]
    total = np.linalg.inv(np.eye(len(names)) - w) - np.eye(len(names))
    rows = [(a, b, float(w[i, j]), float(total[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i != j]
    return weights.sparkSession.createDataFrame(rows, "cause string, effect string, direct double, total double")


def causal_order(weights: DataFrame, names: list[str]) -> DataFrame:
    """Each variable's depth in the graph (the longest way from a root), and whether it is a root or a sink."""
    edges = [(r["cause"], r["effect"]) for r in weights.select("cause", "effect").collect()]
    depth = dict.fromkeys(names, 0)
    for _ in names:
        for a, b in edges:
            depth[b] = max(depth[b], depth[a] + 1)
    causes, effects = {a for a, _ in edges}, {b for _, b in edges}
    rows = [(n, depth[n], n not in effects, n not in causes) for n in names]
    return weights.sparkSession.createDataFrame(rows, "node string, depth bigint, is_root boolean, is_sink boolean")


def diagnose_confounding(effects: DataFrame, cause: str, effect: str, correlation: float) -> DataFrame:
    """What lies behind a correlation of two variables, given the fitted graph's effects."""
    e = {(r["cause"], r["effect"]): (r["direct"], r["total"]) for r in effects.collect()}
    names = {a for a, _ in e}
    direct, total = e[cause, effect]
    back = e[effect, cause][1]
    shared = sorted(z for z in names - {cause, effect} if abs(e[z, cause][1]) > 1e-9 and abs(e[z, effect][1]) > 1e-9)
    if abs(back) > 1e-9:
        verdict = "reverse causation"
    elif abs(total) < 1e-9:
        verdict = "spurious: common causes" if shared else "unrelated" if abs(correlation) < 0.1 else "unexplained correlation"
    elif shared:
        verdict = "causal and confounded"
    else:
        verdict = "direct cause" if abs(direct) > 1e-9 and abs(direct - total) < 1e-9 else "cause through mediators" if abs(direct) < 1e-9 else "direct and mediated cause"
    rows = [(cause, effect, direct, total, float(correlation), ",".join(shared), verdict)]
    return effects.sparkSession.createDataFrame(rows, "cause string, effect string, direct double, total double, correlation double, confounders string, verdict string")
