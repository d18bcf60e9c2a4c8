"""Recursive and fitted models of series: one kernel call for each series, series in parallel.

``series(df, ...)`` deals rows by series and sorts each task's rows once; a task then runs through its series in Arrow batches and hands numpy
arrays to a kernel. One series is one call, as these recurrences have an order: a very long series is one task's work either way.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Kernel = Callable[..., dict[str, np.ndarray]]


def _whole_series(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of whole series, in order, with where each series begins. The last series of a batch waits for the rest of it."""
    open_: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        rows = pd.concat([*open_[-1:], batch], ignore_index=True) if open_ else batch
        known = rows[by]
        same = ((known == known.shift()) | (known.isna() & known.shift().isna())).all(axis=1).to_numpy()
        same[0] = False
        starts = np.flatnonzero(~same)
        # open_ holds the parts of the open series; only its last part was compared with this batch
        part = len(open_[-1]) if open_ else 0
        cut = starts[-1]
        if cut < max(part, 1):
            open_ = [*open_[:-1], *([open_[-1]] if open_ else []), batch]
            continue
        done = pd.concat([*open_[:-1], rows.iloc[:cut]], ignore_index=True)
        shift = len(done) - cut
        yield done, np.concatenate([[0], starts[(starts > 0) & (starts < cut)] + shift])
        open_ = [rows.iloc[cut:]]
    if open_:
        yield pd.concat(open_, ignore_index=True), np.zeros(1, np.int64)


def series(df: DataFrame, by: list[str], order: str, value: str | list[str], kernel: Kernel, outputs: list[str], whole: bool = False) -> DataFrame:
    """Rows (or with ``whole`` one row a series, or more) with the kernel's outputs as doubles, or as named in ``outputs`` ("name type").
    A kernel gets one array for each value column."""
    values = [value] if isinstance(value, str) else value
    keep = by if whole else list(dict.fromkeys([*by, order, *values]))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    kinds = ", ".join(f"`{o}` double" if " " not in o else o for o in outputs)
    names = [o.split()[0] for o in outputs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, starts in _whole_series(batches, by):
            arrays = [rows[v].to_numpy(float) for v in values]
            ends = [*starts[1:], len(rows)]
            found = [kernel(*(x[i:j] for x in arrays)) for i, j in zip(starts, ends)]
            if whole:
                sizes = [max((np.size(v) for v in f.values() if not isinstance(v, list)), default=1) for f in found]
                keys = rows[by].iloc[np.repeat(starts, sizes)].reset_index(drop=True)
                cells = {n: [y for f, size in zip(found, sizes) for y in ([f[n]] * size if isinstance(f[n], list) else np.broadcast_to(f[n], size))] for n in names}
                yield keys.assign(**cells)
            else:
                yield rows[keep].assign(**{n: np.concatenate([np.broadcast_to(f[n], j - i) for f, i, j in zip(found, starts, ends)]) for n in names})

    rows = df.select(*dict.fromkeys([*by, order, *values]))
    dealt = rows.repartition(*by) if by else rows.coalesce(1)
    return dealt.sortWithinPartitions(*by, order).mapInPandas(run, f"{fields}, {kinds}" if fields else kinds)


def decay(span: float | None = None, half_life: float | None = None, alpha: float | None = None, default_span: float = 12) -> float:
    """Smoothing factor of a span, a half-life or itself."""
    if alpha is not None:
        return alpha
    if half_life is not None:
        return 1 - 0.5 ** (1 / half_life)
    return 2 / ((span or default_span) + 1)


def ewma_kernel(x: np.ndarray, alpha: float) -> np.ndarray:
    """Recursive mean; a gap repeats the value and goes on decaying it."""
    out, state, old = np.empty(len(x)), np.nan, 1.0
    for k, v in enumerate(x):
        if np.isnan(state):
            state = v
        else:
            old *= 1 - alpha
            if not np.isnan(v):
                state = (old * state + alpha * v) / (old + alpha)
                old = 1.0
        out[k] = state
    return out


def ewma(df: DataFrame, by: list[str], order: str, value: str, span: float | None = None, half_life: float | None = None, alpha: float | None = None) -> DataFrame:
    a = decay(span, half_life, alpha)
    return series(df, by, order, value, lambda x: {"ewma": ewma_kernel(x, a)}, ["ewma"])


def ewms_kernel(x: np.ndarray, rate: float) -> np.ndarray:
    """Decayed sum; a gap adds nothing and shows nothing."""
    out, state = np.empty(len(x)), 0.0
    for k, v in enumerate(x):
        state = rate * state + (0.0 if np.isnan(v) else v)
        out[k] = np.nan if np.isnan(v) else state
    return out


def ewms(df: DataFrame, by: list[str], order: str, value: str, half_life: float | None = None, span: float | None = None, alpha: float | None = None, decay_rate: float | None = None) -> DataFrame:
    rate = decay_rate if decay_rate is not None else 0.5 ** (1 / half_life) if half_life is not None else 1 - decay(span, None, alpha) if span or alpha is not None else 0.5 ** (1 / 8)
    if not 0 <= rate < 1:
        raise ValueError("the rate must lie in [0, 1)")
    return series(df, by, order, value, lambda x: {"ewms": ewms_kernel(x, rate)}, ["ewms"])


def poisson_ewma(df: DataFrame, by: list[str], order: str, value: str, alpha: float = 0.2, baseline: float | None = None) -> DataFrame:
    """EWMA of counts and its z-score against the baseline mean (default: the series' own)."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        mean = np.nanmean(x) if baseline is None else baseline
        e = ewma_kernel(x, alpha)
        return {"ewma": e, "z": (e - mean) / np.sqrt(alpha / (2 - alpha) * max(1e-6, mean))}

    return series(df, by, order, value, kernel, ["ewma", "z"])


#: How the best candidate of a scan is found by each criterion.
_BEST = {"rmse_one_step": np.nanargmin, "mae_one_step": np.nanargmin, "aic": np.nanargmin, "bic": np.nanargmin, "noise_reduction": np.nanargmin, "correlation": np.nanargmax, "target_correlation": np.nanargmax, "target_r2": np.nanargmax}


def ewma_span_scan(df: DataFrame, by: list[str], order: str, value: str, spans: list[float] | None = None, half_lives: list[float] | None = None, target: str | None = None, criterion: str = "rmse_one_step") -> DataFrame:
    """One-step and in-sample errors of each span (or half-life), information criteria, how much noise goes, the correlation with the series and, with
    ``target``, with that; and the best by the criterion."""
    if criterion not in _BEST or criterion.startswith("target") and target is None:
        raise ValueError(f"unknown criterion {criterion}")
    alphas = [decay(half_life=h) for h in half_lives] if half_lives else [decay(s) for s in spans or (2, 4, 8, 12, 26, 52)]
    if not all(0 < a < 1 for a in alphas):
        raise ValueError("spans must be over 1 and half-lives over 0")

    def spread(x: np.ndarray) -> float:
        return float(np.nanstd(x, ddof=1)) if len(x) > 1 else np.nan

    def related(x: np.ndarray, y: np.ndarray) -> float:
        ok = ~(np.isnan(x) | np.isnan(y))
        return float(np.corrcoef(x[ok], y[ok])[0, 1]) if ok.sum() > 2 and x[ok].std() > 0 and y[ok].std() > 0 else np.nan

    def kernel(x: np.ndarray, *wanted: np.ndarray) -> dict[str, np.ndarray]:
        rows = []
        for a in alphas:
            e = ewma_kernel(x, a)
            step, fit = x[1:] - e[:-1], x - e
            n, mse = len(step), max(np.nanmean(step**2), 1e-300)
            noise = spread(np.diff(e)) / (spread(np.diff(x)) or np.nan)
            r = related(e, wanted[0]) if wanted else np.nan
            rows.append((2 / a - 1, np.log(0.5) / np.log(1 - a), np.sqrt(mse), np.nanmean(np.abs(step)), np.sqrt(np.nanmean(fit**2)), n * np.log(mse) + 2, n * np.log(mse) + np.log(n), noise, related(x, e), r, r * r))
        out = dict(zip(names, np.array(rows).T))
        best = _BEST[criterion](out[criterion]) if not np.isnan(out[criterion]).all() else -1
        return out | {"is_optimal": (np.arange(len(rows)) == best).astype(float)}

    names = ["span", "half_life", "rmse_one_step", "mae_one_step", "rmse_in_sample", "aic", "bic", "noise_reduction", "correlation", "target_correlation", "target_r2"]
    return series(df, by, order, [value, *([target] if target else [])], kernel, [*names, "is_optimal"], whole=True)


def _search(f: Callable[[np.ndarray], float], start: np.ndarray, low: np.ndarray, high: np.ndarray, steps: int = 400) -> np.ndarray:
    """Bounded simplex search (reflect, expand, contract, shrink) from a start inside the bounds."""
    n = len(start)
    points = [np.clip(start, low, high)]
    for k in range(n):
        p = points[0].copy()
        p[k] = p[k] + 0.15 * (high[k] - low[k]) if p[k] < (low[k] + high[k]) / 2 else p[k] - 0.15 * (high[k] - low[k])
        points.append(p)
    worth = [f(p) for p in points]
    for _ in range(steps):
        order = np.argsort(worth)
        points, worth = [points[k] for k in order], [worth[k] for k in order]
        if abs(worth[-1] - worth[0]) < 1e-10 * (1 + abs(worth[0])):
            break
        center = np.mean(points[:-1], axis=0)
        move = lambda t: np.clip(center + t * (points[-1] - center), low, high)  # noqa: B023, E731
        p = move(-1.0)
        v = f(p)
        if v < worth[0]:
            q = move(-2.0)
            w = f(q)
            p, v = (q, w) if w < v else (p, v)
        elif v >= worth[-2]:
            p = move(0.5)
            v = f(p)
            if v >= worth[-1]:
                points = [points[0]] + [(points[0] + x) / 2 for x in points[1:]]
                worth = [worth[0]] + [f(x) for x in points[1:]]
                continue
        points[-1], worth[-1] = p, v
    return points[int(np.argmin(worth))]


@dataclass
class SmoothingResult:
    """A fitted Holt or Holt-Winters model: parameters, states after each value, one-step fits, forecast and information criteria."""

    alpha: float
    beta: float
    gamma: float
    phi: float
    period: int
    sse: float
    aic: float
    bic: float
    fitted: np.ndarray
    level: np.ndarray
    trend: np.ndarray
    season: np.ndarray
    forecast: np.ndarray

    def to_dict(self) -> dict[str, object]:
        return {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(self).items()}


def smooth(x: np.ndarray, alpha: float | None = None, beta: float | None = None, gamma: float | None = None, period: int = 0, damped: bool = False, horizon: int = 0, seasonal: str = "add") -> SmoothingResult:
    """Level, trend and (with a period) an additive or multiplicative season; parameters that aren't given minimise the one-step squared error.
    Criteria count the smoothing parameters and the initial states."""
    if seasonal not in ("add", "mul"):
        raise ValueError(f"unknown season {seasonal}")
    x = np.asarray(x, float)
    x = np.where(np.isnan(x), np.nanmean(x), x)
    m, times = (period if period and len(x) >= 2 * period else 0), seasonal == "mul"
    season0 = (x[:m] / x[:m].mean() if times else x[:m] - x[:m].mean()) if m else np.zeros(0)
    trend0 = (x[m : 2 * m].mean() - x[:m].mean()) / m if m else (x[1] - x[0] if len(x) > 1 else 0.0)
    level0 = x[:m].mean() if m else x[0] - trend0  # the level before the first value

    def go(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b, g, phi = p
        level, trend, season = level0, trend0, season0.copy()
        fit, levels, trends, seasons = (np.empty(len(x)) for _ in range(4))
        for k, v in enumerate(x):
            s = season[k % m] if m else float(times)
            ahead = level + phi * trend
            fit[k] = ahead * s if times else ahead + s
            new = a * (v / s if times else v - s) + (1 - a) * ahead
            trend = b * (new - level) + (1 - b) * phi * trend
            if m:
                season[k % m] = g * (v / ahead if times else v - ahead) + (1 - g) * s
            level = new
            levels[k], trends[k], seasons[k] = level, trend, season[k % m] if m else float(times)
        return fit, levels, trends, seasons, season

    given = [alpha, beta, gamma if m else 0.0, 0.98 if damped else 1.0]
    free = [k for k in range(3) if given[k] is None]

    def full(p: np.ndarray) -> np.ndarray:
        out = np.array([0.0 if g is None else g for g in given])
        out[free] = p
        return out

    best = full(_search(lambda p: float(np.sum((x - go(full(p))[0]) ** 2)), np.full(len(free), 0.3), np.full(len(free), 1e-4), np.full(len(free), 0.9999))) if free else full(np.empty(0))
    fit, levels, trends, seasons, season = go(best)
    steps = np.arange(1, horizon + 1)
    ahead = levels[-1] + np.cumsum(best[3] ** steps) * trends[-1]
    again = season[(len(x) + steps - 1) % m] if m else float(times)
    sse, n, k = float(np.sum((x - fit) ** 2)), len(x), (3 + m if m else 2) + 2 + damped
    spread = n * np.log(max(sse, 1e-300) / n)
    return SmoothingResult(*(float(v) for v in best), m, sse, float(spread + 2 * k), float(spread + k * np.log(n)), fit, levels, trends, seasons, ahead * again if times else ahead + again)


def smoothing_kernel(x: np.ndarray, *given: float | None, **options: object) -> dict[str, np.ndarray]:
    r = smooth(x, *given, **options)
    return {"fit": r.fitted, "forecast": r.forecast, "parameters": np.array([r.alpha, r.beta, r.gamma, r.phi])}


def exponential_smoothing(df: DataFrame, by: list[str], order: str, value: str, **options: object) -> DataFrame:
    """Fitted values, residuals and states of double, or with ``period`` triple, exponential smoothing."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        r = smooth(x, **options)
        return {"fitted": r.fitted, "residual": x - r.fitted, "level": r.level, "trend": r.trend, "season": r.season}

    return series(df, by, order, value, kernel, ["fitted", "residual", "level", "trend", "season"])


def smoothing_models(df: DataFrame, by: list[str], order: str, value: str, horizon: int = 0, **options: object) -> DataFrame:
    """One row a series: parameters, squared error, information criteria and the forecast."""

    def kernel(x: np.ndarray) -> dict[str, object]:
        r = smooth(x, horizon=horizon, **options)
        return {"alpha": r.alpha, "beta": r.beta, "gamma": r.gamma, "sse": r.sse, "aic": r.aic, "bic": r.bic, "forecast": r.forecast.tolist()}

    return series(df, by, order, value, kernel, ["alpha", "beta", "gamma", "sse", "aic", "bic", "forecast array<double>"], whole=True)


@dataclass(frozen=True)
class SingularSpectrum:
    """Singular spectrum analysis with its settings: components of a series, their shares of the variance, and the baseline."""

    window: int | None = None
    top_k: int = 3
    variance: float | None = None

    def shares(self, x: np.ndarray) -> np.ndarray:
        """Share of each component in the trajectory matrix's sum of squares, largest first."""
        s = np.linalg.svd(_trajectory(x, self.window), compute_uv=False) ** 2
        return s / s.sum()

    def components(self, x: np.ndarray) -> np.ndarray:
        """The leading components as series; they add up to the baseline."""
        u, s, vt = np.linalg.svd(_trajectory(x, self.window), full_matrices=False)
        return np.array([_averaged(np.outer(u[:, k] * s[k], vt[k])) for k in range(_kept(s, self.top_k, self.variance))])

    def baseline(self, x: np.ndarray) -> np.ndarray:
        return ssa_kernel(x, self.window, self.top_k, self.variance)

    def transform(self, df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
        return ssa_baseline(df, by, order, value, self.window, self.top_k, self.variance)


def _trajectory(x: np.ndarray, window: int | None) -> np.ndarray:
    n = len(x)
    if n < 4:
        raise ValueError("at least four values are needed")
    known = ~np.isnan(x)
    x = np.interp(np.arange(n), np.flatnonzero(known), x[known])
    size = int(np.clip(window or min(max(4, n // 3), 30), 2, n // 2))
    return np.lib.stride_tricks.sliding_window_view(x, size).T


def _kept(s: np.ndarray, top_k: int, variance: float | None) -> int:
    return int(np.searchsorted(np.cumsum(s**2) / np.sum(s**2), variance) + 1) if variance else min(top_k, len(s))


def _averaged(part: np.ndarray) -> np.ndarray:
    place = np.add.outer(np.arange(part.shape[0]), np.arange(part.shape[1]))
    return np.bincount(place.ravel(), part.ravel()) / np.bincount(place.ravel())


def ssa_kernel(x: np.ndarray, window: int | None = None, top_k: int = 3, variance: float | None = None) -> np.ndarray:
    """Baseline of the leading components of the trajectory matrix, averaged over its anti-diagonals."""
    u, s, vt = np.linalg.svd(_trajectory(x, window), full_matrices=False)
    k = _kept(s, top_k, variance)
    return _averaged((u[:, :k] * s[:k]) @ vt[:k])


def ssa_baseline(df: DataFrame, by: list[str], order: str, value: str, window: int | None = None, top_k: int = 3, variance: float | None = None) -> DataFrame:
    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        base = ssa_kernel(x, window, top_k, variance)
        return {"baseline": base, "residual": x - base, "imputed": np.isnan(x).astype(float)}

    return series(df, by, order, value, kernel, ["baseline", "residual", "imputed"])


@dataclass
class Garch:
    """GARCH(p, q) with a constant mean by Gaussian likelihood. ``arch``: weights of the last squared shocks, ``garch``: of the last variances."""

    mean: float
    omega: float
    arch: np.ndarray
    garch: np.ndarray
    volatility: np.ndarray
    shocks: np.ndarray
    loglik: float
    aic: float
    bic: float

    @classmethod
    def fit(cls, x: np.ndarray, p: int = 1, q: int = 1) -> Garch:
        """``p``: lags of the variance, ``q``: of the shocks. Flat and very short series have a constant variance."""
        x = np.asarray(x, float)
        x = x[~np.isnan(x)]
        mean, scale = (x.mean() if len(x) else np.nan), (x.std(ddof=1) if len(x) > 1 else 0.0)
        if scale <= 1e-6 or len(x) < 5:
            return cls(mean, scale**2, np.zeros(q), np.zeros(p), np.full(len(x), scale), x - mean, np.nan, np.nan, np.nan)
        e = (x - mean) / scale
        lags = max(p, q)

        def variances(w: np.ndarray) -> np.ndarray:
            h, a, b = np.ones(len(e)), w[1 : 1 + q], w[1 + q :]
            for k in range(1, len(e)):
                # before the first value, squared shocks and variances are one
                h[k] = w[0] + sum(a[j] * (e[k - 1 - j] ** 2 if k - 1 - j >= 0 else 1.0) for j in range(q)) + sum(b[j] * (h[k - 1 - j] if k - 1 - j >= 0 else 1.0) for j in range(p))
            return h

        def loss(w: np.ndarray) -> float:
            if w[1:].sum() >= 0.9999:
                return 1e12
            h = np.maximum(variances(w), 1e-8)
            return float(np.sum(np.log(h) + e**2 / h))

        start = np.array([0.1, *np.full(q, 0.1 / q), *np.full(p, 0.8 / p)])
        best = _search(loss, start, np.array([1e-4, *np.zeros(q + p)]), np.array([2.0, *np.full(q, 0.9), *np.full(p, 0.999)]), 400 * lags)
        loglik, k = -0.5 * (loss(best) + len(e) * (np.log(2 * np.pi) + 2 * np.log(scale))), 2 + p + q
        return cls(mean, best[0] * scale**2, best[1 : 1 + q], best[1 + q :], np.sqrt(variances(best)) * scale, e * scale, loglik, 2 * k - 2 * loglik, k * np.log(len(e)) - 2 * loglik)

    def predict(self, horizon: int = 1) -> np.ndarray:
        """Variances ahead: unknown squared shocks are taken at their expected value."""
        shocks, h = list(self.shocks**2), list(self.volatility**2)
        for _ in range(horizon):
            new = self.omega + sum(a * shocks[-1 - j] for j, a in enumerate(self.arch)) + sum(b * h[-1 - j] for j, b in enumerate(self.garch))
            shocks.append(new)
            h.append(new)
        return np.array(h[len(h) - horizon :])


def garch_kernel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """GARCH(1, 1): parameters (mean, omega, alpha, beta) and conditional volatility."""
    m = Garch.fit(x)
    return np.array([m.mean, m.omega, m.arch[0], m.garch[0]]), m.volatility


def garch_volatility(df: DataFrame, by: list[str], order: str, value: str, p: int = 1, q: int = 1) -> DataFrame:
    return series(df.where(F.col(value).isNotNull()), by, order, value, lambda x: {"volatility": Garch.fit(x, p, q).volatility}, ["volatility"])


def garch_forecast(df: DataFrame, by: list[str], order: str, value: str, horizon: int = 1, p: int = 1, q: int = 1) -> DataFrame:
    """Parameters, information criteria, and variance and volatility of each step ahead."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        m = Garch.fit(x, p, q)
        v = m.predict(horizon)
        return {"step": np.arange(1.0, horizon + 1), "variance": v, "volatility": np.sqrt(v), "omega": m.omega, "persistence": m.arch.sum() + m.garch.sum(), "aic": m.aic, "bic": m.bic}

    return series(df.where(F.col(value).isNotNull()), by, order, value, kernel, ["step", "variance", "volatility", "omega", "persistence", "aic", "bic"], whole=True)


def rolling_garch_kernel(x: np.ndarray, window: int, step: int = 1, least: int | None = None) -> np.ndarray:
    """Latest volatility of a model refitted every ``step`` rows to the last ``window`` values; between, the last fit's."""
    out, last = np.full(len(x), np.nan), np.nan
    for k in range(len(x)):
        part = x[max(0, k - window + 1) : k + 1]
        if (~np.isnan(part)).sum() >= (least or window):
            if np.isnan(last) or (k % step) == 0:
                last = garch_kernel(part)[1][-1]
            out[k] = last
    return out


def rolling_garch(df: DataFrame, by: list[str], order: str, value: str, window: int, step: int = 1, least: int | None = None, periods_per_year: int | None = None) -> DataFrame:
    scale = np.sqrt(periods_per_year) if periods_per_year else 1.0
    return series(df, by, order, value, lambda x: {"volatility": rolling_garch_kernel(x, window, step, least) * scale}, ["volatility"])


@dataclass
class HiddenMarkov:
    """Gaussian hidden Markov model with diagonal covariances; states in order of their mean in the first column."""

    columns: list[str]
    start: np.ndarray
    move: np.ndarray
    means: np.ndarray
    deviations: np.ndarray
    loglik: float = float("nan")

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None, :] - self.means) / self.deviations
        return np.exp(-0.5 * (z**2).sum(axis=2)) / self.deviations.prod(axis=1) + 1e-300

    def _passes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        b, n = self._emissions(x), len(x)
        f, c, g = np.empty(b.shape), np.empty(n), np.ones(b.shape)
        for k in range(n):
            f[k] = (self.start if k == 0 else f[k - 1] @ self.move) * b[k]
            c[k] = f[k].sum()
            f[k] /= c[k]
        for k in range(n - 2, -1, -1):
            g[k] = self.move @ (b[k + 1] * g[k + 1]) / c[k + 1]
        return b, f, c, g

    @classmethod
    def fit(cls, x: np.ndarray, states: int = 3, rounds: int = 150, columns: list[str] | None = None) -> HiddenMarkov:
        """Expectation-maximisation from quantiles; ``x``: rows, or rows by columns. Gaps take the column's mean."""
        x = np.asarray(x, float).reshape(len(x), -1)
        x = np.where(np.isnan(x), np.nanmean(x, axis=0), x)
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9)
        m = cls(columns or [f"x{k}" for k in range(x.shape[1])], np.full(states, 1 / states), move, np.quantile(x, (np.arange(states) + 0.5) / states, axis=0), np.tile(x.std(axis=0) + 1e-6, (states, 1)))
        before = -np.inf
        for _ in range(rounds):
            b, f, c, g = m._passes(x)
            post = f * g
            pairs = (f[:-1].T @ (b[1:] * g[1:] / c[1:, None])) * m.move + 1e-9
            weight = (post.sum(axis=0) + 1e-9)[:, None]
            means = post.T @ x / weight
            square = np.einsum("ns,nsd->sd", post, (x[:, None, :] - means) ** 2) / weight
            m = cls(m.columns, post[0] / post[0].sum(), pairs / pairs.sum(axis=1, keepdims=True), means, np.sqrt(np.maximum(square, 1e-6)), float(np.log(c).sum()))
            if m.loglik - before < 1e-6:
                break
            before = m.loglik
        order = np.argsort(m.means[:, 0])
        return cls(m.columns, m.start[order], m.move[np.ix_(order, order)], m.means[order], m.deviations[order], m.loglik)

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        """Posterior of each state at each row of a sequence, new or old."""
        x = np.asarray(x, float).reshape(len(x), -1)
        _, f, _, g = self._passes(np.where(np.isnan(x), self.start @ self.means, x))
        return f * g / (f * g).sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.predict_proba(x).argmax(axis=1)

    def profile(self, x: np.ndarray) -> list[dict[str, float]]:
        """Share of the rows, mean and deviation of each state."""
        found = self.predict(x)
        return [{"state": k, "prevalence_pct": 100 * float(np.mean(found == k)), **{f"mean_{c}": float(m) for c, m in zip(self.columns, self.means[k])}, **{f"std_{c}": float(d) for c, d in zip(self.columns, self.deviations[k])}} for k in range(len(self.start))]

    def transform(self, df: DataFrame, by: list[str], order: str) -> DataFrame:
        """Rows of new sequences with their state and the posterior of each state."""
        names = [f"prob_{k}" for k in range(len(self.start))]

        def kernel(*x: np.ndarray) -> dict[str, np.ndarray]:
            p = self.predict_proba(np.column_stack(x))
            return {"regime": p.argmax(axis=1).astype(float), **dict(zip(names, p.T))}

        return series(df, by, order, self.columns, kernel, ["regime", *names])

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in asdict(self).items()})

    @classmethod
    def from_json(cls, text: str) -> HiddenMarkov:
        d = json.loads(text)
        return cls(d["columns"], *(np.array(d[k]) for k in ("start", "move", "means", "deviations")), d["loglik"])


def hmm_kernel(x: np.ndarray, states: int = 3, rounds: int = 150) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, deviations and posterior of each row of a fit to one column."""
    m = HiddenMarkov.fit(x, states, rounds)
    return m.means[:, 0], m.deviations[:, 0], m.predict_proba(x)


def hmm_regimes(df: DataFrame, by: list[str], order: str, value: str | list[str], states: int = 3) -> DataFrame:
    """Rows with their regime, its probability and its mean (of the first column); each series has a model of its own."""
    columns = [value] if isinstance(value, str) else value

    def kernel(*x: np.ndarray) -> dict[str, np.ndarray]:
        m = HiddenMarkov.fit(np.column_stack(x), states, columns=columns)
        post = m.predict_proba(np.column_stack(x))
        best = post.argmax(axis=1)
        return {"regime": best.astype(float), "probability": post.max(axis=1), "regime_mean": m.means[best, 0]}

    return series(df, by, order, columns, kernel, ["regime", "probability", "regime_mean"])


def hmm_profile(df: DataFrame, by: list[str], order: str, value: str | list[str], states: int = 3) -> DataFrame:
    """One row a series and state: its share of the rows, and the mean and deviation of each column."""
    columns = [value] if isinstance(value, str) else value
    names = ["state", "prevalence_pct", *[f"mean_{c}" for c in columns], *[f"std_{c}" for c in columns]]

    def kernel(*x: np.ndarray) -> dict[str, np.ndarray]:
        rows = HiddenMarkov.fit(np.column_stack(x), states, columns=columns).profile(np.column_stack(x))
        return {n: np.array([r[n] for r in rows], float) for n in names}

    return series(df, by, order, columns, kernel, names, whole=True)


@dataclass(frozen=True)
class Hawkes:
    """Self-exciting events: base rate mu, jump alpha, decay beta."""

    mu: float = 0.2
    alpha: float = 0.5
    beta: float = 1.0

    def excitement(self, t: np.ndarray) -> np.ndarray:
        """Decayed number of events before each."""
        r = np.zeros(len(t))
        for k in range(1, len(t)):
            r[k] = np.exp(-self.beta * (t[k] - t[k - 1])) * (1 + r[k - 1])
        return r

    def loglik(self, t: np.ndarray, end: float) -> float:
        if self.alpha >= self.beta:
            return -np.inf
        return float(np.sum(np.log(self.mu + self.alpha * self.excitement(t))) - self.mu * end - self.alpha / self.beta * np.sum(1 - np.exp(-self.beta * (end - t))))

    @classmethod
    def fit(cls, t: np.ndarray, end: float | None = None) -> Hawkes:
        if len(t) < 3:
            raise ValueError("at least three events are needed")
        end = t[-1] + 1 if end is None else end
        loss = lambda p: min(1e12, -cls(*p).loglik(t, end))
        return cls(*_search(loss, np.array([0.2, 0.3, 1.0]), np.array([1e-3, 1e-3, 1e-2]), np.array([5.0, 5.0, 10.0])))

    @property
    def branching_ratio(self) -> float:
        return self.alpha / self.beta

    @property
    def is_stationary(self) -> bool:
        return self.branching_ratio < 1

    def intensity(self, events: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Intensity at any times, from the events before each."""
        events, at = np.sort(np.asarray(events, float)), np.asarray(at, float)
        if not len(events):
            return np.full(len(at), self.mu)
        after = 1 + self.excitement(events)  # decayed number of events just after each
        last = np.searchsorted(events, at, side="left") - 1
        return self.mu + np.where(last >= 0, self.alpha * after[last] * np.exp(-self.beta * np.maximum(at - events[last], 0)), 0.0)

    def simulate(self, horizon: float, seed: int | None = None, most: int = 100_000) -> np.ndarray:
        """Event times up to the horizon by thinning: between events the intensity only falls, so its present value bounds it."""
        if horizon <= 0:
            raise ValueError("the horizon must be positive")
        r, t, excited, out = np.random.default_rng(seed), 0.0, 0.0, []
        while len(out) < most:
            bound = self.mu + self.alpha * excited
            wait = r.exponential(1 / bound) if bound > 0 else np.inf
            t += wait
            if t > horizon:
                break
            excited *= np.exp(-self.beta * wait)
            if r.random() * bound <= self.mu + self.alpha * excited:
                out.append(t)
                excited += 1
        return np.array(out)

    def compensator(self, t: np.ndarray) -> np.ndarray:
        """Expected number of events up to each event."""
        r = self.excitement(t)
        # excitement that is gone by then: events so far less what of them is left
        return self.mu * t + self.alpha / self.beta * (np.arange(len(t)) - r)

    def goodness_of_fit(self, t: np.ndarray, end: float | None = None) -> dict[str, object]:
        """Residuals by random time change, which are standard exponential under the model, and their Kolmogorov-Smirnov test."""
        t = np.sort(np.asarray(t, float))
        n = len(t)
        if not n:
            raise ValueError("there are no events")
        tau = np.diff(np.concatenate([[0.0], self.compensator(t)]))
        stat = p = lag = np.nan
        if n >= 3:
            f, k = 1 - np.exp(-np.sort(tau)), np.arange(n)
            stat = float(max((f - k / n).max(), ((k + 1) / n - f).max()))
            p = kolmogorov_tail(n, stat)
            d = tau - tau.mean()
            lag = float((d[:-1] * d[1:]).sum() / (d**2).sum()) if (d**2).sum() > 0 else 0.0
        ll = self.loglik(t, t[-1] + 1 if end is None else end)
        return {
            "ks_stat": stat, "ks_pvalue": p, "is_good_fit": bool(p > 0.05), "tau": tau, "uniforms": 1 - np.exp(-tau), "loglik": ll, "aic": 6 - 2 * ll, "bic": 3 * np.log(n) - 2 * ll,
            "branching_ratio": self.branching_ratio, "is_stationary": self.is_stationary, "lag1_autocorrelation": lag,
        }

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Hawkes:
        return cls(**json.loads(text))


def kolmogorov_tail(n: int, d: float) -> float:
    """P(D >= d) for n uniforms, exactly, by powers of a banded matrix (Marsaglia, Tsang and Wang); the limit's series for n over 500."""
    if d <= 0:
        return 1.0
    if d >= 1:
        return 0.0
    if n > 500:
        x = d * (np.sqrt(n) + 0.12 + 0.11 / np.sqrt(n))
        j = np.arange(1, 101)
        return float(np.clip(2 * np.sum((-1.0) ** (j - 1) * np.exp(-2 * j**2 * x**2)), 0, 1))
    k = int(n * d) + 1
    m, h = 2 * k - 1, k - n * d
    fact = np.cumprod(np.arange(1.0, m + 1))
    a = np.tri(m, m, 1)
    a[:, 0] -= h ** np.arange(1, m + 1)
    a[-1, :] -= h ** np.arange(m, 0, -1)
    a[-1, 0] += max(0.0, 2 * h - 1) ** m
    gap = np.subtract.outer(np.arange(m), np.arange(m)) + 1
    a = np.where(gap > 0, a / fact[np.maximum(gap, 1) - 1], a)
    power, square, left, shift, grown = np.eye(m), a, n, 0, 0
    while left:  # a product of powers, kept in range by a power of ten beside it
        if left & 1:
            power, shift = power @ square, shift + grown
            if power[k - 1, k - 1] > 1e140:
                power, shift = power * 1e-140, shift + 140
        square, grown = square @ square, 2 * grown
        if square[k - 1, k - 1] > 1e140:
            square, grown = square * 1e-140, grown + 140
        left >>= 1
    below = power[k - 1, k - 1]
    for i in range(1, n + 1):
        below *= i / n
        if below < 1e-140:
            below, shift = below * 1e140, shift - 140
    return float(np.clip(1 - below * 10.0**shift, 0, 1))


def hawkes_fit(df: DataFrame, by: list[str], time: str) -> DataFrame:
    """Parameters, branching ratio and log-likelihood of each series of event times; series of fewer than three events give null."""

    def kernel(t: np.ndarray) -> dict[str, np.ndarray]:
        if len(t) < 3:
            return {k: np.nan for k in ("mu", "alpha", "beta", "branching_ratio", "loglik")}
        m = Hawkes.fit(t - t[0])
        return {"mu": m.mu, "alpha": m.alpha, "beta": m.beta, "branching_ratio": m.branching_ratio, "loglik": m.loglik(t - t[0], t[-1] - t[0] + 1)}

    rows = df.withColumn("__at", F.col(time))
    return series(rows, by, time, "__at", kernel, ["mu", "alpha", "beta", "branching_ratio", "loglik"], whole=True)


def hawkes_fit_test(df: DataFrame, by: list[str], time: str, model: Hawkes) -> DataFrame:
    """Goodness of fit of a model to each series of event times, counted from the series' first."""
    names = ["ks_stat", "ks_pvalue", "loglik", "aic", "bic", "lag1_autocorrelation"]

    def kernel(t: np.ndarray) -> dict[str, float]:
        found = model.goodness_of_fit(t - t[0])
        return {n: found[n] for n in names}

    return series(df.withColumn("__at", F.col(time)), by, time, "__at", kernel, names, whole=True)


def hawkes_intensity(df: DataFrame, by: list[str], time: str, model: Hawkes) -> DataFrame:
    """Intensity just before each event."""
    rows = df.withColumn("__at", F.col(time))
    return series(rows, by, time, "__at", lambda t: {"intensity": model.mu + model.alpha * model.excitement(t)}, ["intensity"]).drop("__at")


def adf_statistic(x: np.ndarray, lags: int) -> float:
    """t-statistic of the level in the augmented Dickey-Fuller regression with a constant."""
    d = np.diff(x)
    y = d[lags:]
    parts = [np.ones(len(y)), x[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]]
    a = np.stack(parts, axis=1)
    b, *_ = np.linalg.lstsq(a, y, rcond=None)
    e = y - a @ b
    cov = np.linalg.pinv(a.T @ a) * (e @ e) / max(1, len(y) - a.shape[1])
    return float(b[1] / np.sqrt(cov[1, 1])) if cov[1, 1] > 0 else float("nan")


#: MacKinnon's response surfaces for the Dickey-Fuller statistic with a constant, one series.
_ADF_SMALL = (2.1659, 1.4412, 0.038269)
_ADF_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
_ADF_SPLIT, _ADF_LOW, _ADF_HIGH = -1.61, -18.83, 2.74


def adf_pvalue(statistic: float) -> float:
    """Approximate p-value of the augmented Dickey-Fuller statistic with a constant."""
    if np.isnan(statistic):
        return float("nan")
    if statistic >= _ADF_HIGH:
        return 1.0
    if statistic <= _ADF_LOW:
        return 0.0
    surface = _ADF_SMALL if statistic <= _ADF_SPLIT else _ADF_LARGE
    return NormalDist().cdf(sum(c * statistic**k for k, c in enumerate(surface)))


def fractional_scan(df: DataFrame, by: list[str], order: str, value: str, orders: list[float], threshold: float = 1e-4, lags: int = 2) -> DataFrame:
    """For each order of differencing: the test statistic and its p-value, whether it looks stationary, the correlation with the raw series, and the first
    order that looks so."""
    from wfspark.functions.scores import fractional_weights

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        rows = []
        for d in orders:
            w = np.array(fractional_weights(d, len(x), threshold))
            y = np.convolve(x, w)[len(w) - 1 : len(x)]
            enough = len(y) > lags + 5
            statistic = adf_statistic(y, lags) if enough else np.nan
            p = adf_pvalue(statistic)
            rows.append((d, statistic, p, float(p < 0.05), np.corrcoef(y, x[len(w) - 1 :])[0, 1] if enough else np.nan, len(w)))
        out = dict(zip(names, np.array(rows, float).T))
        first = np.flatnonzero(out["is_stationary"] == 1)
        return out | {"is_optimal": (np.arange(len(rows)) == (first[0] if len(first) else -1)).astype(float)}

    names = ["d", "adf", "p_value", "is_stationary", "correlation", "n_weights"]
    return series(df, by, order, value, kernel, [*names, "is_optimal"], whole=True)
