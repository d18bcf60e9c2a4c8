"""Window features over panels: partitions ordered by time.

Every function appends columns to the rows it gets, in one select, so that features over one partitioning share one
exchange and one sort. Rows whose partition keys are all null get null features. NaN counts as missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wfspark.functions.pay import col
from wfspark.functions.scores import fractional_weights

Names = list[str]


@dataclass(frozen=True)
class RollingMetric:
    """``aggregation``: mean, sum, var, std, min, max, median, skew, kurt, quantile, count, or a function from Column to Column."""

    target: str
    window: int
    aggregation: str | Callable[[Column], Column] = "mean"
    output: str | None = None
    min_periods: int | None = 1
    lag: int = 0
    closed: str | None = None
    center: bool = False
    quantile: float | None = None

    @property
    def name(self) -> str:
        agg = self.aggregation if isinstance(self.aggregation, str) else "custom"
        return self.output or f"{self.target}_roll_{agg}_{self.window}" + (f"_lag{self.lag}" if self.lag else "")


def _order(partition: Names, time: str, ascending: bool) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(F.col(time).asc_nulls_last() if ascending else F.col(time).desc_nulls_last())


def _known(partition: Names, value: Column) -> Column:
    keys = reduce(lambda a, b: a & b, [F.col(p).isNotNull() for p in partition]) if partition else F.lit(True)
    return F.when(keys, value)


def _check(df: DataFrame, needed: Iterable[str]) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise KeyError(f"no such columns: {missing}")


_BOUNDS = {
    None: lambda w: (-(w - 1), 0),
    "right": lambda w: (-(w - 1), 0),
    "both": lambda w: (-w, 0),
    "left": lambda w: (-w, -1),
    "neither": lambda w: (-(w - 1), -1),
}


def _skew(x: Column, n: Column, over: Callable[[Column], Column]) -> Column:
    flat = over(F.min(x)) == over(F.max(x))
    return F.when(n >= 3, F.when(flat, 0.0).otherwise(over(F.skewness(x)) * F.sqrt(n * (n - 1)) / (n - 2)))


def _kurt(x: Column, n: Column, over: Callable[[Column], Column]) -> Column:
    flat = over(F.min(x)) == over(F.max(x))
    return F.when(n >= 4, F.when(flat, -3.0).otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * over(F.kurtosis(x)) + 6)))


def _rolling(m: RollingMetric, base: WindowSpec, partition: Names) -> Column:
    low, high = (-(m.window // 2), (m.window - 1) // 2) if m.center else _BOUNDS[m.closed](m.window)
    frame = base.rowsBetween(low - m.lag, high - m.lag)
    x = col(m.target)
    over = lambda c: c.over(frame)
    n = over(F.count(x)).cast("double")
    plain = {"mean": F.avg, "sum": F.sum, "var": F.var_samp, "variance": F.var_samp, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}
    if callable(m.aggregation):
        value = over(m.aggregation(x))
    elif m.aggregation in plain:
        value = over(plain[m.aggregation](x))
    elif m.aggregation == "median":
        value = over(F.percentile(x, 0.5))
    elif m.aggregation == "quantile":
        value = over(F.percentile(x, 0.5 if m.quantile is None else m.quantile))
    elif m.aggregation == "skew":
        value = _skew(x, n, over)
    elif m.aggregation in ("kurt", "kurtosis"):
        value = _kurt(x, n, over)
    else:
        raise ValueError(f"unknown aggregation {m.aggregation}")
    least = m.window if m.min_periods is None else m.min_periods
    value = F.when(n >= least, value)
    if m.lag:
        value = F.when(F.row_number().over(base) > m.lag, value)
    return _known(partition, value).alias(m.name)


def rolling_metrics(df: DataFrame, metrics: Iterable[RollingMetric], partition: Names, time: str, ascending: bool = True) -> DataFrame:
    metrics = list(metrics)
    _check(df, [*partition, time, *(m.target for m in metrics)])
    base = _order(partition, time, ascending)
    return df.select("*", *[_rolling(m, base, partition) for m in metrics])


def lag_features(df: DataFrame, lags: dict[str, list[int]], partition: Names, time: str, ascending: bool = True, prefix: str = "") -> DataFrame:
    _check(df, [*partition, time, *lags])
    base, pre = _order(partition, time, ascending), f"{prefix}_" if prefix else ""
    return df.select("*", *[_known(partition, F.lag(c, k).over(base)).alias(f"{pre}{c}_lag_{k}") for c, ks in lags.items() for k in ks])


#: Periods of the presets.
PERIODS = {"weekly": [1, 4, 13, 52], "monthly": [1, 3, 12], "daily": [1, 7, 30, 365]}


def differencing_features(
    df: DataFrame, targets: Names, periods: int | list[int] | str, partition: Names, time: str, pct_change: bool = False, as_percent: bool = True, ascending: bool = True
) -> DataFrame:
    """Difference from k rows before, and with ``pct_change`` its share of that (signed) value; a zero base gives null."""
    _check(df, [*partition, time, *targets])
    steps = PERIODS[periods] if isinstance(periods, str) else [periods] if isinstance(periods, int) else periods
    base, out = _order(partition, time, ascending), []
    for c in targets:
        for k in steps:
            before = F.lag(col(c), k).over(base)
            change = col(c) - before
            out.append(_known(partition, change).alias(f"{c}_diff_{k}"))
            if pct_change:
                share = F.try_divide(change, before) * (100.0 if as_percent else 1.0)
                out.append(_known(partition, share).alias(f"{c}_diff_{k}_pct"))
    return df.select("*", *out)


@dataclass
class TemporalPipeline:
    """Steps gathered first and applied together; ``fit`` checks them against the input's columns."""

    partition: Names
    time: str
    rolling: list[RollingMetric] = field(default_factory=list)
    lags: dict[str, list[int]] = field(default_factory=dict)
    differences: list[tuple[Names, int | list[int] | str, bool]] = field(default_factory=list)

    def add_metric(self, *metrics: RollingMetric) -> TemporalPipeline:
        self.rolling += metrics
        return self

    def add_lags(self, target: str, lags: list[int]) -> TemporalPipeline:
        self.lags[target] = self.lags.get(target, []) + lags
        return self

    def add_differencing(self, targets: Names, periods: int | list[int] | str, pct_change: bool = False) -> TemporalPipeline:
        self.differences.append((targets, periods, pct_change))
        return self

    def fit(self, df: DataFrame) -> TemporalPipeline:
        _check(df, [*self.partition, self.time, *(m.target for m in self.rolling), *self.lags, *(t for d in self.differences for t in d[0])])
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = rolling_metrics(df, self.rolling, self.partition, self.time) if self.rolling else df
        out = lag_features(out, self.lags, self.partition, self.time) if self.lags else out
        for targets, periods, pct in self.differences:
            out = differencing_features(out, targets, periods, self.partition, self.time, pct)
        return out

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def feature_names(self, df: DataFrame) -> Names:
        return [c for c in self.transform(df.limit(0)).columns if c not in df.columns]


def fractional_difference(df: DataFrame, target: str, d: float, partition: Names, time: str, threshold: float = 1e-4, output: str | None = None) -> DataFrame:
    """(1 - L)**d as a weighted sum of lags: all weights from the threshold up, at most as many as the series has rows. Null until the filter is
    full, and where any value in it is missing."""
    series = Window.partitionBy(*partition)
    weights = fractional_weights(d, 65, threshold)
    if len(weights) > 64:  # bounded by the longest series, which takes a job to find
        longest = df.groupBy(*partition).count().agg(F.max("count")).first()[0] or 1
        weights = fractional_weights(d, longest, threshold)
    frame = _order(partition, time, True).rowsBetween(1 - len(weights), 0)
    work = df.withColumn("__seen", F.collect_list(F.struct(col(target).cast("double").alias("v"))).over(frame)).withColumn("__rows", F.count(F.lit(1)).over(series))
    kept = F.slice(F.array(*[F.lit(w) for w in weights]), F.lit(1), F.size("__seen"))
    terms = F.zip_with(F.reverse("__seen"), kept, lambda x, w: x["v"] * w)
    total = F.when(F.size("__seen") == F.least(F.lit(len(weights)), F.col("__rows")), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))
    return work.withColumn(output or f"{target}_fracdiff", _known(partition, total)).drop("__seen", "__rows")


def weighted_weeks_since(events: DataFrame, current: float, half_life: float = 8.0, entity: str = "employee_id", week: str = "week", tier: str = "tier", weights: dict[str, float] | None = None) -> DataFrame:
    """Decayed sum of tier weights, time since the last event, its tier and the number of events, of events up to ``current``."""
    weights = weights or {"Gold": 1.0, "Silver": 0.6, "Bronze": 0.3}
    weigh = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(tier)], F.lit(0.25))
    age = F.lit(float(current)) - col(week)
    past = events.where(col(week) <= current)
    return past.groupBy(entity).agg(
        F.sum(weigh * F.exp(-F.log(F.lit(2.0)) * age / half_life)).alias("decayed_score"),
        F.min(age).alias("since_last"),
        F.max_by(tier, F.struct(week, tier)).alias("last_tier"),
        F.count("*").alias("n_events"),
    )


def shannon_entropy(df: DataFrame, value: str, by: Names, base: float = 2.0) -> DataFrame:
    """Entropy of the non-null values of each group, 0 for one distinct value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").cast("double").alias("c"))
    total = counts.groupBy(*by).agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.ln("c")).alias("s"))
    return total.select(*by, F.greatest((F.ln("t") - F.col("s") / F.col("t")) / math.log(base), F.lit(0.0)).alias("entropy"))


def rolling_entropy(df: DataFrame, value: str, window: int, partition: Names, time: str, base: float = 2.0, normalize: bool = False, output: str = "rolling_entropy") -> DataFrame:
    """Entropy of the last ``window`` rows; null before max(2, window // 2) of them. Normalised: by the log of the distinct values, two at least."""
    frame = _order(partition, time, True).rowsBetween(-(window - 1), 0)
    seen, rows = F.collect_list(value).over(frame), F.count(F.lit(1)).over(frame)
    work = df.withColumn("__seen", seen).withColumn("__rows", rows).withColumn("__kinds", F.array_distinct("__seen"))
    n = F.size("__seen").cast("double")
    share = lambda k: F.size(F.filter("__seen", lambda x: x == k)) / n
    bits = -F.aggregate("__kinds", F.lit(0.0), lambda a, k: a + share(k) * F.ln(share(k)))
    scale = F.ln(F.greatest(F.lit(2), F.size("__kinds")).cast("double")) if normalize else F.lit(math.log(base))
    out = F.when(F.col("__rows") >= max(2, window // 2), F.when(F.size("__kinds") <= 1, 0.0).otherwise(bits / scale))
    return work.withColumn(output, _known(partition, out)).drop("__seen", "__rows", "__kinds")


def hazard_curve(df: DataFrame, tenure: str, event: str) -> DataFrame:
    """Kaplan-Meier survival and Nelson-Aalen hazard at every whole tenure from 1 to the longest. Tenures may be fractions: those that end in one whole
    tenure are ordered among themselves, and only whole tenures are added up in one task."""
    at = df.where(col(tenure).isNotNull()).groupBy(col(tenure).alias("t")).agg(F.sum(col(event)).alias("d"), F.count("*").cast("double").alias("n")).withColumn("cell", F.ceil("t"))
    totals = at.groupBy(F.col("cell").alias("of")).agg(F.sum("n").alias("all"))
    later = totals.select("of", (F.sum("all").over(Window.orderBy(F.desc("of"))) - F.col("all")).alias("later"))
    own = F.sum("n").over(Window.partitionBy("cell").orderBy(F.desc("t")))
    risk = at.withColumn("own", own).join(F.broadcast(later), F.col("cell") == F.col("of")).select("cell", "d", (F.col("own") + F.col("later")).alias("r"))
    cells = risk.groupBy("cell").agg(
        F.sum(F.when(F.col("d") < F.col("r"), F.log1p(-F.col("d") / F.col("r"))).otherwise(0.0)).alias("log"), F.sum(F.col("d") / F.col("r")).alias("h"), F.max((F.col("d") >= F.col("r")).cast("int")).alias("dead")
    )
    before = Window.orderBy("cell")
    steps = cells.select(
        F.col("cell").cast("double").alias("t"),
        F.when(F.max("dead").over(before) == 1, 0.0).otherwise(F.exp(F.sum("log").over(before))).alias("survival"),
        F.sum("h").over(before).alias("hazard"),
    )
    grid = df.agg(F.floor(F.max(col(tenure))).cast("int").alias("last")).where("last >= 1").select(F.explode(F.sequence(F.lit(1), F.col("last"))).alias("g")).select(F.col("g").cast("double").alias("tenure"))
    joined = grid.join(steps, F.col("tenure") == F.col("t"), "full").withColumn("at", F.coalesce("tenure", "t"))
    filled = joined.select("tenure", *[F.coalesce(F.last(c, ignorenulls=True).over(Window.orderBy("at")), F.lit(first)).alias(c) for c, first in (("survival", 1.0), ("hazard", 0.0))])
    return filled.where("tenure is not null").select(F.col("tenure").cast("bigint").alias("tenure"), "survival", "hazard")


def hazard_features(df: DataFrame, curve: DataFrame, tenure: str) -> DataFrame:
    """Survival and hazard of each row's tenure; off the grid, the last values."""
    last = curve.agg(F.max_by("survival", "tenure").alias("ls"), F.max_by("hazard", "tenure").alias("lh"))
    joined = df.join(curve.withColumnRenamed("tenure", "__t"), col(tenure) == F.col("__t").cast("double"), "left").crossJoin(F.broadcast(last))
    return joined.select(*df.columns, F.coalesce("survival", "ls").alias("survival"), F.coalesce("hazard", "lh").alias("hazard"))


def ctmc_rates(events: DataFrame, entity: str, state: str, start: str, end: str) -> DataFrame:
    """Transition rates between states: moves i to j over the time in i. Stays of nothing count as 0.01; a move to the same state is time only."""
    moved = events.withColumn("__next", F.lead(state).over(Window.partitionBy(entity).orderBy(start, end, state)))
    moved = moved.withColumn("__time", F.greatest(F.lit(0.01), col(end) - col(start)))
    time = moved.groupBy(F.col(state).alias("source")).agg(F.sum("__time").alias("total_time"))
    moves = moved.where(f"__next is not null and __next <> {state}").groupBy(F.col(state).alias("source"), F.col("__next").alias("target")).agg(F.count("*").alias("moves"))
    return moves.join(time, "source").select("source", "target", "moves", "total_time", (F.col("moves") / F.col("total_time")).alias("rate"))


def ctmc_sojourn(rates: DataFrame, slow: float = 1.4) -> DataFrame:
    """Expected stay in each state, and whether it is a bottleneck: over ``slow`` times the median stay."""
    stays = rates.groupBy("source").agg((1 / F.sum("rate")).alias("sojourn"))
    median = stays.agg(F.percentile("sojourn", 0.5).alias("median"))
    return stays.crossJoin(F.broadcast(median)).select(
        F.col("source").alias("state"), "sojourn", (F.col("sojourn") > slow * F.col("median")).alias("is_bottleneck"), (F.col("sojourn") / (F.col("median") + 1e-6)).alias("drag")
    )
