"""Empirical-Bayes target encoding and leave-one-out cohort scores."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wfspark.functions.pay import col
from wfspark.sources.files import load_state, save_state


def _same(keys: list[str], prefix: str = "__k_") -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(prefix + k))
    return out


@dataclass
class TargetEncoder:
    """(n * mean + m * prior) / (n + m) of each key. The fitted state is a small frame of keys, counts and codes, which can be written as a table."""

    keys: list[str]
    target: str
    m: float = 10.0
    state: DataFrame | None = None

    def fit(self, df: DataFrame) -> TargetEncoder:
        y = col(self.target)
        by = df.groupBy(*self.keys).agg(F.count(y).alias("n"), F.avg(y).alias("mean"))
        prior = df.agg(F.avg(y).alias("prior"))
        code = F.when(F.col("n") > 0, (F.col("n") * F.col("mean") + self.m * F.col("prior")) / (F.col("n") + self.m)).otherwise(F.col("prior"))
        self.state = by.crossJoin(F.broadcast(prior)).withColumn("code", code)
        self.prior = prior
        return self

    def transform(self, df: DataFrame, output: str = "encoded") -> DataFrame:
        """Codes of the rows; unseen keys get the prior."""
        state = self.state.select(*[F.col(k).alias(f"__k_{k}") for k in self.keys], F.col("code").alias("__code"))
        joined = df.join(state, _same(self.keys), "left").crossJoin(F.broadcast(self.prior.withColumnRenamed("prior", "__prior")))
        return joined.select(*df.columns, F.coalesce("__code", "__prior").alias(output))

    def out_of_fold(self, df: DataFrame, fold: Column, output: str = "encoded") -> DataFrame:
        """Each row's code from the rows of the other folds, in one pass: totals less the fold's own."""
        y = col(self.target)
        work = df.withColumn("__fold", fold)
        total = work.groupBy("__fold").agg(F.count(y).alias("__nf"), F.coalesce(F.sum(y), F.lit(0.0)).alias("__sf"))
        whole = total.agg(F.sum("__nf").alias("__N"), F.sum("__sf").alias("__S"))
        priors = total.crossJoin(whole).select("__fold", ((F.col("__S") - F.col("__sf")) / F.nullif(F.col("__N") - F.col("__nf"), F.lit(0))).alias("__prior"))
        key, own = Window.partitionBy(*self.keys), Window.partitionBy(*self.keys, "__fold")
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        s = zero(F.sum(y).over(key)) - zero(F.sum(y).over(own))
        n = F.count(y).over(key) - F.count(y).over(own)
        work = work.withColumn("__s", s).withColumn("__n", n).join(F.broadcast(priors), "__fold")
        return work.select(*df.columns, ((F.col("__s") + self.m * F.col("__prior")) / (F.col("__n") + self.m)).alias(output))

    def inverse(self, df: DataFrame, value: str, rows: str, output: str = "decoded", strategy: str = "nearest", tolerance: float = 1e-5) -> DataFrame:
        """The first key column whose code is nearest; equal codes: the more frequent, then the first in order; equal distances: the lower code.
        ``exact``: null where the nearest code is further than the tolerance. ``rows`` identifies the rows of ``df``."""
        if strategy not in ("nearest", "exact"):
            raise ValueError(f"unknown strategy {strategy}")
        codes = self.state.groupBy("code").agg(F.min_by(F.col(self.keys[0]), F.struct(-F.col("n"), F.col(self.keys[0]))).alias("__key"))
        ordered = codes.select("code", "__key", F.lead("code").over(Window.orderBy("code")).alias("__up"), F.lead("__key").over(Window.orderBy("code")).alias("__upkey"), F.row_number().over(Window.orderBy("code")).alias("__i"))
        v = F.col(value)
        meets = ((F.col("code") <= v) | (F.col("__i") == 1)) & (F.col("__up").isNull() | (F.col("__up") > v))
        joined = df.join(F.broadcast(ordered), meets, "left")
        nearer = (F.col("__up").isNotNull()) & (F.abs(F.col("__up") - v) < F.abs(v - F.col("code")))
        found = F.when(nearer, F.col("__upkey")).otherwise(F.col("__key"))
        if strategy == "exact":
            found = F.when(F.abs(F.when(nearer, F.col("__up")).otherwise(F.col("code")) - v) <= tolerance, found)
        return joined.select(*df.columns, found.alias(output))

    def save(self, path: str) -> None:
        """Codes as a table; settings and the prior beside it."""
        save_state(self.state, f"{path}/codes")
        settings = json.dumps({"keys": self.keys, "target": self.target, "m": self.m})
        save_state(self.prior.withColumn("settings", F.lit(settings)), f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TargetEncoder:
        stored = load_state(spark, f"{path}/settings")
        out = cls(**json.loads(stored.first()["settings"]), state=load_state(spark, f"{path}/codes"))
        out.prior = stored.select("prior")
        return out


@dataclass
class CohortScorer:
    """Statistics of fitted cohorts and of all rows, to score new rows with; they can be written as tables."""

    cohort: list[str]
    value: str
    least: int = 3
    epsilon: float = 1e-6
    state: DataFrame | None = None
    every: DataFrame | None = None

    def fit(self, df: DataFrame) -> CohortScorer:
        x = col(self.value)
        self.state = df.groupBy(*self.cohort).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
        self.every = df.agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        """Fit, and the leave-one-out scores of the fitted rows themselves."""
        self.fit(df)
        return loo_zscore(df, self.cohort, self.value, self.least, self.epsilon)

    def transform(self, df: DataFrame) -> DataFrame:
        """Z-score of new rows against fitted cohorts; small cohorts score 0, unknown ones against all rows (size 0)."""
        x = col(self.value)
        stats = self.state.select(*[F.col(c).alias(f"__k_{c}") for c in self.cohort], F.col("n").alias("__n"), F.col("mean").alias("__m"), F.col("std").alias("__s"))
        every = self.every.select(F.col("mean").alias("__gm"), F.col("std").alias("__gs"))
        joined = df.join(stats, _same(self.cohort), "left").crossJoin(F.broadcast(every))
        known = F.col("__n").isNotNull()
        mean, std = F.when(known, F.col("__m")).otherwise(F.col("__gm")), F.greatest(F.when(known, F.col("__s")).otherwise(F.col("__gs")), F.lit(self.epsilon))
        score = F.when(known & (F.col("__n") < self.least), 0.0).when(F.abs(x - mean) < self.epsilon, 0.0).otherwise((x - mean) / std)
        return joined.select(*df.columns, F.coalesce("__n", F.lit(0)).alias("cohort_size"), score.alias("z_score"))

    def save(self, path: str) -> None:
        save_state(self.state, f"{path}/cohorts")
        settings = json.dumps({"cohort": self.cohort, "value": self.value, "least": self.least, "epsilon": self.epsilon})
        save_state(self.every.withColumn("settings", F.lit(settings)), f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CohortScorer:
        stored = load_state(spark, f"{path}/settings")
        return cls(**json.loads(stored.first()["settings"]), state=load_state(spark, f"{path}/cohorts"), every=stored.select("mean", "std"))


def loo_zscore(df: DataFrame, cohort: list[str], value: str, least: int = 3, epsilon: float = 1e-6) -> DataFrame:
    """Standard and leave-one-out z-score of each row in its cohort, from window sums around the cohort's mean."""
    w = Window.partitionBy(*cohort)
    x = col(value)
    work = df.withColumn("__n", F.count(x).over(w).cast("double")).withColumn("__mean", F.avg(x).over(w)).withColumn("__dev", x - F.col("__mean"))
    work = work.withColumn("__ss", F.sum(F.col("__dev") * F.col("__dev")).over(w))
    n, mean, dev, ss = F.col("__n"), F.col("__mean"), F.col("__dev"), F.col("__ss")
    loo_mean = mean - dev / (n - 1)
    gap = dev + dev / (n - 1)
    loo_var = (ss - dev * dev - dev * dev / (n - 1)) / (n - 2)
    std = F.sqrt(F.try_divide(ss, n - 1))
    z = lambda d, s: F.when(F.abs(d) < epsilon, 0.0).otherwise(d / F.greatest(s, F.lit(epsilon)))
    loo_std = F.greatest(F.sqrt(F.greatest(loo_var, F.lit(0.0))), F.lit(epsilon))
    enough = n >= max(least, 3)
    standard = F.when(n >= least, z(dev, std)).otherwise(0.0)
    return work.select(
        *df.columns,
        F.col("__n").cast("bigint").alias("cohort_size"),
        standard.alias("standard_z_score"),
        F.when(enough, loo_mean).otherwise(mean).alias("loo_cohort_mean"),
        F.when(enough, loo_std).when(n >= least, F.greatest(std, F.lit(epsilon))).otherwise(0.0).alias("loo_cohort_std"),
        F.when(enough, z(gap, loo_std)).when(n >= least, standard).otherwise(0.0).alias("loo_z_score"),
    )


def cohort_zscore(fitted: DataFrame, df: DataFrame, cohort: list[str], value: str, least: int = 3, epsilon: float = 1e-6) -> DataFrame:
    """Z-score of new rows against the cohorts of other rows."""
    return CohortScorer(cohort, value, least, epsilon).fit(fitted).transform(df)
