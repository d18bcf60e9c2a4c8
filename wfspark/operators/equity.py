"""Pay gaps, fairness measures, rate and mix attribution, uplift curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wfspark.functions.pay import col
from wfspark.functions.scores import logarithmic_mean


def lmdi(df: DataFrame, key: str, h0: str, r0: str, h1: str, r1: str) -> DataFrame:
    """Change of the overall rate by key, split into a rate and a mix effect with logarithmic weights; the two add up."""
    total = df.agg(F.sum(col(h0)).alias("__t0"), F.sum(col(h1)).alias("__t1"))
    work = df.crossJoin(F.broadcast(total)).withColumn("__s0", F.try_divide(col(h0), F.col("__t0"))).withColumn("__s1", F.try_divide(col(h1), F.col("__t1")))
    work = work.withColumn("__c0", F.col("__s0") * col(r0)).withColumn("__c1", F.col("__s1") * col(r1))
    weight = logarithmic_mean("__c1", "__c0")
    effect = lambda a, b: F.when(weight == 0, 0.0).otherwise(weight * F.ln(F.try_divide(a, b)))
    rate, mix = effect(col(r1), col(r0)), effect(F.col("__s1"), F.col("__s0"))
    return work.select(key, F.col("__s0").alias("share_0"), F.col("__s1").alias("share_1"), rate.alias("rate_effect"), mix.alias("mix_effect"), (F.col("__c1") - F.col("__c0")).alias("change"))


def lmdi_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sum("rate_effect").alias("rate_effect"), F.sum("mix_effect").alias("mix_effect"), F.sum("change").alias("change")).withColumn(
        "residual", F.col("change") - F.col("rate_effect") - F.col("mix_effect")
    )


def group_pay(df: DataFrame, salary: str, group: str) -> DataFrame:
    s = col(salary)
    return df.where(s.isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count("*").alias("n"), F.avg(s).alias("mean"), F.percentile(s, 0.5).alias("median"), F.percentile(s, 0.25).alias("p25"), F.percentile(s, 0.75).alias("p75"), F.stddev_samp(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max")
    )


def pay_gap(df: DataFrame, salary: str, group: str, reference: str | None = None, comparison: str | None = None) -> DataFrame:
    """Gaps of the comparison group to the reference in percent of the reference, and the ratios. Without names the reference is the group of the highest
    mean pay and the comparison that of the lowest; equal means: the first in order."""
    stats = group_pay(df, salary, group)
    if reference is None or comparison is None:
        found = stats.agg(F.min_by(group, F.struct(-F.col("mean"), F.col(group))).alias("top"), F.min_by(group, F.struct("mean", group)).alias("low")).first()
        reference = found["top"] if reference is None else reference
        comparison = found["low"] if comparison is None else comparison
    pick = lambda of, c: F.max(F.when(F.col(group) == of, F.col(c)))
    wide = stats.agg(*[pick(of, c).alias(f"{name}_{c}") for name, of in (("ref", reference), ("cmp", comparison)) for c in ("mean", "median", "n")])
    gap = lambda c: 100 * F.try_divide(F.col(f"ref_{c}") - F.col(f"cmp_{c}"), F.col(f"ref_{c}"))
    return wide.select(
        "*", gap("mean").alias("mean_gap_pct"), gap("median").alias("median_gap_pct"),
        F.try_divide("cmp_mean", "ref_mean").alias("mean_ratio"), F.try_divide("cmp_median", "ref_median").alias("median_ratio"),
    )


def median_gap(df: DataFrame, salary: str, group: str, reference: str, comparison: str) -> DataFrame:
    return pay_gap(df, salary, group, reference, comparison).select("median_gap_pct")


def pay_quartiles(df: DataFrame, salary: str, group: str) -> DataFrame:
    """Share of each group in each pay quarter; quarters by right-closed edges."""
    s = col(salary)
    edges = df.agg(F.percentile(s, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("__e"))
    e = F.col("__e")
    quarter = F.when(s <= e[0], "Q1_Lower").when(s <= e[1], "Q2_Lower_Middle").when(s <= e[2], "Q3_Upper_Middle").otherwise("Q4_Upper")
    counts = df.where(s.isNotNull()).crossJoin(F.broadcast(edges)).groupBy(quarter.alias("quartile"), group).agg(F.count("*").alias("n"))
    return counts.withColumn("share_pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("quartile")))


def controlled_gap(df: DataFrame, salary: str, group: str, reference: str, comparison: str, controls: list[str]) -> DataFrame:
    """Median and mean gap within cohorts of the controls, weighted by the whole cohort's size; only cohorts with both groups count."""
    s = col(salary)
    of = lambda g: F.when(F.col(group) == g, s)
    cohorts = df.where(s.isNotNull()).groupBy(*controls).agg(
        F.count("*").alias("n"), F.percentile(of(reference), 0.5).alias("rm"), F.percentile(of(comparison), 0.5).alias("cm"), F.avg(of(reference)).alias("ra"), F.avg(of(comparison)).alias("ca")
    )
    both = cohorts.where("rm > 0 and cm is not null and ra > 0 and ca is not null")
    weigh = lambda a, b: F.sum(F.col("n") * 100 * (F.col(a) - F.col(b)) / F.col(a)) / F.sum("n")
    return both.agg(weigh("rm", "cm").alias("median_gap_pct"), weigh("ra", "ca").alias("mean_gap_pct"), F.count("*").alias("n_cohorts"), F.sum("n").alias("n_rows"))


def fairness(df: DataFrame, predicted: str, group: str, truth: str | None = None) -> DataFrame:
    """Demographic parity difference and ratio of 0/1 predictions over groups, and with ``truth`` the equalized odds difference."""
    y = col(predicted)
    parts = [F.avg(y).alias("rate")]
    if truth:
        parts += [F.coalesce(F.avg(F.when(col(truth) == k, y)), F.lit(0.0)).alias(n) for n, k in (("tpr", 1), ("fpr", 0))]
    by = df.where(F.col(group).isNotNull()).groupBy(group).agg(*parts)
    few = F.count("*") < 2
    span = lambda c: F.when(few, 0.0).otherwise(F.max(c) - F.min(c))
    out = [span("rate").alias("dp_difference"), F.when(few | (F.max("rate") == 0), 1.0).otherwise(F.try_divide(F.min("rate"), F.max("rate"))).alias("dp_ratio")]
    return by.agg(*out, *([F.greatest(span("tpr"), span("fpr")).alias("eo_difference")] if truth else []))


def qini_curve(df: DataFrame, outcome: str, treated: str, score: str, row: str, bins: int = 10) -> DataFrame:
    """Uplift gained by treating the best k of n rows, at bins + 1 even shares. Ties of the score go by ``row``.

    Places are ranks within score ranges plus the ranges' totals before, so no task sorts all rows."""
    n = df.agg(F.count("*").alias("__n"))
    ranked = _running(df.select(row, col(outcome).alias("y"), col(treated).alias("t"), col(score).alias("s")), row)
    marks = n.select("__n", F.explode(F.sequence(F.lit(0), F.lit(bins))).alias("bin")).select("__n", "bin", F.ceil(F.col("bin") * F.col("__n") / bins).alias("k"))
    at = marks.join(ranked, F.col("k") == F.col("place"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    yt, yc, nt, nc = (zero(c) for c in ("yt", "yc", "nt", "nc"))
    gain = yt - F.when(nc > 0, nt / F.nullif(nc, F.lit(0.0)) * yc).otherwise(0.0)
    return at.select("bin", F.col("k").alias("n_targeted"), nt.alias("n_treated"), nc.alias("n_control"), gain.alias("gain"))


def _running(df: DataFrame, row: str, ranges: int = 64) -> DataFrame:
    """Place and running sums by falling score: score ranges in parallel, then the sums of the ranges before."""
    edges = df.agg(F.percentile_approx(-F.col("s"), [k / ranges for k in range(1, ranges)]).alias("__e"))
    part = df.crossJoin(F.broadcast(edges)).withColumn("__p", F.size(F.filter("__e", lambda e: e < -F.col("s"))))
    sums = {"place": F.lit(1), "yt": F.col("y") * F.col("t"), "yc": F.col("y") * (1 - F.col("t")), "nt": F.col("t"), "nc": 1 - F.col("t")}
    totals = part.groupBy("__p").agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    over = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("__p").alias("__q"), *[F.coalesce(F.sum(f"__t_{k}").over(over), F.lit(0)).alias(f"__b_{k}") for k in sums])
    inner = Window.partitionBy("__p").orderBy(F.desc("s"), row).rowsBetween(Window.unboundedPreceding, 0)
    return part.select("*", *[F.sum(c).over(inner).alias(f"__r_{k}") for k, c in sums.items()]).join(F.broadcast(before), F.col("__p") == F.col("__q")).select(*[(F.col(f"__r_{k}") + F.col(f"__b_{k}")).alias(k) for k in sums])


def auuc(df: DataFrame, outcome: str, treated: str, score: str, row: str, bins: int = 20) -> DataFrame:
    """Area under the uplift curve over shares of the rows, by trapezoids, and the area above the straight line to its end."""
    curve = qini_curve(df, outcome, treated, score, row, bins)
    w = Window.orderBy("bin")
    parts = curve.withColumn("area", (F.col("gain") + F.lag("gain").over(w)) / 2 / bins)
    return parts.agg(F.sum("area").alias("auuc"), F.max_by("gain", "bin").alias("end")).select("auuc", (F.col("auuc") - F.col("end") / 2).alias("qini_score"))
