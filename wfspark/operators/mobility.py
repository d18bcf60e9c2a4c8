"""Absence, tenure, hierarchy and career-path operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wfspark.functions.pay import col
from wfspark.functions.scores import bradford_score


def bradford_daily(days: DataFrame, people: DataFrame, entity: str, date: str, as_of: Column, weeks: int = 52) -> DataFrame:
    """Spells, days and score of each person from days of absence: consecutive days are one spell, the same day twice opens another."""
    inside = days.where(F.col(date).between(F.date_sub(as_of, 7 * weeks), as_of))
    gap = F.datediff(date, F.lag(date).over(Window.partitionBy(entity).orderBy(date)))
    marked = inside.withColumn("__new", (~gap.eqNullSafe(F.lit(1))).cast("int"))
    return _scored(marked.groupBy(entity).agg(F.sum("__new").alias("spells"), F.count("*").alias("days_absent")), people, entity)


def bradford_spells(spells: DataFrame, people: DataFrame, entity: str, start: str, days: str, as_of: Column, weeks: int = 52) -> DataFrame:
    """The same from a log of spells that start in the window."""
    inside = spells.where(F.col(start).between(F.date_sub(as_of, 7 * weeks), as_of))
    return _scored(inside.groupBy(entity).agg(F.count("*").alias("spells"), F.sum(days).alias("days_absent")), people, entity)


def _scored(counts: DataFrame, people: DataFrame, entity: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    out = people.select(entity).distinct().join(counts, entity, "left").select(entity, zero("spells").alias("spells"), zero("days_absent").alias("days_absent"))
    return out.withColumn("bradford_score", bradford_score("spells", "days_absent")).withColumn("disruption", F.when(F.col("days_absent") > 0, F.col("spells") * F.col("spells")).otherwise(1))


def time_in_position(df: DataFrame, since: str, as_of: Column | None = None, output: str = "time_in_position_months") -> DataFrame:
    """Months since the last change of role, to one digit, not below 0. Without ``as_of``: to the latest date of all."""
    last = as_of if as_of is not None else F.col("__last")
    source = df if as_of is not None else df.crossJoin(F.broadcast(df.agg(F.max(F.to_timestamp(since)).alias("__last"))))
    length = (F.unix_micros(F.to_timestamp(last)) - F.unix_micros(F.to_timestamp(since))) / (86400e6 * 30.4375)
    return source.select(*df.columns, F.bround(F.greatest(length, F.lit(0.0)), 1).alias(output))


def percent_rank_average(value: Column, partition: list[str]) -> Column:
    """Share of the cohort at or below, ties at their average rank; null values have none."""
    by = Window.partitionBy(*partition)
    ties = F.count(value).over(Window.partitionBy(*partition, value))
    place = F.rank().over(by.orderBy(value.asc_nulls_last()))
    return F.when(value.isNotNull(), (place + (ties - 1) / 2) / F.count(value).over(by))


def stagnation_index(
    df: DataFrame, months: str, cohort: list[str], performance: str, flight_risk: str | None = None, high: float = 4.0, stagnant: float = 0.9, emerging: float = 0.75, sensitivity: float = 0.25
) -> DataFrame:
    x, w = col(months), Window.partitionBy(*cohort)
    work = df.select(
        "*",
        F.percentile(x, 0.5).over(w).alias("cohort_median"),
        F.percentile(x, stagnant).over(w).alias("cohort_p90"),
        F.percentile(x, emerging).over(w).alias("cohort_p75"),
        percent_rank_average(x, cohort).alias("percentile"),
    )
    is_high, is_stagnant = col(performance) >= high, x >= F.col("cohort_p90")
    excess = F.greatest(x - F.col("cohort_p75"), F.lit(0.0))
    surge = F.greatest(F.lit(0.0), F.least(F.lit(0.45), (0.08 + sensitivity * (1 - F.exp(-excess / 6))) * col(performance) / 4))
    tag = (
        F.when(is_high & is_stagnant, "Urgent Career-Pathing Trigger")
        .when(is_high & (x >= F.col("cohort_p75")), "Emerging Stagnation Warning")
        .when(~is_high & is_stagnant, "Tenured Core Contributor")
        .otherwise("Normal Progression")
    )
    work = work.withColumn("is_stagnant", F.coalesce(is_stagnant, F.lit(False))).withColumn("risk_surge", F.bround(F.when(is_high & is_stagnant, surge).otherwise(0.0), 4)).withColumn("career_status", tag)
    return work.withColumn("adjusted_flight_risk", F.least(F.lit(1.0), col(flight_risk) + F.col("risk_surge"))) if flight_risk else work


def span_of_control(tree: DataFrame, employee: str, manager: str, budget_hours: float = 10.0, best: tuple[int, int] = (4, 10), critical: int = 15) -> DataFrame:
    """Reports, load category and the attention each person gets from their manager. Several rows of a person: the last manager in order."""
    clean = lambda c: F.when(F.lower(F.trim(F.col(c).cast("string"))).isin("none", "nan", ""), None).otherwise(F.trim(F.col(c).cast("string")))
    rows = tree.select(clean(employee).alias("employee"), clean(manager).alias("manager")).where("employee is not null")
    spans = rows.where("manager is not null").groupBy(F.col("manager").alias("employee")).agg(F.countDistinct("employee").alias("span"))
    own = rows.groupBy("employee").agg(F.max("manager").alias("manager"))
    people = own.select("employee", "manager").join(spans, "employee", "full")
    bosses = spans.select(F.col("employee").alias("__m"), F.col("span").alias("manager_span"))
    low, high = best
    span, theirs = F.coalesce("span", F.lit(0)), F.col("manager_span")
    load = F.when(span == 0, "Individual Contributor").when(span < low, "Under-leveraged").when(span <= high, "Optimal").when(span <= critical, "Stretched").otherwise("Critical Overload")
    return people.join(bosses, F.col("manager") == F.col("__m"), "left").select(
        "employee", "manager", span.cast("bigint").alias("span"), (span > 0).alias("is_manager"), load.alias("load_category"), "manager_span",
        F.bround(60 * budget_hours / theirs, 1).alias("one_on_one_minutes"), F.bround(1 / (1 + F.exp(-(theirs - high) / 2.5)), 4).alias("dilution"),
    )


def reorg_shock(before: DataFrame, after: DataFrame, employee: str, manager: str, sensitivity: float = 0.15, base_risk: float = 0.15) -> DataFrame:
    """What a reorganisation does to each person's share of their manager, and the rise of flight risk where a large span grew."""
    pick = lambda df, k: span_of_control(df, employee, manager).select("employee", F.col("manager_span").alias(f"span_{k}"), F.col("one_on_one_minutes").alias(f"minutes_{k}"))
    both = pick(before, "pre").join(pick(after, "post"), "employee")
    pre, post = F.coalesce("span_pre", F.lit(0)), F.coalesce("span_post", F.lit(0))
    growth = post - pre
    shock = sensitivity * ((post - 10) / 15.0) * (1 + 0.5 * F.greatest(F.lit(0.0), growth / F.greatest(pre, F.lit(4))))
    shock = F.when((post > 10) & (growth > 0), F.greatest(F.lit(0.0), F.least(F.lit(0.45), shock))).otherwise(0.0)
    return both.select("employee", "span_pre", "span_post", growth.alias("span_change"), (F.coalesce("minutes_pre", F.lit(0.0)) - F.coalesce("minutes_post", F.lit(0.0))).alias("minutes_lost"), shock.alias("shock"), F.least(F.lit(1.0), base_risk + shock).alias("flight_risk_post"))


def transitions(steps: DataFrame, entity: str, state: str, order: list[str]) -> DataFrame:
    """Counts and probabilities of moves from one state to the next."""
    after = F.lead(state).over(Window.partitionBy(entity).orderBy(*order))
    moves = steps.select(F.col(state).alias("source"), after.alias("target")).where("source is not null and target is not null").groupBy("source", "target").agg(F.count("*").alias("n"))
    return moves.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("source")))


def reachability(p: DataFrame, steps: int = 3, decay: float = 0.6) -> DataFrame:
    """Sum over k of decay**(k-1) times the k-step transition probabilities, by self-joins."""
    power, parts = p.select("source", "target", "p"), [p.select("source", "target", "p")]
    for k in range(1, steps):
        right = p.select(F.col("source").alias("__via"), F.col("target").alias("__to"), F.col("p").alias("__p"))
        power = power.join(right, F.col("target") == F.col("__via")).groupBy("source", F.col("__to").alias("target")).agg(F.sum(F.col("p") * F.col("__p")).alias("p"))
        parts.append(power.withColumn("p", F.col("p") * decay**k))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.groupBy("source", "target").agg(F.sum("p").alias("reach"))
