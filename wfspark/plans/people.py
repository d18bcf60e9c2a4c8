"""Queries of encoders, pay, fairness, attribution, absence and hierarchy operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wfspark.functions import pay, scores
from wfspark.operators import encoding as E
from wfspark.operators import equity as Q
from wfspark.operators import mobility as M
from wfspark.plans.registry import query, table


def _customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal", (F.col("c_acctbal") < 0).cast("double").alias("y"))


_CUST = "c AS (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, (c_acctbal < 0)::INT::DOUBLE AS y FROM customer)"


@query(f"""WITH {_CUST}, g AS (SELECT avg(y) AS mu FROM c)
SELECT c_custkey, (sum(y) OVER k + 10 * mu) / (count(*) OVER k + 10) AS encoded FROM c CROSS JOIN g WINDOW k AS (PARTITION BY c_nationkey, c_mktsegment)""", "encoded")
def target_encode(spark: SparkSession, d: str) -> DataFrame:
    rows = _customers(spark, d)
    return E.TargetEncoder(["c_nationkey", "c_mktsegment"], "y").fit(rows).transform(rows).select("c_custkey", "encoded")


@query(f"""WITH {_CUST}, f AS (SELECT *, c_custkey % 5 AS fold FROM c),
g AS (SELECT a.fold, (SELECT avg(y) FROM f b WHERE b.fold <> a.fold) AS mu FROM (SELECT DISTINCT fold FROM f) a)
SELECT c_custkey, (sum(y) OVER k - sum(y) OVER kf + 10 * mu) / (count(*) OVER k - count(*) OVER kf + 10) AS encoded FROM f JOIN g USING (fold)
WINDOW k AS (PARTITION BY c_nationkey, c_mktsegment), kf AS (PARTITION BY c_nationkey, c_mktsegment, fold)""", "encoded")
def target_encode_oof(spark: SparkSession, d: str) -> DataFrame:
    return E.TargetEncoder(["c_nationkey", "c_mktsegment"], "y").out_of_fold(_customers(spark, d), F.col("c_custkey") % 5).select("c_custkey", "encoded")


@query(f"""WITH {_CUST}, g AS (SELECT avg(y) AS mu FROM c), codes AS (SELECT c_nationkey, (sum(y) + 10 * any_value(mu)) / (count(*) + 10) AS code, count(*) AS n FROM c CROSS JOIN g GROUP BY 1),
v AS (SELECT c_custkey, (c_custkey % 97) / 485.0 AS v FROM c)
SELECT c_custkey, min_by(c_nationkey, (abs(code - v), code, -n, c_nationkey)) AS decoded FROM v CROSS JOIN codes GROUP BY 1""")
def target_decode(spark: SparkSession, d: str) -> DataFrame:
    rows = _customers(spark, d)
    values = rows.select("c_custkey", ((F.col("c_custkey") % 97) / 485.0).alias("v"))
    return E.TargetEncoder(["c_nationkey"], "y").fit(rows).inverse(values, "v", "c_custkey").select("c_custkey", "decoded")


@query(f"""WITH {_CUST}, s AS (SELECT *, count(*) OVER k AS n, avg(c_acctbal) OVER k AS m, stddev_samp(c_acctbal) OVER k AS sd FROM c WINDOW k AS (PARTITION BY c_nationkey, c_mktsegment)),
l AS (SELECT *, (m * n - c_acctbal) / nullif(n - 1, 0) AS lm, greatest(sqrt(greatest((sd * sd * (n - 1) - pow(c_acctbal - m, 2) * n / nullif(n - 1, 0)) / nullif(n - 2, 0), 0)), 1e-6) AS ls FROM s)
SELECT c_custkey, n AS cohort_size, CASE WHEN n < 3 THEN 0.0 WHEN abs(c_acctbal - m) < 1e-6 THEN 0.0 ELSE (c_acctbal - m) / greatest(sd, 1e-6) END AS standard_z_score,
  CASE WHEN n >= 3 THEN lm ELSE m END AS loo_cohort_mean, CASE WHEN n >= 3 THEN ls ELSE 0.0 END AS loo_cohort_std,
  CASE WHEN n < 3 OR abs(c_acctbal - lm) < 1e-6 THEN 0.0 ELSE (c_acctbal - lm) / ls END AS loo_z_score FROM l""", "standard_z_score loo_cohort_mean loo_cohort_std loo_z_score", 7)
def loo_zscore(spark: SparkSession, d: str) -> DataFrame:
    return E.loo_zscore(_customers(spark, d), ["c_nationkey", "c_mktsegment"], "c_acctbal").drop("c_nationkey", "c_mktsegment", "c_acctbal", "y")


@query("""WITH s AS (SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer GROUP BY 1),
g AS (SELECT avg(c_acctbal) AS gm, stddev_samp(c_acctbal) AS gs FROM customer)
SELECT s_suppkey, coalesce(n, 0) AS cohort_size, CASE WHEN n < 3 THEN 0.0 ELSE (s_acctbal - coalesce(m, gm)) / greatest(CASE WHEN n IS NULL THEN gs ELSE sd END, 1e-6) END AS z_score
FROM supplier LEFT JOIN s ON c_nationkey = s_nationkey CROSS JOIN g""", "z_score")
def loo_zscore_outofsample(spark: SparkSession, d: str) -> DataFrame:
    fitted = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("bal"))
    rows = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return E.cohort_zscore(fitted, rows, ["nation"], "bal").select("s_suppkey", "cohort_size", "z_score")


_BANDS = "b AS (SELECT p_brand, min(p_retailprice) * 0.9 + max(p_retailprice) * 0.1 AS lo, min(p_retailprice) * 0.1 + max(p_retailprice) * 0.9 AS hi FROM part GROUP BY 1)"


@query(f"""WITH {_BANDS}, r AS (SELECT p_partkey, p_retailprice AS s, lo, hi, CASE WHEN hi > lo THEN (p_retailprice - lo) / (hi - lo) END AS rp FROM part JOIN b USING (p_brand))
SELECT p_partkey, (lo + hi) / 2 AS midpoint, CASE WHEN lo + hi > 0 THEN s / ((lo + hi) / 2) END AS compa, rp AS penetration,
CASE WHEN rp IS NULL THEN 'Unknown' WHEN rp < 0 THEN 'Green-Circled (<Min)' WHEN rp < 0.25 THEN 'Q1: Developing (0-25%)' WHEN rp < 0.5 THEN 'Q2: Core Proficient (25-50%)' WHEN rp < 0.75 THEN 'Q3: Advanced (50-75%)'
 WHEN rp <= 1 THEN 'Q4: Senior Cap (75-100%)' ELSE 'Red-Circled (>Max)' END AS status, coalesce(s > hi, false) AS is_red, coalesce(s < lo, false) AS is_green FROM r""", "midpoint compa penetration")
def pay_bands(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    band = part.groupBy("p_brand").agg((F.min("p_retailprice") * 0.9 + F.max("p_retailprice") * 0.1).alias("lo"), (F.min("p_retailprice") * 0.1 + F.max("p_retailprice") * 0.9).alias("hi"))
    return part.join(band, "p_brand").select(
        "p_partkey", pay.band_midpoint("lo", "hi").alias("midpoint"), pay.compa_ratio("p_retailprice", band_min="lo", band_max="hi").alias("compa"), pay.range_penetration("p_retailprice", "lo", "hi").alias("penetration"),
        pay.pay_band_status("p_retailprice", "lo", "hi").alias("status"), pay.red_circled("p_retailprice", "hi").alias("is_red"), pay.green_circled("p_retailprice", "lo").alias("is_green"),
    )


_MIX = """m AS (SELECT n_nationkey, c_mktsegment AS seg FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)),
p AS (SELECT m.n_nationkey, m.seg, count(c_custkey)::DOUBLE AS p FROM m LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = seg GROUP BY ALL),
q AS (SELECT c_mktsegment AS seg, count(*)::DOUBLE AS q FROM customer GROUP BY 1),
e AS (SELECT n_nationkey, seg, (p + 1e-9) / sum(p + 1e-9) OVER (PARTITION BY n_nationkey) AS p, (q + 1e-9) / sum(q + 1e-9) OVER (PARTITION BY n_nationkey) AS q FROM p JOIN q USING (seg))"""


@query(f"""WITH {_MIX} SELECT n_nationkey, greatest(sum(p * ln(p / q)), 0) AS kl, sqrt(greatest((sum(p * ln(p / ((p + q) / 2))) + sum(q * ln(q / ((p + q) / 2)))) / 2, 0)) AS js FROM e GROUP BY 1""", "kl js")
def divergence_drift(spark: SparkSession, d: str) -> DataFrame:
    customer = table(spark, d, "customer")
    q = customer.groupBy("c_mktsegment").agg(F.count("*").cast("double").alias("q"))
    grid = table(spark, d, "nation").select("n_nationkey").crossJoin(F.broadcast(q))
    p = customer.groupBy(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").agg(F.count("*").cast("double").alias("p"))
    both = grid.join(p, ["n_nationkey", "c_mktsegment"], "left").groupBy("n_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_mktsegment", F.coalesce("p", F.lit(0.0)).alias("p"), "q"))).alias("m"))
    return both.select("n_nationkey", scores.kl_divergence(F.col("m.p"), F.col("m.q")).alias("kl"), scores.js_divergence(F.col("m.p"), F.col("m.q")).alias("js"))


_LMDI = """y AS (SELECT c_mktsegment AS seg, year(o_orderdate) AS y, count(*)::DOUBLE AS h, avg((o_orderstatus = 'F')::INT) AS r FROM orders JOIN customer ON c_custkey = o_custkey WHERE year(o_orderdate) IN (1999, 2000) GROUP BY ALL),
w AS (SELECT seg, sum(h) FILTER (y = 1999) AS h0, sum(r) FILTER (y = 1999) AS r0, sum(h) FILTER (y = 2000) AS h1, sum(r) FILTER (y = 2000) AS r1 FROM y GROUP BY 1),
s AS (SELECT *, h0 / sum(h0) OVER () AS s0, h1 / sum(h1) OVER () AS s1 FROM w),
l AS (SELECT *, CASE WHEN s0 * r0 <= 0 OR s1 * r1 <= 0 THEN 0 WHEN abs(s1 * r1 - s0 * r0) < 1e-12 THEN s1 * r1 ELSE (s1 * r1 - s0 * r0) / (ln(s1 * r1) - ln(s0 * r0)) END AS lw FROM s),
e AS (SELECT seg, s0 AS share_0, s1 AS share_1, CASE WHEN lw = 0 THEN 0.0 ELSE lw * ln(r1 / r0) END AS rate_effect, CASE WHEN lw = 0 THEN 0.0 ELSE lw * ln(s1 / s0) END AS mix_effect, s1 * r1 - s0 * r0 AS change FROM l)"""


def _lmdi(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("y", F.year("o_orderdate")).where("y in (1999, 2000)")
    is_f = (F.col("o_orderstatus") == "F").cast("double")
    aggs = [f(F.when(F.col("y") == y, v)).alias(f"{n}{k}") for k, y in enumerate((1999, 2000)) for n, f, v in (("h", F.count, F.lit(1)), ("r", F.avg, is_f))]
    return Q.lmdi(orders.groupBy(F.col("c_mktsegment").alias("seg")).agg(*aggs), "seg", "h0", "r0", "h1", "r1")


@query(f"WITH {_LMDI} SELECT * FROM e", "share_0 share_1 rate_effect mix_effect change")
def lmdi(spark: SparkSession, d: str) -> DataFrame:
    return _lmdi(spark, d)


@query(f"WITH {_LMDI} SELECT sum(rate_effect) AS rate_effect, sum(mix_effect) AS mix_effect, sum(change) AS change, 0.0::DOUBLE AS residual FROM e", "rate_effect mix_effect change residual")
def lmdi_summary(spark: SparkSession, d: str) -> DataFrame:
    return Q.lmdi_summary(_lmdi(spark, d)).withColumn("residual", F.abs(F.round("residual", 9)))


_GAP = "g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS mean, median(c_acctbal) AS median FROM customer GROUP BY 1), a AS (SELECT * FROM g WHERE g = 'BUILDING'), b AS (SELECT * FROM g WHERE g = 'MACHINERY')"


@query(f"""WITH {_GAP} SELECT a.mean AS ref_mean, a.median AS ref_median, a.n AS ref_n, b.mean AS cmp_mean, b.median AS cmp_median, b.n AS cmp_n, 100 * (a.mean - b.mean) / a.mean AS mean_gap_pct,
100 * (a.median - b.median) / a.median AS median_gap_pct, b.mean / a.mean AS mean_ratio, b.median / a.median AS median_ratio FROM a, b""", "ref_mean ref_median cmp_mean cmp_median mean_gap_pct median_gap_pct mean_ratio median_ratio")
def pay_equity_gap(spark: SparkSession, d: str) -> DataFrame:
    return Q.pay_gap(table(spark, d, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")


@query(f"WITH {_GAP} SELECT 100 * (a.median - b.median) / a.median AS median_gap_pct FROM a, b", "median_gap_pct")
def median_gap(spark: SparkSession, d: str) -> DataFrame:
    return Q.median_gap(table(spark, d, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")


@query("""SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS mean, median(c_acctbal) AS median, quantile_cont(c_acctbal, 0.25) AS p25, quantile_cont(c_acctbal, 0.75) AS p75, stddev_samp(c_acctbal) AS std, min(c_acctbal) AS min, max(c_acctbal) AS max
FROM customer GROUP BY 1""", "mean median p25 p75 std", 5)
def pay_group_stats(spark: SparkSession, d: str) -> DataFrame:
    return Q.group_pay(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")


@query("""WITH e AS (SELECT quantile_cont(c_acctbal, 0.25) AS a, quantile_cont(c_acctbal, 0.5) AS b, quantile_cont(c_acctbal, 0.75) AS c FROM customer),
q AS (SELECT CASE WHEN c_acctbal <= a THEN 'Q1_Lower' WHEN c_acctbal <= b THEN 'Q2_Lower_Middle' WHEN c_acctbal <= c THEN 'Q3_Upper_Middle' ELSE 'Q4_Upper' END AS quartile, c_mktsegment, count(*) AS n FROM customer, e GROUP BY ALL)
SELECT *, 100 * n / sum(n) OVER (PARTITION BY quartile) AS share_pct FROM q""", "share_pct")
def pay_quartiles(spark: SparkSession, d: str) -> DataFrame:
    return Q.pay_quartiles(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")


@query("""WITH k AS (SELECT c_nationkey, count(*) AS n, median(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS rm, median(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS cm, avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS ra, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS ca FROM customer GROUP BY 1)
SELECT sum(n * 100 * (rm - cm) / rm) / sum(n) AS median_gap_pct, sum(n * 100 * (ra - ca) / ra) / sum(n) AS mean_gap_pct, count(*) AS n_cohorts, sum(n)::BIGINT AS n_rows FROM k WHERE rm > 0 AND cm IS NOT NULL AND ra > 0 AND ca IS NOT NULL""", "median_gap_pct mean_gap_pct")
def controlled_gap(spark: SparkSession, d: str) -> DataFrame:
    return Q.controlled_gap(table(spark, d, "customer"), "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY", ["c_nationkey"])


@query("""WITH g AS (SELECT o_orderpriority, avg((o_totalprice > 150000)::INT) AS rate, coalesce(avg((o_totalprice > 150000)::INT) FILTER (o_orderstatus = 'F'), 0) AS tpr, coalesce(avg((o_totalprice > 150000)::INT) FILTER (o_orderstatus <> 'F'), 0) AS fpr FROM orders GROUP BY 1)
SELECT max(rate) - min(rate) AS dp_difference, min(rate) / max(rate) AS dp_ratio, greatest(max(tpr) - min(tpr), max(fpr) - min(fpr)) AS eo_difference FROM g""", "dp_difference dp_ratio eo_difference")
def group_fairness(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderpriority", (F.col("o_totalprice") > 150000).cast("int").alias("p"), (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return Q.fairness(rows, "p", "o_orderpriority", "y")


_QINI = """r AS (SELECT (o_orderstatus = 'F')::INT::DOUBLE AS y, (o_orderpriority < '3')::INT::DOUBLE AS t, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, count(*) OVER () AS n FROM orders),
s AS (SELECT place, n, sum(y * t) OVER o AS yt, sum(y * (1 - t)) OVER o AS yc, sum(t) OVER o AS nt, sum(1 - t) OVER o AS nc FROM r WINDOW o AS (ORDER BY place)),
c AS (SELECT b AS bin, k AS n_targeted, coalesce(nt, 0) AS n_treated, coalesce(nc, 0) AS n_control, coalesce(yt, 0) - CASE WHEN coalesce(nc, 0) > 0 THEN nt / nc * yc ELSE 0 END AS gain
 FROM (SELECT b, ceil(b * (SELECT count(*) FROM orders) / {0}.0)::BIGINT AS k FROM range(0, {0} + 1) t(b)) m LEFT JOIN s ON place = k)"""


def _uplift(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("double").alias("y"), (F.col("o_orderpriority") < "3").cast("double").alias("t"), F.col("o_totalprice").alias("s"))


@query(f"WITH {_QINI.format(10)} SELECT * FROM c", "gain")
def qini_curve(spark: SparkSession, d: str) -> DataFrame:
    return Q.qini_curve(_uplift(spark, d), "y", "t", "s", "o_orderkey")


@query(f"WITH {_QINI.format(20)}, a AS (SELECT bin, gain, (gain + lag(gain) OVER (ORDER BY bin)) / 40 AS area FROM c) SELECT sum(area) AS auuc, sum(area) - max_by(gain, bin) / 2 AS qini_score FROM a", "auuc qini_score")
def auuc(spark: SparkSession, d: str) -> DataFrame:
    return Q.auuc(_uplift(spark, d), "y", "t", "s", "o_orderkey")


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'error' AND ts::DATE BETWEEN DATE '2024-01-31' - 21 AND DATE '2024-01-31'),
m AS (SELECT user_id, (day - lag(day) OVER (PARTITION BY user_id ORDER BY day) IS DISTINCT FROM 1)::INT AS new FROM d),
c AS (SELECT user_id, sum(new) AS s, count(*) AS n FROM m GROUP BY 1)
SELECT u.user_id, coalesce(s, 0)::BIGINT AS spells, coalesce(n, 0)::BIGINT AS days_absent, (coalesce(s, 0) * coalesce(s, 0) * coalesce(n, 0))::DOUBLE AS bradford_score, CASE WHEN n > 0 THEN s * s ELSE 1 END::BIGINT AS disruption,
CASE WHEN coalesce(s * s * n, 0) <= 50 THEN 'Low Friction' WHEN s * s * n <= 200 THEN 'Moderate Friction' WHEN s * s * n <= 500 THEN 'Substantial Friction' ELSE 'Critical Friction' END AS risk
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c USING (user_id)""")
def bradford_daily(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    absent = events.where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day")).distinct()
    out = M.bradford_daily(absent, events, "user_id", "day", F.lit("2024-01-31").cast("date"), 3)
    return out.withColumn("risk", scores.bradford_risk("bradford_score")).withColumn("disruption", F.col("disruption").cast("bigint"))


@query("""WITH c AS (SELECT o_custkey, count(*) AS s, sum(1 + o_orderkey % 4) AS n FROM orders WHERE o_orderdate::DATE BETWEEN DATE '2001-06-30' - 364 AND DATE '2001-06-30' GROUP BY 1)
SELECT c_custkey AS o_custkey, coalesce(s, 0)::BIGINT AS spells, coalesce(n, 0)::BIGINT AS days_absent, (coalesce(s * s * n, 0))::DOUBLE AS bradford_score, CASE WHEN n > 0 THEN s * s ELSE 1 END::BIGINT AS disruption FROM customer LEFT JOIN c ON o_custkey = c_custkey""")
def bradford_spells(spark: SparkSession, d: str) -> DataFrame:
    spells = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("start"), (1 + F.col("o_orderkey") % 4).alias("days"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return M.bradford_spells(spells, people, "o_custkey", "start", "days", F.lit("2001-06-30").cast("date")).withColumn("disruption", F.col("disruption").cast("bigint"))


_POS = """l AS (SELECT o_custkey, max(o_orderdate) AS since FROM orders GROUP BY 1),
t AS (SELECT c_custkey, c_nationkey, 1 + c_custkey % 5 AS perf, greatest(epoch_us((SELECT max(since) FROM l)) - epoch_us(since), 0) / (86400e6 * 30.4375) AS m FROM l JOIN customer ON c_custkey = o_custkey)"""


def _positions(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("since"))
    rows = last.join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_nationkey", (1 + F.col("c_custkey") % 5).alias("perf"), F.col("since").cast("timestamp").alias("since"))
    return M.time_in_position(rows, "since", output="months")


@query(f"WITH {_POS} SELECT c_custkey, round_even(m, 1) AS months FROM t")
def time_in_position(spark: SparkSession, d: str) -> DataFrame:
    return _positions(spark, d).select("c_custkey", "months")


@query(f"""WITH {_POS}, r AS (SELECT c_custkey, c_nationkey, perf, round_even(m, 1) AS m FROM t),
s AS (SELECT *, quantile_cont(m, 0.5) OVER k AS cohort_median, quantile_cont(m, 0.9) OVER k AS cohort_p90, quantile_cont(m, 0.75) OVER k AS cohort_p75,
 (rank() OVER (PARTITION BY c_nationkey ORDER BY m) + (count(*) OVER (PARTITION BY c_nationkey, m) - 1) / 2.0) / count(*) OVER k AS percentile FROM r WINDOW k AS (PARTITION BY c_nationkey))
SELECT c_custkey, cohort_median, cohort_p90, cohort_p75, percentile, m >= cohort_p90 AS is_stagnant,
 CASE WHEN perf >= 4 AND m >= cohort_p90 THEN greatest(0, least(0.45, (0.08 + 0.25 * (1 - exp(-greatest(m - cohort_p75, 0) / 6))) * perf / 4)) ELSE 0 END AS risk_surge,
 CASE WHEN perf >= 4 AND m >= cohort_p90 THEN 'Urgent Career-Pathing Trigger' WHEN perf >= 4 AND m >= cohort_p75 THEN 'Emerging Stagnation Warning' WHEN perf < 4 AND m >= cohort_p90 THEN 'Tenured Core Contributor' ELSE 'Normal Progression' END AS career_status FROM s""",
 "cohort_median cohort_p90 cohort_p75 percentile risk_surge", 4)
def stagnation_index(spark: SparkSession, d: str) -> DataFrame:
    return M.stagnation_index(_positions(spark, d), "months", ["c_nationkey"], "perf").drop("c_nationkey", "perf", "since", "months")


_SPAN = """{0} AS (SELECT employee, manager, coalesce(span, 0) AS span, manager_span FROM (SELECT s_suppkey::VARCHAR AS employee, 'm' || {1} AS manager FROM supplier UNION ALL SELECT DISTINCT 'm' || {1}, NULL FROM supplier)
 LEFT JOIN (SELECT 'm' || {1} AS employee, count(*) AS span FROM supplier GROUP BY 1) USING (employee) LEFT JOIN (SELECT 'm' || {1} AS manager, count(*) AS manager_span FROM supplier GROUP BY 1) USING (manager))"""


def _tree(spark: SparkSession, d: str, boss: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("e"), F.concat(F.lit("m"), F.expr(boss)).alias("m"))


@query(f"""WITH {_SPAN.format("p", "s_nationkey")} SELECT employee, manager, span::BIGINT AS span, span > 0 AS is_manager,
CASE WHEN span = 0 THEN 'Individual Contributor' WHEN span < 4 THEN 'Under-leveraged' WHEN span <= 10 THEN 'Optimal' WHEN span <= 15 THEN 'Stretched' ELSE 'Critical Overload' END AS load_category, manager_span,
round_even(600.0 / manager_span, 1) AS one_on_one_minutes, round_even(1 / (1 + exp(-(manager_span - 10) / 2.5)), 4) AS dilution FROM p""")
def span_of_control(spark: SparkSession, d: str) -> DataFrame:
    return M.span_of_control(_tree(spark, d, "s_nationkey"), "e", "m")


@query(f"""WITH {_SPAN.format("a", "s_nationkey")}, {_SPAN.format("b", "(s_suppkey % 7)")},
j AS (SELECT employee, a.manager_span AS span_pre, b.manager_span AS span_post, coalesce(b.manager_span, 0) - coalesce(a.manager_span, 0) AS span_change, coalesce(round_even(600.0 / a.manager_span, 1), 0) - coalesce(round_even(600.0 / b.manager_span, 1), 0) AS minutes_lost FROM a JOIN b USING (employee)),
k AS (SELECT *, CASE WHEN span_post > 10 AND span_change > 0 THEN greatest(0, least(0.45, 0.15 * ((span_post - 10) / 15.0) * (1 + 0.5 * greatest(0, span_change / greatest(coalesce(span_pre, 0), 4))))) ELSE 0.0 END AS shock FROM j)
SELECT *, least(1.0, 0.15 + shock) AS flight_risk_post FROM k""", "minutes_lost shock flight_risk_post")
def reorg_shock(spark: SparkSession, d: str) -> DataFrame:
    return M.reorg_shock(_tree(spark, d, "s_nationkey"), _tree(spark, d, "s_suppkey % 7"), "e", "m")


_MOVES = """s AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events),
k AS (SELECT source, target, count(*) AS n FROM s WHERE target IS NOT NULL GROUP BY ALL),
p AS (SELECT source, target, n, n / sum(n) OVER (PARTITION BY source) AS p FROM k)"""


@query(f"WITH {_MOVES} SELECT * FROM p", "p")
def career_transitions(spark: SparkSession, d: str) -> DataFrame:
    return M.transitions(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query(f"""WITH {_MOVES}, p2 AS (SELECT a.source, b.target, sum(a.p * b.p) AS p FROM p a JOIN p b ON a.target = b.source GROUP BY ALL), p3 AS (SELECT a.source, b.target, sum(a.p * b.p) AS p FROM p2 a JOIN p b ON a.target = b.source GROUP BY ALL)
SELECT source, target, sum(p) AS reach FROM (SELECT source, target, p FROM p UNION ALL SELECT source, target, 0.6 * p FROM p2 UNION ALL SELECT source, target, 0.36 * p FROM p3) GROUP BY ALL""", "reach")
def career_reachability(spark: SparkSession, d: str) -> DataFrame:
    return M.reachability(M.transitions(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]))
