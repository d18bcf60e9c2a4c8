"""Queries of window and temporal operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wfspark.functions.scores import fractional_weights
from wfspark.operators import temporal as T
from wfspark.plans.registry import DAYS, PANEL, days, panel, query, table

_W = "WINDOW w AS (PARTITION BY grp ORDER BY month)"


@query(f"""
WITH {PANEL}
SELECT grp, month, price, n,
  avg(price) OVER (PARTITION BY grp ORDER BY month ROWS 2 PRECEDING) AS price_roll_mean_3,
  CASE WHEN row_number() OVER w > 1 THEN sum(price) OVER (PARTITION BY grp ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END AS price_roll_sum_12_lag1,
  var_samp(price) OVER (PARTITION BY grp ORDER BY month ROWS 5 PRECEDING) AS price_roll_var_6,
  max(price) OVER (PARTITION BY grp ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS price_roll_max_6,
  lag(price, 1) OVER w AS price_lag_1, lag(price, 12) OVER w AS price_lag_12, lag(n, 1) OVER w AS n_lag_1,
  price - lag(price, 1) OVER w AS price_diff_1, 100 * (price - lag(price, 1) OVER w) / nullif(lag(price, 1) OVER w, 0) AS price_diff_1_pct
FROM panel {_W}""", "price price_roll_mean_3 price_roll_sum_12_lag1 price_roll_var_6 price_roll_max_6 price_lag_1 price_lag_12 price_diff_1 price_diff_1_pct", 9)
def rolling_features(spark: SparkSession, d: str) -> DataFrame:
    steps = T.TemporalPipeline(["grp"], "month")
    steps.add_metric(T.RollingMetric("price", 3), T.RollingMetric("price", 12, "sum", lag=1), T.RollingMetric("price", 6, "var"), T.RollingMetric("price", 6, "max", closed="left"))
    steps.add_lags("price", [1, 12]).add_lags("n", [1]).add_differencing(["price"], 1, pct_change=True)
    return steps.fit_transform(panel(spark, d))


@query(f"""
WITH {PANEL}, f AS (
  SELECT *, count(price) OVER f6 AS c, quantile_cont(price, 0.9) OVER f6 AS q, median(price) OVER f6 AS m, skewness(price) OVER f6 AS s, kurtosis(price) OVER f6 AS k FROM panel
  WINDOW f6 AS (PARTITION BY grp ORDER BY month ROWS 5 PRECEDING)
)
SELECT grp, month, CASE WHEN c >= 6 THEN q END AS q90, m AS med, CASE WHEN c >= 3 THEN s END AS skw, CASE WHEN c >= 4 THEN k END AS krt FROM f""", "q90 med skw krt")
def rolling_quantile_skew(spark: SparkSession, d: str) -> DataFrame:
    metrics = [
        T.RollingMetric("price", 6, "quantile", "q90", min_periods=None, quantile=0.9),
        T.RollingMetric("price", 6, "median", "med"),
        T.RollingMetric("price", 6, "skew", "skw"),
        T.RollingMetric("price", 6, "kurt", "krt"),
    ]
    return T.rolling_metrics(panel(spark, d), metrics, ["grp"], "month").drop("price", "n")


@query(f"""
WITH {PANEL}
SELECT grp, month, sum(n) OVER (PARTITION BY grp ORDER BY month ROWS 4 PRECEDING) AS whole, max(price) OVER b - min(price) OVER b AS spread, stddev_samp(price) OVER b AS deviation, count(price) OVER b AS seen
FROM panel WINDOW b AS (PARTITION BY grp ORDER BY month ROWS 5 PRECEDING)""", "whole spread deviation")
def rolling_closed_custom(spark: SparkSession, d: str) -> DataFrame:
    spread = [T.RollingMetric("price", 6, how, f"price_{k}") for k, how in (("max", F.max), ("min", F.min))]  # functions in place of names
    metrics = [T.RollingMetric("n", 4, "sum", "whole", closed="both"), *spread, T.RollingMetric("price", 6, "std", "deviation"), T.RollingMetric("price", 6, "count", "seen")]
    rows = T.rolling_metrics(panel(spark, d), metrics, ["grp"], "month")
    return rows.select("grp", "month", "whole", (F.col("price_max") - F.col("price_min")).alias("spread"), "deviation", "seen")


@query(f"""
WITH {PANEL}
SELECT grp, month, avg(price) OVER (PARTITION BY grp ORDER BY month ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS mid,
  sum(n) OVER (PARTITION BY grp ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS past,
  CASE WHEN row_number() OVER w > 2 THEN avg(n) OVER (PARTITION BY grp ORDER BY month ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) END AS shifted
FROM panel {_W}""", "mid past shifted")
def rolling_centered(spark: SparkSession, d: str) -> DataFrame:
    metrics = [T.RollingMetric("price", 5, output="mid", center=True), T.RollingMetric("n", 4, "sum", "past", closed="neither"), T.RollingMetric("n", 4, output="shifted", center=True, lag=2)]
    return T.rolling_metrics(panel(spark, d), metrics, ["grp"], "month").drop("price", "n")


@query(f"""
WITH {PANEL}
SELECT grp, month, {", ".join(f"n - lag(n, {k}) OVER w AS n_diff_{k}, (n - lag(n, {k}) OVER w) / nullif(lag(n, {k}) OVER w, 0) AS n_diff_{k}_pct" for k in (1, 3, 12))}
FROM panel {_W}""", "n_diff_1_pct n_diff_3_pct n_diff_12_pct")
def diff_features(spark: SparkSession, d: str) -> DataFrame:
    return T.differencing_features(panel(spark, d), ["n"], "monthly", ["grp"], "month", pct_change=True, as_percent=False).drop("price", "n")


@query(f"""
WITH {PANEL}
SELECT grp, month, {" + ".join(f"{w!r}::DOUBLE * lag(n, {k}) OVER w" for k, w in enumerate(fractional_weights(0.4, 1000, 1e-3)))} AS n_fracdiff FROM panel {_W}""", "n_fracdiff")
def frac_diff(spark: SparkSession, d: str) -> DataFrame:
    return T.fractional_difference(panel(spark, d), "n", 0.4, ["grp"], "month", threshold=1e-3).drop("price", "n")


@query("""
SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN 1.0 WHEN 'signup' THEN 0.6 WHEN 'click' THEN 0.3 ELSE 0.25 END * exp(-ln(2) * (25 - dayofmonth(ts)) / 8)) AS decayed_score,
  min(25.0 - dayofmonth(ts)) AS since_last, max_by(event_type, (dayofmonth(ts)::DOUBLE, event_type)) AS last_tier, count(*) AS n_events
FROM events WHERE dayofmonth(ts) <= 25 GROUP BY user_id""", "decayed_score")
def weighted_weeks_since(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("user_id", "event_type", F.dayofmonth("ts").cast("double").alias("day"))
    return T.weighted_weeks_since(events, 25, 8.0, "user_id", "day", "event_type", {"purchase": 1.0, "signup": 0.6, "click": 0.3})


@query("""
WITH c AS (SELECT user_id, event_type, count(*)::DOUBLE AS c FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
SELECT user_id, greatest((ln(sum(c)) - sum(c * ln(c)) / sum(c)) / ln(2), 0) AS entropy FROM c GROUP BY user_id""", "entropy")
def shannon_entropy(spark: SparkSession, d: str) -> DataFrame:
    return T.shannon_entropy(table(spark, d, "events"), "event_type", ["user_id"])


@query("""
WITH f AS (SELECT event_id, count(*) OVER r AS rows, list(event_type) OVER r AS seen FROM events WINDOW r AS (PARTITION BY user_id ORDER BY ts ROWS 6 PRECEDING)),
p AS (SELECT event_id, any_value(rows) AS rows, list_sum(list_transform(map_values(histogram(x)), lambda c: -(c::DOUBLE / 1) * ln(c))) AS s, count(*)::DOUBLE AS n, count(DISTINCT x) AS kinds
      FROM (SELECT event_id, rows, unnest(seen) AS x FROM f) GROUP BY event_id)
SELECT event_id, CASE WHEN rows >= 3 THEN CASE WHEN kinds <= 1 THEN 0.0 ELSE (ln(n) + s / n) / ln(greatest(2, kinds)) END END AS rolling_entropy FROM p""", "rolling_entropy")
def rolling_entropy(spark: SparkSession, d: str) -> DataFrame:
    return T.rolling_entropy(table(spark, d, "events"), "event_type", 7, ["user_id"], "ts", normalize=True).select("event_id", "rolling_entropy")


def _tenure(spark: SparkSession, d: str) -> DataFrame:
    span = table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    months = (F.year("b") - F.year("a")) * 12 + F.month("b") - F.month("a")
    return span.select("o_custkey", months.cast("double").alias("tenure"), (F.to_date("b") < F.lit("2000-08-01").cast("date")).cast("double").alias("event"))


_TENURE = """span AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1),
tenure AS (SELECT o_custkey, ((year(b) - year(a)) * 12 + month(b) - month(a))::DOUBLE AS tenure, (b::DATE < DATE '2000-08-01')::INT::DOUBLE AS event FROM span)"""
_CURVE = f"""{_TENURE},
pts AS (SELECT tenure AS t, sum(event) AS d, count(*)::DOUBLE AS n FROM tenure GROUP BY 1),
risk AS (SELECT *, sum(n) OVER (ORDER BY t DESC) AS r FROM pts),
steps AS (SELECT t, CASE WHEN max((d >= r)::INT) OVER o = 1 THEN 0.0 ELSE exp(sum(CASE WHEN d < r THEN ln(1 - d / r) ELSE 0 END) OVER o) END AS survival, sum(d / r) OVER o AS hazard FROM risk WINDOW o AS (ORDER BY t)),
grid AS (SELECT unnest(range(1, (SELECT max(tenure)::BIGINT FROM tenure) + 1)) AS tenure),
curve AS (SELECT tenure, coalesce((SELECT survival FROM steps WHERE t <= tenure ORDER BY t DESC LIMIT 1), 1.0) AS survival, coalesce((SELECT hazard FROM steps WHERE t <= tenure ORDER BY t DESC LIMIT 1), 0.0) AS hazard FROM grid)"""


@query(f"WITH {_CURVE} SELECT * FROM curve", "survival hazard")
def hazard_embeddings(spark: SparkSession, d: str) -> DataFrame:
    return T.hazard_curve(_tenure(spark, d), "tenure", "event")


@query(f"""WITH {_CURVE}, z AS (SELECT max_by(survival, tenure) AS ls, max_by(hazard, tenure) AS lh FROM curve)
SELECT o_custkey, t.tenure, event, coalesce(survival, ls) AS survival, coalesce(hazard, lh) AS hazard FROM tenure t LEFT JOIN curve c ON t.tenure = c.tenure CROSS JOIN z""", "survival hazard")
def hazard_features(spark: SparkSession, d: str) -> DataFrame:
    rows = _tenure(spark, d)
    return T.hazard_features(rows, T.hazard_curve(rows, "tenure", "event"), "tenure")


def _states(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    after = F.lead("s").over(Window.partitionBy("user_id").orderBy("s", "event_type"))
    return table(spark, d, "events").select("user_id", "event_type", seconds.alias("s")).withColumn("e", after).where("e is not null").withColumn("s", F.col("s") / 3600).withColumn("e", F.col("e") / 3600)


_RATES = """s AS (SELECT user_id, event_type, epoch_us(ts) / 1e6 / 3600 AS s, lead(epoch_us(ts) / 1e6 / 3600) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS e FROM events),
moved AS (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY s, e, event_type) AS nxt, greatest(0.01, e - s) AS dt FROM s WHERE e IS NOT NULL),
tt AS (SELECT event_type AS source, sum(dt) AS total_time FROM moved GROUP BY 1),
rates AS (SELECT source, nxt AS target, count(*) AS moves, any_value(total_time) AS total_time, count(*) / any_value(total_time) AS rate FROM moved JOIN tt ON source = event_type WHERE nxt <> event_type GROUP BY ALL)"""


@query(f"WITH {_RATES} SELECT * FROM rates", "total_time rate")
def ctmc_rates(spark: SparkSession, d: str) -> DataFrame:
    return T.ctmc_rates(_states(spark, d), "user_id", "event_type", "s", "e")


@query(f"""WITH {_RATES}, st AS (SELECT source AS state, 1 / sum(rate) AS sojourn FROM rates GROUP BY 1), m AS (SELECT median(sojourn) AS median FROM st)
SELECT state, sojourn, sojourn > 1.4 * median AS is_bottleneck, sojourn / (median + 1e-6) AS drag FROM st CROSS JOIN m""", "sojourn drag")
def ctmc_sojourn(spark: SparkSession, d: str) -> DataFrame:
    return T.ctmc_sojourn(T.ctmc_rates(_states(spark, d), "user_id", "event_type", "s", "e"))
