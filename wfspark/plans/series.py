"""Queries of series models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wfspark.operators import series as S
from wfspark.plans.registry import DAYS, PANEL, days, panel, query, table


def _fold(start: str, step: str) -> str:
    """Recursive SQL over the days of a user: ``start`` and ``step`` give the new state from n and the old state s."""
    return f"""WITH RECURSIVE {DAYS}, r AS (SELECT user_id, day, n, row_number() OVER (PARTITION BY user_id ORDER BY day) AS i FROM days),
f AS (SELECT user_id, day, n, i, {start} AS s FROM r WHERE i = 1 UNION ALL SELECT r.user_id, r.day, r.n, r.i, {step} FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)"""


@query(f"{_fold('n', '0.25 * r.n + 0.75 * f.s')} SELECT user_id, day, n, s AS ewma FROM f", "ewma")
def ewma(spark: SparkSession, d: str) -> DataFrame:
    return S.ewma(days(spark, d), ["user_id"], "day", "n", alpha=0.25)


@query(f"{_fold('n', 'r.n + 0.5 ** (1 / 8.0) * f.s')} SELECT user_id, day, n, s AS ewms FROM f", "ewms")
def ewms(spark: SparkSession, d: str) -> DataFrame:
    return S.ewms(days(spark, d), ["user_id"], "day", "n", half_life=8)


@query(f"{_fold('n', '0.2 * r.n + 0.8 * f.s')}, m AS (SELECT user_id, avg(n) AS m FROM days GROUP BY 1) SELECT user_id, day, n, s AS ewma, (s - m) / sqrt(0.2 / 1.8 * greatest(1e-6, m)) AS z FROM f JOIN m USING (user_id)", "ewma z")
def poisson_ewma(spark: SparkSession, d: str) -> DataFrame:
    return S.poisson_ewma(days(spark, d), ["user_id"], "day", "n")


_SPANS = f"""WITH RECURSIVE {PANEL}, r AS (SELECT grp, price AS x, row_number() OVER (PARTITION BY grp ORDER BY month) AS i FROM panel),
s AS (SELECT unnest([2.0, 4.0, 8.0, 12.0, 26.0])::DOUBLE AS span), f AS (SELECT grp, span, i, x, x AS e FROM r, s WHERE i = 1 UNION ALL SELECT r.grp, f.span, r.i, r.x, 2 / (f.span + 1) * r.x + (1 - 2 / (f.span + 1)) * f.e FROM f JOIN r ON r.grp = f.grp AND r.i = f.i + 1),
d AS (SELECT *, x - lag(e) OVER w AS step, e - lag(e) OVER w AS de, x - lag(x) OVER w AS dx FROM f WINDOW w AS (PARTITION BY grp, span ORDER BY i)),
m AS (SELECT grp, span, -ln(2) / ln(1 - 2 / (span + 1)) AS half_life, sqrt(avg(step * step)) AS rmse_one_step, avg(abs(step)) AS mae_one_step, sqrt(avg((x - e) * (x - e))) AS rmse_in_sample, count(step) * ln(avg(step * step)) + 2 AS aic,
  count(step) * ln(avg(step * step)) + ln(count(step)) AS bic, stddev_samp(de) / stddev_samp(dx) AS noise_reduction, corr(x, e) AS correlation FROM d GROUP BY 1, 2)
SELECT *, (row_number() OVER (PARTITION BY grp ORDER BY rmse_one_step, span) = 1)::INT::DOUBLE AS is_optimal FROM m"""


@query(_SPANS, "half_life rmse_one_step mae_one_step rmse_in_sample aic bic noise_reduction correlation")
def ewma_span_scan(spark: SparkSession, d: str) -> DataFrame:
    return S.ewma_span_scan(panel(spark, d), ["grp"], "month", "price", [2, 4, 8, 12, 26]).drop("target_correlation", "target_r2")


@query()
def double_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return S.exponential_smoothing(panel(spark, d), ["grp"], "month", "price")


_ROWS = f"{PANEL}, r AS (SELECT grp, month, price AS x, row_number() OVER (PARTITION BY grp ORDER BY month) AS i, count(*) OVER (PARTITION BY grp) AS n FROM panel)"

_HOLT = f"""WITH RECURSIVE {_ROWS}, f AS (SELECT a.grp, 1 AS i, a.x - (b.x - a.x) + (b.x - a.x) AS fit, a.x AS level, 0.1 * (a.x - (a.x - (b.x - a.x))) + 0.9 * (b.x - a.x) AS trend, a.x FROM r a JOIN r b ON b.grp = a.grp AND b.i = 2 WHERE a.i = 1
  UNION ALL SELECT r.grp, r.i, f.level + f.trend, 0.4 * r.x + 0.6 * (f.level + f.trend), 0.1 * (0.4 * r.x + 0.6 * (f.level + f.trend) - f.level) + 0.9 * f.trend, r.x FROM f JOIN r ON r.grp = f.grp AND r.i = f.i + 1),
e AS (SELECT grp, sum((x - fit) * (x - fit)) AS sse, count(*) AS n, max_by(level, i) AS level, max_by(trend, i) AS trend FROM f GROUP BY 1)
SELECT grp, sse, n * ln(sse / n) + 8 AS aic, n * ln(sse / n) + 4 * ln(n) AS bic, level + trend AS step_1, level + 2 * trend AS step_2, level + 3 * trend AS step_3 FROM e"""


@query(_HOLT, "sse aic bic step_1 step_2 step_3", 5)
def holt_forecast(spark: SparkSession, d: str) -> DataFrame:
    found = S.smoothing_models(panel(spark, d), ["grp"], "month", "price", horizon=3, alpha=0.4, beta=0.1)
    return found.select("grp", "sse", "aic", "bic", *[F.col("forecast")[k].alias(f"step_{k + 1}") for k in range(3)])


_WINTERS = f"""WITH RECURSIVE {_ROWS}, first AS (SELECT grp, avg(x) FILTER (i <= 12) AS level, (avg(x) FILTER (i BETWEEN 13 AND 24) - avg(x) FILTER (i <= 12)) / 12 AS trend, list(x ORDER BY i) FILTER (i <= 12) AS xs FROM r GROUP BY 1),
f(grp, i, fitted, level, trend, season, seasons) AS (SELECT grp, 0, 0.0::DOUBLE, level, trend, 0.0::DOUBLE, list_transform(xs, lambda v: v - level) FROM first
  UNION ALL SELECT grp, i, fitted, level, trend, season, list_concat(seasons[2:], [season]) FROM (SELECT grp, i, ahead + s AS fitted, new AS level, 0.05 * (new - level) + 0.95 * trend AS trend, 0.1 * (x - ahead) + 0.9 * s AS season, seasons
    FROM (SELECT *, 0.3 * (x - s) + 0.7 * ahead AS new FROM (SELECT r.grp, r.i, r.x, f.level, f.trend, f.level + f.trend AS ahead, f.seasons[1] AS s, f.seasons FROM f JOIN r ON r.grp = f.grp AND r.i = f.i + 1))))
SELECT grp, month, x AS price, fitted, x - fitted AS residual, level, trend, season FROM f JOIN r USING (grp, i)"""


@query(_WINTERS, "price fitted residual level trend season")
def triple_smoothing(spark: SparkSession, d: str) -> DataFrame:
    return S.exponential_smoothing(panel(spark, d), ["grp"], "month", "price", period=12, alpha=0.3, beta=0.05, gamma=0.1)


@query()
def ssa_baseline(spark: SparkSession, d: str) -> DataFrame:
    return S.ssa_baseline(panel(spark, d), ["grp"], "month", "price")


@query()
def garch_volatility(spark: SparkSession, d: str) -> DataFrame:
    return S.garch_volatility(panel(spark, d), ["grp"], "month", "price")


@query()
def garch_forecast(spark: SparkSession, d: str) -> DataFrame:
    return S.garch_forecast(panel(spark, d), ["grp"], "month", "price", horizon=3)


@query()
def rolling_garch(spark: SparkSession, d: str) -> DataFrame:
    return S.rolling_garch(panel(spark, d), ["grp"], "month", "price", 36, step=12, periods_per_year=12)


@query()
def hmm_regimes(spark: SparkSession, d: str) -> DataFrame:
    return S.hmm_regimes(panel(spark, d), ["grp"], "month", "price")


@query()
def hmm_profile(spark: SparkSession, d: str) -> DataFrame:
    return S.hmm_profile(panel(spark, d), ["grp"], "month", ["price", "n"])


@query()
def fractional_scan(spark: SparkSession, d: str) -> DataFrame:
    return S.fractional_scan(panel(spark, d), ["grp"], "month", "price", [0.0, 0.25, 0.5, 0.75, 1.0], 1e-2)


def _errors(spark: SparkSession, d: str) -> DataFrame:
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 3.6e9
    return table(spark, d, "events").where("event_type = 'error'").select("user_id", hours.alias("t"))


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t FROM events WHERE event_type = 'error')
SELECT a.user_id, a.t, 0.2 + 0.5 * coalesce((SELECT sum(exp(-(a.t - b.t))) FROM e b WHERE b.user_id = a.user_id AND b.t < a.t), 0) AS intensity FROM e a""", "t intensity")
def hawkes_intensity(spark: SparkSession, d: str) -> DataFrame:
    return S.hawkes_intensity(_errors(spark, d), ["user_id"], "t", S.Hawkes())


@query()
def hawkes_fit(spark: SparkSession, d: str) -> DataFrame:
    return S.hawkes_fit(_errors(spark, d), ["user_id"], "t")


_TESTED = """WITH e AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS hour FROM events WHERE event_type = 'error'), r AS (SELECT user_id, hour - min(hour) OVER (PARTITION BY user_id) AS t, row_number() OVER (PARTITION BY user_id ORDER BY hour) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e),
k AS (SELECT a.user_id, a.i, any_value(a.n) AS n, any_value(a.t) AS t, coalesce(sum(exp(-(a.t - b.t))), 0) AS s FROM r a LEFT JOIN r b ON b.user_id = a.user_id AND b.i < a.i GROUP BY 1, 2),
c AS (SELECT *, 0.2 * t + 0.5 * (i - 1 - s) AS up FROM k), u AS (SELECT *, 1 - exp(-(up - coalesce(lag(up) OVER (PARTITION BY user_id ORDER BY i), 0))) AS u, max(t) OVER (PARTITION BY user_id) + 1 AS stop FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY u) AS j FROM u),
g AS (SELECT user_id, any_value(n) AS n, greatest(max(u - (j - 1) / n), max(j / n - u)) AS ks_stat, sum(ln(0.2 + 0.5 * s)) - 0.2 * any_value(stop) - 0.5 * sum(1 - exp(-(stop - t))) AS loglik FROM o GROUP BY 1)
SELECT user_id, CASE WHEN n >= 3 THEN ks_stat END AS ks_stat, loglik, 6 - 2 * loglik AS aic, 3 * ln(n) - 2 * loglik AS bic FROM g"""


@query(_TESTED, "ks_stat loglik aic bic", 5)
def hawkes_goodness(spark: SparkSession, d: str) -> DataFrame:
    return S.hawkes_fit_test(_errors(spark, d), ["user_id"], "t", S.Hawkes()).select("user_id", "ks_stat", "loglik", "aic", "bic")
