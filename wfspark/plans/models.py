"""Queries of linear models, alignment and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wfspark.operators import anomalies as A
from wfspark.operators import linear as L
from wfspark.plans.registry import PANEL, panel, query, table

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("""WITH r AS (SELECT l_returnflag AS f, l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_returnflag IN ('A', 'R')), p AS (SELECT regr_slope(y, x) AS b FROM lineitem, LATERAL (SELECT l_quantity AS x, l_extendedprice AS y)),
g AS (SELECT avg(y) FILTER (f = 'A') - avg(y) FILTER (f = 'R') AS raw, avg(x) FILTER (f = 'A') - avg(x) FILTER (f = 'R') AS dx FROM r)
SELECT part, feature, value FROM g, p, LATERAL (VALUES ('raw_gap', NULL, raw), ('explained', NULL, dx * b), ('unexplained', NULL, raw - dx * b), ('explained', 'l_quantity', dx * b)) t(part, feature, value)""", "value")
def oaxaca(spark: SparkSession, d: str) -> DataFrame:
    return L.oaxaca(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", ["l_quantity"], "A", "R")


@query("""WITH m AS (SELECT regr_sxy(l_extendedprice, l_quantity) / (regr_sxx(l_extendedprice, l_quantity) + 1) AS b, avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM lineitem)
SELECT l_suppkey, count(*) AS n, avg(l_extendedprice - my - b * (l_quantity - mx)) AS mean_residual, stddev_samp(l_extendedprice - my - b * (l_quantity - mx)) AS std_residual FROM lineitem, m GROUP BY 1""", "mean_residual std_residual", 4)
def loo_expected_diff(spark: SparkSession, d: str) -> DataFrame:
    return L.loo_expected_differential(table(spark, d, "lineitem"), "l_suppkey", "l_extendedprice", ["l_quantity"])


def _corr(columns: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, count(*) AS n, corr(l_extendedprice, {f}) AS r FROM {columns}" for f in ("l_quantity", "l_discount", "l_tax"))
    return f"""c AS ({parts}), z AS (SELECT *, atanh(r) AS z, 1.959963984540054 / sqrt(n - 3) AS s FROM c)
SELECT feature, n, r, tanh(z - s) AS ci_low, tanh(z + s) AS ci_high, (tanh(z - s) <= 0 AND tanh(z + s) >= 0) AS contains_0 FROM z"""


@query(f"WITH {_corr('lineitem')}", "r ci_low ci_high")
def corr_table(spark: SparkSession, d: str) -> DataFrame:
    return L.correlation_table(table(spark, d, "lineitem"), "l_extendedprice", _LINE[:1] + _LINE[2:]).drop("p", "is_significant")


_RANKS = "ranked AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _LINE) + " FROM lineitem)"


@query(f"WITH {_RANKS}, {_corr('ranked')}", "r ci_low ci_high")
def corr_table_spearman(spark: SparkSession, d: str) -> DataFrame:
    return L.correlation_table(table(spark, d, "lineitem"), "l_extendedprice", _LINE[:1] + _LINE[2:], "spearman").drop("p", "is_significant")


_KENDALL = """WITH s AS (SELECT s_acctbal AS y, s_nationkey AS a, s_suppkey % 7 AS b FROM supplier), c AS (SELECT unnest(['a', 'b']) AS feature, unnest([a, b])::DOUBLE AS x, y, row_number() OVER () AS i FROM s),
p AS (SELECT u.feature, sum(sign(u.x - v.x) * sign(u.y - v.y)) AS s, sum((u.x <> v.x)::INT) AS nx, sum((u.y <> v.y)::INT) AS ny FROM c u JOIN c v ON u.feature = v.feature AND u.i < v.i GROUP BY 1)
SELECT feature, s / sqrt(nx::DOUBLE * ny) AS r FROM p"""


@query(_KENDALL, "r")
def corr_table_kendall(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select(F.col("s_acctbal").alias("y"), F.col("s_nationkey").alias("a"), (F.col("s_suppkey") % 7).alias("b"))
    return L.correlation_table(rows, "y", ["a", "b"], "kendall").select("feature", "r")


def _turned(name: str) -> tuple[str, str]:
    """SQL of the biweight and percentage-bend columns of ``lineitem``."""
    if name == "bicor":
        parts = ", ".join(f"(SELECT median(abs({c} - (SELECT median({c}) FROM lineitem))) FROM lineitem) AS d_{c}, (SELECT median({c}) FROM lineitem) AS m_{c}" for c in _LINE)
        cell = lambda c: f"CASE WHEN abs(({c} - m_{c}) / (9 * d_{c})) < 1 THEN ({c} - m_{c}) * pow(1 - pow(({c} - m_{c}) / (9 * d_{c}), 2), 2) ELSE 0 END AS {c}"
        return f"q AS (SELECT {parts})", f"t AS (SELECT {', '.join(map(cell, _LINE))} FROM lineitem, q)"
    one = "; ".join(_LINE).split("; ")
    size = "(SELECT count(*) FROM lineitem)"
    meds = ", ".join(f"(SELECT median({c}) FROM lineitem) AS m_{c}" for c in one)
    omegas = ", ".join(f"(SELECT list_sort(list(abs({c} - m_{c})))[floor(0.8 * {size} + 0.5)::INT] FROM lineitem) AS o_{c}" for c in one)
    centres = ", ".join(f"(SELECT (o_{c} * (count(*) FILTER ({c} - m_{c} > o_{c}) - count(*) FILTER ({c} - m_{c} < -o_{c})) + sum({c}) FILTER (abs({c} - m_{c}) <= o_{c})) / count(*) FILTER (abs({c} - m_{c}) <= o_{c}) FROM lineitem) AS c_{c}" for c in one)
    cells = ", ".join(f"greatest(-1, least(1, ({c} - c_{c}) / o_{c})) AS {c}" for c in one)
    return f"q0 AS (SELECT {meds}), q1 AS (SELECT *, {omegas} FROM q0), q AS (SELECT *, {centres} FROM q1)", f"t AS (SELECT {cells} FROM lineitem, q)"


def _robust(name: str) -> str:
    parts = " UNION ALL ".join(f"SELECT '{f}' AS feature, sum(l_extendedprice * {f}) / sqrt(sum(l_extendedprice * l_extendedprice) * sum({f} * {f})) AS r FROM t" for f in _LINE if f != "l_extendedprice")
    return f"WITH {', '.join(_turned(name))} {parts}"


@query(_robust("bicor"), "r")
def corr_table_bicor(spark: SparkSession, d: str) -> DataFrame:
    return L.correlation_table(table(spark, d, "lineitem"), "l_extendedprice", _LINE[:1] + _LINE[2:], "bicor").select("feature", "r")


@query(_robust("percbend"), "r")
def corr_table_percbend(spark: SparkSession, d: str) -> DataFrame:
    return L.correlation_table(table(spark, d, "lineitem"), "l_extendedprice", _LINE[:1] + _LINE[2:], "percbend").select("feature", "r")


@query()
def corr_table_shepherd(spark: SparkSession, d: str) -> DataFrame:
    return L.style_bands(L.correlation_table(table(spark, d, "lineitem"), "l_extendedprice", _LINE[:1] + _LINE[2:], "shepherd", power=True))


@query("""WITH b AS (SELECT s_suppkey, s_acctbal / 1000 - 4 AS x, s_nationkey - 12.0 AS y FROM supplier), q AS (SELECT s_suppkey, sqrt((x * x * 50 + y * y * 9) / 450) AS mahalanobis FROM b)
SELECT *, exp(-pow(mahalanobis, 2) / 2) AS p_value, exp(-pow(mahalanobis, 2) / 2) < 0.05 AS is_outlier FROM q""", "mahalanobis p_value")
def mahalanobis_given(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return L.mahalanobis(rows, ["x", "y"], regularization=0.0, mean=[4.0, 12.0], covariance=[[9.0, 0.0], [0.0, 50.0]]).drop("x", "y")


@query()
def mahalanobis_robust(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return L.mahalanobis(rows, ["x", "y"], robust=True).drop("x", "y")


_SQUARE = "sqrt((vy * pow(x - mx, 2) - 2 * vxy * (x - mx) * (y - my) + vx * pow(y - my, 2)) / (vx * vy - vxy * vxy))"


@query(f"""WITH r AS (SELECT s_suppkey, s_acctbal / 1000 AS x, s_nationkey::DOUBLE AS y FROM supplier), m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) + 1e-6 AS vx, var_samp(y) + 1e-6 AS vy, covar_samp(x, y) AS vxy FROM r),
q AS (SELECT s_suppkey, {_SQUARE} AS mahalanobis FROM r, m)
SELECT *, exp(-pow(mahalanobis, 2) / 2) AS p_value, exp(-pow(mahalanobis, 2) / 2) < 0.05 AS is_outlier FROM q""", "mahalanobis p_value")
def mahalanobis(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return L.mahalanobis(rows, ["x", "y"]).drop("x", "y")


@query(f"""WITH r AS (SELECT c_custkey, c_mktsegment AS g, c_acctbal / 1000 AS x, (c_custkey % 50)::DOUBLE AS y FROM customer), m AS (SELECT g, avg(x) AS mx, avg(y) AS my, var_samp(x) + 1e-6 AS vx, var_samp(y) + 1e-6 AS vy, covar_samp(x, y) AS vxy FROM r GROUP BY 1),
q AS (SELECT c_custkey, {_SQUARE} AS mahalanobis FROM r JOIN m USING (g))
SELECT *, exp(-pow(mahalanobis, 2) / 2) AS p_value, exp(-pow(mahalanobis, 2) / 2) < 0.05 AS is_outlier FROM q""", "mahalanobis p_value")
def mahalanobis_grouped(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("g"), (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 50).cast("double").alias("y"))
    return L.mahalanobis(rows, ["x", "y"], "g").drop("g", "x", "y")


def _curves(spark: SparkSession, d: str) -> DataFrame:
    """Each priority's monthly counts, beside the third priority's."""
    rows = panel(spark, d).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("month", "n"))).alias("m")).select("grp", F.col("m.n").alias("v"))
    return rows.crossJoin(F.broadcast(rows.where("grp = '3-MEDIUM'").select(F.col("v").alias("ref"))))


def _aligned(name: str, first: str, edge: str, cell: str, n: str = "len(v)") -> str:
    """CTEs of a dynamic programme over two lists, a row of the table a round: the row before is folded over into the next by ``cell`` (d, u, l: diagonal,
    up, left; v[i + 1], ref[j]). ``first``: the row 0; ``edge``: column 0 of the next row."""
    fold = f"list_reduce(list_concat([[{edge}]], list_transform(range(1, len(ref) + 1), lambda j: [j::DOUBLE])), lambda a, q: list_append(a, {cell}))"
    cell_of = lambda j, d, u, left: fold.replace("{j}", j).replace("{d}", d).replace("{u}", u).replace("{l}", left)
    return f"""{name}_t(grp, i, v, ref, t) AS (SELECT grp, 0, v, ref, {first} FROM curves UNION ALL SELECT grp, i + 1, v, ref, {cell_of('q[1]::INT', 't[q[1]::INT]', 't[q[1]::INT + 1]', 'a[-1]')} FROM {name}_t WHERE i < {n}),
{name} AS (SELECT grp, t[-1] AS d FROM {name}_t WHERE i = len(v))"""


_NEARER = "abs(v[i + 1] - ref[{j}])"
_CURVES = f"""{PANEL}, lists AS (SELECT grp, list(n ORDER BY month) AS v FROM panel GROUP BY 1), curves AS (SELECT a.grp, a.v, b.v AS ref FROM lists a, lists b WHERE b.grp = '3-MEDIUM')"""
_INF = "'infinity'::DOUBLE"
_WARPED = f"""WITH RECURSIVE {_CURVES},
{_aligned('dtw_', f"list_transform(range(0, len(ref) + 1), lambda j: CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE {_INF} END)", _INF, f"{_NEARER} + least({{d}}, {{u}}, {{l}})")},
{_aligned('band_', f"list_transform(range(0, len(ref) + 1), lambda j: CASE WHEN j = 0 THEN 0.0::DOUBLE ELSE {_INF} END)", _INF, f"CASE WHEN abs(i + 1 - {{j}}) <= 3 THEN {_NEARER} + least({{d}}, {{u}}, {{l}}) ELSE {_INF} END")},
{_aligned('lcss_', "list_transform(range(0, len(ref) + 1), lambda j: 0.0::DOUBLE)", "0.0::DOUBLE", f"CASE WHEN {_NEARER} <= 2.5 AND abs(i + 1 - {{j}}) <= 4 THEN {{d}} + 1 ELSE greatest({{u}}, {{l}}) END")},
{_aligned('edr_', "list_transform(range(0, len(ref) + 1), lambda j: j::DOUBLE)", "i + 1.0::DOUBLE", f"least({{d}} + ({_NEARER} > 2.5)::INT, {{u}} + 1, {{l}} + 1)")}
SELECT grp, dtw_.d AS dtw, band_.d AS dtw_band, 1 - lcss_.d / least(len(v), len(ref)) AS lcss, edr_.d / greatest(len(v), len(ref)) AS edr FROM curves JOIN dtw_ USING (grp) JOIN band_ USING (grp) JOIN lcss_ USING (grp) JOIN edr_ USING (grp)"""


@query(_WARPED, "dtw dtw_band lcss edr")
def alignment(spark: SparkSession, d: str) -> DataFrame:
    v, r = F.col("v"), F.col("ref")
    return _curves(spark, d).select("grp", A.dtw()(v, r).alias("dtw"), A.dtw(3)(v, r).alias("dtw_band"), A.lcss()(v, r).alias("lcss"), A.edr()(v, r).alias("edr"))


_NEAR = """s AS (SELECT p_partkey AS id, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER () AS a, (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS b, (p_retailprice > 1300)::INT AS y FROM part),
k AS (SELECT x.id, z.id AS other, round(sqrt(pow(x.a - z.a, 2) + pow(x.b - z.b, 2)), 9) AS d, x.y, z.y AS theirs FROM s x JOIN s z ON x.id <> z.id QUALIFY row_number() OVER (PARTITION BY x.id ORDER BY round(sqrt(pow(x.a - z.a, 2) + pow(x.b - z.b, 2)), 9), z.id) <= 5)"""


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size", (F.col("p_retailprice") > 1300).cast("int").alias("y"))


@query(f"""WITH {_NEAR}, kd AS (SELECT id AS other, max(d) AS kd FROM k GROUP BY 1), l AS (SELECT id, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM k JOIN kd USING (other) GROUP BY 1),
f AS (SELECT k.id, avg(o.lrd) / any_value(l.lrd) AS lof FROM k JOIN l o ON o.id = k.other JOIN l ON l.id = k.id GROUP BY 1)
SELECT id AS p_partkey, lof, lof > (SELECT quantile_cont(lof, 0.95) FROM f) AS is_outlier FROM f""", "lof", 5)
def lof_outliers(spark: SparkSession, d: str) -> DataFrame:
    return A.local_outlier_factor(_parts(spark, d), "p_partkey", ["p_retailprice", "p_size"], 5)


@query(f"WITH {_NEAR} SELECT id AS p_partkey, 1 - abs(any_value(y) - avg(theirs)) AS consistency FROM k GROUP BY 1", "consistency")
def individual_fairness(spark: SparkSession, d: str) -> DataFrame:
    return A.individual_fairness(_parts(spark, d), "p_partkey", ["p_retailprice", "p_size"], "y").drop("lipschitz")


@query()
def pca_reconstruction(spark: SparkSession, d: str) -> DataFrame:
    return A.pca_reconstruction(table(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query()
def autoencoder(spark: SparkSession, d: str) -> DataFrame:
    return A.autoencoder(table(spark, d, "part"), "p_partkey", ["p_retailprice", "p_size"], latent=1)


_KNOWN = ["a", "b", "c", "d"]


def _known_graph(spark: SparkSession, d: str) -> DataFrame:
    """Four columns that cause one another as laid out here: a makes b, b makes c, and d stands alone."""
    z = A.standardized(table(spark, d, "lineitem").select(*_LINE), _LINE)
    b = 0.9 * F.col("z_0") + F.col("z_1")
    return z.select(F.col("z_0").alias("a"), b.alias("b"), (-0.8 * b + F.col("z_2")).alias("c"), F.col("z_3").alias("d"))


@query("SELECT * FROM (VALUES ('a', 'b', 1.0::DOUBLE), ('b', 'c', -1.0::DOUBLE)) t(cause, effect, direction)")
def notears(spark: SparkSession, d: str) -> DataFrame:
    return L.notears(_known_graph(spark, d), _KNOWN).select("cause", "effect", F.signum("weight").alias("direction"))


@query()
def causal_effects(spark: SparkSession, d: str) -> DataFrame:
    return L.total_effects(L.notears(_known_graph(spark, d), _KNOWN), _KNOWN)


@query("SELECT 'a' AS cause, 'c' AS effect, 0.0::DOUBLE AS direct, '' AS confounders, 'cause through mediators' AS verdict")
def confounding(spark: SparkSession, d: str) -> DataFrame:
    rows = _known_graph(spark, d)
    found = L.diagnose_confounding(L.total_effects(L.notears(rows, _KNOWN), _KNOWN), "a", "c", rows.stat.corr("a", "c"))
    return found.select("cause", "effect", "direct", "confounders", "verdict")


@query("SELECT * FROM (VALUES ('a', 0::BIGINT, true, false), ('b', 1::BIGINT, false, false), ('c', 2::BIGINT, false, true), ('d', 0::BIGINT, true, true)) t(node, depth, is_root, is_sink)")
def causal_order(spark: SparkSession, d: str) -> DataFrame:
    return L.causal_order(L.notears(_known_graph(spark, d), _KNOWN), _KNOWN)
