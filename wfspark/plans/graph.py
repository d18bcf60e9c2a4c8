"""Queries of network measures on the trade graph of nations: pieces traded between customers and suppliers of each two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wfspark.operators import graph as G
from wfspark.plans.registry import query, table
from wfspark.sources.files import kept


def trade(spark: SparkSession, d: str) -> DataFrame:
    """Nations joined by the pieces that they trade with one another."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("a"))
    suppliers = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("b"))
    pairs = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = pairs.groupBy("a", "b").agg(F.sum("q").alias("q")).where("a <> b")
    return G.edges_from(pairs, "a", "b", "q")


TRADE = """pairs AS (SELECT c_nationkey AS a, s_nationkey AS b, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL),
edges AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, sum(q)::DOUBLE AS weight FROM pairs GROUP BY ALL),
sides AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
nodes AS (SELECT DISTINCT src AS node FROM sides)"""


@query(f"WITH {TRADE} SELECT src AS node, count(*) / ((SELECT count(*) FROM nodes) - 1) AS degree FROM sides GROUP BY 1", "degree")
def degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degree(trade(spark, d))


@query(f"WITH {TRADE} SELECT src AS node, sum(weight) AS degree FROM sides GROUP BY 1", "degree")
def weighted_degree(spark: SparkSession, d: str) -> DataFrame:
    return G.degree(trade(spark, d), weighted=True, normalized=False)


_SOLD = "sold AS (SELECT s_nationkey AS src, c_nationkey AS dst, sum(l_quantity)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL), every AS (SELECT src AS node FROM sold UNION SELECT dst FROM sold)"


@query(f"""WITH {_SOLD}, i AS (SELECT dst AS node, count(*) AS c, sum(weight) AS w FROM sold GROUP BY 1), o AS (SELECT src AS node, count(*) AS c, sum(weight) AS w FROM sold GROUP BY 1)
SELECT node, coalesce(i.c, 0) / ((SELECT count(*) FROM every) - 1) AS in_degree, coalesce(o.c, 0) / ((SELECT count(*) FROM every) - 1) AS out_degree, coalesce(i.w, 0) AS in_strength, coalesce(o.w, 0) AS out_strength
FROM every LEFT JOIN i USING (node) LEFT JOIN o USING (node)""", "in_degree out_degree in_strength out_strength")
def degree_directed(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = kept(G.edges_from(lines, "s_nationkey", "c_nationkey", "l_quantity", directed=True))
    out = G.nodes(edges)
    for kind in ("in", "out"):
        out = out.join(G.degree(edges, kind=kind).withColumnRenamed("degree", f"{kind}_degree"), "node")
        out = out.join(G.degree(edges, weighted=True, normalized=False, kind=kind).withColumnRenamed("degree", f"{kind}_strength"), "node")
    return out


@query(f"WITH {TRADE}, v AS (SELECT src AS node, sum(weight) AS volume FROM sides GROUP BY 1) SELECT node, volume, (volume - avg(volume) OVER ()) / stddev_samp(volume) OVER () AS z, (volume - avg(volume) OVER ()) / stddev_samp(volume) OVER () > 2 AS is_overloaded FROM v", "volume z")
def overload(spark: SparkSession, d: str) -> DataFrame:
    return G.collaboration_overload(trade(spark, d))


@query(f"""WITH {TRADE}, p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM sides),
t AS (SELECT a.src, b.dst, sum(a.p * b.p) AS q FROM p a JOIN p b ON a.dst = b.src GROUP BY ALL)
SELECT p.src AS node, sum(pow(p.p + coalesce(q, 0), 2)) AS "constraint" FROM p LEFT JOIN t ON t.src = p.src AND t.dst = p.dst GROUP BY 1""")
def burt_constraint(spark: SparkSession, d: str) -> DataFrame:
    return G.burt_constraint(trade(spark, d))


@query(f"""WITH {TRADE}, p AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM sides),
h1 AS (SELECT DISTINCT dst AS node, 1 AS hop FROM p WHERE src = 3), h2 AS (SELECT DISTINCT dst AS node, 2 AS hop FROM p JOIN h1 ON src = node WHERE dst <> 3),
h AS (SELECT node, min(hop) AS hop FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1), m AS (SELECT a.src AS node, max(a.p * b.p) AS med FROM p a JOIN p b ON a.dst = b.src WHERE b.dst = 3 GROUP BY 1),
t AS (SELECT h.node, hop, coalesce(p.p, med, 0.02) AS tie FROM h LEFT JOIN p ON p.src = h.node AND p.dst = 3 LEFT JOIN m ON m.node = h.node)
SELECT node, hop::BIGINT AS hop, round(tie, 4) AS tie, round(0.5 * tie * pow(0.6, hop), 3) AS risk FROM t""")
def contagion(spark: SparkSession, d: str) -> DataFrame:
    return G.attrition_contagion(trade(spark, d), 3)


def _distances(name: str, length: str) -> str:
    """CTEs for the shortest distances of all pairs: every round goes one edge further and keeps the least."""
    return f"""{name}_len AS (SELECT src, dst, {length} AS l FROM sides),
{name}_walk(src, node, d, hops) AS (SELECT node, node, 0.0::DOUBLE, 0 FROM nodes UNION ALL SELECT src, node, min(d) AS d, any_value(hops) FROM (SELECT w.src, l.dst AS node, w.d + l.l AS d, w.hops + 1 AS hops FROM {name}_walk w JOIN {name}_len l ON w.node = l.src WHERE w.hops < 24) GROUP BY src, node),
{name} AS (SELECT src, node, min(d) AS d FROM {name}_walk GROUP BY ALL)"""


_N = "(SELECT count(*) FROM nodes)"
_CLOSE = f"{_distances('near', '(SELECT max(weight) FROM edges) / weight')}, close AS (SELECT src AS node, (count(*) - 1) / sum(d) * (count(*) - 1) / ({_N} - 1) AS closeness FROM near GROUP BY 1)"
_BETWEEN = f"""{_distances('far', '1 / weight')}, through AS (SELECT v.node, count(*) AS c FROM far v JOIN far st ON st.src < st.node AND st.src = v.src AND v.node NOT IN (st.src, st.node) JOIN far vt ON vt.src = v.node AND vt.node = st.node WHERE abs(v.d + vt.d - st.d) <= 1e-12 GROUP BY 1),
between_ AS (SELECT node, coalesce(c, 0) * 2.0 / (({_N} - 1) * ({_N} - 2)) AS betweenness FROM nodes LEFT JOIN through USING (node))"""
_EIGEN = f"""pull AS (SELECT src, dst, weight FROM sides UNION ALL SELECT node, node, 1.0 FROM nodes),
power(i, node, x) AS (SELECT 0, node, 1.0::DOUBLE / {_N} FROM nodes UNION ALL SELECT i, node, y / sqrt(sum(y * y) OVER ()) FROM (SELECT p.i + 1 AS i, m.src AS node, sum(m.weight * p.x) AS y FROM power p JOIN pull m ON m.dst = p.node WHERE p.i < 100 GROUP BY 1, 2)),
eigen AS (SELECT node, x AS eigenvector FROM power WHERE i = 100)"""
_EULER = f"""hop_walk(src, node, h) AS (SELECT node, node, 0 FROM nodes UNION SELECT w.src, s.dst, w.h + 1 FROM hop_walk w JOIN sides s ON s.src = w.node WHERE w.h < 24),
hops AS (SELECT a.node AS src, b.node AS dst, min(h) AS h FROM nodes a CROSS JOIN nodes b LEFT JOIN hop_walk w ON w.src = a.node AND w.node = b.node GROUP BY ALL),
apart AS (SELECT src, dst, coalesce(h, 2 * (SELECT max(h) FROM hops))::DOUBLE AS h FROM hops),
kernel AS (SELECT src, dst, exp(-h / greatest((SELECT avg(h) FROM apart), 0.5)) + CASE WHEN src = dst THEN 1e-4 ELSE 0 END AS z FROM apart),
numbered AS (SELECT node, row_number() OVER (ORDER BY node) AS r FROM nodes),
matrix AS (SELECT list(cells ORDER BY r) AS m FROM (SELECT a.r, list_append(list(k.z ORDER BY b.r), 1.0::DOUBLE) AS cells FROM kernel k JOIN numbered a ON a.node = k.src JOIN numbered b ON b.node = k.dst GROUP BY a.r)),
solve(k, m) AS (SELECT 0, m FROM matrix UNION ALL SELECT k + 1, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN i = k + 1 THEN list_transform(m[k + 1], lambda v: v / m[k + 1][k + 1]) ELSE list_transform(range(1, len(m) + 2), lambda j: m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM solve WHERE k < len(m)),
magnitudes AS (SELECT node, m[r][len(m) + 1] AS magnitude FROM solve CROSS JOIN numbered WHERE k = len(m))"""


@query(f"WITH RECURSIVE {TRADE}, {_CLOSE} SELECT * FROM close", "closeness")
def closeness(spark: SparkSession, d: str) -> DataFrame:
    return G.closeness(trade(spark, d))


@query(f"WITH RECURSIVE {TRADE}, {_BETWEEN} SELECT * FROM between_", "betweenness")
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return G.betweenness(trade(spark, d))


@query(f"WITH RECURSIVE {TRADE}, {_EIGEN} SELECT * FROM eigen", "eigenvector", 5)
def eigenvector(spark: SparkSession, d: str) -> DataFrame:
    return G.eigenvector(trade(spark, d))


@query(f"WITH RECURSIVE {TRADE}, {_EULER} SELECT * FROM magnitudes", "magnitude", 5)
def euler(spark: SparkSession, d: str) -> DataFrame:
    return G.euler(trade(spark, d))


_PROFILE = f"""{_CLOSE}, {_BETWEEN}, {_EIGEN}, {_EULER}, shares AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS p FROM sides),
via AS (SELECT a.src, b.dst, sum(a.p * b.p) AS q FROM shares a JOIN shares b ON a.dst = b.src GROUP BY ALL),
burt AS (SELECT s.src AS node, sum(pow(s.p + coalesce(q, 0), 2)) AS "constraint" FROM shares s LEFT JOIN via v ON v.src = s.src AND v.dst = s.dst GROUP BY 1),
sums AS (SELECT src AS node, count(*) / ({_N} - 1) AS degree, sum(weight) AS volume FROM sides GROUP BY 1), loads AS (SELECT *, (volume - avg(volume) OVER ()) / stddev_samp(volume) OVER () AS z FROM sums),
every AS (SELECT * FROM loads JOIN close USING (node) JOIN between_ USING (node) JOIN eigen USING (node) JOIN burt USING (node) JOIN magnitudes USING (node)),
cuts AS (SELECT quantile_cont(betweenness, 0.75) AS cb, quantile_cont(eigenvector, 0.75) AS ce, quantile_cont("constraint", 0.5) AS cc FROM every)
SELECT node, round(degree, 9) AS degree, closeness, betweenness, eigenvector, round("constraint", 9) AS "constraint", magnitude, volume, z, z > 2 AS is_overloaded,
  CASE WHEN betweenness >= cb AND "constraint" < cc THEN 'Broker / Bridge' WHEN eigenvector >= ce THEN 'Informal Hub' WHEN "constraint" >= cc AND z >= 0 THEN 'Cohesive Core' WHEN "constraint" < cc THEN 'Autonomous Specialist' ELSE 'Peripheral' END AS archetype
FROM every, cuts"""


@query(f"WITH RECURSIVE {TRADE}, {_PROFILE}", "closeness betweenness eigenvector magnitude volume z", 5)
def ona_profile(spark: SparkSession, d: str) -> DataFrame:
    return G.ona_profile(trade(spark, d)).withColumn("constraint", F.round("constraint", 9)).withColumn("degree", F.round("degree", 9))


def _typed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers, their nations and regions as one typed graph."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    edges = s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst")).union(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    every = [(s, "s", "s_suppkey"), (s, "n", "s_nationkey"), (n, "n", "n_nationkey"), (n, "r", "n_regionkey")]
    kinds = [t.select(name(kind, c).alias("node"), F.lit(kind).alias("node_type")) for t, kind, c in every]
    types = kinds[0].union(kinds[1]).union(kinds[2]).union(kinds[3]).where("node is not null").distinct()
    return types, edges.where("src is not null and dst is not null").withColumn("weight", F.lit(1.0))


@query()
def metapath_walks(spark: SparkSession, d: str) -> DataFrame:
    return G.metapath_walks(*_typed(spark, d), ["s", "n", "s"], length=6, walks=3)


def _embedded(spark: SparkSession, d: str) -> G.NodeEmbeddings:
    types, edges = _typed(spark, d)
    return G.NodeEmbeddings.fit(types, G.metapath_walks(types, edges, ["s", "n", "s"], length=6, walks=3), dim=32)


@query()
def metapath2vec(spark: SparkSession, d: str) -> DataFrame:
    return _embedded(spark, d).frame(spark)


@query()
def similar_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _embedded(spark, d).similar(spark, "s2", 5, "s")
