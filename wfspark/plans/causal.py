"""Queries of treatment effects, fair classifiers, careers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wfspark.operators import careers as K
from wfspark.operators import causal as C
from wfspark.operators import mobility as M
from wfspark.operators import temporal as T
from wfspark.operators import trees as R
from wfspark.plans.registry import query, table
from wfspark.plans.temporal import _RATES


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1e5).alias("y"), (F.col("o_orderpriority") < "3").cast("int").alias("t"),
        (F.dayofyear("o_orderdate") / 366).alias("x"), ((F.col("o_custkey") % 10) / 10).alias("z"), (F.col("o_orderstatus") == "F").cast("int").alias("f"), "o_orderpriority",
    )


@query()
def aipw(spark: SparkSession, d: str) -> DataFrame:
    return C.aipw(_orders(spark, d), "o_orderkey", "y", "t", ["x", "z"])


@query()
def dr_uplift(spark: SparkSession, d: str) -> DataFrame:
    return C.uplift_mse(_orders(spark, d), "o_orderkey", "y", "t", ["x", "z"], "z")


@query()
def causal_forest(spark: SparkSession, d: str) -> DataFrame:
    return C.causal_forest(_orders(spark, d), "o_orderkey", "y", "t", ["x", "z"], trees=16)


@query()
def forest_importances(spark: SparkSession, d: str) -> DataFrame:
    return C.CausalForest.fit(_orders(spark, d), "o_orderkey", "y", "t", ["x", "z"], trees=8).importances(spark)


@query()
def persuadables(spark: SparkSession, d: str) -> DataFrame:
    rows = _orders(spark, d)
    return C.CausalForest.fit(rows, "o_orderkey", "y", "t", ["x", "z"], trees=8).persuadables(rows).groupBy("archetype").agg(F.count("*").alias("n"), F.avg("effect").alias("effect"))


@query()
def fair_classifier_odds(spark: SparkSession, d: str) -> DataFrame:
    return C.fair_classifier(_orders(spark, d), "o_orderkey", "f", "o_orderpriority", ["y", "x", "z"], rounds=4, constraint="odds")


def _quarters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rows.select("c_nationkey", ((F.year("o_orderdate") - 1995) * 4 + F.quarter("o_orderdate")).alias("q"), (F.col("o_totalprice") / 1e5).alias("y"))


@query()
def sdid(spark: SparkSession, d: str) -> DataFrame:
    return C.sdid(_quarters(spark, d), "c_nationkey", "q", "y", [1, 2], 17)


@query()
def synthetic_control(spark: SparkSession, d: str) -> DataFrame:
    return C.synthetic_controls(_quarters(spark, d), "c_nationkey", "q", "y", [1, 2, 3], 17)


@query()
def fair_classifier(spark: SparkSession, d: str) -> DataFrame:
    return C.fair_classifier(_orders(spark, d), "o_orderkey", "f", "o_orderpriority", ["y", "x", "z"], rounds=4)


_LINEAR = """m AS (SELECT avg(l_quantity) AS mx, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)"""


@query(f"""WITH {_LINEAR} SELECT 'l_quantity' AS feature, avg(b * (l_quantity - mx)) FILTER (l_returnflag <> 'R') AS retained, avg(b * (l_quantity - mx)) FILTER (l_returnflag = 'R') AS terminated FROM lineitem, m""", "retained terminated", 4)
def shap_group_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("c"))
    shap = C.linear_shap(rows.withColumn("l_orderkey", F.struct("l_orderkey", "c")), "l_orderkey", "l_extendedprice", ["l_quantity"])
    return C.shap_by_class(shap.withColumn("c", F.col("l_orderkey.c")), "c", ["l_quantity"])


@query()
def shap_inflection(spark: SparkSession, d: str) -> DataFrame:
    shap = C.linear_shap(table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity"), "l_orderkey", "l_extendedprice", ["l_quantity"])
    rows = shap.withColumn("v", F.col("shap_l_quantity"))
    return C.inflection_thresholds(rows, "v", "shap_l_quantity")


@query()
def shap_interactions(spark: SparkSession, d: str) -> DataFrame:
    return C.shap_interactions(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", (F.col("l_quantity") * (1 - F.col("l_discount")) + F.when(F.col("l_quantity") > 30, 20.0).otherwise(0.0)).alias("y"))


@query()
def tree_interactions(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    return R.BoostedTrees.fit(rows, "y", ["l_quantity", "l_discount", "l_tax"], rounds=8).interactions(rows)


@query()
def tree_thresholds(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    model = R.BoostedTrees.fit(rows, "y", ["l_quantity", "l_discount"], rounds=8)
    lines = rows.groupBy("l_quantity", "l_discount").agg(F.count("*").alias("times"))  # equal lines have equal values
    return R.threshold_table(model.shap(lines), ["l_quantity", "l_discount"], rounds=8, weight="times")


def _moves(spark: SparkSession, d: str) -> DataFrame:
    return M.transitions(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"])


@query()
def role_similarity(spark: SparkSession, d: str) -> DataFrame:
    return K.CareerEmbeddings.fit(_moves(spark, d)).similarity_frame(spark)


@query()
def succession_topk(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("h"))
    people = history.select("user_id", F.element_at("h.event_type", -1).alias("role"), F.col("h.event_type").alias("history"))
    return K.CareerEmbeddings.fit(_moves(spark, d)).succession(people, "user_id", "role", "history", "purchase")


def _chain(spark: SparkSession, d: str) -> K.MarkovChain:
    from wfspark.plans.temporal import _states

    return K.MarkovChain.fit(T.ctmc_rates(_states(spark, d), "user_id", "event_type", "s", "e"))


_SETTLED = f"""WITH RECURSIVE {_RATES}, states AS (SELECT source AS s FROM rates UNION SELECT target FROM rates), q AS (SELECT a.s AS i, b.s AS j, CASE WHEN a.s = b.s THEN -coalesce((SELECT sum(rate) FROM rates WHERE source = a.s), 0) ELSE coalesce(r.rate, 0) END AS v FROM states a CROSS JOIN states b LEFT JOIN rates r ON r.source = a.s AND r.target = b.s),
terms(k, i, j, v) AS (SELECT 0, a.s, b.s, (a.s = b.s)::INT::DOUBLE FROM states a CROSS JOIN states b UNION ALL SELECT t.k + 1, t.i, q.j, sum(t.v * q.v) * 24.0 / 4096 / (t.k + 1) FROM terms t JOIN q ON q.i = t.j WHERE t.k < 12 GROUP BY t.k + 1, t.i, q.j),
small AS (SELECT i, j, sum(v) AS v FROM terms GROUP BY ALL),
squares(k, i, j, v) AS (SELECT 0, i, j, v FROM small UNION ALL SELECT a.k + 1, a.i, b.j, sum(a.v * b.v) FROM squares a JOIN squares b ON a.j = b.i WHERE a.k < 30 GROUP BY a.k + 1, a.i, b.j)
SELECT p.i AS source, p.j AS target, p.v AS probability, s.v AS stationary FROM squares p JOIN squares s ON s.k = 30 AND s.i = p.i AND s.j = p.j WHERE p.k = 12"""


@query(_SETTLED, "probability stationary")
def ctmc_transition(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d).frame(spark, 24.0)


@query()
def ctmc_simulation(spark: SparkSession, d: str) -> DataFrame:
    return _chain(spark, d).simulate(spark, 100, "view", 72.0)


@query()
def attention_pool(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "embeddings")
    return K.AttentionPooling.fresh(len(tokens.first()["embedding"]), heads=2).transform(tokens, ["label"], "embedding")


@query("""WITH t AS (SELECT label, unnest(embedding) AS v, unnest(range(0, len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(v::DOUBLE) AS v FROM t GROUP BY ALL) SELECT label, i, v FROM m""", "v")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    pooled = K.mean_pool(table(spark, d, "embeddings"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("pooled").alias("i", "v")).withColumn("i", F.col("i").cast("bigint"))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream of files."""
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t FROM events WHERE event_type = 'error')
SELECT a.user_id, a.t AS hour, 0.2 + 0.5 * coalesce((SELECT sum(exp(-(a.t - b.t))) FROM e b WHERE b.user_id = a.user_id AND b.t < a.t), 0) AS intensity FROM e a""", "hour intensity")
def stream_hawkes(spark: SparkSession, d: str) -> DataFrame:
    from wfspark.streaming.operators import hawkes_intensity, run_available

    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 3.6e9
    events = _stream(spark, d).where("event_type = 'error'").select("user_id", hours.alias("hour"))
    return run_available(hawkes_intensity(events, "user_id", "hour", 0.2, 0.5, 1.0)).withColumnRenamed("at", "hour")


@query("""WITH d AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type = 'error'), g AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INT AS run FROM d),
s AS (SELECT user_id, run, count(*) AS days FROM g GROUP BY ALL) SELECT user_id, count(*) AS spells, max(days) AS longest, sum(days)::BIGINT AS days FROM s GROUP BY 1""")
def stream_spells(spark: SparkSession, d: str) -> DataFrame:
    from wfspark.streaming.operators import absence_spells, run_available

    days = _stream(spark, d).where("event_type = 'error'").select("user_id", F.to_date("ts").alias("day")).dropDuplicates()
    spells = run_available(absence_spells(days, "user_id", "day"), "complete")
    return spells.groupBy("user_id").agg(F.count("*").alias("spells"), F.max("days_absent").alias("longest"), F.sum("days_absent").alias("days"))


@query("""WITH w AS (SELECT user_id, value, floor(epoch_us(ts) / 1e6) / 604800 AS week FROM events)
SELECT user_id, CASE WHEN sum(value) > 0 THEN max(week) - sum(value * week) / sum(value) END AS weeks FROM w GROUP BY 1""", "weeks")
def stream_weighted_weeks(spark: SparkSession, d: str) -> DataFrame:
    from wfspark.streaming.operators import run_available, weighted_weeks

    return run_available(weighted_weeks(_stream(spark, d), "user_id", "ts", "value"), "complete")


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t, value FROM events), l AS (SELECT user_id, max(t) AS last FROM e GROUP BY 1)
SELECT user_id, sum(value * pow(0.5, (last - t) / 48)) AS total FROM e JOIN l USING (user_id) GROUP BY 1""", "total", 5)
def stream_decayed_sum(spark: SparkSession, d: str) -> DataFrame:
    from wfspark.streaming.operators import decayed_sum, run_available

    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / 3.6e9
    events = _stream(spark, d).select("user_id", hours.alias("hour"), "value")
    updates = run_available(decayed_sum(events, "user_id", "hour", "value", 48.0), "update")
    return updates.groupBy("user_id").agg(F.max_by("total", "at").alias("total"))


@query("SELECT user_id, sum(n) AS n, sum(s) AS s FROM (SELECT user_id, time_bucket(INTERVAL 1 day, ts) AS w, count(*) AS n, sum(value) AS s FROM events GROUP BY ALL) GROUP BY user_id", "s")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    from wfspark.streaming.operators import daily_counts, run_available

    counts = run_available(daily_counts(_stream(spark, d)), "complete")
    return counts.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
