"""Operators and queries do the whole job: no rows, lags or periods are left out."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wfspark import catalogue
from wfspark.functions.scores import fractional_weights
from wfspark.operators import anomalies, causal, quantiles, temporal


def parts(tmp_path, n=1300):
    r = np.random.default_rng(5)
    df = pd.DataFrame({"p_partkey": np.arange(1, n + 1), "p_retailprice": r.uniform(900, 2000, n).round(2), "p_size": r.integers(1, 51, n)})
    df.to_parquet(tmp_path / "part.parquet")
    z = np.column_stack([(df[c] - df[c].mean()) / df[c].std(ddof=0) for c in ("p_retailprice", "p_size")])
    d = np.round(np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)), 9)
    np.fill_diagonal(d, np.inf)
    best = np.array([np.lexsort((df.p_partkey, x))[:5] for x in d])
    return df, d, best


def test_lof_and_fairness_of_the_whole_table_equal_brute_force(spark, tmp_path):
    df, d, best = parts(tmp_path)
    near = np.take_along_axis(d, best, axis=1)
    lrd = 1 / (np.maximum(near, near.max(axis=1)[best]).mean(axis=1) + 1e-10)
    lof = lrd[best].mean(axis=1) / lrd
    got = catalogue.QUERIES["lof_outliers"](spark, str(tmp_path)).toPandas().sort_values("p_partkey")
    assert len(got) == len(df) and np.allclose(got.lof, lof, atol=1e-5)
    assert (got.is_outlier.to_numpy() == (lof > np.quantile(lof, 0.95))).all()
    y = (df.p_retailprice > 1300).astype(int).to_numpy()
    got = catalogue.QUERIES["individual_fairness"](spark, str(tmp_path)).toPandas().sort_values("p_partkey")
    assert len(got) == len(df) and np.allclose(got.consistency, 1 - abs(y - y[best].mean(axis=1)), atol=1e-6)


@pytest.mark.parametrize("most", [10_000, 400])
def test_neighbours_in_blocks_equal_brute_force(spark, tmp_path, most):
    df, d, best = parts(tmp_path)
    got = anomalies.neighbours(spark.createDataFrame(df), "p_partkey", ["p_retailprice", "p_size"], 5, most=most).toPandas().sort_values(["p_partkey", "rank"])
    assert (got.other.to_numpy().reshape(-1, 5) == best + 1).all() and np.allclose(got.distance.to_numpy().reshape(-1, 5), np.take_along_axis(d, best, axis=1))


def test_neighbours_of_many_equal_rows_and_gaps_equal_brute_force(spark):
    """Rows at one place go by id; rows with a gap have no neighbours and are none, also where the rest is cut into cells."""
    r = np.random.default_rng(9)
    df = pd.DataFrame({"id": r.permutation(900), "a": np.repeat(r.normal(size=60), 15).round(1), "b": r.integers(0, 3, 900).astype(float), "c": r.normal(size=900)})
    df.loc[:4, "b"], df.loc[40:, "c"] = None, 0.0
    x = ((df[["a", "b", "c"]] - df[["a", "b", "c"]].mean()) / df[["a", "b", "c"]].std(ddof=0)).to_numpy()
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    np.fill_diagonal(d, np.nan)
    want = {i: df.id.to_numpy()[np.lexsort((df.id, d[k]))[:7]].tolist() for k, i in enumerate(df.id) if k > 4}
    rows = spark.createDataFrame(df.astype(object).where(df.notna(), None), "id long, a double, b double, c double")
    for most in (10_000, 300):
        got = anomalies.neighbours(rows, "id", ["a", "b", "c"], 7, most=most).toPandas().sort_values(["id", "rank"])
        assert got.groupby("id").other.apply(list).to_dict() == want


def test_neighbour_search_looks_at_few_pairs(monkeypatch):
    """The points that are compared grow with the rows, not with their square."""
    r, seen = np.random.default_rng(3), []
    round_ = np.round
    monkeypatch.setattr(anomalies.np, "round", lambda x, n: seen.append(x.size) or round_(x, n))
    for n in (4000, 16_000):
        anomalies._search(np.arange(n), x := r.normal(size=(n, 2)), x, 6)
        seen.append(-1)
    cut = seen.index(-1)
    assert sum(seen[cut + 1 : -1]) < 6 * sum(seen[:cut])


def test_percentiles_equal_those_of_a_sorted_column(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 40)
    monkeypatch.setattr(quantiles, "BINS", 8)
    r = np.random.default_rng(4)
    df = pd.DataFrame({"a": np.exp(6 * r.normal(size=3001)), "b": r.integers(-2, 3, 3001).astype(float), "k": r.integers(1, 4, 3001)})
    df["c"] = df.a.where(r.random(3001) < 0.5)
    p = [0.0, 0.05, 0.5, 0.951, 1.0]
    rows = spark.createDataFrame(df.astype(object).where(df.notna(), None), "a double, b double, k long, c double")
    got = quantiles.percentiles(rows.withColumn("none", F.lit(None).cast("double")), dict.fromkeys(["a", "b", "c", "none"], p))
    assert all(np.allclose(got[c], np.quantile(df[c].dropna(), p)) for c in "abc") and got["none"] == [None] * 5
    assert np.allclose(quantiles.percentiles(rows, {"a": p}, "k")["a"], np.quantile(np.repeat(df.a, df.k), p))


@pytest.mark.parametrize("threshold", [1e-3, 1e-4])
def test_fractional_difference_keeps_every_weight_from_the_threshold_up(spark, threshold):
    r = np.random.default_rng(6)
    df = pd.DataFrame([(g, k, float(r.normal())) for g, n in (("long", 150), ("short", 40)) for k in range(n)], columns=["g", "k", "v"])
    df.loc[(df.g == "long") & (df.k == 20), "v"] = None
    rows = spark.createDataFrame(df.astype(object).where(df.notna(), None), "g string, k long, v double")
    got = temporal.fractional_difference(rows, "v", 0.4, ["g"], "k", threshold).toPandas().sort_values(["g", "k"])
    for g, part in got.groupby("g"):
        x = part.v.to_numpy()
        w = np.array(fractional_weights(0.4, len(x), threshold))
        want = [x[i - len(w) + 1 : i + 1] @ w[::-1] if i >= len(w) - 1 else np.nan for i in range(len(x))]
        assert np.allclose(part.v_fracdiff, want, equal_nan=True)


def test_frac_diff_of_the_panel_has_55_terms(spark):
    assert len(fractional_weights(0.4, 1000, 1e-3)) == 55
    got = catalogue.QUERIES["frac_diff"](spark, "/root/testdata/sf0.001").toPandas()
    assert (got.groupby("grp").n_fracdiff.count() == got.groupby("grp").size() - 54).all()


def test_causal_forest_learns_from_every_row(spark):
    """The effect is in rows whose hashes are not among the smallest 20,000; it does not depend on the partitions."""
    ids = spark.range(26_000)
    last = ids.orderBy(F.xxhash64("id").desc()).limit(6000).withColumn("x", F.lit(1.0))
    rows = ids.join(last, "id", "left").select("id", F.coalesce("x", F.lit(0.0)).alias("x"), (F.pmod(F.hash("id", F.lit(1)), F.lit(2))).alias("t"), (F.rand(7) - 0.5).alias("noise"))
    rows = spark.createDataFrame(rows.select("id", "x", "t", (F.col("t") * F.col("x") * 2 + F.col("noise")).alias("y")).toPandas())
    got = [causal.causal_forest(rows.repartition(n, "id"), "id", "y", "t", ["x"], trees=4).toPandas().merge(rows.select("id", "x").toPandas()).sort_values("id") for n in (1, 5)]
    for g in got:
        assert abs(g[g.x == 1].effect.mean() - 2) < 0.3 and abs(g[g.x == 0].effect.mean()) < 0.3
    assert np.allclose(got[0].effect, got[1].effect)


def test_autoencoder_fits_all_rows(spark):
    """Errors equal those of one process that trains on all rows, though there are more than 5,000."""
    r = np.random.default_rng(8)
    df = pd.DataFrame({"id": np.arange(5600), "a": r.normal(size=5600), "b": r.normal(size=5600)})
    df["b"] += df.a**2
    x = ((df[["a", "b"]] - df[["a", "b"]].mean()) / df[["a", "b"]].std(ddof=0)).to_numpy()
    r, sizes = np.random.default_rng(42), [2, 12, 1, 12, 2]
    w = [r.normal(0, np.sqrt(2 / m), (m, n)) for m, n in zip(sizes, sizes[1:])] + [np.zeros(n) for n in sizes[1:]]
    m, v = [0 * p for p in w], [0 * p for p in w]

    def forward():
        out = [x]
        for k in range(4):
            a = out[-1] @ w[k] + w[4 + k]
            out.append(np.where(a > 0, a, 0.1 * a) if k < 3 else a)
        return out

    for step in range(1, 16):
        out, grads = forward(), [None] * 8
        d = 2 * (out[-1] - x) / x.size
        for k in (3, 2, 1, 0):
            grads[k], grads[4 + k] = out[k].T @ d, d.sum(axis=0)
            d = (d @ w[k].T) * np.where(out[k] > 0, 1, 0.1)
        for k, g in enumerate(grads):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            w[k] = w[k] - 5e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    got = anomalies.autoencoder(spark.createDataFrame(df).repartition(5), "id", ["a", "b"], latent=1, epochs=15).toPandas().sort_values("id")
    assert np.allclose(got.error, ((forward()[-1] - x) ** 2).mean(axis=1), rtol=1e-6)


def test_alignment_compares_whole_series(spark, duck):
    got = {r.grp: r.dtw for r in catalogue.QUERIES["alignment"](spark, "/root/testdata/sf0.001").collect()}
    panel = duck.execute("SELECT o_orderpriority AS g, date_trunc('month', o_orderdate) AS m, count(*)::DOUBLE AS n FROM orders GROUP BY ALL ORDER BY m").df()
    curves = {g: p.n.to_numpy() for g, p in panel.groupby("g")}
    assert min(map(len, curves.values())) > 70
    assert got == {g: anomalies.dtw_table(c, curves["3-MEDIUM"])[-1, -1] for g, c in curves.items()}


def test_synthetic_controls_and_sdid_read_every_quarter(spark, tmp_path):
    days = pd.date_range("1995-01-15", "2002-12-15", freq="MS") + pd.Timedelta(days=14)
    rows = [(c * 1000 + k, c, day, 1e5 * (c + k / 10 + (5 if c == 1 and day.year == 2002 else 0))) for c in range(1, 9) for k, day in enumerate(days)]
    pd.DataFrame(rows, columns=["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]).astype({"o_orderdate": "datetime64[us]"}).to_parquet(tmp_path / "orders.parquet")
    pd.DataFrame({"c_custkey": range(1, 9), "c_nationkey": range(1, 9)}).to_parquet(tmp_path / "customer.parquet")
    got = catalogue.QUERIES["synthetic_control"](spark, str(tmp_path)).toPandas()
    assert sorted(got.time.unique()) == list(range(1, 33))
    effect = catalogue.QUERIES["sdid"](spark, str(tmp_path)).first()
    assert abs(effect.att - 5 * 4 / 16 / 2) < 0.05  # a lift of 5 in 4 of 16 later quarters of one of two nations


def test_outofsample_cohorts_are_those_of_all_customers(spark, tmp_path):
    bal = {3: [1.0, 2.0, 6.0], 22: [10.0, 12.0, 17.0]}
    customers = pd.DataFrame([(n, x) for n, values in bal.items() for x in values], columns=["c_nationkey", "c_acctbal"])
    customers.to_parquet(tmp_path / "customer.parquet")
    pd.DataFrame({"s_suppkey": [1, 2, 3], "s_nationkey": [3, 22, 24], "s_acctbal": [4.0, 14.0, 9.0]}).to_parquet(tmp_path / "supplier.parquet")
    got = {r.s_suppkey: (r.cohort_size, r.z_score) for r in catalogue.QUERIES["loo_zscore_outofsample"](spark, str(tmp_path)).collect()}
    every = customers.c_acctbal  # nation 24 has no customers: the mean and spread of all
    want = {1: (3, 1 / np.std(bal[3], ddof=1)), 2: (3, 1 / np.std(bal[22], ddof=1)), 3: (0, (9 - every.mean()) / every.std())}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-5 for k in want)


def test_every_supplier_nation_and_region_is_embedded(spark, tmp_path):
    """Also those without a nation or region; what has no name is no node."""
    pd.DataFrame({"s_suppkey": [1, 2, 3], "s_nationkey": [7, 7, None]}).astype("Int64").to_parquet(tmp_path / "supplier.parquet")
    pd.DataFrame({"n_nationkey": [7, 8], "n_regionkey": [0, None]}).astype("Int64").to_parquet(tmp_path / "nation.parquet")
    got = {r.node: r.vector for r in catalogue.QUERIES["metapath2vec"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ["n7", "n8", "r0", "s1", "s2", "s3"] and not any(got["s3"])
