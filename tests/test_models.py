"""Fitted objects: results against plain formulas, new rows, and what comes back from storage."""

import itertools
import json
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wfspark import catalogue
from wfspark.operators import anomalies, careers, causal, encoding, equity, graph, linear, pipeline, series, trees
from wfspark.sources import files, synthetic
from wfspark.streaming import operators as streams


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(1)
    df = pd.DataFrame({"id": np.arange(120), "a": r.normal(size=120), "b": r.normal(size=120), "g": np.where(np.arange(120) % 3 == 0, "x", "y")})
    df.loc[5, ["a", "b"]] = 9.0, -9.0
    return df


def test_attention_equals_its_formula(spark):
    r = np.random.default_rng(2)
    tokens = {k: r.normal(size=(n, 8)) for k, n in (("p", 1), ("q", 7), ("r", 40))}
    model = careers.AttentionPooling.fresh(8, heads=2)
    rows = [(k, i, v.tolist()) for k, x in tokens.items() for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("q", 99, None)], "who string, i int, v array<double>").repartition(5)
    for query in (None, list(np.arange(8.0))):
        got = {x["who"]: x for x in model.transform(df, ["who"], "v", query).collect()}
        weights = {(x["who"], x["i"]): x["attention"] for x in model.weights(df.where("v is not null"), ["who"], "v", query).collect()}
        for k, x in tokens.items():
            q = (x.mean(axis=0) if query is None else np.array(query)) @ model.query
            parts, shares = [], []
            for h in range(2):
                at = slice(4 * h, 4 * h + 4)
                s = (x @ model.key)[:, at] @ q[at] / 2
                w = np.exp(s - s.max())
                shares.append(w / w.sum())
                parts.append(shares[-1] @ (x @ model.value)[:, at])
            assert np.allclose(got[k]["pooled"], np.concatenate(parts) @ model.output) and got[k]["n_tokens"] == len(x)
            assert np.allclose([weights[k, i] for i in range(len(x))], np.mean(shares, axis=0))
            assert np.allclose(model.aggregate(x, None if query is None else np.array(query))[0], got[k]["pooled"])
    again = careers.AttentionPooling.from_json(model.to_json())
    assert np.array_equal(again.output, model.output) and again.heads == 2
    with pytest.raises(ValueError):
        careers.AttentionPooling.fresh(8, heads=3)


def test_outliers_of_new_rows(spark, points, tmp_path):
    df = spark.createDataFrame(points)
    model = anomalies.LocalOutliers.fit(df, "id", ["a", "b"], k=5)
    z = ((points[["a", "b"]] - points[["a", "b"]].mean()) / points[["a", "b"]].std(ddof=0)).to_numpy()
    new = pd.DataFrame({"id": [500, 501], "a": [0.1, 20.0], "b": [0.0, 20.0]})
    zn = ((new[["a", "b"]] - points[["a", "b"]].mean()) / points[["a", "b"]].std(ddof=0)).to_numpy()
    d = np.round(np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)), 9)
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1, kind="stable")[:, :5]
    near = np.take_along_axis(d, best, axis=1)
    lrd = 1 / (np.maximum(near, near.max(axis=1)[best]).mean(axis=1) + 1e-10)
    dn = np.round(np.sqrt(((zn[:, None] - z[None]) ** 2).sum(axis=2)), 9)
    bn = np.argsort(dn, axis=1, kind="stable")[:, :5]
    want = lrd[bn].mean(axis=1) * (np.maximum(np.take_along_axis(dn, bn, axis=1), near.max(axis=1)[bn]).mean(axis=1) + 1e-10)
    model.save(str(tmp_path / "lof"))
    again = anomalies.LocalOutliers.load(spark, str(tmp_path / "lof"))
    for m, most in ((model, 50_000), (again, 50_000), (again, 50)):
        got = m.predict(spark.createDataFrame(new), most).toPandas().sort_values("id")
        assert np.allclose(got.lof, want) and got.is_outlier.tolist() == [want[0] > model.threshold, True]


def test_autoencoder_thresholds_and_storage(spark, points):
    df = spark.createDataFrame(points)
    model = anomalies.Autoencoder.fit(df, ["a", "b"], latent=1, epochs=8)
    errors = model.transform(df).toPandas()
    e = errors.error.to_numpy()
    assert np.allclose(e, [np.mean(x) for x in errors.errors])
    q1, q3 = np.percentile(e, [25, 75])
    for method, options, want in (("percentile", {}, np.percentile(e, 95)), ("percentile", {"percentile": 80}, np.percentile(e, 80)), ("iqr", {}, q3 + 1.5 * (q3 - q1)), ("gaussian", {}, e.mean() + 3 * e.std())):
        assert abs(model.select_threshold(df, method, **options) - want) < 1e-9
    again = anomalies.Autoencoder.from_json(model.to_json())
    got = again.predict(df).toPandas()
    assert np.allclose(got.error, e) and (got.is_anomalous == (e >= model.threshold)).all()
    with pytest.raises(ValueError):
        model.select_threshold(df, "no such")


def test_causal_forest_on_new_rows(spark):
    r = np.random.default_rng(3)
    n = 6000
    df = pd.DataFrame({"id": np.arange(n), "x": r.uniform(size=n), "noise": r.uniform(size=n), "t": r.integers(0, 2, n)})
    df["y"] = df.t * np.where(df.x > 0.5, 2.0, -1.0) + r.normal(0, 0.3, n)
    forest = causal.CausalForest.fit(spark.createDataFrame(df), "id", "y", "t", ["x", "noise"], trees=8, depth=3)
    new = spark.createDataFrame([(1, 0.9, 0.5), (2, 0.1, 0.5), (3, None, 0.5)], "id long, x double, noise double")
    got = {x["id"]: x for x in causal.CausalForest.from_json(forest.to_json()).persuadables(new).collect()}
    assert abs(got[1]["effect"] - 2) < 0.5 and abs(got[2]["effect"] + 1) < 0.5
    assert got[1]["is_persuadable"] and got[2]["archetype"].startswith("Do Not Disturb") and abs(got[3]["effect"] - got[2]["effect"]) < 0.2
    names = [x["feature"] for x in forest.importances(spark).collect()]
    assert names == ["x", "noise"] and abs(sum(x["importance"] for x in forest.importances(spark, "split").collect()) - 1) < 1e-9
    tree = forest.trees[0]
    x = r.uniform(size=(50, 2))
    flat = {node: rest for node, *rest in tree.flatten()}
    for row, effect in zip(x, tree.predict(x)):
        node = 0
        while flat[node][0] >= 0:
            left, right, f, cut, _ = flat[node]
            node = left if row[f] <= cut else right
        assert flat[node][4] == effect and tree.predict_instance(row) == (effect, node)


def test_split_weighs_all_bins(spark):
    r = np.random.default_rng(4)
    for _ in range(30):
        bins, leaf = 12, 3
        h = np.zeros((2, bins + 1, 2, 3))
        h[..., 0] = r.integers(0, 6, h.shape[:-1])
        h[..., 1] = h[..., 0] * r.uniform(0.5, 1, h.shape[:-1])
        h[..., 2] = h[..., 1] * r.normal(size=h.shape[:-1])
        edges = [np.arange(float(bins)), np.arange(float(bins))]
        best = (0.0, -1, -1)
        for f in range(2):
            n = h[f, :, 0, 0].sum()
            marks = {int(np.argmax(h[f, :, 0, 0].cumsum() >= q * n)) for q in np.arange(0.1, 0.91, 0.1)}
            for c in marks:
                lo, hi = h[f, : c + 1, 0].sum(axis=0), h[f, c + 1 :, 0].sum(axis=0)
                if c < bins and min(lo[0], hi[0]) >= leaf:
                    gain = lo[0] * hi[0] / n * (lo[2] / (lo[1] + 1e-6) - hi[2] / (hi[1] + 1e-6)) ** 2
                    best = max(best, (gain, f, c))
        found = causal._split(h, np.array([0, 1]), edges, leaf)
        assert (found is None and best[1] < 0) or (found[:2] == best[1:] and abs(found[2] - best[0]) < 1e-9)


def test_doubly_robust_scores(spark):
    r = np.random.default_rng(5)
    n = 1500
    df = pd.DataFrame({"id": np.arange(n), "x": r.normal(size=n)})
    df["t"] = (r.uniform(size=n) < 1 / (1 + np.exp(-df.x))).astype(int)
    df["y"] = 2 * df.t + df.x + r.normal(0, 0.5, n)
    rows = spark.createDataFrame(df)
    scored = causal.doubly_robust(rows, "id", "y", "t", ["x"], folds=3).toPandas()
    fold = rows.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("f")).toPandas().set_index("id").f
    scored["f"] = scored.id.map(fold)
    for k in range(3):
        train, test = scored[scored.f != k], scored[scored.f == k]
        x = np.column_stack([np.ones(len(train)), train.x])
        b = np.zeros(2)
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ b))
            b += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([1e-9, 1.0]), x.T @ (train.t - p) - np.array([1e-9, 1.0]) * b)
        assert np.allclose(test.propensity, np.clip(1 / (1 + np.exp(-(b[0] + b[1] * test.x))), 0.01, 0.99), atol=1e-6)
        for arm in (0, 1):
            part = train[train.t == arm]
            dx, dy = part.x - part.x.mean(), part.y - part.y.mean()
            slope = (dx * dy).sum() / ((dx**2).sum() + 1)
            assert np.allclose(test[f"mu{arm}"], part.y.mean() + slope * (test.x - part.x.mean()), atol=1e-6)
    got = causal.aipw(rows, "id", "y", "t", ["x"], folds=3).first()
    assert abs(got["ate"] - scored.psi.mean()) < 1e-9 and abs(got["ate"] - 2) < 0.15 and abs(got["z"] - got["ate"] / got["se"]) < 1e-9
    assert abs(got["naive_ate"] - (df[df.t == 1].y.mean() - df[df.t == 0].y.mean())) < 1e-9 and got["naive_ate"] > 2.3
    given = causal.aipw(rows, "id", "y", "t", ["x"], folds=2, propensity=lambda part, target, features: F.lit(0.5), regression=causal.ridge_learner(0.0)).first()
    assert abs(given["ate"] - 2) < 0.15
    with pytest.raises(ValueError):
        causal.aipw(rows.withColumn("t", F.lit(2)), "id", "y", "t", ["x"])


def test_equalized_odds_narrow_the_gaps(spark):
    r = np.random.default_rng(6)
    n = 4000
    g = r.integers(0, 2, n)
    x = r.normal(size=n) + 0.8 * g
    df = pd.DataFrame({"id": np.arange(n), "g": np.where(g == 1, "u", "v"), "x": x, "y": (x + r.normal(0, 1.2, n) > 0.4).astype(int)})
    rows = spark.createDataFrame(df)

    def gaps(found):
        m = found.toPandas().merge(df)
        rate = m.groupby(["y", "g"]).predicted.mean()
        return max(abs(rate[k, "u"] - rate[k, "v"]) for k in (0, 1)), abs(m.groupby("g").predicted.mean().diff().iloc[-1])

    plain = gaps(causal.fair_classifier(rows, "id", "y", "g", ["x"], rounds=1))
    with pytest.raises(ValueError):
        causal.fair_classifier(rows, "id", "y", "g", ["x"], constraint="no such")
    for constraint in ("parity", "odds"):
        found = causal.fair_classifier(rows, "id", "y", "g", ["x"], rounds=6, constraint=constraint)
        assert found.count() == n and gaps(found)[0] <= plain[0] + 0.05


def test_series_run_through_batches(spark):
    r = np.random.default_rng(7)
    sizes = {"a": 1, "b": 25, "c": 3, "d": 61, None: 8}
    rows = [(g, k, float(r.normal())) for g, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = series.ewma(df, ["g"], "k", "v", alpha=0.3).toPandas()
        whole = series.series(df, ["g"], "k", "v", lambda x: {"n": len(x), "last": x[-1]}, ["n", "last"], whole=True).toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows) and len(whole) == len(sizes)
    for g, n in sizes.items():
        x = np.array([v for h, _, v in rows if h == g])
        part = got[got.g.isna() if g is None else got.g == g].sort_values("k")
        assert np.allclose(part.ewma, series.ewma_kernel(x, 0.3))
        assert whole[whole.g.isna() if g is None else whole.g == g].n.tolist() == [n]


def test_smoothing_states_and_forecast():
    t = np.arange(60.0)
    line = series.smooth(3 + 2 * t, horizon=3)
    assert np.allclose(line.forecast, 3 + 2 * np.arange(60, 63), atol=1e-6) and line.sse < 1e-9
    times = (10 + 0.1 * t) * np.tile([0.5, 1.0, 1.5, 1.0], 15)
    good, bad = (series.smooth(times, period=4, seasonal=s, horizon=4) for s in ("mul", "add"))
    assert good.sse < 0.2 * bad.sse and abs(good.forecast / ((10 + 0.1 * np.arange(60, 64)) * [0.5, 1, 1.5, 1]) - 1).max() < 0.05
    fit = series.smooth(times, period=4, seasonal="mul")
    for other in (0.05, 0.5, 0.9):
        assert fit.sse <= series.smooth(times, alpha=other, beta=0.1, gamma=0.1, period=4, seasonal="mul").sse + 1e-9
    assert json.loads(json.dumps(fit.to_dict()))["period"] == 4 and fit.bic > fit.aic


def test_garch_forecasts_and_likelihood():
    r = np.random.default_rng(8)
    e, h = [], 1.0
    for _ in range(600):
        x = r.normal() * math.sqrt(h)
        e.append(x)
        h = 0.1 + 0.2 * x * x + 0.7 * h
    m = series.Garch.fit(np.array(e))
    assert 0.8 < m.arch.sum() + m.garch.sum() < 1
    v = m.predict(200)
    assert abs(v[0] - (m.omega + m.arch[0] * m.shocks[-1] ** 2 + m.garch[0] * m.volatility[-1] ** 2)) < 1e-9
    assert abs(v[-1] / (m.omega / (1 - m.arch[0] - m.garch[0])) - 1) < 0.05
    z = m.shocks / m.volatility
    assert abs(m.loglik - np.sum(-0.5 * (np.log(2 * np.pi) + 2 * np.log(m.volatility) + z**2))) < 1e-6 and abs(m.aic - (8 - 2 * m.loglik)) < 1e-9
    two = series.Garch.fit(np.array(e), 2, 1)
    assert len(two.garch) == 2 and two.loglik > m.loglik - 1 and len(series.Garch.fit(np.ones(20)).predict(3)) == 3


def test_hidden_markov_on_new_rows(spark):
    r = np.random.default_rng(9)
    state = np.repeat([0, 1, 2, 0, 2, 1], 40)
    x = np.column_stack([state * 5 + r.normal(size=240), -3 * state + r.normal(size=240)])
    m = series.HiddenMarkov.fit(x, 3, columns=["u", "w"])
    assert np.allclose(m.means[:, 0], [0, 5, 10], atol=0.6) and (m.predict(x) == state).mean() > 0.97
    shares = m.profile(x)
    assert abs(sum(p["prevalence_pct"] for p in shares) - 100) < 1e-9 and abs(shares[1]["mean_w"] + 3) < 0.6
    again = series.HiddenMarkov.from_json(m.to_json())
    new = spark.createDataFrame([("s", k, float(v), float(-0.6 * v)) for k, v in enumerate([0, 0.2, 5, 5.1, 10, 9.8])], "g string, k int, u double, w double")
    got = again.transform(new, ["g"], "k").toPandas().sort_values("k")
    assert got.regime.tolist() == [0, 0, 1, 1, 2, 2] and np.allclose(got[["prob_0", "prob_1", "prob_2"]].sum(axis=1), 1)


def test_hawkes_simulation_and_fit():
    true = series.Hawkes(0.5, 0.6, 1.2)
    t = true.simulate(1500, seed=3)
    assert np.array_equal(t, true.simulate(1500, seed=3)) and t.max() <= 1500 and (np.diff(t) > 0).all()
    assert abs(len(t) / 1500 - 0.5 / (1 - 0.5)) < 0.2
    fit = series.Hawkes.fit(t, 1500)
    assert abs(fit.branching_ratio - 0.5) < 0.15
    found = true.goodness_of_fit(t, 1500)
    assert found["is_good_fit"] and abs(found["tau"].mean() - 1) < 0.1 and abs(found["loglik"] - true.loglik(t, 1500)) < 1e-9
    assert not series.Hawkes(0.1, 0.1, 5.0).goodness_of_fit(t, 1500)["is_good_fit"]
    few = np.array([1.0, 1.5, 4.0])
    at = np.array([0.5, 1.2, 1.5, 3.0, 9.0])
    want = [0.5 + 0.6 * sum(math.exp(-1.2 * (s - e)) for e in few if e < s) for s in at]
    assert np.allclose(true.intensity(few, at), want)
    lam = [0.5 * s + 0.5 * sum(1 - math.exp(-1.2 * (s - e)) for e in few if e < s) for s in few]
    assert np.allclose(true.compensator(few), lam) and series.Hawkes.from_json(true.to_json()) == true


@pytest.mark.parametrize("n, d, want", [(3, 0.5, 0.3333333), (10, 0.274, 0.3728481), (50, 0.15, 0.1920757)])
def test_kolmogorov_tail(n, d, want):
    if n == 3:  # by hand: P(D < 1/2) = 2/3 * ... for three uniforms
        r = np.sort(np.random.default_rng(0).uniform(size=(200_000, 3)), axis=1)
        far = np.maximum((r - np.arange(3) / 3).max(axis=1), (np.arange(1, 4) / 3 - r).max(axis=1))
        want = (far >= d).mean()
    else:
        r = np.sort(np.random.default_rng(n).uniform(size=(100_000, n)), axis=1)
        far = np.maximum((r - np.arange(n) / n).max(axis=1), (np.arange(1, n + 1) / n - r).max(axis=1))
        want = (far >= d).mean()
    assert abs(series.kolmogorov_tail(n, d) - want) < 0.006
    assert abs(series.kolmogorov_tail(501, 0.05) - series.kolmogorov_tail(500, 0.05)) < 0.01


def test_singular_spectrum_parts_add_up():
    x = np.sin(np.arange(80) / 5) + 0.02 * np.arange(80)
    m = series.SingularSpectrum(window=20, top_k=4)
    assert np.allclose(m.components(x).sum(axis=0), m.baseline(x)) and abs(m.shares(x).sum() - 1) < 1e-12 and np.allclose(m.baseline(x), x, atol=1e-6)


def test_correlations_by_all_pairs(spark):
    r = np.random.default_rng(10)
    y, x = r.integers(0, 12, 80), r.integers(0, 9, 80)
    x = np.where(r.uniform(size=80) < 0.5, x, y)
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, x)], "y int, x int")
    tau, p = linear.kendall(rows, "y", "x")
    sy, sx = np.sign(np.subtract.outer(y, y)), np.sign(np.subtract.outer(x, x))
    assert abs(tau - (sx * sy).sum() / math.sqrt((sx != 0).sum() * (sy != 0).sum())) < 1e-12 and 0 < p < 0.01
    clean = r.normal(size=(300, 2)) @ [[1, 0.8], [0, 0.6]]
    dirty = np.vstack([clean, [[9, -9]] * 6])
    frame = spark.createDataFrame(pd.DataFrame(dirty, columns=["y", "x"]))
    pearson, robust = (linear.correlation_table(frame, "y", ["x"], m).first()["r"] for m in ("pearson", "shepherd"))
    assert robust > 0.7 > pearson
    for m in ("bicor", "percbend"):
        assert linear.correlation_table(frame, "y", ["x"], m).first()["r"] > 0.65
    found = linear.correlation_table(frame.withColumn("z", F.randn(3)), "y", ["z", "x"], "spearman", power=True, drop_insignificant=True, drop_ci_contain_0=True)
    assert [x["feature"] for x in found.collect()] == ["x"] and found.first()["power"] > 0.999 and linear.style_bands(found).first()["style_band"] == "strong"
    # a correlation of 0.3 in 84 rows is found in about 80 of 100 trials
    assert abs(linear.correlation_power(0.3, 84) - 0.8) < 0.01 and abs(linear.t_quantile(0.975, 10) - 2.228139) < 1e-5


def test_robust_distances_see_what_plain_ones_miss(spark):
    r = np.random.default_rng(11)
    x = np.vstack([r.normal(size=(160, 3)), r.normal(size=(40, 3)) * 0.2 + 8])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(id=range(200)))
    plain, robust = (linear.mahalanobis(df, ["a", "b", "c"], robust=k).toPandas().sort_values("id").is_outlier.to_numpy() for k in (False, True))
    assert robust[160:].all() and robust[:160].mean() < 0.12 and not plain[160:].all()
    by = linear.mahalanobis(df, ["a", "b", "c"], reference=df.where("id < 160")).toPandas().sort_values("id")
    m, s = x[:160].mean(axis=0), np.cov(x[:160], rowvar=False) + 1e-6 * np.eye(3)
    assert np.allclose(by.mahalanobis, np.sqrt(np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(s), x - m)))


def test_oaxaca_without_a_group_and_residuals_by_text(spark, points):
    df = spark.createDataFrame(points)
    assert linear.oaxaca(df, "a", "g", ["b"], "x", "nobody").count() == 0
    got = linear.loo_expected_differential(df.withColumn("e", F.col("id") % 4), "e", "a", ["b", "g"]).toPandas().sort_values("e")
    x = np.column_stack([points.b, (points.g == "y").astype(float)])
    xc, yc = x - x.mean(axis=0), points.a - points.a.mean()
    beta = np.linalg.solve(xc.T @ xc + np.eye(2), xc.T @ yc)
    left = yc - xc @ beta
    assert np.allclose(got.mean_residual, left.groupby(points.id % 4).mean())


def test_encoders_come_back_from_storage(spark, points, tmp_path):
    df = spark.createDataFrame(points)
    model = encoding.TargetEncoder(["g"], "a").fit(df)
    model.save(str(tmp_path / "codes"))
    again = encoding.TargetEncoder.load(spark, str(tmp_path / "codes"))
    new = spark.createDataFrame([("x", 1), ("unseen", 2)], "g string, id int")
    assert sorted(map(tuple, again.transform(new).collect())) == sorted(map(tuple, model.transform(new).collect()))
    code = model.state.where("g = 'x'").first()["code"]
    asked = spark.createDataFrame([(1, code), (2, code + 0.01)], "id int, v double")
    assert {r["id"]: r["decoded"] for r in again.inverse(asked, "v", "id", strategy="exact").collect()} == {1: "x", 2: None}
    scorer = encoding.CohortScorer(["g"], "a").fit(df)
    scorer.save(str(tmp_path / "cohorts"))
    rows = df.select("id", "g", "a").union(spark.createDataFrame([(999, 1.0, "w")], "id long, a double, g string").select("id", "g", "a"))
    one, two = (sorted(map(tuple, m.transform(rows).collect())) for m in (scorer, encoding.CohortScorer.load(spark, str(tmp_path / "cohorts"))))
    assert one == two and len(one) == 121
    gap = equity.pay_gap(df.withColumn("pay", F.col("id") + 10.0), "pay", "g").first()
    assert gap["ref_mean"] >= gap["cmp_mean"]


def test_operators_as_stages(spark, points):
    df = spark.createDataFrame(points)
    model = pipeline.chain(pipeline.Apply(encoding.loo_zscore, cohort=["g"], value="a"), pipeline.Learn(lambda rows: encoding.TargetEncoder(["g"], "b").fit(rows), output="code")).fit(df)
    out = model.transform(df.where("id < 50"))
    assert {"loo_z_score", "code"} <= set(out.columns) and out.count() == 50


def test_graph_pieces(spark):
    r = np.random.default_rng(12)
    pairs = [(int(a), int(b), float(r.integers(1, 9)), k) for k, (a, b) in enumerate(r.integers(0, 14, (60, 2)))]
    raw = spark.createDataFrame(pairs, "a int, b int, w double, k int")
    edges = graph.edges_from(raw, "a", "b", "w")
    w = np.zeros((14, 14))
    for a, b, v, _ in pairs:
        if a != b:
            w[a, b] += v
            w[b, a] += v
    p = w / np.maximum(w.sum(axis=1, keepdims=True), 1e-12)
    want = {i: sum((p[i, j] + sum(p[i, q] * p[q, j] for q in range(14) if q not in (i, j))) ** 2 for j in range(14) if p[i, j] > 0) for i in range(14) if w[i].any()}
    got = {x["node"]: x["constraint"] for x in graph.burt_constraint(edges).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    one, two = ({x["node"]: x["eigenvector"] for x in graph.eigenvector(edges, dense=n).collect()} for n in (100, 3))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-4 for k in one)
    last = {(min(a, b), max(a, b)): v for a, b, v, _ in pairs if a != b}
    assert {(x["src"], x["dst"]): x["weight"] for x in graph.edges_from(raw, "a", "b", "w", dedupe="last", order="k").collect()} == last
    with pytest.raises(ValueError):
        graph.edges_from(raw, "a", "b", "w", dedupe="last")


def test_walk_embeddings(spark):
    types = spark.createDataFrame([(x, x[0]) for x in ("p1", "p2", "p3", "p4", "q1", "q2", "z1")], "node string, node_type string")
    edges = spark.createDataFrame([("p1", "q1", 1.0), ("p2", "q1", 1.0), ("p3", "q2", 1.0), ("p4", "q2", 1.0)], "src string, dst string, weight double")
    walks = graph.metapath_walks(types, edges, ["p", "q", "p"], length=8, walks=6)
    near = {("p1", "q1"), ("p2", "q1"), ("p3", "q2"), ("p4", "q2")}
    for x in walks.collect():
        assert len(x["nodes"]) == 8 and all((min(a, b), max(a, b)) in near for a, b in zip(x["nodes"], x["nodes"][1:]))
    m = graph.NodeEmbeddings.fit(types, walks, dim=4, negative=1)
    best = m.similar(spark, "p1", 2, "p").collect()
    assert best[0]["node"] == "p2" and best[0]["cosine"] > best[1]["cosine"] and not m.vectors[m.names.index("z1")].any()
    close, far = m.complementarity(["p1", "p2"]), m.complementarity(["p1", "p3"])
    assert close["pairwise_cohesion"] > far["pairwise_cohesion"] and m.complementarity(["p1"])["pairwise_cohesion"] == 1.0
    assert graph.NodeEmbeddings.from_json(m.to_json()).names == m.names


def test_embeddings_of_more_nodes_than_a_dense_matrix_takes(spark, monkeypatch):
    """Blocks that are factored apart give the vectors of the whole matrix."""
    r = np.random.default_rng(2)
    types = spark.createDataFrame([(f"p{k}", "p") for k in range(60)] + [(f"q{k}", "q") for k in range(12)], "node string, node_type string")
    edges = spark.createDataFrame([(f"p{k}", f"q{q}", 1.0) for k in range(60) for q in set(4 * (k % 3) + r.integers(0, 4, 2))], "src string, dst string, weight double")
    walks = graph.metapath_walks(types, edges, ["p", "q", "p"], length=6, walks=4)
    monkeypatch.setattr(graph, "MOST_DENSE", 10)
    model = graph.NodeEmbeddings.fit(types, walks, dim=72, negative=2)
    at, m = {n: k for k, n in enumerate(model.names)}, np.zeros((72, 72))
    for w in walks.collect():
        for i, a in enumerate(w["nodes"]):
            for j, b in enumerate(w["nodes"]):
                m[at[a], at[b]] += i != j and abs(i - j) <= 5
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.nan_to_num(np.maximum(0, np.log(m * m.sum() / np.outer(m.sum(axis=1), m.sum(axis=0)) / 2)))
    want = (np.linalg.svd(m)[0] * np.linalg.svd(m)[1])[:, :71]
    want = want / np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(model.vectors @ model.vectors.T, want @ want.T, atol=1e-6)
    got = {x["node"]: x["vector"] for x in model.frame(spark).collect()}
    assert all(np.array_equal(got[n], v) for n, v in zip(model.names, model.vectors))


def test_similar_nodes_of_6000_suppliers(spark, tmp_path):
    n = 6000
    pd.DataFrame({"s_suppkey": range(n), "s_nationkey": [k % 400 for k in range(n)]}).to_parquet(tmp_path / "supplier.parquet")
    pd.DataFrame({"n_nationkey": range(400), "n_regionkey": [k % 5 for k in range(400)]}).to_parquet(tmp_path / "nation.parquet")
    got = catalogue.QUERIES["similar_nodes"](spark, str(tmp_path)).toPandas()
    assert len(got) == 5 and "s2" not in set(got.node) and got.cosine.is_monotonic_decreasing


def test_sparse_leading_vectors_are_those_of_a_dense_matrix():
    r = np.random.default_rng(6)
    m = np.triu(r.random((400, 400)) * (r.random((400, 400)) < 0.05))
    m = m + m.T
    m[:50, :50] += 1.0  # and equal values: two blocks alike
    m[100:150, 100:150] = m[200:250, 200:250]
    m[100:150, 150:], m[150:, 100:150], m[200:250, :200], m[:200, 200:250], m[200:250, 250:], m[250:, 200:250], m[100:150, :100], m[:100, 100:150] = (0,) * 8
    values, q = graph._leading(*np.nonzero(m), m[np.nonzero(m)], 400, 12, dense=0)
    u, sv, _ = np.linalg.svd(m)
    assert np.allclose(values, sv[:12]) and np.allclose(np.abs(m @ q), np.abs(q) * values, atol=1e-6) and np.allclose(q.T @ q, np.eye(12), atol=1e-8)


def test_connected_parts(spark):
    pairs = [(k, k + 1) for k in range(40, 0, -1)] + [(100, 101), (103, 101), (7, 7)]
    got = {x["node"]: x["part"] for x in graph._parts(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 42)} | {k: 100 for k in (100, 101, 103)}


def test_streams_equal_batches(spark, tmp_path):
    r = np.random.default_rng(13)
    rows = [(int(u), float(t), (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=float(t))).floor("ms").to_pydatetime(), "abc"[int(c)]) for u, t, c in zip(r.integers(0, 5, 300), np.sort(r.uniform(0, 900, 300)), r.integers(0, 3, 300))]
    table = spark.createDataFrame(rows, "u int, t double, ts timestamp, c string")
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    got = streams.run_available(streams.hawkes_intensity(stream(), "u", "t", 0.2, 0.5, 1.0)).toPandas().sort_values(["u", "at"])
    want = series.hawkes_intensity(table.select("u", "t"), ["u"], "t", series.Hawkes()).toPandas().sort_values(["u", "t"])
    assert np.allclose(got["at"], want.t) and np.allclose(got.intensity, want.intensity)
    ages = streams.run_available(streams.weighted_weeks(stream(), "u", "ts", "t"), "complete").toPandas().set_index("u").weeks
    for u, part in table.toPandas().groupby("u"):
        weeks = part.ts.map(lambda x: x.timestamp()) / 604800
        assert abs(ages[u] - (weeks.max() - (part.t * weeks).sum() / part.t.sum())) < 1e-6
    spells = streams.run_available(streams.absence_spells(stream().select("u", F.to_date("ts").alias("day")).dropDuplicates(), "u", "day"), "complete")
    days = {u: sorted(set(p.ts.dt.normalize())) for u, p in table.toPandas().groupby("u")}
    runs = {}
    for u, d in days.items():
        runs[u] = sorted(np.diff(np.flatnonzero([True, *[(b - a).days > 1 for a, b in zip(d, d[1:])], True])).tolist())
    assert {u: sorted(g.days_absent.tolist()) for u, g in spells.toPandas().groupby("u")} == runs
    # windows that the watermark has passed
    entropy = streams.run_available(streams.sliding_entropy(stream(), "u", "ts", "c", "7 days", "7 days")).collect()
    counts = table.groupBy("u", F.window("ts", "7 days").alias("w"), "c").count().toPandas()
    for row in entropy:
        n = counts[(counts.u == row["u"]) & counts.w.map(lambda w: w.start == row["window"]["start"])]["count"].to_numpy()
        assert row["n"] == n.sum() and abs(row["entropy"] + (n / n.sum() * np.log2(n / n.sum())).sum()) < 1e-9
    assert len(entropy) > 10


def test_trees_of_repeated_rows_are_those_of_the_rows(spark):
    """Splits come from all rows, not from a sample of them, and equal rows are fitted once, as MLlib fits them."""
    r = np.random.default_rng(15)
    x = pd.DataFrame({"a": r.integers(0, 60, 500).astype(float), "b": r.integers(0, 6, 500).astype(float)})
    x["y"] = np.sqrt(x.a) * x.b + r.normal(0, 0.3, 500)
    df = spark.createDataFrame(x)
    copies = df.crossJoin(spark.range(40)).drop("id")
    one, many = (trees.BoostedTrees.fit(rows, "y", ["a", "b"], depth=3, rounds=3) for rows in (df, copies))
    for s, t in zip(one.trees, many.trees):
        assert np.array_equal(s.feature, t.feature) and np.allclose(s.threshold, t.threshold) and np.allclose(s.value, t.value) and np.allclose(40 * s.cover, t.cover)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    plain = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df.withColumn("a", F.floor(F.col("a") / 6)))
    want = GBTRegressor(featuresCol="x", labelCol="y", maxDepth=3, maxIter=3, stepSize=0.1, seed=42).fit(plain).transform(plain).toPandas()
    got = trees.BoostedTrees.fit(plain, "y", ["a", "b"], depth=3, rounds=3).predict(want[["a", "b"]].to_numpy(float))
    assert np.allclose(got, want.prediction)


def test_thresholds_of_repeated_rows_are_those_of_the_rows(spark):
    r = np.random.default_rng(16)
    x = pd.DataFrame({"a": r.integers(0, 50, 400).astype(float)})
    x["shap_a"] = np.where(x.a > 30, 1.0, -0.5) + 0.01 * x.a
    x["k"] = r.integers(1, 30, 400)
    df = spark.createDataFrame(x)
    whole = df.withColumn("i", F.explode(F.sequence(F.lit(1), "k"))).drop("i", "k")
    assert trees.threshold_table(df, ["a"], rounds=3, weight="k").first() == trees.threshold_table(whole, ["a"], rounds=3).first()


def test_interactions_of_repeated_rows_are_looked_at_once(spark, monkeypatch):
    r = np.random.default_rng(17)
    x = pd.DataFrame(r.integers(0, 4, (300, 2)).astype(float), columns=["a", "b"])
    x["y"] = x.a * x.b
    df = spark.createDataFrame(x)
    model, rows = trees.BoostedTrees.fit(df, "y", ["a", "b"], depth=2, rounds=3), []
    seen = type(df).mapInPandas
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, *a, **k: rows.append(self.count()) or seen(self, *a, **k))
    strength = model.interactions(df.crossJoin(spark.range(20)).drop("id")).first()["strength"]
    assert rows == [16] and abs(strength - 2 * np.abs(model.contributions(x[["a", "b"]].to_numpy())[1]).mean(axis=0)[0, 1]) < 1e-9


@pytest.mark.parametrize("method", ["bicor", "percbend"])
def test_robust_correlations_without_a_map_of_all_values(spark, monkeypatch, method):
    r = np.random.default_rng(18)
    x = pd.DataFrame({"y": r.normal(size=701), "a": r.integers(0, 9, 701).astype(float)})
    x["y"] += 0.2 * x.a + np.where(r.random(701) < 0.05, 50, 0)
    d = x - x.median()
    if method == "bicor":
        u = d / (9 * d.abs().median())
        t = np.where(u.abs() < 1, d * (1 - u * u) ** 2, 0)
    else:
        omega = d.abs().apply(lambda v: np.sort(v)[int(np.floor(0.8 * 701 + 0.5)) - 1])
        high, low = (d > omega).sum(), (d < -omega).sum()
        t = ((x - (omega * (high - low) + x.where(d.abs() <= omega).sum()) / (701 - high - low)) / omega).clip(-1, 1).to_numpy()

    def none(*a, **k):
        raise AssertionError("holds all values of a column in one task")

    monkeypatch.setattr(linear.F, "percentile", none)
    got = linear.correlation_table(spark.createDataFrame(x), "y", ["a"], method).first()["r"]
    assert abs(got - (t[:, 0] * t[:, 1]).sum() / np.sqrt((t**2).sum(axis=0).prod())) < 1e-9


@pytest.mark.parametrize("few", [1000, 10, 0])
def test_rank_correlations_equal_those_of_ranked_columns(spark, monkeypatch, few):
    r = np.random.default_rng(19)
    x = pd.DataFrame({"y": r.integers(0, 300, 900) / 7, "a": r.integers(-3, 3, 900).astype(float), "b": r.normal(size=900).round(1)})
    x["y"] += x.a
    if few == 1000:  # no row is joined with the ranks of all values
        monkeypatch.setattr(linear, "average_ranks", None)
    n, got = linear.rank_correlations(spark.createDataFrame(x).repartition(3), "y", ["a", "b"], few)
    assert n == 900 and np.allclose(got, x.corr("spearman").loc["y", ["a", "b"]])


def test_bootstrap_weights_are_poisson_numbers():
    w = linear._poisson(np.random.default_rng(1), (1000, 1000))
    share = [np.exp(-1) / math.factorial(k) for k in range(8)]
    assert np.allclose([(w == k).mean() for k in range(8)], share, atol=2e-3) and abs(w.mean() - 1) < 5e-3 and abs(w.var() - 1) < 1e-2


def test_shepherd_of_several_features_leaves_outliers_out(spark):
    r = np.random.default_rng(20)
    x = pd.DataFrame(r.normal(size=(800, 3)), columns=["y", "a", "b"])
    x["a"] += x.y
    x.loc[:19] = [30.0, -30.0, 30.0]
    inside = x.loc[20:]
    got = linear.shepherd(spark.createDataFrame(x), "y", ["a", "b"])
    assert all(700 < n < 800 for _, _, n in got) and abs(got[0][0] - inside.corr("spearman").loc["y", "a"]) < 0.05 and abs(got[1][0]) < 0.15
    assert got[0][1] < 1e-6 < got[1][1]


def test_sdid_intervals(spark):
    rows = [(u, t, 0.1 * t + u + (3.0 if u == 0 and t >= 8 else 0.0)) for u in range(8) for t in range(12)]
    got = causal.sdid(spark.createDataFrame(rows, "u int, t int, y double"), "u", "t", "y", [0], 8).first()
    assert abs(got["att"] - 3) < 1e-6 and got["p_value"] < 1e-6 and got["ci_low"] <= got["att"] <= got["ci_high"]
    assert abs((got["treated_post"] - got["synthetic_post"]) - (got["treated_pre"] - got["synthetic_pre"]) - got["att"]) < 1e-9


def test_role_similarity_by_numpy(spark):
    from wfspark.plans.causal import _moves

    moves = _moves(spark, SF)
    model = careers.CareerEmbeddings.fit(moves)
    p = moves.toPandas()
    roles = sorted({*p.source, *p.target})
    m = np.zeros((len(roles),) * 2)
    for s, t, v in zip(p.source, p.target, p.p):
        m[roles.index(s), roles.index(t)] = v
    reach = sum(0.6**k * np.linalg.matrix_power(m, k) for k in range(1, 4))
    assert model.roles == roles
    scale = model.reach[model.reach > 0].mean() / reach[reach > 0].mean()
    values, vectors = np.linalg.eigh((model.reach + model.reach.T) / 2 + 0.1 * np.eye(len(roles)))
    top = np.argsort(-abs(values))[: model.vectors.shape[1]]
    v = vectors[:, top] * np.sqrt(abs(values[top]))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    assert np.allclose(model.similarity(), v @ v.T, atol=1e-6) and scale > 0


@pytest.mark.parametrize("name", sorted(synthetic.TABLES))
def test_synthetic_tables(spark, name):
    size, columns, condition = synthetic.TABLES[name]
    one, other = synthetic.synthetic(spark, name), synthetic.synthetic(spark, name, seed=7)
    df = one.toPandas()
    assert list(df.columns) == list(columns) and 0 < len(df) <= size and (condition or len(df) == size)
    assert df.drop(columns=["manager_id"], errors="ignore").notna().all().all()
    again = synthetic.synthetic(spark, name).repartition(3).toPandas()
    key = lambda f: sorted(map(str, f.itertuples(index=False)))
    assert key(df) == key(again)
    if any("U" in re.sub(r"[A-Z]{2,}", "", e) or "Z" in re.sub(r"[A-Z]{2,}", "", e) for e in columns.values()):
        assert key(df) != key(other.toPandas())


@pytest.mark.parametrize("kind", ["parquet", "orc", "csv", "json"])
def test_files_come_back(spark, points, tmp_path, kind):
    df = spark.createDataFrame(points)
    schema = "id long, a double, b double, g string"
    files.write(df, str(tmp_path / f"t.{kind}"))
    back = files.read(spark, str(tmp_path / f"t.{kind}"), schema)
    assert sorted(map(str, back.select("id", "g").collect())) == sorted(map(str, df.select("id", "g").collect())) and abs(back.agg(F.sum("a")).first()[0] - points.a.sum()) < 1e-9
    files.write(df, str(tmp_path / f"p.{kind}"), partition=["g"])
    assert files.read(spark, str(tmp_path / f"p.{kind}"), schema).where("g = 'x'").count() == (points.g == "x").sum()
    with pytest.raises(ValueError):
        files.read(spark, str(tmp_path / "t.csv"))


def test_tree_contributions_by_all_orders(spark):
    """Shapley values as means over all orders in which features become known, and interactions that add up to them."""
    r = np.random.default_rng(14)
    x = pd.DataFrame(r.integers(0, 8, (400, 3)).astype(float), columns=["a", "b", "c"])
    x["y"] = x.a * (x.b > 3) + 0.5 * x.c + r.normal(0, 0.1, 400)
    df = spark.createDataFrame(x)
    model = trees.BoostedTrees.fit(df, "y", ["a", "b", "c"], depth=3, rounds=4)
    v = x[["a", "b", "c"]].to_numpy()[:25]
    one, two = model.contributions(v)
    value = lambda s: sum(w * t.expected(v, frozenset(s)) for w, t in zip(model.weights, model.trees))
    want = np.zeros((25, 3))
    for order in itertools.permutations(range(3)):
        for k, i in enumerate(order):
            want[:, i] += (value(order[: k + 1]) - value(order[:k])) / 6
    assert np.allclose(one, want) and np.allclose(one.sum(axis=1) + value(()), model.predict(v))
    for i, j in itertools.combinations(range(3), 2):
        k = 3 - i - j
        part = sum((value((i, j, *s)) - value((i, *s)) - value((j, *s)) + value(s)) / 4 for s in ((), (k,)))
        assert np.allclose(two[:, i, j], part) and np.allclose(two, two.transpose(0, 2, 1))
    assert all(t.cover[0] == 400 and np.allclose(t.cover[t.feature >= 0], t.cover[t.left[t.feature >= 0]] + t.cover[t.right[t.feature >= 0]]) for t in model.trees)
    got = model.shap(df.limit(30).union(spark.createDataFrame([(None, 1.0, 2.0, 3.0)], df.schema))).toPandas()
    assert got.shap_a.isna().sum() == 1 and {c for c in got if c.startswith("shap_")} == {"shap_a", "shap_b", "shap_c"}
    strongest = trees.BoostedTrees.from_json(model.to_json()).interactions(df).first()
    assert (strongest["feature_a"], strongest["feature_b"]) == ("a", "b")
    every = 2 * np.abs(model.contributions(x[["a", "b", "c"]].to_numpy())[1]).mean(axis=0)[0, 1]
    assert abs(strongest["strength"] - every) < 1e-9
