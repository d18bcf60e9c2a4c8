import numpy as np
import pytest

from tests.conftest import SF
from tests.same import rows
from wfspark import catalogue


def close(a, b):
    try:
        return abs(float(a) - float(b)) < 2e-4
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or close(u, v) for u, v in zip(x, y)), (x, y)


def probability(x):
    return x.between(0, 1).all()


def finite(df, *columns):
    return all(np.isfinite(df[c].dropna()).all() and df[c].notna().any() for c in columns)


def one_each(duck, sql, column):
    return sorted(duck.execute(sql).df().iloc[:, 0]) == sorted(column)


ORDERS, PARTS, PANEL_ROWS = "SELECT o_orderkey FROM orders", "SELECT p_partkey FROM part", "SELECT count(*) FROM (SELECT DISTINCT o_orderpriority, date_trunc('month', o_orderdate) FROM orders)"


def whole_panel(df, duck):
    return len(df) == duck.execute(PANEL_ROWS).fetchone()[0]


def correlation(df):
    m = df.pivot(index="role_a", columns="role_b", values="similarity").to_numpy()
    return np.allclose(m, m.T) and np.allclose(np.diag(m), 1) and (np.abs(m) <= 1 + 1e-9).all()


#: What must hold for each query that has no SQL: all rows are there, and the results are what they claim to be.
HOLDS = {
    "aipw": lambda df, duck: df.n[0] == len(duck.execute(ORDERS).df()) and df.ci_low[0] < df.ate[0] < df.ci_high[0] and abs(df.z[0] - df.ate[0] / df.se[0]) < 1e-9 and probability(df.p_value),
    "dr_uplift": lambda df, duck: df.dr_mse[0] > 0,
    "causal_forest": lambda df, duck: one_each(duck, ORDERS, df.o_orderkey) and (df.ci_low <= df.effect).all() and (df.effect <= df.ci_high).all() and df.effect.nunique() > 5,
    "forest_importances": lambda df, duck: sorted(df.feature) == ["x", "z"] and abs(df.importance.sum() - 1) < 1e-9,
    "persuadables": lambda df, duck: df.n.sum() == len(duck.execute(ORDERS).df()) and df.archetype.is_unique,
    "fair_classifier": lambda df, duck: one_each(duck, ORDERS, df.o_orderkey) and probability(df.probability) and ((df.probability >= 0.5) == (df.predicted == 1)).all(),
    "fair_classifier_odds": lambda df, duck: one_each(duck, ORDERS, df.o_orderkey) and probability(df.probability),
    "sdid": lambda df, duck: len(df) == 1 and abs((df.treated_post - df.synthetic_post - df.treated_pre + df.synthetic_pre - df.att)[0]) < 1e-9,
    "synthetic_control": lambda df, duck: np.allclose(df.actual - df.synthetic, df["lift"], atol=2e-3) and df.groupby("unit").time.nunique().nunique() == 1,
    "shap_inflection": lambda df, duck: set(df.kind) <= {"zero_crossing", "steepest"} and finite(df, "threshold"),
    "shap_interactions": lambda df, duck: len(df) == 3 and (df.strength >= 0).all(),
    "role_similarity": lambda df, duck: correlation(df),
    "succession_topk": lambda df, duck: len(df) == 10 and df.score.is_monotonic_decreasing and (df.role != "purchase").all(),
    "ctmc_simulation": lambda df, duck: df.path.nunique() == 100 and all(p.sort_values("step").entered.is_monotonic_increasing for _, p in df.groupby("path")) and (df[df.step == 0].state == "view").all(),
    "attention_pool": lambda df, duck: df.n_tokens.sum() == duck.execute("SELECT count(*) FROM embeddings").fetchone()[0] and all(len(v) == 64 for v in df.pooled),
    "double_smoothing": lambda df, duck: whole_panel(df, duck) and np.allclose(df.price - df.fitted, df.residual),
    "ssa_baseline": lambda df, duck: whole_panel(df, duck) and np.allclose(df.price - df.baseline, df.residual) and (df.groupby("grp").residual.var() < df.groupby("grp").price.var()).all(),
    "garch_volatility": lambda df, duck: whole_panel(df, duck) and (df.volatility > 0).all(),
    "garch_forecast": lambda df, duck: (df.groupby("grp").size() == 3).all() and np.allclose(df.variance, df.volatility**2) and (df.persistence < 1).all(),
    "rolling_garch": lambda df, duck: whole_panel(df, duck) and df.groupby("grp").volatility.apply(lambda v: v.isna().sum() == 35).all(),
    "hmm_regimes": lambda df, duck: whole_panel(df, duck) and df.probability.between(1 / 3 - 1e-9, 1).all() and all(p.groupby("regime").regime_mean.first().is_monotonic_increasing for _, p in df.groupby("grp")),
    "hmm_profile": lambda df, duck: np.allclose(df.groupby("grp").prevalence_pct.sum(), 100) and (df.std_price > 0).all(),
    "fractional_scan": lambda df, duck: probability(df.p_value) and np.allclose(df[df.d == 0].correlation, 1) and (df.groupby("grp").is_optimal.sum() <= 1).all(),
    "hawkes_fit": lambda df, duck: (df.branching_ratio.dropna() < 1).all() and np.allclose(df.branching_ratio.dropna(), (df.alpha / df.beta).dropna()),
    "pca_reconstruction": lambda df, duck: one_each(duck, "SELECT vec_id FROM embeddings", df.vec_id) and (df.error >= 0).all() and 0 < df.is_anomalous.mean() <= 0.06,
    "autoencoder": lambda df, duck: one_each(duck, PARTS, df.p_partkey) and (df.error >= 0).all() and 0 < df.is_anomalous.mean() <= 0.06,
    "causal_effects": lambda df, duck: abs(df.set_index(["cause", "effect"]).total["a", "c"] - df.set_index(["cause", "effect"]).direct["a", "b"] * df.set_index(["cause", "effect"]).direct["b", "c"]) < 1e-9,
    "corr_table_shepherd": lambda df, duck: len(df) == 3 and df.r.between(-1, 1).all() and probability(df.p) and probability(df.power),
    "mahalanobis_robust": lambda df, duck: one_each(duck, "SELECT s_suppkey FROM supplier", df.s_suppkey) and probability(df.p_value) and ((df.p_value < 0.05) == df.is_outlier).all(),
    "metapath_walks": lambda df, duck: all(len(n) >= 3 and all(x[0] == "sn"[k % 2] for k, x in enumerate(n)) for n in df.nodes),
    "metapath2vec": lambda df, duck: all(abs(np.linalg.norm(v) - 1) < 1e-9 or not any(v) for v in df.vector) and len(df) == duck.execute("SELECT (SELECT count(*) FROM supplier) + (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)) + 30").fetchone()[0],
    "tree_interactions": lambda df, duck: len(df) == 3 and df.strength.is_monotonic_decreasing and {df.feature_a[0], df.feature_b[0]} == {"l_quantity", "l_discount"},
    "tree_thresholds": lambda df, duck: df.feature.tolist() == ["l_quantity", "l_discount"] and 15 < df.primary_threshold[0] < 35 and df.high_value_adds[0],
    "similar_nodes": lambda df, duck: len(df) <= 5 and df.cosine.is_monotonic_decreasing and (df.node_type == "s").all() and "s2" not in set(df.node),
}


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_holds(spark, duck, name):
    # the smallest tables have no nation with orders in every quarter
    found = catalogue.QUERIES[name](spark, SF.replace("0.001", "0.01") if name in ("sdid", "synthetic_control") else SF).toPandas()
    assert len(found) and HOLDS[name](found, duck)
