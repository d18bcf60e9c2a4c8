import numpy as np
import pandas as pd
import pytest

from wfspark.functions import pay, scores
from wfspark.operators import anomalies, careers, causal, linear, series


def test_pay_band_edges(spark):
    df = spark.createDataFrame([(75.0,), (95.0,), (110.0,), (135.0,), (None,)], "s double")
    got = df.select(pay.compa_ratio("s", band_min=80, band_max=120), pay.pay_band_status("s", 80, 120), pay.red_circled("s", 120), pay.green_circled("s", 80)).collect()
    assert [r[0] for r in got] == [0.75, 0.95, 1.1, 1.35, None]
    assert [r[1] for r in got] == ["Green-Circled (<Min)", "Q2: Core Proficient (25-50%)", "Q4: Senior Cap (75-100%)", "Red-Circled (>Max)", "Unknown"]
    assert [r[2] for r in got] == [False, False, False, True, False]
    assert [r[3] for r in got] == [True, False, False, False, False]


def test_band_that_ends_below_its_start_raises(spark):
    with pytest.raises(Exception, match="band_min"):
        spark.range(1).select(pay.band_midpoint(2.0, 1.0)).collect()


def test_fractional_weights():
    assert scores.fractional_weights(0, 5) == [1.0]
    assert scores.fractional_weights(1, 5) == [1.0, -1.0]
    assert np.allclose(scores.fractional_weights(0.5, 4, 1e-9), [1, -0.5, -0.125, -0.0625])


def test_ewma_as_pandas_does_with_gaps():
    x = np.array([1.0, np.nan, 3.0, 2.0, np.nan, np.nan, 5.0])
    assert np.allclose(series.ewma_kernel(x, 0.5), pd.Series(x).ewm(alpha=0.5, adjust=False).mean())


def test_ssa_keeps_a_sine():
    x = np.sin(np.arange(60) / 3)
    assert np.allclose(series.ssa_kernel(x, 20, 2), x, atol=1e-8)


def test_smoothing_follows_a_line():
    out = series.smoothing_kernel(np.arange(30.0), 0.5, 0.5, horizon=3)
    assert np.allclose(out["fit"][2:], np.arange(30.0)[2:], atol=1e-6) and np.allclose(out["forecast"], [30, 31, 32])


def test_hmm_finds_two_levels():
    r = np.random.default_rng(1)
    truth = np.repeat([0, 1, 0, 1], 50)
    mu, _, post = series.hmm_kernel(truth * 5 + r.normal(0, 0.5, 200), 2)
    assert np.allclose(mu, [0, 5], atol=0.3) and (post.argmax(axis=1) == truth).mean() > 0.98


def test_hawkes_recursion_equals_double_sum():
    t = np.array([0.0, 0.5, 0.7, 2.0])
    want = [sum(np.exp(-1.3 * (a - b)) for b in t if b < a) for a in t]
    assert np.allclose(series.Hawkes(0.2, 0.5, 1.3).excitement(t), want)


def brute_dtw(a, b):
    t = np.full((len(a) + 1, len(b) + 1), np.inf)
    t[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = abs(a[i] - b[j]) + min(t[i, j], t[i, j + 1], t[i + 1, j])
    return t


def test_alignment_tables():
    r = np.random.default_rng(2)
    for _ in range(20):
        a, b = r.normal(size=r.integers(1, 9)), r.normal(size=r.integers(1, 9))
        assert np.allclose(anomalies.dtw_table(a, b)[1:, 1:], brute_dtw(a, b)[1:, 1:])
    path = anomalies.dtw_path(anomalies.dtw_table(np.arange(4.0), np.arange(4.0)))
    assert path == [(k, k) for k in range(4)]


def test_special_functions():
    assert abs(linear.gammainc(1, 2) - (1 - np.exp(-2))) < 1e-12
    assert abs(linear.gammainc(0.5, 50) - 1) < 1e-12
    assert abs(linear.betainc(2, 3, 0.4) - 0.5248) < 1e-9
    assert np.allclose(linear._expm(np.array([[0.0, 1.0], [-1.0, 0.0]])), [[np.cos(1), np.sin(1)], [-np.sin(1), np.cos(1)]])


def test_simplex_weights_find_the_mixture():
    r = np.random.default_rng(3)
    a = r.normal(size=(40, 5))
    w, level = causal.simplex_weights(a, a @ [0.2, 0.0, 0.5, 0.3, 0.0] + 7, l2=0.0)
    assert np.allclose(w, [0.2, 0, 0.5, 0.3, 0], atol=1e-4) and abs(level - 7) < 1e-3


def test_markov_chain_rows_sum_to_one():
    m = careers.MarkovChain(["a", "b"], np.array([[-1.0, 1.0], [0.5, -0.5]]))
    assert np.allclose(m.transition(3.0).sum(axis=1), 1) and np.allclose(m.stationary(), [1 / 3, 2 / 3])


def test_notears_recovers_a_chain(spark):
    r = np.random.default_rng(4)
    a = r.normal(size=3000)
    b = 1.2 * a + r.normal(size=3000)
    c = -0.9 * b + r.normal(size=3000)
    got = {(x.cause, x.effect) for x in linear.notears(spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": c})), ["a", "b", "c"]).collect()}
    assert got == {("a", "b"), ("b", "c")}


def test_streamed_decay_equals_batch(spark, tmp_path):
    from wfspark.streaming.operators import decayed_sum, run_available

    rows = pd.DataFrame({"k": [1, 1, 2, 1], "t": [0.0, 1.0, 1.0, 3.0], "v": [1.0, 2.0, 5.0, 1.0]})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = run_available(decayed_sum(spark.readStream.schema("k long, t double, v double").parquet(str(tmp_path / "in")), "k", "t", "v", 1.0), "update")
    assert {r.k: round(r.total, 9) for r in out.collect()} == {1: round(1 / 8 + 2 / 4 + 1, 9), 2: 5.0}
