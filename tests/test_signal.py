import numpy as np
import pandas as pd
import pytest

from sableflow.functions import signal as s
from sableflow.functions.signal import Program, stream
from sableflow.operators.families import registry

X, Y = stream("x"), stream("y")


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    days = pd.date_range("2024-01-01", periods=40)
    parts = []
    for a in "ab":
        x = rng.normal(100, 10, 40).round(1)
        x[[3, 4, 17]] = np.nan
        x[20:26] = 7.0  # no variance
        parts.append(pd.DataFrame({"date": days.date, "asset": a, "x": x, "y": rng.normal(0, 1, 40)}))
    return pd.concat(parts, ignore_index=True)


def run(spark, frame, node, **kw):
    df = spark.createDataFrame(frame.replace({np.nan: None}).astype(object).where(frame.notna(), None).to_dict("records"), "date date, asset string, x double, y double")
    out = Program({"v": node}).run(df, None, **kw).toPandas().sort_values(["asset", "date"])
    return out["v"].astype(float).to_numpy()


def per_asset(frame, f):
    return np.concatenate([np.asarray(f(g), float) for _, g in frame.groupby("asset")])


CASES = {
    "mean": (s.ts_mean(X, 5), lambda g: g.x.rolling(5).mean()),
    "any_mean": (s.ts_any_mean(X, 5), lambda g: g.x.rolling(5, min_periods=1).mean()),
    "sum": (s.ts_sum(Y, 4), lambda g: g.y.rolling(4).sum()),
    "std": (s.ts_stddev(X, 5), lambda g: g.x.rolling(5).std()),
    "min": (s.ts_min(X, 3), lambda g: g.x.rolling(3).min()),
    "max": (s.ts_max(X, 3), lambda g: g.x.rolling(3).max()),
    "skew": (s.ts_skew(Y, 8), lambda g: g.y.rolling(8).skew()),
    "rank": (s.ts_rank(X, 4), lambda g: g.x.rolling(4).rank(pct=True)),
    "cov": (s.covariance(Y, Y + 1.0, 6), lambda g: g.y.rolling(6).var()),
    "corr": (s.correlation(Y, s.ts_delay(Y), 6), lambda g: g.y.rolling(6).corr(g.y.shift(1))),
    "delta": (s.delta(X, 2), lambda g: g.x.diff(2)),
    "pct": (s.ts_pct_change(X), lambda g: g.x / g.x.shift(1) - 1),
    "delay": (s.ts_delay(X, 3), lambda g: g.x.shift(3)),
    "ffill": (s.ts_ffill(X), lambda g: g.x.ffill()),
    "ffill_n": (s.ts_ffill(X, 1), lambda g: g.x.ffill(limit=1)),
    "bfill": (s.ts_bfill(X), lambda g: g.x.bfill()),
    "ewm": (s.ts_ewm(X, 5), lambda g: g.x.ewm(span=5).mean()),
    "halflife": (s.smooth_data(Y, 3), lambda g: g.y.ewm(halflife=3).mean()),
    "ewm_std": (s.ewm_std(Y, 4), lambda g: g.y.ewm(halflife=4).std()),
    "cumprod": (s.cum_prod(1.0 + Y / 100.0), lambda g: (1 + g.y / 100).cumprod()),
    "cummax": (s.cum_max(Y), lambda g: g.y.cummax()),
    "zscore": (s.zscore(Y, 10), lambda g: (g.y - g.y.rolling(10).mean()) / g.y.rolling(10).std()),
    "history": (s.zscore(Y), lambda g: (g.y - g.y.mean()) / g.y.std()),
    "quantile": (s.full_quantile(Y, 0.7), lambda g: pd.Series(g.y.quantile(0.7), g.index)),
    "winsorize": (s.winsorize(Y, 0.1), lambda g: g.y.clip(g.y.quantile(0.1), g.y.quantile(0.9))),
    "where": (s.ts_where(X, X > 100.0, 0.0), lambda g: g.x.where(g.x > 100, 0.0)),
    "clip": (s.ts_clip(X, 90.0, 105.0), lambda g: g.x.clip(90, 105)),
    "decay": (s.ts_decay_exp_window(Y, 3, 0.5), lambda g: g.y.rolling(3).apply(lambda w: (w[2] + w[1] / 2 + w[0] / 4) / 1.75, raw=True)),
    "sign": (s.sign(Y), lambda g: np.sign(g.y)),
    "log": (s.ts_log10(Y), lambda g: np.log10(g.y.where(g.y > 0))),
}


@pytest.mark.parametrize("name", CASES)
def test_against_pandas(spark, frame, name):
    node, want = CASES[name]
    np.testing.assert_allclose(run(spark, frame, node), per_asset(frame, want), rtol=1e-9, atol=1e-9)


def test_flat_windows_have_no_correlation(spark, frame):
    v = run(spark, frame, s.correlation(X, Y, 5))
    assert np.isnan(v[24]) and not np.isnan(v[34])


def test_division_by_zero_is_null(spark, frame):
    assert np.isnan(run(spark, frame, s.safe_div(Y, Y - Y))).all()


def test_cross_section(spark, frame):
    v = run(spark, frame, s.rank(Y)).reshape(2, -1)
    assert set(v.ravel()) == {0.5, 1.0}
    np.testing.assert_allclose(run(spark, frame, s.neutralise(Y)).reshape(2, -1).sum(axis=0), 0, atol=1e-9)
    np.testing.assert_allclose(np.abs(run(spark, frame, s.scale(Y)).reshape(2, -1)).sum(axis=0), 1, atol=1e-9)
    y = frame.y.to_numpy().reshape(2, -1)
    np.testing.assert_allclose(run(spark, frame, s.others_mean(Y)).reshape(2, -1), y[::-1])


@pytest.mark.parametrize("node", [s.ts_mean(s.ts_stddev(X, 5), 4), s.ts_ewm(Y, 3), s.neutralise(s.delta(Y, 3))])
def test_chunks_of_time_change_nothing(spark, frame, node):
    if node.op == "ewm":
        np.testing.assert_allclose(run(spark, frame, node, chunk_rows=10), run(spark, frame, node), rtol=1e-9)
    else:
        np.testing.assert_allclose(run(spark, frame, node, chunk_rows=10), run(spark, frame, node))


def test_full_history_refuses_chunks(spark, frame):
    with pytest.raises(ValueError):
        run(spark, frame, s.zscore(Y), chunk_rows=10)


def test_shared_nodes_are_one_column():
    m = s.ts_mean(X, 5)
    p = Program({"a": m - X, "b": m * 2.0, "c": s.ts_mean(s.ts_mean(X, 5), 3)})
    assert sum(n.op == "mean" for n in p.names) == 2


def test_one_exchange_for_all_frames(spark, frame):
    df = spark.createDataFrame([], "date date, asset string, x double, y double")
    out = Program({"a": s.ts_mean(s.ts_stddev(X, 5), 4), "b": s.correlation(X, Y, 9), "c": s.ts_rsi(X)}).run(df)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


def test_registry_has_hundreds_of_signals():
    r = registry()
    assert len(r) > 200 and len(set(r.values())) > 0.9 * len(r)
