"""Queries over panels: one per operator of the signal language, one per family of signals, and the backtest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sableflow.functions import signal as s
from sableflow.functions.signal import Program, stream
from sableflow.operators.families import FAMILIES
from sableflow.operators.panel import PANEL_SQL, metals_panel

close, high, low, open_, volume, oi = (stream(x) for x in ("close_price", "high_price", "low_price", "open_price", "volume", "open_interest"))
filled = s.ts_ffill(close)
gdp = s.ts_ffill(stream("us_gdp"))
vix = s.ts_ffill(stream("us_vix"))

#: One program per operator of the language; each output is one way of calling it.
OPERATORS: dict[str, dict[str, s.Node]] = {
    "ts_mean": {"m5": s.ts_mean(filled, 5), "m21": s.ts_mean(filled), "raw5": s.ts_mean(close, 5), "any5": s.ts_any_mean(close, 5)},
    "ts_ffill": {"all_days": filled, "five_days": s.ts_ffill(close, 5), "back": s.ts_bfill(close), "both": s.ts_bfill(s.ts_ffill(close))},
    "ts_where": {"kept": s.ts_where(filled, filled > gdp, 0.0), "on_null": s.ts_where(volume, close > gdp, -1.0), "both": s.indicator((filled > gdp) & (vix > 10.0)), "either": s.indicator((close > 200.0) | ~(volume > 1.0))},
    "zscore": {"rolling": s.zscore(filled, 21), "history": s.zscore(filled), "guarded": s.zscore(filled, eps=1e-8)},
    "correlation": {"c21": s.correlation(filled, s.ts_ffill(volume)), "c63": s.correlation(filled, vix, 63), "raw": s.correlation(close, volume, 5)},
    "covariance": {"c21": s.covariance(filled, s.ts_ffill(volume)), "c10": s.covariance(filled, vix, 10)},
    "delta": {"d1": s.delta(filled), "d5": s.delta(close, 5)},
    "ts_pct_change": {"p1": s.ts_pct_change(filled), "p5": s.ts_pct_change(close, 5)},
    "safe_div": {"ratio": s.safe_div(filled, volume), "by_zero": s.safe_div(filled, filled - filled)},
    "ts_delay": {"d1": s.ts_delay(close), "d21": s.ts_delay(filled, 21), "d0": s.ts_delay(close, 0)},
    "ts_rsi": {"r14": s.ts_rsi(filled), "r5": s.ts_rsi(filled, 5)},
    "ts_rank": {"r10": s.ts_rank(filled, 10), "ties": s.ts_rank(s.ts_ffill(volume), 21)},
    "ts_stddev": {"s21": s.ts_stddev(filled, 21), "s5": s.ts_stddev(close, 5)},
    "ts_ewm": {"e12": s.ts_ewm(filled, 12), "e5_gaps": s.ts_ewm(close, 5)},
    "ts_decay_exp_window": {"d10": s.ts_decay_exp_window(filled, 10, 0.9), "d5": s.ts_decay_exp_window(close, 5, 0.5)},
    "ts_clip": {"both": s.ts_clip(close, 100.0, 300.0), "low": s.ts_clip(close, lo=150.0), "high": s.ts_clip(close, hi=150.0)},
    "ts_log10": {"l10": s.ts_log10(close), "l2": s.log(close, 2.0), "ln": s.ln(close - 200.0)},
    "ts_pow": {"square": s.ts_pow(close, 2.0), "root": s.ts_pow(close, 0.5)},
    "ts_minmax": {"max21": s.ts_max(filled, 21), "min21": s.ts_min(filled, 21), "max5": s.ts_max(close, 5)},
    "ts_sum": {"s21": s.ts_sum(filled), "s5": s.ts_sum(close, 5)},
    "ts_skew": {"k21": s.ts_skew(s.ts_pct_change(filled), 21)},
    "rank": {"pct": s.rank(close), "ties": s.rank(volume)},
    "scale": {"scaled": s.scale(close - 150.0)},
    "neutralise": {"market": s.neutralise(close), "others": s.others_mean(close), "extremes": s.keep_extremes(close)},
    "winsorize": {"w5": s.winsorize(close, 0.05)},
    "smooth_data": {"h10": s.smooth_data(filled, 10)},
    "compute_z_score": {"z": s.compute_z_score(s.ts_pct_change(filled), 10, 20), "uncentred": s.compute_z_score(s.ts_pct_change(filled), 10, 20, False, 2.0)},
    "moving_average_crossover": {"x": s.moving_average_crossover(s.ts_pct_change(filled), 5, 21)},
    "volatility_regime": {"r": s.volatility_regime(s.ts_pct_change(filled), 21, 10, 0.5, 0.25)},
    "sign_exp_abs": {"sign": s.sign(s.delta(filled)), "exp": s.exp(-(volume / 10.0)), "abs": s.absolute(s.delta(filled))},
    "cumulative": {"product": s.cum_prod(1.0 + s.ts_pct_change(filled) / 1000.0), "high": s.cum_max(close), "total": s.cum_sum(volume)},
    "full_quantile": {"q7": s.full_quantile(close, 0.7), "mask": s.indicator(close > s.full_quantile(close, 0.7))},
}


def _query(program: Program) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: program.run(metals_panel(spark, sf_dir))


_PROGRAMS = {f"op_{k}": Program(v) for k, v in OPERATORS.items()} | {f"family_{k}": Program(v) for k, v in FAMILIES.items()}
QUERIES = {k: _query(p) for k, p in _PROGRAMS.items()}
ORACLE = {k: p.sql(PANEL_SQL) for k, p in _PROGRAMS.items()}

# SQL of composites written by hand, not by the compiler that also makes their plan
_FILLED = f"""WITH p AS ({PANEL_SQL}),
f AS (SELECT date, asset, last_value(close_price IGNORE NULLS) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) AS c FROM p),
g AS (SELECT *, c - lag(c) OVER (PARTITION BY asset ORDER BY date) AS d, c / nullif(lag(c) OVER (PARTITION BY asset ORDER BY date), 0) - 1 AS r FROM f)"""


def _rsi_sql(n: int) -> str:
    w = f"OVER (PARTITION BY asset ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"""SELECT date, asset, CASE WHEN rows = {n} THEN CASE WHEN round(loss, 9) = 0 THEN CASE WHEN round(gain, 9) > 0 THEN 100.0 END ELSE 100 - 100 / (1 + gain / loss) END END AS r{n}
FROM (SELECT date, asset, count(*) {w} AS rows, avg(CASE WHEN round(d, 9) > 0 THEN d ELSE 0 END) {w} AS gain, avg(CASE WHEN round(d, 9) < 0 THEN -d ELSE 0 END) {w} AS loss FROM g)"""


_ALL = "OVER (PARTITION BY asset)"


def _full(value: str, n: int, of: str = "x") -> str:
    """An aggregate over n rows that all have a value."""
    w = f"OVER (PARTITION BY asset ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({of}) {w} = {n} THEN {value}({of}) {w} END"


BY_HAND = {
    "op_ts_rsi": f"{_FILLED}, a AS ({_rsi_sql(14)}), b AS ({_rsi_sql(5)}) SELECT date, asset, round(r14, 5) + 0.0 AS r14, round(r5, 5) + 0.0 AS r5 FROM a JOIN b USING (date, asset)",
    "op_zscore": f"""{_FILLED}, z AS (SELECT date, asset, c, {_full('avg', 21, 'c')} AS m, {_full('stddev_samp', 21, 'c')} AS s, avg(c) {_ALL} AS am, stddev_samp(c) {_ALL} AS sd FROM f)
SELECT date, asset, round((c - m) / nullif(s, 0), 5) + 0.0 AS rolling, round((c - am) / nullif(sd, 0), 5) + 0.0 AS history, round((c - am) / (sd + 1e-8), 5) + 0.0 AS guarded FROM z""",
    "op_moving_average_crossover": f"{_FILLED} SELECT date, asset, round({_full('avg', 5, 'r')} - {_full('avg', 21, 'r')}, 5) + 0.0 AS x FROM g",
    "op_volatility_regime": f"""{_FILLED}, v AS (SELECT date, asset, {_full('stddev_samp', 21, 'r')} AS x FROM g), a AS (SELECT date, asset, {_full('avg', 10)} AS x FROM v),
z AS (SELECT date, asset, (x - {_full('avg', s.QUARTER)}) / nullif({_full('stddev_samp', s.QUARTER)}, 0) AS z FROM a)
SELECT date, asset, CASE WHEN round(z, 9) < 0.5 THEN 1.0 ELSE 0.25 END::DOUBLE AS r FROM z""",
}
ORACLE |= BY_HAND
