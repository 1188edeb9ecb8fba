"""Queries of the sentiment signals and their backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableflow.operators import backtest as b

_CURVE_SQL = b.CURVE.sql(b.MART_SQL, 10)


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.CURVE.run(b.daily_mart(spark, sf_dir), 10)


def daily_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = b.daily_mart(spark, sf_dir)
    return x.select("date", "asset", *(F.round(c, 6).alias(c) for c in ("price", "volume", "oi", "sentiment", "confidence", "weighted")))


QUERIES = {
    "backtest_mart": daily_mart,
    "backtest_signals": lambda spark, d: b.SIGNALS.run(b.daily_mart(spark, d), 6),
    "backtest_curve": lambda spark, d: b.CURVE.run(b.daily_mart(spark, d), 6),
    "backtest_summary": lambda spark, d: b.summary(_curve(spark, d)),
    "backtest_drawdowns": lambda spark, d: b.drawdown_runs(_curve(spark, d)),
    "backtest_trades": lambda spark, d: b.trades(_curve(spark, d)),
    "backtest_trade_statistics": lambda spark, d: b.trade_statistics(b.trades(_curve(spark, d))),
    "backtest_ic": lambda spark, d: b.information_coefficient(_curve(spark, d)),
}
ORACLE = {
    "backtest_mart": f"SELECT date, asset, {', '.join(f'round({c}, 6) AS {c}' for c in ('price', 'volume', 'oi', 'sentiment', 'confidence', 'weighted'))} FROM ({b.MART_SQL})",
    "backtest_signals": b.SIGNALS.sql(b.MART_SQL, 6),
    "backtest_curve": b.CURVE.sql(b.MART_SQL, 6),
    "backtest_summary": b.SUMMARY_SQL.format(curve=_CURVE_SQL),
    "backtest_drawdowns": b.DRAWDOWN_SQL.format(curve=_CURVE_SQL),
    "backtest_trades": b.TRADES_SQL.format(curve=_CURVE_SQL),
    "backtest_trade_statistics": b.TRADE_STATISTICS_SQL.format(curve=_CURVE_SQL),
    "backtest_ic": b.IC_SQL.format(curve=_CURVE_SQL),
}
