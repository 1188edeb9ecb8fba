"""Seventeen sentiment signals, their combination, and the return, drawdown and trade statistics of a position series.

Signals and the equity curve are expressions of the signal language; drawdown periods and trades are islands of rows
with the same state (a running count of changes), so every statistic is one or two aggregations over (asset, run).

Defined results: days without a value keep the last one; ratios with a zero denominator are null; an asset without any
day has no row; repeated (date, asset) rows are not allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sableflow.functions import signal as s
from sableflow.functions.signal import Node, Program, stream
from sableflow.session import table

# Weights of the seventeen signals, in order.
WEIGHTS = (1.0, 1.0, 0.5, 0.5, 1.5, 1.0, 0.8, 1.2, 1.0, 0.8, 0.8, 1.2, 0.5, 0.5, 1.0, 0.8, 0.8)
DAYS, COST, CAPITAL = 252, 2.97, 50_000.0


def daily_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, asset 'ALL', close, volume, open_interest, sentiment, confidence, weighted: one row per calendar day.

    The price is the day's mean order over a level of 1000, since orders are no market: means of a few alone would move by more than all there is.
    """
    shifted = F.add_months(F.to_date("o_orderdate"), 312)
    prices = table(spark, sf_dir, "orders").groupBy(shifted.alias("date")).agg(
        (F.avg("o_totalprice") / 997.0 + 1000.0).alias("price"), F.count("*").cast("double").alias("volume"), (F.sum("o_totalprice") / 997.0).alias("oi"),
    )
    moods = table(spark, sf_dir, "sot_sugar").groupBy(F.to_date("timestamp_added").alias("date")).agg(
        F.avg("sentiment").alias("sentiment"), F.avg("confidence").alias("confidence"),
    ).withColumn("weighted", F.col("sentiment") * F.col("confidence"))
    grid = prices.agg(F.explode(F.sequence(F.min("date"), F.max("date"))).alias("date"))
    return grid.join(prices, "date", "left").join(moods, "date", "left").withColumn("asset", F.lit("ALL"))


MART_SQL = """
SELECT CAST(g.date AS DATE) AS date, 'ALL' AS asset, price, volume, oi, sentiment, confidence, weighted
FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS date FROM (SELECT CAST(CAST(o_orderdate AS DATE) + INTERVAL 312 MONTH AS DATE) AS d FROM orders)) g
LEFT JOIN (SELECT CAST(CAST(o_orderdate AS DATE) + INTERVAL 312 MONTH AS DATE) AS date, avg(o_totalprice) / 997.0 + 1000.0 AS price, CAST(count(*) AS DOUBLE) AS volume, sum(o_totalprice) / 997.0 AS oi
           FROM orders GROUP BY 1) p ON p.date = g.date
LEFT JOIN (SELECT *, sentiment * confidence AS weighted FROM (SELECT CAST(timestamp_added AS DATE) AS date, avg(sentiment) AS sentiment, avg(confidence) AS confidence FROM sot_sugar GROUP BY 1)) m ON m.date = g.date
"""


def _both(x: Node) -> Node:
    return s.ts_bfill(s.ts_ffill(x))


def streams() -> dict[str, Node]:
    return {
        "price": _both(stream("price")), "volume": _both(stream("volume")), "oi": _both(stream("oi")),
        "sentiment": _both(stream("sentiment")), "weighted": _both(stream("weighted")),
    }


def _differs(a: Node, b: Node) -> Node:
    """-1 where the signs differ; a missing sign differs from everything, itself included."""
    return s.ts_where(0.0, s.eq(s.sign(a), s.sign(b)), -1.0)


def _standard(x: Node) -> Node:
    return s.zscore(s.fill(x, 0.0), eps=1e-8)


def sentiment_signals() -> list[Node]:
    """The seventeen, in order of their weights."""
    x = streams()
    price, volume, oi, mood, weighted = x["price"], x["volume"], x["oi"], x["sentiment"], x["weighted"]
    change, ret = s.delta(mood), s.ts_pct_change(price)
    vol, rsi = s.ts_stddev(ret, 20), s.ts_rsi(price, 14)
    corr = s.correlation(mood, price, 30)
    event = s.indicator(s.absolute(change) > s.ts_stddev(change, 252)) * s.sign(change)
    flip = s.ts_delay(corr) * corr < 0.0
    bullish, calm = mood > s.full_quantile(mood, 0.7), vol < s.full_quantile(vol, 0.3)
    supply = s.ts_mean(volume, 20)
    volume_mood, volume_weighted = s.fill(s.correlation(volume, mood, 30), 0.0), s.fill(s.correlation(volume, weighted, 30), 0.0)
    return [
        event,
        s.fill(corr, 0.0),
        _differs(ret, change),
        s.fill(s.ts_where(-s.sign(s.ts_delay(corr)), flip, s.sign(corr)), 0.0),
        _standard(s.ts_delay(weighted)),
        s.fill(s.correlation(weighted, price, 30), 0.0),
        s.fill(s.correlation(mood, volume, 30), 0.0),
        s.indicator(bullish & calm) - s.indicator(~bullish & ~calm),
        _standard(s.ts_pct_change(price, 5) * mood * (rsi / 100.0)),
        volume_mood,
        volume_weighted,
        _standard(weighted * (rsi / 100.0) * s.sign(ret)),
        _standard(s.ts_mean(mood, 20) / (supply / s.full_mean(supply) + 0.1)),
        _standard(s.covariance(mood, vol, 30)),
        _differs(s.ts_mean(s.delta(mood), 5), s.ts_mean(s.delta(oi), 5)),
        _standard(mood * (1.0 / (vol + 0.001))),
        _standard(mood * s.exp(vol * -10.0)),
    ]


def combined(weights: tuple[float, ...] = WEIGHTS) -> Node:
    total = s.lift(0.0)
    for w, x in zip(weights, sentiment_signals(), strict=True):
        total = total + x * w
    return s.zscore(total, eps=1e-8)


def position(upper: float = 0.3, lower: float = -0.3) -> Node:
    x = combined()
    return s.ts_where(1.0, x > upper, s.ts_where(-1.0, x < lower, 0.0))


def curve() -> dict[str, Node]:
    """Position, net return of the day, equity and drawdown."""
    signal, price = position(), streams()["price"]
    net = s.ts_delay(signal) * s.ts_pct_change(price) - s.absolute(s.delta(signal)) * (2 * COST / CAPITAL)
    equity = s.cum_prod(1.0 + net)
    high = s.cum_max(equity)
    return {"signal": signal, "net": net, "equity": equity, "drawdown": (equity - high) / high, "held": s.ts_delay(signal)}


CURVE = Program(curve())
SIGNALS = Program({f"alpha_{i}": x for i, x in enumerate(sentiment_signals(), 1)} | {"combined": combined()})


def _runs(df: DataFrame, state: str) -> DataFrame:
    """Adds `run`: the number of the island of rows with equal state."""
    by_day = Window.partitionBy("asset").orderBy("date")
    change = F.when(F.lag(state).over(by_day).eqNullSafe(F.col(state)), 0).otherwise(1)
    return df.withColumn("change", change).withColumn("run", F.sum("change").over(by_day))


def summary(days: DataFrame) -> DataFrame:
    """days: date, asset, signal, net, equity, drawdown. Returns of the whole series per asset."""
    total = F.max_by("equity", F.when(F.col("equity").isNotNull(), F.col("date"))) - 1
    mean, std = F.avg("net"), F.stddev_samp("net")
    down = F.stddev_samp(F.when(F.col("net") < 0, F.col("net")))
    year = F.pow(1 + total, F.lit(float(DAYS)) / F.count("*")) - 1
    moves = F.sum(F.abs(F.col("signal") - F.col("before")))
    x = days.withColumn("before", F.lag("signal").over(Window.partitionBy("asset").orderBy("date")))
    return x.groupBy("asset").agg(
        F.count("*").alias("n_days"), F.round(total, 6).alias("total_return"), F.round(F.try_divide(mean, std + 1e-8) * DAYS**0.5, 6).alias("sharpe"),
        F.round(year, 6).alias("annual_return"), F.round(std * DAYS**0.5, 6).alias("annual_volatility"), F.round(F.try_divide(year, std * DAYS**0.5), 6).alias("return_to_volatility"),
        F.round(F.try_divide(year, down * DAYS**0.5), 6).alias("sortino"), F.round(F.min("drawdown"), 6).alias("max_drawdown"),
        F.round(F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))), 6).alias("mean_drawdown"), F.round(moves, 6).alias("moves"),
        F.round(F.try_divide(F.count_if(F.col("net") > 0), F.count_if(F.col("net").isNull() | (F.col("net") != 0))), 6).alias("win_rate"),
        F.round(F.avg(F.abs(F.col("signal"))), 6).alias("mean_exposure"),
    )


SUMMARY_SQL = f"""
WITH c AS ({{curve}}), d AS (SELECT *, lag(signal) OVER (PARTITION BY asset ORDER BY date) AS before FROM c),
a AS (SELECT asset, count(*) AS n_days, max_by(equity, date) FILTER (equity IS NOT NULL) - 1 AS tot, avg(net) AS m, stddev_samp(net) AS sd,
             stddev_samp(CASE WHEN net < 0 THEN net END) AS dn, min(drawdown) AS mdd, avg(CASE WHEN drawdown < 0 THEN drawdown END) AS add_, sum(abs(signal - before)) AS moves,
             count(*) FILTER (net > 0) / nullif(count(*) FILTER (net IS NULL OR net <> 0), 0) AS wr, avg(abs(signal)) AS ex FROM d GROUP BY asset)
SELECT asset, n_days, round(tot, 6) AS total_return, round(m / (sd + 1e-8) * sqrt({DAYS}), 6) AS sharpe, round(pow(1 + tot, {DAYS}.0 / n_days) - 1, 6) AS annual_return,
       round(sd * sqrt({DAYS}), 6) AS annual_volatility, round((pow(1 + tot, {DAYS}.0 / n_days) - 1) / nullif(sd * sqrt({DAYS}), 0), 6) AS return_to_volatility,
       round((pow(1 + tot, {DAYS}.0 / n_days) - 1) / nullif(dn * sqrt({DAYS}), 0), 6) AS sortino, round(mdd, 6) AS max_drawdown, round(add_, 6) AS mean_drawdown,
       round(moves, 6) AS moves, round(wr, 6) AS win_rate, round(ex, 6) AS mean_exposure FROM a
"""


def drawdown_runs(days: DataFrame, limit: float = -0.01) -> DataFrame:
    """Number, longest and mean length of the periods below the limit."""
    x = _runs(days.withColumn("below", F.coalesce(F.col("drawdown") < limit, F.lit(False))), "below").where("below")
    runs = x.groupBy("asset", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("asset").agg(F.count("*").alias("periods"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean_days"))


DRAWDOWN_SQL = """
WITH c AS ({curve}), b AS (SELECT *, coalesce(drawdown < -0.01, false) AS below FROM c),
k AS (SELECT *, CASE WHEN lag(below) OVER (PARTITION BY asset ORDER BY date) IS NOT DISTINCT FROM below THEN 0 ELSE 1 END AS change FROM b),
r AS (SELECT *, sum(change) OVER (PARTITION BY asset ORDER BY date) AS run FROM k),
n AS (SELECT asset, run, count(*) AS n FROM r WHERE below GROUP BY ALL)
SELECT asset, count(*) AS periods, max(n) AS longest, round(avg(n), 6) AS mean_days FROM n GROUP BY asset
"""


def trades(days: DataFrame) -> DataFrame:
    """One row per run of a constant position other than 0: first and last day, side, length, sum of net returns."""
    x = _runs(days.withColumn("side", F.coalesce("held", F.lit(0.0))), "side").where("side != 0")
    return x.groupBy("asset", "run", "side").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count("*").alias("n_days"), F.round(F.sum("net"), 6).alias("pnl")).drop("run")


TRADES_SQL = """
WITH c AS ({curve}), b AS (SELECT *, coalesce(held, 0.0) AS side FROM c),
k AS (SELECT *, CASE WHEN lag(side) OVER (PARTITION BY asset ORDER BY date) IS NOT DISTINCT FROM side THEN 0 ELSE 1 END AS change FROM b),
r AS (SELECT *, sum(change) OVER (PARTITION BY asset ORDER BY date) AS run FROM k)
SELECT asset, side, min(date) AS first_day, max(date) AS last_day, count(*) AS n_days, round(sum(net), 6) AS pnl FROM r WHERE side <> 0 GROUP BY asset, run, side
"""


def trade_statistics(trade_rows: DataFrame) -> DataFrame:
    """Win rate, mean win and loss, expectancy, profit factor (999 without losses) and holding periods per asset."""
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    wins, losses = F.sum(F.when(win, F.col("pnl"))), -F.sum(F.when(loss, F.col("pnl")))

    def side(value: float) -> tuple:
        n = F.when(F.col("side") == value, F.col("n_days"))
        return F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6), F.round(F.coalesce(F.stddev_pop(n), F.lit(0.0)), 6)

    (long_mean, long_std), (short_mean, short_std) = side(1.0), side(-1.0)
    return trade_rows.groupBy("asset").agg(
        F.count("*").alias("n_trades"), F.round(F.try_divide(F.count_if(win), F.count("*")), 6).alias("win_rate"), F.round(F.avg(F.when(win, F.col("pnl"))), 6).alias("mean_win"),
        F.round(F.avg(F.when(loss, F.col("pnl"))), 6).alias("mean_loss"), F.round(F.avg("pnl"), 6).alias("expectancy"),
        F.round(F.coalesce(F.try_divide(wins, losses), F.lit(999.0)), 6).alias("profit_factor"),
        long_mean.alias("long_days"), long_std.alias("long_days_std"), short_mean.alias("short_days"), short_std.alias("short_days_std"),
    )


TRADE_STATISTICS_SQL = f"""
WITH t AS ({TRADES_SQL})
SELECT asset, count(*) AS n_trades, round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate, round(avg(pnl) FILTER (pnl > 0), 6) AS mean_win,
       round(avg(pnl) FILTER (pnl < 0), 6) AS mean_loss, round(avg(pnl), 6) AS expectancy,
       round(coalesce(sum(pnl) FILTER (pnl > 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0), 999.0), 6) AS profit_factor,
       round(coalesce(avg(n_days) FILTER (side = 1), 0.0), 6) AS long_days, round(coalesce(stddev_pop(n_days) FILTER (side = 1), 0.0), 6) AS long_days_std,
       round(coalesce(avg(n_days) FILTER (side = -1), 0.0), 6) AS short_days, round(coalesce(stddev_pop(n_days) FILTER (side = -1), 0.0), 6) AS short_days_std
FROM t GROUP BY asset
"""


def information_coefficient(days: DataFrame) -> DataFrame:
    """Correlation of the position with the next day's net return, null without variance."""
    x = days.withColumn("next", F.lead("net").over(Window.partitionBy("asset").orderBy("date"))).where("signal is not null and next is not null")
    ic = F.try_divide(F.covar_samp("signal", "next"), F.stddev_samp("signal") * F.stddev_samp("next"))
    return x.groupBy("asset").agg(F.round(ic, 6).alias("ic"))


IC_SQL = """
WITH c AS ({curve}), n AS (SELECT *, lead(net) OVER (PARTITION BY asset ORDER BY date) AS nxt FROM c)
SELECT asset, round(covar_samp(signal, nxt) / nullif(stddev_samp(signal) * stddev_samp(nxt), 0), 6) AS ic FROM n WHERE signal IS NOT NULL AND nxt IS NOT NULL GROUP BY asset
"""


def score(sharpe: float, max_drawdown: float) -> float:
    """Sharpe ratio less half the drawdown; never above -0.5 where the ratio is under 0.5."""
    out = sharpe - 0.5 * abs(max_drawdown)
    return min(out, -0.5) if sharpe < 0.5 else out
