"""Date x asset panels made from the star schema's orders and line items.

The grid is dense: every asset has a row for each day between its first and last, made by a sequence per asset. Line
items join their orders on the key both tables are usually bucketed by; both sides are aggregated before the streams
meet on (date, asset). Macro streams live on the first day of a month only and have the same value for every asset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableflow.session import table

UNIT = 997.0  # prime, so that means of a few two-digit prices never end on half a unit of the rounding
ORDER_STREAMS = ["close_price", "high_price", "low_price", "open_price", "volume", "open_interest"]
ITEM_STREAMS = ["stock_in", "stock_out", "on_warrant", "cancelled_stock", "closing_stock"]
MACRO_STREAMS = ["us_gdp", "cn_gdp", "us_pmi", "us_vix", "fx_cny"]


def metals_panel(spark: SparkSession, sf_dir: str, items: bool = True) -> DataFrame:
    """date, asset and the streams, as doubles; null where a day has no orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("asset"), "o_totalprice")
    price = F.col("o_totalprice") / UNIT
    daily = orders.groupBy("date", "asset").agg(
        F.avg(price).alias("close_price"), F.max(price).alias("high_price"), F.min(price).alias("low_price"),
        F.percentile(price, F.lit(0.5)).alias("open_price"), F.count("*").cast("double").alias("volume"), F.sum(price).alias("open_interest"),
    )
    ends = orders.groupBy("asset").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    grid = ends.select("asset", F.explode(F.expr("sequence(first_day, last_day)")).alias("date"))
    out = grid.join(daily, ["date", "asset"], "left")
    if items:
        lines = table(spark, sf_dir, "lineitem")
        flows = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "date", "asset"), "l_orderkey").groupBy("date", "asset").agg(
            (F.sum("l_quantity") / 100).alias("stock_in"), (F.sum(F.col("l_extendedprice") * F.col("l_discount")) / 10000).alias("stock_out"),
            (F.avg("l_tax") * 100).alias("on_warrant"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("cancelled_stock"),
            (F.sum(F.col("l_quantity") * (1 - F.col("l_discount"))) / 100).alias("closing_stock"),
        )
        out = out.join(flows, ["date", "asset"], "left")
    month = F.trunc("date", "month")
    macro = orders.groupBy(month.alias("date")).agg(
        F.avg(price).alias("us_gdp"), F.max(price).alias("cn_gdp"), (F.count("*") / 10.0).alias("us_pmi"),
    )
    days = orders.groupBy("date").agg((F.avg(price) / 10).alias("us_vix"), (F.max(price) / 100).alias("fx_cny"))
    return out.join(macro, "date", "left").join(days, "date", "left")


PANEL_SQL = """
SELECT g.date, g.asset, close_price, high_price, low_price, open_price, volume, open_interest,
       stock_in, stock_out, on_warrant, cancelled_stock, closing_stock, us_gdp, cn_gdp, us_pmi, us_vix, fx_cny
FROM (SELECT asset, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date
      FROM (SELECT o_orderpriority AS asset, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b FROM orders GROUP BY 1)) g
LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS asset, avg(o_totalprice / 997.0) AS close_price,
                  max(o_totalprice / 997.0) AS high_price, min(o_totalprice / 997.0) AS low_price,
                  quantile_cont(o_totalprice / 997.0, 0.5) AS open_price, CAST(count(*) AS DOUBLE) AS volume, sum(o_totalprice / 997.0) AS open_interest
           FROM orders GROUP BY 1, 2) d ON d.date = g.date AND d.asset = g.asset
LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS asset, sum(l_quantity) / 100 AS stock_in,
                  sum(l_extendedprice * l_discount) / 10000 AS stock_out, avg(l_tax) * 100 AS on_warrant,
                  CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) AS cancelled_stock, sum(l_quantity * (1 - l_discount)) / 100 AS closing_stock
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) f ON f.date = g.date AND f.asset = g.asset
LEFT JOIN (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, avg(o_totalprice / 997.0) AS us_gdp, max(o_totalprice / 997.0) AS cn_gdp, count(*) / 10.0 AS us_pmi
           FROM orders GROUP BY 1) m ON m.date = g.date
LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice / 997.0) / 10 AS us_vix, max(o_totalprice / 997.0) / 100 AS fx_cny
           FROM orders GROUP BY 1) v ON v.date = g.date
"""
