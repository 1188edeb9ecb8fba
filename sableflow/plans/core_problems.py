"""Queries over the core problems: continuous periods and normalised instants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableflow.operators.intervals import ledger_periods
from sableflow.operators.timestamps import normalise, stated_times
from sableflow.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger_periods(table(spark, sf_dir, "processed_date_ranges"))


def p3_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value with its instant, status and posterior."""
    rows = stated_times(*(table(spark, sf_dir, t) for t in ("news", "sot_sugar", "oil_only_output")))
    return normalise(rows, table(spark, sf_dir, "feeds"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_all(spark, sf_dir).where("status = 'ok'").select("tbl", "row_no", "utc_us")


def p3_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each table have which status."""
    return p3_all(spark, sf_dir).groupBy("tbl", "status").agg(F.count("*").alias("n"), F.round(F.avg("posterior"), 6).alias("mean_posterior"))


QUERIES = {"p1_found": p1_found, "p3_found": p3_found, "p3_status": p3_status}

ORACLE = {
    "p1_found": """
WITH r AS (
  SELECT db_path, lower(trim(processing_mode, E' \\t\\r\\n')) AS processing_mode,
         try_cast(left(trim(start_date), 10) AS DATE) AS s, try_cast(left(trim(end_date), 10) AS DATE) AS e
  FROM processed_date_ranges),
v AS (SELECT *, max(e) OVER (PARTITION BY db_path, processing_mode ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE s <= e),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY db_path, processing_mode ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM v),
p AS (SELECT db_path, processing_mode, n, min(s) AS a, max(e) AS b FROM g GROUP BY ALL),
q AS (SELECT *, lead(a) OVER (PARTITION BY db_path, processing_mode ORDER BY a) AS nxt FROM p)
SELECT db_path, processing_mode, 'period' AS kind, strftime(a, '%Y-%m-%d') AS first_day, strftime(b, '%Y-%m-%d') AS last_day FROM q
UNION ALL
SELECT db_path, processing_mode, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(nxt - 1, '%Y-%m-%d') FROM q WHERE nxt IS NOT NULL
""",
}
