"""Queries over streams, each run over what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableflow.streaming import streams as s


def daily_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = s.run_available(s.tumbling_means(s.file_stream(spark, f"{sf_dir}/events.parquet"), "ts", "event_type", "value", late="60 days"), "complete")
    return x.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", F.round("mean_value", 6).alias("mean_value"), "n")


def distinct_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = s.file_stream(spark, f"{sf_dir}/news_incoming.parquet").where("id is not null").select("id", "received_at")
    return s.run_available(s.first_of_each(x, "received_at", ["id"], "10000 days")).select("id")


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished runs of users' events of one type."""
    x = s.file_stream(spark, f"{sf_dir}/events.parquet")
    return s.run_available(s.runs(x, "user_id", "ts", "event_type")).select("key", "run", "state", "n")


QUERIES = {"st_daily_means": daily_means, "st_distinct_articles": distinct_articles, "st_event_runs": event_runs}
ORACLE = {
    "st_daily_means": "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, round(avg(value), 6) AS mean_value, count(*) AS n FROM events GROUP BY 1, 2",
    "st_distinct_articles": "SELECT DISTINCT id FROM news_incoming WHERE id IS NOT NULL",
}
