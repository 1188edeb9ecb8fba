"""Round trips of every source and sink over whole tables: written to the shared folder, read back, and compared by SQL with what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableflow.sources import files
from sableflow.sources.tables import Ledger, Parts, Table
from sableflow.session import shared_folder, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f"io_{name}"], ORACLE[f"io_{name}"] = f, sql
        return f

    return register


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files/{uuid.uuid4().hex}"


@query("csv", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def csv(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _folder(spark), table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    files.write_csv(rows, path)
    return files.read_delimited(spark, path, "p_partkey bigint, p_name string, p_size int, p_retailprice double", sep=",")


@query("csv_append", "SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def csv_append(spark: SparkSession, d: str) -> DataFrame:
    path, rows = _folder(spark), table(spark, d, "supplier")
    files.append_csv(rows.select("s_suppkey", "s_name"), path)
    files.append_csv(rows.where("s_acctbal > 0").select("s_suppkey", "s_name"), path)
    return files.read_delimited(spark, path, "s_suppkey bigint, s_name string", sep=",")


@query("tsv_thousands", "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer")
def tsv_thousands(spark: SparkSession, d: str) -> DataFrame:
    """Numbers written with thousands separators in a tab-separated file whose delimiter is found out."""
    path, rows = _folder(spark), table(spark, d, "customer")
    rows.select("c_custkey", F.format_number("c_acctbal", 2).alias("c_acctbal")).write.option("sep", "\t").csv(path)
    x = files.read_delimited(spark, path, "c_custkey bigint, c_acctbal string")
    return x.select("c_custkey", files.thousands(F.col("c_acctbal")).alias("c_acctbal"))


@query("csv_days", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def csv_days(spark: SparkSession, d: str) -> DataFrame:
    """Dates with a time and zone behind them, of which the first ten characters count."""
    path = _folder(spark)
    files.write_csv(table(spark, d, "orders").select(F.col("o_orderkey"), F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("-05:00")).alias("date")), path)
    x = files.read_delimited(spark, path, "o_orderkey bigint, date string", sep=",")
    return x.select("o_orderkey", files.leading_day(F.col("date")).alias("day"))


@query("json_lines", "SELECT event_id, event_type, value FROM events")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    files.write_json_lines(table(spark, d, "events").select("event_id", "event_type", "value"), path)
    return files.read_json_lines(spark, path, "event_id bigint, event_type string, value double")


@query("arrays", "SELECT vec_id, unnest(generate_series(1, 64)) - 1 AS place, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings")
def arrays(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark)
    x = table(spark, d, "embeddings").select((F.col("vec_id") % 8).cast("string").alias("file"), F.lit("embedding").alias("name"), F.col("vec_id").cast("int").alias("i"), F.concat(F.array(F.col("vec_id").cast("double")), F.col("embedding").cast("array<double>")).alias("values"))
    files.write_arrays(x, path)
    back = files.arrays_of(spark.read.parquet(path))
    return back.select(F.element_at("values", 1).cast("bigint").alias("vec_id"), F.posexplode(F.slice("values", 2, 64)).alias("place", "v")).select("vec_id", F.col("place").cast("bigint").alias("place"), "v")


@query("insert_and_delete", "SELECT s_suppkey, s_name FROM supplier WHERE NOT (s_suppkey % 3 = 0 AND s_suppkey % 2 = 0) AND s_suppkey % 7 <> 1")
def insert_and_delete(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping inserts of absent rows, a delete by predicate, a delete by ids, a compaction."""
    t = Table(spark, _folder(spark), "s_suppkey bigint, s_name string")
    rows = table(spark, d, "supplier")
    t.insert_absent(rows.where("s_suppkey % 2 = 0"), ["s_suppkey"])
    t.insert_absent(rows, ["s_suppkey"])
    t.delete("s_suppkey % 3 = 0 and s_suppkey % 2 = 0")
    t.delete_ids(rows.where("s_suppkey % 7 = 1"), "s_suppkey")
    t.compact()
    return t.read()


@query("deduplicate", """SELECT news_no FROM (SELECT news_no, row_number() OVER (PARTITION BY title, text, source ORDER BY news_no DESC) AS rn FROM news) WHERE rn = 1""")
def deduplicate(spark: SparkSession, d: str) -> DataFrame:
    """Of rows with equal title, text and source the newest stays; the others are deleted, and the result is verified."""
    t = Table(spark, _folder(spark), "news_no bigint, title string, text string, source string")
    t.append(table(spark, d, "news"))
    t.delete_repeats(["title", "text", "source"], "news_no")
    return t.read().select("news_no")


@query("describe", "SELECT 'n_nationkey' AS name, 'int' AS type UNION ALL SELECT 'n_name', 'string' UNION ALL SELECT 'n_regionkey', 'int'")
def describe(spark: SparkSession, d: str) -> DataFrame:
    t = Table(spark, _folder(spark), "n_nationkey int, n_name string, n_regionkey int")
    t.append(table(spark, d, "nation"))
    return spark.createDataFrame(t.describe(), "name string, type string")


@query("ledger", """SELECT CAST(day AS DATE) AS day FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-03-31', INTERVAL 1 DAY)) AS day)
WHERE NOT (day BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' OR day BETWEEN DATE '2024-02-25' AND DATE '2024-03-02')""")
def ledger(spark: SparkSession, d: str) -> DataFrame:
    """Days of a quarter that no finished run covers: ranges are marked one by one, one of them for another mode, one failed."""
    x = Ledger(spark, _folder(spark))
    for mode, a, b, status in (("full", "2024-01-10", "2024-01-20", "done"), ("full", "2024-02-25", "2024-03-02", "done"), ("quick", "2024-01-01", "2024-01-05", "done"), ("full", "2024-03-20", "2024-03-25", "failed")):
        x.mark(mode, a, b, status)
    x.table.compact()
    return x.days_left("full", "2024-01-01", "2024-03-31")


@query("resumed_parts", "SELECT o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY 1")
def resumed_parts(spark: SparkSession, d: str) -> DataFrame:
    """A run that breaks off after two parts and goes on with the others."""
    orders, parts = table(spark, d, "orders"), Parts(spark, _folder(spark))
    names = [r[0] for r in orders.select("o_orderpriority").distinct().orderBy("o_orderpriority").collect()]  # five by the table's definition
    for some in (names[:2], names):
        for i, n in enumerate(some):
            parts.run(f"p{i}", lambda n=n: orders.where(F.col("o_orderpriority") == n).groupBy(F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n")))
    return parts.all().select("priority", "n")


@query("results", "SELECT CAST(s_suppkey AS INT) AS generation, s_acctbal AS combined_score FROM supplier WHERE s_suppkey % 3 > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 1")
def results(spark: SparkSession, d: str) -> DataFrame:
    """Result files of generations, one folder each, and the best correct one."""
    path = _folder(spark)
    x = table(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("generation"), F.col("s_acctbal").alias("combined_score"), (F.col("s_suppkey") % 3 > 0).alias("correct"))
    files.write_json_lines(x, path)
    return files.best_generation(files.read_json_lines(spark, path, "generation int, combined_score double, correct boolean"))
