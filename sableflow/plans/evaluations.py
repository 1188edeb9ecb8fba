"""Queries of the evaluation operators and of further joins and allocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableflow.operators import evaluation as e
from sableflow.operators import relational as r
from sableflow.session import table

QUERIES: dict = {}
ORACLE: dict = {}
PRED = "sugar_complete_dataset_with_predictions"


def query(name: str, sql: str):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f"ev_{name}"], ORACLE[f"ev_{name}"] = f, sql
        return f

    return register


_CASES = "SELECT l_orderkey, l_linenumber AS case_no, CASE l_returnflag WHEN 'N' THEN 'ACCEPTED' WHEN 'R' THEN 'WRONG_ANSWER' ELSE 'TIME_LIMIT' END AS verdict, l_quantity AS seconds, CAST(l_extendedprice * 1000 AS BIGINT) AS bytes, l_discount AS score FROM lineitem"


def _cases(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("l_returnflag") == "N", "ACCEPTED").when(F.col("l_returnflag") == "R", "WRONG_ANSWER").otherwise("TIME_LIMIT")
    return table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("case_no"), verdict.alias("verdict"), F.col("l_quantity").alias("seconds"), F.round(F.col("l_extendedprice") * 1000).cast("bigint").alias("bytes"), F.col("l_discount").alias("score"))


@query("case_rollup", f"SELECT l_orderkey, count(*) FILTER (verdict = 'ACCEPTED') AS passed, count(*) FILTER (verdict <> 'ACCEPTED') AS failed, max(seconds) AS max_seconds, max(bytes) // 1048576 AS max_mib, round(0 - avg(score), 6) + 0 AS combined_score FROM ({_CASES}) GROUP BY 1")
def case_rollup(spark: SparkSession, d: str) -> DataFrame:
    return e.case_rollup(_cases(spark, d), ["l_orderkey"], maximise=False).withColumn("combined_score", F.round("combined_score", 6))


@query("representative_case", f"""SELECT l_orderkey, CAST(coalesce(min(case_no) FILTER (verdict = overall), min(case_no)) AS INT) AS case_no
FROM (SELECT c.*, max(verdict) OVER (PARTITION BY l_orderkey) AS overall FROM ({_CASES}) c) GROUP BY 1""")
def representative_case(spark: SparkSession, d: str) -> DataFrame:
    x = _cases(spark, d)
    x = x.join(x.groupBy("l_orderkey").agg(F.max("verdict").alias("overall")), "l_orderkey")
    return e.representative_case(x, ["l_orderkey"], "overall")


@query("call_costs", f"SELECT model, count(*) AS calls, round(CAST(sum(length(title) * CASE model WHEN (SELECT min(model) FROM {PRED}) THEN 0.5 ELSE 2.0 END + 10 * 1.5) AS DOUBLE), 4) AS cost FROM {PRED} WHERE model IS NOT NULL GROUP BY 1")
def call_costs(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, PRED).where("model is not null").select("model", F.length("title").alias("prompt_tokens"), F.lit(10).alias("completion_tokens"))
    low = calls.agg(F.min("model").alias("low"))
    prices = calls.select("model").distinct().join(F.broadcast(low)).select("model", F.when(F.col("model") == F.col("low"), 0.5).otherwise(2.0).alias("input"), F.lit(1.5).alias("output"))
    return e.call_costs(calls, prices).groupBy("model").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))


@query("within_budget", "SELECT c_custkey, within FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 20 AS within FROM customer)")
def within_budget(spark: SparkSession, d: str) -> DataFrame:
    return e.within_budget(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 20).select("c_custkey", "within")


@query("archive", "SELECT p_brand, p_partkey, CAST(rank AS INT) AS rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part WHERE p_size % 2 = 0) WHERE rank <= 5")
def archive(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "part").withColumn("correct", F.col("p_size") % 2 == 0)
    return e.archive(x, ["p_brand"], "p_retailprice", "p_partkey", 5).select("p_brand", "p_partkey", "rank")


@query("run_score", "SELECT s_suppkey, CASE WHEN s < 0.5 THEN least(s - 0.5 * abs(w), -0.5) ELSE s - 0.5 * abs(w) END AS score FROM (SELECT s_suppkey, s_acctbal / 3000 AS s, s_nationkey / -50.0::DOUBLE AS w FROM supplier)")
def run_score(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", e.run_score(F.col("s_acctbal") / 3000, F.col("s_nationkey") / F.lit(-50.0)).alias("score"))


@query("arrays_as_text", "SELECT l_orderkey, string_agg('lines[' || l_linenumber || '] = (' || l_partkey || ', ' || l_suppkey || ')', chr(10) ORDER BY l_linenumber, '(' || l_partkey || ', ' || l_suppkey || ')') AS text FROM lineitem GROUP BY 1")
def arrays_as_text(spark: SparkSession, d: str) -> DataFrame:
    return e.arrays_as_text(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_partkey", "l_suppkey"], "lines")


@query("not_in", f"SELECT news_no FROM news WHERE id NOT IN (SELECT id FROM {PRED} WHERE id IS NOT NULL)")
def not_in(spark: SparkSession, d: str) -> DataFrame:
    return r.not_in(table(spark, d, "news"), "id", table(spark, d, PRED).where("id is not null"), "id").select("news_no")


@query("not_in_with_null", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT CASE WHEN s_suppkey = 1 THEN NULL ELSE s_nationkey END FROM supplier)")
def not_in_with_null(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") != 1, F.col("s_nationkey")).alias("k"))
    return r.not_in(table(spark, d, "customer"), "c_nationkey", keys, "k").select("c_custkey")


_MINUTE = "strftime(date_trunc('minute', {t} + INTERVAL 30 SECOND), '%Y-%m-%d %H:%M') || '_' || left(title, 50)"


@query("synthetic_key_join", f"""SELECT a.pred_no, b.pred_no AS other FROM {PRED} a JOIN {PRED} b ON {_MINUTE.format(t='a.datetime').replace('title', 'a.title')} = {_MINUTE.format(t='b.datetime').replace('title', 'b.title')} AND a.pred_no < b.pred_no""")
def synthetic_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one minute and one beginning of a title, joined by a key made of both."""
    x = table(spark, d, PRED).withColumn("k", r.key_of_minute("datetime", "title"))
    a, b = x.select("k", "pred_no"), x.select("k", F.col("pred_no").alias("other"))
    return a.join(b, "k").where("pred_no < other").select("pred_no", "other")


_WORTH = "SELECT source, CASE home_lang WHEN 'en' THEN 3.0 ELSE 1.0 END * (1 + site_id % 5) AS w FROM feeds"


def _worth_sql(total: int) -> str:
    return f"""WITH x AS ({_WORTH}), b AS (SELECT source, w, greatest(1, CAST(floor(w / (SELECT sum(w) FROM x) * {total}) AS INT)) AS base FROM x),
c AS (SELECT source, w, CASE WHEN (SELECT sum(base) FROM b) > {total} THEN greatest(1, CAST(floor(base * {total} / (SELECT sum(base) FROM b)) AS INT)) ELSE base END AS base FROM b)
SELECT source, CAST(base + CASE WHEN row_number() OVER (ORDER BY w DESC, source) <= {total} - (SELECT sum(base) FROM c) THEN 1 ELSE 0 END AS INT) AS quota FROM c"""


def _worth(spark: SparkSession, d: str, total: int) -> DataFrame:
    feeds = table(spark, d, "feeds").select("source", F.when(F.col("home_lang") == "en", 3.0).otherwise(1.0).alias("category"), (1 + F.col("site_id") % 5).cast("double").alias("reliability"))
    return r.allocate_by_worth(feeds, "source", ["category", "reliability"], total)


@query("quota_by_worth", _worth_sql(1000))
def quota_by_worth(spark: SparkSession, d: str) -> DataFrame:
    return _worth(spark, d, 1000)


@query("quota_scaled_down", _worth_sql(70))
def quota_scaled_down(spark: SparkSession, d: str) -> DataFrame:
    """So small a total that the ones of small shares exceed it."""
    return _worth(spark, d, 70)


@query("source_and_topic", "SELECT news_no FROM news WHERE source IN (SELECT source FROM feeds WHERE site_id % 2 = 0) AND asset = 'Sugar'")
def source_and_topic(spark: SparkSession, d: str) -> DataFrame:
    """Both filters: the source's number, and the topic among those of the row, which are a JSON list of objects here."""
    feeds = table(spark, d, "feeds").where("site_id % 2 = 0").select("source")
    x = table(spark, d, "news").withColumn("topics", F.to_json(F.array(F.struct(F.lit("General").alias("id")), F.struct(F.col("asset").alias("id")))))
    return r.with_topic(x.join(feeds, "source", "left_semi"), "topics", "Sugar").select("news_no")
