"""Warehouse-style queries: filters, recodes, joins, aggregations, windows and set operations over whole tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sableflow.functions.joins import join_small
from sableflow.operators import relational as r
from sableflow.session import table

QUERIES: dict = {}
ORACLE: dict = {}
PRED = "sugar_complete_dataset_with_predictions"
WORDS = ("sugar", "azúcar", "açúcar", "sucre", "zucker", "ethanol", "cane", "crushing", "harvest")


def query(name: str, sql: str):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f"wh_{name}"] = f
        ORACLE[f"wh_{name}"] = sql
        return f

    return register


# ------------------------------------------------ projections, filters, fills, recodes


@query("select_rename", "SELECT doc_id AS id, trim(source) AS origin, lang AS language, n_chars AS size FROM documents")
def select_rename(spark: SparkSession, d: str) -> DataFrame:
    x = r.strip_names(table(spark, d, "documents").withColumnRenamed("n_chars", " size "))
    return x.select(F.col("doc_id").alias("id"), F.trim("source").alias("origin"), F.col("lang").alias("language"), "size")


@query("date_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-03-31'")
def date_range(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return x.where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-04-01").cast("timestamp_ntz")))


@query("valid_or_missing", f"SELECT pred_no, sentiment FROM {PRED} WHERE sentiment IN ('positive', 'negative', 'neutral') OR sentiment IS NULL")
def valid_or_missing(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, PRED).select("pred_no", "sentiment")
    return x.where(F.col("sentiment").isin("positive", "negative", "neutral") | F.col("sentiment").isNull())


@query("text_sizes", """
SELECT source, count(*) AS n, count(*) FILTER (title <> '' AND text <> '') AS filled, count(*) FILTER (length(text) > 100) AS over_100_chars,
       count(*) FILTER (octet_length(encode(text)) > 1000) AS over_1000_bytes, count(*) FILTER (length(text) <= 500) AS short,
       count(*) FILTER (length(text) BETWEEN 501 AND 2000) AS middle, count(*) FILTER (length(text) > 2000) AS long FROM news GROUP BY source
""")  # fmt: skip
def text_sizes(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return table(spark, d, "news").groupBy("source").agg(
        F.count("*").alias("n"), F.count_if((F.col("title") != "") & (F.col("text") != "")).alias("filled"), F.count_if(n > 100).alias("over_100_chars"),
        F.count_if(F.octet_length("text") > 1000).alias("over_1000_bytes"), F.count_if(n <= 500).alias("short"), F.count_if(n.between(501, 2000)).alias("middle"), F.count_if(n > 2000).alias("long"),
    )


@query("keyword_any", f"SELECT asset, count(*) AS n FROM news WHERE regexp_matches(lower(concat_ws(' ', title, text)), '{'|'.join(WORDS)}') GROUP BY asset")
def keyword_any(spark: SparkSession, d: str) -> DataFrame:
    hit = F.lower(F.concat_ws(" ", "title", "text")).rlike("|".join(WORDS))
    return table(spark, d, "news").where(hit).groupBy("asset").agg(F.count("*").alias("n"))


@query("dedup_keep_newest", """
SELECT news_no, title, source FROM (SELECT *, row_number() OVER (PARTITION BY title, source ORDER BY created_at DESC, news_no) AS rn FROM news WHERE title IS NOT NULL) WHERE rn = 1
""")
def dedup_keep_newest(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "news").where("title is not null").select("news_no", "title", "source", "created_at")
    return r.keep_first(x, ["title", "source"], F.desc("created_at"), F.asc("news_no")).select("news_no", "title", "source")


@query("dedup_counts", """
SELECT asset, count(*) AS before, count(*) FILTER (rn = 1) AS after, count(*) FILTER (rn > 1) AS removed
FROM (SELECT asset, row_number() OVER (PARTITION BY asset, title, source ORDER BY created_at DESC, news_no) AS rn FROM news) GROUP BY asset
""")
def dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    # one aggregation instead of numbering rows: a group keeps one of its rows
    x = table(spark, d, "news").groupBy("asset", "title", "source").agg(F.count("*").alias("n"))
    return x.groupBy("asset").agg(F.sum("n").alias("before"), F.count("*").alias("after"), (F.sum("n") - F.count("*")).alias("removed"))


@query("fill_median_mode", f"""
SELECT pred_no, round(coalesce(prob_neutral, (SELECT median(prob_neutral) FROM {PRED})), 6) AS prob_neutral,
       coalesce(sentiment, (SELECT sentiment FROM {PRED} WHERE sentiment IS NOT NULL GROUP BY sentiment ORDER BY count(*) DESC, sentiment LIMIT 1)) AS sentiment FROM {PRED}
""")  # fmt: skip
def fill_median_mode(spark: SparkSession, d: str) -> DataFrame:
    x = r.fill_median_mode(table(spark, d, PRED).select("pred_no", "prob_neutral", "sentiment"), ["prob_neutral"], ["sentiment"])
    return x.withColumn("prob_neutral", F.round("prob_neutral", 6))


@query("recode", f"""
SELECT pred_no, CASE sentiment WHEN 'positive' THEN prob_positive WHEN 'negative' THEN prob_negative WHEN 'neutral' THEN prob_neutral END AS own_prob,
       CASE sentiment WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 WHEN 'neutral' THEN 0 END AS label FROM {PRED}
""")  # fmt: skip
def recode(spark: SparkSession, d: str) -> DataFrame:
    own = reduce(lambda acc, k: acc.when(F.col("sentiment") == k, F.col(f"prob_{k}")), ("negative", "neutral"), F.when(F.col("sentiment") == "positive", F.col("prob_positive")))
    code = F.create_map(*(F.lit(v) for kv in (("positive", 1), ("negative", -1), ("neutral", 0)) for v in kv))
    return table(spark, d, PRED).select("pred_no", own.alias("own_prob"), F.try_element_at(code, F.coalesce("sentiment", F.lit(""))).alias("label"))


@query("ordinal_and_snippet", """
SELECT news_no, date_diff('day', DATE '0001-01-01', CAST(created_at AS DATE)) + 1 AS ordinal,
       CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM news
""")  # fmt: skip
def ordinal_and_snippet(spark: SparkSession, d: str) -> DataFrame:
    ordinal = (F.datediff(F.to_date("created_at"), F.lit("0001-01-01").cast("date")) + 1).cast("bigint")
    return table(spark, d, "news").select("news_no", ordinal.alias("ordinal"), r.snippet("text", 200).alias("snippet"))


@query("positional_split", """
SELECT o_orderkey, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
""")
def positional_split(spark: SparkSession, d: str) -> DataFrame:
    return r.positional_split(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 0.7).select("o_orderkey", "part")


@query("hash_split", "SELECT doc_id, CASE WHEN CAST(CAST('0x' || left(md5(CAST(doc_id AS VARCHAR)), 6) AS BIGINT) % 100 AS INT) < 85 THEN 'train' ELSE 'valid' END AS part FROM documents")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.when(r.bucket_of("doc_id", 100) < 85, "train").otherwise("valid").alias("part"))


@query("repeatable_sample", "SELECT news_no FROM news ORDER BY md5(CAST(news_no AS VARCHAR)), news_no LIMIT 50")
def repeatable_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: the 50 rows first by hash."""
    return table(spark, d, "news").select("news_no").orderBy(F.md5(F.col("news_no").cast("string")), "news_no").limit(50)


# ------------------------------------------------ joins


@query("new_ids", "SELECT inc_no FROM news_incoming i WHERE NOT EXISTS (SELECT 1 FROM news n WHERE n.id = i.id)")
def new_ids(spark: SparkSession, d: str) -> DataFrame:
    return r.insert_if_absent(table(spark, d, "news_incoming"), table(spark, d, "news"), ["id"]).select("inc_no")


@query("known_ids", "SELECT inc_no, batch_no FROM news_incoming WHERE id IN (SELECT id FROM news)")
def known_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news_incoming").join(table(spark, d, "news").select("id"), "id", "left_semi").select("inc_no", "batch_no")


@query("lookup_feed", "SELECT n.news_no, f.zone_name, f.home_lang FROM news n LEFT JOIN feeds f ON n.source = f.source")
def lookup_feed(spark: SparkSession, d: str) -> DataFrame:
    feeds = table(spark, d, "feeds").select("source", "zone_name", "home_lang")
    return join_small(table(spark, d, "news").select("news_no", "source"), feeds, ["source"]).select("news_no", "zone_name", "home_lang")


@query("fan_out_join", f"""
SELECT s.sot_no, count(p.pred_no) AS predictions FROM sot_sugar s LEFT JOIN {PRED} p ON lower(trim(s.title)) = lower(trim(p.title)) GROUP BY s.sot_no
""")
def fan_out_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, PRED).groupBy(F.lower(F.trim("title")).alias("k")).agg(F.count("*").alias("n"))  # before the join: one row per key
    s = table(spark, d, "sot_sugar").select("sot_no", F.lower(F.trim("title")).alias("k"))
    return s.join(p, "k", "left").select("sot_no", F.coalesce("n", F.lit(0)).cast("bigint").alias("predictions"))


@query("synthetic_key", f"""
SELECT k, count(*) AS n FROM (SELECT strftime(date_trunc('minute', datetime + INTERVAL 30 SECOND), '%Y-%m-%d %H:%M') || '_' || left(title, 50) AS k FROM {PRED}) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1
""")
def synthetic_key(spark: SparkSession, d: str) -> DataFrame:
    minute = F.date_format(F.date_trunc("minute", F.col("datetime") + F.expr("interval 30 seconds")), "yyyy-MM-dd HH:mm")
    k = F.concat(minute, F.lit("_"), F.left("title", F.lit(50)))
    return table(spark, d, PRED).groupBy(k.alias("k")).agg(F.count("*").alias("n")).where("n > 1 and k is not null")


_MATCH_SQL = f"""
WITH s AS (SELECT sot_no, timestamp_added AS t, list_distinct(string_split(lower(title), ' ')) AS w FROM sot_sugar WHERE title <> ''),
p AS (SELECT pred_no, datetime AS t, list_distinct(string_split(lower(title), ' ')) AS w FROM {PRED} WHERE title <> ''),
m AS (SELECT sot_no, pred_no, len(list_intersect(s.w, p.w)) * 1.0 / greatest(len(s.w), len(p.w)) AS overlap
      FROM s JOIN p ON p.t BETWEEN s.t - INTERVAL 1 DAY AND s.t + INTERVAL 1 DAY)
SELECT sot_no, pred_no, round(overlap, 6) AS overlap
FROM (SELECT *, row_number() OVER (PARTITION BY sot_no ORDER BY overlap DESC, pred_no) AS rn FROM m WHERE overlap > 0.3) WHERE rn = 1
"""


@query("best_match_within_a_day", _MATCH_SQL)
def best_match_within_a_day(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "sot_sugar").where("title != ''").select("sot_no", F.col("timestamp_added").alias("t"), F.array_distinct(F.split(F.lower("title"), " ")).alias("w"))
    p = table(spark, d, PRED).where("title != ''").select("pred_no", F.col("datetime").alias("t"), F.array_distinct(F.split(F.lower("title"), " ")).alias("w"))
    both = r.interval_join(s, p, "t", 86_400)
    overlap = F.size(F.array_intersect("l_w", "r_w")) / F.greatest(F.size("l_w"), F.size("r_w"))
    best = both.withColumn("overlap", overlap).where("overlap > 0.3").groupBy(F.col("l_sot_no").alias("sot_no")).agg(F.max_by(F.struct("r_pred_no", "overlap"), F.struct("overlap", -F.col("r_pred_no"))).alias("m"))
    return best.select("sot_no", F.col("m.r_pred_no").alias("pred_no"), F.round("m.overlap", 6).alias("overlap"))


@query("overlapping_ranges", """
SELECT db_path, count(*) AS pairs FROM (SELECT a.db_path FROM processed_date_ranges a JOIN processed_date_ranges b ON a.db_path = b.db_path AND a.processing_mode = b.processing_mode AND a.id < b.id
  AND left(a.start_date, 10) <= left(b.end_date, 10) AND left(a.end_date, 10) >= left(b.start_date, 10)) GROUP BY db_path
""")
def overlapping_ranges(spark: SparkSession, d: str) -> DataFrame:
    """How many pairs of ranges overlap: per range, those that start no later than it ends less those that end before it starts, without making a pair."""
    x = table(spark, d, "processed_date_ranges").select("db_path", "processing_mode", "id", F.left("start_date", F.lit(10)).alias("s"), F.left("end_date", F.lit(10)).alias("e"))
    return r.count_overlaps(x, ["db_path", "processing_mode"], "id", "s", "e").groupBy("db_path").agg(F.sum("overlaps").alias("pairs")).where("pairs > 0")


_CIRCLE_SQL = """
WITH c AS (SELECT s_suppkey AS i, (s_suppkey * 37 % 1000) / 10.0 AS x, (s_suppkey * 91 % 1000) / 10.0 AS y, 3.05 + (s_suppkey % 7) / 10.0 AS r FROM supplier)
SELECT a.i AS i, b.i AS j, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) - a.r - b.r, 6) AS gap
FROM c a JOIN c b ON a.i < b.i WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < a.r + b.r - 1e-6
"""


@query("overlapping_circles", _CIRCLE_SQL)
def overlapping_circles(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = table(spark, d, "supplier").select(k.alias("i"), ((k * 37 % 1000) / 10.0).alias("x"), ((k * 91 % 1000) / 10.0).alias("y"), (F.lit(3.05) + (k % 7) / 10.0).alias("r"))
    return r.overlapping_circles(c, tolerance=1e-6)


@query("as_of_weekly", """
WITH w AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, sum(o_totalprice) AS oi FROM orders GROUP BY 1),
g AS (SELECT CAST(unnest(generate_series(min(week), max(week), INTERVAL 1 DAY)) AS DATE) AS day FROM w)
SELECT day, round(last_value(oi IGNORE NULLS) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING), 2) AS oi FROM g LEFT JOIN w ON w.week = g.day
""")
def as_of_weekly(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("day")).agg(F.sum("o_totalprice").alias("oi"))
    return r.daily_as_of(w, "day", "oi").select("day", F.round("oi", 2).alias("oi"))


# ------------------------------------------------ aggregations


@query("daily_mean", """
WITH e AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v, count(*) AS n FROM events GROUP BY 1), g AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM e)
SELECT g.day, round(v, 6) AS mean_value, coalesce(n, 0) AS n FROM g LEFT JOIN e ON e.day = g.day
""")
def daily_mean(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    return r.on_calendar(e, "day").select("day", F.round("v", 6).alias("mean_value"), F.coalesce("n", F.lit(0)).alias("n"))


@query("top_sources", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_sources(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query("distinct_counts", "SELECT model, count(DISTINCT id) AS ids, count(DISTINCT title) AS titles, count(*) AS n FROM " + PRED + " GROUP BY model")
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PRED).groupBy("model").agg(F.count_distinct("id").alias("ids"), F.count_distinct("title").alias("titles"), F.count("*").alias("n"))


@query("repeated_ids", "SELECT id, count(*) AS n, array_to_string(list_sort(list(pred_no)), ',') AS preds FROM " + PRED + " GROUP BY id HAVING count(*) > 1")
def repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, PRED).groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("pred_no")).cast("array<string>"), ",").alias("preds"))
    return x.where("n > 1")


@query("newest_of_group", """
SELECT title, source, max(news_no) FILTER (created_at = m) AS newest, count(*) AS n
FROM (SELECT title, source, news_no, created_at, max(created_at) OVER (PARTITION BY title, source) AS m FROM news WHERE title IS NOT NULL) GROUP BY title, source HAVING count(*) > 1
""")
def newest_of_group(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "news").where("title is not null").groupBy("title", "source")
    return x.agg(F.max_by("news_no", F.struct("created_at", "news_no")).alias("newest"), F.count("*").alias("n")).where("n > 1")


@query("ranges_and_means", "SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, round(avg(value), 3) AS mean_value, round(stddev_samp(value), 3) AS std FROM events GROUP BY event_type")
def ranges_and_means(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.round(F.avg("value"), 3).alias("mean_value"), F.round(F.stddev_samp("value"), 3).alias("std"))


@query("per_day_of_year", "SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM news WHERE year(created_at) = 2024 GROUP BY 1")
def per_day_of_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news").where(F.year("created_at") == 2024).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("correlation_matrix", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in combinations(_NUMERIC, 2)))
def correlation_matrix(spark: SparkSession, d: str) -> DataFrame:
    return r.correlation_matrix(table(spark, d, "lineitem").select(*_NUMERIC), list(_NUMERIC))


@query("quantiles", "SELECT p_brand, round(quantile_cont(p_retailprice, 0.7), 4) AS q70, round(median(p_retailprice), 4) AS q50, round(quantile_cont(p_retailprice, 0.05), 4) AS q05 FROM part GROUP BY p_brand")
def quantiles(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("p_retailprice", F.array(F.lit(0.7), F.lit(0.5), F.lit(0.05)))
    return table(spark, d, "part").groupBy("p_brand").agg(q.alias("q")).select("p_brand", *(F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q70", "q50", "q05"))))


_REG_SQL = f"""
SELECT model, prompt_id, count(*) AS n, round(sqrt(avg(pow(sentiment_score - (prob_positive - prob_negative), 2))), 6) AS rmse, round(avg(abs(sentiment_score - (prob_positive - prob_negative))), 6) AS mae,
       round(1 - sum(pow(sentiment_score - (prob_positive - prob_negative), 2)) / nullif(var_pop(sentiment_score) * count(*), 0), 6) AS r2
FROM {PRED} WHERE sentiment_score IS NOT NULL AND prob_positive IS NOT NULL AND prob_negative IS NOT NULL GROUP BY model, prompt_id
"""


@query("regression_metrics", _REG_SQL)
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, PRED).select("model", "prompt_id", F.col("sentiment_score").alias("y"), (F.col("prob_positive") - F.col("prob_negative")).alias("p"))
    return r.regression_metrics(x, ["model", "prompt_id"], "y", "p")


@query("best_config", f"SELECT model, prompt_id, rmse, r2 FROM ({_REG_SQL}) ORDER BY rmse, r2 DESC, model, prompt_id LIMIT 1")
def best_config(spark: SparkSession, d: str) -> DataFrame:
    return regression_metrics(spark, d).agg(F.min_by(F.struct("model", "prompt_id", "rmse", "r2"), F.struct("rmse", -F.col("r2"), "model", "prompt_id")).alias("m")).select("m.*")


@query("accuracy_rollup", f"""
SELECT model, count(*) AS calls, round(avg(CASE WHEN (sentiment = 'positive') = (sentiment_score > 0) THEN 1.0 ELSE 0.0 END) * 100, 4) AS accuracy FROM {PRED} WHERE sentiment IS NOT NULL AND sentiment_score IS NOT NULL GROUP BY model
""")
def accuracy_rollup(spark: SparkSession, d: str) -> DataFrame:
    right = F.when((F.col("sentiment") == "positive") == (F.col("sentiment_score") > 0), 1.0).otherwise(0.0)
    return table(spark, d, PRED).where("sentiment is not null and sentiment_score is not null").groupBy("model").agg(F.count("*").alias("calls"), F.round(F.avg(right) * 100, 4).alias("accuracy"))


@query("majority_vote", f"""
SELECT title, sentiment AS winner, n AS votes FROM (SELECT title, sentiment, count(*) AS n, row_number() OVER (PARTITION BY title ORDER BY count(*) DESC, min(pred_no)) AS rn
  FROM {PRED} WHERE sentiment IS NOT NULL AND title IS NOT NULL GROUP BY title, sentiment) WHERE rn = 1
""")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, PRED).where("sentiment is not null and title is not null").select("title", "sentiment", "pred_no")
    return r.majority_vote(x, ["title"], "sentiment", "pred_no").withColumnRenamed("sentiment", "winner")


@query("any_and_all", """
SELECT source, bool_or(CAST(json_extract_string(metadata, '$.triage_passed') AS BOOLEAN)) AS any_passed, bool_and(CAST(json_extract_string(metadata, '$.triage_passed') AS BOOLEAN)) AS all_passed,
       round(avg(coalesce(CAST(json_extract_string(metadata, '$.score') AS DOUBLE), 0)), 6) AS mean_score FROM news GROUP BY source
""")
def any_and_all(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("metadata", "triage_passed boolean, score double")
    x = table(spark, d, "news").select("source", m["triage_passed"].alias("p"), m["score"].alias("s"))
    return x.groupBy("source").agg(F.bool_or("p").alias("any_passed"), F.bool_and("p").alias("all_passed"), F.round(F.avg(F.coalesce("s", F.lit(0.0))), 6).alias("mean_score"))


@query("data_quality", f"""
SELECT count(*) AS n, count(*) FILTER (datetime < TIMESTAMP '2021-01-01' OR datetime >= TIMESTAMP '2026-01-01') AS out_of_range, count(*) FILTER (abs(prob_negative + prob_neutral + prob_positive - 1) > 0.01) AS bad_sum,
       count(*) FILTER (sentiment IS NULL) AS missing, count(*) FILTER (sentiment NOT IN ('positive', 'negative', 'neutral')) AS invalid, count(DISTINCT id) AS ids FROM {PRED}
""")
def data_quality(spark: SparkSession, d: str) -> DataFrame:
    when = F.col("datetime")
    out = (when < F.lit("2021-01-01").cast("timestamp_ntz")) | (when >= F.lit("2026-01-01").cast("timestamp_ntz"))
    return table(spark, d, PRED).agg(
        F.count("*").alias("n"), F.count_if(out).alias("out_of_range"), F.count_if(F.abs(F.col("prob_negative") + F.col("prob_neutral") + F.col("prob_positive") - 1) > 0.01).alias("bad_sum"),
        F.count_if(F.col("sentiment").isNull()).alias("missing"), F.count_if(~F.col("sentiment").isin("positive", "negative", "neutral")).alias("invalid"), F.count_distinct("id").alias("ids"),
    )


@query("coverage", f"SELECT n.source, count(*) AS total, count(p.id) AS predicted, round(count(p.id) / count(*), 6) AS share FROM news n LEFT JOIN (SELECT DISTINCT id FROM {PRED}) p ON n.id = p.id GROUP BY n.source")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, PRED).select("id").distinct().withColumn("hit", F.lit(1))
    x = table(spark, d, "news").select("source", "id").join(done, "id", "left").groupBy("source")
    return x.agg(F.count("*").alias("total"), F.count("hit").alias("predicted"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


@query("quota", """
WITH w AS (SELECT source, count(*) * (1 + avg(coalesce(CAST(json_extract_string(metadata, '$.score') AS DOUBLE), 0))) AS weight FROM news WHERE source IS NOT NULL GROUP BY source),
q AS (SELECT source, weight, greatest(1, CAST(floor(weight / sum(weight) OVER () * 1000) AS INT)) AS base FROM w),
k AS (SELECT *, 1000 - sum(base) OVER () AS spare, row_number() OVER (ORDER BY weight DESC, source) AS rn FROM q)
SELECT source, CAST(base + CASE WHEN rn <= spare THEN 1 ELSE 0 END AS INT) AS quota FROM k
""")
def quota(spark: SparkSession, d: str) -> DataFrame:
    score = F.coalesce(F.get_json_object("metadata", "$.score").cast("double"), F.lit(0.0))
    w = table(spark, d, "news").where("source is not null").groupBy("source").agg((F.count("*") * (1 + F.avg(score))).alias("weight"))
    return r.allocate(w, "source", "weight", 1000)


# ------------------------------------------------ windows, sorts, sets


@query("running", "SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER w, 2) AS so_far, max(o_totalprice) OVER w AS highest, row_number() OVER w AS nth, lead(o_orderkey) OVER w AS next_order FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def running(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = w.rowsBetween(Window.unboundedPreceding, 0)
    x = table(spark, d, "orders")
    return x.select("o_orderkey", "o_custkey", F.round(F.sum("o_totalprice").over(rows), 2).alias("so_far"), F.max("o_totalprice").over(rows).alias("highest"), F.row_number().over(w).alias("nth"), F.lead("o_orderkey").over(w).alias("next_order"))


@query("page", "SELECT title, source, count(*) AS n FROM news GROUP BY ALL HAVING count(*) > 1 ORDER BY n DESC, title, source NULLS FIRST LIMIT 10 OFFSET 5")
def page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a report."""
    x = table(spark, d, "news").groupBy("title", "source").agg(F.count("*").alias("n")).where("n > 1")
    return x.orderBy(F.desc("n"), F.asc_nulls_last("title"), F.asc_nulls_first("source")).offset(5).limit(10)


@query("tagged_union", f"SELECT 'news' AS origin, source, count(*) AS n FROM news GROUP BY source UNION ALL SELECT 'documents', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'predictions', source, count(*) FROM {PRED} GROUP BY source")
def tagged_union(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(n).alias("origin"), "source") for n, t in (("news", "news"), ("documents", "documents"), ("predictions", PRED))]
    return reduce(DataFrame.unionByName, parts).groupBy("origin", "source").agg(F.count("*").alias("n"))


@query("set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT id FROM news INTERSECT SELECT id FROM news_incoming) UNION ALL SELECT 'only new', count(*) FROM (SELECT id FROM news_incoming EXCEPT SELECT id FROM news) UNION ALL SELECT 'all', count(*) FROM (SELECT id FROM news UNION SELECT id FROM news_incoming)")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "news").select("id"), table(spark, d, "news_incoming").select("id")
    kinds = (("both", a.intersect(b)), ("only new", b.exceptAll(a).distinct().join(a, "id", "left_anti")), ("all", a.union(b).distinct()))
    return reduce(DataFrame.unionByName, [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, x in kinds])


@query("search_space", "SELECT a.v AS depth, b.v AS rate, c.v AS rounds, e.v AS l2, f.v AS features, g.v AS engineering FROM (SELECT unnest([4, 6, 8]) AS v) a, (SELECT unnest([0.01, 0.03, 0.05, 0.1]::DOUBLE[]) AS v) b, (SELECT unnest([500, 1000, 1500]) AS v) c, (SELECT unnest([1, 3, 5]) AS v) e, (SELECT unnest(['raw', 'engineered', 'all']) AS v) f, (SELECT unnest(['none', 'interaction', 'log']) AS v) g")
def search_space(spark: SparkSession, d: str) -> DataFrame:  # noqa: ARG001
    return r.grid(spark, depth=[4, 6, 8], rate=[0.01, 0.03, 0.05, 0.1], rounds=[500, 1000, 1500], l2=[1, 3, 5], features=["raw", "engineered", "all"], engineering=["none", "interaction", "log"])


@query("month_ranges", "SELECT CAST(m AS DATE) AS first_day, CAST(m + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS last_day FROM (SELECT unnest(generate_series(date_trunc('month', min(created_at)), date_trunc('month', max(created_at)), INTERVAL 1 MONTH)) AS m FROM news)")
def month_ranges(spark: SparkSession, d: str) -> DataFrame:
    return r.month_ranges(table(spark, d, "news"), "created_at")


@query("unprocessed_days", """
WITH done AS (SELECT DISTINCT CAST(unnest(generate_series(CAST(left(start_date, 10) AS DATE), CAST(left(end_date, 10) AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM processed_date_ranges WHERE left(start_date, 10) <= left(end_date, 10)),
need AS (SELECT CAST(unnest(generate_series(DATE '2019-06-01', DATE '2026-06-30', INTERVAL 1 DAY)) AS DATE) AS day)
SELECT day FROM need WHERE day NOT IN (SELECT day FROM done)
""")
def unprocessed_days(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "processed_date_ranges").select(F.to_date(F.left("start_date", F.lit(10))).alias("a"), F.to_date(F.left("end_date", F.lit(10))).alias("b"))
    return r.days_left(x, "a", "b", "2019-06-01", "2026-06-30")


@query("similar_vectors", """
SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 5) AS cosine
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
  AND list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) >= 0.3
""")
def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The search's queries are the rows with ids divisible by 100, against all rows."""
    x = table(spark, d, "embeddings").select("vec_id", "embedding")
    return r.similar_vectors(x.where("vec_id % 100 = 0"), x, 0.3)


@query("lineage", """
WITH RECURSIVE t AS (SELECT s_suppkey AS id, 0 AS depth FROM supplier WHERE s_suppkey = 1 UNION ALL SELECT s.s_suppkey, t.depth + 1 FROM supplier s JOIN t ON s.s_suppkey // 2 = t.id AND s.s_suppkey > 1)
SELECT id, depth FROM t
""")
def lineage(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "supplier").where("s_suppkey > 0").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") > 1, F.floor(F.col("s_suppkey") / 2)).alias("parent"))
    return r.depths(x, "id", "parent")


@query("rank_pages", "SELECT news_no, round(1 - (pos - 1.0) / (max(pos) OVER (PARTITION BY source)), 6) AS position_score FROM (SELECT news_no, source, row_number() OVER (PARTITION BY source ORDER BY created_at DESC, news_no) AS pos FROM news)")
def rank_pages(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("source").orderBy(F.desc("created_at"), "news_no")
    x = table(spark, d, "news").select("news_no", "source", F.row_number().over(by).alias("pos"))
    return x.select("news_no", F.round(1 - (F.col("pos") - 1.0) / F.max("pos").over(Window.partitionBy("source")), 6).alias("position_score"))


@query("star", """
SELECT n_name, r_name, c_mktsegment, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)) / 997, 4) AS revenue
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' GROUP BY ALL
""")
def star(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("l_shipdate")
    lines = table(spark, d, "lineitem").where((day >= F.lit("1996-01-01").cast("timestamp_ntz")) & (day < F.lit("1998-01-01").cast("timestamp_ntz")))
    per_order = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    x = per_order.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    x = join_small(x, places, ["c_nationkey"], "inner", 1000)
    return x.groupBy("n_name", "r_name", "c_mktsegment").agg(F.sum("n").alias("n_lines"), F.round(F.sum("v") / 997, 4).alias("revenue"))
