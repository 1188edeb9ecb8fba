"""Queries of feature marts and of evaluation roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sableflow.functions import text as t
from sableflow.functions.joins import join_small
from sableflow.operators import mart, relational as r
from sableflow.operators.similar import repeats, similar_pairs
from sableflow.session import cut, table

PRED = "sugar_complete_dataset_with_predictions"


def _sources(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    news = table(spark, d, "news").groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.avg(F.length("text")).alias("size"))
    moods = table(spark, d, "sot_sugar").groupBy(F.to_date("timestamp_added").alias("day")).agg(F.avg("sentiment").alias("mean"), F.avg("confidence").alias("confidence"))
    preds = table(spark, d, PRED).groupBy(F.to_date("datetime").alias("day")).agg(F.avg("sentiment_score").alias("score"), F.count("*").alias("n"))
    return {"news": news, "mood": moods, "pred": preds}


_PARTS = f"""news AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS news_n, avg(length(text)) AS news_size FROM news GROUP BY 1),
mood AS (SELECT CAST(timestamp_added AS DATE) AS day, avg(sentiment) AS mood_mean, avg(confidence) AS mood_confidence FROM sot_sugar GROUP BY 1),
pred AS (SELECT CAST(datetime AS DATE) AS day, avg(sentiment_score) AS pred_score, count(*) AS pred_n FROM {PRED} GROUP BY 1)"""
_SPINE = "SELECT day FROM (SELECT day, 1 AS o, count(*) OVER () AS c FROM m_news UNION ALL SELECT day, 2, count(*) OVER () FROM m_mood UNION ALL SELECT day, 3, count(*) OVER () FROM m_pred) QUALIFY dense_rank() OVER (ORDER BY c DESC, o) = 1"
_CTES = "WITH " + _PARTS.replace("news AS (", "m_news AS (", 1).replace("\nmood AS (", "\nm_mood AS (").replace("\npred AS (", "\nm_pred AS (") + f", s AS ({_SPINE})"
_COLS = ("news_n", "news_size", "mood_mean", "mood_confidence", "pred_score", "pred_n")


def _mart(spark: SparkSession, d: str) -> DataFrame:
    return mart.feature_mart(_sources(spark, d), "day")


def features(spark: SparkSession, d: str) -> DataFrame:
    x = mart.engineered(r.fill_median_mode(_mart(spark, d).withColumns({c: F.col(c).cast("double") for c in _COLS}), list(_COLS), []), "news_n", "mood_mean")
    return x.select("day", mart.ordinal(F.col("day")).cast("bigint").alias("ordinal"), *(F.round(c, 5).alias(c) for c in (*_COLS, "news_n_x_mood_mean", "log_news_n")))


def _filled(c: str) -> str:
    return f"coalesce({c}, (SELECT median({c}) FROM j))"


_FEATURES_SQL = f"""{_CTES}, j AS (SELECT s.day, {', '.join(_COLS)} FROM s LEFT JOIN m_news USING (day) LEFT JOIN m_mood USING (day) LEFT JOIN m_pred USING (day))
SELECT day, date_diff('day', DATE '0001-01-01', day) + 1 AS ordinal, {', '.join(f'round(CAST({_filled(c)} AS DOUBLE), 5) AS {c}' for c in _COLS)},
       round({_filled('news_n')} * {_filled('mood_mean')}, 5) AS news_n_x_mood_mean, round(ln(1 + greatest({_filled('news_n')}, 0)), 5) AS log_news_n FROM j"""


def inner_days(spark: SparkSession, d: str) -> DataFrame:
    x = mart.feature_mart(_sources(spark, d), "day", "inner")
    return x.select("day", *(F.round(F.col(c).cast("double"), 5).alias(c) for c in _COLS))


def correlations(spark: SparkSession, d: str) -> DataFrame:
    return r.correlation_matrix(_mart(spark, d).select(*(F.col(c).cast("double").alias(c) for c in _COLS[:4])), list(_COLS[:4]))


def importance(spark: SparkSession, d: str) -> DataFrame:
    x = mart.pruned(mart.importances(_mart(spark, d), "mood_mean", ["news_n", "news_size", "mood_confidence", "pred_score"]), 0.01)
    return x.select("feature", F.round("importance", 6).alias("importance"))


def grid_search(spark: SparkSession, d: str) -> DataFrame:
    configs = r.grid(spark, penalty=[0.01, 1.0, 100.0], degree=[1, 2, 3])
    configs = configs.withColumn("config", (F.col("degree") * 3 + F.log10(F.col("penalty")) / 2).cast("bigint"))
    x = table(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("size"), (F.col("p_partkey") % 1000).cast("double").alias("cycle"))
    out = mart.grid_search(x, "p_retailprice", ["size", "cycle"], configs, "p_partkey")
    return out.select("config", "penalty", "degree", F.round("rmse", 4).alias("rmse"), F.round("r2", 4).alias("r2"), "n")


def layered_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """How each later delivery repeats an earlier one: by address, by content, by id. First occurrences are found by aggregation, one per layer."""
    x = table(spark, d, "news").select("news_no", "id", F.get_json_object("metadata", "$.url").alias("url"), t.content_key(F.col("title"), F.col("text"), F.lit("")).alias("k"))
    for c in ("url", "k", "id"):
        first = x.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("news_no").alias(f"first_{c}"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
        x = x.join(first, c, "left")
    layer = F.when(F.col("first_url") < F.col("news_no"), "url").when(F.col("first_k") < F.col("news_no"), "content").when(F.col("first_id") < F.col("news_no"), "id")
    return x.select("news_no", layer.alias("layer")).where("layer is not null")


_PLAIN = r"coalesce(trim(regexp_replace(regexp_replace(lower({c}), 'https?://\S+|www\.\S+|[^\s@]{{1,64}}@[^\s@]+|[^\p{{L}}\p{{M}}\p{{Nd}}]', ' ', 'g'), ' {{2,}}', ' ', 'g')), '')"
_KEY = f"md5(concat({_PLAIN.format(c='title')}, '|', {_PLAIN.format(c='text')}, '|'))"
_LAYERS_SQL = f"""WITH x AS (SELECT news_no, id, json_extract_string(metadata, '$.url') AS url, {_KEY} AS k FROM news),
f AS (SELECT *, min(news_no) OVER (PARTITION BY url) AS fu, min(news_no) OVER (PARTITION BY k) AS fk, min(news_no) OVER (PARTITION BY id) AS fi FROM x)
SELECT * FROM (SELECT news_no, CASE WHEN url IS NOT NULL AND fu < news_no THEN 'url' WHEN fk < news_no THEN 'content' WHEN id IS NOT NULL AND fi < news_no THEN 'id' END AS layer FROM f) WHERE layer IS NOT NULL"""


def _similar(spark: SparkSession, d: str, layers: DataFrame) -> DataFrame:
    return similar_pairs(table(spark, d, "news").select(F.col("news_no").alias("id"), "source", F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("text", F.lit(""))).alias("content")), skip=layers.select(F.col("news_no").alias("id")))


def similar_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Of the rows that repeat none by address, content or id: all pairs of one source whose words have a Jaccard similarity of 0.85 or more."""
    return _similar(spark, d, cut(layered_duplicates(spark, d))).select(F.col("id").alias("news_no"), "earlier")


def four_layers(spark: SparkSession, d: str) -> DataFrame:
    """wh_layered_duplicates and its fourth layer: rows similar to an earlier kept row of their source."""
    layers = cut(layered_duplicates(spark, d))
    similar = repeats(_similar(spark, d, layers)).select(F.col("id").alias("news_no"), F.lit("similar").alias("layer"))
    return layers.unionByName(similar)


_WORDS_SQL = r"list_distinct(list_filter(string_split_regex(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '\s+'), lambda w: w <> ''))"
_SIMILAR_SQL = f"""WITH s AS (SELECT news_no, source, {_WORDS_SQL} AS w FROM news WHERE news_no NOT IN (SELECT news_no FROM ({_LAYERS_SQL})))
SELECT b.news_no, a.news_no AS earlier FROM s a JOIN s b ON a.source IS NOT DISTINCT FROM b.source AND a.news_no < b.news_no AND least(len(a.w), len(b.w)) >= 0.84 * greatest(len(a.w), len(b.w))
WHERE len(a.w) > 0 AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) >= 0.85::DOUBLE"""


def trusted(spark: SparkSession, d: str) -> DataFrame:
    """Rows of known feeds, by site first and by name else; rows without a source are not trusted."""
    feeds = table(spark, d, "feeds").where("home_lang in ('en', 'pt')")
    x = table(spark, d, "news").select("news_no", "source", F.get_json_object("metadata", "$.site_id").alias("site"))
    x = join_small(x, feeds.select(F.col("site_id").cast("string").alias("site"), F.lit(True).alias("by_site")), ["site"])
    x = join_small(x, feeds.select("source", F.lit(True).alias("by_name")), ["source"])
    keep = F.col("source").isNotNull() & (F.coalesce("by_site", F.lit(False)) | F.coalesce("by_name", F.lit(False)))
    return x.groupBy("source").agg(F.count_if(keep).alias("kept"), F.count_if(~keep).alias("left_out"))


def pick_site(spark: SparkSession, d: str) -> DataFrame:
    """The feed for each looked-up name: an exact match, else the first that contains it."""
    names = table(spark, d, "feeds").select(F.lower(F.element_at(F.split("source", " "), 1)).alias("name")).distinct()
    feeds = table(spark, d, "feeds").select("source", "site_id", F.lower("source").alias("s"))
    w = Window.partitionBy("name").orderBy(F.desc(F.col("s") == F.col("name")), "site_id")
    hits = feeds.select("*", F.explode(F.split("s", " ")).alias("name")).unionByName(feeds.withColumn("name", F.col("s"))).join(names, "name")
    return hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("name", "source", "site_id")


def training_records(spark: SparkSession, d: str) -> DataFrame:
    """Prompt and completion within a budget of characters; rows whose text would be left with under 100 are skipped."""
    budget = 2048
    room = F.lit(budget) - F.length("title") - F.length("sentiment") - 40
    x = table(spark, d, PRED).where("title is not null and text is not null and sentiment is not null and text != ''").where(room >= 100)
    body = F.when(F.length("text") <= room, F.col("text")).otherwise(F.left("text", room))
    return x.select("pred_no", F.md5(F.concat(F.lit("Title: "), "title", F.lit("\nText: "), body)).alias("prompt_key"), F.col("sentiment").alias("completion"))


def valid_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Whether each model's roll-up is sound, and the first reason if not."""
    x = table(spark, d, PRED).groupBy("model", "prompt_id").agg(F.avg("prob_positive").alias("p"), F.min("prob_negative").alias("low"), F.max("prob_neutral").alias("high"), F.count("*").alias("n"))
    reason = F.when(F.col("p").isNull(), "no values").when((F.col("low") < 0) | (F.col("high") > 1), "out of range").when(F.col("n") < 10, "too few")
    return x.select("model", "prompt_id", reason.isNull().alias("valid"), reason.alias("reason"))


QUERIES = {
    "mart_features": features, "mart_inner_days": inner_days, "mart_correlations": correlations, "mart_importance": importance, "mart_grid_search": grid_search,
    "wh_layered_duplicates": layered_duplicates, "wh_similar_deliveries": similar_deliveries, "wh_four_layers": four_layers, "wh_trusted_sources": trusted, "wh_pick_site": pick_site, "tx_training_records": training_records, "wh_valid_metrics": valid_metrics,
}
ORACLE = {
    "mart_features": _FEATURES_SQL,
    "mart_inner_days": f"{_CTES} SELECT n.day, {', '.join(f'round(CAST({c} AS DOUBLE), 5) AS {c}' for c in _COLS)} FROM m_news n JOIN m_mood USING (day) JOIN m_pred USING (day)",
    "mart_correlations": f"{_CTES}, j AS (SELECT s.day, {', '.join(_COLS)} FROM s LEFT JOIN m_news USING (day) LEFT JOIN m_mood USING (day) LEFT JOIN m_pred USING (day)) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM j" for i, a in enumerate(_COLS[:4]) for b in _COLS[i + 1 : 4]),
    "mart_importance": f"{_CTES}, j AS (SELECT s.day, {', '.join(_COLS)} FROM s LEFT JOIN m_news USING (day) LEFT JOIN m_mood USING (day) LEFT JOIN m_pred USING (day)), i AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, pow(corr({c}, mood_mean), 2) AS importance FROM j" for c in ("news_n", "news_size", "mood_confidence", "pred_score"))
    + ") SELECT feature, round(importance, 6) AS importance FROM i WHERE importance >= 0.01 * (SELECT max(importance) FROM i)",
    "wh_layered_duplicates": _LAYERS_SQL,
    "wh_similar_deliveries": _SIMILAR_SQL,
    "wh_trusted_sources": """WITH f AS (SELECT * FROM feeds WHERE home_lang IN ('en', 'pt')), k AS (SELECT source, source IS NOT NULL AND (source IN (SELECT source FROM f) OR coalesce(json_extract_string(metadata, '$.site_id') IN (SELECT CAST(site_id AS VARCHAR) FROM f), false)) AS keep FROM news)
SELECT source, count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS left_out FROM k GROUP BY source""",
    "wh_pick_site": "SELECT name, source, site_id FROM (SELECT n.name, f.source, f.site_id, row_number() OVER (PARTITION BY n.name ORDER BY lower(f.source) = n.name DESC, f.site_id) AS rn FROM (SELECT DISTINCT lower(string_split(source, ' ')[1]) AS name FROM feeds) n JOIN feeds f ON list_contains(string_split(lower(f.source), ' '), n.name) OR lower(f.source) = n.name) WHERE rn = 1",
    "tx_training_records": f"""SELECT pred_no, md5('Title: ' || title || chr(10) || 'Text: ' || CASE WHEN length(text) <= 2048 - length(title) - length(sentiment) - 40 THEN text ELSE left(text, 2048 - length(title) - length(sentiment) - 40) END) AS prompt_key, sentiment AS completion
FROM {PRED} WHERE text <> '' AND title IS NOT NULL AND sentiment IS NOT NULL AND 2048 - length(title) - length(sentiment) - 40 >= 100""",
    "wh_valid_metrics": f"""SELECT model, prompt_id, reason IS NULL AS valid, reason FROM (SELECT model, prompt_id, CASE WHEN avg(prob_positive) IS NULL THEN 'no values' WHEN min(prob_negative) < 0 OR max(prob_neutral) > 1 THEN 'out of range' WHEN count(*) < 10 THEN 'too few' END AS reason FROM {PRED} GROUP BY ALL)""",
}
