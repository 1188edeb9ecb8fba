"""Queries of the text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableflow.functions import text as t
from sableflow.session import table

QUERIES: dict = {}
ORACLE: dict = {}
PRED = "sugar_complete_dataset_with_predictions"


def query(name: str, sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f"tx_{name}"] = f
        if sql:
            ORACLE[f"tx_{name}"] = sql
        return f

    return register


_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c},
 '<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<!--.*?-->', '', 'gs'), '<[^>]+>', ' ', 'g'), '\s+([.,!?])', '\1', 'g'), '\s+', ' ', 'g'))"""


@query("clean_html", f"SELECT news_no, md5({_CLEAN.format(c='text')}) AS cleaned, length({_CLEAN.format(c='text')}) AS n FROM news")
def clean_html(spark: SparkSession, d: str) -> DataFrame:
    c = t.clean_html(F.col("text"))
    return table(spark, d, "news").select("news_no", F.md5(c).alias("cleaned"), F.length(c).alias("n"))


_FREE = [w for w in t.COMMODITY_WORDS if any("一" <= ch <= "鿿" for ch in w)]
_BOUND = [w.replace(" ", r"\s+") for w in t.COMMODITY_WORDS if w not in _FREE]
_KEY = rf"(?i)(?:(?:^|[^\p{{L}}\p{{M}}\p{{Nd}}])(?:{'|'.join(_BOUND)})(?:[^\p{{L}}\p{{M}}\p{{Nd}}]|$)|{'|'.join(_FREE)})"


@query("triage", rf"""
SELECT news_no, reason = 'passed' AS passed, reason FROM (SELECT news_no, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 20 THEN 'short' WHEN length(text) > 20000 THEN 'long'
  WHEN NOT regexp_matches(CASE WHEN title <> '' THEN title || ' ' || text ELSE text END, '{_KEY}') THEN 'no keyword' ELSE 'passed' END AS reason FROM news)
""")  # fmt: skip
def triage(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "news").select("news_no", t.triage(F.col("title"), F.col("text"), most=20_000).alias("r"))
    return x.select("news_no", "r.passed", "r.reason")


ZONES = {"metal": ("zinc", "copper", "aluminium", "Zink", "cobre"), "energy": ("oil", "ethanol", "petróleo"), "weather": ("rain", "frost", "drought", "lluvia", "chuva")}


def _has(word: str) -> str:
    return rf"regexp_matches(t, '(?i)(?:^|[^\p{{L}}\p{{M}}\p{{Nd}}]){word}(?:[^\p{{L}}\p{{M}}\p{{Nd}}]|$)')"


_ZONES_SQL = " UNION ALL ".join(f"SELECT news_no, '{z}' AS zone, CASE {' '.join(f"WHEN {_has(w)} THEN '{w}'" for w in ws)} END AS word FROM x" for z, ws in ZONES.items())


@query("zones", f"WITH x AS (SELECT news_no, concat_ws(' ', title, text) AS t FROM news) SELECT * FROM ({_ZONES_SQL}) WHERE word IS NOT NULL")
def zones(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "news").select("news_no", F.explode(t.first_keywords(F.concat_ws(" ", "title", "text"), ZONES)).alias("z"))
    return x.select("news_no", "z.zone", "z.word")


_LINE_WORDS = (*t.COMMODITY_WORDS, "zinc", "copper", "Zink", "cobre", "cuivre")
_LINES = "'Lots today' || chr(10) || '* sugar ' || s_suppkey || chr(10) || s_suppkey || '. raw  sugar' || chr(10) || '| sugar | ' || s_acctbal || ' |' || chr(10) || CASE s_suppkey % 3 WHEN 0 THEN 'Price: sugar 9' WHEN 1 THEN 'Price: zinc 9' ELSE 'Prices: sugar 9' END || chr(10) || '- index - sugar'"
_LINES_SQL = """SELECT s_suppkey, unnest(list_filter(['bullet', 'bullet', 'item', 'row', CASE WHEN s_suppkey % 3 = 0 THEN 'field' END], lambda k: k IS NOT NULL)) AS kind,
  unnest(list_filter(['* sugar ' || s_suppkey, '- index - sugar', s_suppkey || '. raw  sugar', '| sugar | ' || s_acctbal || ' |', CASE WHEN s_suppkey % 3 = 0 THEN 'Price: sugar 9' END], lambda k: k IS NOT NULL)) AS line FROM supplier"""


@query("structured_lines", _LINES_SQL)
def structured_lines(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "supplier").select("s_suppkey", F.explode(t.structured_lines(F.expr(_LINES.replace("chr(10)", r"'\n'")))).alias("l"))
    return x.select("s_suppkey", "l.kind", "l.line")


_ROWS_SQL = r"""SELECT news_no, md5(array_to_string(list_filter(list_transform(string_split(line, '|'), lambda c: regexp_replace(c, '^[\s.,:;-]+|[\s.,:;-]+$', '', 'g')), lambda c: c <> ''), ';')) AS cells, count(*) AS n
FROM (SELECT news_no, unnest(string_split(text, chr(10))) AS line FROM news WHERE text IS NOT NULL) WHERE contains(line, '|') GROUP BY ALL"""


@query("row_fields", _ROWS_SQL)
def row_fields(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "news").select("news_no", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").contains("|"))
    return lines.groupBy("news_no", F.md5(F.array_join(t.row_fields(F.col("line")), ";")).alias("cells")).agg(F.count("*").alias("n"))


@query("line_fields", """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS contract, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 3 > 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS price FROM orders""")
def line_fields(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit(" | Settle - "), F.floor("o_totalprice").cast("string"), F.lit("."))).otherwise("")
    line = F.concat(F.lit("Lot: "), F.col("o_custkey").cast("string"), F.lit("; DATE "), F.date_format("o_orderdate", "yyyy-MM-dd"), price)
    x = table(spark, d, "orders").select("o_orderkey", t.line_fields(line, {"contract": ("contract", "lot"), "date": ("date",), "price": ("price", "settle")}).alias("f"))
    return x.select("o_orderkey", "f.contract", "f.date", "f.price")


_SLANG = {"tons": "tonnes", "vs": "versus"}


@query("replace_words", r"""SELECT pred_no, md5(regexp_replace(regexp_replace(regexp_replace(title, '\s+', ' ', 'g'), '(?i)\btons\b', 'tonnes', 'g'), '(?i)\bvs\b', 'versus', 'g')) AS k FROM sugar_complete_dataset_with_predictions WHERE regexp_full_match(title, '[ -~]*') AND NOT contains(title, '_')""")
def replace_words(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, PRED).where(r"title rlike '^[ -~]*$' and not contains(title, '_')")
    return x.select("pred_no", F.md5(t.replace_words(F.col("title"), _SLANG)).alias("k"))


@query("folded_content", r"""SELECT pred_no, md5(array_to_string(list_filter(list_transform(string_split(trim(regexp_replace(regexp_replace(lower(title), 'https?://\S+|www\.\S+|[^\s@]{1,64}@[^\s@]+|[^\p{L}\p{M}\p{Nd}]', ' ', 'g'), ' {2,}', ' ', 'g')), ' '),
 lambda w: CASE w WHEN 'rises' THEN 'rise' WHEN 'climbs' THEN 'rise' WHEN 'falls' THEN 'fall' ELSE w END), lambda w: w NOT IN ('the', 'of', 'a')), ' ')) AS k FROM sugar_complete_dataset_with_predictions""")
def folded_content(spark: SparkSession, d: str) -> DataFrame:
    c = t.content_text(F.col("title"), {"rises": "rise", "climbs": "rise", "falls": "fall"}, ("the", "of", "a"))
    return table(spark, d, PRED).select("pred_no", F.md5(c).alias("k"))


_PLAIN = r"coalesce(trim(regexp_replace(regexp_replace(lower({c}), 'https?://\S+|www\.\S+|[^\s@]{{1,64}}@[^\s@]+|[^\p{{L}}\p{{M}}\p{{Nd}}]', ' ', 'g'), ' {{2,}}', ' ', 'g')), '')"


@query("content_key", f"SELECT news_no, md5(concat({_PLAIN.format(c='title')}, '|', {_PLAIN.format(c='text')}, '|', coalesce(lower(trim(source)), ''))) AS k FROM news")
def content_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "news").select("news_no", t.content_key(F.col("title"), F.col("text"), F.col("source")).alias("k"))


@query("article_id", "SELECT news_no, md5(concat_ws('_', coalesce(json_extract_string(metadata, '$.url'), ''), coalesce(title, ''), coalesce(strftime(created_at, '%Y-%m-%d'), ''), coalesce(asset, ''))) AS k FROM news")
def article_id(spark: SparkSession, d: str) -> DataFrame:
    url = F.get_json_object("metadata", "$.url")
    return table(spark, d, "news").select("news_no", t.article_id(url, F.col("title"), F.date_format("created_at", "yyyy-MM-dd"), F.col("asset")).alias("k"))


@query("jaccard", r"""
WITH f AS (SELECT id, news_no, title, min(news_no) OVER (PARTITION BY id) AS first FROM news WHERE title IS NOT NULL AND id IS NOT NULL),
w AS (SELECT news_no, first, list_distinct(list_filter(regexp_split_to_array(lower(title), '\s+'), lambda w: w <> '')) AS w FROM f)
SELECT a.news_no, a.first, round(len(list_intersect(a.w, b.w)) * 1.0 / nullif(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)), 0), 6) AS similarity FROM w a JOIN w b ON a.first = b.news_no WHERE a.news_no <> a.first
""")
def jaccard(spark: SparkSession, d: str) -> DataFrame:
    """Each repeated delivery against the first: one row per row, not per pair."""
    x = table(spark, d, "news").where("title is not null and id is not null").select("id", "news_no", "title")
    first = x.groupBy("id").agg(F.min(F.struct("news_no", "title")).alias("f"))
    y = x.join(first, "id").where(F.col("news_no") != F.col("f.news_no"))
    return y.select("news_no", F.col("f.news_no").alias("first"), F.round(t.jaccard(F.col("title"), F.col("f.title")), 6).alias("similarity"))


@query("rough_tokens", "SELECT doc_id, CAST(length(text) // 4 AS INT) AS tokens FROM documents")
def rough_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", t.rough_tokens(F.col("text")).alias("tokens"))


@query("packed_sentences")
def packed_sentences(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(t.pack_sentences(F.col("text"), 256, 128)).alias("part", "p"))
    return x.select("doc_id", "part", F.length("p").alias("n_chars"), F.md5("p").alias("key"))


@query("to_last_sentence", r"""
SELECT doc_id, md5(CASE WHEN length(text) <= 500 THEN text WHEN length(regexp_extract(left(text, 500), '^.*[.!?]', 0, 's')) > 350 THEN regexp_extract(left(text, 500), '^.*[.!?]', 0, 's') ELSE left(text, 500) END) AS k FROM documents
""")
def to_last_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(t.to_last_sentence(F.col("text"), 500)).alias("k"))


_SUFFIX = "CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) || '.5K' WHEN 1 THEN CAST(p_size AS VARCHAR) || 'M' WHEN 2 THEN '1,' || lpad(CAST(p_size AS VARCHAR), 3, '0') WHEN 3 THEN 'n/a' ELSE ' ' || CAST(p_size AS VARCHAR) || ' B' END"


@query("suffixed_number", f"""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN (p_size + 0.5) * 1e3 WHEN p_partkey % 5 = 1 THEN p_size * 1e6 WHEN p_partkey % 5 = 2 THEN 1000.0 + p_size WHEN p_partkey % 5 = 3 THEN NULL ELSE p_size * 1e9 END AS value FROM (SELECT *, {_SUFFIX} AS s FROM part)
""")
def suffixed_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", t.suffixed_number(F.expr(_SUFFIX.replace("VARCHAR", "STRING"))).alias("value"))


_SAID = rf"try_cast(regexp_extract(lower(raw_prediction), '{{name}}(?: is| of)?[\s:]*({t.NUMBER})', 1) AS DOUBLE)"
_MOOD = " ".join(f"WHEN regexp_matches(lower(raw_prediction), '{'|'.join(words)}') THEN {score}" for score, words in t.MOODS)
_LAST = f"try_cast(regexp_extract_all(raw_prediction, '({t.NUMBER})', 1)[-1] AS DOUBLE)"
_STATED = f"coalesce({_SAID.format(name='sentiment score')}, {_SAID.format(name='score')})"
_SCORE = f"coalesce(CASE WHEN {_STATED} IS NOT NULL THEN least(1.0, greatest(-1.0, {_STATED})) END, CASE {_MOOD} END, CASE WHEN {_LAST} BETWEEN -1 AND 1 THEN {_LAST} END, 0.0)"


@query("reply_score", f"""
SELECT pred_no, CAST(s AS DOUBLE) AS score, CASE WHEN s > 0.15 THEN 'positive' WHEN s < -0.15 THEN 'negative' ELSE 'neutral' END AS label, round(CASE WHEN s < 0 THEN abs(s) ELSE 0.0 END, 6)::DOUBLE AS prob_negative,
       round(1 - abs(s), 6)::DOUBLE AS prob_neutral, round(CASE WHEN s > 0 THEN abs(s) ELSE 0.0 END, 6)::DOUBLE AS prob_positive FROM (SELECT pred_no, {_SCORE} AS s FROM {PRED})
""")  # fmt: skip
def reply_score(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, PRED).select("pred_no", t.reply_score(F.col("raw_prediction")).alias("score"))
    y = t.score_label(F.col("score"))
    return x.select("pred_no", "score", y["label"].alias("label"), *(F.round(y[f"prob_{k}"], 6).alias(f"prob_{k}") for k in ("negative", "neutral", "positive")))


@query("reply_label", rf"""
SELECT pred_no, coalesce(lower(CASE WHEN regexp_matches(raw_prediction, '\{{.*?\}}') AND json_valid(regexp_extract(raw_prediction, '(\{{.*?\}})', 1)) THEN json_extract_string(regexp_extract(raw_prediction, '(\{{.*?\}})', 1), '$.label') END),
  nullif(regexp_extract(lower(raw_prediction), '(?:label|answer|sentiment)\W{{1,4}}(positive|negative|neutral)', 1), ''), nullif(regexp_extract(lower(raw_prediction), '(positive|negative|neutral)', 1), '')) AS label FROM {PRED}
""")  # fmt: skip
def reply_label(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PRED).select("pred_no", t.reply_label(F.col("raw_prediction")).alias("label"))


@query("last_number", f"SELECT pred_no, {_LAST} AS value FROM {PRED}")
def last_number(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, PRED).select("pred_no", t.last_number(F.col("raw_prediction")).alias("value"))


@query("last_stated", "SELECT s_suppkey, CAST(s_suppkey % 10 / 10.0 AS DOUBLE) AS diversity, CAST(s_suppkey % 7 / 10.0 AS DOUBLE) AS novelty FROM supplier")
def last_stated(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = F.concat(F.lit("Diversity: 0.9, novelty_score = 0.1. On reflection diversity = "), (k % 10 / 10.0).cast("string"), F.lit("; Novelty-Score: "), (k % 7 / 10.0).cast("string"), F.lit(" final"))
    return table(spark, d, "supplier").select("s_suppkey", t.last_stated(s, "diversity").alias("diversity"), t.last_stated(s, r"novelty[\s_-]?score").alias("novelty"))


@query("last_boxed", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) || '{x{y}}' END AS boxed, CAST(p_size AS VARCHAR) AS answer FROM part")
def last_boxed(spark: SparkSession, d: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    s = F.concat(F.lit(r"so \boxed{1} or \boxed{"), size, F.lit("{x{y}}"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("} done"))
    return table(spark, d, "part").select("p_partkey", t.last_boxed(s).alias("boxed"), t.plain_answer(F.concat(F.lit(" 00"), size, F.lit(".0 %"))).alias("answer"))


@query("metadata", """
SELECT news_no, json_extract_string(metadata, '$.url') AS url, json_extract_string(metadata, '$.site_id') AS site_id, CAST(json_extract_string(metadata, '$.score') AS DOUBLE) AS score,
       CAST(json_extract_string(metadata, '$.triage_passed') AS BOOLEAN) AS passed, json_extract_string(metadata, '$.triage_reason') AS reason FROM news
""")
def metadata(spark: SparkSession, d: str) -> DataFrame:
    m = F.from_json("metadata", "url string, site_id string, score double, triage_passed boolean, triage_reason string")
    x = table(spark, d, "news").select("news_no", m.alias("m"))
    return x.select("news_no", "m.url", "m.site_id", "m.score", F.col("m.triage_passed").alias("passed"), F.col("m.triage_reason").alias("reason"))


@query("row_as_json", """SELECT s_suppkey, '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}' AS line FROM supplier""")
def row_as_json(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.to_json(F.struct("s_suppkey", "s_name")).alias("line"))


@query("prompt", "SELECT asset, string_agg('[' || rn || '] ' || title, chr(10) ORDER BY rn) AS prompt FROM (SELECT asset, title, row_number() OVER (PARTITION BY asset ORDER BY created_at DESC, news_no) AS rn FROM news WHERE title IS NOT NULL) WHERE rn <= 5 GROUP BY asset")
def prompt(spark: SparkSession, d: str) -> DataFrame:
    """The five newest titles of each asset as one numbered text; every partition keeps five rows per asset at most."""
    from pyspark.sql import Window

    w = Window.partitionBy("asset").orderBy(F.desc("created_at"), "news_no")
    x = table(spark, d, "news").where("title is not null").select("asset", "title", F.row_number().over(w).alias("rn")).where("rn <= 5")
    titles = F.transform(F.array_sort(F.collect_list(F.struct("rn", "title"))), lambda s: s["title"])
    return x.groupBy("asset").agg(t.numbered(titles).alias("prompt"))
