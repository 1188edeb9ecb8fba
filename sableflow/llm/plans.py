"""Queries over the problems of text at scale, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sableflow.llm.arrivals import ArrivalStore
from sableflow.llm.languages import fit, identify, label_code, relabel
from sableflow.llm.leaks import leaked_items
from sableflow.llm.linkage import link
from sableflow.llm.near_duplicates import duplicate_pairs, near_duplicates
from sableflow.llm.packing import fill_rate, pack
from sableflow.llm.sentences import split_sentences
from sableflow.llm.splitting import LIMIT, split_texts
from sableflow.operators.timestamps import normalise, stated_times
from sableflow.session import cut, shared_folder, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "news").select(F.col("news_no").alias("id"), "text")
    return duplicate_pairs(*near_duplicates(rows, run=3, threshold=0.6)).select(F.col("a").alias("news_a"), F.col("b").alias("news_b"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted articles are the history; all twelve batches are checked against it and each other in the order of arrival, and appended."""
    store = ArrivalStore(spark, f"{shared_folder(spark)}/arrivals/{uuid.uuid4().hex}", run=3, threshold=0.6)
    news = table(spark, sf_dir, "news")
    store.append(news.select((-1 - F.col("news_no")).alias("id"), F.col("id").alias("doc"), "text"))
    batch = table(spark, sf_dir, "news_incoming").select(F.col("inc_no").alias("id"), F.col("id").alias("doc"), "text")
    return store.check(batch).select(F.col("id").alias("inc_no")).distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_sentences(table(spark, sf_dir, "documents")).select("doc_id", "end_pos")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "news").select(F.col("news_no").alias("id"), "title", "text", F.get_json_object("metadata", "$.language").alias("label"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relabel(_labelled(spark, sf_dir)).where("lang != 'und'").select(F.col("id").alias("news_no"), "lang")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every title and paragraph with its language and confidence."""
    rows = _labelled(spark, sf_dir)
    return identify(rows, fit(rows.select("id", "title", "text", label_code(F.col("label")).alias("label")))).withColumnRenamed("id", "news_no")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_links(spark, sf_dir).select("sot_no", "pred_no")


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches with their confidence."""
    sot, pred = table(spark, sf_dir, "sot_sugar"), table(spark, sf_dir, "sugar_complete_dataset_with_predictions")
    instants = normalise(stated_times(None, sot, None), table(spark, sf_dir, "feeds")).where("utc_us is not null")
    left = sot.join(instants, F.col("sot_no") == F.col("row_no")).select(F.col("sot_no").alias("id"), "title", F.col("utc_us").alias("us"))
    right = pred.select(F.col("pred_no").alias("id"), "title", F.unix_micros(F.col("datetime").cast("timestamp")).alias("us"))
    return link(left, right).select(F.col("left_id").alias("sot_no"), F.col("right_id").alias("pred_no"), F.round("confidence", 6).alias("confidence"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_texts(table(spark, sf_dir, "news").select(F.col("news_no").alias("id"), "text"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir).where("piece_no = 2").select(F.col("id").alias("news_no"))


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces, from the first, of the texts that were cut: those over the limit of a piece."""
    long = table(spark, sf_dir, "news").where(F.char_length("text") > LIMIT)
    return split_texts(long.select(F.col("news_no").alias("id"), "text"), LIMIT).withColumnRenamed("id", "news_no")


def p7_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each text without what they repeat, joined: a digest of it, how many there are, the longest piece, and whether every repeat is the end of what comes before."""
    x = p7_pieces(spark, sf_dir).withColumn("core", F.expr("substring(piece, n_overlap + 1)"))
    repeats = F.expr("left(piece, n_overlap)")
    w = Window.partitionBy("news_no").orderBy("piece_no")
    x = x.withColumn("ok", (F.col("piece_no") == 1) | F.lag("piece").over(w).endswith(repeats))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "core"))), lambda p: p["core"])
    longest = (F.max(F.char_length("piece")) <= LIMIT).alias("within")
    repeated = (F.max("n_overlap") <= 200).alias("repeats_within")
    return x.groupBy("news_no").agg(F.md5(F.array_join(parts, "")).alias("text_key"), longest, repeated, F.bool_and("ok").alias("repeats_fit"), F.sum(F.char_length("core")).alias("n_chars"))


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the documents with tokens were placed: how many there are, whether every token is in one window only, and whether any window holds more than its capacity."""
    x = cut(p8_pack(spark, sf_dir))
    each = x.groupBy("doc_id").agg(F.min("token_from").alias("first"), F.max("token_to").alias("last"), F.sum(F.col("token_to") - F.col("token_from")).alias("n"))
    whole = each.select(F.lit(1).alias("document"), ((F.col("first") == 0) & (F.col("last") == F.col("n"))).alias("once"), F.lit(0).cast("bigint").alias("held"))
    held = x.groupBy("window").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("held")).select(F.lit(0).alias("document"), F.lit(True).alias("once"), "held")
    return whole.unionByName(held).agg(F.sum("document").alias("documents"), F.bool_and("once").alias("each_token_once"), (F.max("held") <= 2048).alias("within_capacity"))


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_rate(pack(table(spark, sf_dir, "documents")))


QUERIES = {
    "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_segments": p5_segments, "p6_found": p6_found, "p6_links": p6_links,
    "p7_found": p7_found, "p7_pieces": p7_pieces, "p7_joined": p7_joined,
    "p8_pack": p8_pack, "p8_fill": p8_fill, "p8_placed": p8_placed, "p9_found": p9_found, "p10_found": p10_found,
}
ORACLE: dict[str, str] = {
    "p7_found": "SELECT news_no FROM news WHERE length(text) > 4000",
    "p7_joined": "SELECT news_no, md5(text) AS text_key, true AS within, true AS repeats_within, true AS repeats_fit, length(text) AS n_chars FROM news WHERE length(text) > 4000",
    "p8_placed": "SELECT count(*) AS documents, true AS each_token_once, true AS within_capacity FROM documents WHERE text IS NOT NULL AND text <> ''",
}
