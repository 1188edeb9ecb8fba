"""Pieces of oversized texts, cut at natural boundaries, with a specified overlap.

One regular expression with bounded quantifiers takes a piece: its alternatives, ordered by the strength of the
boundary (blank line, sentence, line, clause, word), each consume up to the limit and must end on their boundary; the
last takes characters whatever they are. A piece that follows another one starts with the overlap: the last `overlap`
characters of its predecessor, or fewer so as to begin on a whole unit (sentence, else word), found by a lookback from
the cut. Everything runs on SQL string and array functions inside the JVM, over code points, not UTF-16 units.

Defined results: a text of at most `limit` characters is one piece, whole; null and empty texts have no pieces; a text
without boundaries is cut at the limit; pieces without their overlaps make up the text again, character for character;
repeated rows give repeated pieces; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


LIMIT = 4000


def piece_pattern(most: int, least: int) -> str:
    """Alternatives by strength of boundary; each takes at most `most` code points and, save the rest and the last two, at least `least`."""
    return "|".join([
        rf"(?s:.{{1,{most}}})\z",  # the rest fits
        rf"(?s:.{{{least},{most - 3}}}\n[^\S\n]?\n)",
        rf"(?s:.{{{least},{most - 3}}}(?:[.!?…।؟][\"'”’»)]?\s|[。！？][”」』）]?))",
        rf"(?s:.{{{least},{most - 1}}}\n)",
        rf"(?s:.{{{least},{most - 2}}}(?:[;:,،]\s|[，；：、]))",
        rf"(?s:.{{1,{most - 1}}}\s)",
        rf"(?s:.{{1,{most}}})",
    ])


def overlap_of(before: Column, overlap: int) -> Column:
    """What a piece repeats of the text before it: from the beginning of a sentence if that is at least half the overlap, else of a word, else of any character."""
    tail = F.right(before, F.lit(overlap + 1))  # one more, to look back at
    sentence = F.regexp_extract(tail, rf"(?s)(?<=[.!?…।؟]\s|[。！？])\S.{{{overlap // 2},{overlap - 1}}}\z", 0)
    word = F.regexp_extract(tail, rf"(?s)(?<=\s)\S.{{{overlap // 2},{overlap - 1}}}\z", 0)
    return F.coalesce(F.nullif(sentence, F.lit("")), F.nullif(word, F.lit("")), F.right(before, F.lit(overlap)))


def split_texts(rows: DataFrame, limit: int = LIMIT, overlap: int = 200) -> DataFrame:
    """rows: id, text. One row per piece: id, piece_no (from 1), start_pos (without the overlap), n_overlap, piece."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    rows = rows.select("id", "text").where("text is not null and text != ''")
    rest = limit - overlap
    first = F.regexp_extract("text", rf"\A(?:{piece_pattern(limit, limit // 2)})", 0)
    tail = F.expr("substring(text, char_length(first) + 1)")
    cores = F.regexp_extract_all("tail", F.lit(rf"(?:{piece_pattern(rest, rest // 2)})"), F.lit(0))
    # a short text is its own first piece: no expression runs over it
    small = F.char_length("text") <= limit
    x = rows.withColumn("first", F.when(small, F.col("text")).otherwise(first))
    x = x.withColumn("tail", F.when(small, F.lit("")).otherwise(tail))
    x = x.withColumn("cores", F.concat(F.array("first"), F.when(F.col("tail") == "", F.array().cast("array<string>")).otherwise(cores)))
    # finished pieces, then one row each: the text itself is not carried along
    sizes = F.transform("cores", lambda c: F.char_length(c))

    def piece(core: Column, i: Column) -> Column:
        start = F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda acc, n: acc + n)
        last = F.element_at("cores", F.greatest(i, F.lit(1)))
        reach = F.least(i, F.lit(overlap + 1))  # so many pieces have as many characters
        further = F.array_join(F.transform(F.slice("cores", i - reach + 1, reach), lambda c: F.right(c, F.lit(overlap + 1))), "")
        before = F.right(F.when(F.char_length(last) > overlap, last).otherwise(further), F.lit(overlap + 1))
        kept = F.when((i > 0) & F.lit(overlap > 0), overlap_of(before, overlap)).otherwise("")
        return F.struct((i + 1).alias("piece_no"), start.alias("start_pos"), F.char_length(kept).alias("n_overlap"), F.concat(kept, core).alias("piece"))

    return x.withColumn("sizes", sizes).select("id", F.inline(F.transform("cores", piece)))
