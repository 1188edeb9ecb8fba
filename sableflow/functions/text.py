"""Functions on text columns as JVM expressions: cleaning, keyword gates, keys, packing, and reading model replies.

All take columns and give columns; nulls stay null unless said otherwise. Regular expressions are Java's with (?u), so
letters of every script fold their case.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for the commodity in the languages of the feeds.
COMMODITY_WORDS = ("sugar", "sugarcane", "molasses", "sucrose", "raw sugar", "white sugar", "azúcar", "açúcar", "sucre", "zucker", "сахар", "चीनी", "سكر", "السكر", "糖", "砂糖", "白糖", "粗糖")
# Words of mood in free replies and their scores, in the order they are looked for. "negative" and "positive"
# stand before their mild forms, which therefore never decide.
MOODS = (
    (-0.9, ("very negative", "extremely negative")),
    (-0.6, ("negative", "bearish")),
    (-0.3, ("slightly negative", "mildly negative")),
    (0.9, ("very positive", "extremely positive")),
    (0.6, ("positive", "bullish")),
    (0.3, ("slightly positive", "mildly positive")),
    (0.0, ("neutral", "balanced")),
)
# Names of the fields of key-value lines.
LINE_FIELDS = ("contract", "date", "price", "volume", "index")
NUMBER = r"-?(?:[0-9]+(?:[.][0-9]+)?|[.][0-9]+)"


def keyword_pattern(words: tuple[str, ...]) -> str:
    """Whole words; blanks between the parts of a word match any white space; scripts without spaces match anywhere."""
    free = [w for w in words if re.search("[一-鿿぀-ヿ]", w)]
    bound = [r"\s+".join(re.escape(p) for p in w.split()) for w in words if w not in free]
    parts = ([rf"(?<![\p{{L}}\p{{M}}\p{{Nd}}])(?:{'|'.join(bound)})(?![\p{{L}}\p{{M}}\p{{Nd}}])"] if bound else []) + [re.escape(w) for w in free]
    return "(?iu)(?:" + "|".join(parts) + ")"


def clean_html(c: Column) -> Column:
    """Text without scripts, styles, comments and tags (the word <escaped> stays); entities stay; white space is single, none before .,!? or at the ends."""
    unseen = F.regexp_replace(c, r"(?s)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->", "")
    bare = F.regexp_replace(unseen, r"<(?!escaped>)[^>]+>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\s+(?=[.,!?])", ""), r"\s+", " "))


def normalise_punctuation(c: Column) -> Column:
    """Straight quotes, single white space, and of repeated marks the last."""
    c = F.translate(c, "“”„«»‘’‚", "\"\"\"\"\"'''")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[.!?]*([.!?])", "$1"), r"\s+", " "))


def contains_keywords(c: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(c.rlike(keyword_pattern(words)), F.lit(False)) if words else F.lit(False)


def triage(title: Column, text: Column, topic_passed: Column | None = None, least: int = 20, most: int | None = None, words: tuple[str, ...] = COMMODITY_WORDS) -> Column:
    """struct(passed, reason): gates in order, the first that fails gives the reason."""
    both = F.when(title.isNotNull() & (title != ""), F.concat(title, F.lit(" "), text)).otherwise(text)
    reason = F.when(~F.coalesce(topic_passed, F.lit(True)), "topic") if topic_passed is not None else F.when(F.lit(False), "")
    reason = reason.when(text.isNull() | (F.trim(text) == ""), "empty").when(F.length(text) < least, "short")
    if most is not None:
        reason = reason.when(F.length(text) > most, "long")
    reason = reason.when(~contains_keywords(both, words), "no keyword").otherwise("passed")
    return F.struct((reason == "passed").alias("passed"), reason.alias("reason"))


def replace_words(c: Column, words: dict[str, str]) -> Column:
    """Whole words replaced by what they stand for (slang, transliterations), whatever their case; white space becomes single."""
    table = F.create_map(*(F.lit(x) for kv in words.items() for x in kv)) if words else None
    if table is None:
        return c
    pieces = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{Nd}]+|[^\p{L}\p{M}\p{Nd}\s]+|\s+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda w: F.when(F.trim(w) == "", " ").otherwise(F.coalesce(table[F.lower(w)], w))), "")


def first_keywords(c: Column, zones: dict[str, tuple[str, ...]]) -> Column:
    """array<struct(zone, word)>: the first word of each zone's list that occurs, in the order of the zones."""
    found = [F.struct(F.lit(z).alias("zone"), F.coalesce(*(F.when(c.rlike(keyword_pattern((w,))), w) for w in ws)).alias("word")) for z, ws in zones.items()]
    return F.filter(F.array(*found), lambda x: x["word"].isNotNull())


def line_kinds(line: Column, names: tuple[str, ...] = LINE_FIELDS) -> Column:
    """Which kinds of structured line a line is: "bullet", "item" (numbered), "row" (of a table with bars), "field" (a known name before : or -)."""
    first, rest = F.left(line, F.lit(1)), F.trim(F.substr(line, F.lit(2)))
    head = F.substring_index(line, ".", 1)
    cut = F.least(*(F.when(F.instr(line, m) > 0, F.instr(line, m)).otherwise(F.length(line) + 1) for m in ":-"))
    name, value = F.lower(F.trim(F.left(line, cut - 1))), F.trim(F.substr(line, cut + 1))
    kinds = (
        ("bullet", first.isin("*", "-", "•") & (rest != "")),
        ("item", line.contains(".") & head.rlike("^[0-9]+$") & (F.length(line) > F.length(head) + 1)),
        ("row", (first == "|") & rest.contains("|")),
        ("field", name.isin(*names) & (value != "")),
    )
    return F.filter(F.array(*(F.when(test, kind) for kind, test in kinds)), lambda k: k.isNotNull())


def structured_lines(c: Column, words: tuple[str, ...] = COMMODITY_WORDS) -> Column:
    """array<struct(kind, line)> of the structured lines that hold a keyword, by kind and then in the order of the text; a line comes once per kind."""
    lines = F.filter(F.split(c, "\r?\n"), lambda x: x.rlike(keyword_pattern(words)))
    each = F.transform(lines, lambda x: F.struct(line_kinds(x).alias("kinds"), F.trim(x).alias("line")))

    def of_kind(k: str) -> Column:
        return F.transform(F.filter(each, lambda x: F.array_contains(x["kinds"], k)), lambda x: F.struct(F.lit(k).alias("kind"), x["line"].alias("line")))

    return F.concat(*map(of_kind, ("bullet", "item", "row", "field")))


def row_fields(line: Column) -> Column:
    """array of the trimmed cells of a table row written with bars."""
    return F.filter(F.transform(F.split(line, r"\|"), lambda x: F.regexp_replace(x, r"^[\s.,:;-]+|[\s.,:;-]+$", "")), lambda x: x != "")


def line_fields(line: Column, names: dict[str, tuple[str, ...]]) -> Column:
    """struct with, for each name, what follows the first of its words in the line (and a colon or dash) up to the next blank, bar or semicolon; null if none does."""

    def value(words: tuple[str, ...]) -> Column:
        after = F.regexp_extract(line, keyword_pattern(words) + r"[\s:-]*([^\s|;]+)", 1)
        return F.nullif(F.regexp_replace(after, r"^[.,:-]+|[.,:-]+$", ""), F.lit(""))

    return F.struct(*(value(words).alias(name) for name, words in names.items()))


_NO_CONTENT = r"https?://\S+|www\.\S+|[^\s@]{1,64}@[^\s@]+|[^\p{L}\p{M}\p{Nd}]"


def content_text(c: Column, synonyms: dict[str, str] | None = None, stop: tuple[str, ...] = ()) -> Column:
    """Lower case without addresses, punctuation and repeated white space: what two deliveries of one text share.

    With synonyms, every word becomes what it stands for; stop words go.
    """
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), _NO_CONTENT, " "), r" {2,}", " "))
    if not synonyms and not stop:
        return plain
    words = F.split(plain, " ")
    if synonyms:
        table = F.create_map(*(F.lit(x) for kv in synonyms.items() for x in kv))
        words = F.transform(words, lambda w: F.coalesce(table[w], w))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*stop)) if stop else words, " ")


def content_key(title: Column, text: Column, source: Column, synonyms: dict[str, str] | None = None, stop: tuple[str, ...] = ()) -> Column:
    """MD5 of the normalised title and text and the source, missing parts empty."""
    parts = (content_text(title, synonyms, stop), content_text(text, synonyms, stop), F.lower(F.trim(source)))
    return F.md5(F.concat_ws("|", *(F.coalesce(x, F.lit("")) for x in parts)))


def article_id(url: Column, title: Column, day: Column, asset: Column) -> Column:
    return F.md5(F.concat_ws("_", *(F.coalesce(x.cast("string"), F.lit("")) for x in (url, title, day, asset))))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared by all distinct words; null if neither has any."""
    x, y = word_set(a), word_set(b)
    both = F.size(F.array_intersect(x, y))
    return F.try_divide(both, F.size(x) + F.size(y) - both)


def rough_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def pack_sentences(c: Column, most: int = 1024, least: int = 512) -> Column:
    """array of parts of about `most` rough tokens at most, cut after sentences.

    A sentence beyond `most` gives way to its paragraphs, and a paragraph beyond it to its words. A part is closed where
    the next unit would take it beyond `most`, but not before it has `least`; a last part under `least` joins its predecessor.
    """

    def sized(x: Column) -> Column:
        return F.struct(x.alias("unit"), rough_tokens(x).cast("double").alias("n"))

    def by_words(p: Column) -> Column:
        return F.transform(F.split(p, r"\s+"), lambda w: F.struct(w.alias("unit"), ((F.length(w) + 1) / 4.0).alias("n")))

    def by_paragraphs(s: Column) -> Column:
        return F.flatten(F.transform(F.split(s, "\n\n"), lambda p: F.when(rough_tokens(p) > most, by_words(p)).otherwise(F.array(sized(p)))))

    sentences = F.split(F.regexp_replace(c, r"([.!?])\s+", "$1\u0000"), "\u0000")
    units = F.flatten(F.transform(sentences, lambda s: F.when(rough_tokens(s) > most, by_paragraphs(s)).otherwise(F.array(sized(s)))))
    # the numbers of the units that begin a part: a fold over sizes only
    begin = F.struct(F.array(F.lit(1)).alias("starts"), F.lit(0.0).alias("n"), F.lit(1).alias("at"))

    def step(acc: Column, u: Column) -> Column:
        close = (acc["n"] + u["n"] > most) & (acc["n"] >= least) & (acc["at"] > 1)
        return F.struct(
            F.when(close, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"),
            F.when(close, u["n"]).otherwise(acc["n"] + u["n"]).alias("n"), (acc["at"] + 1).alias("at"),
        )

    def parts(units: Column) -> Column:
        end = F.aggregate(units, begin, step)
        starts = F.when((end["n"] < least) & (F.size(end["starts"]) > 1), F.slice(end["starts"], 1, F.size(end["starts"]) - 1)).otherwise(end["starts"])
        texts = F.transform(units, lambda u: u["unit"])
        return F.transform(starts, lambda s, i: F.trim(F.array_join(F.slice(texts, s, F.coalesce(F.try_element_at(starts, i + 2), F.size(units) + 1) - s), " ")))

    return F.when(rough_tokens(c) <= most, F.array(c)).otherwise(F.element_at(F.transform(F.array(units), parts), 1))


def to_last_sentence(c: Column, budget: int, share: float = 0.7) -> Column:
    """At most `budget` characters, cut after the last .!? if that keeps more than the share of them."""
    head = F.left(c, F.lit(budget))
    end = F.length(F.regexp_extract(head, r"(?s)^.*[.!?]", 0))
    return F.when(F.length(c) <= budget, c).when(end > budget * share, F.left(head, end)).otherwise(head)


def suffixed_number(c: Column) -> Column:
    """'334.72K' as 334720; K, M and B multiply, thousands commas go, anything else is null."""
    c = F.regexp_replace(F.trim(c), ",", "")
    factor = F.create_map(*(F.lit(x) for kv in (("", 1.0), ("K", 1e3), ("M", 1e6), ("B", 1e9)) for x in kv))
    pattern = r"^([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*([KMB]?)$"
    return F.regexp_extract(c, pattern, 1).try_cast("double") * factor[F.regexp_extract(c, pattern, 2)]


def _number(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("double")


def reply_score(c: Column) -> Column:
    """A score in [-1, 1] from free text: a stated score, else a word of mood (MOODS), else the last number if it lies there, else 0."""
    low = F.lower(c)

    def after(name: str) -> Column:
        return _number(F.regexp_extract(low, rf"{name}(?: is| of)?[\s:]*({NUMBER})", 1))

    stated = F.coalesce(after("sentiment score"), after("score"))
    mood = F.coalesce(*(F.when(low.rlike("|".join(words)), score) for score, words in MOODS))
    number = last_number(c)
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), stated)) + F.when(stated.isNotNull(), 0.0), mood, F.when(number.between(-1.0, 1.0), number), F.lit(0.0))


def score_label(score: Column, edge: float = 0.15) -> Column:
    """struct(label, prob_negative, prob_neutral, prob_positive) of a score."""
    size = F.abs(score)
    up, down = score > edge, score < -edge
    return F.struct(
        F.when(up, "positive").when(down, "negative").otherwise("neutral").alias("label"),
        F.when(score < 0, size).otherwise(0.0).alias("prob_negative"), (1 - size).alias("prob_neutral"), F.when(score > 0, size).otherwise(0.0).alias("prob_positive"),
    )


def reply_label(c: Column) -> Column:
    """The label a reply gives: as JSON anywhere in it, as "label: x" or "answer: x", else the first mood word; else null."""
    json = F.regexp_extract(c, r"(?s)(\{.*?\})", 1)
    told = F.get_json_object(F.when(json != "", json), "$.label")
    keyed = F.nullif(F.regexp_extract(F.lower(c), r"(?:label|answer|sentiment)\W{1,4}(positive|negative|neutral)", 1), F.lit(""))
    word = F.nullif(F.regexp_extract(F.lower(c), r"(positive|negative|neutral)", 1), F.lit(""))
    return F.coalesce(F.lower(told), keyed, word)


def _last(c: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1))


def last_number(c: Column) -> Column:
    return _last(c, f"({NUMBER})").try_cast("double")


def last_stated(c: Column, name: str) -> Column:
    """The last number stated as "name: x" or "name = x", in any case."""
    return _last(F.lower(c), rf"{name.lower()}\s*[:=]\s*([+]?{NUMBER}(?:e[-+]?[0-9]+)?)").try_cast("double")


def last_boxed(c: Column, commands: tuple[str, ...] = (r"\boxed", r"\fbox")) -> Column:
    """What stands in the braces of the last boxed command, nested braces included; empty if there is none or a brace is missing.

    With several commands, the first that occurs counts.
    """
    at = F.coalesce(*(F.when(F.instr(c, k) > 0, F.length(c) - F.instr(F.reverse(c), k[::-1]) - len(k) + 2) for k in commands))
    body = F.regexp_extract(F.substr(c, at), r"(?s)\{(.*)", 1)
    # depth after each character; the body ends at the first place where it falls to -1
    marks = F.transform(F.split(body, ""), lambda ch: F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0))
    level = F.aggregate(
        marks,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("i"), F.lit(-1).alias("end")),
        lambda acc, m: F.struct((acc["depth"] + m).alias("depth"), (acc["i"] + 1).alias("i"), F.when((acc["end"] < 0) & (acc["depth"] + m < 0), acc["i"]).otherwise(acc["end"]).alias("end")),
    )
    return F.when(c.isNotNull(), F.coalesce(F.when(level["end"] >= 0, F.left(body, level["end"])), F.lit("")))


def plain_answer(c: Column) -> Column:
    """An answer for comparison: no blanks, signs of currency, degrees or percent, or leading zeros; a trailing .0 goes.

    Fractions are written out: \\frac12, \\dfrac{1}{2} and 1/2 agree.
    """
    c = F.regexp_replace(c, r"\\[dt]?frac\s*(?:\{([^{}]*)\}|(\d))\s*(?:\{([^{}]*)\}|(\d))", "$1$2/$3$4")
    c = F.regexp_replace(c, r"[\s$%°,]|\\(?:left|right|!|,|;)", "")
    c = F.regexp_replace(c, r"^(-?)0+(?=\d)", "$1")
    return F.regexp_replace(c, r"\.0+$", "")


def numbered(samples: Column) -> Column:
    """The samples of an array as one numbered text."""
    return F.array_join(F.transform(samples, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x)), "\n")


def search_query(groups: list[list[str]]) -> str:
    """Alternatives within a group, all groups required; multi-word terms are quoted and every group of several is in brackets."""
    parts = []
    for group in groups:
        terms = [f'"{t}"' if " " in t else t for t in group if t]
        if terms:
            parts.append(terms[0] if len(terms) == 1 else "(" + " OR ".join(terms) + ")")
    return " AND ".join(parts)
