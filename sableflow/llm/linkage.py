"""Matching headlines of two sources without a shared key: probabilistic record linkage.

1. Blocking in several passes: a title's names, whole, by their first and by their last five letters, each with a
   time bin as wide as the longest gap allowed (one side enters its neighbouring bins too). Names are rare words and
   hot ones: frequent words that titles write with a capital inside. Blocks of hot words are whole too, only larger.
2. Comparison of each candidate pair in agreement levels: names, numbers, wording, time. Names are the rare words of the
   left title, found in the right one up to small typing errors; a title cut off by an ellipsis cannot disagree about
   what it lost. Hot words are the names of a title without rare words; in others they can only add agreement, where
   half of all names or more are found and no rare name stands in the place of the lost ones, since company forms and German nouns have capitals as well. Wording asks how well the right title's common words go with the left one's, by associations counted
   over all pairs whose names agree, so paraphrases count as agreement and other news about the same names does not.
3. Expectation-maximisation over the counts of comparison patterns gives, for each level, its probability among
   matches and non-matches, and the posterior of a match is the pair's confidence.

Rows of one side with the same title and instant are compared once and expanded at the end. Word frequencies, pattern
counts and associations cover all rows; the driver gets pattern counts (at most 81) and the associations of common
words only, whose number is bounded by their least share of all titles.

Defined results: rows without title, instant or any word of four letters or more match nothing; repeated rows match each; equal titles
outside the gap do not match; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sableflow.functions.joins import join_small
from sableflow.session import cut, saved

LEVELS = {"names": 3, "numbers": 3, "wording": 3, "gap": 3}
# scripts without spaces: their words are taken as pairs of characters
_UNSPACED = "぀-ヿ㐀-䶿一-鿿豈-﫿"
_WORD = re.compile(rf"[{_UNSPACED}]+|(?:(?![{_UNSPACED}])[^\W_])+(?:[.,]\d+)*")
_RUN = re.compile(rf"[{_UNSPACED}]")
_CUT = re.compile(r"(?:…|\.\.\.)\s*(?:$|[|(\-–—])")
_DIGITS = re.compile(r"\d")


# Latin letters with marks and without, which damaged titles mix.
MARKED, PLAIN = "áàâãäåçéèêëíìîïñóòôõöúùûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys"
_FOLD = str.maketrans(MARKED, PLAIN)


def words_of(title: str) -> list[str]:
    out = []
    for w in _WORD.findall(title):
        out += [w[i : i + 2] for i in range(max(len(w) - 1, 1))] if _RUN.match(w) else [w.lower().translate(_FOLD)]
    return out


def close(a: str, b: str) -> bool:
    """Whether one letter changed, dropped, added or swapped with its neighbour makes them equal. Names are short and alike, so more would join different ones; under four letters none does."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3 or max(len(a), len(b)) < 4:
        return False
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[n + 1 :] == b[n + 1 :] or (a[n : n + 2] == b[n : n + 2][::-1] and a[n + 2 :] == b[n + 2 :])
    return a[n + 1 :] == b[n:] if len(a) > len(b) else a[n:] == b[n + 1 :]


def number_of(word: str) -> str:
    """Whole part of a number without separators of thousands: 13.7 and 13,70 and 13 agree, as do 4,094 and 4094."""
    m = re.fullmatch(r"(\d{1,3}(?:[.,]\d{3})+|\d+)(?:[.,]\d{1,2})?", word)
    return re.sub(r"[.,]", "", m[1]) if m else re.sub(r"\D", "", word)


def compare(left: list[str], names: list[str], right: list[str], right_title: str, hot: list[str] | tuple = (), own: list[str] | tuple = ()) -> tuple[int, int]:
    """Levels of names (0: none, 1: some, 2: all that can be there) and numbers (0: differ, 1: missing, 2: agree).

    hot: frequent names besides. Where no other name is found, they make level 1 if half of all names are found, or those that come first in a title cut off.
    Not so if the right title has another rare name in the place of the lost ones (own: its rare words with a capital).
    """
    truncated = bool(_CUT.search(right_title))

    def there(n: str) -> bool:
        return any(close(n, w) or truncated and len(w) > 3 and n.startswith(w) for w in right)

    hits = sum(there(n) for n in names)
    level = 2 if hits == len(names) else 1 if hits else 0
    if level == 1 and truncated:
        # the names that are left must be those that come first on the left
        first = names[:hits]
        if all(any(close(n, w) for w in right) for n in first):
            level = 2
    if not level and hot and all(any(close(n, w) for w in left) for n in own):
        found = [there(n) for n in dict.fromkeys(w for w in left if w in names or w in hot)]
        if 2 * sum(found) >= len(found) or truncated and found[0] and all(found[: sum(found)]):
            level = 1
    mine, theirs = {number_of(w) for w in left if _DIGITS.search(w)}, {number_of(w) for w in right if _DIGITS.search(w)}
    if not mine or not theirs:
        return level, 1
    return level, 2 if mine & theirs else (1 if truncated else 0)


def prepare(rows: DataFrame) -> DataFrame:
    """Distinct (title, us) with an id of their own: key, title, us, words. Runs of unspaced scripts give their pairs of characters."""
    split = F.expr(
        rf"flatten(transform(regexp_extract_all(title, '[{_UNSPACED}]+|[\\p{{L}}\\p{{M}}\\p{{Nd}}&&[^{_UNSPACED}]]+(?:[.,][\\p{{Nd}}]+)*', 0), w -> "
        rf"if(w rlike '^[{_UNSPACED}]', transform(sequence(1, greatest(char_length(w) - 1, 1)), i -> substring(w, i, 2)), array(translate(lower(w), '{MARKED}', '{PLAIN}')))))"
    )
    x = rows.where("title is not null and us is not null").select(F.trim("title").alias("title"), "us").distinct()
    return x.withColumn("words", split).withColumn("key", F.xxhash64("title", "us"))


def rare_words(left: DataFrame, right: DataFrame, share: float = 0.002, slack: int = 3) -> DataFrame:
    """(word, rare, hot): over the distinct titles of both sides; digits are neither. hot: a frequent word that has a capital inside titles.

    Titles of one case tell nothing about capitals. A word that is never inside a left title is judged by the right ones, and is hot if it isn't inside any.
    """
    both = left.select("title", "words").unionByName(right.select("title", "words")).dropDuplicates(["title"])
    n = both.count()
    count = both.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    usable = ((F.length("word") > 3) & ~F.col("word").rlike(r"\d")) | F.col("word").rlike(f"^[{_UNSPACED}]")
    frequent = count.where(usable & (F.col("df") > share * n + slack)).select("word")
    sides = left.select("title", "words", F.lit(True).alias("l")).unionByName(right.select("title", "words", F.lit(False).alias("l")))
    inside = sides.where((F.col("title") != F.lower("title")) & (F.col("title") != F.upper("title"))).select("title", "l", F.posexplode("words").alias("pos", "word")).where("pos > 0")
    large = _plain().contains(_large()).cast("int")
    inside = inside.join(frequent, "word", "left_semi").groupBy("word").agg(F.avg(F.when(F.col("l"), large)).alias("of_left"), F.avg(large).alias("of_all"))
    x = count.join(inside, "word", "left")
    rare = usable & (F.col("df") <= share * n + slack)
    return x.select("word", rare.alias("rare"), (usable & ~rare).alias("frequent"), (usable & ~rare & (F.coalesce("of_left", "of_all", F.lit(1.0)) >= 0.9)).alias("hot"))


def _plain() -> Column:
    return F.translate("title", MARKED + MARKED[:-2].upper(), PLAIN + PLAIN[:-2].upper())


def _large() -> Column:
    return F.concat(F.upper(F.left("word", F.lit(1))), F.expr("substr(word, 2)"))


def with_names(side: DataFrame, rare: DataFrame, capitals: bool) -> DataFrame:
    """Adds `names`: the rare words of each title, in order; with `capitals` only those with a capital, if there are any. And `hot`: its hot words, `own`: its rare words with a capital.

    A title without rare words has its hot words as names, or else all its frequent words.
    """
    each = side.select("key", "title", F.posexplode("words").alias("pos", "word")).join(rare.where("rare or frequent"), "word")
    capital = _plain().contains(_large()) | _plain().contains(F.upper("word"))
    each = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "word", capital.alias("capital"), "rare", "hot"))).alias("x"))
    each = each.withColumns({"r": F.filter("x", lambda w: w["rare"]), "h": F.array_distinct(F.transform(F.filter("x", lambda w: w["hot"]), lambda w: w["word"]))})
    chosen = F.when(F.lit(capitals) & F.exists("r", lambda w: w["capital"]), F.filter("r", lambda w: w["capital"])).otherwise(F.col("r"))
    frequent = F.array_distinct(F.transform("x", lambda w: w["word"]))
    names = F.when(F.size("r") > 0, F.transform(chosen, lambda w: w["word"])).when(F.size("h") > 0, F.col("h")).otherwise(frequent)
    hot = F.when(F.size("r") > 0, F.col("h")).otherwise(F.array().cast("array<string>"))
    own = F.transform(F.filter("r", lambda w: w["capital"]), lambda w: w["word"])
    return side.join(each.select("key", names.alias("names"), hot.alias("hot"), own.alias("own")), "key")


def _blocks(side: DataFrame, bins: list[int], width: int) -> DataFrame:
    """(key, us, bin, block, word, named): the names and hot words of a title, whole and by both ends, in the time bins given relative to its own."""
    x = side.select("key", "us", F.floor(F.col("us") / width).alias("bin"), F.size(F.array_distinct("names")).alias("n"), F.posexplode(F.array_union("names", "hot")).alias("word", "w"))
    whole = F.concat(F.lit("w"), "w")
    kinds = F.when(F.length("w") < 4, F.array(whole)).otherwise(F.array(whole, F.concat(F.lit("a"), F.left("w", F.lit(5))), F.concat(F.lit("z"), F.right("w", F.lit(5)))))
    x = x.select("key", "us", "bin", "word", (F.col("word") < F.col("n")).alias("named"), F.explode(kinds).alias("block"))
    return x.select("key", "us", F.explode(F.array(*(F.col("bin") + k for k in bins))).alias("bin"), "block", "word", "named")


def candidates(left: DataFrame, right: DataFrame, width: int, most: int = 500) -> DataFrame:
    """Distinct (a, b) of keys that share a block and lie at most `width` microseconds apart.

    Where no name is among what they share, half of the left title's names and hot words must be, or the right title be cut off: others can't agree.
    Blocks with more than `most` right rows are dealt out: their right rows over pieces by their keys, their left rows to every piece.
    """
    a = _blocks(left, [-1, 0, 1], width).withColumnsRenamed({"key": "a", "us": "us_a"})
    a = a.join(left.select(F.col("key").alias("a"), F.size(F.array_union("names", "hot")).alias("of")), "a")
    cut_off = right.select(F.col("key").alias("b"), F.col("title").rlike(_CUT.pattern).alias("cut_off"))
    b = _blocks(right, [0], width).select(F.col("key").alias("b"), F.col("us").alias("us_b"), "bin", "block").distinct()
    b = cut(b.join(cut_off, "b"))
    hot = cut(b.groupBy("bin", "block").agg(F.ceil(F.count("*") / most).alias("pieces")).where("pieces > 1"))
    on = ["bin", "block"]
    if not hot.isEmpty():
        pieces = F.coalesce("pieces", F.lit(1))
        a = join_small(a, hot, on).select("a", "us_a", "word", "named", "of", *on, F.explode(F.sequence(F.lit(1).cast("bigint"), pieces)).alias("piece"))
        b = join_small(b, hot, on).select("b", "us_b", "cut_off", *on, (F.pmod(F.col("b"), pieces) + 1).alias("piece"))
        on = [*on, "piece"]
    met = a.join(b, on).where(F.abs(F.col("us_a") - F.col("us_b")) <= width)
    told = met.groupBy("a", "b").agg(F.max("named").alias("named"), F.max("cut_off").alias("cut_off"), F.expr("bit_or(shiftleft(1L, least(word, 62)))").alias("words"), F.max("of").alias("of"))
    return told.where(F.col("named") | F.col("cut_off") | (F.col("of") > 62) | (2 * F.bit_count("words") >= F.col("of"))).select("a", "b")


class Patterns:
    """Match and non-match probabilities of agreement levels, by expectation-maximisation over counts of patterns."""

    def __init__(self, counts: dict[tuple[int, ...], int], rounds: int = 200) -> None:
        fields = list(LEVELS.values())
        patterns = list(itertools.product(*(range(n) for n in fields)))
        n = np.array([counts.get(p, 0) for p in patterns], float)
        total = max(n.sum(), 1)
        # matches lean to agreement and non-matches to disagreement: that starts the rounds and, as a few pseudo-counts, steadies them on small tables
        lean = np.array([0.03, 0.17, 0.8])
        marginal = [np.bincount([p[k] for p in patterns], n, size) + 0.5 for k, size in enumerate(fields)]
        m, u = ([y * x / (y * x).sum() for y in marginal] for x in (lean, lean[::-1]))
        prior = 0.5
        index = [np.array([p[k] for p in patterns]) for k in range(len(fields))]
        for _ in range(rounds):
            lm = np.prod([m[k][index[k]] for k in range(len(fields))], axis=0) * prior
            lu = np.prod([u[k][index[k]] for k in range(len(fields))], axis=0) * (1 - prior)
            w = lm / np.maximum(lm + lu, 1e-300)
            new = float((w * n).sum() / total)
            for k, size in enumerate(fields):
                for table, weight, side in ((m, w * n, lean), (u, (1 - w) * n, lean[::-1])):
                    x = np.bincount(index[k], weight, size) + 5 * side * (n.sum() > 0) + 1e-3
                    table[k] = x / x.sum()
            done = abs(new - prior) < 1e-9
            prior = min(max(new, 1e-6), 1 - 1e-6)
            if done:
                break
        self.m, self.u, self.prior = m, u, prior
        self.posterior = dict(zip(patterns, w, strict=True))


ASSOCIATION = "a_word string, b_word string, n bigint"


def _association(matched: DataFrame) -> DataFrame:
    """How often each common left word meets each common right word."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                count.update((x, y) for x in {"", *a} for y in {"", *b})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["a_word", "b_word", "n"])

    return matched.select("a_common", "b_common").mapInArrow(of, ASSOCIATION).groupBy("a_word", "b_word").agg(F.sum("n").alias("n"))


class Wording:
    """How well the common words of two titles go together: 0 badly, 1 partly, 2 well."""

    def __init__(self, rows: list[tuple[str, str, int]], telling: float = 2.5, slack: float = 1.2) -> None:
        """A right word is telling if some left word meets it e**telling times as often as by chance; left words that come near the best of them explain it."""
        n = {(a, b): c for a, b, c in rows}
        total = max(n.get(("", ""), 0), 1)
        lift, best = {}, {}
        for (a, b), c in n.items():
            if a and b:
                x = math.log((c + 0.1) / (n.get((a, ""), 0) * n.get(("", b), 0) / total + 0.1))
                lift[a, b] = x
                for side in (("a", a), ("b", b)):
                    best[side] = max(best.get(side, x), x)
        self.telling = {w for w, x in best.items() if x >= telling}
        self.explains = {(a, b) for (a, b), x in lift.items() if x >= max(min(best["a", a], best["b", b]) - slack, 0.5)}

    def level(self, a: list[str], b: list[str], truncated: bool) -> int:
        """The share of telling words that stand in both titles, or are explained by a word that stands in the other only.

        What a cut-off right title lacks is not held against it.
        """
        left, right = set(a), set(b)
        both, only_left, only_right = left & right, left - right, right - left
        told = [w for w in right if ("b", w) in self.telling]
        good = sum(w in both or any((x, w) in self.explains for x in only_left) for w in told)
        n = len(told)
        if not truncated:
            told = [w for w in left if ("a", w) in self.telling]
            good += sum(w in both or any((w, x) in self.explains for x in only_right) for w in told)
            n += len(told)
        if not n:
            return 1
        return 2 if good / n >= 0.75 else 1 if good / n >= 0.5 else 0


COMPARED = "a bigint, b bigint, names int, numbers int, gap int, a_common array<string>, b_common array<string>, truncated boolean"


def _compared(pairs: DataFrame, left: DataFrame, right: DataFrame, width: int) -> DataFrame:
    """Agreement levels of names, numbers and time of the candidates that share a name, with both titles' common words."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for a, b, ua, ub, wa, na, ha, ca, wb, ob, cb, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                names, numbers = compare(wa, na, wb, tb, ha, ob)
                if names:
                    out.append((a, b, names, numbers, 2 if abs(ua - ub) * 8 <= width else 1 if abs(ua - ub) * 2 <= width else 0, ca, cb, bool(_CUT.search(tb))))
            cols = list(zip(*out, strict=True)) if out else [[]] * 8
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["a", "b", "names", "numbers", "gap", "a_common", "b_common", "truncated"])

    common = F.filter(F.array_except("words", "names"), lambda w: ~w.rlike(r"\d"))
    a = left.select(F.col("key").alias("a"), F.col("us").alias("us_a"), F.col("words").alias("words_a"), "names", "hot", common.alias("a_common"))
    b = right.select(F.col("key").alias("b"), F.col("us").alias("us_b"), F.col("words").alias("words_b"), "own", common.alias("b_common"), F.col("title").alias("title_b"))
    x = pairs.join(a, "a").join(b, "b").select("a", "b", "us_a", "us_b", "words_a", "names", "hot", "a_common", "words_b", "own", "b_common", "title_b")
    return x.mapInArrow(of, COMPARED)


def link(left: DataFrame, right: DataFrame, max_gap_us: int = 48 * 3_600_000_000, threshold: float = 0.5, least_share: float = 0.0005) -> DataFrame:
    """left, right: id, title, us (instant in microseconds). (left_id, right_id, confidence) of the matches.

    least_share is the share of all matched pairs below which a word's associations are not kept.
    """
    a, b = prepare(left), prepare(right)
    rare = cut(rare_words(a, b))
    a, b = cut(with_names(a, rare, True)), cut(with_names(b, rare, False))  # both sides' names serve blocking, the left ones comparison too
    pairs = saved(_compared(candidates(a, b, max_gap_us), a, b, max_gap_us))
    told = cut(_association(pairs.where("names = 2")))
    total = told.where("a_word = '' and b_word = ''").agg(F.max("n")).first()[0] or 0
    wording = left.sparkSession.sparkContext.broadcast(Wording([tuple(r) for r in told.where(F.col("n") >= max(1, least_share * total)).collect()]))

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [wording.value.level(p, q, t) for p, q, t in zip(*(batch.column(k).to_pylist() for k in (5, 6, 7)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(x, pa.int32())], names=["a", "b", "names", "numbers", "gap", "wording"])

    levelled = cut(pairs.mapInArrow(level, "a bigint, b bigint, names int, numbers int, gap int, wording int"))
    counts = {tuple(r[f] for f in LEVELS): r["n"] for r in levelled.groupBy(*LEVELS).agg(F.count("*").alias("n")).collect()}
    fitted = Patterns(counts)
    posterior = F.create_map(*(F.lit(x) for k, v in fitted.posterior.items() for x in ("".join(map(str, k)), float(v))))
    found = levelled.withColumn("confidence", posterior[F.concat(*LEVELS)]).where(F.col("confidence") >= threshold).select("a", "b", "confidence")
    # the keys are hashes; title and instant decide
    named = found.join(a.select(F.col("key").alias("a"), F.col("title").alias("title_a"), F.col("us").alias("us_a")), "a").join(b.select(F.col("key").alias("b"), F.col("title").alias("title_b"), F.col("us").alias("us_b")), "b")
    la, rb = (side.select(F.col("id").alias(f"{name}_id"), F.trim("title").alias(f"title_{c}"), F.col("us").alias(f"us_{c}")) for side, name, c in ((left, "left", "a"), (right, "right", "b")))
    return named.join(la, ["title_a", "us_a"]).join(rb, ["title_b", "us_b"]).select("left_id", "right_id", "confidence")
