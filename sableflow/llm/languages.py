"""Languages of documents and of their passages, from interpolated Kneser-Ney character models.

One model per language over runs of up to ORDER characters (letters and combining marks in lower case, single spaces,
no digits; capitalised words inside a sentence are left out, as names count for nothing). The n-grams of all languages
share sorted arrays of 64-bit hashes, each with a row of log probabilities, one per language, so a text needs one
lookup per character. A segment (the title, a paragraph) gets the language of the lowest length-normalised
cross-entropy. Its confidence is the posterior of the segment's likelihoods at a temperature fitted on held-out
segments; a segment whose cross-entropy lies above what held-out segments of that language show is rejected ("und").

The models are fitted on a bounded sample of labelled rows (at most `per_label` of each language, whole texts, in the
order of a hash of their keys) plus one built-in sentence per language, in two rounds: segments that the frequencies
of n-grams give another language than their label are left out of the models, which rids the sample of wrong labels
and of foreign passages. Everything else covers all rows and whole texts, in one pass without a shuffle.

Defined results: rows without text still have their title's segment; rows with neither have no segment; segments
without letters, or rejected ones, are "und" and count for no language; repeated rows are judged alike; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sableflow.functions.words import chunks, classes, code_points, mix64

ORDER = 5
LANGUAGES = ("en", "pt", "es", "fr", "de", "ru", "zh", "ja", "hi", "ar")
_SPACE = 32
_FLOOR = np.log(1.0 / 30_000)  # a character no model has seen
_P = np.uint64(0x9E3779B97F4A7C15)

# The first article of the Universal Declaration of Human Rights.
SEED = {
    "en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should act towards one another in a spirit of brotherhood.",
    "pt": "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade.",
    "es": "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros.",
    "fr": "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité.",
    "de": "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geist der Brüderlichkeit begegnen.",
    "ru": "Все люди рождаются свободными и равными в своём достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "ja": "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。人間は、理性と良心とを授けられており、互いに同胞の精神をもって行動しなければならない。",
    "hi": "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए।",
    "ar": "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء.",
}
# Names and three-letter codes of languages.
LABELS = {
    "en": "english eng anglais inglés inglês englisch", "pt": "portuguese por português portugues", "es": "spanish spa español espanol castellano castilian",
    "fr": "french fra fre français francais", "de": "german deu ger deutsch", "ru": "russian rus русский", "zh": "chinese zho chi cmn mandarin 中文 汉语",
    "ja": "japanese jpn 日本語", "hi": "hindi hin हिन्दी हिंदी", "ar": "arabic ara العربية",
}
LABEL_OF = {name: code for code, names in LABELS.items() for name in names.split()} | {code: code for code in LABELS}

PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*|(?:<br\s*/?>\s*){2,}")
_TAG = re.compile(r"<[a-zA-Z/][^<>]{0,80}>|&[a-z]{2,8};|https?://\S+")
_CAPITAL = re.compile(r"(?<=[^\W\d_][\s,;]|[\s,;\d][\s])(?<![.!?:»”\"] )[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*")


def label_code(column):  # noqa: ANN001, ANN201 - Column in, Column out
    """The two-letter code that a label names, null if it names none."""
    plain = F.lower(F.trim(column))
    base = F.regexp_extract(plain, r"^([^\s_-]+)(?:[_-][a-z0-9]{2,8})*$", 1)
    codes = F.create_map(*(F.lit(x) for kv in LABEL_OF.items() for x in kv))
    two = F.when(base.rlike("^[a-z]{2}$") & ~base.isin("xx", "zz"), base)
    return F.coalesce(F.try_element_at(codes, F.coalesce(base, F.lit(""))), two)


_NAME_FIRST = re.compile(r"(?:^|(?<=[.!?:»”\"] ))[A-ZÀ-ÖØ-ÞА-ЯЁ][\w'’-]*(?=\s+(?:[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W\d_]|& ))")


def plain(segment: str) -> str:
    """The segment without markup and, unless it is all in capitals, without capitalised words inside sentences."""
    s = _TAG.sub(" ", segment.replace("\x00", " "))
    if any(map(str.islower, s)) or not any(map(str.isupper, s)):
        s = _CAPITAL.sub(" ", _NAME_FIRST.sub(" ", s))
    return s.lower()


def encode(segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all segments, each led by ORDER - 1 spaces, and where each begins."""
    lead = "\x00" * (ORDER - 1)
    parts = [lead + plain(s) + " " for s in segments]
    raw = code_points("".join(parts))
    begin = np.r_[0, np.cumsum([len(p) for p in parts])][: len(parts)].astype(np.int64)
    cls = classes()[raw]
    digit = (raw >= 48) & (raw <= 57) | (raw >= 0x966) & (raw <= 0x96F) | (raw >= 0x660) & (raw <= 0x669)
    space = ((cls == 0) | digit) & (raw != 0)
    codes = np.where(space | (raw == 0), np.uint32(_SPACE), raw)
    led = raw == 0
    after_space = np.r_[True, (codes[:-1] == _SPACE)]
    keep = led | ~((codes == _SPACE) & after_space)
    return codes[keep], (np.cumsum(keep) - 1)[begin]


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that end at each place (places before n - 1 hold no gram)."""
    h = np.zeros(len(codes), np.uint64)
    x = codes.astype(np.uint64) + np.uint64(1)
    for k in range(n):
        h[n - 1 :] = h[n - 1 :] * _P + x[k : len(codes) - n + 1 + k]
    return mix64(h + np.uint64(n))


class SortedHashes:
    """A sorted array of hashes, entered through its leading bits."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = max(8, min(22, int(len(keys)).bit_length() + 1))
        self.first = np.searchsorted(keys, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)
        self.most = int(np.diff(np.r_[self.first, len(keys)]).max(initial=0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        at, left, last = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)], np.arange(len(h)), len(self.keys) - 1
        for _ in range(self.most):
            key, want = self.keys[np.minimum(at, last)], h if len(left) == len(h) else h[left]
            hit = key == want
            out[left[hit]] = at[hit]
            more = (key < want) & (at < last)
            if not more.any():
                break
            left, at = left[more], at[more] + 1
        return out


class KneserNey:
    """Interpolated Kneser-Ney models of several languages over shared n-grams."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.languages = list(texts)
        n_lang = len(self.languages)
        seen: list[list[tuple]] = [[] for _ in range(ORDER + 1)]  # by order: (keys, contexts, suffixes, counts) of each language
        for language in self.languages:
            codes, starts = encode(texts[language])
            real = np.ones(len(codes), bool)
            real[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
            at = np.flatnonzero(real)
            hashes = {n: gram_hashes(codes, n) for n in range(1, ORDER + 1)}
            keys, first, counts = np.unique(hashes[ORDER][at], return_index=True, return_counts=True)
            places = at[first]
            for n in range(ORDER, 0, -1):
                context = hashes[n - 1][places - 1] if n > 1 else np.zeros(len(places), np.uint64)
                suffix = hashes[n - 1][places] if n > 1 else context
                seen[n].append((keys, context, suffix, counts))
                if n > 1:  # the lower order counts how many different characters come before
                    keys, first, counts = np.unique(suffix, return_index=True, return_counts=True)
                    places = places[first]
        self.grams: list[SortedHashes | None] = [None]
        self.logp: list[np.ndarray | None] = [None]
        self.contexts: list[SortedHashes | None] = [None]
        self.log_gamma: list[np.ndarray | None] = [None]
        lower = None
        for n in range(1, ORDER + 1):
            keys, first = np.unique(np.concatenate([s[0] for s in seen[n]]), return_index=True)
            context = np.concatenate([s[1] for s in seen[n]])[first]
            suffix = np.concatenate([s[2] for s in seen[n]])[first]
            contexts = np.unique(context)
            gamma, p = np.ones((len(contexts), n_lang)), np.zeros((len(keys), n_lang))
            for k, (own, ctx, _, counts) in enumerate(seen[n]):
                n1, n2 = (counts == 1).sum(), (counts == 2).sum()
                discount = n1 / (n1 + 2 * n2) if n1 else 0.5
                slot = np.searchsorted(contexts, ctx)
                total = np.bincount(slot, counts, len(contexts))
                kinds = np.bincount(slot, minlength=len(contexts))
                known = total > 0
                gamma[known, k] = discount * kinds[known] / total[known]
                p[np.searchsorted(keys, own), k] = np.maximum(counts - discount, 0) / total[slot]
            base = np.exp(_FLOOR) if lower is None else lower[np.searchsorted(self.grams[-1].keys, suffix)]
            p += gamma[np.searchsorted(contexts, context)] * base
            lower = p
            self.grams.append(SortedHashes(keys))
            self.logp.append(np.log(p).astype(np.float32))
            self.contexts.append(SortedHashes(contexts))
            self.log_gamma.append(np.log(gamma).astype(np.float32))

    def scores(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sum of log probabilities under each language (rows: segments) and number of characters."""
        codes, starts = encode(segments)
        if not len(codes):
            return np.zeros((len(segments), len(self.languages)), np.float32), np.zeros(len(segments), np.int64)
        real = np.ones(len(codes), bool)
        real[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
        at = np.flatnonzero(real)
        row = self.grams[ORDER].find(gram_hashes(codes, ORDER)[at])
        logp = self.logp[ORDER][row]
        rest = np.flatnonzero(row < 0)
        if len(rest):
            total = np.zeros((len(rest), len(self.languages)), np.float32)
            todo, places = np.arange(len(rest)), at[rest]
            for n in range(ORDER, 0, -1):
                context = gram_hashes_at(codes, places[todo] - 1, n - 1)
                c = self.contexts[n].find(context)
                total[todo[c >= 0]] += self.log_gamma[n][c[c >= 0]]
                if n == 1:
                    total[todo] += _FLOOR
                    break
                g = self.grams[n - 1].find(gram_hashes_at(codes, places[todo], n - 1))
                total[todo[g >= 0]] += self.logp[n - 1][g[g >= 0]]
                todo = todo[g < 0]
                if not len(todo):
                    break
            logp[rest] = total
        sizes = np.diff(np.r_[starts, len(codes)]) - (ORDER - 1)
        out = np.zeros((len(segments), len(self.languages)), np.float32)
        full = sizes > 0
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        if full.any():
            out[full] = np.add.reduceat(logp, begin[full], axis=0)
        letters = np.zeros(len(segments), np.int64)
        if full.any():
            letters[full] = np.add.reduceat((codes[at] != _SPACE).astype(np.int64), begin[full])
        return out, letters


def gram_hashes_at(codes: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """As gram_hashes, at some places only."""
    if n == 0:
        return np.zeros(len(places), np.uint64)
    h = np.zeros(len(places), np.uint64)
    for k in range(n):
        h = h * _P + (codes[places - n + 1 + k].astype(np.uint64) + np.uint64(1))
    return mix64(h + np.uint64(n))


def _trusted(labelled: list[tuple[str, str]], n: int = 3) -> np.ndarray:
    """Which segments fit their label best by plain frequencies of n-grams.

    Conditional models would not do here: trained on a language with a tenth of English in it, they predict English as
    well as an English model does. Frequencies count that tenth as a tenth.
    """
    codes, starts = encode([s for _, s in labelled])
    keys, gram = np.unique(gram_hashes(codes, n), return_inverse=True)
    sizes = np.diff(np.r_[starts, len(codes)])
    label = np.array([LANGUAGES.index(c) for c, _ in labelled])
    counts = np.zeros((len(keys), len(LANGUAGES)))
    np.add.at(counts, (gram, np.repeat(label, sizes)), 1)
    logp = np.log((counts + 0.1) / (counts + 0.1).sum(axis=0))
    score = np.add.reduceat(logp[gram], starts, axis=0)
    return _clear(score, label)


def _clear(score: np.ndarray, label: np.ndarray, margin: float = 12.0) -> np.ndarray:
    """Whether the label's score beats every other by the margin (natural logarithm)."""
    own = score[np.arange(len(label)), label]
    rest = score.copy()
    rest[np.arange(len(label)), label] = -np.inf
    return own >= rest.max(axis=1) + margin


class Identifier:
    """Models with their calibration: temperature of the posterior, and highest acceptable cross-entropy by language and length."""

    def __init__(self, labelled: list[tuple[str, str]]) -> None:
        """labelled: (language, segment); the built-in sentences stand in for languages without any."""
        flat = [(c, SEED[c]) for c in LANGUAGES] + labelled
        clean = [x for x, ok in zip(flat, _trusted(flat), strict=True) if ok]
        if labelled:  # once more, by what the models themselves say
            score, _ = self._model(clean).scores([s for _, s in clean])
            clean = [x for x, ok in zip(clean, _clear(score, np.array([LANGUAGES.index(c) for c, _ in clean])), strict=True) if ok]
        # a model without every fifth segment tells what the segments it has not seen cost; with none to spare, the built-in sentences are cut in two
        held = clean[::5] if labelled else [(c, t[len(t) // 2 :]) for c, t in clean]
        self.model = self._model([x for i, x in enumerate(clean) if i % 5] if labelled else [(c, t[: len(t) // 2]) for c, t in clean], seeds=bool(labelled))
        self.temperature = 4.0
        self._calibrate(held)
        if not labelled:
            self.model = self._model(clean)

    @staticmethod
    def _model(rows: list[tuple[str, str]], seeds: bool = True) -> KneserNey:
        return KneserNey({c: [SEED[c]] * seeds + [s for k, s in rows if k == c] for c in LANGUAGES})

    def _calibrate(self, held: list[tuple[str, str]]) -> None:
        total, n = self.model.scores([s for _, s in held])
        truth = np.array([LANGUAGES.index(c) for c, _ in held])
        ok = n > 0
        total, truth, n = total[ok].astype(np.float64), truth[ok], n[ok]

        def loss(t: float) -> float:
            z = total / t
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            return -np.log(p[np.arange(len(z)), truth] / p.sum(axis=1) + 1e-12).mean()

        self.temperature = min((2.0, 3.0, 4.0, 6.0, 8.0, 12.0), key=loss)
        # held-out segments of n letters cost level[k] a letter, give or take a spread that falls with sqrt(n); three times what all but one in a hundred
        # (whose label may be wrong) exceed it by is rejected
        entropy = -total[np.arange(len(truth)), truth] / n
        self.level = np.full(len(LANGUAGES), np.average(entropy, weights=n))
        for k in range(len(LANGUAGES)):
            if (truth == k).any():
                self.level[k] = np.average(entropy[truth == k], weights=n[truth == k])
        over = (entropy - self.level[truth]) * np.sqrt(n)
        self.reach = 3.0 * max(float(np.quantile(over, 0.99)), 3.0)

    def judge(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Language number (-1: rejected), confidence, cross-entropy and letters of each segment."""
        total, n = self.model.scores(segments)
        z = total.astype(np.float64) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        entropy = -total[np.arange(len(best)), best] / np.maximum(n, 1)
        rejected = (n == 0) | (entropy > self.level[best] + self.reach / np.sqrt(np.maximum(n, 1)))
        return np.where(rejected, -1, best), np.where(rejected, 0.0, p[np.arange(len(best)), best]), entropy, n


def segments_of(title: str | None, text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the title and of every paragraph of the text."""
    out = [("title", 0, len(title))] if title and title.strip() else []
    at = 0
    for cut in [*(m.span() for m in PARAGRAPH.finditer(text)), (len(text), len(text))] if text else []:
        if text[at : cut[0]].strip():
            out.append(("text", at, cut[0]))
        at = cut[1]
    return out


def fit(labelled_rows: DataFrame, per_label: int = 200) -> Identifier:
    """labelled_rows: id, title, text, label (two-letter code or null). Collects at most per_label rows of each language.

    The labels are counted first; the rows are then those whose hash lies in the share of the hash range that holds
    per_label of them, so one scan finds them and the driver gets no more.
    """
    rows = labelled_rows.where(F.col("label").isin(*LANGUAGES))
    counts = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Identifier([])
    share = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, int(min(1.0, 1.1 * per_label / n) * (1 << 62)))))
    h = F.shiftrightunsigned(F.xxhash64("id"), 2)
    near = rows.withColumn("h", h).where(F.col("h") <= share[F.col("label")]).where("text is not null and text != ''")
    found = near.select("label", "h", "title", "text").limit(2 * per_label * len(LANGUAGES)).collect()
    picked = []
    for language in LANGUAGES:
        own = sorted((r for r in found if r.label == language), key=lambda r: r.h)[:per_label]
        picked += [(language, r.title, r.text) for r in own]
    labelled = []
    for language, title, text in picked:
        for kind, a, b in segments_of(title, text):
            labelled.append((language, (title if kind == "title" else text)[a:b]))
    return Identifier(labelled)


SEGMENT_ROWS = "id bigint, kind string, start_pos bigint, end_pos bigint, lang string, confidence double, cross_entropy double, letters bigint"


def identify(rows: DataFrame, identifier: Identifier) -> DataFrame:
    """rows: id, title, text. One row per segment with its language ("und" if rejected) and confidence."""
    shared = rows.sparkSession.sparkContext.broadcast(identifier)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, titles, texts = (c.to_pylist() for c in batch.columns)
            for a, b in chunks([t or "" for t in texts]):
                place = [(ids[i], *s, (titles[i] if s[0] == "title" else texts[i])[s[1] : s[2]]) for i in range(a, b) for s in segments_of(titles[i], texts[i])]
                lang, conf, entropy, letters = shared.value.judge([p[4] for p in place]) if place else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0] for p in place], pa.int64()), pa.array([p[1] for p in place], pa.string()),
                        pa.array([p[2] for p in place], pa.int64()), pa.array([p[3] for p in place], pa.int64()),
                        pa.array([LANGUAGES[k] if k >= 0 else "und" for k in lang], pa.string()), pa.array(np.asarray(conf, np.float64)),
                        pa.array(np.asarray(entropy, np.float64)), pa.array(np.asarray(letters, np.int64)),
                    ],
                    names=["id", "kind", "start_pos", "end_pos", "lang", "confidence", "cross_entropy", "letters"],
                )

    return rows.select("id", "title", "text").mapInArrow(of, SEGMENT_ROWS)


def documents_languages(segments: DataFrame, sure: float = 0.95, least_letters: int = 8) -> DataFrame:
    """(id, lang, letters, confidence): the languages really present in each document. A character of Chinese or Japanese says as much as two letters.

    A document without any sure segment has the language with the most letters by confidence, at the confidence that it has; "und" at 0 if all are rejected.
    """
    weight = F.when(F.col("lang").isin("zh", "ja"), 2 * F.col("letters")).otherwise(F.col("letters"))
    good = (F.col("lang") != "und") & (F.col("confidence") >= sure) & (weight >= least_letters)
    each = segments.groupBy("id", "lang").agg(
        F.sum(F.when(good, F.col("letters"))).alias("letters"), F.max(F.when(good, F.col("confidence"))).alias("confidence"),
        F.sum(F.col("letters") * F.col("confidence")).alias("told"), F.sum("letters").alias("all_letters"),
    )
    found = each.groupBy("id").agg(
        F.collect_list(F.when(F.col("letters").isNotNull(), F.struct("lang", "letters", "confidence"))).alias("sure"),  # at most ten languages
        F.max(F.struct(F.col("told"), F.col("lang"), F.col("all_letters").alias("letters"), F.coalesce(F.col("told") / F.nullif("all_letters", F.lit(0)), F.lit(0.0)).alias("confidence"))).alias("best"),
    )
    best = F.array(F.struct(F.col("best.lang").alias("lang"), F.col("best.letters").alias("letters"), F.col("best.confidence").alias("confidence")))
    return found.select("id", F.explode(F.when(F.size("sure") > 0, F.col("sure")).otherwise(best)).alias("x")).select("id", "x.lang", "x.letters", "x.confidence")


def relabel(rows: DataFrame, per_label: int = 200) -> DataFrame:
    """rows: id, title, text, label (as stored). (id, lang, confidence) for rows whose label is absent or wrong, or that are mixed.

    Only rows with a text are judged.
    """
    rows = rows.where("text is not null and text != ''").withColumn("code", label_code(F.col("label")))
    identifier = fit(rows.select("id", "title", "text", F.col("code").alias("label")), per_label)
    present = documents_languages(identify(rows, identifier))
    count = present.groupBy("id").agg(F.collect_list(F.struct("lang", "confidence")).alias("langs"))  # at most ten languages
    joined = count.join(rows.select("id", "code"), "id")
    wrong = (F.size("langs") > 1) | F.col("code").isNull() | (F.col("code") != F.col("langs")[0]["lang"])
    return joined.where(wrong).select("id", F.explode("langs").alias("x")).select("id", "x.lang", "x.confidence")
