"""Sentences of documents in spaced and spaceless scripts, with their places.

A paragraph (between blank lines) always ends a sentence. Inside a paragraph every run of marks (. ! ? ... and their
relatives of other scripts, with closing quotes and brackets) is a node of a lattice with two arcs, ending and going on.
Each arc has a cost from what stands on both sides of the gap, and the cheapest path through the paragraph gives its
sentences. The costs are log-odds, added up from

* the token before the mark: number, initial, title, unit, dotted abbreviation, or a token that the documents write
  with a point where nothing can end;
* the word after it: its case, and how much more often the documents open sentences with it, or write it small, than
  they write it with a capital in the middle of one;
* for spaceless scripts, the words on both sides by the cheapest path through a dictionary lattice: final particles
  before the gap, opening words and words that go on after it. The dictionary holds closed classes of words and the
  beginnings of sentences and clauses learned from the documents.

The statistics need no labels: they are counted once over all documents, at openings that are sure (paragraphs, after
! ? 。 and after a long word with a point) and in the middle of clauses, and words below `least_share` of all counted
words are left out, so the model has at most 1 / least_share of them.

Marks inside quotations and brackets, which are paired by a stack whatever their length, end nothing; a quotation that
ends with a mark of its own ends the sentence unless the sentence runs on behind it.

Defined results: null, empty and blank texts have no sentences; places count Unicode code points of the text as it is;
a paragraph without letters or digits still is a sentence; repeated rows give repeated results; a text of any length is
handled paragraph by paragraph, in time linear in its length; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations, by what may follow them.
# A name or another part of the same expression follows: never an end.
TITLES = frozenset(
    "mr mrs ms dr av avda prof gen sen rep gov sgt capt lt col rev hon st ste mt ft messrs "  # en
    "mme mlle mm m me mgr "  # fr
    "sr sra srta dra dr d dña dna ing lic arq prof profa exmo exma ee "  # es, pt
    "hr fr frl vgl bzw bspw z u d ca geb evtl ggf inkl zzgl abs "  # de
    "см ср гр г-н г-жа им акад проф доц "  # ru
    "डॉ श्री श्रीमती प्रो पं कु "  # hi
    "د أ م ص ".split()  # ar
)
# A number follows; before anything else they end like other words.
NUMBERED = frozenset(
    "no nos nr fig figs p pp pg pag pág págs art arts sec ch vol ed par cap eq tab s h v vs cf env aprox approx ca núm num nº n "
    "jan feb mar apr jun jul aug sep sept oct nov dec п пп стр ст рис табл гл ч т № पृ ص".split()
)
# They stand before lower case or at the end of a sentence.
UNITS = frozenset("inc co corp ltd bros cie ltda uu etc usw a.m p.m jr sr sa s.a plc llc gmbh ag t млн тыс млрд руб др пр т.е т.д т.п".split())
# Parts of company names that go on after an abbreviation.
FOLLOWERS = frozenset("GmbH AG KG SE Cie Ltda Ltd Inc Corp Co Bros S.A SA LLC PLC Jr Sr UU".split())
# Words of closed classes that open a sentence (articles, prepositions, pronouns, conjunctions, question words).
OPENERS = frozenset(
    "The A An In On At It He She They We This That These Those But And For By From With As If When While What Who How Why There Here "
    "Le La Les L' Un Une Des Il Elle En Dans Nous Ils On Ce Cette El Los Las Una Uno Es No O Os Um Uma Na Ele Ela Der Die Das Ein Eine Im Am Was Wer Nach Seit Er Sie Wir Es "
    "В На По Как Какой Какая Кто Что Это Но И А Мы Он Она Они Я Вы Так С У За Для После".split()
)
GERMAN_ORDINALS = frozenset("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Mal Woche Tag Tage Monat Jahr Jahrhundert Quartal Saison Platz Stock Etage Auflage Klasse Kapitel Artikel Absatz".split())
# Spaceless scripts: words that go on after a quotation, reporting words, final particles, words that open a sentence.
GO_ON = frozenset("と って という といった などと などの との は が を に の も で から へ 这让 让 使 令 这 的 是 等 然后 就 便 并 又 还 才 而 接着 之后".split())
REPORTING = frozenset("说 表示 称道 写道 问道 问 回答 指出 認めた 述べ 語っ 話し 言っ 答え 尋ね 報じ".split())
FINAL = frozenset("た だ る です ます ません か のか よ ね 了 吗 呢 吧 啊".split())
OPENING = frozenset("在 据 与 自 由 应 他们 我们 他 她 它 我 连续 尽管 谁 第 但 誰 しかし そして また ただ 彼 彼女 私 我々".split())

BLANK = re.compile(r"\n[^\S\n]*\n\s*")
_MARK = re.compile(r"[.!?…。！？｡．।॥؟۔]+")
_CLOSERS = re.compile(r"(?:[\"'”’»」』）)\]]|[   ]»)+")
_TOKEN = re.compile(r"[^\s\"“”«»„‘(\[（「『—–]*$")
_NEXT = re.compile(r"[^\W_]+(?:\.[^\W\d_](?![^\W_]))*")
_SPACELESS = re.compile("[぀-ヿ㐀-䶿一-鿿豈-﫿！？。，、]")
_GERMAN = re.compile(r"\b(?:der|die|das|und|im|am|mit|bei|zum|ein|eine|in)\b")
_OPENING_MARKS = "\"“«„¿¡「『（(‘'[—–-"
_PAIRS = {")": "(", "]": "[", "）": "（", "」": "「", "』": "『", "»": "«", "”": "“„", "“": "„"}
_QUOTES = re.compile(r"[\"“”„«»「」『』（）()\[\]]")
_HAN = r"[぀-ヿ㐀-䶿一-鿿豈-﫿]"
# openings that are sure, and the middle of clauses, in spaced and spaceless scripts
_SURE = [re.compile(x + r"([^\W\d_]+)") for x in (r"\A\s*", r"\n[^\S\n]*\n\s*", r"[!?।؟]\s+", r"\.(?<=[^\W\d_]{5}\.)\s+")]
_INNER = re.compile(r"(?<=[\w,;:]\s)[^\W\d_]+")
_DOTTED = re.compile(r"\.(?=\s+(?:[a-zа-яà-ÿ]{2}|[,;:)]))")
_SURE_HAN = [re.compile(x + f"({_HAN}{{1,4}})") for x in (r"\A\s*", r"\n[^\S\n]*\n\s*", "[。！？](?![”」』）])")]
_INNER_HAN = [re.compile(f"[，、：；]({_HAN}{{1,4}})")]
_HAN_ONE, _STOP, _SOLID, _LETTER = re.compile(_HAN), re.compile("[。！？]"), re.compile(r"\S"), re.compile(r"[^\W_]")
_DOTS = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]")
_LONGEST = 24  # no abbreviation of a list is longer
_ALSO_WORD = 12.0  # the cost of a character that no word of the dictionary covers


@dataclass
class Marks:
    """What the documents tell about words at gaps: log-odds of opening a sentence, of a point belonging to the token, and costs of spaceless words."""

    opens: dict[str, float] = field(default_factory=dict)
    dotted: dict[str, float] = field(default_factory=dict)
    words: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        known = GO_ON | REPORTING | FINAL | OPENING
        self.words = dict.fromkeys(known, 6.0) | {w: min(c, 6.0) if w in known else c for w, c in self.words.items()}
        self.longest = max(map(len, self.words))

    def opening(self, word: str) -> float:
        """Log-odds that a gap before this word (with a capital, where there are any) is an opening."""
        prior = 3.0 if word in OPENERS or word in OPENING else 0.0
        return prior + self.opens.get(word, 0.0)

    def segmented(self, text: str) -> list[str]:
        """The cheapest path through the dictionary lattice of a spaceless text; characters outside of all words are words by themselves."""
        n = len(text)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
        for i in range(n):
            here = best[i][0]
            for j in range(i + 1, min(n, i + self.longest) + 1):
                cost = self.words.get(text[i:j], _ALSO_WORD if j == i + 1 else math.inf)
                if here + cost < best[j][0]:
                    best[j] = (here + cost, i)
        out, j = [], n
        while j:
            i = best[j][1]
            out.append(text[i:j])
            j = i
        return out[::-1]


GENERAL = Marks()
COUNTS = "kind string, word string, n bigint"


def _counts(texts: list[str]) -> Counter:
    """Of (kind, word): o: at sure openings, i: in the middle, d: with a point where nothing ends; O, I: the same for spaceless scripts."""
    out: Counter = Counter()
    inner: Counter = Counter()
    for text in texts:
        inner.update(_INNER.findall(text))
        out.update(("o", w) for form in _SURE for w in form.findall(text))
        for m in _DOTTED.finditer(text):
            token = text[max(m.start() - _LONGEST, 0) : m.start()].split()[-1:]
            out.update(("d", t.lower()) for t in token if t.isalnum() and t[0].isalpha() and len(t) < 7)
        if _SPACELESS.search(text):
            for kind, forms in (("O", _SURE_HAN), ("I", _INNER_HAN)):
                out.update((kind, w[:k]) for form in forms for w in form.findall(text) for k in range(1, len(w) + 1))
    out.update({("i", w): n for w, n in inner.items()})
    return out


def fit_marks(documents: DataFrame, least_share: float = 1e-5) -> Marks:
    """documents: text. Counted over all documents; the driver gets words with at least `least_share` of all counts of their kind, so 1 / least_share of each at most."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            count.update(_counts([t for t in batch.column(0).to_pylist() if t]))
            if len(count) > 500_000:
                yield _counted(count)
                count = Counter()
        yield _counted(count)

    counts = documents.select("text").mapInArrow(of, COUNTS).groupBy("kind", "word").agg(F.sum("n").alias("n")).persist()
    try:
        total = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
        least = F.create_map(*(F.lit(x) for k in "oidOI" for x in (k, max(total.get(k, 0) * least_share, 1.0))))
        rows = counts.where(F.col("n") >= least[F.col("kind")]).collect()
    finally:
        counts.unpersist()
    return _marks(rows)


def _counted(count: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in count], pa.string()), pa.array([w for _, w in count], pa.string()), pa.array(list(count.values()), pa.int64())], names=["kind", "word", "n"])


def _marks(rows: list) -> Marks:
    n: dict[str, Counter] = {k: Counter() for k in "oidOI"}
    for r in rows:
        n[r.kind][r.word] += r.n
    o, i, big, small = n["o"], n["i"], n["O"], n["I"]
    opens = {}
    for w in o.keys() | i.keys():
        if w[0].isupper():
            opens[w] = math.log((o[w] + i[w.lower()] + 0.5) / (i[w] + 0.5))
    total_open, total_inner = max(sum(big.values()), 1), max(sum(small.values()), 1)
    for w in big.keys() | small.keys():
        opens[w] = math.log((big[w] + 0.5) / (total_open + 0.5) * (total_inner + 0.5) / (small[w] + 0.5))
    dotted = {w: math.log((c + 0.5) / (max(0, i[w] + i[w.capitalize()] - c) + 0.5)) for w, c in n["d"].items()}  # the inner ones hold those with a point
    total = total_open + total_inner
    return Marks(opens, dotted, {w: -math.log((big[w] + small[w]) / total) for w in big.keys() | small.keys() if big[w] + small[w] > 1 and len(w) > 1})


class Paragraph:
    """The lattice of one paragraph."""

    def __init__(self, text: str, model: Marks) -> None:
        self.text, self.model = text, model
        self.scanned = self.token_at = 0
        self.since = 0  # the end of the last mark that more likely ends a sentence

    def spans(self) -> list[tuple[int, int]]:
        """Outermost quotations and brackets, paired by a stack. Marks without a partner count for nothing."""
        stack: list[tuple[str, int]] = []
        held: Counter = Counter()
        pairs: list[tuple[int, int]] = []
        for m in _QUOTES.finditer(self.text):
            c = m[0]
            openers = '"' if c == '"' else _PAIRS.get(c, "")
            if any(held[o] for o in openers):
                while True:
                    o, at = stack.pop()
                    held[o] -= 1
                    if o in openers:
                        break
                pairs.append((at, m.end()))
            elif c == '"' or c == "“" or c not in _PAIRS:
                stack.append((c, m.start()))
                held[c] += 1
        pairs.sort()
        out: list[tuple[int, int]] = []
        for a, b in pairs:
            if not out or a >= out[-1][1]:
                out.append((a, b))
        return out

    def token(self, start: int) -> int:
        """Where the token before the mark at `start` begins. Marks come in order, and every part of the text is scanned once."""
        near = max(self.scanned, start - 48)
        at = _TOKEN.search(self.text, near, start).start()
        if at == near > self.scanned:
            at = _TOKEN.search(self.text, self.scanned, start).start()
        if at > self.scanned:
            self.token_at = at
        self.scanned = start
        return self.token_at

    def nodes(self) -> Iterator[tuple[int, int, float]]:
        """(start, end, log-odds of ending there) of every mark outside of quotations and brackets."""
        para = self.text
        last = len(para.rstrip())
        spans, k, at = self.spans(), 0, 0
        while m := _MARK.search(para, at):
            start, stop = m.span()
            at, mark, opened = stop, m[0], -1
            while k < len(spans) and spans[k][1] <= start:
                k += 1
            if k < len(spans) and spans[k][0] < start:
                if not (c := _CLOSERS.match(para, stop)) or c.end() < spans[k][1]:
                    continue  # inside
                stop = at = c.end()
                opened = spans[k][0]
            elif c := _CLOSERS.match(para, stop):
                opens = next((a for a, _ in spans[k : k + 2] if a >= stop), len(para))  # a straight quote may open the next sentence
                stop = at = min(c.end(), max(stop, opens))
            if stop >= last:
                return
            if opened > 0 and para[opened] in "(（[" and para[:opened].rstrip()[-1:] not in ".!?。！？":
                continue  # a bracket inside a running sentence
            odds = self.odds(start, mark, stop, opened >= 0)
            if odds > 0:
                self.since = stop
            yield start, stop, odds

    def ends(self) -> list[int]:
        """The ends of the sentences on the cheapest path through the lattice; the last is the end of the last character."""
        last = len(self.text.rstrip())
        if not last:
            return []
        costs, back, places, before = (0.0, math.inf), [], [], 0  # the last node ends a sentence, or it doesn't
        for start, stop, odds in self.nodes():
            ending, going = math.log1p(math.exp(-odds)), math.log1p(math.exp(odds))
            empty = 0.0 if _LETTER.search(self.text, before, start) else 2.0  # a sentence without a letter or digit
            end, go = min((costs[0] + empty, 0), (costs[1], 1)), min((costs[0], 0), (costs[1], 1))
            costs = (end[0] + ending, go[0] + going)
            back.append((end[1], go[1]))
            places.append(stop)
            before = stop
        out, state = [last], int(costs[1] < costs[0])
        for stop, (end, go) in zip(reversed(places), reversed(back), strict=True):
            if state == 0:
                out.append(stop)
            state = go if state else end
        return out[::-1]

    def odds(self, start: int, mark: str, stop: int, quoted: bool) -> float:
        para = self.text
        spaceless = mark[-1] in "。！？｡．" or bool(_SPACELESS.match(para, stop)) or (para[stop - 1] in "」』）”" and bool(_SPACELESS.match(para, start - 1)))
        if spaceless and (mark[0] != "." or len(mark) > 1):
            return self.spaceless(start, mark, stop, quoted)
        i = stop
        while para[i].isspace():
            i += 1
        if mark == ".":
            return self.after_space(start, i, quoted) if i > stop else self.without_space(start, stop, quoted)
        c = para[i]
        if c.islower() or c in ",;:%)]»”":
            return -4.0
        if c in "—–-":
            return 4.0 if not quoted and self.large_after_dash(i) else -4.0
        if i == stop:
            return 4.0 if mark[-1] in "।॥؟۔!?" and (c.isalpha() or c in _OPENING_MARKS or c.isdigit() and mark[-1] in "।॥؟") else -4.0
        return -4.0 if mark[0] in ".…" and c.isdigit() else 4.0

    def large_after_dash(self, i: int) -> bool:
        m = _SOLID.search(self.text, i + 1)
        return bool(m) and m[0].isupper()

    def run(self, at: int, step: int) -> str:
        """The unbroken run of spaceless letters from a gap on, or up to it."""
        i = at
        while self.since <= i - (step < 0) and i - (step < 0) < len(self.text) and _HAN_ONE.match(self.text, i - (step < 0)):
            i += step
        return self.text[min(at, i) : max(at, i)]

    def spaceless(self, start: int, mark: str, stop: int, quoted: bool) -> float:
        para, model = self.text, self.model
        i = stop
        while para[i].isspace():
            i += 1
        after = model.segmented(self.run(i, 1)) or [para[i]]
        if quoted:
            if after[0] in GO_ON:
                return -4.0
            m = _STOP.search(para, i)
            told = model.segmented(para[i : m.start() if m else len(para)])
            return -4.0 if not REPORTING.isdisjoint(told) else 4.0
        if "…" in mark or mark.startswith(".."):
            before = model.segmented(self.run(start, -1))
            final = 1.5 if before and before[-1] in FINAL else -3.0
            return final + max(-3.0, min(3.0, model.opening(after[0])))
        return 4.0

    def word_before(self, start: int) -> tuple[int, int, str]:
        """Start and length of the token before a mark, and in small letters what stands in it after an apostrophe, if it can be in a list."""
        at = max(self.token(start), self.since)
        n = start - at
        tail = max(at, self.text.rfind("'", at, start) + 1, self.text.rfind("’", at, start) + 1)  # L'art., d’env.
        return at, n, self.text[tail:start].lower() if start - tail <= _LONGEST else ""

    def without_space(self, start: int, stop: int, closed: bool) -> float:
        """A missing space, or the inside of a number, an abbreviation, an address."""
        para = self.text
        at, n, low = self.word_before(start)
        c, last = para[stop], para[start - 1 : start]
        solid = n > 0 and (last.islower() or last.isdigit())
        if c in _OPENING_MARKS and not closed and n > 1:
            return 4.0 if low in UNITS or low not in TITLES and solid else -4.0
        if closed or not c.isalpha() or not n:
            return -4.0
        if c.isupper():
            rest = para[stop + 1 : stop + 2]
            if n < 2 and not last.isdigit() or para.find(".", at, start) >= 0 or low in TITLES or not (rest.islower() or rest in ("'", "’", " ")):
                return -4.0
            return 4.0 if solid or low in UNITS else -4.0
        return 4.0 if not c.islower() and n > 2 and low not in TITLES and not para[at:start].isascii() else -4.0

    def after_space(self, start: int, i: int, closed: bool) -> float:
        """The point of a token, or the end of a sentence, before the word at i."""
        para, model = self.text, self.model
        at, n, low = self.word_before(start)
        token, c = para[at:start], para[i]
        if c.islower() or c in ",;:%)]»”":
            return -4.0
        if c in "—–-" and para[i + 1 : i + 2].isspace():
            return 4.0 if self.large_after_dash(i) else -4.0
        if low in TITLES and not (low == "p" and c.isdigit()):
            return -5.0
        if c.isdigit():
            return -4.0 if low in NUMBERED or low.rsplit(".", 1)[-1] in NUMBERED or len(low) == 1 and low.isalpha() else 4.0
        word = m[0] if (m := _NEXT.match(para, i)) else ""
        if token.isupper() and n > 1 and len(word) > 1 and word.isupper() and (low in UNITS or low in TITLES):
            return model.opening(word.capitalize()) - 1.0  # all in capitals, which then tell nothing
        if low in ("млн", "тыс", "млрд", "т.е", "mio", "mrd", "г", "гг"):  # they mostly stand before small letters and names
            return model.opening(word) - 0.3
        if low in UNITS:
            return -4.0 if word in FOLLOWERS else 3.0
        if low.isdigit() and word in GERMAN_ORDINALS and _GERMAN.search(para):
            return -4.0
        if n == 1 and token.isalpha() and token.isupper():  # an initial
            return -4.0
        if n <= _LONGEST and _DOTS.fullmatch(low):  # U.S., i.e, z.B
            return 4.0 if c in _OPENING_MARKS else model.opening(word) + 0.5
        if n == 1 and token in "vzus":
            return -4.0
        return 4.0 + min(0.0, -2.0 * model.dotted.get(low, 0.0) + max(0.0, model.opening(word)))


def paragraph_ends(para: str, model: Marks = GENERAL) -> list[int]:
    """The ends of the sentences of one paragraph; the last is the end of its last character."""
    return Paragraph(para, model).ends()


def sentence_spans(text: str, model: Marks = GENERAL) -> list[tuple[int, int]]:
    """(start, end) of every sentence, without outer white space."""
    out, at = [], 0
    for cut in [*(m.span() for m in BLANK.finditer(text)), (len(text), len(text))]:
        para = text[at : cut[0]]
        start = 0
        for end in paragraph_ends(para, model):
            while start < end and para[start].isspace():
                start += 1
            if start < end:
                out.append((at + start, at + end))
            start = end
        at = cut[1]
    return out


def split_sentences(documents: DataFrame, with_text: bool = False, model: Marks | None = None) -> DataFrame:
    """documents: doc_id, text. One row per sentence: doc_id, sent_no (from 1), start_pos, end_pos[, sentence].

    The model is fitted on the documents, unless one is given.
    """
    marks = documents.sparkSession.sparkContext.broadcast(model or fit_marks(documents))
    names = ["doc_id", "sent_no", "start_pos", "end_pos"] + ["sentence"] * with_text

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                spans = sentence_spans(text, marks.value)
                rows[0] += [i] * len(spans)
                rows[1] += range(1, len(spans) + 1)
                rows[2] += [a for a, _ in spans]
                rows[3] += [b for _, b in spans]
                if with_text:
                    rows[4] += [text[a:b] for a, b in spans]
                if len(rows[0]) > 50_000:
                    yield _batch(rows, names)
                    rows = [[] for _ in names]
            yield _batch(rows, names)

    schema = "doc_id bigint, sent_no int, start_pos bigint, end_pos bigint" + ", sentence string" * with_text
    return documents.select("doc_id", "text").where("text is not null and text != ''").mapInArrow(of, schema)


def _batch(rows: list[list], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=False)], names=names)
