"""Evaluation items leaking into documents, by the q-gram lemma on diagonal bands.

Texts are read as streams of word characters (case, punctuation and spacing gone). An edit of a word of w characters
destroys at most w + q - 1 of the q-grams of a part of an item, so a part within its edit budget shares at least a
known number of q-grams with its copy. A part of twice `part` words or more within the budget has a half within it, so
only the parts where the budget allows one more edit, up to that length, set the bounds.

Every edit moves the copy by no more than the longest pair of item words: longer document words equal none and no two
glued ones, so they count as one place. Therefore all shared q-grams of a copy lie within (edits) * (that length) of
one diagonal (place in the document minus place in the item). They are counted in diagonal bands twice as wide, each
overlapping its neighbours by half; bands below the item's bound are dropped. The rest are verified by a banded
alignment of words, which finds out exactly whether some continuous part of at least `part` item words lies in the
document with at most `edits` of its words changed, dropped or added. Words that spacing has glued or torn apart in two
align without cost. The alignment runs in a narrow band of word diagonals first and, where that finds nothing, in one
as wide as all edits and all glued or torn words outside of shared q-grams can reach.

The items are a stated query set: they are handed to all tasks in blocks of at most `block` characters (and 60,000
items), and documents are read once for each block. Nothing is shuffled.

Defined results: null, empty and too short texts on either side leak nothing, unless the whole item is shorter than
`part` words, which then counts when all of it is there; repeated items are found each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sableflow.functions.words import _P, _powers, chunks, classes, code_points, mix64, words

FOUND = "doc_id bigint, item_id bigint"


@dataclass(frozen=True)
class Settings:
    part: int = 20
    part_single: int = 30
    edits: float = 0.1
    q: int = 10
    q_single: int = 5

    @property
    def rate(self) -> Fraction:
        return Fraction(self.edits).limit_denominator(1000)

    def budget(self, n: int) -> int:
        """Edits that a part of n words may have."""
        return int(n * self.rate)

    def lengths(self, part: int) -> list[int]:
        """Of the parts of `part` words to twice as many, the shortest for each budget: any longer one holds one of them."""
        return [n for n in range(part, 2 * part) if n == part or self.budget(n) > self.budget(n - 1)]


class Stream:
    """Word characters of several texts in a row, and where words and texts begin."""

    def __init__(self, texts: list[str]) -> None:
        _, owner, first, last = words(texts)
        codes = code_points("\n".join(t.lower() for t in texts) + "\n")
        cls = classes()[codes]
        keep = cls > 0
        self.codes, self.single = codes[keep], cls[keep] == 2
        length = last - first
        self.word_at = np.r_[0, np.cumsum(length)].astype(np.int64)  # start of each word in the stream
        self.word_owner = owner
        self.word_of = np.repeat(np.arange(len(first)), length)
        powers, self._inverse = _powers(max(20, int(len(self.codes)).bit_length()))
        self._total = np.r_[np.uint64(0), np.cumsum(self.codes.astype(np.uint64) * powers[: len(self.codes)])]
        self.text_at = np.searchsorted(owner, np.arange(len(texts) + 1))  # first word of each text
        self.words = self.piece(self.word_at[:-1], self.word_at[1:])
        self.pairs = np.zeros_like(self.words)  # a word and the next, glued
        if len(self.words) > 1:
            self.pairs[:-1] = np.where(owner[1:] == owner[:-1], self.piece(self.word_at[:-2], self.word_at[2:]), np.uint64(0))

    def piece(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((self._total[b] - self._total[a]) * self._inverse[a] + (b - a).astype(np.uint64) * np.uint64(_P))

    def grams(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and place of every q-gram inside one text."""
        n = len(self.codes) - q + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        at = np.arange(n)
        own = self.word_owner[self.word_of]
        at = at[own[:n] == own[q - 1 :]]
        return self.piece(at, at + q), at


class ItemIndex:
    """The q-grams of a block of items, split by writing: words of letters, or single characters."""

    def __init__(self, ids: list[int], texts: list[str], s: Settings) -> None:
        self.s, self.ids, self.stream = s, np.array(ids, np.int64), Stream(texts)
        st = self.stream
        n_words = np.diff(st.text_at)
        begin = st.word_at[st.text_at]
        single = np.array([bool(st.single[begin[i] : begin[i + 1]].mean() > 0.5) if n_words[i] else False for i in range(len(ids))])
        self.part = np.minimum(np.where(single, s.part_single, s.part), np.maximum(n_words, 1))
        self.single, self.sides = single, {}
        size = np.diff(st.word_at)
        pair = size + np.r_[np.where(st.word_owner[1:] == st.word_owner[:-1], size[1:], 0), 0][: len(size)]
        longest = {}
        for kind, q in ((False, s.q), (True, s.q_single)):
            longest[kind] = int(pair[single[st.word_owner] == kind].max(initial=1))
            h, at = st.grams(q)
            owner = st.word_owner[st.word_of[at]] if len(at) else at
            ok = single[owner] == kind if len(at) else np.zeros(0, bool)
            h, at, owner = h[ok], at[ok], owner[ok]
            order = np.argsort(h, kind="stable")
            h, at, owner = h[order], at[order], owner[order]
            table = np.zeros(1 << 22, bool)
            table[(h >> np.uint64(42)).astype(np.int64)] = True
            keys, firsts, counts = np.unique(h, return_index=True, return_counts=True)
            self.sides[kind] = (q, keys, firsts, counts, at - begin[owner], owner, table, longest[kind])
        # bound: q-grams that must be shared; slack: how far they are from one diagonal; span: how far apart in the document;
        # rows, turns: item words and word diagonals that an alignment can go beyond shared q-grams
        self.bound, self.slack, self.span, self.edits, self.rows, self.turns = (np.ones(len(ids), np.int64) for _ in range(6))
        for i in range(len(ids)):
            length, part, q = size[st.text_at[i] : st.text_at[i + 1]], int(self.part[i]), s.q_single if single[i] else s.q
            if not len(length):
                continue
            parts = [n for n in s.lengths(part) if n <= len(length)]
            total = np.r_[0, np.cumsum(length)]
            k, most = s.budget(parts[-1]), min(parts[-1] + 2, len(length))
            self.bound[i] = max(1, min(self._bound(length[j : j + n], q, s.budget(n)) for n in parts for j in range(len(length) - n + 1)))
            self.slack[i] = max(1, k * longest[bool(single[i])])
            self.span[i] = (total[most:] - total[:-most]).max() + self.slack[i]
            silent = int((np.searchsorted(total, total[:-1] + q - 1, "right") - 1 - np.arange(len(length))).max())  # words in q - 1 characters
            self.edits[i], self.rows[i], self.turns[i] = k, k + (k + 1) * (silent + 1), k + (k + 1) * max(silent // 2, (q - 1) // 2)

    @staticmethod
    def _bound(length: np.ndarray, q: int, k: int) -> int:
        """q-grams that k edits of words leave of a part at least."""
        return int(length.sum() - q + 1 - np.sort(length)[len(length) - k :].sum() - k * (q - 1))

    def regions(self, docs: Stream) -> tuple[np.ndarray, ...]:
        """(document, item, lowest and highest word diagonal, first and last item word) of the bands that reach the item's bound."""
        out = []
        for q, keys, firsts, counts, place, owner, table, longest in self.sides.values():
            if not len(keys):
                continue
            h, at = docs.grams(q)  # from any character on, as the bound counts those in numbers and Latin words too
            hit = table[(h >> np.uint64(42)).astype(np.int64)]
            h, at = h[hit], at[hit]
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[slot] == h
            slot, at = slot[hit], at[hit]
            n = counts[slot]
            at = np.repeat(at, n)
            if not len(at):
                continue
            which = np.repeat(firsts[slot] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(len(at))
            item, word = owner[which], docs.word_of[at]
            doc = docs.word_owner[word]
            size = np.diff(docs.word_at)
            short = np.r_[0, np.cumsum(np.where(size > longest, 1, size))]
            place_d = short[word] + np.where(size[word] > longest, 0, at - docs.word_at[word]) - short[docs.text_at[doc]]
            band = (place_d - place[which] + (1 << 30)) // self.slack[item] - (1 << 30) // self.slack[item] + (1 << 27)
            key = (doc.astype(np.uint64) << np.uint64(44)) | (item.astype(np.uint64) << np.uint64(28)) | band.astype(np.uint64)
            ordered = np.sort(key)  # counting needs no places, and few bands reach their bound
            start = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
            good, count = ordered[start], np.diff(np.r_[start, len(key)])
            count[:-1] += np.where(good[1:] == good[:-1] + np.uint64(1), count[1:], 0)  # a band is two neighbouring halves
            good = good[count >= self.bound[(good >> np.uint64(28) & np.uint64(0xFFFF)).astype(np.int64)]]
            for half in (0, 1) if len(good) else ():
                of = key - np.uint64(half)
                some = np.flatnonzero(good[np.minimum(np.searchsorted(good, of), len(good) - 1)] == of)
                members = (of[some], *(x[some] for x in (at, place_d, which, doc, item)))
                both = members if not half else tuple(np.concatenate(x) for x in zip(both, members, strict=True))
            if len(good):
                out.append(self._narrowed(docs, *both, place))
        if not out:
            return tuple(np.empty(0, np.int64) for _ in range(6))
        return tuple(np.unique(np.concatenate(out, axis=1), axis=1))

    def _narrowed(self, docs: Stream, key: np.ndarray, at: np.ndarray, place_d: np.ndarray, which: np.ndarray, doc: np.ndarray, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of the bands, those where the bound is reached within the longest place a part can take."""
        order = np.lexsort((place_d, key))
        key, at, place_d, which, doc, item = key[order], at[order], place_d[order], which[order], doc[order], item[order]
        need = self.bound[item]
        until = np.arange(len(key)) + need - 1
        inside = until < len(key)
        until = np.minimum(until, len(key) - 1)
        dense = inside & (key[until] == key) & (place_d[until] - place_d <= self.span[item])
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        good = np.logical_or.reduceat(dense, start)
        st = self.stream
        i_word = st.word_of[st.word_at[st.text_at[item]] + place[which]] - st.text_at[item]
        w_diag = docs.word_of[at] - docs.text_at[doc] - i_word
        low, high, top, bottom = (f.reduceat(x, start)[good] for f, x in ((np.minimum, w_diag), (np.maximum, w_diag), (np.minimum, i_word), (np.maximum, i_word)))
        first = start[good]
        return np.stack([doc[first], item[first], low, high, top, bottom])

    def verify(self, docs: Stream, doc: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        """Which regions hold a part of the item within the edit budget, but for those of a document and item found already."""
        ok, pair = np.zeros(len(doc), bool), doc * len(self.ids) + item
        top, bottom = np.maximum(top - self.rows[item], 0), np.minimum(bottom + self.rows[item] + 1, np.diff(self.stream.text_at)[item])
        turns = self.turns[item]
        left = self._each(self._plausible, 1 << 20, docs, np.arange(len(doc)), doc, item, low - turns, high - low + 2 * turns + 1, top, bottom)
        near = np.minimum(turns, 3)
        ok[self._each(self._align, 1 << 16, docs, left, doc, item, low - near, high - low + 2 * near + 1, top, bottom)] = True
        left = left[~np.isin(pair[left], pair[ok]) & (turns[left] > near[left])]
        ok[self._each(self._align, 1 << 16, docs, left, doc, item, low - turns, high - low + 2 * turns + 1, top, bottom)] = True
        return ok

    def _each(self, test, most: int, docs: Stream, left: np.ndarray, doc: np.ndarray, item: np.ndarray, low: np.ndarray, width: np.ndarray, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:  # noqa: ANN001
        """Which of the regions `left` pass the test, which looks at many regions of like length at once, about `most` cells."""
        passed = [left[:0]]
        for part in np.unique(self.part[item[left]]):
            some = left[self.part[item[left]] == part]
            some = some[np.lexsort((width[some], np.ceil(np.log2(np.maximum((bottom - top)[some], 32)) * 2)))]
            cells, at = np.cumsum(width[some] * np.maximum(bottom - top, 32)[some]), 0
            while at < len(some):
                end = max(at + 1, int(np.searchsorted(cells, (cells[at - 1] if at else 0) + most)))
                x = some[at:end]
                passed.append(x[test(docs, doc[x], item[x], low[x], int(width[x].max()), int(part), top[x], bottom[x])])
                at = end
        return np.concatenate(passed)

    def _met(self, docs: Stream, doc: np.ndarray, item: np.ndarray, low: np.ndarray, width: int, top: np.ndarray, rows: int) -> tuple[np.ndarray, ...]:
        """For [region, item word from top, diagonal from low]: whether the words are equal, whether the item's word and the one before glued
        are the document's, and the other way round; and which [region, item word] there are."""
        st, n_items, n_docs = self.stream, np.diff(self.stream.text_at)[item], np.diff(docs.text_at)[doc]
        at_i = top[:, None] + np.arange(rows)
        at_d = at_i[:, :, None] + low[:, None, None] + np.arange(width)
        here, there = at_i < n_items[:, None], (at_d >= 0) & (at_d < n_docs[:, None, None])
        there &= here[:, :, None]
        at_i, at_d = np.where(here, st.text_at[item][:, None] + at_i, 0), np.where(there, docs.text_at[doc][:, None, None] + at_d, 0)
        word, d = st.words[at_i][:, :, None], docs.words[at_d]
        glued = there & (d == st.pairs[at_i - 1][:, :, None]) & (at_i > st.text_at[item][:, None])[:, :, None]
        torn = there & (word == docs.pairs[at_d - 1]) & (at_d > docs.text_at[doc][:, None, None])
        return there & (word == d), glued, torn, here

    def _plausible(self, docs: Stream, doc: np.ndarray, item: np.ndarray, low: np.ndarray, width: int, part: int, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        """Whether in some part all but the edited words stand somewhere in the band, in whatever order."""
        rows = int((bottom - top).max())
        same, glued, torn, here = self._met(docs, doc, item, low, width, top, rows)
        known, before = (same | torn).any(axis=2), glued.any(axis=2)
        known |= before
        known[:, :-1] |= before[:, 1:]
        total = np.cumsum(np.pad(known & here, ((0, 0), (1, 0))), axis=1)
        most = (total[:, part:] - total[:, :-part]).max(axis=1) if rows >= part else total[:, -1]
        return most >= part - self.edits[item]

    def _align(self, docs: Stream, doc: np.ndarray, item: np.ndarray, low: np.ndarray, width: int, part: int, top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
        """Banded alignment of many regions at once.

        best[c, b, n] is the best score of a path that ends in row i on diagonal low + b and has consumed n item words
        (n stops at part): +gain for each item word, -cost for each edit. A score of 0 or more at n = part is a find.
        """
        gain, cost = (self.s.rate.numerator, self.s.rate.denominator) if self.s.rate else (1, 1_000_000)
        never, adds = -100_000_000, int(self.edits[item].max(initial=0))
        rows, c = int((bottom - top).max()), len(doc)
        same, glued, torn, here = self._met(docs, doc, item, low, width, top, rows)
        any_glued, any_torn = glued.any(axis=(0, 2)), torn.any(axis=(0, 2))

        def shifted(x: np.ndarray, by: int) -> np.ndarray:
            """The same doc word or so, seen from the next row: diagonal b takes from b + by."""
            out = np.full_like(x, never)
            if by > 0:
                out[:, :-by] = x[:, by:]
            else:
                out[:, -by:] = x[:, :by]
            return out

        def consumed(x: np.ndarray, n: int, gain: int) -> np.ndarray:
            out = np.full_like(x, never)
            out[:, :, n:] = x[:, :, : part + 1 - n]
            out[:, :, part] = x[:, :, part - n :].max(axis=2)
            return out + np.int32(gain)

        fresh = np.full((c, width, part + 1), never, np.int32)
        fresh[:, :, 0] = 0
        before, last, found = fresh.copy(), fresh.copy(), np.zeros(c, bool)
        for i in range(rows):
            step = consumed(last, 1, gain)
            now = np.maximum(fresh, np.where(same[:, i, :, None], step, step - cost))
            np.maximum(now[:, :-1], step[:, 1:] - cost, out=now[:, :-1])  # the item's word is dropped
            if i and any_glued[i]:
                now = np.maximum(now, np.where(glued[:, i, :, None], shifted(consumed(before, 2, 2 * gain), 1), never))
            if any_torn[i]:
                now = np.maximum(now, np.where(torn[:, i, :, None], shifted(step, -1), never))
            for _ in range(adds):  # words added in the document
                np.maximum(now[:, 1:], now[:, :-1] - cost, out=now[:, 1:])
            now = np.maximum(now, never)
            now[~here[:, i]] = never
            found |= (now[:, :, part] >= 0).any(axis=1)
            before, last = last, now
        return found

    def leaks(self, ids: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        docs = Stream(texts)
        if not len(docs.codes) or not len(self.stream.codes):
            return ids[:0], ids[:0]
        regions = np.stack(self.regions(docs))
        doc, item = np.unique(regions[:2, self.verify(docs, *regions)], axis=1)  # bands overlap
        return ids[doc], self.ids[item]


def leaked_items(documents: DataFrame, items: DataFrame, settings: Settings = Settings(), block: int = 4_000_000) -> DataFrame:
    """documents: doc_id, text; items: item_id, text. The distinct (doc_id, item_id) of leaks."""
    spark = documents.sparkSession
    held: list[list] = [[]]
    size = 0
    for row in items.select("item_id", "text").where("text is not null and text != ''").orderBy("item_id").toLocalIterator():
        if held[-1] and (size + len(row.text) > block or len(held[-1]) >= 60_000):
            held.append([])
            size = 0
        held[-1].append((row.item_id, row.text))
        size += len(row.text)
    docs, out = documents.select("doc_id", "text").where("text is not null and text != ''"), None
    for part in held:
        shared = spark.sparkContext.broadcast(ItemIndex([i for i, _ in part], [t for _, t in part], settings)) if part else None

        def of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
                for a, b in chunks(texts, 1 << 21) if shared else []:
                    d, i = shared.value.leaks(ids[a:b], texts[a:b])
                    yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(i, pa.int64())], names=["doc_id", "item_id"])

        found = docs.mapInArrow(of, FOUND)
        out = found if out is None else out.unionByName(found)
    return out.distinct()
