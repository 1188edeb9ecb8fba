import random
from itertools import combinations

import numpy as np
import pytest
import regex

from sableflow.functions.words import run_hashes, words
from sableflow.llm import fingerprints as fp
from sableflow.llm.near_duplicates import duplicate_pairs, near_duplicates

WORD = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{Nd}\p{M}])+")


def runs_of(text, n):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(rows, n, threshold):
    sets = {i: s for i, t in rows if t and (s := runs_of(t, n))}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=5, groups=40):
    rng = random.Random(seed)
    vocabulary = [f"wort{i}" for i in range(3000)] + ["चीनी", "сахар", "糖", "砂", "Ünïcode", "a1"]
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([40, 80, 300]))
        for k in range(rng.choice([1, 2, 5])):
            w = list(base)
            for _ in range(k * len(w) // 40):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [w[at], rng.choice(vocabulary)]])
            rows.append((len(rows), rng.choice([" ", "\n", ", "]).join(w)))
    return rows


SCHEMA = "id bigint, text string, fp string, digest int"


def found(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    return [(r.a, r.b) for r in duplicate_pairs(*near_duplicates(df, **kw)).collect()]


@pytest.mark.parametrize(("run", "threshold", "most"), [(3, 0.6, 200), (5, 0.8, 200), (3, 0.6, 2)])
def test_against_all_pairs(spark, run, threshold, most):
    """The last case sends most keys through the refinement of hot segments."""
    rows = corpus()
    got = found(spark, rows, run=run, threshold=threshold, most=most)
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, run, threshold)


def test_copies_nulls_and_short_texts(spark):
    long_text = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, "one two three four five six"), (2, "One, two: three four FIVE six!"), (3, None), (4, ""), (5, "one two"), (6, "one two"), (7, long_text), (8, long_text + " end"), (9, "one two three four five six")]
    assert set(found(spark, rows, run=3, threshold=0.6)) == {(1, 2), (1, 9), (2, 9), (7, 8)}


def test_members_name_their_class(spark):
    df = spark.createDataFrame([(i, "a b c d e" if i < 30 else f"x{i} y{i} z{i} u{i}", None, None) for i in range(50)], SCHEMA)
    members, links = near_duplicates(df, run=3, threshold=0.6)
    assert members.where("rep = 0").count() == 30 and links.count() == 0


def test_empty(spark):
    assert found(spark, [], run=3, threshold=0.6) == []


def test_words_are_the_tables_words():
    text = "Don't stop 3.5% at 糖厂キヌハ, naïve ЧЁРНЫЙ हिन्दी!"
    h, owner, first, last = words([text, text.upper()])
    assert (owner == 0).sum() == len(WORD.findall(text.lower()))
    assert (h[owner == 0] == h[owner == 1]).all()
    assert len(run_hashes(h, owner, 3)[0]) == 2 * ((owner == 0).sum() - 2)


def test_bit_difference_follows_similarity():
    a = [f"w{i}" for i in range(400)]
    b = a[:200] + [f"v{i}" for i in range(200)]
    runs, owner = fp.run_sets([" ".join(a), " ".join(b)], 1)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    prints, _ = fp.sketch(runs, starts)
    bits = int(np.bitwise_count(prints[0] ^ prints[1]).sum())
    assert abs(bits - 4 * fp.BYTES * (1 - 1 / 3)) < 90


def versions(n, seed=4, size=120):
    """n versions of one article, each with a few words of its own, and another article of its own for every tenth."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(size)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in range(rng.randrange(1, 9)):
            w[rng.randrange(size)] = f"n{i}x{k}"
        rows.append((i, " ".join(w)))
        if i % 10 == 0:
            rows.append((n + i, " ".join(f"o{i}y{k}" for k in range(size))))
    return rows


def test_dense_groups_are_compared_block_by_block(spark, monkeypatch):
    """Hot keys, refined keys and dense groups, in several blocks, against all pairs."""
    rows = versions(90)
    plain = fp.candidates
    monkeypatch.setattr(fp, "candidates", lambda *a: plain(*a[:3], 20, 5))
    blocks = fp.dense_links
    monkeypatch.setattr(fp, "dense_links", lambda *a: blocks(*a, block=13))
    got = found(spark, rows, run=3, threshold=0.6)
    want = brute(rows, 3, 0.6)
    assert len(got) == len(set(got)) and len(want) > 2000
    assert set(got) == want


def test_groups_of_groups(spark):
    chain = [(i, h) for h in range(40) for i in (h, h + 1)] + [(100, 90), (101, 90)]
    got = {r.id: r.label for r in fp.groups_of_groups(spark.createDataFrame(chain, "id bigint, hot bigint")).collect()}
    assert {v for k, v in got.items() if k <= 40} == {0} and got[100] == got[101] == 100


def test_ten_thousand_versions(spark):
    """One article in ten thousand versions: some fifty million pairs, each compared once; the number of links of each version is checked for a few."""
    rows = versions(10_000, size=60)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    members, links = near_duplicates(df, run=3, threshold=0.6)
    assert members.count() == 11_000
    some = [0, 17, 4_321, 9_999]
    per = {r.id: r.n for r in links.selectExpr("explode(array(a, b)) id").where(f"id in ({', '.join(map(str, some))})").groupBy("id").count().withColumnRenamed("count", "n").collect()}
    sets = {i: runs_of(t, 3) for i, t in rows if i < 10_000}
    for i in some:
        want = sum(len(sets[i] & s) >= 0.6 * len(sets[i] | s) for j, s in sets.items() if j != i)
        assert abs(per.get(i, 0) - want) <= 0.01 * want  # pairs at the threshold are found with probability 0.996
