import random

import numpy as np
import pytest

from sableflow.llm.leaks import ItemIndex, Settings, Stream, leaked_items

RNG = random.Random(8)
VOCABULARY = ["".join(RNG.choices("abcdefghilmnoprstu", k=RNG.randint(2, 11))) for _ in range(4000)]
ITEM = RNG.sample(VOCABULARY, 60)
HAN = [chr(0x4E00 + i) for i in RNG.sample(range(5000), 80)]


def noise(n):
    return RNG.choices(VOCABULARY, k=n)


def edit(words, n, rng):
    out = list(words)
    for at in rng.sample(range(1, len(words) - 1), n):
        out[at] = [f"zz{at}"]
    return [x for w in out for x in (w if isinstance(w, list) else [w])]


def check(doc, item=" ".join(ITEM)):
    ix = ItemIndex([7], [item], Settings())
    return len(ix.leaks(np.array([1]), [doc])[0]) == 1


def test_whole_and_parts():
    assert check(" ".join(noise(50) + ITEM + noise(50)))
    assert check(" ".join(noise(30) + ITEM[10:30] + noise(30)))
    assert not check(" ".join(noise(30) + ITEM[10:27] + noise(30)))  # with three words more it would be 20, but three are too many edits
    assert not check(" ".join(noise(400)))


@pytest.mark.parametrize("seed", range(12))
def test_edit_budget(seed):
    rng = random.Random(seed)
    part = ITEM[5:25]
    assert check(" ".join(noise(20) + edit(part, 2, rng) + noise(20)))
    whole = edit(ITEM, 6, rng)
    assert check(" ".join(noise(20) + whole + noise(20)))
    far = list(part)
    for at in range(2, 20, 5):  # four of twenty, evenly
        far[at] = f"q{at}"
    assert not check(" ".join(noise(20) + far + noise(20)))


def test_dropped_and_added_words():
    part = ITEM[5:30]
    assert check(" ".join(noise(9) + part[:8] + part[9:] + noise(9)))
    assert check(" ".join(noise(9) + part[:8] + ["extra"] + part[8:] + noise(9)))


def test_case_punctuation_and_spacing():
    text = ITEM[0].upper() + ", (" + "; ".join(ITEM[1:30]) + ")!\n\n"
    assert check(" ".join(noise(5)) + " " + text)
    glued = " ".join(ITEM[:30]).replace(ITEM[11] + " " + ITEM[12], ITEM[11] + ITEM[12])
    assert check(glued)
    assert check(" ".join(ITEM[:12] + [ITEM[12][:1] + " " + ITEM[12][1:]] + ITEM[13:30]))


def test_chinese():
    item = "".join(HAN)
    doc = "。".join("".join(chr(0x4E00 + RNG.randrange(6000, 9000)) for _ in range(40)) for _ in range(3))
    assert check(doc + "".join(HAN[10:40]) + doc, item)
    assert not check(doc + "".join(HAN[10:36]) + doc, item)
    edited = HAN[10:40]
    edited[9] = edited[19] = edited[24] = "丂"
    assert check(doc + "".join(edited) + doc, item)


def test_short_items_count_whole():
    assert check("some words and the little test item here", "the little test item")
    assert not check("some words and the little item here", "the little test item")


def test_table(spark):
    docs = [(1, " ".join(ITEM), "x"), (1, " ".join(ITEM), "x"), (2, None, None), (3, "", None), (4, " ".join(noise(9000) + ITEM[:40]), None), (5, "short", None)]
    items = [(10, " ".join(ITEM), 1), (11, " ".join(ITEM), 1), (12, None, 1), (13, "", 1)]
    got = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string, doc_id int"))
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (4, 10), (4, 11)]
    blocks = leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string, doc_id int"), block=10)
    assert blocks.count() == 4
    assert leaked_items(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_stream_has_no_words():
    assert len(Stream(["...", ""]).words) == 0


@pytest.mark.parametrize("seed", range(40))
def test_chinese_with_numbers_at_full_edit_budget(seed):
    rng = random.Random(seed)
    part = [w for i in range(10) for w in (*HAN[3 * i : 3 * i + 2], [str(1000 + 37 * i), HAN[3 * i + 2]][i % 2])]
    edited = list(part)
    for at in rng.sample(range(1, 29), 3):
        edited[at] = "丂"
    doc = "".join(chr(0x4E00 + rng.randrange(6000, 9000)) for _ in range(60))
    assert check(doc + "".join(edited) + doc, "".join(part))


def aligned(item, doc, part, rate=0.1):
    """Brute force: whether some part of at least `part` item words lies in doc within the budget; two words glued to one, or one torn in two, are free."""
    gain, cost, never = 1, round(1 / rate), -(10**9)
    rows = [[[0] + [never] * part for _ in range(len(doc) + 1)]]
    for i in range(1, len(item) + 1):
        row = []
        for j in range(len(doc) + 1):
            best = [0] + [never] * part

            def take(cell, n, score, best=best):
                for k, v in enumerate(cell):
                    to = min(k + n, part)
                    best[to] = max(best[to], v + score)

            take(rows[i - 1][j], 1, gain - cost)
            if j:
                take(rows[i - 1][j - 1], 1, gain if item[i - 1] == doc[j - 1] else gain - cost)
                take(row[j - 1], 0, -cost)
                if i > 1 and item[i - 2] + item[i - 1] == doc[j - 1]:
                    take(rows[i - 2][j - 1], 2, 2 * gain)
            if j > 1 and item[i - 1] == doc[j - 2] + doc[j - 1]:
                take(rows[i - 1][j - 2], 1, gain)
            if best[part] >= 0:
                return True
            row.append(best)
        rows.append(row)
    return False


SCRIPTS = {
    "latin": lambda r: "".join(r.choices("abcdefghilmnoprstu", k=r.choice([1, 2, 2, 3, 3, 4, 5, 6, 7, 9, 14]))),
    "cyrillic": lambda r: "".join(r.choices("абвгдежзиклмнопрст", k=r.randint(1, 12))),
    "numbers": lambda r: str(r.randrange(10 ** r.randint(1, 7))) if r.random() < 0.3 else "".join(r.choices("aeiourstln", k=r.randint(1, 8))),
    "chinese": lambda r: chr(0x4E00 + r.randrange(3000)),
    "chinese numbers": lambda r: str(r.randrange(10 ** r.randint(1, 4))) + "." if r.random() < 0.15 else chr(0x4E00 + r.randrange(3000)),
}


@pytest.mark.parametrize("script", SCRIPTS)
@pytest.mark.parametrize("seed", range(12))
def test_recall_is_whole_against_full_alignment(script, seed):
    """Parts of minimum length and more, with all the edits the budget allows, long added words and spacing errors among them."""
    rng = random.Random(f"{script} {seed}")
    word, han = SCRIPTS[script], script.startswith("chinese")
    item = [word(rng).rstrip(".") for _ in range(rng.randint(60, 90))]
    n = rng.choice([30, 35, 40, 50, 59] if han else [20, 21, 25, 30, 33, 39])
    start = rng.randrange(len(item) - n + 1)
    part = [[w] for w in item[start : start + n]]
    spots = rng.sample(range(n), n // 10) if seed % 3 else [n // 2 - n // 20 + k for k in range(n // 10)]  # in a row, too
    for at in spots:
        kind = rng.choice(["change", "drop", "add", "add"])
        new = "".join(rng.choices("qwxyz", k=rng.choice([1, 4, 12, 28, 39])))
        part[at] = {"change": [new], "drop": [], "add": [part[at][0], new]}[kind]
    words = [w for p in part for w in p]
    if not han:
        for _ in range(3):
            at = rng.randrange(len(words) - 1)
            if rng.random() < 0.5:
                words[at : at + 2] = [words[at] + words[at + 1]]
            elif len(words[at]) > 1:
                words[at : at + 1] = [words[at][:1], words[at][1:]]
    around = [[word(rng).rstrip(".") for _ in range(40)] for _ in range(2)]
    doc = around[0] + words + around[1]
    if aligned(item, doc, 30 if han else 20):
        assert check(" ".join(doc), " ".join(item))
    scattered = list(item[start : start + n])
    for at in range(1, n, 5):  # twice the budget
        scattered[at] = "qq"
    doc = around[0] + scattered + around[1]
    assert check(" ".join(doc), " ".join(item)) == aligned(item, doc, 30 if han else 20)
