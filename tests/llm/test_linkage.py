import random

from sableflow.llm.linkage import Patterns, candidates, close, compare, link, number_of, prepare, rare_words, with_names, words_of

LEFT = "id bigint, title string, us bigint, key string"
HOUR = 3_600_000_000


def headlines(n=60, seed=3):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choices(["ul", "mor", "xar", "ven", "tri", "kel", "sal", "hol"], k=4)).capitalize()
    left, right, truth, t = [], [], set(), 0
    for i in range(n):
        t += rng.randrange(1, 9) * HOUR
        a, b, k = name(), name(), rng.randrange(10, 999)
        kind = i % 3
        title = [f"{a} mill halts crushing, {b} Metals seeks {k} tonnes", f"Rain near {a} delays {b} Foods harvest by {k} days", f"{a} levy on tin draws protest from {b} Corp."][kind]
        left.append((i, title, t, "k"))
        other = [f"{a} plant stops crushing, {b} Metals looks for {k} t", f"UPDATE 1-rain near {a.lower()} sets back {b.lower()} foods harvest by {k} days", f"{a} tax on tin angers {b} Corp."][kind]
        if i % 2 == 0:
            right.append((1000 + i, other, t + rng.randrange(-40, 40) * HOUR, "k"))
            truth.add((i, 1000 + i))
        if i % 5 == 0:  # the same names, days later, and other names at the same time
            right.append((2000 + i, other, t + 80 * HOUR, "k"))
            right.append((3000 + i, title.replace(a, name()).replace(b, name()), t, "k"))
    return left, right, truth


def test_links(spark):
    left, right, truth = headlines()
    right += [(5000, right[0][1], right[0][2], "k")]  # a repeated prediction counts too
    truth.add((right[0][0] - 1000, 5000))
    left += [(900, None, 5, None), (901, "", 5, None), (902, "tin", 5, None), (903, "Xarul levy", None, None)]
    right += [(9000, None, None, None), (9001, "", 1, None)]
    got = {(r.left_id, r.right_id): r.confidence for r in link(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, LEFT)).collect()}
    assert set(got) == truth
    assert all(0.5 <= c <= 1 for c in got.values())


def test_empty(spark):
    empty = spark.createDataFrame([], LEFT)
    assert link(empty, empty).count() == 0


def test_levels():
    a = "Narbo mill halts crushing, Xarul Metals seeks 1,088 tonnes"
    names = ["narbo", "xarul"]
    assert compare(words_of(a), names, words_of("Nrbo plant stops, Xarul seeks 1088 t"), "Nrbo plant stops, Xarul seeks 1088 t") == (2, 2)
    assert compare(words_of(a), names, words_of("Narbo plant stops 5"), "Narbo plant stops 5") == (1, 0)
    cut = "Narbo plant stops crushing…"
    assert compare(words_of(a), names, words_of(cut), cut) == (2, 1)
    assert compare(words_of(a), names, words_of("quite another"), "quite another")[0] == 0


def test_small_parts():
    assert all(close("xarul", x) for x in ("xarul", "xrul", "xarrul", "xarol", "xraul", "xaru", "arul")) and not any(close("xarul", x) for x in ("xaron", "xuarl", "", "xarulmo"))
    assert words_of("Açúcar à Ulm") == ["acucar", "a", "ulm"]
    assert number_of("4,094") == number_of("4094") and number_of("13.7") == number_of("13") and number_of("121.436") == "121436"


def test_patterns_separate_agreement_from_chance():
    counts = {(2, 2, 2, 2): 80, (2, 1, 2, 1): 20, (1, 0, 0, 0): 300, (1, 1, 0, 1): 200, (1, 0, 1, 2): 150}
    p = Patterns(counts).posterior
    assert p[2, 2, 2, 2] > 0.95 and p[1, 0, 0, 0] < 0.05
    assert Patterns({}).posterior


def test_frequent_names_link(spark):
    """A company and a port in every title: both are above the share of rare words."""
    verbs = [("halts", "stops"), ("buys", "acquires"), ("delays", "postpones")]
    left, right, truth, t = [], [], set(), 0
    for i in range(60):
        t += 30 * HOUR
        a, b = verbs[i % 3]
        left.append((i, f"Xarul Norbek {a} {100 + 7 * i} cargoes at Molvent", t, "k"))
        if i % 2 == 0:
            right.append((1000 + i, f"Xarul Norbek {b} {100 + 7 * i} cargoes at Molvent", t + HOUR, "k"))
            truth.add((i, 1000 + i))
        else:
            right.append((1000 + i, f"Tarsid Pelquor {b} {900 + 7 * i} barrels near Dovrin", t + HOUR, "k"))
    got = {(r.left_id, r.right_id) for r in link(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, LEFT)).collect()}
    assert got == truth


def test_frequent_names_count():
    a = "Narbo mill halts crushing, Xarul Metals seeks 1,088 tonnes"
    other = "Xarul Metals seeks tonnes"
    assert compare(words_of(a), ["narbo"], words_of(other), other)[0] == 0
    assert compare(words_of(a), ["narbo"], words_of(other), other, ["xarul", "metals"])[0] == 1
    assert compare(words_of(a), ["narbo", "seeks"], words_of("Brex Metals"), "Brex Metals", ["xarul", "metals"])[0] == 0


def test_unspaced_titles_link(spark):
    """Chinese headlines have no spaces: their names are pairs of characters."""
    rng = random.Random(6)
    name = lambda: "".join(chr(0x4E00 + rng.randrange(4000)) for _ in range(4))
    left, right, truth, t = [], [], set(), 0
    for i in range(60):
        t += 20 * HOUR
        a, b, k = name(), name(), rng.randrange(100, 999)
        left.append((i, f"{a}糖业宣布停止压榨，{b}港口积压{k}吨", t, "k"))
        if i % 2:
            right.append((1000 + i, f"快讯：{a}糖厂停止压榨，{b}港积压{k}吨", t + 3 * HOUR, "k"))
            truth.add((i, 1000 + i))
        else:
            right.append((1000 + i, f"{name()}糖业宣布停止压榨，{name()}港口积压{rng.randrange(100, 999)}吨", t + HOUR, "k"))
    got = {(r.left_id, r.right_id) for r in link(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, LEFT)).collect()}
    assert truth <= got and len(got - truth) <= 2
    assert words_of("糖业3.5吨 Ulm") == ["糖业", "3.5", "吨", "ulm"]


def test_hot_blocks_are_dealt_out(spark, monkeypatch):
    left, right, truth = headlines(30)
    a, b = prepare(spark.createDataFrame(left, LEFT)), prepare(spark.createDataFrame(right, LEFT))
    rare = rare_words(a, b)
    a, b = with_names(a, rare, True), with_names(b, rare, False)
    whole = {tuple(r) for r in candidates(a, b, 48 * HOUR).collect()}
    assert whole and {tuple(r) for r in candidates(a, b, 48 * HOUR, most=1).collect()} == whole
