import random

from sableflow.operators.similar import repeats, similar_pairs

ROWS = "id bigint, source string, content string"


def test_pairs_are_those_of_all_comparisons(spark):
    rng = random.Random(4)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 5) + str(rng.randrange(40)) for _ in range(60)] for _ in range(6)]
    rows = [(i, rng.choice(["x", "y", None]), " ".join(w if rng.random() > rng.choice([0, 0.05, 0.1]) else f"new{rng.random()}" for w in base[i % 6])) for i in range(150)]
    rows += [(900, "x", ""), (901, "x", None), (902, "x", " ")]
    got = {(r.id, r.earlier) for r in similar_pairs(spark.createDataFrame(rows, ROWS)).collect()}
    sets = {i: (s, set((c or "").split())) for i, s, c in rows}
    want = {(b, a) for a, (s, x) in sets.items() for b, (u, y) in sets.items() if a < b and s == u and x and y and len(x & y) / len(x | y) >= 0.85}
    assert got == want and len(want) > 50


def test_chains_and_empty(spark):
    pairs = spark.createDataFrame([("x", 2, 1), ("x", 3, 2), ("x", 5, 3), (None, 8, 7)], "source string, id bigint, earlier bigint")
    assert sorted(r.id for r in repeats(pairs).collect()) == [2, 5, 8]  # 3 is similar only to 2, which is gone
    assert similar_pairs(spark.createDataFrame([], ROWS)).count() == 0


def test_edited_delivery_is_a_fourth_layer(spark, tmp_path):
    from sableflow.plans.registry import queries

    text = " ".join(f"word{i}" for i in range(100))
    news = [(1, "a", "S", "T", text, '{"url": "u1"}'), (2, "b", "S", "T", text + " more", '{"url": "u2"}'), (3, "c", "other", "T", text + " more", '{"url": "u3"}'), (4, "d", "S", "T", text, '{"url": "u1"}')]
    spark.createDataFrame(news, "news_no bigint, id string, source string, title string, text string, metadata string").write.parquet(str(tmp_path / "news.parquet"))
    got = {r.news_no: r.layer for r in queries()["wh_four_layers"](spark, str(tmp_path)).collect()}
    assert got == {2: "similar", 3: "content", 4: "url"}
