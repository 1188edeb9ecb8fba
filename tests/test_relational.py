import random

from pyspark.sql import functions as F

from sableflow.operators import backtest, relational as r


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "` a ` int, a int, b int")
    assert r.strip_names(df).columns == ["a", "b"] and r.strip_names(df).first().a == 1
    assert r.prefixed(df.select("b"), "x", []).columns == ["x_b"]


def test_count_overlaps(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("kl"), f"{rng.randrange(50):03d}", f"{rng.randrange(50):03d}") for i in range(300)]
    want = {}
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and a[3] >= b[2]:
                want[a[1]] = want.get(a[1], 0) + 1
    got = r.count_overlaps(spark.createDataFrame(rows, "id int, k string, s string, e string"), ["k"], "id", "s", "e").groupBy("k").agg(F.sum("overlaps").alias("n"))
    assert {x.k: x.n for x in got.collect()} == want


def test_circles(spark):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.0, 0.5, 2.0])) for i in range(200)]
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 < a[3] + b[3]}
    got = r.overlapping_circles(spark.createDataFrame(rows, "i bigint, x double, y double, r double"))
    assert {(x.i, x.j) for x in got.collect()} == want
    assert r.overlapping_circles(spark.createDataFrame([], "i bigint, x double, y double, r double")).count() == 0


def test_interval_join(spark):
    rows = [(i, i * 1000) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, t bigint").select("id", F.timestamp_seconds("t").alias("t"))
    pairs = r.interval_join(df, df, "t", 3000).where("l_id < r_id").count()
    assert pairs == sum(1 for a in range(50) for b in range(a + 1, 50) if b - a <= 3)


def test_allocate(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 0.001)], "n string, w double")
    got = {x.n: x.quota for x in r.allocate(df, "n", "w", 10).collect()}
    assert got == {"a": 6, "b": 3, "c": 1}


def test_vote_and_fill(spark):
    df = spark.createDataFrame([("q", "x", 2), ("q", "y", 1), ("q", "y", 3), ("q", "x", 4), ("p", None, 1)], "k string, v string, o int")
    assert {(x.k, x.v, x.votes) for x in r.majority_vote(df.where("v is not null"), ["k"], "v", "o").collect()} == {("q", "y", 2)}
    filled = r.fill_median_mode(spark.createDataFrame([(1.0, "a"), (None, None), (3.0, "a")], "x double, c string"), ["x"], ["c"])
    assert sorted(map(tuple, filled.collect())) == [(1.0, "a"), (2.0, "a"), (3.0, "a")]


def test_as_of(spark):
    df = spark.createDataFrame([("2023-12-30", 1.0), ("2024-01-02", 2.0)], "d string, v double").select(F.to_date("d").alias("d"), "v")
    assert [x.v for x in r.daily_as_of(df, "d", "v").orderBy("d").collect()] == [1.0, 1.0, 1.0, 2.0]


def test_depths(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 1)], "id bigint, p bigint")
    assert {x.id: x.depth for x in r.depths(df, "id", "p").collect()} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 1}


def test_insert_and_split(spark):
    a, b = spark.createDataFrame([(1,), (None,), (2,)], "id int"), spark.createDataFrame([(2,)], "id int")
    assert r.insert_if_absent(a, b, ["id"]).count() == 2
    parts = r.positional_split(spark.range(10).toDF("id"), ["id"], 0.75).groupBy("part").count().collect()
    assert {x.part: x["count"] for x in parts} == {"train": 7, "test": 3}
    assert r.positional_split(spark.range(0).toDF("id"), ["id"], 0.75).count() == 0


def test_correlation_without_variance(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (1.0, 3.0, 6.0), (1.0, None, 8.0)], "a double, b double, c double")
    got = {(x.a, x.b): x.r for x in r.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got == {("a", "b"): None, ("a", "c"): None, ("b", "c"): 1.0}


def test_union(spark):
    out = r.union_all(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, None), (2, "x")]


def test_score():
    assert backtest.score(2.0, -0.2) == 1.9 and backtest.score(0.4, 0.0) == -0.5
