from pyspark.sql import functions as F

from sableflow.operators import evaluation as e
from sableflow.operators import relational as r


def test_cases(spark):
    rows = [("g", 1, "ACCEPTED", 1.0, 1 << 20, 4.0), ("g", 2, None, 2.5, 3 << 20, None), ("g", 3, "WRONG", None, None, 2.0)]
    x = spark.createDataFrame(rows, "g string, case_no int, verdict string, seconds double, bytes bigint, score double")
    got = e.case_rollup(x, ["g"]).first()
    assert (got.passed, got.failed, got.max_seconds, got.max_mib, got.combined_score) == (1, 2, 2.5, 3, 3.0)
    for overall, case in (("WRONG", 3), ("ACCEPTED", 1), ("CRASH", 1)):
        assert e.representative_case(x.withColumn("o", F.lit(overall)), ["g"], "o").first().case_no == case
    assert e.case_rollup(x.limit(0), ["g"]).count() == 0


def test_costs_and_archive(spark):
    calls = spark.createDataFrame([("m", 10, 2), ("n", 1, 1), (None, 1, 1)], "model string, prompt_tokens int, completion_tokens int")
    prices = spark.createDataFrame([("m", 0.5, 1.0), ("m", 0.5, 1.0)], "model string, input double, output double")
    assert sorted((x.cost for x in e.call_costs(calls, prices).collect()), key=str) == [7.0, None, None]
    x = spark.createDataFrame([("a", 1, 5.0, True), ("a", 2, 5.0, True), ("a", 3, 9.0, False), ("a", 4, 1.0, True)], "g string, i int, s double, correct boolean")
    assert [(v.i, v.rank) for v in e.archive(x, ["g"], "s", "i", 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert [v.within for v in e.within_budget(x, ["g"], ["i"], 1).orderBy("i").collect()] == [True, False, False, False]


def test_not_in_is_null_aware(spark):
    x = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    keys = lambda *v: spark.createDataFrame([(a,) for a in v], "k int")
    assert [v.k for v in r.not_in(x, "k", keys(1), "k").collect()] == [2]
    assert r.not_in(x, "k", keys(1, None), "k").count() == 0
    assert r.not_in(x, "k", keys(), "k").count() == 3


def test_topics(spark):
    rows = [(1, '["1", "2"]'), (2, '[{"id": "2"}, {"id": "7"}]'), (3, "2"), (4, '"2"'), (5, None), (6, "[broken"), (7, '{"id": "2"}'), (8, "[]")]
    x = spark.createDataFrame(rows, "i int, topics string")
    assert sorted(v.i for v in r.with_topic(x, "topics", "2").collect()) == [1, 2, 3, 4, 7]


def test_shares(spark):
    x = spark.createDataFrame([("a", 10.0, 1.0), ("b", 1.0, 1.0), ("c", None, 1.0)], "n string, w double, v double")
    got = {v.n: v.quota for v in r.allocate_by_worth(x, "n", ["w", "v"], 22).collect()}
    assert min(got.values()) >= 1 and got["a"] > got["b"] >= got["c"]
    assert r.allocate_by_worth(x.limit(0), "n", ["w"], 5).count() == 0


def test_arrays_as_text(spark):
    x = spark.createDataFrame([("g", 1, 0.5, 2.0), ("g", 0, 1.0, None)], "g string, i int, x double, y double")
    assert e.arrays_as_text(x, ["g"], "i", ["x", "y"], "centers").first().text == "centers[0] = (1.0)\ncenters[1] = (0.5, 2.0)"
