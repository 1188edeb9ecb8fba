import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from sableflow.sources import connectors, files
from sableflow.sources.tables import Ledger, Parts, Table
from sableflow.streaming import streams


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('datetime;value;note\n2024-01-01T00:00;"1,234.5";x\n2024-01-02;"7";y\n', encoding="utf-8")
    (tmp_path / "b.tsv").write_text("2024-01-01\t5\tx\n2024-01-02\t\ty\n", encoding="utf-8")
    schema = "datetime string, value string, note string"
    a = files.read_delimited(spark, str(tmp_path / "a.csv"), schema)
    assert a.select(files.thousands(F.col("value")).alias("v"), files.leading_day(F.col("datetime")).alias("d")).orderBy("d").first().v == 1234.5
    b = files.read_delimited(spark, str(tmp_path / "b.tsv"), schema)
    assert b.count() == 2 and a.count() == 2
    assert files.sniff_delimiter(spark, str(tmp_path / "b.tsv")) == "\t"


def test_sinks_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, "ä"), (2, None)], "id int, s string")
    files.write_json_lines(df, str(tmp_path / "j"))
    assert files.read_json_lines(spark, str(tmp_path / "j"), "id int, s string").where("s = 'ä'").count() == 1
    files.write_csv(df, str(tmp_path / "c"))
    files.write_csv(df, str(tmp_path / "c"), append=True)
    assert files.read_delimited(spark, str(tmp_path / "c"), "id int, s string", sep=",").count() == 4


def test_results(spark, tmp_path):
    for g, s, ok in ((0, 1.0, True), (1, 3.0, False), (2, 2.0, True), (3, 2.0, True)):
        d = tmp_path / f"gen_{g}" / "results"
        d.mkdir(parents=True)
        (d / "metrics.json").write_text(json.dumps({"combined_score": s, "public": {"a": 1.0}, "private": {}, "text_feedback": ""}, indent=1))
        (d / "correct.json").write_text(json.dumps({"correct": ok, "error": None}))
    out = files.read_results(spark, str(tmp_path))
    assert out.count() == 4
    best = files.best_generation(out).first()
    assert (best.generation, best.combined_score) == (2, 2.0)


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "x.npz", centers=np.arange(6.0).reshape(3, 2), radii=np.ones(3))
    rows = files.read_arrays(spark, str(tmp_path / "x.npz")).collect()
    assert len(rows) == 6 and [r["values"] for r in rows if r.name == "centers"][2] == [4.0, 5.0]


def test_sqlite_and_articles(spark, tmp_path):
    db = tmp_path / "x.db"
    with sqlite3.connect(db) as c:
        c.execute("create table t (id integer, name text, v real)")
        c.executemany("insert into t values (?, ?, ?)", [(i, f"n{i}", i / 2) for i in range(25)])
    connectors.register(spark)
    df = spark.read.format("sqlite_table").option("path", str(db)).option("table", "t").option("rows", 10).load()
    assert df.count() == 25 and df.where("v > 10").count() == 4 and df.rdd.getNumPartitions() == 3
    pages = [[{"id": "a", "published": "2024-01-01", "language": "en", "title": "x", "score": 1}, {"id": "b", "published": "2024-02-01", "language": "de", "score": None}], [{"id": "c", "published": "2024-03-01", "language": "en"}]]
    for i, p in enumerate(pages):
        (tmp_path / f"page_{i}.json").write_text(json.dumps(p))
    articles = spark.read.format("articles").option("path", str(tmp_path)).option("pages", 3).load()
    assert articles.count() == 3
    assert articles.where("language = 'en' and published >= '2024-02-01'").collect()[0].id == "c"


def test_table(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "id int, v string")
    assert t.read().count() == 0
    t.insert_absent(spark.createDataFrame([(1, "a"), (1, "a2"), (2, "b"), (None, "n")], "id int, v string"), ["id"])
    t.insert_absent(spark.createDataFrame([("z", 2), ("c", 3)], "v string, id int"), ["id"])
    assert {r.id for r in t.read().collect()} == {1, 2, 3, None}
    t.delete("v = 'b'")
    t.delete_ids(spark.createDataFrame([(3,)], "id int"), "id")
    assert {r.id for r in t.read().collect()} == {1, None} and t.describe()[0] == ("id", "int")


def test_ledger_and_parts(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"))
    ledger.mark("daily", "2024-01-02", "2024-01-04")
    ledger.mark("daily", "2024-01-05", "2024-01-05", "started")
    assert [str(r.day) for r in ledger.days_left("daily", "2024-01-01", "2024-01-05").orderBy("day").collect()] == ["2024-01-01", "2024-01-05"]
    ledger.purge(90)
    assert ledger.table.read().count() == 2
    parts, calls = Parts(spark, str(tmp_path / "p")), []

    def make():
        calls.append(1)
        return spark.range(3)

    parts.run("a", make)
    parts.run("a", make)
    parts.run("b", make)
    assert len(calls) == 2 and parts.all().count() == 6


def _files(spark, tmp_path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))


def test_streams(spark, tmp_path):
    schema = "k string, t timestamp_ntz, v double, s string"
    from datetime import datetime as d

    batches = [[("a", d(2024, 1, 1, 1), 1.0, "x"), ("a", d(2024, 1, 1, 2), 3.0, "x")], [("a", d(2024, 1, 1, 3), 5.0, "y"), ("b", d(2024, 1, 2), 7.0, "x"), ("a", d(2024, 1, 1, 1), 1.0, "x")]]
    _files(spark, tmp_path / "in", batches, schema)
    src = lambda: streams.file_stream(spark, str(tmp_path / "in"))
    means = streams.run_available(streams.tumbling_means(src(), "t", "k", "v", late="30 days"), "complete")
    assert {(r.k, r.mean_value, r.n) for r in means.collect()} == {("a", 2.5, 4), ("b", 7.0, 1)}
    assert streams.run_available(streams.first_of_each(src(), "t", ["k", "t"], "30 days")).count() == 4
    seen = []
    check = str(tmp_path / "check")
    streams.run_available(src(), checkpoint=check, each=lambda b, n: seen.append(b.count()))
    streams.run_available(src(), checkpoint=check, each=lambda b, n: seen.append(b.count()))
    assert sum(seen) == 5  # the second run finds nothing new


def test_runs_of_states(spark, tmp_path):
    from datetime import datetime as d

    _files(spark, tmp_path / "in", [[("a", d(2024, 1, 1, i), 0.0, s) for i, s in enumerate("xxyyyx")]], "k string, t timestamp_ntz, v double, s string")
    out = streams.run_available(streams.runs(streams.file_stream(spark, str(tmp_path / "in")), "k", "t", "s")).orderBy("run").collect()
    assert [(r.state, r.n) for r in out] == [("x", 2), ("y", 3)]


def test_appends_write_what_is_new_only_and_rewrites_refuse_to_lose_rows(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "k int, v string")
    for k in range(3):
        t.append(spark.createDataFrame([(k, "a")], "k int, v string"))
    assert [n.split("-")[1] for n in t._parts()] == ["add"] * 3 and t.read().count() == 3
    since = t._last()
    t.append(spark.createDataFrame([(9, "b")], "k int, v string"))
    with pytest.raises(RuntimeError):
        t.replace(t.read().where("k = 0"), since)
    assert t.read().count() == 4
    t.compact()
    assert [n.split("-")[1] for n in t._parts()] == ["all"] and t.read().count() == 4
    assert not t._take(0) and t._take(t._last() + 1)


def test_deleted_repeats_are_reported(spark, tmp_path):
    t = Table(spark, str(tmp_path / "d"), "k int, s string, v string")
    t.append(spark.createDataFrame([(1, None, "x"), (2, None, "x"), (3, "a", None), (4, "a", None), (None, "a", None), (5, "b", "y")], "k int, s string, v string"))
    assert t.delete_repeats(["s", "v"], "k") == {"before": 6, "after": 3, "deleted": 3}
    assert sorted(r.k for r in t.read().collect()) == [2, 4, 5]
    empty = Table(spark, str(tmp_path / "e"), "k int")
    assert empty.delete_repeats(["k"], "k")["deleted"] == 0


def test_csv_with_one_header(spark, tmp_path):
    for v in (1, 2):
        files.append_csv(spark.createDataFrame([(v, "a,b")], "k int, s string"), str(tmp_path / "h"))
    assert (tmp_path / "h" / "_header").read_text() == "k,s\n"
    assert sorted(map(tuple, files.read_delimited(spark, str(tmp_path / "h"), "k int, s string", sep=",").collect())) == [(1, "a,b"), (2, "a,b")]
