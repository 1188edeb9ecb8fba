import random

import pytest

from sableflow.llm import fingerprints as fp
from sableflow.llm.arrivals import TABLES, ArrivalStore
from tests.llm.test_near_duplicates import corpus, runs_of

SCHEMA = "id bigint, doc string, text string, key string"


def brute(rows, history):
    """Positions above the history's that repeat an id or a similar text at a smaller one."""
    out = set()
    sets = {p: runs_of(t, 3) if t else set() for p, _, t, _ in rows}
    for p, doc, _, _ in rows:
        if p >= history:
            for q, other, _, _ in rows:
                if q < p and (doc and doc == other or sets[p] and sets[q] and len(sets[p] & sets[q]) >= 0.6 * len(sets[p] | sets[q])):
                    out.add(p)
    return out


def stream(seed=9):
    rng = random.Random(seed)
    texts = [t for _, t in corpus(seed, 30)]
    rng.shuffle(texts)
    rows = [(i, f"d{rng.randrange(500)}", t, "k") for i, t in enumerate(texts)]
    return rows + [(len(rows), None, None, None), (len(rows) + 1, "", "", None), (len(rows) + 2, "", "too short", None), (len(rows) + 3, None, rows[0][2], None), (len(rows) + 4, rows[1][1], None, None)]


def test_in_one_call_and_batch_by_batch(spark, tmp_path):
    rows = stream()
    cut = len(rows) // 2
    want = brute(rows, cut)
    whole = ArrivalStore(spark, f"{tmp_path}/a", run=3, threshold=0.6)
    whole.append(spark.createDataFrame(rows[:cut], SCHEMA))
    assert {r.id for r in whole.check(spark.createDataFrame(rows[cut:], SCHEMA)).collect()} == want
    steps, got = ArrivalStore(spark, f"{tmp_path}/b", run=3, threshold=0.6), set()
    steps.append(spark.createDataFrame(rows[:cut], SCHEMA))
    for a in range(cut, len(rows), 30):
        got |= {r.id for r in steps.check(spark.createDataFrame(rows[a : a + 30], SCHEMA)).collect()}
    assert got == want
    assert steps.docs().count() == whole.docs().count()


def test_new_store_and_empty_batch(spark, tmp_path):
    store = ArrivalStore(spark, f"{tmp_path}/c", run=3, threshold=0.6)
    assert store.check(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a", "one two three four five", None), (2, "b", "one two three four five", None), (3, "a", "quite another text of words", None)]
    assert {(r.id, r.why) for r in store.check(spark.createDataFrame(rows, SCHEMA)).collect()} == {(2, "same text"), (3, "id")}


def test_hot_blocks_are_refined_and_dense_groups_compared(spark, tmp_path, monkeypatch):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, None, base + f" x{i} y{i}", None) for i in range(30)] + [(30, None, " ".join(f"z{i}" for i in range(60)), None)]
    for dense in (50, 3):
        plain = fp.candidates
        monkeypatch.setattr(fp, "candidates", lambda *a, plain=plain, dense=dense: plain(*a[:3], 3, dense))
        store = ArrivalStore(spark, f"{tmp_path}/d{dense}", run=3, threshold=0.6)
        store.append(spark.createDataFrame(rows[:20], SCHEMA))
        assert {r.id for r in store.check(spark.createDataFrame(rows[20:], SCHEMA)).collect()} == set(range(20, 30))
        monkeypatch.undo()


def test_failed_appends_leave_nothing_and_compaction_keeps_all(spark, tmp_path, monkeypatch):
    rows = stream(3)[:40]
    store = ArrivalStore(spark, f"{tmp_path}/e", run=3, threshold=0.6, buckets=3)
    store.append(spark.createDataFrame(rows[:20], SCHEMA))
    before = {t: sorted(map(str, store._read(t).collect())) for t in TABLES}
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.check(spark.createDataFrame(rows[20:], SCHEMA))
    again = ArrivalStore(spark, f"{tmp_path}/e", run=3, threshold=0.6)
    assert again.buckets == 3 and {t: sorted(map(str, again._read(t).collect())) for t in TABLES} == before
    got = {r.id for r in again.check(spark.createDataFrame(rows[20:], SCHEMA)).collect()}
    assert got == brute(rows, 20)
    full = {t: sorted(map(str, again._read(t).collect())) for t in TABLES}
    again.compact()
    assert len(again.batches) == 1 and {t: sorted(map(str, again._read(t).collect())) for t in TABLES} == full
    # a new session finds the partitions by the log alone
    for t in TABLES:
        spark.sql(f"DROP TABLE {again._table(t)}")
    other = ArrivalStore(spark, f"{tmp_path}/e", run=3, threshold=0.6)
    assert other.batches == again.batches and {t: sorted(map(str, other._read(t).collect())) for t in TABLES} == full


def test_history_is_not_shuffled(spark, tmp_path):
    """A look-up reads the history's buckets in place: above the scan of the store there is a join, no exchange."""
    store = ArrivalStore(spark, f"{tmp_path}/f", run=3, threshold=0.6)
    store.append(spark.createDataFrame(stream(5)[:40], SCHEMA))
    batch = spark.createDataFrame([(i, f"d{i}") for i in range(50)], "key bigint, doc string")
    for table, column in (("blocks", "key"), ("ids", "doc")):
        plan = store._looked_up(table, batch.select(column))._jdf.queryExecution().sparkPlan().toString()
        prepared = store._looked_up(table, batch.select(column))._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan
        assert prepared.count("Exchange") == 1, prepared  # the batch's keys


def rows_shuffled(spark, work):
    """Shuffle records written by all stages that run in work()."""
    store = spark.sparkContext._jsc.sc().statusStore()
    sc = spark.sparkContext
    none, no_quantiles = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)

    def written():
        stages = store.stageList(none, False, False, no_quantiles, none)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    work()
    return sum(n for k, n in written().items() if k not in before)


def test_rows_moved_depend_on_the_batch_not_on_the_history(spark, tmp_path):
    rng = random.Random(1)

    def texts(first, n):
        return [(first + i, f"h{first + i}", " ".join(f"v{rng.randrange(100_000)}" for _ in range(40)), None) for i in range(n)]

    moved = []
    batch = texts(1_000_000, 60)
    for n in (150, 1500):
        store = ArrivalStore(spark, f"{tmp_path}/g{n}", run=3, threshold=0.6)
        store.append(spark.createDataFrame(texts(0, n), SCHEMA))
        moved.append(rows_shuffled(spark, lambda store=store: store.check(spark.createDataFrame(batch, SCHEMA)).collect()))
    assert 0 < moved[1] < 1.1 * moved[0]
