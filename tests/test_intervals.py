import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from sableflow.operators.intervals import ledger_periods, merge_sorted, periods_and_gaps

SCHEMA = "id bigint, db_path string, start_date string, end_date string, processing_mode string, kind string"


def brute(rows):
    days = {}
    for _, db, s, e, mode, _ in rows:
        try:
            a, b = date.fromisoformat(s.strip()[:10]), date.fromisoformat(e.strip()[:10])
        except (AttributeError, ValueError):
            continue
        if a <= b:
            got = days.setdefault((db, mode.strip().lower() if mode is not None else None), set())
            got.update(a + timedelta(i) for i in range((b - a).days + 1))
    out = set()
    for (db, mode), d in days.items():
        d = sorted(d)
        runs, start = [], d[0]
        for x, y in zip(d, d[1:] + [None]):
            if y is None or y != x + timedelta(1):
                runs.append((start, x))
                start = y
        for a, b in runs:
            out.add((db, mode, "period", str(a), str(b)))
        for (_, b), (a, _) in zip(runs, runs[1:]):
            out.add((db, mode, "gap", str(b + timedelta(1)), str(a - timedelta(1))))
    return out


def test_against_days_in_sets(spark):
    rng = random.Random(4)
    rows = []
    for i in range(1500):
        a = date(2023, 1, 1) + timedelta(rng.randrange(300))
        b = a + timedelta(rng.randrange(-2, 9))
        db = "hot.db" if rng.random() < 0.4 else f"l{rng.randrange(20)}.db"  # one ledger has a third of all rows
        suffix = rng.choice(["", "T00:00:00", " 23:59:59"])
        rows.append((i, db, str(a) + suffix, str(b) + suffix, rng.choice(["daily", " Daily ", "DAILY", "weekly", None]), "extra"))
    rows += rows[:200] + [(1, "n.db", None, "2023-01-01", "daily", None), (2, "n.db", "2023-01-01", "", "daily", None), (3, "n.db", "soon", "2023-01-01", "daily", None), (4, None, "2023-01-01", "2023-01-02", "daily", None)]
    got = {tuple(r) for r in ledger_periods(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert ledger_periods(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", "2024-01-01", "2024-01-03", 1, 2, [3])], "k string, s string, e string, kind int, keys int, starts array<int>")
    out = periods_and_gaps(df, [F.col("k")], F.to_date("s"), F.to_date("e")).collect()
    assert [(r.kind, str(r.first_day), str(r.last_day)) for r in out] == [("period", "2024-01-01", "2024-01-03")]


def test_merge_is_independent_of_the_order():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 500, 200)
    e = s + rng.integers(0, 5, 200)
    whole = merge_sorted(s, e)
    parts = [merge_sorted(s[i::3], e[i::3]) for i in range(3)]
    again = merge_sorted(np.concatenate([p[0] for p in reversed(parts)]), np.concatenate([p[1] for p in reversed(parts)]))
    assert all((a == b).all() for a, b in zip(whole, again))
