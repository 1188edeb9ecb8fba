"""Continuous periods and gaps of overlapping day ranges, per entity.

The aggregate's state is a sorted list of disjoint, non-adjacent intervals. Two states combine by one linear merge,
so partial states can be combined in any order. The reduction tree has three levels:

1. every input partition folds its own rows into one state per entity (no shuffle);
2. states of an entity that come from different partitions meet in `fan_in` salted groups;
3. the salted states of an entity meet once more, and periods and complements are emitted.

A state never holds more intervals than there are separated periods on the calendar, whatever the number of rows, so an
entity that owns a third of all rows costs its last task no more than any other.

Defined results: rows whose start or end is null, empty or no date cover nothing, and so do rows that end before they
start; repeated rows and ties change nothing; null keys form an entity of their own; an entity without any valid range
has no rows; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_STATE = "slot int, keys array<string>, starts array<int>, ends array<int>"


def merge_sorted(starts: np.ndarray, ends: np.ndarray, touch: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals covering the same days; intervals up to `touch` apart belong together."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")  # runs that are sorted already are merged in linear time
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, s[1:] > reach[:-1] + touch]
    return s[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(s) - 1]]


def _fold(batches: Iterator[pa.RecordBatch], n_keys: int, fan_in: int) -> Iterator[pa.RecordBatch]:
    """Level 1: one state per entity and input partition. Rows are folded batch by batch, so memory holds states only."""
    states: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    slot = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        slot = slot or hash_bytes(batch)
        s = batch.column(n_keys).to_numpy(zero_copy_only=False).astype(np.int64)
        e = batch.column(n_keys + 1).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys)), strict=True))
        codes: dict[tuple, int] = {}
        code = np.fromiter((codes.setdefault(k, len(codes)) for k in keys), np.int64, len(keys))
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(len(codes) + 1))
        for k, i in codes.items():
            rows = order[bounds[i] : bounds[i + 1]]
            a, b = states.get(k, (s[:0], e[:0]))
            states[k] = merge_sorted(np.concatenate([a, s[rows]]), np.concatenate([b, e[rows]]))
    yield from _rows(states, slot % fan_in)


def hash_bytes(batch: pa.RecordBatch) -> int:
    """A number that differs from partition to partition and is the same when a task runs again."""
    import zlib

    return 1 + zlib.crc32(repr(batch.slice(0, 1).to_pylist()).encode())


def _rows(states: dict, slot: int, step: int = 2000) -> Iterator[pa.RecordBatch]:
    items = sorted(states.items(), key=lambda x: [(v is not None, v) for v in x[0]])
    for i in range(0, len(items), step):
        part = items[i : i + step]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([slot] * len(part), pa.int32()),
                pa.array([list(k) for k, _ in part], pa.list_(pa.string())),
                pa.array([v[0].astype(np.int32) for _, v in part], pa.list_(pa.int32())),
                pa.array([v[1].astype(np.int32) for _, v in part], pa.list_(pa.int32())),
            ],
            names=["slot", "keys", "starts", "ends"],
        )


def _combine(starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    out = [
        merge_sorted(np.concatenate([np.asarray(x, np.int64) for x in s]), np.concatenate([np.asarray(x, np.int64) for x in e]))
        for s, e in zip(starts, ends, strict=True)
    ]
    return pd.DataFrame({"starts": [a.astype(np.int32) for a, _ in out], "ends": [b.astype(np.int32) for _, b in out]})


def periods_and_gaps(df: DataFrame, keys: list[Column], start: Column, end: Column, fan_in: int = 8) -> DataFrame:
    """Periods and gaps per entity, as rows (keys array<string>, kind, first_day date, last_day date).

    keys are strings; start and end are dates, both included. fan_in is the width of the middle level of the tree.
    """
    n = len(keys)
    combine = F.pandas_udf(_combine, "struct<starts:array<int>,ends:array<int>>")
    epoch = F.lit("1970-01-01").cast("date")
    rows = (
        df.select(*(k.cast("string").alias(f"k{i}") for i, k in enumerate(keys)), F.datediff(start, epoch).alias("s"), F.datediff(end, epoch).alias("e"))
        .where("s is not null and e is not null and s <= e")
        .mapInArrow(lambda batches: _fold(batches, n, fan_in), _STATE)
    )

    def level(states: DataFrame, *by: str) -> DataFrame:
        met = states.groupBy(*by).agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
        return met.withColumn("m", combine("starts", "ends")).select(*by, "m.starts", "m.ends")

    done = level(level(rows, "keys", "slot"), "keys")
    periods = F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(F.lit("period").alias("kind"), x["starts"].alias("a"), x["ends"].alias("b")))
    gaps = F.transform(
        F.arrays_zip(F.slice("starts", 2, F.size("starts")).alias("next"), F.slice("ends", 1, F.size("ends") - 1).alias("last")),
        lambda x: F.struct(F.lit("gap").alias("kind"), (x["last"] + 1).alias("a"), (x["next"] - 1).alias("b")),
    )
    return done.select("keys", F.explode(F.concat(periods, gaps)).alias("x")).select(
        "keys", "x.kind", F.date_add(epoch, F.col("x.a")).alias("first_day"), F.date_add(epoch, F.col("x.b")).alias("last_day")
    )


def day_of(column: str) -> Column:
    """The day a text starts with, else null."""
    return F.to_date(F.try_to_timestamp(F.substring(F.trim(F.col(column)), 1, 10), F.lit("yyyy-MM-dd")))


def ledger_periods(ranges: DataFrame) -> DataFrame:
    """Periods and gaps of every ledger file and processing mode (lower case, without outer blanks)."""
    mode = F.lower(F.trim(F.col("processing_mode"), F.lit(" \t\r\n")))
    out = periods_and_gaps(ranges, [F.col("db_path"), mode], day_of("start_date"), day_of("end_date"))
    return out.select(
        F.col("keys")[0].alias("db_path"), F.col("keys")[1].alias("processing_mode"), "kind",
        F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), F.date_format("last_day", "yyyy-MM-dd").alias("last_day"),
    )
