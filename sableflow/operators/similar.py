"""Similar contents of one source: all pairs at a Jaccard similarity of words or more, by a prefix-filter join.

Two word sets at the similarity share a word among the first n - ceil(share * n) + 1 of each, whatever the order of
words, so joining on these is exact. Words are compared by their 64-bit hashes and ordered by how often their hash bucket occurs, rare ones first; the
counts of 65,536 buckets are all the driver gets.

Defined results: rows without words are similar to nothing; a missing source is a source of its own; ids are unique;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sableflow.functions.joins import join_small
from sableflow.functions.text import word_set
from sableflow.session import saved

BUCKETS = 1 << 16
IDS = 1_000_000  # up to so many ids are broadcast


def similar_pairs(rows: DataFrame, share: float = 0.85, skip: DataFrame | None = None) -> DataFrame:
    """rows: id, source, content. (source, id, earlier) of the rows of one source at the similarity; earlier is the smaller id. skip: ids that take no part."""
    x = saved(rows.select("id", "source", F.transform(word_set(F.col("content")), lambda w: F.xxhash64(w)).alias("words")).where("size(words) > 0"))
    if skip is not None:
        x = join_small(x, skip, ["id"], "left_anti", IDS)
    counts = np.zeros(BUCKETS, np.int64)
    for r in x.select(F.explode("words").alias("h")).groupBy(F.pmod("h", F.lit(BUCKETS)).alias("bucket")).agg(F.count("*").alias("n")).collect():
        counts[r["bucket"]] = r["n"]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
            kept, sizes = [], np.diff(starts)
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                h, n = values[a:b], int(b - a)
                kept.append(h[np.lexsort((h, counts[h % BUCKETS]))[: n - math.ceil(share * n - 1e-9) + 1]])
            many = [len(k) for k in kept]
            ids, source = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2))
            out = [*(np.repeat(v, many) for v in (ids, sizes, source)), np.concatenate(kept) if kept else np.empty(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["id", "n", "s", "h"])

    # the source is in the hash: others can only meet by accident and are compared below
    posts = x.select("id", "words", F.xxhash64("source").alias("s")).mapInArrow(prefixes, "id bigint, n int, s bigint, h bigint")
    posts = posts.select("id", "n", F.xxhash64("s", "h").alias("h"))
    a, b = (posts.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), "h") for k in ("earlier", "id"))
    near = (F.col("earlier") < F.col("id")) & (F.least("n_earlier", "n_id") >= share * F.greatest("n_earlier", "n_id") - 1e-9)
    pairs = saved(a.join(b, "h").where(near).select("earlier", "id").distinct())
    x = join_small(x, pairs.select("id").union(pairs.select("earlier")).distinct(), ["id"], "left_semi", IDS)
    first = x.select(F.col("id").alias("earlier"), F.col("source").alias("s"), F.col("words").alias("w"))
    both = pairs.join(first, "earlier").join(x, "id").where(F.col("s").eqNullSafe(F.col("source")))
    same = F.size(F.array_intersect("w", "words"))
    return both.where(same / (F.size("w") + F.size("words") - same) >= share).select("source", "id", "earlier")


def repeats(pairs: DataFrame) -> DataFrame:
    """The ids that are similar to an earlier kept one; ids that are similar only to such repeats are kept. In order of ids, per source."""

    def of(data: pd.DataFrame) -> pd.DataFrame:
        gone: set = set()
        for i, earlier in data.sort_values("id").groupby("id", sort=True)["earlier"]:
            if not gone.issuperset(earlier):
                gone.add(i)
        return pd.DataFrame({"id": sorted(gone)}, dtype="int64")

    return pairs.groupBy("source").applyInPandas(of, "id bigint")
