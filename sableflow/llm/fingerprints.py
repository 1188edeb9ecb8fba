"""Fingerprints of texts whose bit difference follows the similarity of their word runs, and candidate pairs from them.

A text's set is the set of hashes of its distinct runs of `run` words. The fingerprint holds one byte for each of
BYTES independent minimum hashes of the set: a byte is equal in two texts with the probability of their similarity J
(shared runs by all runs) and differs in half its bits otherwise, so the expected bit difference is
4 * BYTES * (1 - J). Four bytes make a segment; two texts with J agree in at least one of the 40 segments with
probability 1 - (1 - J**4)**40: 0.996 at 0.6, 0.9996 at 0.65, 0.99998 at 0.7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sableflow.functions.words import chunks, mix64, run_hashes, words
from sableflow.session import cut, saved

BYTES = 160
SEGMENT = 4
SEGMENTS = BYTES // SEGMENT
FEATURES = "id bigint, digest binary, fp binary, runs array<int>"
PAIRS = "a bigint, b bigint, hot bigint"


def _hash_family(n: int, seed: int = 20210) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32), rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1)


def run_sets(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct run hashes (32 bits) of all texts and the number of the text each belongs to."""
    h, owner, _, _ = words(texts)
    x, own = run_hashes(h, owner, run)
    keys = np.unique(own.astype(np.uint64) << np.uint64(32) | x >> np.uint64(32))
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32)).astype(np.int64)


def sketch(runs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (rows of BYTES bytes) and digests (rows of two 64-bit numbers) of the sets that begin at `starts`."""
    xor, mult = _hash_family(BYTES)
    fp = np.empty((len(starts), BYTES), np.uint8)
    for k in range(BYTES):
        v = (runs ^ xor[k]) * mult[k]
        v ^= v >> np.uint32(15)
        fp[:, k] = np.minimum.reduceat(v, starts) * np.uint32(0x9E3779B1) >> np.uint32(24)
    wide = runs.astype(np.uint64)
    digest = np.stack([np.add.reduceat(mix64(wide + np.uint64(s)), starts) for s in (0x1234567, 0x9ABCDEF0123)], axis=1)
    return fp, digest


def features(rows: DataFrame, run: int) -> DataFrame:
    """rows: id, text. One row per text with at least one run; texts that are null or too short have none."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                runs, owner = run_sets(texts[a:b], run)
                if not len(runs):
                    continue
                starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                fp, digest = sketch(runs, starts)
                offsets = np.r_[starts, len(runs)].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[a + owner[starts]], pa.int64()),
                        pa.array([x.tobytes() for x in digest], pa.binary()),
                        pa.array([x.tobytes() for x in fp], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(runs.view(np.int32))),
                    ],
                    names=["id", "digest", "fp", "runs"],
                )

    return rows.select("id", "text").where("text is not null and text != ''").mapInArrow(of, FEATURES)


def fp_array(column: pa.Array) -> np.ndarray:
    """A binary column of fingerprints as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BYTES)


def segment_keys(fps: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray], *carry: str) -> DataFrame:
    """One row (key, id, *carry) for each segment of each fingerprint; carried columns are bigint.

    keys_of takes rows of segments (32 bits) and gives a 64-bit key for each; the number of the segment is mixed in.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _salted(keys_of(np.ascontiguousarray(fp_array(batch.column(0))).view(np.uint32)))
                rest = [pa.array(np.repeat(c.to_numpy(zero_copy_only=False), SEGMENTS), pa.int64()) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *rest], names=["key", "id", *carry])

    return fps.select("fp", "id", *carry).mapInArrow(of, "key bigint, id bigint" + "".join(f", {c} bigint" for c in carry))


def _salted(keys: np.ndarray) -> np.ndarray:
    return mix64(keys ^ np.arange(1, keys.shape[1] + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def refined_keys(hot: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(key, id) for rows (fp, id, hot) of a hot segment: its key with that of each run of three bytes outside of it.

    Two texts at similarity 0.6 that share a segment share one of these with probability 1 - 3e-6.
    """
    width = SEGMENT - 1
    n = BYTES // width

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = np.ascontiguousarray(fp_array(batch.column(0)))
            ids, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
            segment = (_salted(keys_of(raw.view(np.uint32))).view(np.int64) == own[:, None]).argmax(axis=1)
            small = np.zeros((len(raw), n, SEGMENT), np.uint8)
            small[:, :, :width] = raw[:, : n * width].reshape(len(raw), n, width)
            keys = mix64(_salted(keys_of(small.view(np.uint32)[:, :, 0])) ^ own.view(np.uint64)[:, None])
            first = np.arange(n) * width
            outside = (first + width <= segment[:, None] * SEGMENT) | (first >= (segment[:, None] + 1) * SEGMENT)
            yield pa.RecordBatch.from_arrays([pa.array(keys[outside].view(np.int64)), pa.array(np.repeat(ids, outside.sum(axis=1)), pa.int64())], names=["key", "id"])

    return hot.select("fp", "id", "hot").mapInArrow(of, "key bigint, id bigint")


def _in_groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return starts, np.diff(np.r_[starts, len(sorted_keys)])


def _pairs_of(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs (earlier, later) inside the given groups."""
    left, right = [], []
    for d in range(1, int(sizes.max(initial=1))):
        s, n = starts[sizes > d], sizes[sizes > d] - d
        first = np.repeat(s - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        left.append(first)
        right.append(first + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (starts[:0], starts[:0])


def bucket_pairs(keyed: DataFrame, most: int | None, marked: bool = False) -> DataFrame:
    """Pairs of ids that share a key, as (a, b, null), reading each key's rows as one sorted stream.

    A key with more than `most` rows is emitted row by row as (id, null, key) instead, for refinement: no group is
    gathered, however large. marked: keyed has a column `new`, and only pairs whose later id is new are wanted.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, new, hot = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), None

        def out(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(a), 200_000):
                part, none = slice(i, i + 200_000), pa.nulls(len(a[i : i + 200_000]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a[part]), none if b is None else pa.array(b[part]), none if key is None else pa.array(key[part])], names=["a", "b", "hot"])

        def flush(k: np.ndarray, x: np.ndarray, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(k):
                return
            starts, sizes = _in_groups(k)
            big = sizes > most if most else np.zeros(len(sizes), bool)
            if big.any():
                rows = np.repeat(big, sizes)
                yield from out(x[rows], None, k[rows])
            some = (sizes > 1) & ~big
            a, b = _pairs_of(starts[some], sizes[some])
            keep = (x[a] != x[b]) & (not marked or fresh[b] == 1)  # rows of a key are sorted by id
            yield from out(x[a[keep]], x[b[keep]], None)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
            ids = np.concatenate([ids, batch.column(1).to_numpy(zero_copy_only=False)])
            new = np.concatenate([new, batch.column(2).to_numpy(zero_copy_only=False)])
            if hot is not None:  # the group that is streamed out already may go on
                n = int(np.searchsorted(keys != hot, True)) if (keys != hot).any() else len(keys)
                yield from out(ids[:n], None, keys[:n])
                keys, ids, new = keys[n:], ids[n:], new[n:]
                hot = hot if not len(keys) else None
            if not len(keys):
                continue
            open_ = int(np.flatnonzero(keys != keys[-1])[-1] + 1) if keys[0] != keys[-1] else 0
            yield from flush(keys[:open_], ids[:open_], new[:open_])
            keys, ids, new = keys[open_:], ids[open_:], new[open_:]
            if most and len(keys) > most:
                hot = keys[-1]
                yield from out(ids, None, keys)
                keys, ids, new = keys[:0], ids[:0], new[:0]
        yield from flush(keys, ids, new)

    if not marked:
        return keyed.repartition("key").sortWithinPartitions("key", "id").select("key", "id", F.lit(1).cast("bigint").alias("new")).mapInArrow(of, PAIRS)
    return keyed.repartition("key").sortWithinPartitions("key", "id").select("key", "id", "new").mapInArrow(of, PAIRS)


def candidates(keyed: DataFrame, prints_of: Callable[[DataFrame], DataFrame], keys_of: Callable[[np.ndarray], np.ndarray], most: int = 200, dense: int = 50) -> tuple[DataFrame, DataFrame | None]:
    """keyed: key, id, new. Distinct pairs (a < b) of ids that share the key of a segment, the later one new; and members of dense groups.

    Keys shared by more than `most` rows are refined: their rows meet again under refined_keys(). Where more than `dense`
    rows meet under one of those, which only texts with much in common do, no pairs are made; such rows come back as
    (id, label), the label naming their group of groups, for dense_links(). prints_of gives (id, fp) of a table of ids.
    """
    first = saved(bucket_pairs(keyed, most, marked=True).distinct())
    pairs, hot = first.where("b is not null").select("a", "b"), first.where("b is null").select(F.col("a").alias("id"), "hot")
    if hot.isEmpty():
        return pairs, None
    new = keyed.where("new = 1").select("id", "new").distinct()
    again = refined_keys(hot.join(prints_of(hot.select("id").distinct()), "id"), keys_of)
    again = again.join(new, "id", "left").select("key", "id", F.coalesce("new", F.lit(0).cast("bigint")).alias("new"))
    second = saved(bucket_pairs(again, dense, marked=True).distinct())
    pairs = pairs.unionByName(second.where("b is not null").select("a", "b")).distinct()
    rows = second.where("b is null").select(F.col("a").alias("id"), "hot")
    return pairs, None if rows.isEmpty() else groups_of_groups(rows)


def groups_of_groups(rows: DataFrame) -> DataFrame:
    """(id, label) from (id, hot): ids that share a group, directly or through others, get the same label (the smallest id).

    Smallest labels are passed on from ids to groups and back, and a label takes over the label it got itself, until
    nothing changes; every round is an aggregation with partial sums, so no group is gathered.
    """
    labels = cut(rows.select("id", F.col("id").alias("label")).distinct())
    while True:
        of_group = rows.join(labels, "id").groupBy("hot").agg(F.min("label").alias("label"))
        passed = rows.join(of_group, "hot").groupBy("id").agg(F.min("label").alias("label"))
        jumped = passed.join(passed.select(F.col("id").alias("label"), F.col("label").alias("next")), "label", "left")
        now = cut(jumped.select("id", F.least("label", F.coalesce("next", "label")).alias("label")))
        if now.join(labels.withColumnRenamed("label", "was"), "id").where("label != was").isEmpty():
            return now
        labels = now


LINKS = "a bigint, b bigint, similarity double"


def dense_links(members: DataFrame, sets: DataFrame, threshold: float, block: int = 1000) -> DataFrame:
    """Links (a < b, similarity) inside the groups of `members` (id, label, new) whose later id is new. sets: id, fp, runs.

    A group is dealt out over blocks of about `block` rows, new ones and others apart, and every pair of blocks with a
    new one is a task of its own: fingerprints are compared first, then the sets by a product of their incidence
    matrices. So the work is in proportion to the pairs of a group, each looked at once, and no task holds more than two blocks.
    """
    sizes = members.groupBy("label").agg(F.ceil(F.sum("new") / block).alias("n_new"), F.ceil(F.sum(1 - F.col("new")) / block).alias("n_old"))
    x = members.join(sizes, "label")
    own = F.when(F.col("new") == 1, F.pmod(F.xxhash64("id"), F.col("n_new"))).otherwise(F.col("n_new") + F.pmod(F.xxhash64("id"), F.greatest("n_old", F.lit(1))))
    last = F.when(F.col("new") == 1, F.col("n_new") + F.col("n_old")).otherwise(F.col("n_new"))
    x = x.where("n_new > 0").select("id", "label", "new", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("bigint"), last - 1)).alias("other"))
    x = x.select("id", "label", "new", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    limit = most_bits(threshold)

    def of(key: tuple, t: pa.Table) -> pa.Table:
        ids, new, own = (t.column(c).to_numpy() for c in ("id", "new", "own"))
        prints = fp_array(t.column("fp").combine_chunks()).view(np.uint64)
        lists = t.column("runs").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        row, (_, run) = np.repeat(np.arange(len(ids)), size), np.unique(lists.flatten().to_numpy(), return_inverse=True)
        left = np.flatnonzero(own == own.min())
        right = np.flatnonzero(own == own.max())
        both = np.zeros((len(left), len(right)), np.int32)
        place = np.full(len(ids), -1)
        sides = []
        for side in (left, right):
            place[:] = -1
            place[side] = np.arange(len(side))
            sides.append((place[row][place[row] >= 0], run[place[row] >= 0]))
        shared = np.intersect1d(sides[0][1], sides[1][1])
        for k in range(0, len(shared), 2048):
            columns, parts = shared[k : k + 2048], []
            for (r, c), side in zip(sides, (left, right), strict=True):
                inside = (c >= columns[0]) & (c <= columns[-1])
                at = np.searchsorted(columns, c[inside])
                hit = columns[at] == c[inside]
                m = np.zeros((len(side), len(columns)), np.float32)
                m[r[inside][hit], at[hit]] = 1
                parts.append(m)
            both += np.rint(parts[0] @ parts[1].T).astype(np.int32)
        similarity = both / (size[left][:, None] + size[right][None, :] - both)
        x, y = np.nonzero(similarity >= threshold)
        s, x, y = similarity[x, y], left[x], right[y]
        a, b = np.where(ids[x] < ids[y], x, y), np.where(ids[x] < ids[y], y, x)
        keep = (ids[a] != ids[b]) & (new[b] == 1) & ((key[1] != key[2]) | (ids[x] < ids[y]))
        keep[keep] &= np.bitwise_count(prints[a[keep]] ^ prints[b[keep]]).sum(axis=1) <= limit
        return pa.table({"a": pa.array(ids[a[keep]], pa.int64()), "b": pa.array(ids[b[keep]], pa.int64()), "similarity": pa.array(s[keep], pa.float64())})

    return x.join(sets.select("id", "fp", "runs"), "id").groupBy("label", "i", "j").applyInArrow(of, LINKS)


def most_bits(threshold: float, sigmas: float = 6.0) -> int:
    """The bit difference that texts at the threshold exceed only beyond so many standard deviations."""
    q = 1 - threshold
    return int(4 * BYTES * q + sigmas * (BYTES * (18 * q - 16 * q * q)) ** 0.5)


def within_bits(pairs: DataFrame, fps: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b, ...) whose fingerprints differ in at most `limit` bits."""
    cols = pairs.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (fp_array(batch.column(i)).view(np.uint64) for i in (len(cols), len(cols) + 1))
                keep = np.bitwise_count(x ^ y).sum(axis=1) <= limit
                yield pa.RecordBatch.from_arrays(batch.columns[: len(cols)], names=cols).filter(pa.array(keep))

    a, b = (fps.select(F.col("id").alias(c), F.col("fp").alias(f"fp_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select(*cols, "fp_a", "fp_b").mapInArrow(of, pairs.schema)


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sets reach the threshold, with the exact similarity. sets: id, runs."""
    a, b = (sets.select(F.col("id").alias(c), F.col("runs").alias(f"runs_{c}")) for c in "ab")
    both = F.size(F.array_intersect("runs_a", "runs_b"))
    x = pairs.join(a, "a").join(b, "b").withColumn("both", both)
    x = x.withColumn("similarity", F.col("both") / (F.size("runs_a") + F.size("runs_b") - F.col("both")))
    return x.where(F.col("similarity") >= threshold).drop("runs_a", "runs_b", "both")
