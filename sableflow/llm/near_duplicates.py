"""Near-duplicate texts by pivot distance tables.

Texts with the same set of word runs form a class and are represented by their smallest id, so copies, however many,
cost one fingerprint. For every segment of a representative's fingerprint the table holds its Hamming distances to
REFERENCES reference words. By the triangle inequality two segments differ by at least the largest difference of
their coordinates; pairs survive where that is zero in some segment, which an equi-join on the packed coordinates
finds without looking at any other pair. Survivors are verified by the bit difference of whole fingerprints (six
standard deviations of slack) and by the exact similarity of the sets. Where many texts have much in common (edited
versions of one article by the thousand), their pairs are looked at once each, block by block, instead.

References over whole fingerprints would be of no use here: distances between unrelated texts concentrate, so a pair
at similarity 0 differs by less in every coordinate than the bit difference allowed at 0.6. The README has figures.

Defined results: null, empty and too short texts (fewer than `run` words) belong to no pair; repeated ids are not
allowed (ids are keys); equal texts have similarity 1; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sableflow.llm import fingerprints as fp
from sableflow.session import cut, saved

REFERENCES = 10


def reference_words(n: int = REFERENCES, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, n, dtype=np.uint32)


def pivot_coordinates(segments: np.ndarray) -> np.ndarray:
    """The packed Hamming distances (six bits each) of every 32-bit segment to the references."""
    out = np.zeros(segments.shape, np.uint64)
    for ref in reference_words():
        out = out << np.uint64(6) | np.bitwise_count(segments ^ ref).astype(np.uint64)
    return out


def near_duplicates(rows: DataFrame, run: int = 5, threshold: float = 0.8, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """rows: id (bigint key), text. Gives (members: id, rep) and (links between representatives: a, b, similarity)."""
    feats = saved(fp.features(rows, run))
    firsts = feats.groupBy("digest").agg(F.min(F.struct("id", "fp")).alias("m"), F.count("*").alias("n"))
    reps = saved(firsts.select("m.id", "m.fp", "digest", "n"))
    keyed = fp.segment_keys(reps, pivot_coordinates).withColumn("new", F.lit(1).cast("bigint"))
    pairs, dense = fp.candidates(keyed, lambda ids: reps.select("id", "fp").join(ids, "id", "left_semi"), pivot_coordinates, most)
    close = cut(fp.within_bits(pairs, reps, fp.most_bits(threshold)))
    ends = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(feats.select("id", "runs").join(ends, "id", "left_semi"))
    links = fp.similar(close, sets, threshold)
    if dense is not None:
        inside = fp.dense_links(dense.withColumn("new", F.lit(1).cast("bigint")), feats.join(dense.select("id"), "id", "left_semi"), threshold)
        links = links.select("a", "b", "similarity").unionByName(inside).dropDuplicates(["a", "b"])
    members = feats.select("id", "digest").join(reps.select("digest", F.col("id").alias("rep"), "n"), "digest").select("id", "rep", "n")
    return members, cut(links)


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (a < b) of ids: those inside a class and those between linked classes."""
    # a class of many copies meets itself in pieces of its key, so its pairs are made by many tasks
    many = members.where("n > 1").withColumn("pieces", F.ceil(F.col("n") / 1000))
    piece = F.pmod(F.xxhash64("id"), F.col("pieces"))
    first = many.select("rep", F.col("id").alias("a"), piece.alias("i"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("j"))
    second = many.select("rep", F.col("id").alias("b"), piece.alias("j"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("i"))
    inside = first.join(second, ["rep", "i", "j"]).where("a < b").select("a", "b")
    left, right = members.select(F.col("rep").alias("a"), F.col("id").alias("x")), members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return inside.unionByName(across)
