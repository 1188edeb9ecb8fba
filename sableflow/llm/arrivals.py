"""New batches against all history: a store of fingerprints in rotated block tables.

The store holds, for every text that has ever arrived, its position in the order of arrival, its id, the digest and
the runs of its set, and its fingerprint; the block tables hold for each of the 40 rotations of the fingerprint the
leading 32 bits and the position. A batch is fingerprinted once, its blocks are looked up for exact matches in the
tables (and among the batch itself), matches are verified by the bit difference of whole fingerprints and by the exact
similarity of the texts' sets, and the batch's own rows are appended. The history's texts are never read again.

All tables are bucketed by the column they are looked up with. A look-up shuffles the batch's keys to the buckets and
streams the history's past them where it lies, so nothing of the history is shuffled or sorted but the rows that match:
the rows moved depend on the batch, not on the history.

An append writes one partition of each table and then one row of a log. Only partitions in the log are read, so an
append that fails halfway leaves nothing behind but unread files. compact() rewrites many small partitions as one.

Positions are a bigint that grows with arrival. Several batches may be checked in one call: an arrival is compared with
everything at a smaller position, so the result is the same as batch by batch. One writer at a time.

Defined results: an arrival repeats when its id has occurred at a smaller position (null and empty ids never repeat) or
when its text is similar to one at a smaller position; null, empty and too short texts are similar to nothing; equal
texts are similar; repeated positions are not allowed; empty batches and an empty history give no rows; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sableflow.llm import fingerprints as fp
from sableflow.session import cut, saved

# columns and the column that buckets them
TABLES = {
    "ids": ("doc string, id bigint", "doc"),
    "docs": (fp.FEATURES, "id"),
    "digests": ("digest binary, id bigint", "digest"),
    "blocks": ("key bigint, id bigint", "key"),
}
LOG = "batch string, replaces array<string>, buckets int"


def block_words(segments: np.ndarray) -> np.ndarray:
    """The leading 32 bits of every rotation."""
    return segments.astype(np.uint64)


class ArrivalStore:
    """Fingerprints of all accepted and rejected arrivals under `folder`, which all executors share.

    buckets (by default the session's shuffle partitions) is fixed when the store is new.
    """

    def __init__(self, spark: SparkSession, folder: str, run: int = 5, threshold: float = 0.8, buckets: int | None = None) -> None:
        self.spark, self.folder, self.run, self.threshold = spark, folder, run, threshold
        self.name = "arrivals_" + hashlib.md5(folder.encode()).hexdigest()[:16]
        self.batches: list[str] = []
        log = self._log()
        self.buckets = log[0].buckets if log else buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        for t, (columns, by) in TABLES.items():
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self._table(t)} ({columns}, batch string) USING parquet PARTITIONED BY (batch) CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{folder}/{t}'"
            )
        self._refresh(log)

    def _table(self, name: str) -> str:
        return f"{self.name}_{name}"

    def _log(self) -> list:
        try:
            return self.spark.read.schema(LOG).parquet(f"{self.folder}/log").collect()
        except Exception as e:  # the store is new
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []

    def _refresh(self, log: list) -> None:
        gone = {b for r in log for b in r.replaces}
        batches = sorted(r.batch for r in log if r.batch not in gone)
        for t in TABLES:
            known = {r[0].removeprefix("batch=") for r in self.spark.sql(f"SHOW PARTITIONS {self._table(t)}").collect()}
            for b in batches:
                if b not in known:
                    self.spark.sql(f"ALTER TABLE {self._table(t)} ADD IF NOT EXISTS PARTITION (batch = '{b}')")
        self.batches = batches

    def _read(self, name: str, batches: list[str] | None = None) -> DataFrame:
        return self.spark.table(self._table(name)).where(F.col("batch").isin(self.batches if batches is None else batches)).drop("batch")

    def _write(self, name: str, rows: DataFrame, batch: str) -> None:
        by = TABLES[name][1]
        rows.repartition(self.buckets, by).createOrReplaceTempView(f"{self.name}_rows")
        columns = ", ".join(c.split()[0] for c in TABLES[name][0].split(", "))
        self.spark.sql(f"INSERT INTO {self._table(name)} PARTITION (batch = '{batch}') SELECT {columns} FROM {self.name}_rows")
        self.spark.catalog.dropTempView(f"{self.name}_rows")

    def _commit(self, batch: str, replaces: tuple[str, ...] = ()) -> None:
        row = self.spark.createDataFrame([(batch, list(replaces), self.buckets)], LOG)
        row.coalesce(1).write.mode("append").parquet(f"{self.folder}/log")
        self.batches = sorted({*self.batches, batch} - set(replaces))

    def _looked_up(self, name: str, keys: DataFrame) -> DataFrame:
        """The history's rows of the keys (one column, by which the table is bucketed)."""
        return self._read(name).join(keys.hint("shuffle_hash"), TABLES[name][1], "left_semi")

    def docs(self) -> DataFrame:
        return self._read("docs")

    def append(self, rows: DataFrame) -> None:
        """Add rows (id: position, doc: the article's id, text) to the store without a check."""
        batch, feats = self._fingerprinted(rows)
        self._append(batch, rows, feats, fp.segment_keys(self._firsts(feats).where("first = id").join(feats.select("id", "fp"), "id"), block_words))

    def _fingerprinted(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """The batch's features, written where they will stay, but not yet in the log."""
        batch = uuid.uuid4().hex
        self._write("docs", fp.features(rows, self.run), batch)
        return batch, self._read("docs", [batch])

    def _append(self, batch: str, rows: DataFrame, feats: DataFrame, blocks: DataFrame) -> None:
        self._write("ids", rows.where("doc is not null and doc != ''").groupBy("doc").agg(F.min("id").alias("id")), batch)
        self._write("digests", feats.groupBy("digest").agg(F.min("id").alias("id")), batch)
        self._write("blocks", blocks, batch)
        self._commit(batch)

    def _firsts(self, feats: DataFrame) -> DataFrame:
        """(id, digest, first): the smallest position with the same set of runs."""
        own = feats.select("digest", "id")
        first = self._looked_up("digests", own.select("digest")).unionByName(own).groupBy("digest").agg(F.min("id").alias("first"))
        return own.join(first, "digest")

    def repeated(self, batch: DataFrame, feats: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
        """(id, why) of the arrivals that are nothing new, and the blocks (key, id) of those whose set is; feats are the features of the batch."""
        # 1: ids seen before
        own = batch.where("doc is not null and doc != ''").select("doc", "id")
        first = self._looked_up("ids", own.select("doc")).unionByName(own).groupBy("doc").agg(F.min("id").alias("first"))
        by_id = own.join(first, "doc").where("first < id").select("id", F.lit("id").alias("why"))
        # 2: the same set of runs seen before
        seen = cut(self._firsts(feats).select("id", "first"))
        by_text = seen.where("first < id").select("id", F.lit("same text").alias("why"))
        # 3: similar texts, among the first of each set only
        fresh = feats.join(seen.where("first = id").select("id"), "id", "left_semi")
        blocks = saved(fp.segment_keys(fresh, block_words))
        met = self._looked_up("blocks", blocks.select("key")).withColumn("new", F.lit(0).cast("bigint"))
        keyed = met.unionByName(blocks.withColumn("new", F.lit(1).cast("bigint")))

        def of(ids: DataFrame, *columns: str) -> DataFrame:
            """Columns of old and new texts."""
            old = self._looked_up("docs", ids).select("id", *columns)
            return old.unionByName(fresh.select("id", *columns).join(ids, "id", "left_semi"))

        pairs, dense = fp.candidates(keyed, lambda ids: of(ids, "fp"), block_words, most)
        ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        close = cut(fp.within_bits(pairs, cut(of(ends, "fp")), fp.most_bits(self.threshold)))
        ends = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        links = fp.similar(close, cut(of(ends, "runs")), self.threshold).select("b")
        if dense is not None:
            new = fresh.select("id", F.lit(1).cast("bigint").alias("new"))
            marked = cut(dense.join(new, "id", "left").select("id", "label", F.coalesce("new", F.lit(0).cast("bigint")).alias("new")))
            links = links.unionByName(fp.dense_links(marked, of(marked.select("id"), "fp", "runs"), self.threshold).select("b"))
        by_links = links.select(F.col("b").alias("id"), F.lit("similar text").alias("why")).distinct()
        return by_id.unionByName(by_text).unionByName(by_links), blocks

    def check(self, batch: DataFrame, append: bool = True) -> DataFrame:
        """Check a batch (id: position, doc, text) and append it; gives (id, why), a row for each reason."""
        self._refresh(self._log())
        name, feats = self._fingerprinted(batch)
        found, blocks = self.repeated(batch, feats)
        found = cut(found)
        if append:
            self._append(name, batch, feats, blocks)
        return found

    def compact(self) -> None:
        """Rewrite all partitions as one, with one file a bucket."""
        old, batch = tuple(self.batches), uuid.uuid4().hex
        if len(old) > 1:
            for t in TABLES:
                self._write(t, self._read(t), batch)
            self._commit(batch, old)
