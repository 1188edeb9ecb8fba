"""Tables as Parquet folders: create, insert what is absent, delete, describe, ledgers and resumable parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Table:
    """A folder of numbered parts: "all" parts hold the whole table, "add" parts are added to the newest of these.

    Inserts write what is new only; deletes and compact() write an "all" part. Numbers are taken by creating a file that
    must not exist, so two writers never share one, and a part counts once its _SUCCESS is there: readers never see half
    a change, and lost executors leave only unused files. A rewrite refuses if another part was begun since it read.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str) -> None:
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _hadoop(self, path: str):  # noqa: ANN202
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[str]:
        path, fs = self._hadoop(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _last(self) -> int:
        """The highest number that was taken; -1 before the first."""
        taken = self._listed(f"{self.root}/_numbers")
        return int(taken[-1]) if taken else -1

    def _take(self, number: int) -> bool:
        path, fs = self._hadoop(f"{self.root}/_numbers/{number:09d}")
        try:
            fs.create(path, False).close()
        except Exception as e:
            if "already exists" not in str(e):
                raise
            return False
        return True

    def _parts(self) -> list[str]:
        """The parts that make up the table now."""
        done = [n for n in self._listed(self.root) if n[0] != "_" and self._hadoop(f"{self.root}/{n}/_SUCCESS")[1].exists(self._hadoop(f"{self.root}/{n}/_SUCCESS")[0])]
        whole = [i for i, n in enumerate(done) if n.endswith("-all")]
        return done[whole[-1] :] if whole else done

    def read(self) -> DataFrame:
        """The current rows; an empty table before the first write."""
        parts = self._parts()
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{n}" for n in parts)) if parts else self.spark.createDataFrame([], self.schema)

    def _write(self, df: DataFrame, number: int, kind: str) -> None:
        df.select(*self.spark.createDataFrame([], self.schema).columns).write.parquet(f"{self.root}/{number:09d}-{kind}")

    def append(self, df: DataFrame) -> None:
        number = self._last() + 1
        while not self._take(number):
            number += 1
        self._write(df, number, "add")

    def replace(self, df: DataFrame, since: int | None = None) -> None:
        """df becomes the table. since: the last number when df was read; another writer's later one makes this fail."""
        number = (self._last() if since is None else since) + 1
        if not self._take(number):
            raise RuntimeError("the table was changed by another writer; read it again")
        self._write(df, number, "all")

    def compact(self) -> None:
        """One part in place of many."""
        since = self._last()
        if len(self._parts()) > 1:
            self.replace(self.read(), since)

    def insert_absent(self, df: DataFrame, keys: list[str]) -> None:
        """Appends rows whose keys are new; of rows with equal keys in df one is taken. Rows with a null key are always new."""
        known = F.lit(True)
        for k in keys:
            known = known & F.col(k).isNotNull()
        self.append(df.where(known).dropDuplicates(keys).unionByName(df.where(~known)).join(self.read().select(*keys), keys, "left_anti"))

    def delete(self, condition: str) -> None:
        """Rows for which the condition is true go; unknown is not true."""
        since = self._last()
        self.replace(self.read().where(~F.coalesce(F.expr(condition), F.lit(False))), since)

    def delete_ids(self, ids: DataFrame, key: str) -> None:
        since = self._last()
        self.replace(self.read().join(ids.select(key).distinct(), key, "left_anti"), since)

    def delete_repeats(self, keys: list[str], order: str, newest: bool = True) -> dict[str, int]:
        """Of rows with equal keys (nulls equal each other) only the newest (or oldest) by `order` stays. Gives counts before, after and deleted, read back from what was written."""
        since, rows = self._last(), self.read()
        before = rows.count()
        w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(order) if newest else F.asc_nulls_last(order), F.xxhash64(*rows.columns))
        self.replace(rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn"), since)
        after = self.read()
        kept = after.count()
        if kept != after.select(*keys).distinct().count():
            raise RuntimeError("repeated keys are left")
        return {"before": before, "after": kept, "deleted": before - kept}

    def describe(self) -> list[tuple[str, str]]:
        return self.read().dtypes


class Ledger:
    """Which day ranges are processed already, per mode."""

    SCHEMA = "mode string, first_day date, last_day date, status string, at timestamp"

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.table = Table(spark, root, self.SCHEMA)

    def mark(self, mode: str, first_day: str, last_day: str, status: str = "done") -> None:
        row = self.table.spark.range(1).select(F.lit(mode).alias("mode"), F.lit(first_day).cast("date").alias("first_day"), F.lit(last_day).cast("date").alias("last_day"), F.lit(status).alias("status"), F.current_timestamp().alias("at"))
        self.table.append(row)

    def overlapping(self, mode: str, first_day: str, last_day: str) -> DataFrame:
        return self.table.read().where((F.col("mode") == mode) & (F.col("status") == "done") & (F.col("first_day") <= F.lit(last_day).cast("date")) & (F.col("last_day") >= F.lit(first_day).cast("date")))

    def days_left(self, mode: str, first_day: str, last_day: str) -> DataFrame:
        from sableflow.operators.relational import days_left

        return days_left(self.overlapping(mode, first_day, last_day), "first_day", "last_day", first_day, last_day)

    def purge(self, older_than_days: int) -> None:
        self.table.delete(f"at < current_timestamp() - interval {int(older_than_days)} days")


class Parts:
    """Results saved part by part, so that a run that broke off goes on with the parts it lacks."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/part={name}/_SUCCESS")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def done(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def run(self, name: str, make) -> DataFrame:  # noqa: ANN001 - callable without arguments
        if not self.done(name):
            make().write.mode("overwrite").parquet(f"{self.root}/part={name}")
        return self.spark.read.parquet(f"{self.root}/part={name}")

    def all(self) -> DataFrame:
        return self.spark.read.option("basePath", self.root).parquet(self.root)
