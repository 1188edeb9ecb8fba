"""Streams: files as they arrive, windows with a limit for late rows, bounded de-duplication, and runs kept as state."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sableflow.session import shared_folder


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of a folder (or one file), in order of arrival."""
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return stream.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return stream.parquet(path)


def tumbling_means(stream: DataFrame, at: str, key: str, value: str, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Mean and count per window and key; rows later than the limit are left out by the watermark."""
    x = stream.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", late)
    return x.groupBy(F.window("_t", width).alias("w"), key).agg(F.avg(value).alias("mean_value"), F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), key, "mean_value", "n"
    )


def first_of_each(stream: DataFrame, at: str, keys: list[str], within: str = "7 days") -> DataFrame:
    """Rows whose keys have not come within the limit before; the state is bounded by it."""
    return stream.withColumn("_t", F.col(at).cast("timestamp")).withWatermark("_t", within).dropDuplicatesWithinWatermark(keys).drop("_t")


RUNS = "key string, run bigint, state string, first_at timestamp, last_at timestamp, n bigint"
_STATE = "run bigint, state string, first_at timestamp, last_at timestamp, n bigint"


def runs(stream: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """Finished runs of equal states per key, in order of time inside each batch; the open run is the key's only state."""

    def of(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = list(held.get) if held.exists else None
        rows = pd.concat(list(batches)).sort_values("at", kind="stable")
        out = []
        for t, s in zip(rows["at"], rows["state"], strict=True):
            if now is None:
                now = [0, s, t, t, 1]
            elif now[1] == s:
                now[3], now[4] = max(now[3], t), now[4] + 1
            else:
                out.append((k[0], *now))
                now = [now[0] + 1, s, t, t, 1]
        if now is not None:
            held.update((int(now[0]), now[1], now[2].to_pydatetime() if hasattr(now[2], "to_pydatetime") else now[2], now[3].to_pydatetime() if hasattr(now[3], "to_pydatetime") else now[3], int(now[4])))
        yield pd.DataFrame(out, columns=["key", "run", "state", "first_at", "last_at", "n"])

    x = stream.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(state).cast("string").alias("state"))
    return x.groupBy("key").applyInPandasWithState(of, RUNS, _STATE, "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, each: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives the result as a table. A checkpoint that is used again continues where it ended."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={0 if mode == 'complete' else number}")
        if each is not None:
            each(batch, number)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint or f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        return spark.read.schema(stream.schema).parquet(f"{root}/out")
    except Exception as e:  # no batch came
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], stream.schema)
