"""Files: dated and delimited text with their usual defects, JSON lines, result folders, arrays; and their sinks."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sniff_delimiter(spark: SparkSession, path: str, candidates: str = ",;\t|") -> str:
    """The delimiter of a text file, from its first lines only; a comma if nothing tells."""
    head = "\n".join(r.value for r in spark.read.text(path).limit(20).collect())[:4096]
    try:
        return csv.Sniffer().sniff(head, delimiters=candidates).delimiter
    except csv.Error:
        return ","


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str | None = None, required: str | None = None) -> DataFrame:
    """A delimited file with or without a header: the first line is taken as a header only if it starts with the required (or the schema's first) column.

    Columns are read by position, so a missing header costs nothing.
    """
    sep = sep or sniff_delimiter(spark, path)
    names = T.StructType.fromDDL(schema).fieldNames()
    first = spark.read.text(path).limit(1).collect()
    header = bool(first) and first[0].value.lstrip("﻿").split(sep)[0].strip().strip('"').lower() == (required or names[0]).lower()
    return spark.read.schema(schema).option("header", header).option("sep", sep).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)


def thousands(c: Column) -> Column:
    """'1,234.5' as 1234.5; anything else that is no number is null."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def leading_day(c: Column) -> Column:
    """The day in the first ten characters, null if they are none."""
    return F.to_date(F.try_to_timestamp(F.substring(c, 1, 10), F.lit("yyyy-MM-dd")))


def read_json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """generation, combined_score, public, private, text_feedback, correct: from gen_*/results/metrics.json and correct.json."""
    gen = F.regexp_extract(F.input_file_name(), r"gen_(\d+)", 1).cast("int")
    metrics = spark.read.schema("combined_score double, public map<string,double>, private map<string,double>, text_feedback string").option("multiLine", True).json(f"{root}/gen_*/results/metrics.json")
    correct = spark.read.schema("correct boolean, error string").option("multiLine", True).json(f"{root}/gen_*/results/correct.json")
    return metrics.withColumn("generation", gen).join(correct.select(gen.alias("generation"), "correct"), "generation", "left")


def best_generation(results: DataFrame) -> DataFrame:
    """The correct generation with the highest score, of several the first."""
    return results.where("correct").agg(F.max_by(F.struct("generation", "combined_score"), F.struct("combined_score", -F.col("generation"))).alias("m")).select("m.*")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(name, i, values array<double>) of the rows of every array in .npz files; each file is opened by one task."""
    return arrays_of(spark.read.format("binaryFile").load(path)).drop("path")


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("header", True).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Appends rows without header; the header stands once, in _header, which readers of the folder pass over. `cat _header part-*` is one file with a header."""
    spark = df.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_header")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("append").option("header", False).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    if not fs.exists(at):
        out = fs.create(at)
        out.write((",".join(df.columns) + "\n").encode())
        out.close()


def write_arrays(df: DataFrame, path: str) -> None:
    """(file, name, i, values) as one .npz per file name: every task writes the files it has gathered, a file being one array set of bounded size."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"

    import pandas as pd

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        import io

        import numpy as np

        out = io.BytesIO()
        np.savez(out, **{n: np.array([list(v) for v in g.sort_values("i")["values"]]) for n, g in pdf.groupby("name")})
        return pd.DataFrame({"path": [key[0]], "modificationTime": [pd.Timestamp(0)], "length": [out.tell()], "content": [out.getvalue()]})

    df.groupBy("file").applyInPandas(of, schema).write.mode("overwrite").parquet(path)


def arrays_of(files: DataFrame) -> DataFrame:
    """(path, name, i, values) of the .npz contents in a table (path, content)."""

    def of(batches):  # noqa: ANN001, ANN202
        import io

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with np.load(io.BytesIO(content)) as z:
                    for name in z.files:
                        rows = np.atleast_2d(z[name].astype(np.float64)) if z[name].ndim != 1 else z[name].astype(np.float64)[:, None]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int32()), pa.array([list(r) for r in rows], pa.list_(pa.float64()))], names=["path", "name", "i", "values"])

    return files.select("path", "content").mapInArrow(of, "path string, name string, i int, values array<double>")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jdbc(spark: SparkSession, url: str, table_or_query: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A database table (or a query in brackets with an alias). With a numeric key the read is split into ranges; filters and columns are pushed down."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table_or_query).options(**options)
    if key:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()
