"""Roll-ups of judged cases, costs of model calls, archives of candidates, and other reports of evaluations.

Defined results: null verdicts are failed cases; groups without rows have no row; ties go to the smaller case or id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCEPTED = "ACCEPTED"


def case_rollup(cases: DataFrame, keys: list[str], maximise: bool = True) -> DataFrame:
    """cases: *keys, case_no, verdict, seconds, bytes, score. Per group: passed, failed, longest run, most memory in MiB, mean score (negated to be minimised)."""
    passed = F.coalesce(F.col("verdict") == ACCEPTED, F.lit(False))
    return cases.groupBy(*keys).agg(
        F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"), F.max("seconds").alias("max_seconds"),
        F.floor(F.max("bytes") / (1024 * 1024)).cast("bigint").alias("max_mib"), (F.avg("score") * (1 if maximise else -1)).alias("combined_score"),
    )


def representative_case(cases: DataFrame, keys: list[str], overall: str) -> DataFrame:
    """The case that shows a group's overall verdict (a column of the table): the first with that verdict, or the first of all."""
    order = F.struct((~F.coalesce(F.col("verdict") == F.col(overall), F.lit(False)) & (F.col(overall) != ACCEPTED)).alias("other"), F.col("case_no"))
    return cases.groupBy(*keys).agg(F.min(order).alias("_m")).select(*keys, F.col("_m.case_no").alias("case_no"))


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls: model, prompt_tokens, completion_tokens, ...; prices: model, input, output (a token's price). Adds cost; null for models without price."""
    p = prices.select("model", F.col("input").alias("_in"), F.col("output").alias("_out")).dropDuplicates(["model"])
    return calls.join(p, "model", "left").withColumn("cost", F.col("prompt_tokens") * F.col("_in") + F.col("completion_tokens") * F.col("_out")).drop("_in", "_out")


def within_budget(calls: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The first `most` calls of each group in the given order; the others are over budget."""
    return calls.withColumn("within", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= most)


def archive(candidates: DataFrame, keys: list[str], score: str, row: str, size: int) -> DataFrame:
    """The `size` best correct candidates of each group with their rank; equal scores in the order of their ids."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), row))
    return candidates.where("correct").withColumn("rank", rank).where(F.col("rank") <= size)


def run_score(sharpe: Column, max_drawdown: Column) -> Column:
    """Sharpe ratio less half the drawdown; never above -0.5 where the ratio is under 0.5."""
    out = sharpe - 0.5 * F.abs(max_drawdown)
    return F.when(sharpe < 0.5, F.least(out, F.lit(-0.5))).otherwise(out)


def arrays_as_text(df: DataFrame, keys: list[str], row: str, columns: list[str], name: str) -> DataFrame:
    """One text per group with a line "name[i] = (a, b)" for each row, in order of `row`."""
    values = F.concat_ws(", ", *(F.col(c).cast("string") for c in columns))
    line = F.concat(F.lit(f"{name}["), F.col(row).cast("string"), F.lit("] = ("), values, F.lit(")"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(row).alias("i"), line.alias("line"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))
