"""Feature marts: sources joined on the days of the richest one, filled, extended, and searched over a grid of settings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sableflow.operators.relational import prefixed


def spine(sources: dict[str, DataFrame], day: str) -> DataFrame:
    """The distinct days of the source that has most of them; of several the first."""
    counts = {n: s.agg(F.count_distinct(day)).first()[0] for n, s in sources.items()}  # one number per source
    best = max(counts, key=lambda n: counts[n])
    return sources[best].where(F.col(day).isNotNull()).select(day).distinct()


def feature_mart(sources: dict[str, DataFrame], day: str, how: str = "left") -> DataFrame:
    """All sources on the spine's days, columns prefixed by their source's name; each source has one row per day."""
    parts = [prefixed(s, n, [day]) for n, s in sources.items()]
    if how == "inner":
        return reduce(lambda a, b: a.join(b, day), parts)
    return reduce(lambda a, b: a.join(b, day, "left"), parts, spine(sources, day))


def ordinal(day: Column) -> Column:
    return F.datediff(day, F.lit("0001-01-01").cast("date")) + 1


def engineered(df: DataFrame, first: str, second: str) -> DataFrame:
    """The product of two features and the logarithm of one plus each, negatives as 0."""
    logs = {f"log_{c}": F.log1p(F.greatest(F.col(c), F.lit(0.0))) for c in (first, second)}
    return df.withColumns({f"{first}_x_{second}": F.col(first) * F.col(second), **logs})


def importances(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """(feature, importance): squared correlation with the target over complete pairs, in one aggregation."""
    def r2(c: str) -> Column:
        x, y = F.when(F.col(target).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(target))
        r = F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))
        return r * r

    return df.agg(F.array(*(F.struct(F.lit(c).alias("feature"), r2(c).alias("importance")) for c in features)).alias("m")).select(F.explode("m").alias("x")).select("x.*")


def pruned(importance: DataFrame, share: float = 0.01) -> DataFrame:
    """Features of at least the share of the greatest importance."""
    top = importance.agg(F.max("importance").alias("_top"))
    return importance.join(F.broadcast(top)).where(F.col("importance") >= share * F.col("_top")).drop("_top")


RESULT = "config bigint, penalty double, degree int, rmse double, mae double, r2 double, n bigint"


def grid_search(df: DataFrame, target: str, features: list[str], configs: DataFrame, key: str, test_share: int = 20) -> DataFrame:
    """Ridge regression for every configuration (config, penalty, degree), scored on a hash-held-out share.

    Fitted and scored over all rows without nulls, in three aggregations: means, the normal equations of the highest
    degree (lower ones are their leading part), and sums of errors. The driver gets these sums and the configurations.
    Without training or held-out rows the scores are NaN.
    """
    numbers = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate([target, *features])]
    rows = df.select((F.pmod(F.pmod(F.xxhash64(key), F.lit(1_000_000)), F.lit(100)) < test_share).alias("test"), *numbers).na.drop()
    grid = configs.select("config", "penalty", "degree").collect()
    xs = [f"x{i + 1}" for i in range(len(features))]
    stats = {r["test"]: r for r in rows.groupBy("test").agg(F.count("*").alias("n"), F.avg("x0").alias("y"), *(f(c).alias(f"{k}_{c}") for k, f in (("mean", F.avg), ("std", F.stddev_pop)) for c in xs)).collect()}
    train, held = stats.get(False), stats.get(True)
    if not grid or not train or not held:
        nan = float("nan")
        return df.sparkSession.createDataFrame([(int(c.config), float(c.penalty), int(c.degree), nan, nan, nan, held["n"] if held else 0) for c in grid], RESULT)
    mean, std = np.array([train[f"mean_{c}"] for c in xs]), np.array([train[f"std_{c}"] for c in xs]) + 1e-12
    highest, y_mean = max(int(c.degree) for c in grid), held["y"]

    def design(data: pd.DataFrame) -> np.ndarray:
        z = (data[xs].to_numpy(float) - mean) / std
        return np.hstack([np.ones((len(z), 1)), *(z**k for k in range(1, highest + 1))])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for batch in batches:
            a = np.column_stack([design(batch), batch["x0"].to_numpy(float)])
            total = total + a.T @ a
        if not np.isscalar(total):
            yield pd.DataFrame({"place": np.arange(total.size), "v": total.ravel()})

    width = 1 + len(features) * highest
    gram = np.zeros((width + 1) ** 2)
    for r in rows.where("not test").mapInPandas(products, "place int, v double").groupBy("place").agg(F.sum("v").alias("v")).collect():
        gram[r["place"]] = r["v"]
    gram = gram.reshape(width + 1, width + 1)
    weights = np.zeros((width, len(grid)))
    for i, c in enumerate(grid):
        m = 1 + len(features) * int(c.degree)
        weights[:m, i] = np.linalg.solve(gram[:m, :m] + float(c.penalty) * np.eye(m), gram[:m, -1])

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        square, size, spread = np.zeros(len(grid)), np.zeros(len(grid)), 0.0
        for batch in batches:
            y = batch["x0"].to_numpy(float)
            e = y[:, None] - design(batch) @ weights
            square, size, spread = square + (e**2).sum(axis=0), size + np.abs(e).sum(axis=0), spread + ((y - y_mean) ** 2).sum()
        yield pd.DataFrame({"i": np.arange(len(grid)), "square": square, "size": size, "spread": spread})

    sums = rows.where("test").mapInPandas(errors, "i int, square double, size double, spread double").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("square", "size", "spread"))).collect()
    n, out = held["n"], []
    for r in sums:
        c = grid[r["i"]]
        r2 = 1 - r["square"] / r["spread"] if r["spread"] else float("nan")
        out.append((int(c.config), float(c.penalty), int(c.degree), float(np.sqrt(r["square"] / n)), r["size"] / n, r2, n))
    return df.sparkSession.createDataFrame(out, RESULT)
