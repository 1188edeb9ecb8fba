import numpy as np
import pytest
from pyspark.sql import functions as F

from sableflow.operators.mart import grid_search

CONFIGS = [(0, 0.01, 1), (1, 1.0, 2), (2, 100.0, 3)]


def data(spark, n):
    noise = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(1000)) / 100
    x = spark.range(n).select("id", (F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 101).cast("double").alias("b"), noise.alias("noise"))
    return x.select("id", "a", "b", (3 * F.col("a") - F.col("b") * F.col("b") / 50 + F.col("noise")).alias("y"))


@pytest.mark.parametrize("n", [3_000, 400_000])
def test_grid_search_takes_all_rows(spark, n):
    x = data(spark, n)
    configs = spark.createDataFrame(CONFIGS, "config bigint, penalty double, degree int")
    got = {r.config: r for r in grid_search(x, "y", ["a", "b"], configs, "id").collect()}
    p = x.withColumn("test", F.pmod(F.pmod(F.xxhash64("id"), F.lit(1_000_000)), F.lit(100)) < 20).toPandas()
    test = p["test"].to_numpy()
    v, y = p[["a", "b"]].to_numpy(), p["y"].to_numpy()
    z = (v - v[~test].mean(axis=0)) / v[~test].std(axis=0)
    for config, penalty, degree in CONFIGS:
        a = np.hstack([np.ones((n, 1)), *(z**k for k in range(1, degree + 1))])
        w = np.linalg.solve(a[~test].T @ a[~test] + penalty * np.eye(a.shape[1]), a[~test].T @ y[~test])
        e = (y - a @ w)[test]
        r = got[config]
        assert r.n == test.sum()
        assert (r.rmse, r.mae) == pytest.approx((np.sqrt((e**2).mean()), np.abs(e).mean()), rel=1e-8)
        assert r.r2 == pytest.approx(1 - (e**2).sum() / ((y[test] - y[test].mean()) ** 2).sum(), abs=1e-8)


def test_grid_search_without_rows(spark):
    configs = spark.createDataFrame(CONFIGS, "config bigint, penalty double, degree int")
    got = grid_search(data(spark, 0), "y", ["a", "b"], configs, "id").collect()
    assert len(got) == 3 and all(np.isnan(r.rmse) and r.n == 0 for r in got)
