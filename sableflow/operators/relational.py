"""Relational operators that are more than one DataFrame call, as declarative plans."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def strip_names(df: DataFrame) -> DataFrame:
    """Column names without outer blanks; of columns that then share a name the first stays."""
    seen: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        seen.setdefault(c.strip(), i)
    marked = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return marked.select(*(F.col(f"c{i}").alias(c) for c, i in seen.items()))


def prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    """All columns but `keep` with a prefix, so that joined sources don't clash."""
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(f"{prefix}_{c}") for c in df.columns))


def keep_first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group; the order must be unique for a fixed result."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def fill_median_mode(df: DataFrame, numeric: list[str], categories: list[str]) -> DataFrame:
    """Nulls become the column's median, or its most frequent value (of several the smallest). One aggregated row is joined."""
    stats = df.agg(*(F.median(c).alias(f"_{c}") for c in numeric), *(F.mode(c, True).alias(f"_{c}") for c in categories))
    joined = df.join(F.broadcast(stats))  # a single row
    return joined.select(*(F.coalesce(c, f"_{c}").alias(c) if c in [*numeric, *categories] else F.col(c) for c in df.columns))


def snippet(column: str, n: int) -> Column:
    return F.when(F.length(column) > n, F.concat(F.left(column, F.lit(n)), F.lit("..."))).otherwise(F.col(column))


def positional_split(df: DataFrame, order: list[str], share: float) -> DataFrame:
    """`part` by position in the order. Positions are counted from range partitions' sizes, so no task sees the whole table."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    from sableflow.session import cut

    ranged = cut(ranged)
    sizes = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # one row per partition
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    if not total:
        return df.withColumn("part", F.lit("train"))
    start = F.create_map(*(F.lit(v) for kv in before.items() for v in kv))[F.col("_p")]
    at = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + start
    return ranged.withColumn("part", F.when(at <= math.floor(total * share), "train").otherwise("test")).drop("_p")


def bucket_of(column: str, buckets: int) -> Column:
    """A bucket by hash that is the same on every engine: the first six hexadecimal digits of the MD5."""
    return F.conv(F.left(F.md5(F.col(column).cast("string")), F.lit(6)), 16, 10).cast("bigint") % buckets


def insert_if_absent(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys the old table lacks; null keys are never there already."""
    return new.join(old.select(*keys), keys, "left_anti")


def interval_join(left: DataFrame, right: DataFrame, at: str, seconds: int) -> DataFrame:
    """Pairs at most `seconds` apart, columns prefixed l_ and r_. An equi-join on time bins: the left side enters its neighbours too."""
    bin_of = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (seconds * 1_000_000))
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in left.columns), F.explode(F.sequence(bin_of - 1, bin_of + 1)).alias("_bin"))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), bin_of.alias("_bin"))
    gap = F.abs(F.unix_micros(F.col(f"l_{at}").cast("timestamp")) - F.unix_micros(F.col(f"r_{at}").cast("timestamp")))
    return a.join(b, "_bin").where(gap <= seconds * 1_000_000).drop("_bin")


def count_overlaps(df: DataFrame, keys: list[str], row: str, start: str, end: str) -> DataFrame:
    """How many overlapping pairs each group has, counted at the later row of each pair by sweeping over starts and ends.

    Ranges that end before they start overlap where both inequalities hold, as in SQL; they are compared pair by pair,
    being few. No pair is made for the others.
    """
    good, odd = df.where(F.col(start) <= F.col(end)), df.where(F.col(start) > F.col(end))
    events = good.select(*keys, F.col(start).alias("t"), F.lit(0).alias("kind")).unionByName(good.select(*keys, F.col(end).alias("t"), F.lit(1).alias("kind")))
    tally = events.groupBy(*keys, "t").agg(F.count_if(F.col("kind") == 0).alias("opened"), F.count_if(F.col("kind") == 1).alias("closed"))
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    running = tally.select(*keys, "opened", F.coalesce(F.sum(F.col("opened") - F.col("closed")).over(w), F.lit(0)).alias("open"))
    # a start at t meets all that are open and, once each, those that start at t too
    pairs = running.groupBy(*keys).agg(F.sum(F.col("opened") * F.col("open") + F.col("opened") * (F.col("opened") - 1) / 2).cast("bigint").alias("overlaps"))
    a, b = (x.select(*keys, *(F.col(c).alias(f"{p}_{c}") for c in (row, start, end))) for p, x in (("a", odd), ("b", df)))
    cond = (F.col(f"a_{start}") <= F.col(f"b_{end}")) & (F.col(f"a_{end}") >= F.col(f"b_{start}"))
    once = (F.col(f"b_{start}") <= F.col(f"b_{end}")) & (F.col(f"a_{row}") != F.col(f"b_{row}")) | (F.col(f"a_{row}") < F.col(f"b_{row}"))
    return pairs.unionByName(a.join(b, keys).where(cond & once).groupBy(*keys).agg(F.count("*").alias("overlaps")))


def overlapping_circles(circles: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """circles: i, x, y, r. Pairs i < j that overlap by more than the tolerance, by an equi-join on grid cells as wide as the largest circle."""
    width = circles.agg(F.max("r")).first()[0]
    if width is None:
        return circles.sparkSession.createDataFrame([], "i bigint, j bigint, gap double")
    cell = max(2.0 * width, 1e-9)
    at = circles.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    near = F.explode(F.sequence(F.col("cx") - 1, F.col("cx") + 1))
    a = at.select("i", "x", "y", "r", near.alias("cx"), "cy").select("i", "x", "y", "r", "cx", F.explode(F.sequence(F.col("cy") - 1, F.col("cy") + 1)).alias("cy"))
    b = at.select(F.col("i").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("r").alias("r2"), "cx", "cy")
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    gap = F.sqrt(dx * dx + dy * dy) - F.col("r") - F.col("r2")
    return a.join(b, ["cx", "cy"]).where("i < j").withColumn("gap", gap).where(F.col("gap") < -tolerance).select("i", "j", F.round("gap", 6).alias("gap"))


def on_calendar(df: DataFrame, day: str) -> DataFrame:
    """One row per day between the first and the last, with nulls on days that had none."""
    return df.agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day)).join(df, day, "left")


def daily_as_of(df: DataFrame, day: str, value: str) -> DataFrame:
    """Each day's latest known value. Filled inside calendar years, then from the years before, so no window spans all days."""
    x = on_calendar(df, day).withColumn("_y", F.year(day))
    inside = F.last(value, True).over(Window.partitionBy("_y").orderBy(day).rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn(value, inside)
    ends = x.groupBy("_y").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(day))).alias("_e"))  # one row per year
    ends = ends.withColumn("_e", F.last("_e", True).over(Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, 0)))
    before = ends.select((F.col("_y") + 1).alias("_y"), "_e")
    return x.join(F.broadcast(before), "_y", "left").select(day, F.coalesce(value, "_e").alias(value))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r) for every pair of columns over the rows where both are present, in one aggregation; null without variance."""
    aggs = []
    for a, b in combinations(columns, 2):
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        corr = F.try_divide(F.covar_samp(x, y), F.nullif(F.stddev_samp(x) * F.stddev_samp(y), F.lit(0.0)))
        aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(corr, 6).alias("r")))
    return df.agg(F.array(*aggs).alias("m")).select(F.explode("m").alias("x")).select("x.*")


def regression_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    e = F.col(actual) - F.col(predicted)
    x = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull()).groupBy(*keys)
    return x.agg(
        F.count("*").alias("n"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"), F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.round(1 - F.try_divide(F.sum(e * e), F.nullif(F.var_pop(actual) * F.count("*"), F.lit(0.0))), 6).alias("r2"),
    )


def majority_vote(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The most frequent value per group, of several the one seen first, and its votes."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    best = votes.groupBy(*keys).agg(F.max_by(F.struct(value, "votes"), F.struct("votes", -F.col("_first"))).alias("m"))
    return best.select(*keys, f"m.{value}", "m.votes")


def allocate(df: DataFrame, name: str, weight: str, total: int) -> DataFrame:
    """Shares of `total` by weight, rounded down but at least 1; what is left goes one by one to the heaviest."""
    share = df.agg(F.sum(weight).alias("_w"))
    x = df.join(F.broadcast(share)).select(name, weight, F.greatest(F.lit(1), F.floor(F.col(weight) / F.col("_w") * total).cast("int")).alias("base"))
    spare = x.agg((F.lit(total) - F.sum("base")).alias("_spare"))
    ranked = x.join(F.broadcast(spare)).withColumn("_rn", F.row_number().over(Window.orderBy(F.desc(weight), name)))  # one row per name
    return ranked.select(name, (F.col("base") + F.when(F.col("_rn") <= F.col("_spare"), 1).otherwise(0)).cast("int").alias("quota"))


def grid(spark: SparkSession, **values: list) -> DataFrame:
    """All combinations of the given values."""
    out = spark.range(1)
    for k, v in values.items():
        out = out.withColumn(k, F.explode(F.array(*map(F.lit, v))))
    return out.drop("id")


def month_ranges(df: DataFrame, column: str) -> DataFrame:
    months = df.agg(F.explode(F.sequence(F.to_date(F.date_trunc("month", F.min(column))), F.to_date(F.date_trunc("month", F.max(column))), F.expr("interval 1 month"))).alias("first_day"))
    return months.select("first_day", F.last_day("first_day").alias("last_day"))


def days_left(ranges: DataFrame, start: str, end: str, first: str, last: str) -> DataFrame:
    """Days of a period that no range covers; ranges are cut to the period before they are unfolded."""
    lo, hi = F.lit(first).cast("date"), F.lit(last).cast("date")
    cut = ranges.select(F.greatest(start, lo).alias("a"), F.least(end, hi).alias("b")).where("a <= b").distinct()
    done = cut.select(F.explode(F.sequence("a", "b")).alias("day")).distinct()
    return ranges.sparkSession.range(1).select(F.explode(F.sequence(lo, hi)).alias("day")).join(done, "day", "left_anti")


def similar_vectors(queries: DataFrame, vectors: DataFrame, least: float, block: int = 2000) -> DataFrame:
    """(query_id, vec_id, cosine) at least `least`: a stated query set against all rows, in blocks of queries.

    A block's vectors are normalised on the driver and handed to all tasks; each task multiplies them with its rows.
    """
    import numpy as np
    import pyarrow as pa

    spark, out = vectors.sparkSession, None
    ids = queries.select("vec_id", "embedding").where("embedding is not null").orderBy("vec_id")
    rows: list = []
    blocks = []
    for row in ids.toLocalIterator():
        rows.append((row.vec_id, np.asarray(row.embedding, np.float64)))
        if len(rows) == block:
            blocks.append(rows)
            rows = []
    blocks += [rows] if rows else []

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    for part in blocks:
        shared = spark.sparkContext.broadcast((np.array([i for i, _ in part]), unit(np.stack([v for _, v in part]))))

        def of(batches, shared=shared):  # noqa: ANN001, ANN202
            qid, q = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                vid, dim = batch.column(0).to_numpy(), q.shape[1]
                v = unit(batch.column(1).flatten().to_numpy().astype(np.float64).reshape(-1, dim))
                c = q @ v.T
                a, b = np.nonzero(c >= least)
                keep = qid[a] != vid[b]
                yield pa.RecordBatch.from_arrays([pa.array(qid[a][keep]), pa.array(vid[b][keep]), pa.array(np.round(c[a, b][keep], 5))], names=["query_id", "vec_id", "cosine"])

        found = vectors.select("vec_id", "embedding").where("embedding is not null").mapInArrow(of, "query_id bigint, vec_id bigint, cosine double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id bigint, vec_id bigint, cosine double")


def depths(df: DataFrame, node: str, parent: str, most: int = 60) -> DataFrame:
    """(id, depth) of every node below a root, by doubling pointers: the number of joins grows with the logarithm of the depth."""
    from sableflow.session import cut

    x = df.select(F.col(node).alias("id"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(most):
        if x.where("up is not null").isEmpty():
            break
        above = x.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        x = cut(x.join(above, "up", "left").select("id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return x.select("id", "depth")


def union_all(*parts: DataFrame) -> DataFrame:
    """By name; columns a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def not_in(df: DataFrame, column: str, other: DataFrame, key: str) -> DataFrame:
    """Rows as NOT IN gives them: none if the other side has a null, none with a null of their own unless the other side is empty."""
    keys = other.select(F.col(key).alias("_k")).distinct()
    nulls = keys.where("_k is null").limit(1).count()
    if nulls:
        return df.limit(0)
    left = df.join(keys, F.col(column) == F.col("_k"), "left_anti")
    return left if keys.isEmpty() else left.where(F.col(column).isNotNull())


def allocate_by_worth(df: DataFrame, name: str, worth: list[str], total: int) -> DataFrame:
    """Shares of `total` by the product of the columns, rounded down but at least 1.

    Where the ones of small shares take the sum over the total, all shares are scaled down in proportion (and stay at 1
    at least); what is left goes one by one to the heaviest.
    """
    product = F.lit(1.0)
    for c in worth:
        product = product * F.coalesce(F.col(c), F.lit(0.0))
    x = df.select(name, product.alias("_w"))
    x = x.join(F.broadcast(x.agg(F.sum("_w").alias("_sum"))))  # one row
    x = x.withColumn("_base", F.greatest(F.lit(1), F.floor(F.try_divide(F.col("_w"), F.col("_sum")) * total).cast("int")))
    x = x.join(F.broadcast(x.agg(F.sum("_base").alias("_all"))))  # one row
    x = x.withColumn("_base", F.when(F.col("_all") > total, F.greatest(F.lit(1), F.floor(F.col("_base") * total / F.col("_all")).cast("int"))).otherwise(F.col("_base")))
    spare = x.agg((F.lit(total) - F.sum("_base")).alias("_spare"))
    ranked = x.join(F.broadcast(spare)).withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("_w"), name)))  # one row per name
    return ranked.select(name, (F.col("_base") + F.when(F.col("_rn") <= F.col("_spare"), 1).otherwise(0)).cast("int").alias("quota"))


def with_topic(df: DataFrame, topics: str, topic: str) -> DataFrame:
    """Rows whose topics (a JSON text: one topic, a list, or objects with an id) hold the topic; rows without readable topics stay out."""
    plain = F.from_json(topics, "array<string>")
    ids = F.transform(F.coalesce(plain, F.array(F.trim(topics))), lambda x: F.coalesce(F.get_json_object(x, "$.id"), F.get_json_object(x, "$"), F.trim(x)))
    return df.where(F.array_contains(ids, topic))


def key_of_minute(at: str, title: str, letters: int = 50) -> Column:
    """A key for rows without one: the instant rounded to the minute and the beginning of the title."""
    minute = F.date_format(F.date_trunc("minute", F.col(at) + F.expr("interval 30 seconds")), "yyyy-MM-dd HH:mm")
    return F.concat(minute, F.lit("_"), F.left(title, F.lit(letters)))
