"""Aggregates from exchanges to samples and over the pool; all partial before their shuffle."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scores import min_max_scale, robust_scale
from tessera.functions.text import word_count
from tessera.operators.filters import relevant
from tessera.operators.joins import join_small


def mean_of_all(df: DataFrame, score: str, out: str) -> DataFrame:
    """Per sample the mean over all exchanges."""
    return df.groupBy("data_id").agg(F.avg(score).alias(out))


def mean_of_answered(df: DataFrame, score: str, out: str, skip_empty: bool = True, routed_only: bool = False) -> DataFrame:
    """Per sample the mean over exchanges that have a score (null: not routed) and, with ``skip_empty``, a
    response; 0 if there are none, or null with ``routed_only``."""
    s = F.when(F.col("response") != "", F.col(score)) if skip_empty else F.col(score)
    mean = F.avg(s)
    return df.groupBy("data_id").agg((mean if routed_only else F.coalesce(mean, F.lit(0.0))).alias(out))


def token_lengths(df: DataFrame, count: Column | None = None, response_count: Column | None = None) -> DataFrame:
    """``inst_length, resp_length, last_resp_length`` of each sample; the last is the length of the last
    response that has any, 0 without one."""
    i = count if count is not None else word_count(F.col("instruction"))
    r = response_count if response_count is not None else word_count(F.col("response"))
    rows = df.select("data_id", "exchange_idx", i.alias("i"), r.alias("r"))
    last = F.max_by("r", F.when(F.col("r") > 0, F.col("exchange_idx")))
    return rows.groupBy("data_id").agg(F.sum("i").alias("inst_length"), F.sum("r").alias("resp_length"), F.coalesce(last, F.lit(0)).alias("last_resp_length"))


def corpus_tokens(lengths: DataFrame) -> DataFrame:
    return lengths.agg(F.coalesce(F.sum(F.col("inst_length") + F.col("resp_length")), F.lit(0)).alias("tokens"))


def majority_label(df: DataFrame, label: str = "label", out: str = "setfit_label") -> DataFrame:
    """Per sample the most frequent label of its exchanges, of equally frequent ones the first met."""
    n = df.groupBy("data_id", label).agg(F.count(F.lit(1)).alias("n"), F.min("exchange_idx").alias("first"))
    return n.groupBy("data_id").agg(F.max_by(label, F.struct("n", -F.col("first"))).alias(out))


def dataset_stats(samples: DataFrame, turns: Column, group: str = "origin") -> DataFrame:
    """Samples, user messages and mean turns of each source."""
    return samples.groupBy(group).agg(F.count(F.lit(1)).alias("samples"), F.sum(turns).alias("user_messages"), F.avg(turns).alias("avg_turns"))


def composition(df: DataFrame, by: str) -> DataFrame:
    """Rows and their share by a column."""
    n = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a value


def histogram(df: DataFrame, column: str, bins: int = 200, by: str | None = None) -> DataFrame:
    """Rows in each of ``bins`` equal bins between the least and the largest value; nulls and NaN are left out."""
    x = F.nanvl(F.col(column).cast("double"), F.lit(None))
    rows = df.select(x.alias("x"), *([by] if by else [])).where("x is not null")
    ends = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    b = F.when(F.col("high") == F.col("low"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(bins - 1))).cast("int")
    return rows.crossJoin(F.broadcast(ends)).groupBy(b.alias("bin"), *([by] if by else [])).agg(F.count(F.lit(1)).alias("n"))  # one row of ends


#: Accuracy of the sketch by which exact quantiles are looked for: what is sorted is four rows in so many.
BRACKET = 10_000


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], group: str | None = None, accuracy: int | None = None) -> DataFrame:
    """Of each column the interpolated quantiles, as an array: one row, or one for each value of ``group`` with a
    value; nulls are left out. With ``accuracy`` from a sketch of bounded size, off by one row in ``accuracy``.

    Exact ones are found in two passes, and no task holds a column's values: a sketch gives a bracket for each quantile;
    then rows under a bracket are counted, and only the values in it, counted by value, are put in order.
    """
    g = F.col(group) if group else F.lit(0)
    if accuracy is not None:
        aggs = [F.percentile_approx(x, F.array(*[F.lit(q) for q in shares]), accuracy).alias(n) for n, x in columns.items()]
        return df.groupBy(g.alias("_g")).agg(*aggs).withColumnRenamed("_g", group) if group else df.agg(*aggs)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("m"), x.cast("double").alias("x")) for n, x in columns.items()]))
    long = df.select(g.alias("_g"), each.alias("e")).select("_g", "e.m", "e.x").where("x is not null").persist(StorageLevel.MEMORY_AND_DISK)  # numbers, read twice
    # the same value on many rows is one row from here on
    rows = long.groupBy("_g", "m", "x").agg(F.count(F.lit(1)).alias("c"))
    ends = [F.lit(min(1.0, max(0.0, q + d * 2 / BRACKET))) for q in shares for d in (-1, 1)]
    sketch = long.groupBy("_g", "m").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", F.array(*ends), BRACKET).alias("b"))
    at = join_small(rows, sketch.select(F.col("_g").alias("_h"), F.col("m").alias("_m"), "n", "b"), F.col("_g").eqNullSafe(F.col("_h")) & (F.col("m") == F.col("_m")))
    q = F.posexplode(F.array(*[F.struct(F.lit(float(x)).alias("q"), F.get("b", 2 * i).alias("lo"), F.get("b", 2 * i + 1).alias("hi")) for i, x in enumerate(shares)]))
    at = at.select("_g", "m", "x", "c", "n", q.alias("i", "s")).select("_g", "m", "i", "x", "c", ((F.col("n") - 1) * F.col("s.q")).alias("at"), "s.lo", "s.hi")
    # all rows under a bracket become one, with their largest value, and all above it one with their least
    zone = F.when(F.col("x") < F.col("lo"), 0).when(F.col("x") <= F.col("hi"), 1).otherwise(2)
    at = at.withColumn("zone", zone).groupBy("_g", "m", "i", "at", "zone", F.when(F.col("zone") == 1, F.col("x")).alias("k")).agg(F.sum("c").alias("c"), F.when(F.first("zone") == 0, F.max("x")).otherwise(F.min("x")).alias("x"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy("_g", "m", "i").orderBy("zone", "x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = at.withColumn("before", before)
    value = lambda k: F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("c")), F.col("x")))
    got = at.groupBy("_g", "m", "i", "at").agg(value(F.floor("at")).alias("a"), value(F.ceil("at")).alias("b"))
    whole = F.col("at") == F.floor("at")
    got = got.withColumn("v", F.when(whole | (F.col("a") == F.col("b")), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.floor("at")) * F.col("b")))
    lists = got.groupBy("_g", "m").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v"))
    out = lists.groupBy("_g").agg(*[F.max_by("v", F.when(F.col("m") == n, 1)).alias(n) for n in columns])
    if group:
        return out.withColumnRenamed("_g", group)
    return df.sparkSession.range(1).select(F.lit(0).alias("_z")).join(F.broadcast(out), F.col("_z") == F.col("_g"), "left").drop("_z", "_g")  # one row also of an empty table


def mean_and_median(df: DataFrame, column: str, accuracy: int | None = None) -> DataFrame:
    mid = quantiles(df, {"_q": F.col(column)}, [0.5], None, accuracy)
    return df.agg(F.avg(column).alias("mean")).crossJoin(F.broadcast(mid)).select("mean", F.get("_q", 0).alias("median"))  # a row each


def robust_fit(df: DataFrame, metrics: list[str], label: str = "setfit_label", accuracy: int | None = None) -> DataFrame:
    """One row: median and distance of the 1st and 99th percentile of each metric, over the samples it says
    something about; missing values count as 0."""
    x = {m: F.when(relevant(F.col(label), m), F.coalesce(F.nanvl(F.col(m), F.lit(None)), F.lit(0.0))) for m in metrics}
    q = quantiles(df, x, [0.01, 0.5, 0.99], None, accuracy)
    return q.select(*[c for m in metrics for c in (F.get(m, 1).alias(f"{m}_center"), (F.get(m, 2) - F.get(m, 0)).alias(f"{m}_scale"))])


def robust_scaled(df: DataFrame, fit: DataFrame, metrics: list[str]) -> DataFrame:
    """Metrics on the fitted scale; missing ones stay missing. ``fit`` is one row, so it is sent to all."""
    out = df.crossJoin(F.broadcast(fit))
    for m in metrics:
        out = out.withColumn(m, robust_scale(F.col(m), F.col(f"{m}_center"), F.col(f"{m}_scale")))
    return out.drop(*[f"{m}_{x}" for m in metrics for x in ("center", "scale")])


def min_max_scaled(df: DataFrame, metrics: list[str], group: str = "origin") -> DataFrame:
    """Metrics between 0 and 1 within each group; the ends are aggregated and sent to the rows, which are not moved."""
    ends = df.groupBy(group).agg(*[f(F.nanvl(F.col(m), F.lit(None))).alias(f"{m}_{n}") for m in metrics for f, n in ((F.min, "low"), (F.max, "high"))])
    out = join_small(df, ends.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    for m in metrics:
        out = out.withColumn(m, min_max_scale(F.col(m), F.col(f"{m}_low"), F.col(f"{m}_high")))
    return out.drop(*[f"{m}_{x}" for m in metrics for x in ("low", "high")])


def percentile_threshold(df: DataFrame, column: str, share: float, group: str | None = None, accuracy: int | None = None) -> DataFrame:
    """The percentile ``int(share * 100)`` of a column, interpolated."""
    p = quantiles(df, {"_q": F.col(column)}, [int(share * 100) / 100], group, accuracy)
    return p.select(*([group] if group else []), F.get("_q", 0).alias("threshold"))


def sampled_totals(df: DataFrame, group: str = "origin") -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum(F.col("inst_length") + F.col("resp_length")), F.lit(0)).alias("tokens"))
