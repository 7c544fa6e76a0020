"""Joins of samples with their metrics and labels, always by key."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def attach_metrics(samples: DataFrame, metrics: DataFrame, *names: str) -> DataFrame:
    """Metric columns by ``data_id``; samples without metrics keep nulls."""
    return samples.join(metrics.select("data_id", *names), "data_id", "left")


def attach_metric_tables(samples: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One narrow table a metric (``data_id`` and the metric): the tables are brought together by one aggregate
    and joined once. NaN is a missing value, as null is."""
    parts = [t.select("data_id", *[(F.nanvl(F.col(m).cast("double"), F.lit(None)) if m == name else F.lit(None).cast("double")).alias(m) for m in tables]) for name, t in tables.items()]
    if not parts:
        return samples
    wide = reduce(DataFrame.unionByName, parts).groupBy("data_id").agg(*[F.max(m).alias(m) for m in tables])
    return samples.join(wide, "data_id", "left")


#: Rows of a table of groups that is sent to all executors at most.
SENT_ROWS = 50_000


def join_small(rows: DataFrame, small: DataFrame, on: Column | list[str], how: str = "inner", most: int = SENT_ROWS) -> DataFrame:
    """``rows`` with a table that is expected to be small (one row a group): sent to all executors if it has at
    most ``most`` rows, which is counted first, so a key with a third of the rows meets no single task; a plain
    join beyond that."""
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    return rows.join(F.broadcast(small) if small.limit(most + 1).count() <= most else small, on, how)


def scatter_scores(rows: DataFrame, scores: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Scores of routed rows back on all rows; null for the others."""
    return rows.join(scores.select(*keys, score), keys, "left")


def attach_labels(exchanges: DataFrame, per_message: DataFrame | None, per_sample: DataFrame | None) -> DataFrame:
    """``message_label`` and ``sample_label``; null unless both tables are given."""
    if per_message is None or per_sample is None:
        return exchanges.withColumn("message_label", F.lit(None).cast("string")).withColumn("sample_label", F.lit(None).cast("string"))
    out = exchanges.join(per_message.select("data_id", "exchange_idx", F.col("label").alias("message_label")), ["data_id", "exchange_idx"], "left")
    return out.join(per_sample.select("data_id", F.col("setfit_label").alias("sample_label")), "data_id", "left")


def not_in(df: DataFrame, taken: DataFrame, key: str = "data_id") -> DataFrame:
    return df.join(taken.select(key), key, "left_anti")


def union_all(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; columns that a part lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
