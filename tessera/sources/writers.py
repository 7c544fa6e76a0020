"""Sinks: JSON lines, metric columns and sidecars, partitioned tables."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One record a line; null fields are left out."""
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, by: str | None = "origin", mode: str = "overwrite") -> None:
    """Parquet, in folders by source, so that a later read of some sources skips the others."""
    w = df.write.mode(mode)
    (w.partitionBy(by) if by and by in df.columns else w).parquet(path)


def write_metrics(df: DataFrame, path: str, metrics: list[str], mode: str = "overwrite") -> None:
    """One Parquet table a metric: ``data_id`` and the metric. The metrics are computed once for all of them."""
    df = df.select("data_id", *metrics).persist(StorageLevel.MEMORY_AND_DISK)
    for m in metrics:
        df.select("data_id", m).write.mode(mode).parquet(f"{path}/{m}")
    df.unpersist()


def write_metric_lines(df: DataFrame, path: str, metric: str, order: list[str], mode: str = "overwrite") -> None:
    """One value a line in the order given, ``None`` for null, for readers that go by position."""
    df.orderBy(*order).select(F.coalesce(F.col(metric).cast("string"), F.lit("None")).alias("value")).write.mode(mode).text(path)


def write_sidecar(df: DataFrame, path: str, columns: list[str], mode: str = "overwrite") -> None:
    """Nested columns (constraints and their outcomes, code reviews) as JSON lines by ``data_id``."""
    df.select("data_id", *columns).write.mode(mode).json(path)
