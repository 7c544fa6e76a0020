"""Orders, top-k, quotas, repetition and splits. Every order is total: it ends in the id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import CATEGORIES, first_in_groups
from tessera.operators.reshape import drop_empty_system, id_without_language


def shuffled(seed: int, key: str = "data_id") -> list[Column]:
    """A pseudo-random order that depends on the seed and the ids only, and that other engines can repeat."""
    return [F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), F.col(key)]


def by_preference(seed: int | None = 42, key: str = "data_id", column: str = "overall_preference") -> list[Column]:
    """Best first, missing last; equal ones in seeded order, or by id without a seed."""
    tie = shuffled(seed, key) if seed is not None else [F.col(key)]
    return [F.col(column).desc_nulls_last(), *tie]


def sample_random(df: DataFrame, n: int, seed: int | None = None, key: str = "data_id") -> DataFrame:
    """Exactly ``n`` rows; the seed defaults to the thousands of ``n``."""
    return df.orderBy(*shuffled(n // 1000 if seed is None else seed, key)).limit(n)


def top_k(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def stratified_top_k(df: DataFrame, proportions: dict[str, float], n: int, order: list[Column], label: str = "setfit_label") -> DataFrame:
    """Of each label the first ``ceil(proportion * n)`` rows, labels in the given order, cut off at ``n``."""
    if not proportions:
        return df.limit(0)
    quotas = {x: math.ceil(p * n) for x, p in proportions.items()}
    at = F.create_map(*[F.lit(v) for i, x in enumerate(quotas) for v in (x, i)])
    return first_in_groups(df, label, quotas, order).orderBy(F.element_at(at, F.col(label)), "_r").limit(n).drop("_r")


def oversampled(df: DataFrame, times: float, order: list[Column]) -> DataFrame:
    """Every row ``int(times)`` times, and the first rows of the order once more for the fraction of the table.

    ``copy`` numbers the copies from 1; the extra one is the last.
    """
    whole = int(times)
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(whole)))) if whole else df.withColumn("copy", F.lit(1)).limit(0)
    if times == whole:
        return out
    extra = int(df.count() * (times - whole))
    return out.unionByName(df.orderBy(*order).limit(extra).withColumn("copy", F.lit(whole + 1)))


def plain_key() -> Column:
    """What samples that differ in the language of their id only have in common; all null ids have one."""
    return F.coalesce(id_without_language(F.col("data_id")), F.lit(""))


def cross_lingual_first(df: DataFrame, order: list[Column], taken: DataFrame | None = None) -> DataFrame:
    """Of samples that differ in the language of their id only, the first; none of those whose key was ``taken``
    (column ``_k``) by earlier sources. All null ids count as one."""
    rows = df.withColumn("_k", plain_key())
    if taken is not None:
        rows = rows.join(taken.select("_k"), "_k", "left_anti")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*order))).where("_r = 1").drop("_r", "_k")


def random_member(df: DataFrame, group: str, seed: int, key: str = "data_id") -> DataFrame:
    """One row of each group: that with the least seeded hash. An aggregate, so no group is sorted."""
    cols = [c for c in df.columns if c != group]
    got = df.groupBy(group).agg(F.min_by(F.struct(*cols), F.struct(*shuffled(seed, key))).alias("_r"))
    return got.select(group, *[F.col(f"_r.{c}").alias(c) for c in cols]).select(*df.columns)


def ordering(kind: str | None, seed: int = 1234, label: str = "setfit_label") -> list[Column]:
    """Order of the result: ``shuffle``; names with ``difficulty`` or ``length`` (easy or short first); names
    with ``category`` (labels in their fixed order before that)."""
    kind = kind or "shuffle"
    out: list[Column] = []
    if "category" in kind:
        out.append(F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col(label)))
    if "difficulty" in kind:
        out.append(F.col("difficulty_v2").asc_nulls_last())
    elif "length" in kind:
        out.append(F.col("inst_length") + F.col("resp_length"))
    if kind == "shuffle":
        return shuffled(seed)
    return [*out, F.col("data_id")]


def finished(df: DataFrame, kind: str | None = "shuffle", seed: int = 1234, label: str = "setfit_label") -> DataFrame:
    """Empty system turns dropped, rows in their final order; an order by category drops other labels."""
    if kind and "category" in kind:
        df = df.where(F.col(label).isin(*CATEGORIES))
    return df.withColumn("messages", drop_empty_system(F.col("messages"))).orderBy(*ordering(kind, seed, label))


def train_test_split(df: DataFrame, test_share: float = 0.03, seed: int = 42, key: str = "data_id") -> DataFrame:
    """``split``: ``test`` where a seeded hash of the id falls under the share; the same for any partitioning."""
    u = F.conv(F.substring(shuffled(seed, key)[0], 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    return df.withColumn("split", F.when(u < test_share, "test").otherwise("train"))
