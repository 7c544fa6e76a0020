"""One ranking from scores on different scales.

Each score is standardised by its median and median absolute deviation within its group (a scale need not be
the same in every origin), squashed by the logistic function so that a runaway value is worth no more than a
very good one, and the bounded values are combined by a weighted geometric mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.joins import join_small
from tessera.operators.reshape import numbered

from .common import durable

#: Weights of the scores; a score of which less is better has a negative weight.
WEIGHTS = {"quality": 1.0, "complexity": 1.0, "difficulty_v2": 1.0, "if_quality": 1.0, "process_reward": 1.0, "code_quality": -1.0}
#: What earlier runs wrote where no score could be had.
SENTINELS = (-20.0, -1.0e9, -999.0, -9999.0)
#: Rows of a value's error bound in the medians: one in ACCURACY.
ACCURACY = 10_000
#: Bounded values lie in [FLOOR, 1 - FLOOR], so no single score makes the product 0.
FLOOR = 0.01
NORMAL = 1.4826
#: Digits of the result after the point: rows with the same scores tie however their logarithms were added up.
DIGITS = 9


def cleaned(score: str, sentinels: tuple[float, ...] = SENTINELS) -> Column:
    """The score, null where it is NaN, infinite or a sentinel."""
    c = F.col(f"`{score}`").cast("double")
    bad = F.isnan(c) | c.isin(float("inf"), float("-inf"), *sentinels)
    return F.when(~bad, c)


def fuse_scores(df: DataFrame, id_col: str = "data_id", group: str = "origin", weights: dict[str, float] | None = None, sentinels: tuple[float, ...] = SENTINELS, accuracy: int = ACCURACY) -> DataFrame:
    """``id, overall_preference`` in (0, 1) for each row of ``df``.

    Null, NaN, infinite and sentinel scores are missing: the mean is over the scores a row has, and a row
    without any gets null. A score that is the same throughout its group, or whose deviation is 0, says
    nothing and counts as 1/2. Null groups are one group. The medians come from bounded sketches (error: one
    row in ``accuracy``), so a group with most of the rows stays within one task's memory.
    """
    weights = weights or WEIGHTS
    names = [s for s, w in weights.items() if w and s in df.columns]
    rows = df.select(F.col(id_col), F.coalesce(F.col(group), F.lit("")).alias("_g"), *[cleaned(s, sentinels).alias(s) for s in names])
    mid = rows.groupBy("_g").agg(*[F.percentile_approx(s, 0.5, accuracy).alias(f"m_{s}") for s in names])
    rows = join_small(rows, mid, ["_g"])  # a row a group: the rows stay where they are
    off = rows.groupBy("_g").agg(
        *[F.percentile_approx(F.abs(F.col(s) - F.col(f"m_{s}")), 0.5, accuracy).alias(f"d_{s}") for s in names],
        *[F.avg(F.abs(F.col(s) - F.col(f"m_{s}"))).alias(f"a_{s}") for s in names],
    )
    rows = join_small(rows, off, ["_g"])
    total, logs = F.lit(0.0), F.lit(0.0)
    for s in names:
        w = weights[s]
        # where more than half of the values are one, the mean deviation stands in for the median one
        scale = F.when(F.col(f"d_{s}") > 0, NORMAL * F.col(f"d_{s}")).otherwise(F.when(F.col(f"a_{s}") > 0, 1.2533 * F.least(F.col(f"a_{s}"), F.lit(1e6))))
        z = (F.col(s) - F.col(f"m_{s}")) / scale * (1 if w > 0 else -1)
        bounded = F.when(scale.isNull(), F.lit(0.5)).otherwise(1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0)))))
        bounded = F.greatest(F.least(bounded, F.lit(1 - FLOOR)), F.lit(FLOOR))
        has = F.col(s).isNotNull()
        total = total + F.when(has, F.lit(abs(w))).otherwise(0.0)
        logs = logs + F.when(has, abs(w) * F.log(bounded)).otherwise(0.0)
    return rows.select(id_col, F.when(total > 0, F.round(F.exp(logs / total), DIGITS)).alias("overall_preference"))


def ranked(df: DataFrame, by: str = "overall_preference", id_col: str = "data_id", out: str = "rank") -> DataFrame:
    """``df`` with its rank from 1, best first, nulls last, ties by id: no two rows share a rank.

    Rows are sorted over all partitions by range and numbered within them; each partition's offset comes from
    the partition sizes, so nothing is gathered in one task. The sorted rows are written to the checkpoint
    folder, that they are numbered once.
    """
    rows = durable(df.orderBy(F.col(by).desc_nulls_last(), F.col(id_col)))
    return numbered(rows, out).withColumn(out, F.col(out) + 1)
