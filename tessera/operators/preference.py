"""Scoring strategies: how a sample's scores become one preference."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.aggregates import min_max_scaled, robust_fit, robust_scaled

ROBUST_METRICS = ("quality", "complexity", "if_quality", "process_reward", "code_quality")
#: Digits of a preference after the point: equal scores tie however their terms were added up.
DIGITS = 12
SCALED_METRICS = ("quality", "complexity", "difficulty_v2")


@dataclass(frozen=True)
class Weights:
    quality: float = 0.0
    complexity: float = 0.0
    difficulty: float = 0.0
    tokens: float = 0.0


#: Strategies by the beginning of their name, or by their whole name, in the order in which they are tried.
STRATEGIES = (
    ("default", True, Weights(quality=1, difficulty=1)),
    ("random", False, Weights()),
    ("longest", False, Weights(tokens=1)),
    ("deita", False, Weights(quality=1, complexity=1)),
    ("difficulty", True, Weights(difficulty=1)),
    ("difficulty_v2", True, Weights(difficulty=1)),
    ("quality", False, Weights(quality=1)),
    ("dedicated_quality", False, Weights(quality=1)),
    ("combination", False, Weights(quality=1, difficulty=1)),
    ("complexity", True, Weights(complexity=1)),
)


def weights_of(strategy: str | None) -> Weights:
    for name, whole, w in STRATEGIES:
        if (strategy or "default") == name or (not whole and (strategy or "default").startswith(name)):
            return w
    raise ValueError(f"unknown scoring strategy {strategy!r}")


def is_dedicated(strategy: str | None) -> bool:
    return bool(strategy) and ("dedicated_quality" in strategy or "combination" in strategy)


def dedicated_quality(label: Column) -> Column:
    """The quality score that fits a sample's label."""
    return F.when(label.isin("Generation", "Brainstorming"), F.col("if_quality")).when(label == "Math", F.col("process_reward")).when(label == "Coding", F.col("code_quality")).otherwise(F.col("quality"))


def preference(strategy: str | None, scored: bool = True) -> Column:
    """``overall_preference`` from scaled scores; 1 where samples aren't scored or the strategy is ``random``.

    A missing score makes the preference missing; such samples come last in every order.
    """
    w = weights_of(strategy)
    if not scored or strategy == "random":
        return F.lit(1.0)
    c = lambda name: F.col(name).cast("double")
    if w.quality and w.complexity:
        return c("quality") * c("complexity")
    if w.quality and w.difficulty:
        return c("quality") * c("difficulty_v2")
    parts = [x * c(name) for x, name in ((w.quality, "quality"), (w.complexity, "complexity"), (w.difficulty, "difficulty_v2")) if x]
    if w.tokens:
        parts.append(c("last_resp_length"))
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def with_preference(df: DataFrame, strategy: str | None, scored: bool = True, fit: DataFrame | None = None, group: str = "origin", label: str = "setfit_label") -> DataFrame:
    """``df`` with scores scaled robustly over the pool, dedicated to labels, scaled within sources, and joined.

    ``fit`` defaults to :func:`robust_fit` of ``df``. Scores that ``df`` lacks are null.
    """
    for m in (*ROBUST_METRICS, "difficulty_v2"):
        df = df.withColumn(m, F.nanvl(F.col(m).cast("double"), F.lit(None)) if m in df.columns else F.lit(None).cast("double"))
    df = robust_scaled(df, fit if fit is not None else robust_fit(df, list(ROBUST_METRICS), label), list(ROBUST_METRICS))
    if is_dedicated(strategy):
        df = df.withColumn("quality", dedicated_quality(F.col(label)))
    df = min_max_scaled(df, list(SCALED_METRICS), group)
    return df.withColumn("overall_preference", F.round(preference(strategy, scored), DIGITS))
