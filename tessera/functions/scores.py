"""Numeric functions of scorers and of the normalisation that joins them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ids by which the judge model writes the marks 1 to 6, the log probability of a mark that is
#: not among the returned ones, and the mark where the answer can't be read.
MARK_IDS = (29896, 29906, 29941, 29946, 29945, 29953)
MISSING_LOGIT, UNREADABLE_MARK = -20.0, 3.0


def softmax_expectation(logprobs: Column, ids: tuple[int, ...] = MARK_IDS) -> Column:
    """Expected mark (1 to the number of ``ids``) under the softmax of a map id to log probability."""
    logits = F.array(*[F.coalesce(F.try_element_at(logprobs, F.lit(i)), F.lit(MISSING_LOGIT)) for i in ids])
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    marks = F.array(*[F.lit(float(k)) for k in range(1, len(ids) + 1)])
    weighted = F.aggregate(F.zip_with(e, marks, lambda p, m: p * m), F.lit(0.0), lambda a, x: a + x)
    return F.when(logprobs.isNull() | (F.size(logprobs) == 0), F.lit(UNREADABLE_MARK)).otherwise(weighted / total)


def robust_scale(x: Column, center: Column, scale: Column) -> Column:
    """A scale of zero counts as one."""
    return (x - center) / F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def min_max_scale(x: Column, low: Column, high: Column) -> Column:
    """Between 0 and 1; 0 where all values are equal."""
    return F.when(x.isNull(), F.lit(None)).when(high == low, F.lit(0.0)).otherwise((x - low) / (high - low))


def strict_number(c: Column) -> Column:
    """Text to a number; ``None``, ``NaN`` and text that is no number to null."""
    return F.nullif(c.try_cast("double"), F.lit(float("nan")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for a vector of length zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / n)


def l2_normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x / n))


def step_probabilities(logits: Column, mask: Column) -> Column:
    """Of each marked token the probability of the second of two classes; exact zeros are left out.

    ``logits``: array of pairs, ``mask``: array of booleans of the same length.
    """
    steps = F.zip_with(logits, mask, lambda l, m: F.when(m, 1 / (1 + F.exp(l[0] - l[1]))))
    return F.filter(steps, lambda p: p.isNotNull() & (p != 0))


def step_reward(rewards: Column, how: str = "min") -> Column:
    """Least or mean reward of a response's steps; null without any."""
    if how == "min":
        return F.array_min(rewards)
    if how == "mean":
        return F.when(F.size(rewards) > 0, F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x) / F.size(rewards))
    raise ValueError(f"unknown reduction {how!r}: min or mean")
