"""Scores of code answers from a reviewer model's revision, and JSON in model output."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_code, lines, strip

REVIEW = "review string, final_verdict string, code_original string, code_revision string"


def distance(a: list, b: list) -> int:
    """Edit distance of two sequences, one bit a position (Hyyro 2003)."""
    if not a or not b:
        return len(a) + len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for y in b:
        same = where.get(y, 0)
        zero = (((same & up) + up) ^ up) | same | down
        plus, minus = (down | ~(zero | up)) & full, zero & up
        score += bool(plus & last) - bool(minus & last)
        plus = (plus << 1 | 1) & full
        up, down = ((minus << 1) | ~(zero | plus)) & full, plus & zero & full
    return score


def line_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of lines."""

    def f(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else distance(p, q) for p, q in zip(x.to_pylist(), y.to_pylist())], pa.int32())

    return F.arrow_udf(f, "int")(a, b)


def line_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise((longest - line_distance(a, b)) / longest)


def first_object(text: str | None) -> str | None:
    """From the first brace to the one that closes it, by counting only; None if it is never closed."""
    if text is None:
        return None
    start = text.find("{")
    depth = 0
    for i in range(start, len(text)) if start >= 0 else ():
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def first_json(c: Column) -> Column:
    def f(x: pa.Array) -> pa.Array:
        return pa.array([first_object(t) for t in x.to_pylist()], pa.string())

    return F.arrow_udf(f, "string")(c)


def code_score(answer: Column, too_long: Column | None = None) -> Column:
    """Struct ``score, code_review, code_original, code_revision, functional_correctness, edit_similarity``.

    ``answer`` is the reviewer's JSON. No code: half a point if right, else none. Otherwise the similarity of
    the lines before and after revision (``edit_similarity`` holds the distance itself), halved if wrong, 1 if
    right, longer than three lines and left as it was. An answer that can't be read scores 1, a prompt that was
    too long 0.
    """
    a = F.from_json(answer, REVIEW)
    old, new = clean_code(a["code_original"]), clean_code(a["code_revision"])
    old_lines, new_lines = lines(strip(old)), lines(strip(new))
    right = a["final_verdict"] == "correct"
    readable = F.coalesce(a["review"].isNotNull() & a["final_verdict"].isNotNull() & (F.size(old_lines) > 0) & new.isNotNull(), F.lit(False))
    no_code = F.get(old_lines, 0) == "no code"
    left = right & (F.size(old_lines) > 3) & (F.get(new_lines, 0) == "no revision")
    # a right revision without a first line can't be read
    readable = readable & (no_code | ~(right & (F.size(old_lines) > 3)) | (F.size(new_lines) > 0))
    far = line_distance(old_lines, new_lines).cast("double")
    longest = F.greatest(F.size(old_lines), F.size(new_lines))
    near = (longest - far) / longest
    score = F.when(~readable, 1.0).when(no_code, F.when(right, 0.5).otherwise(0.0)).when(left, 1.0).when(right, near).otherwise(near * 0.5)
    if too_long is not None:
        score = F.when(too_long, 0.0).otherwise(score)
    pick = lambda x, other: F.when(readable, x).otherwise(F.lit(other))
    return F.struct(
        score.alias("score"), pick(a["review"], "no review").alias("code_review"), pick(old, "no code").alias("code_original"),
        F.when(~readable, F.lit("no revision")).when(left & ~no_code, old).otherwise(new).alias("code_revision"),
        F.when(readable, right).otherwise(F.lit(True)).alias("functional_correctness"), F.when(readable & ~no_code, far).otherwise(0.0).alias("edit_similarity"),
    )
