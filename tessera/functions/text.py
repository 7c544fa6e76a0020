"""Column functions on text whose results equal those of Python's string methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's ``str.splitlines`` splits on.
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes blanks only)."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def contains(c: Column, part: str | Column) -> Column:
    return F.contains(c, part if isinstance(part, Column) else F.lit(part))


def occurrences(text: Column, part: Column) -> Column:
    """Occurrences of ``part`` that don't overlap; of the empty text one more than there are characters."""
    n = F.length(part)
    return F.when(n == 0, F.length(text) + 1).otherwise(((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / n).cast("int"))


def lines(c: Column) -> Column:
    """Lines of a text; no line after a last line end, none of the empty text."""
    parts = F.split(c, LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def literal_split(c: Column, sep: str) -> Column:
    """Split at a fixed text (``split`` takes a pattern)."""
    import re

    return F.split(c, re.escape(sep).replace("\\\n", "\\n"))


def non_blank(parts: Column) -> Column:
    return F.filter(parts, lambda p: strip(p) != "")


def word_count(c: Column) -> Column:
    """Words parted by white space: the default stand-in for a model's tokenizer."""
    t = strip(c)
    return F.when(t.isNull() | (t == ""), F.lit(0)).otherwise(F.size(F.split(t, r"(?U)\s+")))


def join_at_ingest(instruction: Column, input_: Column) -> Column:
    """Instruction and input on a line each, stripped; a null input counts as empty."""
    return strip(F.concat(F.coalesce(instruction, F.lit("")), F.lit("\n"), F.coalesce(input_, F.lit(""))))


def join_for_analysis(instruction: Column, input_: Column) -> Column:
    """Both, parted by an empty line; the one that isn't empty; or the empty text."""
    i, j = F.coalesce(instruction, F.lit("")), F.coalesce(input_, F.lit(""))
    return F.when((i != "") & (j != ""), F.concat(i, F.lit("\n\n"), j)).otherwise(F.concat(i, j))


# Marks of fenced code, removed in this order.
FENCES = ("```cpp", "```python", "```java", "```c++", "```json", "```xml", "```")


def clean_code(c: Column) -> Column:
    """Code without fences, written line breaks made real ones."""
    out = F.replace(c, F.lit("\\n"), F.lit("\n"))
    for mark in FENCES:
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


SENTENCE_END = r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]*[\p{Lu}\p{N}])"


def split_steps(c: Column, sep: str = "\n\n") -> Column:
    """Steps of a response.

    With the usual separator: paragraphs if there is an empty line (a colon before white space then ends its
    line first), else lines, else sentences. Any other separator is split at as it is.
    """
    if sep != "\n\n":
        return literal_split(c, sep)
    paragraphs = F.split(F.regexp_replace(c, r":(?U)\s+", ":\n"), r"\n\n")
    return F.when(contains(c, "\n\n"), paragraphs).when(contains(c, "\n"), lines(c)).otherwise(non_blank(F.split(c, SENTENCE_END)))


def truncated(tokens: Column, budget: int, side: str = "right") -> Column:
    """The first (or, with ``side="left"``, the last) ``budget`` tokens."""
    if budget <= 0:
        return F.slice(tokens, F.lit(1), F.lit(0))
    if side == "left":
        return F.slice(tokens, F.greatest(F.size(tokens) - budget + 1, F.lit(1)), F.lit(budget))
    return F.slice(tokens, F.lit(1), F.lit(budget))


def fill(template: str, **values: Column) -> Column:
    """A template with ``{name}`` places, filled; doubled braces are single ones. Null values fill as empty."""
    import re

    parts = []
    for piece in re.split(r"(\{\{|\}\}|\{\w+\})", template):
        if piece in ("{{", "}}"):
            parts.append(F.lit(piece[0]))
        elif m := re.fullmatch(r"\{(\w+)\}", piece):
            parts.append(F.coalesce(values[m[1]], F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")
