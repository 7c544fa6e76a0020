"""Rule checks of constraints that a prompt sets for its response.

A constraint is a struct ``type, expr``. Each check gives true, false, or null where rules can't tell and a
model has to be asked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains, literal_split, non_blank, occurrences, strip

# Phrases that set a relation, in the order in which they are looked for.
RELATIONS = (
    ("+", ">"), ("or more", ">="), ("at least", ">="), ("more than", ">"), ("longer than", ">"),
    ("less than", "<"), ("fewer than", "<"), ("at most", "<="), ("or less", "<="), ("around", "="),
    ("-word", "="), ("up to", "<="), (" to", "--"), ("-", "--"),
)
NUMBERS = ("one ", "two ", "three ", "four ", "five ", "six ", "seven ", "eight ", "nine ", "ten ")
NEGATIONS = ("n't ", "not ", "no ", "without")
# Types of constraints that are considered.
TYPES = (
    "letter_case", "placeholder_and_postscript", "repeat_prompt", "output_combination", "choose_output", "output_format",
    "keyword_included", "keyword_avoided", "keyword_frequency", "language", "length", "punctuation", "start_and_ending",
)
WORD_TOLERANCE = 5


def let(f, **values: Column) -> Column:  # noqa: ANN001
    """``f`` of a struct of values, each of which is computed once however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), 1)


def any_of(c: Column, parts: tuple[str, ...]) -> Column:
    out = contains(c, parts[0])
    for p in parts[1:]:
        out = out | contains(c, p)
    return out


def negated(c: Column) -> Column:
    return any_of(c, NEGATIONS)


def relation(c: Column) -> Column:
    """The relation of the first phrase found, ``=`` if there is none."""
    out = None
    for phrase, r in RELATIONS:
        hit = contains(c, phrase)
        out = F.when(hit, r) if out is None else out.when(hit, r)
    return out.otherwise("=")


def effective_relation(c: Column) -> Column:
    """The relation, turned round by a negation where it is ``<`` or ``>``."""
    return let(lambda v: F.when(v["r"].isin("<", ">") & negated(c), F.when(v["r"] == "<", ">=").otherwise("<=")).otherwise(v["r"]), r=relation(c))


def digits(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("bigint"))


def counts(c: Column) -> Column:
    """Numbers written as words, each once and in ascending order; without any, those in digits."""
    named = F.filter(F.array(*[F.when(contains(c, w), F.lit(i).cast("bigint")) for i, w in enumerate(NUMBERS, 1)]), lambda x: x.isNotNull())
    return let(lambda v: F.when(F.size(v["n"]) > 0, v["n"]).otherwise(digits(c)), n=named)


def compare(n: Column, r: Column, numbers: Column) -> Column:
    """Whether ``n`` stands in the relation to the numbers; null without any. A range needs two of them."""

    def held(v: Column) -> Column:
        n, r, a, b = v["n"], v["r"], F.get(v["x"], 0), F.get(v["x"], 1)
        out = F.when(r == "<", n < a).when(r == ">", n > a).when(r == "<=", n <= a).when(r == ">=", n >= a).when((r == "--") & b.isNotNull(), (n >= a) & (n <= b)).otherwise(n == a)
        return F.when(a.isNotNull(), out)

    return let(held, n=n, r=r, x=numbers)


def check_words(c: Column, response: Column) -> Column:
    """Length in words (counted by blanks) with a tolerance."""

    def held(v: Column) -> Column:
        n, r, a, b, t = v["n"], v["r"], F.get(v["x"], 0), F.get(v["x"], 1), WORD_TOLERANCE
        below, above = n < a + t, n > a - t
        out = F.when(r.isin("<", "<="), below).when(r.isin(">", ">="), above).when((r == "--") & b.isNotNull(), above & (n < b + t)).otherwise(above & below)
        return F.when(a.isNotNull(), out)

    return let(held, n=occurrences(response, F.lit(" ")), r=effective_relation(c), x=digits(c))


def sentence_count(response: Column) -> Column:
    return F.size(non_blank(F.split(response, r"[.?!]")))


def paragraph_count(response: Column) -> Column:
    return F.size(non_blank(F.split(response, r"\n\n")))


def check_sentences(c: Column, response: Column) -> Column:
    return compare(sentence_count(response), effective_relation(c), counts(c))


def check_paragraphs(c: Column, response: Column) -> Column:
    return compare(paragraph_count(response), effective_relation(c), counts(c))


def check_length(c: Column, response: Column) -> Column:
    """By paragraphs, sentences or words, whichever is named first in this order; only true is final."""
    got = F.when(contains(c, "paragraph"), check_paragraphs(c, response)).when(contains(c, "sentence"), check_sentences(c, response)).when(contains(c, "word"), check_words(c, response))
    return F.when(got, F.lit(True))


def check_punctuation(c: Column, response: Column) -> Column:
    return F.when(negated(c) & contains(c, "comma"), ~contains(response, ","))


def keywords(c: Column) -> Column:
    return literal_split(c, "; ")


def check_included(c: Column, response: Column) -> Column:
    return F.forall(keywords(c), lambda k: contains(response, k))


def check_avoided(c: Column, response: Column) -> Column:
    return ~F.exists(keywords(c), lambda k: contains(response, k))


def check_choice(c: Column, response: Column) -> Column:
    return F.size(F.filter(keywords(c), lambda k: contains(response, k))) == 1


def title(word: Column) -> Column:
    return F.initcap(F.lower(word))


def check_frequency(c: Column, response: Column, compat: bool = False) -> Column:
    """How often a word, name or letter occurs.

    ``compat``: ``<`` and ``>`` act as ``=``. Without a word, name or letter after its mark rules can't tell.
    """
    words = F.transform(F.split(c, " "), lambda x: F.translate(strip(x), "\"'.,", ""))

    def places(v: Column) -> Column:
        w = v["w"]
        at = lambda x: F.array_position(w, x)
        before = F.when(at("times") > 1, F.get(w, (at("times") - 2).cast("int"))).when(at("times") == 1, F.element_at(w, -1))
        n = F.when(F.array_contains(w, "once"), 1).when(F.array_contains(w, "twice"), 2).otherwise(F.coalesce(before.try_cast("int"), F.lit(0)))
        after = lambda x: F.get(w, at(x).cast("int"))
        word = F.when(at("word") > 0, after("word")).when(at("name") > 0, after("name"))
        letter = F.when((at("word") == 0) & (at("name") == 0) & (at("letter") > 0), after("letter"))
        return F.struct(n.alias("n"), word.alias("word"), letter.alias("letter"))

    def counted(v: Column) -> Column:
        p = v["p"]
        return F.when(p["word"].isNotNull(), occurrences(response, p["word"]) + occurrences(response, title(p["word"]))).when(p["letter"].isNotNull(), occurrences(response, p["letter"]))

    def held(v: Column) -> Column:
        n, seen, r = v["p"]["n"], v["seen"], v["r"]
        if compat:
            r = F.when(r.isin("<=", ">="), r).otherwise("=")
        out = F.when(r == "<", seen < n).when(r == ">", seen > n).when(r == "<=", seen <= n).when(r == ">=", seen >= n).otherwise(seen == n)
        return F.when((n > 0) & seen.isNotNull(), out)

    return let(lambda v: let(held, p=v["p"], seen=counted(v), r=relation(c)), p=let(places, w=words))


def is_lower(c: Column) -> Column:
    return c.rlike(r"\p{Ll}") & ~c.rlike(r"[\p{Lu}\p{Lt}]")


def is_upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"[\p{Ll}\p{Lt}]")


def check_case(c: Column, response: Column) -> Column:
    capital = contains(c, "capital")
    lower = (negated(c) & capital) | any_of(c, ("lowercase", "lower case"))
    return F.when(any_of(c, ("times", "twice")), F.lit(None).cast("boolean")).when(lower, is_lower(response)).when(capital, is_upper(response))


def check_ends(c: Column, response: Column) -> Column:
    """Wrapped in double quotes, or beginning or ending with a phrase."""
    phrase = F.get(keywords(c), 1)
    wrapped = any_of(c, ("wrap", "Wrap")) & contains(c, "double quot")
    return F.when(wrapped, F.startswith(response, F.lit('"')) & F.endswith(response, F.lit('"'))).when(F.startswith(c, F.lit("start;")), F.startswith(response, phrase)).when(F.startswith(c, F.lit("ending;")), F.endswith(response, phrase))


def check_repeat(prompt: Column, response: Column, compat: bool = False) -> Column:
    """Whether a sentence of the prompt stands in the response; ``compat``: the empty part after the last mark counts."""
    parts = F.split(prompt, r"[.?!]")
    return F.exists(parts if compat else non_blank(parts), lambda p: contains(response, p))


def evaluate(kind: Column, expr: Column, prompt: Column, response: Column, compat: bool = False) -> Column:
    """The check of one constraint."""
    return (
        F.when(kind == "punctuation", check_punctuation(expr, response))
        .when(kind == "keyword_included", check_included(expr, response))
        .when(kind == "keyword_avoided", check_avoided(expr, response))
        .when(kind == "keyword_frequency", check_frequency(expr, response, compat))
        .when(kind == "choose_output", check_choice(expr, response))
        .when(kind == "length", check_length(expr, response))
        .when(kind == "repeat_prompt", check_repeat(prompt, response, compat))
        .when(kind == "letter_case", check_case(expr, response))
        .when(kind == "start_and_ending", check_ends(expr, response))
    )


# ---- constraints from a model's answer ---------------------------------------------------------------------


def clean_constraints(answer: Column) -> Column:
    """``map<expr, type>`` to an array of ``type, expr`` in the map's order: known types only, no empty, yes or
    no expressions, none that is a proper part of another one kept so far."""
    entries = F.transform(F.map_entries(answer), lambda e: F.struct(e["value"].alias("type"), e["key"].alias("expr")))
    kept = F.filter(entries, lambda e: ~e["expr"].isin("", "no", "yes") & e["type"].isin(*TYPES))
    return F.coalesce(F.filter(kept, lambda e: ~F.exists(kept, lambda o: contains(o["expr"], e["expr"]) & (o["expr"] != e["expr"]))), F.array().cast("array<struct<type:string,expr:string>>"))


def quoted(c: Column, mark: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"{mark}([^{mark}]*){mark}"), F.lit(1))


def postprocess_constraints(constraints: Column) -> Column:
    """Keywords taken from quotes, choices merged into one constraint at the end, phrases of beginnings and ends."""
    struct = lambda kind, expr: F.struct(kind.alias("type"), expr.alias("expr"))

    def one(e: Column) -> Column:
        kind, expr = e["type"], e["expr"]
        plain = F.replace(F.replace(expr, F.lit("n't "), F.lit("nt ")), F.lit("'s "), F.lit("s "))
        keys = F.filter(F.concat(quoted(plain, '"'), quoted(plain, "'")), lambda k: k != "")
        first = F.get(quoted(expr, '"'), 0)
        long = occurrences(first, F.lit(" ")) > 1
        ends = any_of(expr, (" end ", "End", " finish ", "Finish")) & contains(expr, '"')
        starts = any_of(expr, (" start ", "Start")) & contains(expr, '"')
        none = F.lit(None).cast("struct<type:string,expr:string>")
        return (
            F.when(kind.isin("keyword_included", "keyword_avoided"), F.when(F.size(keys) > 0, struct(kind, F.array_join(keys, "; "))).otherwise(none))
            .when(kind == "choose_output", none)
            .when((kind == "start_and_ending") & ends, F.when(long, struct(kind, F.concat(F.lit("ending; "), first))).otherwise(none))
            .when((kind == "start_and_ending") & starts, F.when(long, struct(kind, F.concat(F.lit("start; "), first))).otherwise(none))
            .otherwise(struct(kind, expr))
        )

    rest = F.filter(F.transform(constraints, one), lambda e: e.isNotNull())
    options = F.transform(F.filter(constraints, lambda e: e["type"] == "choose_output"), lambda e: e["expr"])
    return F.when(F.size(options) > 0, F.concat(rest, F.array(struct(F.lit("choose_output"), F.array_join(options, "; "))))).otherwise(rest)


def questions(unchecked: Column) -> Column:
    """Numbered questions for a model about constraints that rules could not check."""

    def one(e: Column, i: Column) -> Column:
        head = F.concat((i + 1).cast("string"), F.lit(". "), e["type"], F.lit(": Does the following text (after 'ASSISTANT:') "))
        choice = F.concat(head, F.lit("contain one of the following phrase: "), e["expr"], F.lit("?"))
        other = F.concat(head, F.lit("follow the "), F.replace(e["type"], F.lit("_"), F.lit(" ")), F.lit(" constraint of '"), e["expr"], F.lit("'?"))
        return F.when(e["type"] == "choose_output", choice).otherwise(other)

    return F.transform(unchecked, one)


def instruction_score(followed: Column, fallback: Column | None = None) -> Column:
    """Score from the outcomes of all checked constraints: the share followed, times their number below ten.

    Without a checked constraint the score is ``fallback`` (a model's 0 to 10) over ten, or a half.
    """
    n = F.size(followed)
    yes = F.size(F.filter(followed, lambda x: x))
    base = yes / n
    fall = F.coalesce(fallback / 10, F.lit(0.5)) if fallback is not None else F.lit(0.5)
    return F.when(n == 0, fall).when((yes > 0) & (yes < 10), base * yes).otherwise(base)
