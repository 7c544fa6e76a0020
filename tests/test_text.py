import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import code, rules, scores, text

TEXTS = ["", " ", "a", " a\tb \n", "one two", "A. B! C?", "x\n\ny\n\n \n\nz", "l1\r\nl2\nl3\n", "  x ", "no end", "Über ÄÖ", "it's", "a-b", "..."]


def run(spark, values, column, schema="t string"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, " + schema)
    return [r[0] for r in df.select("i", column.alias("o")).orderBy("i").select("o").collect()]


def test_strip_is_pythons(spark):
    assert run(spark, TEXTS, text.strip(F.col("t"))) == [t.strip() for t in TEXTS]


def test_lines_are_pythons(spark):
    assert run(spark, TEXTS, text.lines(F.col("t"))) == [t.splitlines() for t in TEXTS]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab ", max_size=12), st.text("ab", max_size=2)), min_size=1, max_size=20))
def test_occurrences_is_count(spark, pairs):
    assert run(spark, pairs, text.occurrences(F.col("t"), F.col("p")), "t string, p string") == [t.count(p) for t, p in pairs]


def test_joins(spark):
    cases = [("a", "b"), ("a", ""), ("a", None), (None, "b"), (None, None), (" a ", " ")]
    assert run(spark, cases, text.join_at_ingest(F.col("a"), F.col("b")), "a string, b string") == ["a\nb", "a", "a", "b", "", "a"]
    assert run(spark, cases, text.join_for_analysis(F.col("a"), F.col("b")), "a string, b string") == ["a\n\nb", "a", "a", "b", "", " a \n\n "]


def test_split_steps(spark):
    got = run(spark, ["a\n\nb: c", "a\nb", "One. Two! Three", "single"], text.split_steps(F.col("t")))
    assert got == [["a", "b:\nc"], ["a", "b"], ["One.", "Two!", "Three"], ["single"]]
    assert run(spark, ["a|b|c"], text.split_steps(F.col("t"), "|")) == [["a", "b", "c"]]


def test_clean_code(spark):
    assert run(spark, ["```python\nx = 1\\ny\n```", "```c++\n1\n```"], text.clean_code(F.col("t"))) == ["\nx = 1\ny\n", "\n1\n"]


def test_truncated(spark):
    w = F.split("t", " ")
    assert run(spark, ["a b c"], text.truncated(w, 2)) == [["a", "b"]]
    assert run(spark, ["a b c"], text.truncated(w, 2, "left")) == [["b", "c"]]
    assert run(spark, ["a b c"], text.truncated(w, 0)) == [[]]


def test_fill(spark):
    assert run(spark, ["q", None], text.fill('{{"a": {x}}}', x=F.col("t"))) == ['{"a": q}', '{"a": }']


@pytest.mark.parametrize(
    ("constraint", "words", "sentences", "paragraphs"),
    [
        ("at least 3 words", True, True, False), ("less than 2", True, False, True), ("not more than two sentences", None, False, True), ("2-4", True, True, False), ("no number", None, None, None),
        ("exactly three parts", None, True, False), ("up to 1 word", True, False, True), ("fewer than 9", True, True, True), ("around 3", True, True, False), ("don't use less than 2 words", True, True, False),
    ],
)
def test_length_rules(spark, constraint, words, sentences, paragraphs):
    response = "One here. Two here! Three here?"
    pair = [(constraint, response)]
    schema = "c string, r string"
    c, r = F.col("c"), F.col("r")
    assert run(spark, pair, rules.check_words(c, r), schema) == [words]
    assert run(spark, pair, rules.check_sentences(c, r), schema) == [sentences]
    assert run(spark, pair, rules.check_paragraphs(c, r), schema) == [paragraphs]


def test_keyword_and_case_rules(spark):
    s = "c string, r string"
    c, r = F.col("c"), F.col("r")
    assert run(spark, [("a; b", "xa b"), ("a; q", "xa b")], rules.check_included(c, r), s) == [True, False]
    assert run(spark, [("q; z", "xa"), ("a; z", "xa")], rules.check_avoided(c, r), s) == [True, False]
    assert run(spark, [("yes; no", "yes"), ("yes; no", "yes no")], rules.check_choice(c, r), s) == [True, False]
    assert run(spark, [("all capital letters", "ABC"), ("no capital letters", "abc"), ("lowercase twice", "abc"), ("lower case", "aBc"), ("nice", "x"), ("capital", "12")], rules.check_case(c, r), s) == [True, True, None, False, None, False]
    assert run(spark, [("start; He", "Hello"), ("ending; lo", "Hello"), ("wrap it in double quotes", '"x"'), ("else", "x")], rules.check_ends(c, r), s) == [True, True, True, None]
    assert run(spark, [("don't use commas", "a b"), ("don't use commas", "a, b"), ("use commas", "a")], rules.check_punctuation(c, r), s) == [True, False, None]
    assert run(spark, [("Say hi. Please!", "I Say hi"), ("Say hi.", "no")], rules.check_repeat(c, r), s) == [True, False]
    assert run(spark, [("Say hi.", "no")], rules.check_repeat(c, r, compat=True), s) == [True]


def test_frequency_rule(spark):
    s = "c string, r string"
    c, r = F.col("c"), F.col("r")
    cases = [("word cat 2 times", "cat Cat"), ("word cat at least 1 times", "cat cat"), ("letter a less than 3 times", "aa"), ("twice the letter", "x"), ("word cat often", "cat"), ("less than 2 times", "x"), ("word cat once", "cat")]
    assert run(spark, cases, rules.check_frequency(c, r), s) == [True, True, True, None, None, None, True]
    assert run(spark, [("letter a less than 3 times", "aa")], rules.check_frequency(c, r, compat=True), s) == [False]


def test_constraints_cleaned(spark):
    schema = "m map<string,string>"
    got = run(spark, [({"use cats": "keyword_included", "cats": "length", "no": "length", "x": "style"},), (None,)], rules.clean_constraints(F.col("m")), schema)
    assert [[tuple(x) for x in row] for row in got] == [[("keyword_included", "use cats")], []]
    made = F.array(*[F.struct(F.lit(a).alias("type"), F.lit(b).alias("expr")) for a, b in [("keyword_included", "say 'a' and \"b\""), ("keyword_avoided", "plain"), ("choose_output", "x"), ("choose_output", "y"), ("start_and_ending", 'Finish with "one two three"'), ("start_and_ending", 'Start with "one"'), ("length", "short")]])
    got = run(spark, ["-"], rules.postprocess_constraints(made))[0]
    assert [tuple(x) for x in got] == [("keyword_included", "b; a"), ("start_and_ending", "ending; one two three"), ("length", "short"), ("choose_output", "x; y")]


def test_instruction_score(spark):
    f = F.col("f")
    got = run(spark, [([True, True, False],), ([],), ([False],), ([True] * 10,)], rules.instruction_score(f), "f array<boolean>")
    assert [round(x, 6) for x in got] == [round(2 / 3 * 2, 6), 0.5, 0.0, 1.0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=8), st.lists(st.integers(0, 3), max_size=8))
def test_distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    assert code.distance(a, b) == prev[-1]


def test_first_object():
    assert code.first_object('x {"a": {"b": 1}} y {') == '{"a": {"b": 1}}'
    assert code.first_object("{ never") is None
    assert code.first_object("none") is None
    assert code.first_object(None) is None


def test_code_score(spark):
    import json

    def answer(old, new, verdict="correct"):
        return json.dumps({"review": "r", "final_verdict": verdict, "code_original": old, "code_revision": new})

    four = "a\nb\nc\nd"
    cases = [answer("no code", "x"), answer("no code", "x", "wrong"), answer(four, four), answer(four, "no revision"), answer("a\nb", "a\nc"), answer("a\nb", "a\nc", "wrong"), "not json", None]
    got = run(spark, cases, code.code_score(F.col("t")))
    assert [round(r["score"], 6) for r in got] == [0.5, 0.0, 1.0, 1.0, 0.5, 0.25, 1.0, 1.0]
    assert [r["edit_similarity"] for r in got] == [0.0, 0.0, 0.0, 4.0, 1.0, 1.0, 0.0, 0.0]
    assert got[3]["code_revision"] == four and got[6]["functional_correctness"] is True


def test_softmax_expectation(spark):
    import math

    m = {i: float(k) for k, i in enumerate(scores.MARK_IDS)}
    e = [math.exp(k) for k in range(6)]
    want = sum(k * x for k, x in enumerate(e, 1)) / sum(e)
    got = run(spark, [(m,), ({},), (None,), ({scores.MARK_IDS[5]: 0.0},)], scores.softmax_expectation(F.col("m")), "m map<int,double>")
    assert got[0] == pytest.approx(want) and got[1:3] == [3.0, 3.0] and got[3] == pytest.approx(6.0, abs=1e-6)


def test_scales(spark):
    c = F.col("t")
    assert run(spark, [1.0, None], scores.min_max_scale(c, F.lit(1.0), F.lit(1.0)), "t double") == [0.0, None]
    assert run(spark, [3.0], scores.robust_scale(c, F.lit(1.0), F.lit(0.0)), "t double") == [2.0]
    assert run(spark, ["1.5", "None", "NaN", "x", ""], scores.strict_number(c)) == [1.5, None, None, None, None]
    assert re.match("a", "a")
