"""Queries that take the whole of their tables, against plain Python."""

import re

from tessera.operators import reshape
from tessera.plans import queries as core


def steps(t):
    if "\n\n" in t:
        return re.sub(r":\s+", ":\n", t).split("\n\n")
    if "\n" in t:
        return t.splitlines()
    parts, start = [], 0
    for m in re.finditer(r"(?<=[.!?])[\"')\]]*[ \t]+", t):
        after = t[m.end() :].lstrip("\"'([")[:1]
        if after.isupper() or after.isnumeric():
            parts.append(t[start : m.start()])
            start = m.end()
    return [x for x in [*parts, t[start:]] if x.strip()]


def test_steps_of_every_response(spark, sf_dir):
    said = {(r["data_id"], r["exchange_idx"]): r["response"] for r in reshape.exchanges(core.conversations(spark, sf_dir)).collect()}
    got = {(r["data_id"], r["exchange_idx"]): (r["n_steps"], r["first_step"]) for r in core.queries()["all_response_steps"](spark, sf_dir).collect()}
    assert got.keys() == said.keys()
    one_line = {k: t for k, t in said.items() if t and "\n" not in t}
    assert len(one_line) > 50 and any(got[k][0] > 1 for k in one_line)
    for k, t in said.items():
        if t:
            want = steps(t)
            assert got[k] == (len(want), want[0] if want else None), t


def test_constraints_of_whole_instructions(spark, tmp_path):
    texts = ['Write {a: {"b": [1]}} with } braces { and \\ and\ttabs\nand lines, all beyond the twentieth character', "short", "é ß 漢字 \U0001f600 " * 30, "{{{", '"}', "x" * 5_000]
    rows = [(f"i{k}", t, None, "out", "o", "en", None) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "data_id string, instruction string, input string, output string, origin string, language string, ingested_at timestamp").write.parquet(f"{tmp_path}/instructions.parquet")
    got = {r["data_id"]: r for r in core.queries()["whole_constraints"](spark, str(tmp_path)).collect()}
    # braces are counted, also in strings: an answer in which they don't match can't be read (M9)
    unread = {"{{{", '"}'}
    assert {k: r["first_key"] for k, r in got.items()} == {f"i{k}": None if t in unread else f"use {t}" for k, t in enumerate(texts)}
    for k, t in enumerate(texts):
        assert got[f"i{k}"]["n"] == 0 if t in unread else f"length=not {t}" in got[f"i{k}"]["constraints"], t


def test_curriculum_keeps_samples_without_difficulty(spark, sf_dir):
    rows = [(r["data_id"], r["difficulty_v2"]) for r in core.analysis(spark, sf_dir).collect()]
    unknown = {i for i, v in rows if v is None or v != v}
    assert unknown
    want = [i for i, v in sorted(rows, key=lambda r: (r[0] in unknown, 0 if r[0] in unknown else r[1], r[0]))]
    got = core.queries()["whole_curriculum"](spark, sf_dir).collect()
    assert [r["data_id"] for r in sorted(got, key=lambda r: r["place"])] == want
    assert sorted(r["place"] for r in got) == list(range(len(want)))
