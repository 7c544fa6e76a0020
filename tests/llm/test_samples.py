"""Mixing, proportional samples, score fusion, defects and subjects."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import defects, mixing, proportions, ranking, subjects

SIZE = "coalesce(a, 0) + coalesce(b, 0)"


def specs(spark, *rows):
    return spark.createDataFrame(list(rows), "spec_name string, name string, token_size bigint, oversampling double")


def records(spark, n=3000):
    rows = [(f"r{i}", "hot" if i % 3 else f"s{i % 5}", i % 7, 3, "x") for i in range(n)] + [("nul", None, 1, 1, "x"), ("nos", "s_none", None, None, "x")]
    return spark.createDataFrame(rows, "data_id string, origin string, a bigint, b bigint, name string")


def test_mix_reaches_shares_and_caps(spark):
    rec = records(spark)
    src = mixing.source_tokens(rec, "origin", F.expr(SIZE))
    have = {r["source"]: r["tokens"] for r in src.collect()}
    cfg = specs(spark, ("p", " HOT ", 6000, 1.0), ("p", "s0", 3000, 1.0), ("p", "s-1", 10, 2.0), ("p", "s2", None, 1.0), ("p", "gone", 5, 3.0), ("p", "s3", 10**9, None), ("p", "s0", 3000, 1.0), ("q", "s3", 10**9, 2.5))
    rated = mixing.rates(cfg, src)
    by = {(r["spec_name"], r["name"]): r for r in rated.collect()}
    assert len(by) == rated.count() == 7
    assert by["p", "s3"]["rate"] == 1.0 and by["q", "s3"]["rate"] == 2.5 and by["p", "gone"]["rate"] == 0.0 and by["p", "s2"]["rate"] == 0.0
    assert by["p", " HOT "]["rate"] == pytest.approx(6000 / have["hot"])
    m = mixing.mix(rec, rated, "data_id", "origin", F.expr(SIZE))
    assert m.where("copies > 3").count() == 0
    used = {(r["spec_name"], r["name"]): r for r in mixing.shares(mixing.repeated(m), rated).collect()}
    assert used["p", " HOT "]["used_tokens"] == pytest.approx(6000, rel=0.1)
    assert used["q", "s3"]["used_tokens"] == pytest.approx(2.5 * have["s3"], rel=0.06)
    assert sum(r["actual_share"] for k, r in used.items() if k[0] == "p") == pytest.approx(1)
    again = mixing.mix(rec.repartition(7), rated, "data_id", "origin", F.expr(SIZE))
    assert again.exceptAll(m).count() == 0 and mixing.repeated(m).count() == m.agg(F.sum("copies")).first()[0]
    short = {tuple(r) for r in mixing.short_sources(cfg, src).collect()}
    assert short == {(s, n) for (s, n), r in by.items() if (r["token_size"] or 0) > r["tokens"] * r["cap"]} >= {("p", "gone"), ("p", "s3"), ("q", "s3")}


def test_mix_of_nothing(spark):
    rec, cfg = records(spark).limit(0), specs(spark, ("p", "a", 5, 1.0))
    src = mixing.source_tokens(rec, "origin", F.expr(SIZE))
    assert mixing.mix(rec, mixing.rates(cfg, src), "data_id", "origin", F.expr(SIZE)).count() == 0
    assert mixing.short_sources(cfg, src).count() == 1


def test_rake_meets_margins():
    c = np.array([[50.0, 10], [20, 5], [0, 30]])
    a, b = np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])
    w = proportions.rake(c, [a, b])
    f = w * c
    assert np.allclose(f.sum(1), a, atol=1e-6) and np.allclose(f.sum(0), b, atol=1e-6) and w[2, 0] == 0


def test_quotas():
    q = proportions.quotas
    assert q(10, {"a": 0.5, "b": 0.5}, {}, {"a": 100, "b": 100}) == {"a": 5, "b": 5}
    assert q(10, {"a": 0.5, "b": 0.5}, {}, {"a": 2, "b": 100}) == {"a": 2, "b": 8}
    assert q(10, {"a": 0.9, "b": 0.1}, {"b": 4}, {"a": 100, "b": 100}) == {"a": 6, "b": 4}
    assert q(10, {"a": 0.9, "b": 0.1}, {"b": 40}, {"a": 100, "b": 30}) == {"a": 0, "b": 30}
    assert q(3, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {}, {"a": 9, "b": 9, "c": 9}) == {"a": 1, "b": 1, "c": 1}
    assert q(100, {"a": 0.5, "b": 0.5}, {}, {"a": 2, "b": 3}) == {"a": 2, "b": 3}
    assert q(5, {"a": 0.0}, {"a": 2}, {"a": 9}) == {"a": 2}


def test_proportional_sample(spark):
    r = random.Random(1)
    rows = [(f"d{i}", r.choice(["Math", "math ", "Coding", "Factual_QA", None, "Else"]), r.choice([1, 1, 2]), "w") for i in range(4000)]
    pool = spark.createDataFrame(rows, "data_id string, setfit_label string, n_messages int, spec_name string")
    targets = spark.createDataFrame([("p", "MATH", 0.2, 0), ("p", "coding", 0.7, 5), ("p", "factual qa", 0.1, 90), ("p", "Nothing", 0.0, 3), ("e", "Math", 1.0, 0)], "spec_name string, setfit_label string, proportion double, min_rows bigint")
    sizes = spark.createDataFrame([("p", 500), ("p", 500)], "spec_name string, sample_size bigint")
    s, gaps = proportions.sample_proportional(pool.withColumn("turns", F.col("n_messages") > 1), targets, sizes, margins=("turns",))
    rows = s.collect()
    ids = [x["data_id"] for x in rows]
    assert len(ids) == len(set(ids)) == 500
    n = {x: sum(r["setfit_label"] == x for r in rows) for x in ("math", "coding", "factual qa")}
    assert n["factual qa"] == 90 and n["coding"] / n["math"] == pytest.approx(3.5, rel=0.03)
    got = {(g["spec_name"], g["setfit_label"]): g for g in gaps.collect()}
    assert got["p", "Nothing"]["gap"] == 3.0 and got["p", "factual qa"]["gap"] == 0.0 and ("e", "Math") in got
    again, _ = proportions.sample_proportional(pool.withColumn("turns", F.col("n_messages") > 1).repartition(9), targets, sizes, margins=("turns",))
    assert sorted(r["data_id"] for r in again.collect()) == sorted(ids)
    short = {tuple(x) for x in proportions.short_labels(gaps).collect()}
    assert short == {("p", "Nothing")}
    e, _ = proportions.sample_proportional(pool.limit(0), targets, sizes)
    assert e.count() == 0


def test_fused_scores_equal_brute_force(spark):
    r = random.Random(2)
    rows = []
    for i in range(900):
        o = "abc"[i % 3]
        q = r.gauss(0, 1) * (100 if o == "b" else 1)
        rows.append((f"d{i:03}", o, q if r.random() > 0.1 else None, r.choice([float("nan"), -20.0, r.gauss(3, 1), r.gauss(3, 1)]), 3.0 if o == "a" else r.random(), float("inf") if i == 7 else r.expovariate(1)))
    df = spark.createDataFrame(rows, "data_id string, origin string, quality double, complexity double, process_reward double, code_quality double")
    names = ["quality", "complexity", "process_reward", "code_quality"]
    cols = {n: {x[0]: x[2 + k] for x in rows} for k, n in enumerate(names)}
    ok = lambda v: v is not None and math.isfinite(v) and v != -20.0
    want = {}
    group = {x[0]: x[1] for x in rows}
    bounded = {}
    for n in names:
        for g in "abc":
            v = {i: x for i, x in cols[n].items() if group[i] == g and ok(x)}
            m = statistics.median_low(sorted(v.values()))
            mad = statistics.median_low(sorted(abs(x - m) for x in v.values()))
            for i, x in v.items():
                z = 0 if not mad else (x - m) / (1.4826 * mad) * (-1 if n == "code_quality" else 1)
                bounded[i, n] = min(max(1 / (1 + math.exp(-max(-30, min(30, z)))), 0.01), 0.99)
    for i in group:
        b = [bounded[i, n] for n in names if (i, n) in bounded]
        want[i] = math.exp(sum(map(math.log, b)) / len(b)) if b else None
    got = {x["data_id"]: x["overall_preference"] for x in ranking.fuse_scores(df).collect()}
    assert len(got) == 900
    for i, w in want.items():
        assert (got[i] is None) == (w is None) and (w is None or got[i] == pytest.approx(w, abs=2e-2)), i
    rk = ranking.ranked(ranking.fuse_scores(df)).collect()
    assert sorted(x["rank"] for x in rk) == list(range(1, 901))
    by = [x["overall_preference"] for x in sorted(rk, key=lambda x: x["rank"])]
    assert by == sorted(by, reverse=True)


def test_no_scale_dominates(spark):
    rows = [(i, "o", float(i), float(-i) * 1e6) for i in range(101)]
    got = ranking.fuse_scores(spark.createDataFrame(rows, "data_id int, origin string, quality double, complexity double")).collect()
    v = {x["data_id"]: x["overall_preference"] for x in got}
    assert v[0] == pytest.approx(v[100], rel=1e-3) and v[20] == pytest.approx(v[80], rel=1e-3)


def test_ranking_nothing_and_nulls(spark):
    schema = "data_id string, origin string, quality double"
    assert ranking.ranked(ranking.fuse_scores(spark.createDataFrame([], schema))).count() == 0
    got = ranking.ranked(ranking.fuse_scores(spark.createDataFrame([("a", None, None), ("b", None, 1.0)], schema))).collect()
    assert {r["data_id"]: r["rank"] for r in got} == {"b": 1, "a": 2}


@pytest.mark.parametrize(("answer", "empty"), [(None, True), ("", True), (" ​\n", True), ("-", True), ("### Response:\n", True), ("Answer:", True), ("N/A", True), ("<empty>", True), ("```\n```", True), ("7", False), ("No.", False), ("nothing", False), ("Response: yes", False)])
def test_empty(answer, empty):
    assert defects.is_empty(answer) is empty


def test_copies():
    p = "Compare the modest harp of Xyl with the old violin. Name three tunes."
    assert defects.is_copy(p, p) and defects.is_copy(p, p.upper()) and defects.is_copy(p, "> " + p) and defects.is_copy(p, "You asked: " + p)
    assert defects.is_copy(p, "Name three tunes.  Compare the modest harp of Xyl with the old violin.")
    assert not defects.is_copy(p, "You asked: " + p + " The harp sounds softer and has more strings than it.")
    assert not defects.is_copy(p, "The harp.") and not defects.is_copy(None, "x") and not defects.is_copy("", "")


def test_copies_have_no_length():
    p = "Name three tunes for the harp of Xyl, please."
    assert defects.is_copy(p, " ".join([p] * 5)) and defects.is_copy(p, (p + "\n\n") * 400)
    assert not defects.is_copy(p, p + " The first is slow. " * 40)


# None of these stands in the source; each is made of an opening, a way to decline, and something said along with it.
OPEN = ["", "Sorry, ", "Well, my friend, ", "To be frank, "]
DECLINE = ["I can't get into that", "I won't draw up anything of the kind", "I do not hand out such things", "my makers keep me from that", "this must stay untouched by me", "ich kann dazu nichts beisteuern", "das lasse ich lieber bleiben, ich bin nicht befugt"]
ALONG = ["", " Perhaps another matter?", " Try somebody trained for it.", " Vielleicht etwas anderes?"]


def test_refusals_are_learned(spark):
    r = random.Random(8)
    noun = ["harp", "bell", "river", "violin", "bread", "tractor", "comet", "loan", "judge", "goal"]
    say = lambda: f"The {r.choice(noun)} of the {r.choice(noun)} {r.choice(['was', 'is', 'stays'])} {r.choice(['old', 'late', 'red', 'dear'])} and the {r.choice(noun)} {r.choice(['was not', 'is', 'came'])} {r.choice(['near', 'sold', 'made'])}."
    rows = [(f"n{i}", 0, say(), " ".join(say() for _ in range(r.randrange(1, 6))), None, "en") for i in range(1500)]
    rows += [(f"q{i}", 0, say(), f'"Sorry, I can\'t come," said the {r.choice(noun)}. ' + say() + " " + say(), None, "en") for i in range(60)]
    rows += [(f"r{i}", 0, f"Tell me of the {r.choice(noun)}.", r.choice(OPEN) + r.choice(DECLINE) + "." + r.choice(ALONG), None, "en") for i in range(150)]
    longest = ("long", 0, say(), ("I can't get into that. " + "Perhaps another matter? ") * 60, None, "en")
    df = spark.createDataFrame([*rows, longest], "data_id string, turn_idx int, prompt string, answer string, context string, language string")
    m = defects.fit(df)
    found = {x[0] for x in [*rows, longest] if m.refusals.judge(x[2], x[3])[0]}
    assert sum(x.startswith("r") for x in found) >= 0.9 * 150 and not {x for x in found if x[0] in "nq"} and "long" in found
    assert m.refusals.judge("What is this?", "Sorry, I can't hand out that.")[0]
    assert not m.refusals.judge("Why?", "You cannot divide by zero. I understand the confusion.")[0]
    assert not m.refusals.judge(None, "The harp cannot be tuned. It has nine strings.")[0] and not m.refusals.judge(None, "No.")[0]


def test_stand_ins_are_seen_under_all_languages(spark):
    answers = {"en": "Both.", "de": "Beides.", "fr": "Les deux."}
    rows = [(f"a{i}", 0, "Which?", answers[k] if i % 3 else "zilch", None, k) for i in range(240) for k in [("en", "de", "fr")[i % 5 % 3]]]
    m = defects.fit(spark.createDataFrame(rows, "data_id string, turn_idx int, prompt string, answer string, context string, language string"))
    assert defects.is_empty("(zilch)", m.nothing) and not any(defects.is_empty(x, m.nothing) for x in answers.values())


LANG = {
    "en": "The old harp of the village was tuned by a woman who lived near the river and sold bread.",
    "de": "Die alte Harfe des Dorfes wurde von einer Frau gestimmt, die nahe am Fluss wohnte und Brot verkaufte.",
    "fr": "La vieille harpe du village était accordée par une femme qui vivait près de la rivière et vendait du pain.",
    "es": "La vieja arpa del pueblo era afinada por una mujer que vivía cerca del río y vendía el pan.",
}


def test_defects_end_to_end(spark):
    r = random.Random(3)
    rows = []
    for i in range(240):
        lang = "en de fr es".split()[i % 4]
        w = LANG[lang].rstrip(".").split()
        make = lambda: " ".join(r.sample(w, 12)).capitalize() + "."  # noqa: B023, E731
        rows.append((f"g{i}", 0, make(), make() + " " + make(), None, lang if i % 17 else "EN"))
    good = len(rows)
    en, de = LANG["en"], LANG["de"]
    rows += [
        ("language", 0, en, de + " " + de, None, "en"), ("asked", 0, "Translate this into German. " + en, de, None, "en"), ("followup", 1, "Go on.", de + " " + de, de + de, "de"),
        ("empty", 0, en, None, None, None), ("copy", 0, en, en, None, "en"), ("askedcopy", 0, "Repeat these words without any change. " + en, en, None, "en"),
        ("refusal", 0, en, "I can't help with that.", None, "en"), ("refusal2", 0, en, "Sorry, I can't help with this.", None, "en"), ("refusal3", 0, de, "I can't do that.", None, "en"), ("truncated", 0, "Wer hat die alte Harfe im Dorf gestimmt und wo hat die Frau gewohnt?", de[:60], None, "de"), ("code", 0, en, "A woman tuned it.\n```python\nx = 1", None, "en"), ("json", 0, en, '{"a": [1, 2', None, "en"), ("goodjson", 0, en, '{"a": [1, 2]}', None, "en"),
        ("longone", 0, en, (en + " ") * 3000, None, "en"),
    ]
    df = spark.createDataFrame(rows, "data_id string, turn_idx int, prompt string, answer string, context string, language string")
    got = {x["data_id"]: x["defect"] for x in defects.find_defects(df).collect()}
    assert {k: v for k, v in got.items() if not k.startswith("g")} | {k: v for k, v in got.items() if k == "goodjson"} == {"language": "language", "empty": "empty", "copy": "copy", "refusal": "refusal", "refusal2": "refusal", "refusal3": "refusal", "truncated": "truncated", "code": "truncated", "json": "truncated", "longone": "copy"}
    assert sum(k.startswith("g") for k in got) <= 0.02 * good
    assert defects.find_defects(df.limit(0)).count() == 0
    few = defects.find_defects(df.where("data_id in ('empty', 'copy')").repartition(8)).collect()  # most partitions are empty
    assert {x["data_id"]: x["defect"] for x in few} == {"empty": "empty", "copy": "copy"}


def test_pairs_of(spark):
    i = spark.createDataFrame([("a", "do", "out", "en", 1), ("a", "do", "new", "en", 2), ("b", " \n", "x", "en", 1), (None, "do", "x", "en", 1)], "data_id string, instruction string, output string, language string, ingested_at int")
    c = spark.createDataFrame([("c", [("system", "s"), ("human", "q"), ("gpt", "r"), ("user", "again"), ("user", None), ("assistant", "z")], "en", 1), ("d", [], "en", 1), ("e", None, "en", 1), ("f", [("user", "x")], "en", 1)], "data_id string, messages array<struct<role:string,content:string>>, language string, ingested_at int")
    got = {(r["data_id"], r["turn_idx"]): (r["prompt"], r["answer"]) for r in defects.pairs_of(i, c).collect()}
    assert got == {("a", 0): ("do", "new"), ("c", 1): ("q", "r"), ("c", 4): (None, "z")}


SYLLABLES = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]


def invented(r, n):
    return ["".join(r.choice(SYLLABLES) for _ in range(3)) for _ in range(n)]


def subject_docs(seed, n=600):
    """Documents in two made-up languages about three subjects, whose words are drawn here and stand nowhere else."""
    r = random.Random(seed)
    plain = {k: invented(r, 30) for k in "xy"}
    nouns = {(k, s): invented(r, 80) for k in "xy" for s in ("alpha", "beta", "gamma", "everyday")}
    out = []
    for i in range(n):
        k = "x" if i % 3 else "y"
        own, other = r.sample(("alpha", "beta", "gamma"), 2)
        lines = []
        for j in range(12):
            s = own if j < 8 else other if j < 10 else "everyday"  # the other one is passing: under a quarter
            lines.append(" ".join([*r.sample(plain[k], 4), *r.sample(nouns[k, s], 2), "".join(r.choice(SYLLABLES) for _ in range(5))]).capitalize() + ".")
        out.append((i, " ".join(lines), own))
    return out


def test_vocabulary_and_topics_count_every_document(spark):
    # each rare term is in just as many documents as a term must be in, so none may be left out of the count
    rare = [f"rare{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    need = max(subjects.LEAST_DOCS, int(subjects.LEAST_SHARE * 9_000))
    rows = [(i, f"plain words stand here {rare[i // 150] if i % 150 < need else 'only'} {chr(97 + i % 26) * 3} and end.") for i in range(9_000)]
    corpus = subjects.Corpus(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert set(rare) <= set(corpus.vocabulary) and all(corpus.frequency[w] == need for w in rare) and "plain" not in corpus.vocabulary
    topics = corpus.fit(8)
    assert topics.mass.sum() == pytest.approx(sum(corpus.frequency.values()), rel=1e-3)


def test_pairs_of_different_sentences():
    doc = np.array([0, 0, 0, 0, 1, 1])
    pairs = np.bincount(subjects._outer(np.array([0, 1, 0, 2, 2, 2]), doc, 3), minlength=9) - np.bincount(subjects._outer(np.array([0, 1, 0, 2, 2, 2]), np.array([0, 0, 1, 1, 2, 3]), 3), minlength=9)
    assert pairs.reshape(3, 3).tolist() == [[2, 1, 1], [1, 0, 1], [1, 1, 2]]


def test_subjects(spark):
    docs = subject_docs(4)
    edge = [(9000, None, ""), (9001, "", ""), (9002, "Hm.", ""), (9003, "```\nviolin melody orchestra\n```", ""), (9004, docs[0][1], docs[0][2])]
    df = spark.createDataFrame(docs + edge, "doc_id bigint, text string, subject string")
    r = random.Random(5)
    # a third is labelled, some of it wrongly, in capitals, twice or with a subject that isn't asked for
    said = [(i, r.choice(("alpha", "beta", "gamma", "none", "odd")) if i % 15 == 0 else s.upper() if i % 6 == 0 else s) for i, _, s in docs if i % 3 == 0 or r.random() < 0.2]
    labels = spark.createDataFrame([*said, *said[:5], (None, "alpha")], "doc_id bigint, subject string")
    named = dict.fromkeys(("alpha", "beta", "gamma"), None)
    got = {}
    for x in subjects.assign_subjects(df, named, labels, topics=24).collect():
        got.setdefault(x["doc_id"], set()).add(x["subject"])
    right = sum(got.get(i) == {s} for i, _, s in docs)
    assert right >= 0.9 * len(docs)
    assert not {9000, 9001, 9002, 9003} & set(got) and got[9004] == got[0]
    assert subjects.assign_subjects(df, named, topics=24).count() == 0  # nothing says what a topic is about
    assert subjects.assign_subjects(df.limit(0), named, labels).count() == 0
    assert subjects.assign_subjects(df.limit(3).repartition(8), named, labels.limit(0)).count() == 0
    c = {x["subject"]: x["documents"] for x in subjects.composition(spark.createDataFrame([(0, "law"), (0, "music")], "doc_id bigint, subject string"), df).collect()}
    assert c == {"law": 1, "music": 1, "none": len(docs) + 4}
