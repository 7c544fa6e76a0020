"""Near duplicates, look-alikes and leaks against brute force."""

import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import common, diverse, leakage, neardup
from tessera.llm.common import words

VOCAB = [f"w{i}" for i in range(400)]


def texts(seed, families=12, size=6, alone=40, n=40, edits=3):
    r = random.Random(seed)
    out = []
    for _ in range(families):
        base = [r.choice(VOCAB) for _ in range(n + r.randint(0, 20))]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, edits)):
                k = r.randrange(len(t))
                t[k : k + r.randint(0, 1)] = [r.choice(VOCAB)]
            if r.random() < 0.2:
                r.shuffle(t)
            out.append(" ".join(t))
    out += [" ".join(r.choice(VOCAB) for _ in range(r.randint(1, 80))) for _ in range(alone)]
    return out


def similarity(a, b):
    o = sum((a & b).values())
    return Fraction(o, sum(a.values()) + sum(b.values()) - o) if a or b else Fraction(0)


def all_pairs(rows, t, least):
    c = [(i, Counter(words(x))) for i, x in rows]
    c = [(i, x) for i, x in c if sum(x.values()) >= least]
    return {(min(i, j), max(i, j)) for k, (i, a) in enumerate(c) for j, b in c[:k] if similarity(a, b) >= t}


@pytest.mark.parametrize(("seed", "t", "block"), [(1, Fraction(4, 5), 2000), (2, Fraction(4, 5), 3), (3, Fraction(3, 5), 5), (4, Fraction(9, 10), 2)])
def test_pairs_are_all_pairs(spark, seed, t, block):
    rows = [(f"d{i:03}", x) for i, x in enumerate(texts(seed))]
    df = spark.createDataFrame([*rows, ("n", None), ("e", ""), ("s", "too short")], "id string, text string").repartition(5)
    nd = neardup.NearDuplicates(df, "id", t=t, min_words=20, block=block)
    got = [tuple(r) for r in nd.pairs().select("id_a", "id_b").collect()]
    assert set(got) == all_pairs(rows, t, 20) and len(got) == len(set(got))


def test_groups_are_components(spark):
    rows = [(f"d{i:03}", x) for i, x in enumerate(texts(7, edits=2))]
    pairs = all_pairs(rows, Fraction(4, 5), 20)
    root = {i: i for i, _ in rows}
    for _ in range(len(rows)):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {i: root[i] for p in pairs for i in p}
    nd = neardup.NearDuplicates(spark.createDataFrame(rows, "id string, text string"), "id")
    assert {r["id"]: r["group"] for r in nd.groups().collect()} == want


def test_large_classes_are_written_as_membership(spark):
    same = " ".join(VOCAB[:30])
    other = " ".join([*VOCAB[:29], "else"])
    rows = [(i, same) for i in range(100)] + [(1000, other), (1001, other)]
    nd = neardup.NearDuplicates(spark.createDataFrame(rows, "id bigint, text string"), "id")
    got = {tuple(r) for r in nd.pairs(expanded=10).collect()}
    assert got == {(0, i) for i in range(1, 100)} | {(1000, 1001), (0, 1000), (0, 1001)}
    assert len({r["group"] for r in nd.groups().collect()}) == 1 and nd.groups().count() == 102
    assert neardup.NearDuplicates(spark.createDataFrame(rows, "id bigint, text string"), "id").pairs(1000).count() == 102 * 101 // 2


def test_large_classes_of_different_texts_are_written_whole(spark):
    # one multiset of words in 20 orders, one of them copied 30 times, and a near duplicate of them all
    r = random.Random(9)
    orders = [" ".join(r.sample(VOCAB[:30], 30)) for _ in range(20)]
    rows = [(100 + i, x) for i, x in enumerate(orders)] + [(200 + i, orders[0]) for i in range(29)] + [(1, " ".join([*VOCAB[:29], "else"]))]
    nd = neardup.NearDuplicates(spark.createDataFrame(rows, "id bigint, text string"), "id")
    got = [tuple(x) for x in nd.pairs(expanded=10).collect()]
    copied = {x["id"]: x["copy_of"] for x in nd.copies(expanded=10).collect()}
    assert copied == {i: 100 for i, x in rows if x == orders[0]}
    # only pairs with a copy that is not the first one may be left out, but for its membership
    want = {p for p in all_pairs(rows, Fraction(4, 5), 20) if all(copied.get(i, i) == i for i in p)} | {(c, i) for i, c in copied.items() if i != c}
    assert set(got) == want and len(got) == len(want)


def test_near_duplicates_of_nothing(spark):
    nd = neardup.NearDuplicates(spark.createDataFrame([], "id string, text string"), "id")
    assert nd.pairs().count() == 0 and nd.groups().count() == 0


def test_components_of_a_chain(spark):
    n = 200
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "u bigint, v bigint")
    got = neardup.components(e).collect()
    assert len(got) == n + 1 and {r["root"] for r in got} == {0}
    with pytest.raises(RuntimeError):
        neardup.components(e, rounds=1)


def family(r, n, size):
    base = [r.choice(VOCAB) for _ in range(n)]
    return [" ".join(w if r.random() > 0.15 else f"x{r.randrange(10**6)}" for w in base) for _ in range(size)]


@pytest.mark.parametrize("block", [3000, 7])
def test_look_alikes(spark, block):
    r = random.Random(5)
    rows = [x for k in (30, 14, 11, 9, 4) for x in family(r, 55, k)] + [" ".join(r.choice(VOCAB) for _ in range(50)) for _ in range(120)]
    rows = list(enumerate(rows))
    pairs = all_pairs(rows, Fraction(1, 2), 40)
    deg = Counter(i for p in pairs for i in p)
    want = {i for i, n in deg.items() if n >= 10}
    assert len(want) >= 40
    df = spark.createDataFrame([*rows, (900, None), (901, "")], "id bigint, text string")
    got = [x["id"] for x in diverse.look_alikes(df, "id", block=block).collect()]
    assert set(got) == want and len(got) == len(want)
    assert diverse.look_alikes(spark.createDataFrame([], "id bigint, text string"), "id").count() == 0


@pytest.mark.parametrize("seed", [15, 16])
def test_look_alikes_in_many_cells(spark, seed):
    # a chain whose records are each alike to some before and after, over many more cells than one is looked for in
    r = random.Random(seed)
    link, rows = [r.choice(VOCAB) for _ in range(56)], []
    for _ in range(200):
        for _ in range(3):
            link[r.randrange(56)] = r.choice(VOCAB)
        rows.append(" ".join(link))
    rows = list(enumerate(rows))
    deg = Counter(i for p in all_pairs(rows, Fraction(1, 2), 40) for i in p)
    want = {i for i, n in deg.items() if n >= 10}
    assert 50 < len(want)
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = [x["id"] for x in diverse.look_alikes(df, "id", cell=2).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("held", [7, 10**6])
def test_exact_step_of_look_alikes(spark, held):
    # nothing is settled, records of all sizes, copies; buckets cut in blocks of a few records and not at all
    r = random.Random(17)
    rows = [x for n, k in ((42, 13), (60, 12), (90, 14), (300, 13), (700, 12), (50, 8)) for x in family(r, n, k)]
    rows += [" ".join(r.choice(VOCAB) for _ in range(r.choice((41, 60, 83, 400)))) for _ in range(60)] + [rows[0]] * 3
    rows = list(enumerate(rows))
    deg = Counter(i for p in all_pairs(rows, Fraction(1, 2), 40) for i in p)
    want = {i for i, n in deg.items() if n >= 10}
    assert len(want) > 40
    judged = common.with_tokens(spark.createDataFrame(rows, "id bigint, text string")).where("n >= 40").selectExpr("id", "xxhash64(id) AS rid", "toks", "id % 5 <> 0 AS asks")
    got = [x["id"] for x in diverse._exact(judged, common.bucket_counts(judged), len(rows), Fraction(1, 2), 40, 10, held).collect()]
    assert set(got) == {i for i in want if i % 5} and len(got) == len(set(got))


def test_settled_in_a_group_of_any_sizes():
    r = random.Random(18)
    rows = [x for n, k in ((45, 30), (120, 12), (400, 15), (44, 9)) for x in family(r, n, k)] + [" ".join(r.choice(VOCAB) for _ in range(50)) for _ in range(80)]
    lists = common.token_struct(pa.array(rows)).field("toks")
    deg = Counter(i for p in all_pairs(list(enumerate(rows)), Fraction(1, 2), 40) for i in p)
    got = diverse._settled(*diverse._tokens(lists), Fraction(1, 2), 10)
    assert set(np.flatnonzero(got)) == {i for i, n in deg.items() if n >= 10}


def test_settled_records_are_compared_with_those_that_ask_only(monkeypatch):
    # one word in all of 3,000 records: all pairs would be 4.5 millions
    n, asks = 3_000, np.arange(3_000) % 100 == 0
    g = np.random.default_rng(19)
    m = g.integers(0, 2**63, (n, diverse.LONGS), dtype=np.int64)
    zero = np.zeros(n, np.int32)
    f = pa.table({"lo": zero, "hi": zero, "own": zero, "n": pa.array(np.full(n, 60, np.int32)), "rid": pa.array(np.arange(n)), "asks": pa.array(asks), "m": pa.array([x.tobytes() for x in m], pa.binary()), "keys": pa.array([[5, 60]] * n, pa.list_(pa.int32()))})
    compared, meet = [], diverse._Near.meet
    monkeypatch.setattr(diverse._Near, "meet", lambda self, x, y: compared.append(len(x) * len(y)) or meet(self, x, y))
    diverse._candidates(f, Fraction(1, 2))
    assert 0 < sum(compared) <= 2 * n * asks.sum()


def test_select_varied(spark):
    r = random.Random(6)
    rows = [x for x in family(r, 55, 150)] + [" ".join(r.choice(VOCAB) for _ in range(50)) for _ in range(60)]
    df = spark.createDataFrame([(i, x, float(i)) for i, x in enumerate(rows)] + [(998, None, 0.0), (999, "", None)], "data_id bigint, text string, s double")
    from pyspark.sql import functions as F

    got = diverse.select_varied(df, {"a": 40, "all": 5000, "none": 0}, {"a": F.col("s")}).collect()
    a = [x["data_id"] for x in got if x["spec"] == "a"]
    assert len(a) == len(set(a)) == 40
    assert sum(i < 150 for i in a) < 20  # far fewer than their share of the pool
    assert sorted(x["data_id"] for x in got if x["spec"] == "all") == sorted([*range(210), 998, 999])
    assert not [x for x in got if x["spec"] == "none"]


def test_ward_cuts_apart_what_is_apart():
    g = np.random.default_rng(0)
    m = np.concatenate([g.normal(c, 0.1, (10, diverse.DIM)) for c in (0, 1, 5)])
    label = diverse.cut(diverse.ward(np.ones(30), m), 30, 3)
    assert [len(set(label[s : s + 10])) for s in (0, 10, 20)] == [1, 1, 1] and len(set(label)) == 3
    costs = [c for _, _, c in diverse.ward(np.ones(30), m)]
    assert costs == sorted(costs) and len(costs) == 29


def test_every_cut_has_as_many_groups_as_asked():
    g = np.random.default_rng(2)
    m = g.integers(0, 2, (300, diverse.DIM)).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[50:90] = m[3]
    merges = diverse.ward(g.integers(1, 5, 300).astype(float), m)
    assert all(diverse.cut(merges, 300, k).max() + 1 == k for k in range(1, 301))


def test_cluster_features_add_up():
    g = np.random.default_rng(1)
    m = g.normal(size=(500, diverse.DIM)).astype(np.float32)
    t = diverse.CFTree(leaves=60)
    for x in m:
        t.add(1.0, x, float(x @ x))
    n, ls, ss = t.entries()
    assert len(n) <= 61 and n.sum() == 500
    assert np.allclose(ls.sum(0), m.sum(0), atol=1e-2) and ss.sum() == pytest.approx(float((m * m).sum()), rel=1e-4)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=8), st.lists(st.sampled_from("abc"), max_size=14))
def test_myers(p, t):
    prev = list(range(len(p) + 1))
    best = prev[-1]
    for w in t:
        cur = [0]
        for i, x in enumerate(p, 1):
            cur.append(min(prev[i - 1] + (x != w), prev[i] + 1, cur[i - 1] + 1))
        prev, best = cur, min(best, cur[-1])
    assert leakage.myers_distance(p, t) == best


@pytest.mark.parametrize(("w", "e"), [(12, 0), (12, 1), (12, 2), (20, 3), (5, 0)])
def test_every_passage_holds_enough_pieces(w, e):
    p = leakage.piece_length(w, e)
    for s in range(3 * p):
        whole = sum(s <= k and k + p <= s + w for k in range(0, s + w + p, p))
        assert whole >= e + 1


def test_leaks(spark):
    r = random.Random(8)
    items = [(k, " ".join(r.choice(VOCAB) for _ in range(r.choice([8, 12, 30, 60])))) for k in range(30)] + [(100, None), (101, ""), (102, "w1 w2")]
    docs = []
    for d in range(120):
        body = [r.choice(VOCAB) for _ in range(80)]
        w = words(items[r.randrange(30)][1])
        k, n = r.randrange(max(1, len(w) - 5)), r.choice([6, 11, 12, 13, 40])
        docs.append((d, " ".join(body[:40] + w[k : k + n] + body[40:]).upper().replace(" ", ", ", 9)))
    docs += [(500, None), (501, ""), (502, items[3][1]), (503, items[3][1])]
    runs = {}
    for k, q in items:
        w = words(q)
        for s in range(len(w) - 11):
            runs.setdefault(tuple(w[s : s + 12]), set()).add(k)
    want = set()
    for d, t in docs:
        w = words(t)
        for s in range(len(w) - 11):
            want |= {(d, k) for k in runs.get(tuple(w[s : s + 12]), ())}
    dd, it = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, question string")
    got = [tuple(x) for x in leakage.leaked(dd, it).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    assert {tuple(x) for x in leakage.leaked(dd, it, items_at_once=7).collect()} == want
    assert leakage.leaked(dd, it.limit(0)).count() == 0 and leakage.leaked(dd.limit(0), it).count() == 0


def test_edited_passages_are_found(spark):
    q = [f"q{i}" for i in range(40)]
    t = [*q[:9], "edit", *q[10:25], *q[26:]]
    dd = spark.createDataFrame([(1, " ".join(t))], "doc_id bigint, text string")
    it = spark.createDataFrame([(7, " ".join(q))], "item_id bigint, question string")
    got = leakage.find_leaks(dd, it).collect()
    assert [(r["item_id"], r["words"], r["distance"]) for r in got] == [(7, 40, 2)]
    assert got[0]["matched"] == 15
