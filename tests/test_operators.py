import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import aggregates, filters, joins, preference, reshape, sampling, scorers, vectors

MSG = "data_id string, messages array<struct<role:string,content:string>>"


def conv(spark, *chats, extra=""):
    return spark.createDataFrame([(f"c{i}", [(r, t) for r, t in c]) for i, c in enumerate(chats)], MSG)


def exchanges_of(chat):
    roles = [r for r, _ in chat]
    if len(chat) < 2 or "user" not in roles:
        return []
    out, t = [], roles.index("user")
    while t < len(chat):
        if roles[t] == "user":
            answered = t + 1 < len(chat) and roles[t + 1] == "assistant"
            out.append((chat[t][1] or "", (chat[t + 1][1] or "") if answered else ""))
        t += 2
    return out


turn = st.tuples(st.sampled_from(["user", "assistant", "system"]), st.one_of(st.none(), st.text("ab", max_size=2)))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(turn, max_size=7), min_size=1, max_size=12))
def test_exchanges(spark, chats):
    got = reshape.exchanges(conv(spark, *chats)).orderBy("exchange_idx").collect()
    for i, c in enumerate(chats):
        assert [(r["instruction"], r["response"]) for r in got if r["data_id"] == f"c{i}"] == exchanges_of(c)


def test_two_users_in_a_row_make_one_exchange(spark):
    got = reshape.exchanges(conv(spark, [("user", "a"), ("user", "b"), ("assistant", "c")])).collect()
    assert [(r["instruction"], r["response"]) for r in got] == [("a", "")]


def test_roles_and_chat(spark):
    c = reshape.canonical_conversations(conv(spark, [("human", "a"), ("gpt", "b"), ("system", "c")])).collect()[0]
    assert [m["role"] for m in c["messages"]] == ["user", "assistant", "system"]
    raw = spark.createDataFrame([("x", [("human", "hi")])], "data_id string, conversations array<struct<from:string,value:string>>")
    got = reshape.canonical_conversations(raw, "conversations", "from", "value").collect()[0]
    assert got["messages"][0].asDict() == {"role": "user", "content": "hi"}
    i = spark.createDataFrame([("x", "do", None, "out")], "data_id string, instruction string, input string, output string")
    assert reshape.to_chat(reshape.ingest_instructions(i)).collect()[0]["messages"][0]["content"] == "do"


def test_ids(spark):
    df = spark.createDataFrame([("a_v1_en_3",), ("a_v1_de_3",), (None,), ("a_b",)], "data_id string")
    assert [r[0] for r in df.select(reshape.id_without_language(F.col("data_id"))).collect()] == ["a_v1_3", "a_v1_3", None, "a_b"]
    got = reshape.assign_ids(spark.createDataFrame([(2,), (1,)], "k int"), "my_set", ["k"]).orderBy("k").collect()
    assert [r["data_id"] for r in got] == ["my-set_v1_en_0", "my-set_v1_en_1"]


def test_pairs_pack_and_unpack(spark):
    df = spark.createDataFrame([(0, "p", True), (1, "p", False), (2, "q", True), (3, "q", False)], "position bigint, text string, label boolean")
    packed = reshape.pack_pairs(df)
    assert packed.count() == 2
    assert sorted(map(tuple, reshape.unpack_pairs(packed).select("position", "text", "label").collect())) == sorted(map(tuple, df.collect()))
    bad = spark.createDataFrame([(0, "p", False), (1, "p", True)], "position bigint, text string, label boolean")
    with pytest.raises(Exception, match="alternate"):
        reshape.pack_pairs(bad).collect()


def test_templates(spark):
    c = conv(spark, [("system", "s"), ("user", "a"), ("assistant", "b")], [("user", "a"), ("user", "b")])
    got = {r[0]: r[1] for r in c.select("data_id", reshape.chatml(F.col("messages"))).collect()}
    assert got["c1"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>user\nb<|im_end|>\n"
    one = c.where("data_id = 'c0'").select(reshape.instruct_template(F.col("messages"))).collect()[0][0]
    assert one == "<s>[INST] <<SYS>>\ns\n<</SYS>>\n\na [/INST] b </s>"
    with pytest.raises(Exception, match="alternate"):
        c.select(reshape.instruct_template(F.col("messages"))).collect()


def test_latest_takes_the_newest_and_drops_null_ids(spark):
    df = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), (None, 9, "x"), ("b", None, "only")], "data_id string, ingested_at int, v string")
    assert {r["data_id"]: r["v"] for r in reshape.latest(df).collect()} == {"a": "new", "b": "only"}


def test_budget_is_the_scan(spark):
    rows = [(f"d{i:02}", random.Random(i).randint(1, 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "data_id string, n int")
    kept, total = [], 0
    for i, n in sorted(rows):
        if total >= 50:
            break
        kept.append(i)
        total += n
    assert sorted(r["data_id"] for r in filters.within_budget(df, [F.col("data_id")], token_size=50, tokens=F.col("n")).collect()) == kept


def test_label_limits_round_up(spark):
    df = spark.createDataFrame([(i, "A" if i % 2 else "B") for i in range(20)], "data_id int, setfit_label string")
    got = filters.within_label_limits(df, {"A": 0.25, "B": 0.01}, 10, [F.col("data_id")]).collect()
    assert sorted((r["setfit_label"], r["data_id"]) for r in got) == [("A", 1), ("A", 3), ("A", 5), ("B", 0)]


def test_majority_label_prefers_the_first_met(spark):
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate("abab")] + [("y", 0, None), ("y", 1, "c")], "data_id string, exchange_idx int, label string")
    assert {r[0]: r[1] for r in aggregates.majority_label(df).collect()}["x"] == "a"


def test_token_lengths(spark):
    df = spark.createDataFrame([("x", 0, "a b", "c"), ("x", 1, "d", "e f g"), ("x", 2, "h", ""), ("y", 0, "", "")], "data_id string, exchange_idx int, instruction string, response string")
    got = {r["data_id"]: (r["inst_length"], r["resp_length"], r["last_resp_length"]) for r in aggregates.token_lengths(df).collect()}
    assert got == {"x": (4, 4, 3), "y": (0, 0, 0)}


def test_means(spark):
    df = spark.createDataFrame([("x", "r", 1.0), ("x", "", 5.0), ("x", "r", None), ("y", "r", None)], "data_id string, response string, s double")
    assert {r[0]: r[1] for r in aggregates.mean_of_answered(df, "s", "m").collect()} == {"x": 1.0, "y": 0.0}
    assert {r[0]: r[1] for r in aggregates.mean_of_answered(df, "s", "m", skip_empty=False).collect()} == {"x": 3.0, "y": 0.0}


def test_oversampling(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "data_id int")
    got = sorted(r["data_id"] for r in sampling.oversampled(df, 2.5, [F.col("data_id")]).collect())
    assert got == sorted([0, 1, 2, 3, 4] * 2 + [0, 1])
    assert sampling.oversampled(df, 0.4, [F.col("data_id")]).count() == 2


def test_cross_lingual(spark):
    df = spark.createDataFrame([("a_v1_en_1", 1), ("a_v1_de_1", 2), ("a_v2_en_1", 3), (None, 4), (None, 5)], "data_id string, r int")
    assert sorted(r["r"] for r in sampling.cross_lingual_first(df, [F.col("r")]).collect()) == [1, 3, 4]


def test_strategies():
    assert preference.weights_of(None) == preference.weights_of("default")
    assert preference.weights_of("combination_v5").difficulty == 1
    assert preference.weights_of("dedicated_quality_x").quality == 1
    assert preference.weights_of("complexity").complexity == 1
    with pytest.raises(ValueError, match="unknown"):
        preference.weights_of("nonsense")


def test_constant_and_missing_scores(spark):
    df = spark.createDataFrame([("a", "o", 1.0, float("nan"), None, "Math"), ("b", "o", 1.0, 2.0, None, "Other")], "data_id string, origin string, quality double, complexity double, difficulty_v2 double, setfit_label string")
    got = {r["data_id"]: r for r in preference.with_preference(df, "deita").collect()}
    assert got["a"]["overall_preference"] is None and got["b"]["overall_preference"] == 0.0


def unit(n, d=8, seed=1):
    m = np.random.default_rng(seed).normal(size=(n, d))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def vec_df(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")


def test_nearest_is_exact(spark):
    m = unit(150)
    d = 1 - m @ m.T
    np.fill_diagonal(d, np.inf)
    got = {r["vec_id"]: r for r in vectors.nearest(vec_df(spark, m), "vec_id", "embedding", 1, block=40).collect()}
    assert all(got[i]["other"] == d[i].argmin() and got[i]["distance"] == pytest.approx(d[i].min(), abs=1e-9) for i in range(150))


@pytest.mark.parametrize("block", [2048, 20])
def test_index_recall(spark, sf_dir, block):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    q = e.where("vec_id % 50 = 0")
    want = {(r["vec_id"], r["other"]) for r in vectors.nearest(e, "vec_id", "embedding", 10, q).collect()}
    index = vectors.CellIndex(e, "vec_id", "embedding", 16, sample=300)
    got = [(r["vec_id"], r["other"]) for r in index.search(q, 10, 12, block).collect()]
    assert len(got) == len(set(got)) == len(want)
    assert len(want & set(got)) >= 0.9 * len(want)
    every = {(r["vec_id"], r["other"]) for r in index.search(q, 10, 16, block).collect()}
    assert every == want


def test_grouped_budget(spark):
    rows = [(f"d{i:02}", "ab"[i % 2] if i % 5 else None, i % 7 + 1) for i in range(60)]
    df = spark.createDataFrame(rows, "data_id string, g string, n int").repartition(6)
    want = set()
    for g in ("a", "b", None):
        total = 0
        for i, x, n in rows:
            if x == g and total < 20:
                want.add(i)
                total += n
    got = filters.within_budget(df, [F.col("data_id")], token_size=20, tokens=F.col("n"), group=["g"]).collect()
    assert {r["data_id"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("threshold", [0.1, 0.4, 0.8])
def test_greedy_equals_the_scan(spark, threshold):
    m = unit(120, 4, 3)
    d = 1 - m @ m.T
    kept = []
    for i in range(len(m)):
        if all(round(d[i, j], 12) > threshold for j in kept):
            kept.append(i)
    df = vec_df(spark, m).withColumn("rank", F.col("vec_id"))
    assert sorted(r["vec_id"] for r in vectors.greedy_diverse(df, "vec_id", "embedding", "rank", threshold).collect()) == kept
    first = vectors.greedy_select(df, 5, "vec_id", "embedding", "rank", threshold)
    assert sorted(r["vec_id"] for r in first.collect()) == kept[:5]


def test_cluster_select(spark):
    rows = [("a", 0, 0.9), ("b", 0, 0.8), ("c", 1, 0.1), ("d", 1, 0.2), ("e", 2, 0.7), ("f", 2, None)]
    df = spark.createDataFrame(rows, "data_id string, cluster int, overall_preference double")
    got = lambda **k: sorted(r["data_id"] for r in vectors.cluster_select(df, **k).collect())
    assert got(n=4) == ["a", "b", "d", "e"]
    assert got(n=3, percentile=0.5) == ["a", "b", "e"]
    assert got(n=9) == ["a", "b", "c", "d", "e", "f"]
    assert got(n=0) == []
    assert len(got(n=3, strategy="random")) == 3
    by = vectors.cluster_select(df.withColumn("g", F.when(F.col("cluster") < 2, "x").otherwise("y")), {"x": 1, "y": 5, "z": 2}, group="g").collect()
    assert sorted(r["data_id"] for r in by) == ["a", "e", "f"]


def test_clusters_and_quality(spark):
    m = np.concatenate([np.random.default_rng(5).normal(c, 0.05, (30, 3)) for c in (0, 3, 6)])
    df = vec_df(spark, m)
    got = vectors.clustered(df, "embedding", 3).collect()
    label = {r["vec_id"]: r["cluster"] for r in got}
    assert all(len({label[i] for i in range(s, s + 30)}) == 1 for s in (0, 30, 60)) and len(set(label.values())) == 3
    many = vectors.clustered(df, "embedding", 12, coarse=3).select("cluster").distinct().count()
    assert 9 <= many <= 15
    q = vectors.cluster_quality(spark.createDataFrame(got), "embedding").collect()[0]
    assert q["davies_bouldin"] < 0.2 and q["calinski_harabasz"] > 1000
    assert len(vectors.reduced(df, "embedding").first()["reduced"]) <= 2


def test_scorer_routes_and_scatters(spark):
    df = spark.createDataFrame([("a", 0, "i", "r", "Coding"), ("a", 1, "i", "", "Coding"), ("b", 0, "i", "r", "Math")], "data_id string, exchange_idx int, instruction string, response string, label string")
    s = scorers.ModelScorer("q", lambda: lambda f: f["response"].str.len() + 0.5, ("Coding",))
    got = {(r["data_id"], r["exchange_idx"]): r["score"] for r in s.score(df).collect()}
    assert got == {("a", 0): 1.5, ("a", 1): 0.5, ("b", 0): None}
    assert {r[0]: r[1] for r in s.per_sample(df).collect()} == {"a": 1.5, "b": 0.0}

    def broken():
        def f(_):
            raise RuntimeError

        return f

    bad = scorers.ModelScorer("q", broken, on_failure=3.0)
    assert {r["score"] for r in bad.score(df).collect()} == {3.0}
    with pytest.raises(ValueError, match="unknown analysis"):
        scorers.default_scorers().get("nonsense")


def test_generate(spark):
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    got = scorers.generate(df, F.col("p"), lambda: lambda ps: [x.upper() for x in ps], batch=1).collect()
    assert sorted(r["completion"] for r in got) == ["A", "B"]


def test_model_answers_join_rules(spark):
    df = spark.createDataFrame([("x", "p", "yes, it is", [("keyword_included", "yes"), ("language", "in French")], {"1": False}, None), ("y", "p", "r", [], None, 8.0)], "data_id string, instruction string, response string, constraints array<struct<type:string,expr:string>>, answers map<string,boolean>, mark double")
    got = {r["data_id"]: r for r in scorers.instruction_following(df, answers="answers", fallback="mark").collect()}
    assert got["x"]["followed"] == [True, False] and got["x"]["score"] == 0.5
    assert got["y"]["score"] == 0.8


def test_metric_tables(spark):
    s = spark.createDataFrame([("a",), ("b",)], "data_id string")
    t = {"m": spark.createDataFrame([("a", 1.0)], "data_id string, m double"), "k": spark.createDataFrame([("b", 2.0), ("z", 3.0)], "data_id string, k double")}
    assert sorted(map(tuple, joins.attach_metric_tables(s, t).collect())) == [("a", 1.0, None), ("b", None, 2.0)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], MSG)
    assert reshape.exchanges(e).count() == 0
    assert aggregates.token_lengths(reshape.exchanges(e)).count() == 0
    v = spark.createDataFrame([], "vec_id bigint, embedding array<double>, rank int")
    assert vectors.nearest(v, "vec_id", "embedding").count() == 0
    assert vectors.greedy_diverse(v, "vec_id", "embedding", "rank").count() == 0


def test_shuffle_depends_on_seed_only(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("data_id"))
    a = [r[0] for r in sampling.sample_random(df, 10, 3).collect()]
    b = [r[0] for r in sampling.sample_random(df.repartition(7), 10, 3).collect()]
    assert a == b and a != [r[0] for r in sampling.sample_random(df, 10, 4).collect()]
    share = sampling.train_test_split(df, 0.3).where("split = 'test'").count()
    assert 10 < share < 50 and math.isfinite(share)


def test_exact_quantiles_equal_numpy(spark):

    r = random.Random(12)
    rows = [(r.choice("abc"), r.choice([0.0, 0.0, 1.0, r.gauss(0, 5)]), r.random() if r.random() < 0.9 else None) for _ in range(3000)] + [("one", 4.0, None), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    shares = [0.0, 0.01, 0.28, 0.5, 0.99, 1.0]
    got = aggregates.quantiles(df, {"x": F.col("x"), "y": F.col("y")}, shares, "g").collect()
    assert {q["g"] for q in got} == {"a", "b", "c", "one"}
    for q in got:
        for i, n in ((1, "x"), (2, "y")):
            own = [v[i] for v in rows if v[0] == q["g"] and v[i] is not None]
            assert q[n] is None if not own else q[n] == pytest.approx(np.quantile(own, shares))
    every = aggregates.quantiles(df, {"x": F.col("x")}, shares).collect()
    assert every[0]["x"] == pytest.approx(np.quantile([v[1] for v in rows if v[1] is not None], shares))
    assert aggregates.quantiles(df.limit(0), {"x": F.col("x")}, [0.5]).collect()[0]["x"] is None
    assert aggregates.quantiles(df.limit(0), {"x": F.col("x")}, [0.5], "g").count() == 0


def test_statistics_of_groups_are_sent_to_the_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("origin"), F.col("id").cast("double").alias("complexity"))
    plan = aggregates.min_max_scaled(df, ["complexity"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rows_are_numbered_in_their_order(spark):
    df = spark.range(0, 100, 1, 7).withColumnRenamed("id", "v")
    assert [r["n"] for r in reshape.numbered(df, "n").orderBy("v").collect()] == list(range(100))
    assert reshape.numbered(df.limit(0), "n").count() == 0


def test_nan_in_a_metric_table_is_missing(spark):
    t = {"m": spark.createDataFrame([("a", float("nan")), ("b", 1.0)], "data_id string, m double")}
    got = {r["data_id"]: r["m"] for r in joins.attach_metric_tables(spark.createDataFrame([("a",), ("b",), ("c",)], "data_id string"), t).collect()}
    assert got == {"a": None, "b": 1.0, "c": None}
