import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessera.plans.runner import Run
from tessera.plans.spec import Selection, SelectionSpec, SourceSpec, parse_spec, specs_of_table
from tessera.sources import readers, writers
from tessera.streaming import scoring

YAML = """
pick:
  scoring_strategy: quality
  sample_size: 4
  final_setfit_proportions: {Math: .5, Coding: .5}
  ordering_strategy: category
  data:
    - {name: a, data_path: DATA_PATH/a.jsonl, multi_turn: True, language: en}
    - {name: b, sample_size: 2, setfit_limits: [{Math: .5}, {Coding: 1.0}], subsets: {s1: {language: de}, s2: null}, filter_key: kind}
"""


def pool(spark, n=20):
    labels = ["Math", "Coding", "Other", None]
    rows = [(f"s{i:02}", "a" if i % 2 else "b", [("system", ""), ("user", "q"), ("assistant", "r")], float(i), float(i % 5), float(i % 3), i, i, i, labels[i % 4]) for i in range(n)]
    return spark.createDataFrame(rows, "data_id string, origin string, messages array<struct<role:string,content:string>>, quality double, complexity double, difficulty_v2 double, inst_length int, resp_length int, last_resp_length int, setfit_label string")


def test_parse():
    s = parse_spec(YAML)
    assert s.name == "pick" and s.sample_size == 4 and len(s.data) == 3
    assert s.data[1].subset_name == "s1" and s.data[1].language == "de" and s.data[1].setfit_limits == {"Math": 0.5, "Coding": 1.0}
    with pytest.raises(ValueError):
        parse_spec({})


def test_selection(spark):
    spec = SelectionSpec("x", "longest", 4, final_setfit_proportions={"Math": 0.5, "Coding": 0.5}, ordering_strategy="category")
    got = Selection(spec, pool(spark), seed=None).result().collect()
    assert [(r["data_id"], r["setfit_label"]) for r in got] == [("s12", "Math"), ("s16", "Math"), ("s13", "Coding"), ("s17", "Coding")]
    assert all(len(r["messages"]) == 2 for r in got)


def test_sources_keep_their_own_budgets(spark):
    spec = SelectionSpec("x", "longest", data=(SourceSpec("a", sample_size=2), SourceSpec("b", token_size=50), SourceSpec("zzz")))
    got = Selection(spec, pool(spark), seed=None).sampled().collect()
    assert sorted(r["data_id"] for r in got) == ["s16", "s17", "s18", "s19"]


def test_clustering(spark):
    spec = SelectionSpec("x", "quality", 6, clustering="categories", final_setfit_proportions={"Math": 0.5, "Coding": 0.5})
    got = Selection(spec, pool(spark).withColumn("c", F.col("inst_length") % 3), cluster_column="c", seed=None).sampled().collect()
    assert len(got) == 6 and {r["setfit_label"] for r in got} == {"Math", "Coding"}
    with pytest.raises(ValueError, match="clustering"):
        Selection(SelectionSpec("x", "quality", 6, clustering="odd"), pool(spark)).sampled()


def test_embedding_strategy(spark):
    p = pool(spark).withColumn("v", F.array(F.lit(1.0), (F.col("inst_length") % 4).cast("double")))
    got = Selection(SelectionSpec("x", "deita_embedding", 4, min_distance=0.01), p, vector="v", seed=None).sampled()
    assert got.count() == 4 and got.select("v").distinct().count() == 4


def test_no_size_keeps_all(spark):
    assert Selection(SelectionSpec("x", "random"), pool(spark)).result().count() == 20


def test_specs_of_table(spark):
    c = spark.createDataFrame([("s", "longest", 5, "a", 2.0), ("s", "longest", 5, "a", 2.0), ("s", "longest", 5, "b", None)], "spec_name string, scoring_strategy string, sample_size int, name string, oversampling double")
    got = specs_of_table(c)
    assert len(got) == 1 and [d.oversampling for d in got[0].data] == [2.0, None]


def test_jsonl_and_metric_columns(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text("".join(json.dumps({"data_id": str(i), "messages": [{"role": "user", "content": "hi"}]}) + "\n" for i in range(3)))
    df = readers.read_jsonl(spark, str(f), readers.CONVERSATIONS)
    (tmp_path / "quality_scores").mkdir()
    (tmp_path / "quality_scores/x.csv").write_text("1.5\nNone\nNaN\n")
    (tmp_path / "categories_v2").mkdir()
    (tmp_path / "categories_v2/x_aggr.csv").write_text("Math\nCoding\n")
    got = readers.read_metrics(spark, str(tmp_path), "x", df).orderBy("data_id").collect()
    assert [(r["quality"], r["setfit_label"]) for r in got] == [(1.5, "Math"), (None, "Coding"), (None, None)]
    assert readers.resolve_path("DATA_PATH/x", "/d") == "/d/x"
    readers.check_presence(spark, [str(f)])
    with pytest.raises(FileNotFoundError):
        readers.check_presence(spark, [str(tmp_path / "nothing")])
    out = str(tmp_path / "out")
    writers.write_jsonl(df, out)
    assert readers.read_jsonl(spark, out, readers.CONVERSATIONS).count() == 3
    assert readers.result_exists(spark, str(tmp_path), "ou") and not readers.result_exists(spark, str(tmp_path), "ou", repeat=True)
    assert readers.read_training(spark, out.replace("out", "x.jsonl")).columns == ["messages"]
    writers.write_metric_lines(spark.createDataFrame([("b", None), ("a", 1.0)], "data_id string, m double"), str(tmp_path / "m"), "m", ["data_id"])
    assert [r[0] for r in readers.positions(spark.read.text(str(tmp_path / "m"))).orderBy("position").select("value").collect()] == ["1.0", "None"]
    writers.write_metrics(df.withColumn("m", F.lit(1)), str(tmp_path / "ms"), ["m"])
    writers.write_sidecar(df, str(tmp_path / "side"), ["messages"])
    writers.write_table(df.withColumn("origin", F.lit("o")), str(tmp_path / "t"))
    assert readers.read_source(spark, str(tmp_path / "t")).where("origin = 'o'").count() == 3


def test_rows_of_files_are_numbered_by_name_and_line(spark, tmp_path):
    n, block = 0, spark.conf.get("spark.sql.files.maxPartitionBytes")
    for k in range(12):  # a scan takes larger files first, and cuts the last ones
        more = 1 + 10 * k * k
        (tmp_path / f"part-{k}.txt").write_text("".join(f"{i}\n" for i in range(n, n + more)))
        n += more
    (tmp_path / "part-12.txt").write_text("")
    try:
        for size in (block, "3000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = spark.read.text(str(tmp_path))
            assert sorted((r["position"], int(r["value"])) for r in readers.positions(df).collect()) == [(i, i) for i in range(n)]
            even = readers.positions(df.where("value % 2 = 0").select(F.col("value").alias("_metadata"))).collect()
            assert sorted((r["position"], int(r["_metadata"])) for r in even) == [(i, 2 * i) for i in range((n + 1) // 2)]
            twice = readers.positions(df.select(F.explode(F.array("value", "value")).alias("v"))).collect()
            assert sorted((r["position"], int(r["v"])) for r in twice) == [(i, i // 2) for i in range(2 * n)]
            last = readers.positions(df.orderBy(F.col("value").cast("int").desc()).persist()).collect()
            assert {(r["position"], int(r["value"])) for r in last} == {(i, n - 1 - i) for i in range(n)}
            assert readers.positions(df.where("false")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.catalog.clearCache()


def pairs_in_files(at, sizes):
    """Lines of good and bad examples in files of so many lines, odd ones too; the ids of the pairs."""
    lines = [json.dumps({"data_id": f"i{i // 2}", "prompt": [{"role": "user", "content": " ".join(hashlib.md5(f"{i // 2} {j}".encode()).hexdigest() for j in range(9))}], "label": i % 2 == 0}) + "\n" for i in range(sum(sizes))]
    at.mkdir()
    for k, n in enumerate(sizes):
        (at / f"part-{k:05}.json").write_text("".join(lines[sum(sizes[:k]) : sum(sizes[:k]) + n]))
    return {f"i{i // 2}" for i in range(sum(sizes))}


def pairs_selected(spark, root, **spec):
    spec = parse_spec({"run": {"type_dataset": "kto", "scoring_strategy": "random", **spec, "data": [{"name": "k", "data_path": "DATA_PATH/k.jsonl"}]}})
    return Run(spark, spec, str(root), schemas={"k": "data_id string, prompt array<struct<role:string,content:string>>, label boolean"}).result().collect()


def test_pairs_that_are_cut_between_files(spark, tmp_path):
    ids = pairs_in_files(tmp_path / "k.jsonl", [1, 31, 3, 65])
    (tmp_path / "tokens_scores/responses").mkdir(parents=True)
    (tmp_path / "tokens_scores/responses/k.csv").write_text("".join(f"{i}\n" for i in range(50)))
    got = pairs_selected(spark, tmp_path)
    assert sorted((r["data_id"], r["label"], r["resp_length"]) for r in got) == sorted((i, x, int(i[1:])) for i in ids for x in (True, False))
    (tmp_path / "k.jsonl/part-00004.json").write_text(json.dumps({"data_id": "alone", "prompt": [], "label": True}) + "\n")
    with pytest.raises(Exception, match="must alternate"):
        pairs_selected(spark, tmp_path)


def test_pairs_of_many_partitions_come_in_order(spark, tmp_path):
    ids = pairs_in_files(tmp_path / "k.jsonl", [2000])
    # plans that read fewer columns are joined to fewer partitions
    conf = {f"spark.sql.adaptive.{k}": v for k, v in (("advisoryPartitionSizeInBytes", "100k"), ("coalescePartitions.parallelismFirst", "false"), ("coalescePartitions.minPartitionSize", "10k"))}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = pairs_selected(spark, tmp_path)
        want = sorted(ids, key=lambda i: hashlib.md5(f"1234|{i}".encode()).hexdigest())
        assert [(r["data_id"], r["label"]) for r in got] == [(i, x) for i in want for x in (True, False)]
        few = pairs_selected(spark, tmp_path, sample_size=10)
        assert len(few) == 20 and [r["label"] for r in few] == [True, False] * 10 and all(a["data_id"] == b["data_id"] for a, b in zip(few[::2], few[1::2]))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_registry(spark):
    r = readers.Registry()
    r.register("one", "The first", lambda s: s.range(3))
    r.register_pattern("many_*", lambda name: lambda s: s.range(int(name[5:])))
    assert r.load(spark, "one").count() == 3 and r.load(spark, "many_7").count() == 7 and r.title("one") == "The first"
    with pytest.raises(ValueError, match="unknown dataset"):
        r.load(spark, "other")
    r.create_views(spark)
    assert spark.sql("select count(*) from one").first()[0] == 3
    u = readers.union_subsets({"a": spark.range(1), "b": spark.range(2)})
    assert sorted(x["subset"] for x in u.collect()) == ["a", "b", "b"]


def test_stream(spark, tmp_path):
    rows = [("a", [("human", "one two"), ("gpt", "three")], "o", "en"), ("a", [("human", "again"), ("gpt", "x")], "o", "en"), (None, [], "o", "en")]
    df = spark.createDataFrame(rows, "data_id string, messages array<struct<role:string,content:string>>, origin string, language string").withColumn("ingested_at", F.current_timestamp())
    df.write.parquet(str(tmp_path / "in"))
    s = scoring.scored_samples(scoring.read_stream(spark, str(tmp_path / "in")))
    scoring.write_stream(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["data_id"], r["inst_length"], r["resp_length"]) for r in got) == [("a", 1, 1), ("a", 2, 1)]
    d = scoring.deduplicated(scoring.read_stream(spark, str(tmp_path / "in")))
    scoring.write_stream(d.select("data_id"), str(tmp_path / "out2"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out2")).where("data_id = 'a'").count() == 1
