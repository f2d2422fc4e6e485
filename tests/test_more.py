"""Operators without SQL, sources and sinks against brute force and round trips; slices of ordered windows."""

import bz2
import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiloom.operators import windows
from lexiloom.plans import session
from lexiloom.plans.reports import PARALLEL, schema_faults
from lexiloom.queries import QUERIES
from lexiloom.sources import readers, writers

SF = "/root/testdata/sf0.001"


def test_in_order_equals_one_pass(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randint(0, 50), i, rng.randint(0, 9), "x") for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v int, _k2 string")
    got = {r.i: (r._nth, r._before) for r in windows.in_order(df, ["g"], ["o", "i"], windows.range_slices(df, "o", 8), "v").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        before = 0
        for n, r in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2])), 1):
            want[r[2]] = (n, before)
            before += r[3]
    assert got == want
    empty = df.limit(0)
    assert windows.in_order(empty, [], ["o"], windows.range_slices(empty, "o")).count() == 0


@pytest.mark.parametrize("fits", [True, False])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookups_agree_however_large_the_table(spark, fits, how):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 3)], "k string, n int")
    known = spark.createDataFrame([("a", "x"), ("c", "y")], "k string, v string")
    got = sorted(map(str, session.looked_up(rows, known, ["k"], how, fits).collect()))
    assert got == sorted(map(str, rows.join(known, "k", how).collect()))


def test_small_tables_are_small_in_rows_and_bytes(spark, monkeypatch):
    df = spark.createDataFrame([("a" * 100, None), (None, {"k": 1})], "k string, m map<string,int>")
    assert session.is_small(df) and session.is_small(df.limit(0)) and not session.is_small(df, 1)
    monkeypatch.setattr(session, "SMALL_BYTES", 50)
    assert not session.is_small(df)


def test_schema_faults(spark):
    asked = StructType.fromDDL(PARALLEL)
    assert schema_faults(spark.read.parquet(f"{SF}/parallel.parquet").schema, asked) == []
    other = StructType.fromDDL(PARALLEL.replace("option_ids:array<string>", "option_ids:array<int>").replace("subject string, ", "").replace("answer_index:bigint", "answer_index:string"))
    assert schema_faults(other, asked) == [("subject", "string", "missing"), ("translations{}.answer_index", "bigint", "string"), ("translations{}.option_ids[]", "string", "int")]


def test_queries_without_sql(spark):
    m = {(r.metric, r.model_a, r.model_b): r for r in QUERIES["m20_significance"](spark, SF).collect()}
    assert len(m) == 9 and all(m[x, "base", "tuned"].low <= m[x, "base", "tuned"].point <= m[x, "base", "tuned"].high for x in ("accuracy", "all right", "agreement"))
    assert m["accuracy", "base", "tuned"].point == pytest.approx(m["accuracy", "base", None].point - m["accuracy", "tuned", None].point, abs=2e-6)
    packs = QUERIES["w2_round_robin_packs"](spark, SF).collect()
    assert [(r.chunk, r.lang) for r in packs] == sorted((r.chunk, r.lang) for r in packs)
    texts = spark.read.parquet(f"{SF}/documents.parquet").where("lang is not null and trim(text) <> ''").count()
    assert sum(r.n_texts for r in packs) == texts
    assert {r.table_name for r in QUERIES["n8_schema_faults"](spark, SF).collect()} == {"flat"}


def test_more_sources_and_sinks(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "base_consistency.json").write_text(json.dumps({"acc": 0.5}))
    assert [tuple(r) for r in readers.read_tagged_results(spark, str(tmp_path / "r" / "*_consistency.json"), "acc double").collect()] == [("base", 0.5)]
    (tmp_path / "r" / "s.json").write_text(json.dumps({"results": {"mmlu_a": {"acc": 0.2}, "mmlu_b": {"acc": 0.4}, "mmlu_pro_x": {"acc": 1.0}, "other": {"acc": 0.1}}}))
    got = readers.read_nested_scores(spark, str(tmp_path / "r" / "s.json"), ["mmlu", "mmlu_pro"], "acc").collect()
    assert sorted((r.run, r.parent, round(r.score, 6), r.n) for r in got) == [("r", "mmlu", 0.3, 2), ("r", "mmlu_pro", 1.0, 1)]
    (tmp_path / "t.jsonl").write_text('{"talk_id": "t", "para_data": {"en": "a"}}\n')
    assert [r.talk_id for r in readers.read_talks(spark, str(tmp_path / "t.jsonl")).collect()] == ["t"]
    named = tmp_path / "m" / "run1" / "checkpoint-5"
    named.mkdir(parents=True)
    (named / "a.json").write_text('{"acc": 0.7}')
    (named / "b.json").write_text('{"acc": 0.9}')
    assert [tuple(r) for r in readers.read_metric_tree(spark, str(tmp_path / "m"), "acc").collect()] == [("run1", 0.9)]
    (tmp_path / "verdicts_de_3.json").write_text('{"fact_id": "f"}')
    assert [(r.fact_id, r.lang, r.part) for r in readers.read_named_parts(spark, str(tmp_path / "verdicts_de_3.json"), "fact_id string").collect()] == [("f", "de", 3)]
    item = {"id": "Q2", "labels": {"en": {"value": "x"}}, "claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}}]}}
    with bz2.open(tmp_path / "dump.json.bz2", "wt") as f:
        f.write("[\n" + json.dumps(item) + "\n]\n")
    assert [(r.id, r.labels, r.types) for r in readers.read_dump(spark, str(tmp_path / "dump.json.bz2"), spark.createDataFrame([("Q2",)], "id string"), ["en"]).collect()] == [("Q2", {"en": "x"}, ["Q5"])]
    wanted = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "k string")
    assert [r.k for r in readers.not_yet_fetched(wanted, wanted.where("k = 'a'"), "k").collect()] == ["b"]
    df = spark.createDataFrame([("en", 1), ("de", 2)], "language string, n int")
    for _ in range(2):
        writers.write_whole(df, str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 2
    writers.write_sidecar(df, str(tmp_path / "side"), source="x")
    assert spark.read.json(str(tmp_path / "side")).first().asDict() == {"rows": 2, "columns": ["language", "n"], "source": "x"}
    writers.write_jsonl(df, str(tmp_path / "j"), ("language",))
    assert spark.read.json(str(tmp_path / "j")).where("language = 'de'").first().n == 2
    assert writers.summary(df.withColumn("bulk", F.lit(1)), ("bulk",)).columns == df.columns
    with pytest.raises(ValueError, match="no report"):
        writers.latex_table(spark.range(1001).selectExpr("id", "id as n"), "id")
