import glob
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexiloom.functions import ids, stats, text
from lexiloom.operators import heavy_keys, sampling, windows
from lexiloom.operators.redirects import resolve_redirects
from lexiloom.queries import ORACLES, QUERIES
from lexiloom.sources import readers, writers
from lexiloom.streaming import events as streams

SF = "/root/testdata/sf0.001"


def value(x):
    if isinstance(x, float) or hasattr(x, "quantize"):
        return "nan" if math.isnan(x) else f"{float(x):.5g}"
    return f"{x}" if not isinstance(x, int) or isinstance(x, bool) else f"{float(x):.5g}" if abs(x) < 1e5 else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(value(r[c]) for c in columns) for r in df.collect())
    r = duck.execute(ORACLES[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert mine == sorted(tuple(value(x[names.index(c)]) for c in columns) for x in r.fetchall())


def test_ids(spark):
    told = {"Q12": "Q12", "q12": "Q12", " Q12\n": "Q12", "wd:Q12": "Q12", "<Q12>": "Q12", "entity/Q12": "Q12", "Q1​2": "Q12", "Ｑ１２": "Q12", "Q١٢": "Q12", "12": "Q12", "Q 0012": "Q12", "Q12\xa0": "Q12", "": None, "?": None, "n/a": None, "P12": None, None: None}
    df = spark.createDataFrame(list(told.items()), "x string, want string")
    assert [r for r in df.select("x", "want", ids.read_id(F.col("x"), "Q").alias("got")).collect() if r.want != r.got] == []
    facts = ["Q1|P2|Q3", "q1|p2|q3", "wd:Q1|wdt:P2|wd:Q3", "Q1|P2|Q3#r4", "Q1 | P2 | Q3", "Q1​|P2|⁠Q3", "Q1/P2/Q3", "fact:Q1|P2|Q3", "Q1_P2_Q3", "Q01|P002|Q03"]
    df = spark.createDataFrame([(x,) for x in facts], "x string")
    assert {tuple(r) for r in df.select(*ids.read_fact_id(F.col("x"))).collect()} == {("Q1", "P2", "Q3")}


def test_redirects(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "d"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), (None, "a"), ("q", None)] + [(f"n{i}", f"n{i + 1}") for i in range(40)]
    got = {r[0]: r[1] for r in resolve_redirects(spark.createDataFrame(edges, "o string, n string"), F.col("o"), F.col("n")).collect()}
    assert got == {"a": "d", "b": "d", "c": "d", "e": "d"} | {f"n{i}": "n40" for i in range(40)}
    assert resolve_redirects(spark.createDataFrame([], "o string, n string"), F.col("o"), F.col("n")).count() == 0


def test_heavy_keys(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}", None if i % 2 else "r", 9) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, object_id string, relation string, n long")
    assert {tuple(r) for r in heavy_keys.heavy_keys(df, ["object_id", "relation"], 0.05).collect()} == {("object_id", "hot"), ("relation", "r")}
    assert heavy_keys.heavy_keys(df.limit(0), ["object_id"], 0.05).count() == 0
    p = {r.key_value: r for r in heavy_keys.key_profile(df, "object_id", "relation", "relation", ("r",)).collect()}
    assert (p["hot"].n_facts, p["hot"].n_subjects, p["hot"].n_r) == (100, 1, 50)


def test_stats(spark):
    a = F.array(*map(F.lit, "abcd"))
    df = spark.range(1).select(stats.rank_consistency(a, a).alias("same"), stats.rank_consistency(a, F.reverse(a)).alias("floor"), *[c.alias(x) for c, x in zip(stats.wilson(F.lit(0), F.lit(10)), ("lo", "hi"))])
    r = df.first()
    assert r.same == pytest.approx(1) and 0 < r.floor < 0.1 and r.lo == 0 and 0.2 < r.hi < 0.4


def test_packing_keeps_texts(spark):
    rows = [("a", i, "x" * n) for i, n in enumerate([40, 40, 400, 4, 4, 90])] + [("b", 0, "y" * 8), ("b", 1, None), ("b", 2, "  ")]
    got = windows.pack(spark.createDataFrame(rows, "g string, o long, t string"), "g", "o", "t", 20).orderBy("g", "chunk").collect()
    assert "".join(r.text for r in got if r.g == "a").replace("\n", "") == "x" * 578
    assert [r.n_tokens for r in got if r.g == "a"] == [20, 100, 2, 22] and [r.n_texts for r in got if r.g == "b"] == [1]


def test_sampling(spark):
    df = spark.createDataFrame([(f"s{i % 7}", i + 1) for i in range(7)], "s string, n long")
    assert sampling.largest_remainder(df, "n", "s", 10).agg(F.sum("quota")).first()[0] == 10
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    a, b = ({tuple(r) for r in sampling.per_stratum(rows.repartition(n), ["g"], "id", 5).collect()} for n in (1, 8))
    assert a == b and len(a) == 15


def test_text(spark):
    df = spark.createDataFrame([("日本", "日本の首都", "ja", True), ("ab", "cabd", "en", False), ("rome", "Is Rome big?", "en", True), ("rom", "rome", "en", False), ("a.c\\E", "xx a.c\\E yy", "en", True), ("abc", None, "en", None)], "n string, t string, l string, want boolean")
    assert [r for r in df.select("want", text.leaks(F.col("n"), F.col("t"), F.col("l")).alias("got")).collect() if r.want != r.got] == []
    df = spark.createDataFrame([("D", "D"), ("Rome", "B"), ("it is rome", "B"), ("c) xx", "C"), ("durham", None), ("", None), (None, None)], "p string, want string")
    o = [F.lit(x) for x in ("Paris", "Rome", "Oslo", "Bonn")]
    assert [r for r in df.select("want", text.answer_letter(F.col("p"), o).alias("got")).collect() if r.want != r.got] == []


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{bad\n{"id": 2}\n')
    assert readers.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id long", tolerant=True).count() == 2
    assert readers.bad_lines(spark, str(tmp_path / "a.jsonl"), StructType().add("id", "long")).count() == 1
    (tmp_path / "t.nt").write_text("<http://e/Q1> <http://p/P2> <http://e/Q3> .\n# no\n<http://e/Q1> <http://p/P2> \"x\" .\n")
    assert [tuple(r) for r in readers.read_ntriples(spark, str(tmp_path / "t.nt")).collect()] == [("Q1", "P2", "Q3")]
    entity = lambda i: json.dumps({"id": f"Q{i}", "labels": {"en": {"value": f"e{i}"}, "xx": {"value": "?"}}, "claims": {"P31": [{"mainsnak": {"datavalue": {"value": {"id": "Q5"}}}}, {"mainsnak": {}}]}})
    (tmp_path / "dump.json").write_text("[\n" + entity(1) + ",\n" + entity(2) + "\n]\n")
    got = readers.read_dump(spark, str(tmp_path / "dump.json"), spark.createDataFrame([("Q2",)], "id string"), ["en"]).collect()
    assert [(r.id, r.labels, r.types) for r in got] == [("Q2", {"en": "e2"}, ["Q5"])]
    (tmp_path / "de").mkdir()
    (tmp_path / "de" / "capital.json").write_text(json.dumps({"relation_id": "P1", "prompt_templates": ["x"], "samples": [{"subject": "a", "object": "b", "index": 0}]}))
    assert [tuple(r) for r in readers.read_relations(spark, str(tmp_path / "de")).collect()] == [("de", "capital", "x", "a", "b", 0)]
    (tmp_path / "w.md").write_text("| # | id |\n|---|---|\n| 1 | `Q1|P2|Q3` |\n".replace("Q1|P2|Q3", "Q1-P2"))
    assert [r.fact_id for r in readers.read_worksheet(spark, str(tmp_path / "w.md")).collect()] == ["Q1-P2"]
    df = spark.createDataFrame([("en", "train", i) for i in range(5)] + [("de", "test", 9)], "language string, split string, n long")
    writers.write_release(df, str(tmp_path / "rel"), files=2)
    assert spark.read.parquet(str(tmp_path / "rel")).where("language = 'en'").count() == 5
    assert sorted(r.n for r in writers.write_worksheets(df, str(tmp_path / "ws"), "language", ["n"], 2).collect()) == [1, 1, 2, 2]
    assert writers.markdown_table(df.limit(1)).startswith("| language | split | n |")
    assert "\\textbf{9}" in writers.latex_table(df.select("split", "n"), "split")


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet(SF + "/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(str(tmp_path / "in"))
    s = streams.tumbling_counts(streams.read_stream(spark, str(tmp_path / "in"), e.schema), "1 hour", "0 seconds")
    streams.run_once(s, str(tmp_path / "out"), str(tmp_path / "cp"))
    closed = spark.read.parquet(str(tmp_path / "out"))
    batch = streams.tumbling_counts(e, "1 hour").withColumn("start", F.col("start").cast("timestamp"))
    assert closed.count() > 0 and closed.subtract(batch).count() == 0
    assert streams.sessions(e, "30 minutes").agg(F.sum("n")).first()[0] == e.count()
