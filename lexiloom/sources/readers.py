"""Sources: each gives a DataFrame whose filters and columns reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType, tolerant: bool = False) -> DataFrame:
    """One object a line; blank lines are skipped. Bad lines fail the read, or are left out if tolerant."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(line): what a tolerant read leaves out."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.where(F.from_json("value", schema.add("_bad", "string"), {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNotNull()).select(F.col("value").alias("line"))


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(.., s, p, o): entity triples of N-Triples lines; other lines are left out."""
    pattern = r"^<[^<>]*/(Q[0-9]+)>\s+<[^<>]*/(P[0-9]+)>\s+<[^<>]*/(Q[0-9]+)>\s*\.\s*$"
    rest = [c for c in lines.columns if c != column]
    return lines.where(F.col(column).rlike(pattern)).select(*rest, *[F.regexp_extract(column, pattern, i).alias(x) for i, x in ((1, "s"), (2, "p"), (3, "o"))])


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def read_dump(spark: SparkSession, path: str, wanted: DataFrame | None, languages: list[str]) -> DataFrame:
    """(id, labels, types) from a dump that is one JSON array with an entity a line (bz2 is split).

    wanted: (id) semi-joined, so the build side grows with it and the planner decides how.
    """
    schema = "id string, labels map<string,struct<value:string>>, claims map<string,array<struct<mainsnak:struct<datavalue:struct<value:struct<id:string>>>>>>"
    rows = spark.read.text(path).select(F.from_json(F.regexp_replace(F.trim("value"), ",$", ""), schema).alias("e")).where("e.id is not null").select("e.*")
    if wanted is not None:
        rows = rows.join(wanted.select("id"), "id", "left_semi")
    labels = F.transform_values(F.map_filter("labels", lambda k, v: k.isin(*languages)), lambda k, v: v["value"])
    types = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.element_at("claims", F.lit("P31")), lambda c: c["mainsnak"]["datavalue"]["value"]["id"]))))
    return rows.select("id", labels.alias("labels"), F.coalesce(types, F.array().cast("array<string>")).alias("types"))


def read_relations(spark: SparkSession, pattern: str) -> DataFrame:
    """(lang, relation, template, subject, object, index) from lang/relation.json files of nested samples."""
    schema = "relation_id string, prompt_templates array<string>, samples array<struct<subject:string,object:string,index:bigint>>"
    df = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("path", F.input_file_name())
    at = r"([^/]+)/([^/]+)\.json$"
    df = df.select(F.regexp_extract("path", at, 1).alias("lang"), F.regexp_extract("path", at, 2).alias("relation"), F.get("prompt_templates", F.lit(0)).alias("template"), F.explode("samples").alias("s"))
    return df.select("lang", "relation", "template", "s.*")


def read_worksheet(spark: SparkSession, path: str, pattern: str = r"^\|\s*[0-9]+\s*\|\s*`?([^|`]+?)`?\s*\|") -> DataFrame:
    """(file, fact_id): ids in the second column of markdown tables with numbered rows."""
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_extract("value", pattern, 1).alias("fact_id"))
    return rows.where("fact_id <> ''")


def read_named_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON files named .._{lang}_{part}.json, with lang and part."""
    df = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_f", F.input_file_name())
    at = r"_([a-z]{2,3})_([0-9]+)\.json$"
    return df.withColumn("lang", F.regexp_extract("_f", at, 1)).withColumn("part", F.regexp_extract("_f", at, 2).cast("int")).drop("_f")


def read_metric_tree(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """(run, value): the largest value of a metric among the JSON files below each run's folder."""
    df = spark.read.schema(f"{metric} double").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    run = F.regexp_replace(F.regexp_extract(F.input_file_name(), r"([^/]+(?:/checkpoint-[0-9]+)?)/[^/]+\.json$", 1), "/checkpoint-[0-9]+$", "")
    return df.select(run.alias("run"), F.col(metric).alias("value")).where("value is not null").groupBy("run").agg(F.max("value").alias("value"))


def read_tagged_results(spark: SparkSession, pattern: str, schema: str, suffix: str = "_consistency.json") -> DataFrame:
    """(tag, *schema): one row a result file named {tag}{suffix}."""
    df = spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("_f", F.input_file_name())
    tag = F.regexp_extract("_f", r"([^/]+)" + suffix.replace(".", r"\.") + "$", 1)
    return df.select(tag.alias("tag"), *[c for c in df.columns if c != "_f"]).where("tag <> ''")


def read_nested_scores(spark: SparkSession, pattern: str, parents: list[str], metric: str) -> DataFrame:
    """(run, parent, score, n): the mean of a metric over each parent's tasks, from files `results: {task: {metric: x}}`.

    A task belongs to the longest parent that its name begins with; tasks of no parent and null scores are left out.
    """
    df = spark.read.schema("results map<string,map<string,double>>").option("multiLine", True).json(pattern)
    x = df.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("run"), F.explode("results").alias("task", "scores")).withColumn("score", F.col("scores")[metric])
    parent = F.coalesce(*[F.when(F.col("task").startswith(p), F.lit(p)) for p in sorted(parents, key=len, reverse=True)])
    return x.select("run", parent.alias("parent"), "score").where("parent is not null and score is not null").groupBy("run", "parent").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


def read_talks(spark: SparkSession, path: str) -> DataFrame:
    """(ord, talk_id, para_data): a file of talks, one object a line, with their place in it."""
    df = spark.read.schema("talk_id string, para_data map<string,string>").option("mode", "FAILFAST").json(path)
    return df.select(F.monotonically_increasing_id().alias("ord"), "talk_id", "para_data")


def not_yet_fetched(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The distinct keys that a cache doesn't hold: what a lookup has to ask for."""
    return wanted.where(F.col(key).isNotNull()).select(key).distinct().join(cache.select(key), key, "left_anti")
