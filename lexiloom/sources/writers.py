"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_release(df: DataFrame, path: str, by: tuple[str, ...] = ("language", "split"), files: int = 1) -> None:
    """Parquet in one folder per combination of `by`; each is written by `files` tasks, however hot."""
    spread = F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(files))
    df.repartition(*by, spread).write.mode("overwrite").option("compression", "snappy").partitionBy(*by).parquet(path)


def write_jsonl(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).json(path)


def write_worksheets(df: DataFrame, path: str, by: str, order: list[str], n: int) -> DataFrame:
    """Numbered parts of n rows for each value of `by`; gives the manifest (by, part, n)."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    df = df.withColumn("part", F.floor((at - 1) / n))
    df.repartition(by, "part").write.mode("overwrite").partitionBy(by, "part").json(path)
    return df.groupBy(by, "part").agg(F.count(F.lit(1)).alias("n"))


def _cell(x) -> str:
    return "" if x is None else f"{x:.2f}" if isinstance(x, float) else str(x).replace("|", "\\|")


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report of at most `most` rows as a markdown table; more rows raise."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(_cell, r)) + " |" for r in rows]) + "\n"


def latex_table(df: DataFrame, key: str, most: int = 1000) -> str:
    """A report of at most `most` rows as LaTeX rows; more rows raise. The largest number of each column is bold, the second underlined."""
    rows = [r.asDict() for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    out = []
    for r in rows:
        cells = [str(r[key])]
        for c in df.columns:
            if c == key:
                continue
            ranked = sorted({x[c] for x in rows if x[c] is not None}, reverse=True)
            text = _cell(r[c])
            cells.append(rf"\textbf{{{text}}}" if ranked[:1] == [r[c]] else rf"\underline{{{text}}}" if ranked[1:2] == [r[c]] else text)
        out.append(" & ".join(cells) + r" \\")
    return "\n".join(out) + "\n"


def summary(df: DataFrame, bulky: tuple[str, ...]) -> DataFrame:
    """A result without its bulky columns."""
    return df.drop(*bulky)


def write_sidecar(df: DataFrame, path: str, **facts: str) -> None:
    """A one-row JSON report beside a table: its rows, columns and whatever else is stated."""
    stated = [F.lit(v).alias(k) for k, v in sorted(facts.items())]
    df.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.array(*map(F.lit, df.columns)).alias("columns"), *stated).coalesce(1).write.mode("overwrite").json(path)


def write_whole(df: DataFrame, path: str) -> None:
    """Parquet that readers see whole or not at all: written beside `path`, then renamed in its place."""
    spark = df.sparkSession
    jvm = spark._jvm
    part, final = jvm.org.apache.hadoop.fs.Path(path + ".part"), jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path + ".part")
    fs.delete(final, True)
    if not fs.rename(part, final):
        raise OSError(f"{path} could not be put in place")
