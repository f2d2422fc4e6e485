"""Order-dependent operators; every one takes an explicit ordinal."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Slices of an order; a group's rows are ranked slice by slice.
SLICES = 64


def range_slices(df: DataFrame, column: str, slices: int = SLICES) -> Column:
    """A column's slice, which grows with its value: about as many rows fall into each. One scan of that column."""
    at = df.agg(F.percentile_approx(column, [i / slices for i in range(1, slices)])).first()[0] or []  # slices - 1 numbers
    bounds = sorted(set(at))
    return sum(((F.col(column) > b).cast("int") for b in bounds), F.lit(0))


def hash_slices(column: Column) -> Column:
    """The slice of an md5 in hexadecimal, in its order."""
    return F.conv(F.substring(column, 1, 2), 16, 10).cast("int")


def in_order(df: DataFrame, group: list[str], order: list[str], slice_: Column, value: str | None = None) -> DataFrame:
    """(.., _nth, _before): each row's 1-based place in its group's order, and the sum of `value` over the rows before it.

    `slice_` must not fall while the order rises. Rows are ranked within (group, slice), and what the slices before
    them hold is added, so no task holds a hot group. Null groups are one group.
    """
    keys = [F.struct(F.lit(0), *group).alias("_g")] if group else [F.lit(0).alias("_g")]
    x = df.withColumn("_slice", slice_).select("*", *keys)
    size = F.sum(value) if value else F.lit(0)
    per = x.groupBy("_g", "_slice").agg(F.count(F.lit(1)).alias("_c"), F.coalesce(size, F.lit(0)).alias("_s"))
    upto = Window.partitionBy("_g").orderBy("_slice")  # at most a row a slice
    per = per.select(F.to_json("_g").alias("_k") if group else F.lit("").alias("_k"), F.col("_slice").alias("_i"), (F.sum("_c").over(upto) - F.col("_c")).alias("_c0"), (F.sum("_s").over(upto) - F.col("_s")).alias("_s0"))
    w = Window.partitionBy("_g", "_slice").orderBy(*order)
    own = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value) if value else F.lit(0)
    x = x.withColumn("_r", F.row_number().over(w)).withColumn("_b", own).withColumn("_k", F.to_json("_g") if group else F.lit(""))
    x = x.join(per, (x["_k"] == per["_k"]) & (x["_slice"] == per["_i"]))
    return x.select(*[x[c] for c in df.columns], (F.col("_r") + F.col("_c0")).alias("_nth"), (F.col("_b") + F.col("_s0")).alias("_before"))


def budget_cut(df: DataFrame, group: list[str], order: list[str], size: str, budget: int, slice_: Column) -> DataFrame:
    """Rows of each group in order while what came before them is under the budget; the row that crosses it stays."""
    return in_order(df, group, order, slice_, size).where(F.col("_before") < budget).drop("_before", "_nth")


def first_occurrence(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; one row a key and task is shuffled, so a hot key is no hot task."""
    rest = [c for c in df.columns if c not in order]
    best = F.min(F.struct(*order, *rest))
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(best.alias("_b")).select("_b.*").select(*df.columns)


def parts(df: DataFrame, group: list[str], order: list[str], n: int, keep_last: bool, slice_: Column) -> DataFrame:
    """Runs of n consecutive rows: (.., part); the last, shorter one is kept or dropped."""
    df = in_order(df, group, order, slice_).withColumn("part", F.floor((F.col("_nth") - 1) / n)).drop("_nth", "_before")
    if keep_last:
        return df
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group, "part"))).where(F.col("_n") == n).drop("_n")


def zscores(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Each value's distance to its group's mean in population deviations (plus 1e-6): (.., z)."""
    stats = df.groupBy(*group).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    on = F.lit(True)
    s = stats.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_mean", "_sd")
    for i, g in enumerate(group):
        on = on & df[g].eqNullSafe(s[f"_g{i}"])
    return df.join(s, on).withColumn("z", (F.col(value) - F.col("_mean")) / (F.col("_sd") + 1e-6)).drop("_mean", "_sd", *[f"_g{i}" for i in range(len(group))])


def pack(df: DataFrame, group: str, order: str, text: str, budget: int) -> DataFrame:
    """Greedy packing of each group's texts, in order, into chunks of at most `budget` estimated tokens.

    (group, chunk, text, n_texts, n_tokens). A text over the budget is a chunk of its own; null and blank
    texts are left out; chunks never cross groups. The chunk that a text opens depends on all before it,
    which no window expresses, so each group is packed in one pass over its rows in order: rows are
    partitioned by group and sorted, and a group streams through its task without being gathered. The longest
    task is that of the largest group; its memory is one batch and one chunk.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        held: list[str] = []
        size = chunk = 0

        def flush():
            return (state, chunk, "\n".join(held), len(held), size)

        for b in batches:
            out = []
            for g, t in zip(b["g"], b["t"]):
                n = len(t) // 4
                if g != state:
                    if held:
                        out.append(flush())
                    state, held, size, chunk = g, [], 0, 0
                elif held and size + n > budget:
                    out.append(flush())
                    held, size, chunk = [], 0, chunk + 1
                held.append(t)
                size += n
            yield pd.DataFrame(out, columns=["g", "chunk", "text", "n_texts", "n_tokens"])
        if held:
            yield pd.DataFrame([flush()], columns=["g", "chunk", "text", "n_texts", "n_tokens"])

    rows = df.select(F.col(group).cast("string").alias("g"), F.col(order).alias("o"), F.col(text).alias("t")).where("g is not null and trim(t) <> ''")
    rows = rows.repartition("g").sortWithinPartitions("g", "o").select("g", "t")
    return rows.mapInPandas(run, "g string, chunk long, text string, n_texts long, n_tokens long").withColumnRenamed("g", group)
