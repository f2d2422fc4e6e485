"""Deterministic sampling, splitting and balancing: every draw is an order by a hash of the key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.stats import uniform


def order_key(key: Column | str, seed: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))


def per_stratum(df: DataFrame, strata: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each stratum, ranked by hash then key; planned with a partial limit per group."""
    order = Window.partitionBy(*strata).orderBy(order_key(key, seed), key)
    return df.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_rank")


def round_robin(df: DataFrame, group: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """One row of each group in turn until `total` rows: (.., round)."""
    order = Window.partitionBy(group).orderBy(order_key(key, seed), key)
    return df.withColumn("round", F.row_number().over(order)).orderBy("round", group).limit(total)


def weighted_draw(df: DataFrame, group: list[str], key: str, weight: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each group without replacement, in proportion to weight: smallest -ln(u) / w."""
    draw = -F.ln(uniform(F.col(key).cast("string"), F.lit(str(seed)))) / F.col(weight)
    order = Window.partitionBy(*group).orderBy(draw, key)
    return df.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= k)


def largest_remainder(sizes: DataFrame, size: str, key: str, total: int) -> DataFrame:
    """Quotas in proportion to size that add up to `total`: floors, then the largest remainders.

    sizes: one row a stratum, so the windows are over strata, not rows.
    """
    everything = Window.partitionBy(F.lit(0))
    exact = F.col(size) * F.lit(total) / F.sum(size).over(everything)
    df = sizes.withColumn("_floor", F.floor(exact)).withColumn("_rest", F.round(exact - F.floor(exact), 9))
    more = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), key)) <= F.lit(total) - F.sum("_floor").over(everything)
    return df.withColumn("quota", F.col("_floor") + more.cast("bigint")).drop("_floor", "_rest")


def shuffled_options(fact: Column, language: Column, options: list[Column], seed: int = 7) -> Column:
    """A row's options in an order that fact, language, option and seed decide."""
    pairs = F.array(*[F.struct(F.md5(F.concat_ws("|", fact, language, o, F.lit(str(seed)))).alias("h"), o.alias("o")) for o in options])
    return F.transform(F.array_sort(pairs), lambda p: p["o"])


def bootstrap_means(df: DataFrame, unit: str, value: str, model: str, n_boot: int, seed: int = 1) -> DataFrame:
    """(model, b, mean): resampled means with Poisson weights that unit and draw decide, shared by models.

    Each unit's weight in each draw comes from a hash, so no rows are gathered; the draws are combined
    within tasks before they are shuffled, n_boot rows a model.
    """
    draws = df.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = uniform(F.col(unit).cast("string"), F.col("b").cast("string"), F.lit(str(seed)))
    cuts = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
    weight = sum(((u > c).cast("int") for c in cuts), F.lit(0))
    w = draws.withColumn("_w", weight)
    return w.groupBy(model, "b").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("mean"))
