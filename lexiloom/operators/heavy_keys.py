"""Results per key where a few keys hold most rows.

Every result is an algebraic aggregate: tasks combine their own rows per key first (a bounded hash map
that spills), and only one partial state per key and task is shuffled, so a key with a third of all
rows costs its reducer no more than any other. Distinct counts are taken in two steps, first on
(key, value), which spreads a heavy key over all reducers, then on the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field_name, key_value, n): rows per value of each field, nulls as a value, from one scan."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("key_value")) for f in fields])).alias("c"))
    return cells.select("c.*").groupBy("field_name", "key_value").agg(F.count(F.lit(1)).alias("n"))


def heavy_keys(df: DataFrame, fields: list[str], share: float) -> DataFrame:
    """(field_name, key_value): non-null values that hold more than `share` of all rows.

    The values are taken as stored; null rows count towards all rows. An empty table has none.
    """
    n = key_counts(df, fields)
    total = n.groupBy("field_name").agg(F.sum("n").alias("total"))
    return (
        n.where(F.col("key_value").isNotNull()).join(F.broadcast(total), "field_name")  # one row a field
        .where(F.col("n") > F.col("total") * share).select("field_name", "key_value")
    )


def key_profile(df: DataFrame, key: str, member: str, split: str, splits: tuple[str, ...]) -> DataFrame:
    """Per key (null is one): rows, distinct non-null members, and rows in each of the given splits.

    The first aggregation groups by (key, member), so a heavy key is spread by its members; a member
    that itself is heavy is one partial row per task. The second adds those rows up per key.
    """
    by_member = df.groupBy(F.col(key).alias("key_value"), F.col(member).alias("_member")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(split) == s).alias(f"_n_{s}") for s in splits]
    )
    return by_member.groupBy("key_value").agg(
        F.sum("_n").alias("n_facts"), F.count("_member").alias("n_subjects"), *[F.sum(f"_n_{s}").alias(f"n_{s}") for s in splits]
    )
