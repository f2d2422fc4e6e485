"""Redirect chains resolved to their last target by pointer doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.session import checkpointed


def resolve_redirects(redirects: DataFrame, old: Column, new: Column) -> DataFrame:
    """(old_key, new_key): each redirected id and the id at the end of its chain.

    Each round replaces a target by the target's own target, so a chain of n hops takes about log2(n)
    rounds. Rows with a null id and self-redirects are left out; where an id has several targets the
    smallest counts. Ids on or leading into a cycle have no last target and are left out, so they keep
    naming themselves; the loop sees them because a round no longer settles anything.
    """
    edges = (
        redirects.select(old.alias("old_key"), new.alias("new_key"))
        .where("old_key is not null and new_key is not null and old_key <> new_key")
        .groupBy("old_key").agg(F.min("new_key").alias("new_key"))
    )
    edges = checkpointed(edges.withColumn("open", F.lit(True)))
    open_before = None
    while True:
        step = edges.select(F.col("old_key").alias("via"), F.col("new_key").alias("next"))
        edges = checkpointed(
            edges.join(step, F.col("new_key") == F.col("via"), "left")
            .select("old_key", F.coalesce("next", "new_key").alias("new_key"), F.col("next").isNotNull().alias("open"))
        )
        left = edges.where("open").count()
        if not left or left == open_before:
            return edges.where("not open").select("old_key", "new_key")
        open_before = left


def follow(df: DataFrame, column: str, resolved: DataFrame) -> DataFrame:
    """df with the ids in a column replaced by what they were redirected to."""
    r = resolved.select(F.col("old_key").alias("_old"), F.col("new_key").alias("_new"))
    return df.join(r, df[column] == r["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
