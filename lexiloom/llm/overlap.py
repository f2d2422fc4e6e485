"""Problem 1: facts of validation and test rows that also stand in training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.facts import stated_facts
from lexiloom.llm.segment_join import segment_join
from lexiloom.plans.session import checkpointed

#: Edits between two written facts that the join tolerates; the exact check then decides.
EDITS = 1


def cross_split_overlaps(parallel: DataFrame, redirects: DataFrame, k: int = EDITS) -> DataFrame:
    """(eval_row, train_row, split, source): rows outside train and rows of train that state one fact.

    The facts of both sides, written in one way, meet in a segment join within k edits over the distinct
    facts; of the pairs found, those at distance 0 state the same fact (one digit more or less names
    another entity). Equal facts are one class in the join and are expanded to row pairs only in the
    result. Rows that lack a part of the fact, or the split, have no partner; empty tables give no rows.
    """
    rows = stated_facts(parallel, redirects, "split", "source").where("s is not null and p is not null and o is not null")
    rows = rows.select("row_id", "split", "source", F.concat_ws("|", "s", "p", "o").alias("text"))
    train, held = rows.where("split = 'train'"), rows.where("split in ('validation', 'test')")
    near = checkpointed(segment_join(held, train, k))  # else the optimiser would make the exact check a key of the join
    same = near.where("distance = 0 and eval_text = train_text").select(F.col("eval_text").alias("text"))
    held = held.join(same, "text").select("text", F.col("row_id").alias("eval_row"), "split", "source")
    return held.join(train.select("text", F.col("row_id").alias("train_row")), "text").drop("text")


def p1_found(parallel: DataFrame, redirects: DataFrame) -> DataFrame:
    """(row_a, row_b): overlapping rows, the smaller id first."""
    return cross_split_overlaps(parallel, redirects).select(F.least("eval_row", "train_row").alias("row_a"), F.greatest("eval_row", "train_row").alias("row_b"))


def p1_report(parallel: DataFrame, redirects: DataFrame) -> DataFrame:
    """(split, source, n_rows, n_leaked, n_pairs) of the rows outside train; null sources are one source."""
    hits = cross_split_overlaps(parallel, redirects).groupBy("eval_row").agg(F.count(F.lit(1)).alias("pairs"))
    rows = parallel.where("split in ('validation', 'test')").select("row_id", "split", "source")
    return (
        rows.join(hits, rows.row_id == hits.eval_row, "left").groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count("eval_row").alias("n_leaked"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("n_pairs"))
    )
