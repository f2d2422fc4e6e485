"""What a row of the fact table states, however its ids are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.ids import read_fact_id, read_id
from lexiloom.operators.redirects import follow, resolve_redirects


def stated_facts(parallel: DataFrame, redirects: DataFrame, *keep: str) -> DataFrame:
    """(row_id, *keep, s, p, o): each row's subject, property and object id.

    A column that is null or unreadable gives way to its part of `fact_id`; where both tell, the column
    counts. Redirects of subjects and objects are followed to their end. A part that neither tells is
    null.
    """
    s, p, o = read_fact_id(F.col("fact_id"))
    rows = parallel.select(
        "row_id", *keep, F.coalesce(read_id(F.col("subject_id"), "Q"), s).alias("s"),
        F.coalesce(read_id(F.col("property_id"), "P"), p).alias("p"), F.coalesce(read_id(F.col("object_id"), "Q"), o).alias("o"),
    )
    resolved = resolve_redirects(redirects, read_id(F.col("old_id"), "Q"), read_id(F.col("new_id"), "Q"))
    return follow(follow(rows, "s", resolved), "o", resolved)
