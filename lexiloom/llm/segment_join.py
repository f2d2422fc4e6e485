"""Similarity join of strings under an edit distance, by matching segments.

An evaluation string is cut into k + 1 even segments. At most k edits leave one of them whole, so every
training string within distance k holds it as a substring, at a position that the length difference and
the number of the segment bound. What remains of both strings once the segment is taken out is again
within k edits, so the remainder is cut and matched in the same way. A pair is a candidate only if both
levels match: a segment shared by a third of all strings then still splits by the thousands of
remainders behind it, and no group of one segment is ever paired within itself. Candidates are
verified by banded dynamic programming (`levenshtein` with a threshold, which fills only the band).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bounds(length: str, k: int, i: int) -> tuple[str, str]:
    """SQL for the 1-based start and the length of segment i of a string of this length, cut into k + 1."""
    short, longer = f"({length} div {k + 1})", f"({length} % {k + 1})"
    before = f"greatest(0, {i} - ({k + 1} - {longer}))"  # the last segments are one longer
    return f"({i} * {short} + {before} + 1)", f"({short} + if({i} >= {k + 1} - {longer}, 1, 0))"


def _level(df: DataFrame, k: int, deltas: range, first: bool) -> DataFrame:
    """One level of cutting: (text, rest, sig, delta) with one row for each segment and allowed position.

    delta is by how much the string is longer than the evaluation string it is to meet, 0 on that side.
    """
    found = []
    for delta in deltas:
        for i in range(k + 1):
            start, size = _bounds(f"(length(rest) - {delta})", k, i)
            for shift in range(max(-i, delta - (k - i)), min(i, delta + (k - i)) + 1) if len(deltas) > 1 else [0]:
                at = f"({start} + {shift})"
                fits = f"length(rest) >= {delta} and {at} >= 1 and {at} + {size} - 1 <= length(rest)" + ("" if first else f" and delta = {delta}")
                found.append(f"if({fits}, named_struct('i', {i}, 'delta', {delta}, 'at', {at}, 'size', {size}), null)")
    df = df.select("*", F.explode(F.array_compact(F.array(*map(F.expr, found)))).alias("c"))
    return df.select(
        "text", F.expr("c.delta").alias("delta"), F.expr("concat(substring(rest, 1, c.at - 1), substring(rest, c.at + c.size))").alias("rest"),
        F.expr("xxhash64(sig, c.i, length(rest) - c.delta, substring(rest, c.at, c.size))").alias("sig"),
    )


def _signatures(df: DataFrame, k: int, levels: int, deltas: range) -> DataFrame:
    df = df.select("text", F.col("text").alias("rest"), F.lit(0).alias("delta"), F.lit(0).cast("bigint").alias("sig"))
    for n in range(levels):
        df = _level(df, k, deltas, n == 0)
    return df.select("text", "sig")


def segment_join(evaluation: DataFrame, training: DataFrame, k: int, levels: int = 2) -> DataFrame:
    """(eval_text, train_text, distance): all pairs of distinct strings within k edits.

    Both inputs have a column `text`; null texts have no partner, repeated texts count once (a caller
    joins the classes of equal texts back to its rows), empty texts meet texts of up to k characters.
    """
    a = evaluation.select("text").where("text is not null").distinct()
    b = training.select("text").where("text is not null").distinct()
    a, b = _signatures(a, k, levels, range(1)), _signatures(b, k, levels, range(-k, k + 1))
    pairs = a.select("sig", F.col("text").alias("eval_text")).join(b.select("sig", F.col("text").alias("train_text")), "sig")
    banded: Column = F.levenshtein("eval_text", "train_text", k)
    return pairs.select("eval_text", "train_text", banded.alias("distance")).where(f"distance between 0 and {k}").distinct()
