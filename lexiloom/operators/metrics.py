"""Cross-lingual metrics over predictions: (fact, language, options, scores)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.stats import argmax, rank_consistency, ranks

SENTINEL = -1e8


def length_normalised(total: Column, tokens: Column, text: Column, mode: str) -> Column:
    """A candidate's score by mode: sum, avg, char or byte; a sentinel stays below every score."""
    by = {"sum": F.lit(1), "avg": F.greatest(F.lit(1), tokens), "char": F.greatest(F.lit(1), F.length(text)), "byte": F.greatest(F.lit(1), F.octet_length(text))}[mode]
    return F.when(total <= SENTINEL, F.lit(-1e9)).otherwise(total / by)


def judged(predictions: DataFrame, ids: str, scores: str, gold: str) -> DataFrame:
    """(.., pred, correct, ranking): the best option, whether it is the gold one, entities by score."""
    p = predictions.withColumn("pred", F.get(F.col(ids), argmax(F.col(scores)).cast("int")))
    return p.withColumn("correct", F.col("pred") == F.col(gold)).withColumn("ranking", F.transform(ranks(F.col(scores)), lambda i: F.get(F.col(ids), i)))


def consistency(judged_: DataFrame, fact: str, language: str, n_languages: int) -> DataFrame:
    """(k, n_facts): facts with all languages by how many of them are right; k = n is total consistency."""
    f = judged_.groupBy(fact).agg(F.countDistinct(language).alias("n"), F.count_if("correct").alias("k")).where(F.col("n") == n_languages)
    return f.groupBy("k").agg(F.count(F.lit(1)).alias("n_facts"))


def complete_consistency(judged_: DataFrame, fact: str, language: str, languages: tuple[str, ...]) -> DataFrame:
    """(k, n_facts): facts judged in every one of `languages`, whatever others they have, by how many of these are right.

    A row without a gold entity can't be judged: its language counts as missing.
    """
    rows = judged_.where(F.col(language).isin(*languages) & F.col("correct").isNotNull())
    return consistency(rows, fact, language, len(set(languages)))


def pairwise(judged_: DataFrame, fact: str, language: str) -> DataFrame:
    """(lang_a, lang_b, rank_consistency, agreement, n): means over the facts that both languages have.

    A fact's languages, a dozen at most, are gathered and paired within its row, which spares a self join.
    """
    per = judged_.groupBy(fact).agg(F.array_sort(F.collect_list(F.struct(F.col(language).alias("l"), "ranking", "pred"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 2, 64), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    p = per.select(F.explode(pairs).alias("p")).select("p.*")
    same = (F.col("a.pred") == F.col("b.pred")).cast("double")
    return p.groupBy(F.col("a.l").alias("lang_a"), F.col("b.l").alias("lang_b")).agg(F.avg(rank_consistency(F.col("a.ranking"), F.col("b.ranking"))).alias("rank_consistency"), F.avg(same).alias("agreement"), F.count(F.lit(1)).alias("n"))


def agreement_kinds(judged_: DataFrame, fact: str) -> DataFrame:
    """(kind, n_facts): all languages right, all on one wrong entity, or divided."""
    f = judged_.groupBy(fact).agg(F.countDistinct("pred").alias("d"), F.bool_and("correct").alias("all_right"))
    kind = F.when(F.col("all_right"), "all correct").when(F.col("d") == 1, "agree wrong").otherwise("disagree")
    return f.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_facts"))


def bonus(k: Column, n: Column, shape: str, power: float = 2.0, ladder: tuple[tuple[float, float], ...] = ()) -> Column:
    """A group's consistency bonus for k of n right: all or nothing, a power of the share, or a ladder's step."""
    share = k / n
    if shape == "all":
        return F.when(k == n, F.lit(1.0)).otherwise(F.lit(0.0))
    if shape == "power":
        return F.pow(share, F.lit(power))
    return F.coalesce(*[F.when(share >= at, F.lit(b)) for at, b in sorted(ladder, reverse=True)], F.lit(0.0))
