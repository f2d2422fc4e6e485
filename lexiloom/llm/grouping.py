"""Problem 5: groups of rows that name the same subject, and splits that keep them together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions.ids import read_fact_id, read_id
from lexiloom.plans.session import checkpointed, looked_up

SPLITS = ("train", "validation", "test")
SHARES = (0.8, 0.1, 0.1)
#: Groups above this share of all rows are placed one by one; there are at most 1 / HEAVY of them.
HEAVY = 0.0002
#: While they are placed, the largest relations count one by one and all others together, so that the driver
#: holds at most OWN + 1 numbers a heavy group; every relation's light groups then make up for what they took.
OWN = 255
#: Parts in which the light groups of a stratum are ranked.
PARTS = 64


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected component.

    edges: (a, b) with null and equal ends ignored. The graph is read as bipartite: an edge is a record,
    its ends are its entities. Each round gives every record the smallest label of its entities and every
    entity the smallest label of its records, then lets each label jump to its own label, so long chains
    need about log(length) rounds. Labels per entity are combined within tasks before they are shuffled;
    an entity with many records is one row in every join. Each round is written to the shared folder.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    e = checkpointed(e.distinct())
    ends = e.select("a", "b").union(e.select("b", "a"))
    labels = checkpointed(ends.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        of_b = ends.join(labels, ends.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        nearer = labels.join(of_b, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        via = nearer.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = checkpointed(nearer.join(via, "label").select("node", F.least("label", "far").alias("label"), (F.least("label", "far") != F.col("was")).alias("moved")))
        if labels.where("moved").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def subject_groups(parallel: DataFrame, redirects: DataFrame, *keep: str) -> DataFrame:
    """(row_id, *keep, group_id): rows that name one subject, in the column or in fact_id, along chains.

    A redirect ties the old id to the new one, which gives the same groups as following it. A row that
    names no subject is a group of its own, whose id is `row:` and its row_id.
    """
    in_fact, _, _ = read_fact_id(F.col("fact_id"))
    rows = parallel.select("row_id", *keep, read_id(F.col("subject_id"), "Q").alias("a"), in_fact.alias("b"))
    merged = redirects.select(read_id(F.col("old_id"), "Q").alias("a"), read_id(F.col("new_id"), "Q").alias("b"))
    found = components(rows.select("a", "b").union(merged))
    rows = rows.withColumn("node", F.coalesce("a", "b")).drop("a", "b")
    return rows.join(found, "node", "left").select("row_id", *keep, F.coalesce("label", "node", F.concat(F.lit("row:"), "row_id")).alias("group_id"))


def p5_found(parallel: DataFrame, redirects: DataFrame) -> DataFrame:
    """(row_a, row_b): the smallest row of each group of two or more, with each other row of it.

    The smallest row comes from an aggregate that is combined within tasks; only one row a group is
    looked up, with salted keys where there are many groups, so a group with a third of all rows is spread.
    """
    rows = checkpointed(subject_groups(parallel, redirects))
    first = checkpointed(rows.groupBy("group_id").agg(F.min("row_id").alias("row_a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    return looked_up(rows, first, ["group_id"]).where("row_id <> row_a").select("row_a", F.col("row_id").alias("row_b"))


def _placed(made: list, target: dict[int, list[float]], n_splits: int) -> dict[str, int]:
    """The split of each heavy group, largest first: where the squared deviation of its relations grows least."""
    have = {r: [0.0] * n_splits for r in target}
    makes: dict[str, list] = {}
    for g, r, n in made:
        makes.setdefault(g, []).append((r, n))
    placed = {}
    for g in sorted(makes, key=lambda g: (-sum(n for _, n in makes[g]), g)):
        def cost(i: int, make=makes[g]) -> float:
            return sum(((have[r][i] + n - target[r][i]) ** 2 - (have[r][i] - target[r][i]) ** 2) / max(1.0, target[r][i]) for r, n in make)
        placed[g] = min(range(n_splits), key=lambda i: (cost(i), i))
        for r, n in makes[g]:
            have[r][placed[g]] += n
    return placed


def grouped_splits(rows: DataFrame, shares: Sequence[float] = SHARES, splits: Sequence[str] = SPLITS, heavy_share: float = HEAVY) -> DataFrame:
    """(group_id, new_split): each group whole in one split, shares near `shares` overall and per relation.

    rows: (group_id, relation). Groups above `heavy_share` of all rows are placed one by one, largest first,
    each in the split where the squared deviation from the target counts of its relations grows least. What
    they took is subtracted from each relation's shares. The light groups are ordered within their stratum
    (main relation, then make-up, that is how many rows of which relations) and take their place in a
    golden-ratio sequence, whose every stretch falls into the shares evenly, so all make-ups, and with them
    all relations of groups that span several, are split evenly. Ranks are counted in parts whose
    sizes are added up, so no task ranks a whole stratum. Null relations are one relation; no rows give none.
    """
    spark = rows.sparkSession
    counts = checkpointed(rows.groupBy("group_id", F.coalesce("relation", F.lit("")).alias("relation")).agg(F.count(F.lit(1)).alias("n")))
    groups = checkpointed(counts.groupBy("group_id").agg(F.sum("n").alias("size"), F.expr("bit_xor(xxhash64(relation, n))").alias("kind"), F.max_by("relation", F.struct("n", "relation")).alias("stratum")))
    per = checkpointed(counts.groupBy("relation").agg(F.sum("n").alias("total")))
    total = per.agg(F.sum("total")).first()[0] or 0
    limit = max(1, heavy_share * total)
    heavy = groups.where(F.col("size") > limit).select("group_id")  # at most 1 / heavy_share rows
    own = spark.createDataFrame([(r["relation"], i) for i, r in enumerate(per.orderBy(F.desc("total"), "relation").limit(OWN).collect())], "relation string, r int")
    numbered = lambda df: df.join(F.broadcast(own), "relation", "left").withColumn("r", F.coalesce("r", F.lit(OWN)))
    target = {r["r"]: [s * r["n"] for s in shares] for r in numbered(per).groupBy("r").agg(F.sum("total").alias("n")).collect()}  # OWN + 1 rows
    taken = checkpointed(counts.join(F.broadcast(heavy), "group_id", "left_semi"))
    made = numbered(taken).groupBy("group_id", "r").agg(F.sum("n").alias("n")).collect()  # at most (OWN + 1) / heavy_share rows
    placed = _placed([tuple(r) for r in made], target, len(shares))
    done = spark.createDataFrame(list(placed.items()), "group_id string, at int")
    have = taken.join(F.broadcast(done), "group_id").groupBy("relation").agg(*[F.sum(F.when(F.col("at") == i, F.col("n")).otherwise(0)).alias(f"h{i}") for i in range(len(shares))])
    left = [F.greatest(F.lit(0.0), F.col("total") * s - F.coalesce(f"h{i}", F.lit(0))) for i, s in enumerate(shares)]
    every = sum(left[1:], left[0])
    edges = [F.when(every > 0, sum(left[1 : i + 1], left[0]) / every).otherwise(float(sum(shares[: i + 1]))) for i in range(len(shares) - 1)]
    cut = checkpointed(per.join(have, "relation", "left").select(F.col("relation").alias("stratum"), F.array(*edges).alias("edges")))

    light = groups.where(F.col("size") <= limit).withColumn("part", F.pmod("kind", F.lit(PARTS)) * PARTS + F.pmod(F.xxhash64("group_id"), F.lit(PARTS)))
    sizes = light.groupBy("stratum", "part").agg(F.count(F.lit(1)).alias("c"))
    sizes = checkpointed(sizes.select("stratum", "part", (F.sum("c").over(Window.partitionBy("stratum").orderBy("part")) - F.col("c")).alias("before")))
    rank = F.row_number().over(Window.partitionBy("stratum", "part").orderBy("kind", "group_id"))
    ranked = looked_up(looked_up(light.withColumn("rank", rank), sizes, ["stratum", "part"]), cut, ["stratum"])
    at = (F.col("rank") + F.col("before")) * F.lit(0.6180339887498949)
    which = F.size(F.filter("edges", lambda e: e <= at - F.floor(at)))
    name = lambda i: F.element_at(F.array(*[F.lit(s) for s in splits]), i + 1)
    return done.select("group_id", name(F.col("at")).alias("new_split")).union(ranked.select("group_id", name(which).alias("new_split")))


def _with_groups(parallel: DataFrame, redirects: DataFrame) -> DataFrame:
    return checkpointed(subject_groups(parallel, redirects, "relation").withColumn("relation", F.lower(F.trim(F.translate("relation", "_", " ")))))


def p5_splits(parallel: DataFrame, redirects: DataFrame) -> DataFrame:
    """(row_id, group_id, new_split) of every row."""
    rows = _with_groups(parallel, redirects)
    return looked_up(rows.select("row_id", "group_id"), checkpointed(grouped_splits(rows)), ["group_id"]).select("row_id", "group_id", "new_split")


def p5_balance(parallel: DataFrame, redirects: DataFrame, shares: Sequence[float] = SHARES, splits: Sequence[str] = SPLITS) -> DataFrame:
    """(relation, new_split, n_rows, share, deviation): how the new splits fall within each relation (null is one),
    and over all rows (relation `*`); deviation is the share less the one asked for, and 0 rows count too."""
    rows = _with_groups(parallel, redirects)
    n = looked_up(rows.select("relation", "group_id"), checkpointed(grouped_splits(rows, shares, splits)), ["group_id"])
    n = n.groupBy("relation").agg(*[F.count_if(F.col("new_split") == s).alias(f"n{i}") for i, s in enumerate(splits)])
    n = n.union(n.agg(F.lit("*"), *[F.sum(f"n{i}") for i in range(len(splits))]).where("sum(n0) is not null"))
    each = F.array(*[F.struct(F.lit(s).alias("new_split"), F.col(f"n{i}").alias("n_rows"), F.lit(float(shares[i])).alias("asked")) for i, s in enumerate(splits)])
    n = n.select("relation", sum((F.col(f"n{i}") for i in range(1, len(splits))), F.col("n0")).alias("total"), F.inline(each))
    share = F.col("n_rows") / F.col("total")
    return n.select("relation", "new_split", "n_rows", F.round(share, 4).alias("share"), F.round(share - F.col("asked"), 4).alias("deviation"))
