"""How far the new splits are from the shares asked for, wherever the line between heavy and light groups is drawn."""

import random

import pytest

from lexiloom.llm import grouping


@pytest.mark.parametrize("heavy", [0.0002, 0.002, 0.02])
def test_deviation_is_bounded(spark, heavy):
    rng = random.Random(9)
    rows = []
    for g in range(3000):
        size = min(300, int(rng.paretovariate(1.2)))
        for _ in range(size):
            rows.append((f"g{g}", rng.choice(["a"] * 6 + ["b"] * 3 + ["c", None])))
    rows += [("hot", "a")] * (len(rows) // 8)
    df = spark.createDataFrame(rows, "group_id string, relation string")
    new = {r.group_id: r.new_split for r in grouping.grouped_splits(df, heavy_share=heavy).collect()}
    assert len(new) == len({g for g, _ in rows})
    for relation in ("a", "b", "c", None):
        own = [new[g] for g, x in rows if x == relation]
        for split, share in zip(grouping.SPLITS, grouping.SHARES):
            assert own.count(split) / len(own) == pytest.approx(share, abs=0.03)


def test_every_relation_is_balanced_however_many(spark):
    rows = [(f"g{i % 4000}", f"r{i % 400}") for i in range(12_000)]  # more relations than are counted one by one
    new = {r.group_id: r.new_split for r in grouping.grouped_splits(spark.createDataFrame(rows, "group_id string, relation string")).collect()}
    for relation in ("r0", "r123", "r399"):
        own = [new[g] for g, x in rows if x == relation]
        assert own.count("train") / len(own) == pytest.approx(0.8, abs=0.2) and len(set(own)) > 1
