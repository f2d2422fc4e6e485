"""Exhaustive nearest neighbours of a query set, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Queries that go to all tasks at a time.
BLOCK = 20_000


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(key, nearest, sim): for each query the other row of largest cosine (the smaller id on a tie).

    Queries go out in blocks of a bounded size; each task multiplies its rows with a block and gives one
    candidate a query and batch, so what is shuffled doesn't grow with the pairs. Null and zero vectors
    match nothing.
    """
    spark = rows.sparkSession
    n = max(1, -(-queries.count() // block))
    found = None
    for i in range(n):
        held = queries.where(F.pmod(F.xxhash64(key), F.lit(n)) == i).where(F.col(vector).isNotNull()).select(key, vector).collect()
        if not held:
            continue
        q = np.array([r[1] for r in held], dtype=np.float64)
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in held]), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))

        def best(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            for b in batches:
                b = b[b["v"].notna()]
                if not len(b):
                    continue
                m = np.stack(b["v"].to_numpy()).astype(np.float64)
                size = np.linalg.norm(m, axis=1, keepdims=True)
                sim = np.round(q @ (m / np.maximum(size, 1e-300)).T, 6)
                k = b["k"].to_numpy()
                sim[ids[:, None] == k[None, :]] = -np.inf
                sim[:, size[:, 0] == 0] = -np.inf
                order = np.argsort(k, kind="stable")
                at = order[np.argmax(sim[:, order], axis=1)]
                s = sim[np.arange(len(ids)), at]
                ok = np.isfinite(s)
                yield pd.DataFrame({"key": ids[ok], "nearest": k[at][ok], "sim": s[ok]})

        here = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(best, "key long, nearest long, sim double")
        found = here if found is None else found.union(here)
    if found is None:
        return spark.createDataFrame([], f"{key} long, nearest long, sim double")
    top = found.groupBy("key").agg(F.max(F.struct("sim", (-F.col("nearest")).alias("m"))).alias("t"))
    return top.select(F.col("key").alias(key), (-F.col("t.m")).alias("nearest"), F.col("t.sim").alias("sim"))
