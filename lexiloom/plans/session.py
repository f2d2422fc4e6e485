"""Session helpers: where lineage is cut, and how tables are read."""

from __future__ import annotations

import os
import tempfile

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most so many rows and bytes go to every task whole; beyond, both sides are shuffled by salted keys.
SMALL, SMALL_BYTES, SALT = 200_000, 64 << 20, 16


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the checkpoint folder that the cluster names, read back without its lineage.

    `spark.checkpoint.dir` is taken from the session. Where it is unset, a session on one machine, as in
    tests, uses a local folder; a session on a cluster, whose executors don't share one, fails.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "lexiloom-checkpoints"))
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, small: int = SMALL) -> bool:
    """Whether a table, which should be checkpointed or a plain scan, has at most `small` rows and SMALL_BYTES bytes."""
    size = F.octet_length(F.to_json(F.struct(*df.columns)))
    n, size = df.limit(small + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return n <= small and size <= SMALL_BYTES


def looked_up(rows: DataFrame, known: DataFrame, keys: Sequence[str], how: str = "inner", fits: bool | None = None) -> DataFrame:
    """rows joined with `known`, one row a key, on columns that may be hot in rows; how: inner, left, left_anti or left_semi.

    Where `known` is small (counted unless `fits` tells) it goes to all tasks and rows stay where they are. Beyond, each row draws one of SALT parts by a hash of all its columns and
    `known` is repeated in every part, so a key with a third of all rows is spread over SALT tasks.
    """
    if is_small(known) if fits is None else fits:
        return rows.join(F.broadcast(known), list(keys), how)
    parts = known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    drawn = rows.withColumn("_part", F.pmod(F.xxhash64(*[F.to_json(c) if t.startswith("map") else F.col(c) for c, t in rows.dtypes]), F.lit(SALT)).cast("int"))
    return drawn.join(parts, [*keys, "_part"], how).drop("_part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
