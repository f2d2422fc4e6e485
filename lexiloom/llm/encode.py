"""Problem 6: every text as the token ids of a public byte-level BPE."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.plans.session import checkpointed

#: Where the public vocabulary files lie; only the driver reads them.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS_DIR", "/opt/tokenizers")
#: Fixed value: the pre-tokenisation pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a chunk, and of the overlap on its right. Texts up to CHUNK are one piece.
CHUNK, OVERLAP = 16_384, 512
#: Boundaries so near to a cut are not trusted: the pattern looks at most three characters ahead.
NEAR_END = 4


@lru_cache(maxsize=2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines())
    return tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def decode(ids: list[int], ranks: bytes) -> str:
    """The text behind ids: their raw bytes one after the other."""
    e = _encoding(ranks)
    return b"".join(map(e.decode_single_token_bytes, ids)).decode("utf-8")


def load_ranks(folder: str | None = None, name: str = "byte_bpe_50k.tiktoken") -> bytes:
    """The vocabulary file; its size is fixed, under a megabyte."""
    with open(os.path.join(folder or TOKENIZERS, name), "rb") as f:
        return f.read()


def _boundaries(text: str) -> list[int]:
    import regex

    return [m.start() for m in regex.finditer(PATTERN, text)]


def encode_texts(documents: DataFrame, key: str = "doc_id", text: str = "text", ranks: bytes | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids): one row for each row; null and empty texts give an empty list.

    Texts up to `chunk` characters are encoded where they are read. A longer text is cut into overlapping
    chunks that spread over tasks. Each chunk is pre-tokenised on its own; within the overlap of two
    chunks the first boundary that both have is where they resynchronise, because what follows a
    boundary depends only on the text behind it. Boundaries behind white space don't count, as the pattern
    would take a run of it for one pre-token if the piece ended there. The pieces between such points are encoded in parallel
    and their ids put together in order. Where two chunks share no boundary (one pre-token is longer
    than the overlap), the text is one piece across that cut: neighbouring chunks are joined there. A
    text is walked once to cut it, and each piece comes out of the chunk that it lies in.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(ranks or load_ranks())

    @F.pandas_udf("array<int>")
    def ids_of(texts: pd.Series) -> pd.Series:
        return pd.Series(_encoding(shared.value).encode_ordinary_batch(texts.fillna("").tolist(), num_threads=1), index=texts.index)

    @F.pandas_udf("struct<head:array<int>,tail:array<int>>")
    def zones(texts: pd.Series, at: pd.Series, last: pd.Series) -> pd.DataFrame:
        """Boundaries, as positions in the whole text, in the overlap with the chunk before and after."""
        heads, tails = [], []
        for t, a, end in zip(texts, at, last):
            b = _boundaries(t)
            sure = [x for x in b if x and not t[x - 1].isspace() and (end or x <= len(t) - NEAR_END)]
            heads.append([x + a for x in sure if x < overlap])
            tails.append([x + a for x in sure if x >= chunk])
        return pd.DataFrame({"head": heads, "tail": tails})

    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    short = rows.where(f"t is null or length(t) <= {chunk}").select(F.col("k").alias(key), ids_of("t").alias("ids"))
    long = rows.where(f"length(t) > {chunk}").select("k", F.monotonically_increasing_id().alias("u"), F.explode(F.array(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))).alias("c"))
    ahead = F.transform("c", lambda c, i: F.concat(c, F.coalesce(F.substring(F.get("c", i + 1), 1, overlap), F.lit(""))))
    cuts = long.select("k", "u", F.size("c").alias("n"), F.posexplode(ahead).alias("i", "c")).withColumn("at", F.col("i") * chunk)
    cuts = checkpointed(cuts.repartition("u", "i"))  # after this a text's number no longer changes
    told = cuts.select("u", "i", "at", zones("c", "at", F.col("i") + 1 == F.col("n")).alias("z"), "n")
    order = Window.partitionBy("u").orderBy("i")
    sync = F.array_min(F.array_intersect(F.lag("z.tail").over(order), F.col("z.head")))  # positions at + 0 .. at + overlap
    told = told.select("u", "i", "at", "n", F.when(F.col("i") == 0, F.lit(0)).otherwise(sync).alias("sync"))
    told = told.select("u", "i", "at", "sync", F.lead("sync").over(order).alias("next"), (F.col("i") + 1 == F.col("n")).alias("last"), F.count("sync").over(order).alias("piece"))
    begin = F.coalesce(F.col("sync") - F.col("at"), F.lit(0))
    stop = F.when(F.col("last"), F.lit(chunk + overlap)).otherwise(F.coalesce(F.col("next") - F.col("at"), F.lit(chunk)))
    alone = F.col("sync").isNotNull() & (F.col("last") | F.col("next").isNotNull())
    parts = cuts.select("k", "u", "i", "c").join(told.select("u", "i", "piece", alone.alias("alone"), (begin + 1).alias("from"), (stop - begin).alias("len")), ["u", "i"])
    parts = parts.select("k", "u", "i", "piece", "alone", F.expr("substring(c, from, len)").alias("p"))
    joined = parts.where("not alone").groupBy("u", "piece").agg(F.first("k").alias("k"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda x: x["p"]), "").alias("p"))
    pieces = parts.where("alone").select("k", "u", "piece", "p").union(joined.select("k", "u", "piece", "p"))
    pieces = pieces.select("k", "u", "piece", ids_of("p").alias("ids"))
    whole = pieces.groupBy("u").agg(F.first("k").alias(key), F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    return short.union(whole.select(key, F.flatten("p.ids").alias("ids")))


def p6_ids(documents: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    return encode_texts(documents)
