"""Query blocks against shards of vectors, and merging of top lists.

A tile is one block of queries and one shard of vectors of the same dimension.
Rows are dealt to tiles by hashes of id and vector, so rows of one id, label or vector
don't meet; of rows that repeat both only the first k can be in a list, and as queries
they ask once, so no others are dealt. A tile has ``SHARD`` vectors and
``BLOCK`` queries on average, whatever the ids, labels or copies. Top lists are merged in
a tree, ``FAN`` shards at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD, BLOCK, FAN = 8192, 8192, 16


def usable(frame: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v (array<double>) and dim of the rows whose vector is whole: not null or empty, no null and no non-finite component."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return frame.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine).withColumn("dim", F.size("v"))


def tiled(vectors: DataFrame, every: int, k: int, score, schema: str) -> tuple[DataFrame, int]:
    """``score(queries, vectors)`` of each tile's pandas frames (vec_id, v, and h, a hash of both), as one frame with the tile's shard, and the number of shards."""
    hashed = vectors.withColumn("h", F.xxhash64("vec_id", "v"))
    n, m = hashed.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-m // BLOCK))
    place = lambda seed, count: F.pmod(F.xxhash64("h", "copy", F.lit(seed)), F.lit(count)).cast("int")
    # The window's limit works before the shuffle too.
    copy = F.row_number().over(Window.partitionBy("h", "vec_id", "v").orderBy(F.lit(0)))
    some = hashed.withColumn("copy", copy).where(F.col("copy") <= k)
    own = some.withColumn("asks", F.lit(False)).withColumn("shard", place(1, shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    ask = some.where((F.col("vec_id") % every == 0) & (F.col("copy") == 1)).withColumn("asks", F.lit(True)).withColumn("block", place(2, blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    columns = ["dim", "shard", "block", "asks", "vec_id", "h", "v"]

    def tile(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        found = score(group[asks].sort_values("vec_id", kind="stable"), group[~asks].sort_values("vec_id", kind="stable"))
        return found.assign(shard=int(group["shard"].iloc[0]))

    return own.select(columns).union(ask.select(columns)).groupBy("dim", "shard", "block").applyInPandas(tile, f"{schema}, shard int"), shards


def merged(lists: DataFrame, shards: int, k: int) -> DataFrame:
    """query_id, rank, vec_id and score of each query's (query_id, h) ``k`` best rows, ties to the smaller vec_id."""
    order = [F.desc("score"), F.asc("vec_id")]
    while shards > 1:
        lists = lists.withColumn("shard", F.floor(F.col("shard") / FAN).cast("int"))
        shards = -(-shards // FAN)
        best = Window.partitionBy("query_id", "h", "shard").orderBy(*order)
        lists = lists.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    ranked = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "h").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
