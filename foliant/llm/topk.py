"""Exact top-k search by inner product: tiles of queries and shards, partial selection, tree merging."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import finite_vector, main_dimension, read_table

TILE = 1 << 22  # components of a tile's side: 32 MB as doubles
LONG = (-(1 << 63), (1 << 63) - 1)


def inner_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products. In doubles where no partial sum can pass 2**53, else in Python's integers; raises if one is no long."""
    bound = np.abs(queries).max(initial=0) * np.abs(rows).max(initial=0) * queries.shape[1]
    if bound < 2**53:
        return (queries @ rows.T).astype(np.int64)
    to_int = np.vectorize(int, otypes=[object])
    found = to_int(queries) @ to_int(rows).T
    if found.size and (found.max() > LONG[1] or found.min() < LONG[0]):
        raise OverflowError("an inner product does not fit into a long")
    return found.astype(np.int64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id: partial selection down to the k-th score, then a sort of what is left."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > cut), np.flatnonzero(scores == cut)
        level = level[np.argsort(ids[level], kind="stable")][: k - len(above)]
        place = np.concatenate([above, level])
    else:
        place = np.arange(len(scores))
    return place[np.lexsort((ids[place], -scores[place]))]


def merge_tops(tops: DataFrame, k: int, fan_in: int, tiles: int) -> DataFrame:
    """Per-query top lists of so many tiles, merged fan_in at a time on each level of a tree, as many levels as that takes; ranks from 1."""
    order = (F.desc("score"), F.asc("vec_id"))
    while tiles > fan_in:
        tops = tops.withColumn("tile", F.floor(F.col("tile") / fan_in))
        tops = tops.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "tile").orderBy(*order))).where(F.col("r") <= k).drop("r")
        tiles = math.ceil(tiles / fan_in)
    ranked = tops.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def exact_top_k(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: int = 1024, shard_rows: int | None = None, block_rows: int | None = None, fan_in: int = 32) -> DataFrame:
    """The k rows of vectors with the highest integer inner product floor(scale * x) with each row of queries, its own id left out.

    Null vectors, and ones with null or non-finite components, take no part, nor do null ids or vectors of another length than the commonest.
    Ties go to the smaller id; a repeated row is a candidate each time. Without queries or candidates there are no rows. Other columns are ignored.
    Both sides are dealt by hash of id into shards of about shard_rows and blocks of about block_rows (if not given: as many as have TILE components; fewer while there are fewer shards than tasks at a time); each pair of them is a tile, and a tile sends k rows a query at most.
    A row is copied once a block and a query once a shard, so larger tiles shuffle less.
    """
    own = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & finite_vector(F.col("v")))
    rows, asked = own(vectors), own(queries)
    dim = main_dimension(rows, "v")
    rows, asked = (x.where(F.size("v") == dim) for x in (rows, asked))
    n_rows, n_asked = rows.count(), asked.count()
    most, wide = max(1, TILE // max(1, dim)), vectors.sparkSession.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n_rows / shard_rows) if shard_rows else max(math.ceil(n_rows / most), min(wide, math.ceil(n_rows / 4096))))
    blocks = max(1, math.ceil(n_asked / (block_rows or most)))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = asked.withColumn("block", deal(blocks)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = rows.withColumn("shard", deal(shards)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def tile(key, q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "tile": [], "vec_id": [], "score": []})
        floor = lambda s: np.floor(np.stack(s.to_numpy()).astype(np.float64) * scale)
        a, b, ids = floor(q["v"]), floor(r["v"]), r["id"].to_numpy()
        asked, found, scored = q["id"].to_numpy(), [], []
        for at in range(0, len(a), 64):
            for i, row in zip(asked[at : at + 64], inner_products(a[at : at + 64], b), strict=True):
                other = np.flatnonzero(ids != i)
                top = other[best_of(row[other], ids[other], k)]
                found.append(ids[top])
                scored.append(row[top])
        return pd.DataFrame({"query_id": np.repeat(asked, [len(x) for x in found]), "tile": key[0], "vec_id": np.concatenate(found), "score": np.concatenate(scored)})

    tops = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(tile, "query_id long, tile int, vec_id long, score long")
    return merge_tops(tops, k, fan_in, shards)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op1_exact_topk": op1_exact_topk}
ORACLE_SQL = {
    "op1_exact_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
}
