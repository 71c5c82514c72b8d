"""Cosine search, favourites persona and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.vectors import dot, doubles, norm, normalized, vector_sum


def top_k_cosine(items: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Ids and scores of the k items nearest to one query vector, which is a literal of the plan; ranked by the whole score, shown with six decimals. Items' vectors have length 1. A zero query scores 0 everywhere."""
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = items.select(id_col, dot(doubles(F.col(vector)), normalized(q)).alias("_whole"))
    return scored.orderBy(F.desc("_whole"), id_col).limit(k).select(id_col, F.round("_whole", 6).alias("score"))


def similar_items(items: DataFrame, item_id, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    row = items.where(F.col(id_col) == item_id).select(vector).head()
    if row is None:
        raise ValueError(f"unknown item: {item_id}")
    return top_k_cosine(items.where(F.col(id_col) != item_id), row[0], k, id_col, vector)


def recency_weights(favorites: DataFrame, by: str | None = None) -> DataFrame:
    """favorites with weight: linear by pos, newest four times the oldest, summing to 1; with by, for each of its values by itself."""
    keys = [by] if by else []
    n, i = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(Window.partitionBy(*keys).orderBy("pos")) - 1
    return favorites.withColumn("weight", F.when(n == 1, F.lit(1.0)).otherwise((F.lit(0.4) + F.lit(1.2) * i / (n - 1)) / n))


class UnknownFavorites(ValueError):
    """None of the favourites is among the items."""


def persona(items: DataFrame, favorites: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> list[float]:
    """The weighted mean of the known favourites; unknown ones are left out before weights are made."""
    known = recency_weights(favorites.join(items.select(id_col, doubles(F.col(vector)).alias("v")), id_col))
    row = vector_sum(known.withColumn("one", F.lit(1)), ["one"], "v", "weight").head()
    if row is None:
        raise UnknownFavorites("no favourite is known")
    return list(row["v"])


def recommend(items: DataFrame, favorites: DataFrame, metadata: DataFrame, n: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """rank, id, metadata and similarity of the n items nearest to the persona that aren't favourites themselves. Without a known favourite there are none, with the same columns."""
    try:
        wanted = persona(items, favorites, id_col, vector)
    except UnknownFavorites:
        return items.select(id_col, F.lit(0.0).alias("similarity")).limit(0).join(metadata, id_col, "left").withColumn("average_rating", F.coalesce("average_rating", F.lit(0.0))).withColumn("rank", F.lit(1))
    q = F.array(*(F.lit(float(x)) for x in wanted))
    score = F.when(norm(q) == 0, F.lit(0.0)).otherwise(dot(doubles(F.col(vector)), normalized(q)))
    scored = items.select(id_col, score.alias("_whole")).join(favorites.select(id_col), id_col, "left_anti")
    order = [F.desc("_whole"), F.desc("average_rating"), F.col(id_col)]
    best = scored.join(metadata, id_col, "left").withColumn("average_rating", F.coalesce("average_rating", F.lit(0.0))).orderBy(*order).limit(n)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).withColumn("similarity", F.round("_whole", 6)).drop("_whole")


def unknown_favorites(items: DataFrame, favorites: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """The favourites that no item has, for a warning; persona() leaves them out."""
    return favorites.join(items.select(id_col), id_col, "left_anti")


def favorites_frame(spark: SparkSession, pairs: list[tuple[int, int]], id_col: str = "vec_id") -> DataFrame:
    return spark.createDataFrame(pairs, f"pos int, {id_col} long")
