"""What pages show: enriched results, pages of them, clusters and their members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators.tables import dedupe
from foliant.operators.text_search import thematic_search
from foliant.sources.scratch import path_exists


def enrich(results: DataFrame, details: DataFrame, key: str = "book_id", suffix: str = "_ui") -> DataFrame:
    """Results with the details of their ids, one row each; columns of both come from results, and from details with suffix."""
    one = dedupe(details, [key], [F.col(c) for c in details.columns if c != key])
    one = one.select(key, *(F.col(c).alias(c + suffix if c in results.columns else c) for c in one.columns if c != key))
    return results.join(one, key, "left")


def page_number(total: int, number: int, size: int = 10) -> tuple[int, int]:
    """The page that is shown and how many there are, one at least: below the first it is the first, beyond the last the last."""
    pages = max(1, -(-total // size))
    return min(max(1, number), pages), pages


def page(ranked: DataFrame, number: int, size: int = 10, rank: str = "rank") -> DataFrame:
    """Rows of a page, their numbers held to the pages that there are."""
    shown, _ = page_number(ranked.agg(F.max(rank)).head()[0] or 0, number, size)
    return ranked.where(F.col(rank).between((shown - 1) * size + 1, shown * size))


def search_page(vectors: DataFrame, books: DataFrame, details: DataFrame, encoder, text: str, number: int = 1, *, width: int = 256, size: int = 10, depth: int = 100, key: str = "book_id") -> tuple[DataFrame, int, int, int]:
    """A page of the depth books nearest to a text, with rank and their details; and the page's number, how many pages there are, and how many books were found. A blank text finds none."""
    found = thematic_search(vectors, books, text, encoder, depth, width=width, key=key)
    ranked = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))  # depth rows
    total = ranked.count()
    shown, pages = page_number(total, number, size)
    rows = ranked.where(F.col("rank").between((shown - 1) * size + 1, shown * size))
    return enrich(rows, details, key).orderBy("rank"), shown, pages, total


def cold_start(books: DataFrame, n: int = 5) -> DataFrame:
    return books.orderBy(F.desc("average_rating"), F.desc("ratings_count"), "book_id").limit(n).withColumn("similarity", F.lit(None).cast("double"))


def ui_cache(final: DataFrame, books: DataFrame, key: str = "book_id", size: int | None = None) -> DataFrame:
    """Final rows with their books' columns; raises if a title is missing, or, with size, for another number of rows."""
    from foliant.operators.checks import expect_none

    joined = final.join(dedupe(books, [key], [F.col("title")]), key, "left")
    if size is not None and (n := joined.count()) != size:
        raise ValueError(f"{n} rows, {size} expected")
    expect_none(joined.where("title is null").select(key), "no title")
    return joined


def favorites_page(books: DataFrame, liked: list[str], key: str = "book_id") -> DataFrame:
    """The liked books that are known, with their place among the liked ones from 1 (oldest first); a repeat keeps its first place."""
    places = [(b, i) for i, b in enumerate(dict.fromkeys(map(str, liked)), 1)]
    order = books.sparkSession.createDataFrame(places, f"{key} string, _fav_order int")
    return books.withColumn(key, F.col(key).cast("string")).join(F.broadcast(order), key).orderBy("_fav_order")


def recommendations(books: DataFrame, liked: list, personal, n: int = 5, details: DataFrame | None = None) -> tuple[str, DataFrame]:
    """Mode and rows: the top rated without favourites, else what personal(liked, n) gives (book_id and similarity among its columns). With details, rows come with them, and with the similarity as their score."""
    if liked:
        mode, rows = "personalized", personal(liked, n)
    else:
        mode, rows = "top_rated", cold_start(books, n).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("average_rating"), F.desc("ratings_count"), "book_id")))
    return mode, rows if details is None else enrich(rows, details).withColumn("score", F.col("similarity").cast("double"))


def cluster_list(members: DataFrame) -> DataFrame:
    """cluster_id, cluster_label and cluster_size, the largest first."""
    return members.select("cluster_id", "cluster_label", "cluster_size").distinct().orderBy(F.desc("cluster_size"), "cluster_id")


def neighborhood(members: DataFrame, cluster_id: int, show: int | None = 10, details: DataFrame | None = None, key: str = "book_id") -> DataFrame:
    """A cluster's members by rank: the first 10, 25, 50, or all (None); with their details, if there are any."""
    own = members.where(F.col("cluster_id") == cluster_id)
    own = own if show is None else own.where(F.col("cluster_rank") <= show)
    return (own if details is None else enrich(own, details, key)).orderBy("cluster_rank")


# The captions' wording
def shown_caption(total: int, show: int | None) -> str:
    return f"All {total} books in this neighborhood" if show is None else f"Top {min(show, total)} most central to this neighborhood"


def require_artifacts(spark: SparkSession, required: list[str], optional: list[str] = ()) -> list[str]:
    """Raises with the names of required paths that don't exist; gives the optional ones that do."""
    if missing := [p for p in required if not path_exists(spark, p)]:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")
    return [p for p in optional if path_exists(spark, p)]


class Artifacts:
    """Tables by path, read once a session and kept in its cache, spilling to disk."""

    def __init__(self, spark: SparkSession):
        self.spark, self.held = spark, {}

    def table(self, path: str) -> DataFrame:
        if path not in self.held:
            self.held[path] = self.spark.read.parquet(path).persist()
        return self.held[path]

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()
