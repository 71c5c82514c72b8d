"""The preprocessing job: its stages by name, whole or for a small catalog of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.operators.tables import active_users, dense_index, validation_summary
from foliant.sources.raw import books_table, raw_books, raw_interactions, raw_reviews, reviews_table, write_table

STAGES = ("books", "interactions", "reviews", "validate")


def preprocess(spark: SparkSession, raw: dict[str, str], out: str, *, stage: str = "all", proto: int | None = None, least_ratings: int = 1000, least_user: int = 10, detect=None, counters: dict | None = None) -> dict[str, DataFrame]:
    """Run one stage, or all of them in order: raw names the paths of books, interactions and reviews; tables lie under out.

    counters gets a dictionary of the lines by step for books and reviews, and the validation's metrics, of the stages that ran; they are counted while the tables are written.
    detect tells languages of reviews without a code (without it, a model is trained on those with one).
    A stage that is not run is read from out. With proto, only the so many most rated books count, and all tables lie under out/proto; the others are not touched.
    """
    if stage not in (*STAGES, "all"):
        raise ValueError(f"no stage {stage!r}; there are {', '.join(STAGES)} and all")
    runs = lambda name: stage in (name, "all")
    root = f"{out}/proto" if proto else out
    seen: dict[str, dict] = {}

    def made(name: str, make) -> DataFrame:
        if runs(name):
            write_table(make(), f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    def books() -> DataFrame:
        found = books_table(raw_books(spark, raw["books"]), least_ratings, seen.setdefault("books", {}))
        return found.orderBy(found.ratings_count.desc(), "book_id").limit(proto) if proto else found

    tables = {"books": made("books", books)}
    tables["interactions"] = made("interactions", lambda: active_users(raw_interactions(spark, raw["interactions"]), tables["books"], least_user))
    if runs("interactions"):
        for key in ("user_id", "book_id"):
            write_table(dense_index(tables["interactions"], key, f"{key[:4]}_idx"), f"{root}/{key}_index")
    tables["reviews"] = made("reviews", lambda: reviews_table(raw_reviews(spark, raw["reviews"]), tables["books"], detect, seen.setdefault("reviews", {})))
    if runs("validate"):
        from foliant.operators.checks import expect_unique

        expect_unique(tables["books"], "book_id")
        expect_unique(tables["reviews"], "review_id")
        if counters is not None:
            counters["validate"] = {r["metric"]: r["value"] for r in validation_summary(tables["books"], tables["interactions"], tables["reviews"]).collect()}
    if counters is not None:
        counters |= {name: dict(found["lines"].get) for name, found in seen.items()}
    return tables
