"""Relational operators: dedupe, ranks, catalog sampling, statistics, text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.sources.scratch import materialise


def dedupe(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


#: Groups into which a user's rows are dealt before they are counted.
DEALT = 32


def active_users(interactions: DataFrame, books: DataFrame, least: int) -> DataFrame:
    """Rated interactions with known books, of users with least of them or more (rows, not distinct books).

    Users' rows are dealt in groups by hash and counted there. A group of least rows or more shows by itself that its user is active; all but its first row, which carries its count,
    stay in it. So the second count, over a user's other rows, meets DEALT * least of them at most, however active the user is. Users without an id aren't counted.
    """
    rated = interactions.where("rating > 0 and user_id is not null").join(books.select("book_id"), "book_id", "left_semi")
    dealt = rated.withColumn("_group", F.pmod(F.xxhash64(*(F.col(c) for c in rated.columns if c != "user_id")), F.lit(DEALT)).cast("int"))
    own = Window.partitionBy("user_id", "_group").orderBy("_group")  # one order for both, so that one pass makes them
    dealt = dealt.withColumns({"_n": F.count("*").over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "_first": F.row_number().over(own) == 1})
    stays = (F.col("_n") >= least) & ~F.col("_first")
    dealt = dealt.withColumn("_group", F.when(stays, F.col("_group")).otherwise(-1))
    total = F.sum(F.when(F.col("_first"), F.col("_n")).otherwise(0)).over(Window.partitionBy("user_id", "_group"))
    return dealt.withColumn("_all", total).where((F.col("_group") >= 0) | (F.col("_all") >= least)).drop("_group", "_n", "_first", "_all")


def dense_index(df: DataFrame, key: str, name: str) -> DataFrame:
    """Each distinct key with its place among the sorted ones, from 0. Places come from counts of ranges of keys, so that no task sorts all of them."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return placed(keys, [F.col(key)], name).select(key, (F.col(name) - 1).cast("int").alias(name))


def placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their place from 1 in the given total order. Ranges are dealt once and written with their number, so that counts and places speak of the same ones; the driver's part is a row per range."""
    ranged = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").count()
    starts = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_local", local).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_start", "_local")


def sampled_tables(ids: DataFrame, **named: DataFrame) -> dict[str, DataFrame]:
    """Each table's rows of the sampled books."""
    return {name: df.join(ids.select("book_id").distinct(), "book_id", "left_semi") for name, df in named.items()}


def prototype(books: DataFrame, interactions: DataFrame, reviews: DataFrame, size: int, least: int) -> dict[str, DataFrame]:
    """The most rated books, interactions with them of users who have least or more, and their reviews."""
    top = books.orderBy(F.desc("ratings_count"), "book_id").limit(size)
    found = sampled_tables(top, interactions=interactions, reviews=reviews)
    users = found["interactions"].groupBy("user_id").count().where(F.col("count") >= least)
    return {"books": top, "interactions": found["interactions"].join(users, "user_id", "left_semi"), "reviews": found["reviews"]}


def counts_per_book(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    """Sum, median, least and most reviews of the given books, those without any among them."""
    n = ids.select("book_id").join(reviews.groupBy("book_id").agg(F.count("*").alias("n")), "book_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.sum("n").alias("total"), F.percentile("n", 0.5).alias("median"), F.min("n").alias("least"), F.max("n").alias("most"))


def length_stats(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.percentile(F.length(text), 0.5).alias("median_chars"), F.max(F.length(text)).alias("most_chars"))


def catalog_sample(books: DataFrame, interactions: DataFrame, reviews: DataFrame, least_reviews: int, least_interactions: int, size: int) -> DataFrame:
    """The most rated books that have enough reviews and interactions, in a fixed order."""
    r = reviews.groupBy("book_id").agg(F.count("*").alias("review_count"))
    i = interactions.groupBy("book_id").agg(F.count("*").alias("interaction_count"))
    joined = books.join(r, "book_id", "left").join(i, "book_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("review_count", "interaction_count")})
    kept = joined.where((F.col("review_count") >= least_reviews) & (F.col("interaction_count") >= least_interactions))
    return kept.orderBy(F.desc("ratings_count"), F.desc("text_reviews_count"), "book_id").limit(size)


def min_median_max(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("min_value"), F.percentile(column, 0.5).alias("median_value"), F.max(column).alias("max_value"))


def rating_stats(ratings: DataFrame, key: str = "book_id") -> DataFrame:
    """Mean, population deviation and the five counts of each item."""
    return ratings.groupBy(key).agg(F.avg("rating").alias("average_rating"), F.stddev_pop("rating").alias("rating_std_dev"), *(F.count_if(F.col("rating") == i).alias(f"n{i}") for i in range(1, 6)))


def stratified_sample(reviews: DataFrame, bucket: Column, per_bucket: int = 4, total: int = 12, seed: str = "42") -> DataFrame:
    """Up to per_bucket rows of each bucket of a book, then others, up to total: by a seeded hash of the review, in two rankings."""
    h = F.md5(F.concat_ws("|", F.lit(seed), "book_id", "review_id").cast("binary"))
    ranked = reviews.withColumn("bucket", bucket).withColumn("h", h)
    ranked = ranked.withColumn("tier", (F.row_number().over(Window.partitionBy("book_id", "bucket").orderBy("h", "review_id")) > per_bucket).cast("int"))
    ranked = ranked.withColumn("pick", F.row_number().over(Window.partitionBy("book_id").orderBy("tier", "h", "review_id")))
    return ranked.where(F.col("pick") <= total).drop("h")


def text_block(df: DataFrame, key: str, place: str, text: Column, separator: str, name: str) -> DataFrame:
    """Texts of each key, joined in order of place."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), text.alias("t"))))
    return df.groupBy(key).agg(F.array_join(F.transform(pairs, lambda s: s["t"]), separator).alias(name))


def drop_reasons(reviews: DataFrame, known: DataFrame) -> DataFrame:
    """Of each review, the first step that drops it; steps see only what the earlier ones left."""
    from foliant.functions.scalars import number_or_null, text_or_empty, word_count

    marked = reviews.join(known.select("book_id", F.lit(True).alias("_known")), "book_id", "left")
    first = F.when(F.col("_known").isNull(), "book").when(F.coalesce(number_or_null(F.col("rating")), F.lit(0.0)) <= 0, "rating").when(text_or_empty(F.col("review_text")) == "", "text")
    marked = marked.withColumn("reason", first)
    again = F.row_number().over(Window.partitionBy("book_id", "user_id", F.sha2(F.col("review_text").cast("binary"), 256), F.col("reason").isNull()).orderBy("review_id"))
    marked = marked.withColumn("reason", F.coalesce("reason", F.when(again > 1, "duplicate"), F.when(word_count(F.col("review_text")) < 10, "short"), F.lit("kept")))
    return marked.groupBy("reason").agg(F.count("*").alias("n"))


def field_coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: its type, share of non-null and of non-empty values, and a sample, the least value as text that isn't empty (of 80 characters at most). One pass over the table."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    measures = lambda c: (F.avg(F.col(c).isNotNull().cast("double")), F.avg((text(c) != "").cast("double")), F.min(F.when(text(c) != "", F.left(text(c), F.lit(80)))))
    one = df.agg(*(m.alias(f"{i}_{j}") for i, c in enumerate(columns) for j, m in enumerate(measures(c))))
    kinds = dict(df.dtypes)
    rows = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(kinds[c]).alias("kind"), F.col(f"{i}_0").alias("non_null"), F.col(f"{i}_1").alias("non_empty"), F.col(f"{i}_2").alias("sample")) for i, c in enumerate(columns)))
    return one.select(F.inline(rows))


def shares(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """A row per predicate: how many rows satisfy it, of all, and their share (null is not satisfied; no share without rows). One pass."""
    one = df.agg(F.count("*").alias("_rows"), *(F.count_if(p).alias(f"_{i}") for i, p in enumerate(predicates.values())))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("predicate"), F.col(f"_{i}").alias("n"), F.col("_rows").alias("rows"), (F.try_divide(F.col(f"_{i}").cast("double"), F.col("_rows"))).alias("share")) for i, name in enumerate(predicates)))))


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """bin (from 0), its lower bound and n for each of bins equal widths from low to high, the last with its upper bound; empty ones have 0. Nulls and values outside aren't counted."""
    v = F.col(value).cast("double")
    at = F.least(F.width_bucket(v, F.lit(float(low)), F.lit(float(high)), F.lit(bins)) - 1, F.lit(bins - 1)).cast("long")
    found = df.where(v.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(found, "bin", "left").select("bin", (F.lit(float(low)) + F.col("bin") * F.lit((float(high) - low) / bins)).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))


def validation_summary(books: DataFrame, interactions: DataFrame, reviews: DataFrame) -> DataFrame:
    """metric and value: rows, distinct ids, and which books are in which tables. Each table is read once: ids are counted before the shuffle, and the tables meet as counts by id."""
    none = {c: F.lit(0).cast("long") for c in ("b", "i", "r")}

    def counted(df: DataFrame, kind: str, key: str, column: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), *((F.lit(1).cast("long") if c == column else x).alias(c) for c, x in none.items()))

    both = interactions.select(F.explode(F.array(F.struct(F.lit("book").alias("kind"), F.col("book_id").cast("string").alias("id")), F.struct(F.lit("user").alias("kind"), F.col("user_id").cast("string").alias("id")))).alias("s"))
    ids = counted(books, "book", "book_id", "b").unionByName(counted(reviews, "book", "book_id", "r")).unionByName(both.select("s.kind", "s.id", *((F.lit(1).cast("long") if c == "i" else x).alias(c) for c, x in none.items())))
    n = ids.groupBy("kind", "id").agg(*(F.sum(c).alias(c) for c in none))
    book = F.col("kind") == "book"
    held = {c: book & (F.col(c) > 0) for c in none}
    metrics = {
        "books": F.count_if(held["b"]), "interactions": F.sum(F.when(book, F.col("i")).otherwise(0)), "reviews": F.sum("r"), "users": F.count_if(~book), "in_all": F.count_if(held["b"] & held["i"] & held["r"]),
        "orphan_interactions": F.count_if(held["i"] & ~held["b"]), "books_without_reviews": F.count_if(held["b"] & ~held["r"]), "in_any": F.count_if(held["i"] | held["r"]),
    }
    one = n.agg(*(F.coalesce(m, F.lit(0)).alias(name) for name, m in metrics.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(name).alias("metric"), F.col(name).alias("value")) for name in metrics))))
