"""Raw dumps in, tables and logs out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from foliant.functions.scalars import first_field, joined_names, safe_float, safe_int, text_or_empty
from foliant.sources.gzip_lines import read_lines

BOOK_DDL = """book_id string, work_id string, title string, title_without_series string, description string, authors array<struct<author_id:string>>, publisher string,
publication_year string, num_pages string, format string, language_code string, is_ebook string, average_rating string, ratings_count string, text_reviews_count string,
popular_shelves array<struct<name:string>>, image_url string, isbn string, isbn13 string"""
REVIEW_DDL = "review_id string, user_id string, book_id string, rating string, review_text string, language_code string, n_votes string, n_comments string, date_added string"
INTERACTION_DDL = "user_id string, book_id string, is_read tinyint, rating tinyint, is_reviewed tinyint"


def read_json_lines(spark: SparkSession, path: str, ddl: str, deal: int | None = None) -> DataFrame:
    """One object per line, gzipped or not; the lines that aren't come with _bad true. Gzip files of many members are read by many tasks. deal: over how many tasks lines are dealt before they are parsed, for files that can't be split, such as those of one member."""
    lines = read_lines(spark, path)
    return parse_json_lines(lines.repartition(deal) if deal else lines, ddl)


def parse_json_lines(lines: DataFrame, ddl: str) -> DataFrame:
    """The objects of lines (value), blank ones left out; those that aren't objects, or aren't whole, come with _bad true."""
    lines = lines.where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{ddl}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    is_object = F.trim("value").startswith("{")
    return parsed.select("r.*", is_object.alias("_object")).withColumn("_bad", F.col("_bad").isNotNull() | ~F.col("_object")).drop("_object")


def raw_books(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, BOOK_DDL)


def raw_reviews(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, REVIEW_DDL)


def raw_interactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INTERACTION_DDL).csv(path, header=True)


def book_step(least_ratings: int) -> Column:
    """The first step that drops a line of the books' dump, or kept."""
    return F.when(F.col("_bad") | F.col("book_id").isNull(), "malformed").when(safe_int(F.col("ratings_count")) < least_ratings, "ratings").when(text_or_empty(F.col("title")) == "", "title").otherwise("kept")


def books_table(raw: DataFrame, least_ratings: int = 1000, counters: dict | None = None) -> DataFrame:
    """Books with enough ratings and a title, one row of each id (the first by work and title). counters: see counted(); the steps are BOOK_STEPS."""
    from foliant.operators.tables import dedupe

    kept = counted(raw.withColumn("_step", book_step(least_ratings)), BOOK_STEPS, {} if counters is None else counters)
    rows = kept.select(
        "book_id", "work_id", text_or_empty(F.col("title")).alias("title"), F.coalesce(F.nullif(text_or_empty(F.col("title_without_series")), F.lit("")), text_or_empty(F.col("title"))).alias("title_without_series"),
        first_field(F.col("authors"), "author_id").alias("primary_author_id"), *(text_or_empty(F.col(c)).alias(c) for c in ("description", "publisher", "format", "language_code", "image_url", "isbn", "isbn13")),
        *(safe_int(F.col(c)).alias(c) for c in ("publication_year", "num_pages", "ratings_count", "text_reviews_count")), safe_float(F.col("average_rating")).cast("float").alias("average_rating"),
        (F.col("is_ebook") == "true").alias("is_ebook"), joined_names(F.col("popular_shelves")).alias("popular_shelves"),
    )
    return dedupe(rows, ["book_id"], [F.col("work_id"), F.col("title")])


def skipped_books(raw: DataFrame, least_ratings: int = 1000) -> DataFrame:
    """Counts of lines by the first step that drops them."""
    return raw.groupBy(book_step(least_ratings).alias("reason")).agg(F.count("*").alias("n"))


def is_english(code: Column, text: Column, detect) -> Column:
    """A language code decides if there is one; else texts of 20 or more characters go to detect, a function of a column that gives a code."""
    code, text = F.lower(text_or_empty(code)), text_or_empty(text)
    return F.when(code != "", F.startswith(code, F.lit("en"))).when(F.length(text) < 20, F.lit(False)).otherwise(F.coalesce(detect(text) == "en", F.lit(False)))


#: Why a line of the dumps is no row, in the order of the steps; kept ones may still be repeats.
BOOK_STEPS, REVIEW_STEPS = ("malformed", "ratings", "title", "kept"), ("malformed", "book", "empty", "language", "kept")


def counted(rows: DataFrame, steps: tuple[str, ...], counters: dict, *, step: str = "_step") -> DataFrame:
    """The rows whose step is kept, without it. counters gets an Observation under lines: how many rows each step takes, known once the result has been written, without another pass. A stage that is run again after a loss may count its rows twice."""
    seen = Observation()
    counters["lines"] = seen
    return rows.observe(seen, *(F.count_if(F.col(step) == s).alias(s) for s in steps)).where(F.col(step) == "kept").drop(step)


def reviews_table(raw: DataFrame, books: DataFrame, detect=None, counters: dict | None = None) -> DataFrame:
    """English reviews of known books, but those without rating and text. Without detect, a model is trained on the raw reviews that have a language code. counters: see counted(); the steps are REVIEW_STEPS, each of which sees only what those before it left."""
    from foliant.operators.language import trained_on_codes
    from foliant.operators.tables import dedupe

    detect = detect or trained_on_codes(raw.where(~F.col("_bad"))).detect
    marked = raw.join(books.select("book_id", F.lit(True).alias("_known")), "book_id", "left")
    text, rating = text_or_empty(F.col("review_text")), safe_int(F.col("rating"))
    before = F.when(F.col("_bad"), "malformed").when(F.col("_known").isNull(), "book").when((rating == 0) & (text == ""), "empty")
    # texts that an earlier step drops aren't given to the classifier
    language = is_english(F.when(before.isNull(), F.col("language_code")), F.when(before.isNull(), F.col("review_text")), detect)
    rows = counted(marked.withColumn("_step", F.coalesce(before, F.when(~language, "language"), F.lit("kept"))), REVIEW_STEPS, {} if counters is None else counters)
    rows = rows.select("review_id", "user_id", "book_id", rating.alias("rating"), text.alias("review_text"), safe_int(F.col("n_votes")).alias("n_votes"), safe_int(F.col("n_comments")).alias("n_comments"), "date_added")
    return dedupe(rows, ["review_id"], [F.col("book_id"), F.col("user_id"), F.col("review_text")])


def line_id(line: Column, field: str = "book_id") -> Column:
    """The digits that first stand as the field's value in a raw line; empty without any."""
    return F.regexp_extract(line, f'"{field}":\\s*"?(\\d+)', 1)


def lines_of(lines: DataFrame, ids: DataFrame, field: str = "book_id") -> DataFrame:
    """The raw lines whose id is among ids, before they are parsed."""
    keyed = lines.withColumn("_id", line_id(F.col("value"), field))
    return keyed.join(ids.select(F.col(field).cast("string").alias("_id")).distinct(), "_id", "left_semi").drop("_id")


def id_list(spark: SparkSession, path: str, size: int | None = None, strict: bool = False) -> DataFrame:
    """rank and id of a JSON array of ids, trimmed; blank ones are left out, repeats keep their first place. With size, other numbers of ids raise; strict lists have neither blank nor repeated ids, else they raise."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "id")).select("pos", F.trim(F.coalesce("id", F.lit(""))).alias("id"))
    if strict and (bad := rows.groupBy("id").agg(F.count("*").alias("n")).where("id = '' or n > 1").limit(10).collect()):
        raise ValueError(f"blank or repeated ids: {[r['id'] for r in bad]}")
    out = rows.where("id <> ''").groupBy("id").agg(F.min("pos").alias("rank")).select("rank", "id")
    if size is not None and (n := out.count()) != size:
        raise ValueError(f"{n} ids, {size} expected")
    return out


def jsonl_records(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The records of a log of one JSON object a line; blank lines, malformed ones, and values that are no objects are passed over."""
    return read_json_lines(spark, path, ddl).where(~F.col("_bad")).drop("_bad")


def sample_rows(spark: SparkSession, path: str, ddl: str, most: int) -> DataFrame:
    return read_json_lines(spark, path, ddl).where(~F.col("_bad")).limit(most)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row table as a JSON file of one line."""
    row.coalesce(1).write.mode("overwrite").json(path)
