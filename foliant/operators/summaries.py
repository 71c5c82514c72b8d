"""Resumable text summaries per item through a pluggable client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.scalars import text_or_empty
from foliant.operators import checks
from foliant.operators.client import CallFailed, Pace, Retry, in_order, with_retries
from foliant.operators.tables import dedupe
from foliant.sources.scratch import materialise

OUTPUT_DDL = "book_id string, ok boolean, judgment string, positive_aspects array<string>, negative_aspects array<string>, top_tags array<string>, error_type string, error_message string, attempts int, timestamp_utc string"
LIMITS, LEAST_TAGS = {"positive_aspects": 6, "negative_aspects": 6, "top_tags": 4}, 2


def pending(items: DataFrame, log: DataFrame, key: str = "book_id") -> DataFrame:
    """Items without a success in the log; failures are tried again."""
    return items.join(log.where("ok").select(key), key, "left_anti")


def latest(log: DataFrame, key: str = "book_id") -> DataFrame:
    return dedupe(log, [key], [F.desc("timestamp_utc"), F.desc("attempts")])


#: What the client is to answer with; its field names are fixed by the outputs' columns.
RESPONSE_NAME = "review_summary"
RESPONSE_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "properties": {
        "book_id": {"type": "string"},
        "positive_aspects": {"type": "array", "items": {"type": "string"}, "minItems": 0, "maxItems": LIMITS["positive_aspects"]},
        "negative_aspects": {"type": "array", "items": {"type": "string"}, "minItems": 0, "maxItems": LIMITS["negative_aspects"]},
        "overall_judgment": {"type": "string"},
        "top_tags": {"type": "array", "items": {"type": "string"}, "minItems": LEAST_TAGS, "maxItems": LIMITS["top_tags"]},
    },
    "required": ["book_id", "positive_aspects", "negative_aspects", "overall_judgment", "top_tags"],
}


def string_list(value, most: int) -> list[str]:
    """A list's texts that aren't blank; anything else, texts too, gives none."""
    return [t for x in (value if isinstance(value, list) else []) if (t := str(x).strip())][:most]


def payload_of(response) -> dict:
    """The answer's fields: a dictionary of them, or the input of the block of that name in an answer made of blocks (objects or dictionaries)."""
    get = lambda x, name: x.get(name) if isinstance(x, dict) else getattr(x, name, None)
    if isinstance(response, dict) and "content" not in response:
        return response
    for block in get(response, "content") or []:
        if get(block, "type") == "tool_use" and get(block, "name") == RESPONSE_NAME:
            if not isinstance(found := get(block, "input"), dict):
                raise ValueError("the answer's block holds no fields")
            return found
    raise ValueError("the answer has no block of fields")


def validated(payload: dict, book_id: str) -> dict:
    """The payload's fields, held to their limits; raises ValueError for another id (but for white space around it), fewer than two tags or no judgment."""
    if (echoed := str(payload.get("book_id", "")).strip()) != book_id:
        raise ValueError(f"the id does not match: {echoed}")
    judgment = payload.get("overall_judgment", payload.get("judgment"))
    out = {k: string_list(payload.get(k), n) for k, n in LIMITS.items()} | {"judgment": str(judgment or "").strip()}
    if len(out["top_tags"]) < LEAST_TAGS or not out["judgment"]:
        raise ValueError("tags or judgment missing")
    return out


def utc_now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def run_pending(items: DataFrame, client: Callable[[str], dict], retry: Retry = (TimeoutError, ConnectionError), attempts: int = 5, sleep: Callable[[float], None] = time.sleep, *, at_once: int = 1, tasks: int | None = None, a_second: float | None = None) -> DataFrame:
    """A row per item (book_id, prompt): the client's validated answer, or the error with the attempts that it took. Write the result once, then resume with pending: a task that is run again calls the client again.

    at_once calls run at a time in a task (the client must bear that). tasks sets how many tasks there are; with a_second, all of them together make no more calls a second, as each has its share, used or not.
    """
    if a_second is not None and tasks is None:
        raise ValueError("a rate is shared by a known number of tasks")
    names = [c.split()[0] for c in OUTPUT_DDL.split(", ")]

    def run(batches: Iterator) -> Iterator:
        pace = Pace(None if a_second is None else a_second / tasks)

        def called(item: tuple[str, str]) -> dict:
            book, prompt = item
            row, n = dict.fromkeys(names) | {"book_id": book}, 1
            try:
                response, n = with_retries(lambda: client(prompt), retry, attempts, sleep, pace)
                row |= validated(payload_of(response), book) | {"ok": True, "attempts": n}
            except CallFailed as e:
                row |= {"ok": False, "error_type": type(e.error).__name__, "error_message": str(e)[:500], "attempts": e.attempts}
            except Exception as e:
                row |= {"ok": False, "error_type": type(e).__name__, "error_message": str(e)[:500], "attempts": n}
            return row | {"timestamp_utc": utc_now()}

        for pdf in batches:
            yield pd.DataFrame(in_order(called, zip(pdf["book_id"], pdf["prompt"], strict=True), at_once), columns=names)

    rows = items.select("book_id", "prompt")
    return (rows.repartition(tasks) if tasks else rows).mapInPandas(run, OUTPUT_DDL)


def run_counts(items: DataFrame, log: DataFrame) -> DataFrame:
    """How many items there are, succeeded, failed last, and remain unresolved."""
    last = items.select("book_id").join(latest(log).select("book_id", "ok"), "book_id", "left")
    return last.agg(F.count("*").alias("items"), F.count_if("ok").alias("succeeded"), F.count_if(~F.col("ok")).alias("failed"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("unresolved"))


def prompt_text() -> F.Column:
    return F.concat_ws("\n\n", F.concat(F.lit("Book: "), "title"), F.concat(F.lit("Average rating: "), F.col("average_rating").cast("string")), "rating_distribution_text", "reviews_text_block")


def empty_log(spark: SparkSession) -> DataFrame:
    """The typed table that is written where no item was ever run."""
    return spark.createDataFrame([], OUTPUT_DDL)


def compacted(log: DataFrame, path: str) -> DataFrame:
    """The last row of each item, written as a new version of the table at path, which readers get once it is whole; an empty log gives an empty typed table."""
    from foliant.sources.versions import read_version, write_version

    write_version(latest(log), path)
    return read_version(log.sparkSession, path, log.schema)


def run_averages(log: DataFrame) -> DataFrame:
    """Mean input characters and output tokens of the successes; null without any."""
    return log.where("ok").agg(F.avg("input_chars").alias("mean_input_chars"), F.avg("output_tokens").alias("mean_output_tokens"))


FINAL_COLUMNS = ("book_id", "title", "overall_judgment", "positive_aspects", "negative_aspects", "top_tags")


def compact_json(c: F.Column) -> F.Column:
    """JSON without spaces, with characters beyond ASCII as they are."""
    return F.to_json(c)


def stored_tags(df: DataFrame, column: str = "top_tags") -> tuple[DataFrame, str]:
    """Trimmed tags that aren't blank, and how they are stored: a list column stays one; texts become compact JSON where they hold a JSON list, and stay trimmed texts where they don't (null: empty)."""
    if df.schema[column].dataType.simpleString().startswith("array"):
        return df.withColumn(column, F.filter(F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")), "list"
    text = text_or_empty(F.col(column))
    parsed = F.from_json(text, "array<string>")
    tags = F.filter(F.transform(parsed, lambda t: F.trim(t)), lambda t: t != "")
    return df.withColumn(column, F.when(F.startswith(text, F.lit("[")) & parsed.isNotNull(), compact_json(tags)).otherwise(text)), "json_string"


def tag_count(df: DataFrame, column: str = "top_tags") -> Column:
    """How many tags a stored column holds: a list's, or a text's; a text that is no list is one tag unless it is empty."""
    if df.schema[column].dataType.simpleString().startswith("array"):
        return F.size(column)
    parsed = F.from_json(F.col(column), "array<string>")
    return F.when(F.startswith(F.col(column), F.lit("[")) & parsed.isNotNull(), F.size(parsed)).otherwise((F.col(column) != "").cast("int"))


def check_outputs(rows: DataFrame, ids: DataFrame, size: int | None = None, key: str = "book_id") -> dict:
    """Counts of a run's outputs against the ids expected, in one job over both; raises with examples for blank or repeated ids, missing or unexpected ones, blank judgments, rows without tags, and, with size, another number of rows.

    A tag list of blanks only has no tags.
    """
    checks.require_columns(rows, [key, "overall_judgment", "top_tags"])
    clean = rows.select(F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("id"), (text_or_empty(F.col("overall_judgment")) == "").alias("mute"), (tag_count(rows) == 0).alias("untagged"))
    per = clean.groupBy("id").agg(F.count("*").alias("n"), F.max("mute").alias("mute"), F.max("untagged").alias("untagged"))
    wanted = ids.select(F.trim(F.col(key).cast("string")).alias("id")).distinct().withColumn("wanted", F.lit(True))
    both = per.join(wanted, "id", "full")
    faults = {"blank ids": F.col("n").isNotNull() & (F.col("id") == ""), "repeated ids": F.col("n") > 1, "ids missing": F.col("n").isNull(), "ids not expected": F.col("wanted").isNull(), "no judgment": F.col("mute"), "no tags": F.col("untagged")}
    found = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("wanted").alias("expected"), *(m for i, f in enumerate(faults.values()) for m in (F.count_if(f).alias(f"n{i}"), F.min(F.when(f, F.col("id"))).alias(f"e{i}")))).head()
    if bad := [f"{name}: {found[f'n{i}']}, such as {found[f'e{i}']!r}" for i, name in enumerate(faults) if found[f"n{i}"]]:
        raise ValueError("; ".join(bad))
    if size is not None and found["rows"] != size:
        raise ValueError(f"{found['rows']} rows, {size} expected")
    return {"rows": found["rows"], "expected": found["expected"]}


def check_llm_input(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The input of a run, with trimmed ids; raises for missing columns, blank or repeated ids, blank titles or texts, and, with ids, other ids than those."""
    checks.require_columns(rows, ["book_id", "title", "average_rating", "rating_std_dev", "rating_distribution_text", "reviews_text_block"])
    rows = rows.withColumn("book_id", F.trim(F.col("book_id").cast("string")))
    blank = lambda c: text_or_empty(F.col(c)) == ""
    per = rows.select("book_id", *(blank(c).alias(f"_{c}") for c in ("book_id", "title", "rating_distribution_text", "reviews_text_block"))).groupBy("book_id").agg(F.count("*").alias("n"), *(F.max(f"_{c}").alias(f"_{c}") for c in ("book_id", "title", "rating_distribution_text", "reviews_text_block")))
    faults = {"repeated ids": F.col("n") > 1, "blank ids": F.col("_book_id"), "blank titles": F.col("_title"), "blank distributions": F.col("_rating_distribution_text"), "blank reviews": F.col("_reviews_text_block")}
    if ids is not None:
        per = per.join(ids.select(F.trim(F.col("book_id").cast("string")).alias("book_id")).distinct().withColumn("_wanted", F.lit(True)), "book_id", "full")
        faults |= {"ids missing": F.col("n").isNull(), "ids not expected": F.col("_wanted").isNull()}
    found = per.agg(*(m for i, f in enumerate(faults.values()) for m in (F.count_if(f).alias(f"n{i}"), F.min(F.when(f, F.col("book_id"))).alias(f"e{i}")))).head()
    if bad := [f"{name}: {found[f'n{i}']}, such as {found[f'e{i}']!r}" for i, name in enumerate(faults) if found[f"n{i}"]]:
        raise ValueError("; ".join(bad))
    return rows


def run_ids(log: DataFrame, items: DataFrame) -> DataFrame:
    """Ids of items that were run, whether they succeeded or failed."""
    return log.select("book_id").distinct().join(items.select("book_id").distinct(), "book_id", "left_semi")


def final_artifact(outputs: DataFrame, ids: DataFrame, size: int | None = None) -> tuple[DataFrame, dict]:
    """The final columns of a run's outputs, trimmed, and the details of their checks: see check_outputs(). The rows are written once before they are checked."""
    checks.require_columns(outputs, list(FINAL_COLUMNS))
    rows, storage = stored_tags(outputs.select(*FINAL_COLUMNS).withColumns({"book_id": text_or_empty(F.col("book_id")), "overall_judgment": text_or_empty(F.col("overall_judgment"))}))
    rows = materialise(rows, "final")
    found = check_outputs(rows, ids, size)
    # names of the details are fixed by what reads them
    return rows, {"final_output_rows": found["rows"], "sampled_books_expected": found["expected"], "all_book_ids_unique": True, "book_id_sets_match": True, "missing_from_final": 0, "extra_in_final": 0, "columns_written": list(FINAL_COLUMNS), "top_tags_storage_format": storage, "all_overall_judgment_non_empty": True, "all_top_tags_non_empty": True}
