"""The pending-item runner as a stream: each run takes what has come since the last one, and its log is committed bit by bit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.summaries import OUTPUT_DDL, latest, pending, run_pending
from foliant.sources.scratch import materialise, path_exists
from foliant.sources.versions import write_version


def run_available(spark: SparkSession, source: str, ddl: str, checkpoint: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Feed the parquet files that are new under source to handle(batch, batch id), and end. A batch whose handling failed comes again, with the same id, in the next run."""
    stream = spark.readStream.schema(ddl).parquet(source)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """All records of the log, with the batch and the part that wrote them."""
    ddl = f"{OUTPUT_DDL}, batch long, part int"
    return spark.read.schema(ddl).json(f"{log}/records") if path_exists(spark, f"{log}/records") else spark.createDataFrame([], ddl)


def summarize_available(spark: SparkSession, source: str, log: str, checkpoint: str, client: Callable, *, parts: int = 16, **calls) -> None:
    """Call the client for the new items (book_id, prompt) under source that have no success in the log; failures of earlier runs come again when their items do.

    A batch is dealt in parts by a hash of the id. A part is a folder of the log, named by batch and part, that is marked when its calls are done; without the mark it is written over,
    so records are neither lost nor doubled. After a loss the batch comes again: marked parts, and items with a success in others, are left out; those of the part that was under way are called again.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        wanted = materialise(batch.select("book_id", "prompt").dropDuplicates(["book_id"]).withColumn("_part", F.pmod(F.xxhash64("book_id"), F.lit(parts)).cast("int")), "batch")
        for part in range(parts):
            path = f"{log}/records/batch={batch_id}/part={part}"
            if path_exists(session, f"{path}/_SUCCESS"):
                continue
            known = read_log(session, log).where(~((F.col("batch") == batch_id) & (F.col("part") == part)))
            rows = pending(wanted.where(F.col("_part") == part), known)
            run_pending(rows.select("book_id", "prompt"), client, **calls).write.mode("overwrite").json(path)

    run_available(spark, source, "book_id string, prompt string", checkpoint, handle)


def compact(spark: SparkSession, log: str, root: str) -> DataFrame:
    """The last record of each item as a new version of the table at root; readers get the one before until it is whole."""
    rows = latest(read_log(spark, log).drop("batch", "part"))
    name = write_version(rows, root)
    return spark.read.schema(rows.schema).parquet(f"{root}/versions/{name}")
