"""How served tables lie, so that a page reads the files it shows: members by cluster and rank, details by buckets of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.serve import enrich

BUCKET = "id_bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


def write_members(members: DataFrame, path: str, rows_a_file: int = 100_000) -> None:
    """Members partitioned by cluster_id and sorted by cluster_rank: a cluster's files are ranges of ranks, so that a large one is many tasks', and its first ranks lie in one file."""
    block = F.floor((F.col("cluster_rank") - 1) / rows_a_file)
    (members.withColumn("_block", block).repartition("cluster_id", "_block").sortWithinPartitions("cluster_id", "_block", "cluster_rank").drop("_block")
     .write.mode("overwrite").option("maxRecordsPerFile", rows_a_file).partitionBy("cluster_id").parquet(path))


def member_slice(spark: SparkSession, path: str, cluster_id: int, show: int | None = 10, details: str | None = None, key: str = "book_id") -> DataFrame:
    """A cluster's first members by rank (all for None): reads its partition, and of that the row groups that hold the ranks. With the path of details, rows come with them."""
    rows = spark.read.parquet(path).where(F.col("cluster_id") == cluster_id)
    rows = rows if show is None else rows.where(F.col("cluster_rank") <= show)
    return (rows if details is None else with_details(spark, rows, details, key)).orderBy("cluster_rank")


def write_details(details: DataFrame, path: str, buckets: int, key: str = "book_id") -> None:
    """Details in buckets folders by a hash of their ids, each sorted by id."""
    bucketed = details.withColumn(BUCKET, bucket_of(F.col(key), buckets))
    bucketed.repartition(buckets, BUCKET).sortWithinPartitions(BUCKET, key).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    spark = details.sparkSession
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{path}/_layout")


def details_of(spark: SparkSession, path: str, ids: list, key: str = "book_id") -> DataFrame:
    """The details of some ids: reads their buckets' files only."""
    buckets = spark.read.schema("buckets int").json(f"{path}/_layout/*.json").head()[0]
    found = spark.createDataFrame([(str(i),) for i in ids], "id string").select(bucket_of(F.col("id"), buckets)).distinct().collect()
    return spark.read.parquet(path).where(F.col(BUCKET).isin([r[0] for r in found]) & F.col(key).cast("string").isin([str(i) for i in ids])).drop(BUCKET)


def with_details(spark: SparkSession, rows: DataFrame, path: str, key: str = "book_id", page: int = 1000) -> DataFrame:
    """Rows with the details of their ids. A page of them looks its ids up; more are joined with the whole table."""
    some = [r[0] for r in rows.select(key).distinct().limit(page + 1).collect()]
    details = details_of(spark, path, some, key) if len(some) <= page else spark.read.parquet(path).drop(BUCKET)
    return enrich(rows, details, key)
