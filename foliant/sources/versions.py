"""Tables that are replaced whole: a new version is written beside the old ones, and a pointer to it is put in place last."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

POINTER, VERSIONS = "CURRENT", "versions"


def _store(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, root: str) -> str | None:
    """The name of the version that readers get; None before the first."""
    target, store = _store(spark, f"{root}/{POINTER}")
    return spark.read.text(f"{root}/{POINTER}").head()[0] if store.exists(target) else None


def write_version(df: DataFrame, root: str) -> str:
    """Write df as a new version, then swap the pointer. df may read the version that it replaces; a run that ends before the swap leaves that one in place."""
    from foliant.sources.matrices import write_bytes

    spark, name = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{root}/{VERSIONS}/{name}")
    write_bytes(spark, f"{root}/{POINTER}.{name}", name.encode())
    old, store = _store(spark, f"{root}/{POINTER}.{name}")
    new, _ = _store(spark, f"{root}/{POINTER}")
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(old, new, options)
    return name


def read_version(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """The current version; an empty table before the first."""
    name = current_version(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/{VERSIONS}/{name}") if name else spark.createDataFrame([], schema)


def drop_old_versions(spark: SparkSession, root: str) -> int:
    """Remove versions other than the current one, once nothing reads them any more; how many there were."""
    name, (target, store) = current_version(spark, root), _store(spark, f"{root}/{VERSIONS}")
    if not store.exists(target):
        return 0
    gone = [f.getPath() for f in store.listStatus(target) if f.getPath().getName() != name]
    for path in gone:
        store.delete(path, True)
    return len(gone)
