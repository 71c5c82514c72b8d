"""What the operators share: the scratch folder, table reading, folds and word splitting."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.scratch import materialise, remove_path, scratch_path, scratch_root  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting has this value while the block runs."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def quoted(name: str) -> str:
    """A column's name, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def unused(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as set it apart from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bucketed(df: DataFrame, label: str, by: str, buckets: int) -> DataFrame:
    """As materialise(), with the rows of a value of column by in one bucket, so that what is grouped by it is not shuffled again."""
    spark, name = df.sparkSession, f"foliant_{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).option("path", scratch_path(spark, label)).option("compression", "zstd").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay until the driver ends
    return found


def fold_of(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids are in no fold."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(folds)


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(fold_of(id_col, folds) == F.lit(fold), F.lit(False))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the whole text with A-Z lowered: what bytes.lower() and bytes.split() do."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def finite_vector(col: Column, nonzero: bool = False) -> Column:
    """Not null, and no component null, NaN or infinite (and, if asked for, one of them not 0)."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = col.isNotNull() & (F.size(col) > 0) & ~bad
    return ok & F.exists(col, lambda x: x != 0) if nonzero else ok


def main_dimension(vectors: DataFrame, col: str) -> int:
    """The commonest vector length (ties: the shorter); 0 without vectors."""
    row = vectors.groupBy(F.size(col).alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    return int(row["dim"]) if row else 0


class Numbers(dict):
    """Numbers of chunks in order of arrival; fresh holds those whose ids are not known yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class Bank:
    """Ids of numbered chunks, one after the other. A chunk that must not be encoded by itself has length -1."""

    def __init__(self):
        self.flat, self.start, self.length = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        taken = np.maximum(lengths, 0)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(taken) - taken])
        self.length, self.flat = np.concatenate([self.length, lengths]), np.concatenate([self.flat, ids])

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the numbered chunks in a row, and how many each has."""
        each = np.maximum(self.length[numbers], 0)
        ends = np.cumsum(each)
        return self.flat[np.repeat(self.start[numbers] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)], each
