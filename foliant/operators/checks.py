"""Checks that raise with examples of what is wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def existing_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def expect_none(bad: DataFrame, what: str) -> None:
    if rows := bad.limit(10).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def expect_unique(df: DataFrame, key: str) -> None:
    expect_none(df.groupBy(key).count().where("count > 1"), f"{key} repeats")


def expect_non_blank(df: DataFrame, column: str) -> None:
    expect_none(df.where(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")) == "").select(column), f"{column} is blank")


def expect_keys(df: DataFrame, expected: DataFrame, key: str) -> None:
    expect_none(expected.select(key).join(df, key, "left_anti"), f"{key} missing")
    expect_none(df.select(key).join(expected, key, "left_anti"), f"{key} not expected")


def expect_group_size(df: DataFrame, key: str, size: int) -> None:
    expect_none(df.groupBy(key).count().where(F.col("count") != size), f"groups of {key} that are not of {size}")


def expect_in(df: DataFrame, column: str, values: list) -> None:
    """Every value is one of values; null is none."""
    expect_none(df.where(~F.coalesce(F.col(column).isin(values), F.lit(False))).select(column).distinct(), f"{column} is none of {values}")


def expect_rows(df: DataFrame, least: int, what: str) -> DataFrame:
    if (n := df.limit(least).count()) < least:
        raise ValueError(f"{what}: {n} rows, {least} needed")
    return df


def expect_finite_vectors(df: DataFrame, vector: str, width: int) -> None:
    bad = F.col(vector).isNull() | (F.size(vector) != width) | F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    expect_none(df.where(bad).select(vector), f"{vector} is not finite, or not of {width}")
