"""Vector functions on array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, use) -> Column:
    """use(value) with value computed once, also if use names it several times or inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalized(v: Column) -> Column:
    """Length 1; zero vectors stay zero."""
    return let(v, lambda u: let(F.greatest(norm(u), F.lit(EPS)), lambda n: F.transform(u, lambda x: x / n)))


def layer_norm(v: Column, eps: float = 1e-5) -> Column:
    mean = lambda u: F.aggregate(u, F.lit(0.0), lambda s, x: s + x) / F.size(u).cast("double")
    centred = let(v, lambda u: let(mean(u), lambda m: F.transform(u, lambda x: x - m)))
    return let(centred, lambda c: let(F.sqrt(dot(c, c) / F.size(c).cast("double") + F.lit(eps)), lambda d: F.transform(c, lambda x: x / d)))


def truncated_embedding(v: Column, width: int) -> Column:
    """Layer norm over the full width, then the first width components, then length 1."""
    return normalized(F.slice(layer_norm(v), 1, width))


def vector_sum(df: DataFrame, keys: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """Keys and the (weighted) sum of vectors, component by component."""
    w = F.col(weight) if weight else F.lit(1.0)
    parts = df.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_i", "_x")).groupBy(*keys, "_i").agg(F.sum(F.col("_w") * F.col("_x")).alias("_x"))
    return parts.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(vector))
