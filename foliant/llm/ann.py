"""Approximate nearest neighbours: inverted lists of coarse centroids, product-quantised residuals, exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import finite_vector, main_dimension, materialise, quoted, read_table


@dataclass(frozen=True)
class IvfPq:
    """coarse: lists x dim; books: parts x codes x dim/parts (zero-padded dim)."""

    coarse: np.ndarray
    books: np.ndarray
    dim: int

    @property
    def padded(self) -> int:
        return self.books.shape[0] * self.books.shape[2]

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x, ((0, 0), (0, self.padded - x.shape[1])))

    def nearest_lists(self, x: np.ndarray, n: int) -> np.ndarray:
        d = squared(x, self.coarse)
        return np.argsort(d, axis=1, kind="stable")[:, :n]

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        r = self.pad(x - self.coarse[lists]).reshape(len(x), len(self.books), -1)
        return np.stack([squared(r[:, p], b).argmin(1) for p, b in enumerate(self.books)], axis=1).astype(np.uint8)

    def constants(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Of rows coded as codes in lists: |r|^2 + 2 c.r for the residual r that the codes stand for and its centroid c."""
        r = np.concatenate([b[codes[:, p]] for p, b in enumerate(self.books)], axis=1)
        return (r * r).sum(1) + 2 * (r * self.pad(self.coarse)[lists]).sum(1)

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Of each query q: parts x codes values of -2 q.r. With |q - c|^2 and a row's constant they add up to the squared distance |q - c - r|^2."""
        q = self.pad(x).reshape(len(x), len(self.books), -1)
        return np.stack([-2 * q[:, p] @ b.T for p, b in enumerate(self.books)], axis=1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from k rows; a centre left without rows moves to the row furthest from its own."""
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    for _ in range(rounds):
        d = squared(x, c)
        at, far = d.argmin(1), d.min(1)
        n = np.bincount(at, minlength=k)
        order, own = np.argsort(at, kind="stable"), np.flatnonzero(n)
        c[own] = np.add.reduceat(x[order], (np.cumsum(n) - n)[own]) / n[own, None]
        for j in np.flatnonzero(n == 0):
            c[j], far[far.argmax()] = x[far.argmax()], -1
    return c


def fit_index(sample: np.ndarray, lists: int, parts: int = 16, codes: int = 256, rounds: int = 12, seed: int = 42) -> IvfPq:
    rng = np.random.default_rng(seed)
    coarse = kmeans(sample, lists, rounds, rng)
    residual = sample - coarse[squared(sample, coarse).argmin(1)]
    parts = min(parts, sample.shape[1])
    width = math.ceil(sample.shape[1] / parts)
    r = np.pad(residual, ((0, 0), (0, parts * width - sample.shape[1]))).reshape(len(sample), parts, width)
    books = [kmeans(r[:, p], codes, rounds, rng) for p in range(parts)]
    most = max(map(len, books))
    return IvfPq(coarse, np.stack([np.pad(b, ((0, most - len(b)), (0, 0)), mode="edge") for b in books]), sample.shape[1])


def ann_search(vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, sample_rows: int = 20_000, probe_share: float = 0.75, min_probes: int = 8, rerank: int = 200, shard_rows: int = 32_768, block_rows: int = 1024, chunk_rows: int = 1024) -> DataFrame:
    """The k nearest found (Euclidean) of vectors for each row of queries, its own id left out: query_id, rank, vec_id, score.

    The index is fitted on the sample_rows rows lowest by hash of id (so it has a list for five of them at most), and holds every row: each has its list, codes and constant. Rows lie in shards of about shard_rows, queries in blocks of about block_rows; each pair of them is a task.
    There a query adds up its distance table over the codes of all rows in its nearest lists (probe_share of them, min_probes at least). The rerank nearest by it, and all that tie with the last of them, get their true distance (chunk_rows at a time), and the k best go on: rerank of shard_rows rows is the share of exact comparisons.
    Of equal vectors, only the k + 1 smallest ids can be answers, so only those go into shards; a large group of copies or ties makes no more than k rows a query and task.

    Null or zero vectors, and ones with null or non-finite components, take no part, nor do null ids or lengths other than the commonest. Ties go to the smaller id; a repeated row counts each time. Empty tables give no rows. Other columns are ignored.
    """
    own = lambda df: df.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).alias("v")).where(F.col("id").isNotNull() & finite_vector(F.col("v"), nonzero=True))
    rows, asked = own(vectors), own(queries)
    dim = main_dimension(rows, "v")
    rows, asked = (x.where(F.size("v") == dim) for x in (rows, asked))
    sample = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()], dtype=np.float64)
    out = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return rows.sparkSession.createDataFrame([], out)
    total = rows.count()
    index = fit_index(sample, max(1, min(round(math.sqrt(total)), len(sample) // 5)))
    probes = min(len(index.coarse), max(min_probes, round(probe_share * len(index.coarse))))
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.array(b.column(1).to_pylist(), dtype=np.float64)
                at = shared.value.nearest_lists(x, 1)[:, 0]
                codes = shared.value.encode(x, at)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(shared.value.constants(at, codes))], names=["id", "v", "place", "code", "const"])

    first = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("_r") <= k + 1).drop("_r")
    held = materialise(first.mapInArrow(assign, f"id long, v {rows.schema['v'].dataType.simpleString()}, place int, code binary, const double"), "ann-lists")
    shards, blocks = max(1, math.ceil(held.count() / shard_rows)), max(1, math.ceil(asked.count() / block_rows))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", deal(blocks)).withColumn("shard", spread(shards))
    right = held.withColumn("shard", deal(shards)).withColumn("block", spread(blocks))

    def scan(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(r):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        model = shared.value
        r = r.sort_values(["place", "id"], kind="stable")
        x, y = (np.stack(s.to_numpy()).astype(np.float64) for s in (q["v"], r["v"]))
        ids, place, const = r["id"].to_numpy(), r["place"].to_numpy(), r["const"].to_numpy()
        codes = np.frombuffer(b"".join(r["code"]), dtype=np.uint8).reshape(len(r), -1).T
        tables, coarse = model.tables(x), squared(x, model.coarse)
        found: list[list[np.ndarray]] = [[], [], []]
        for i, v, table, near_list in zip(q["id"].to_numpy(), x, tables, coarse, strict=True):
            probed = np.zeros(len(near_list), bool)
            probed[np.argsort(near_list, kind="stable")[:probes]] = True
            near = np.flatnonzero(probed[place] & (ids != i))
            if len(near) > rerank:
                rough = const[near] + near_list[place[near]]
                for part, code in zip(table, codes, strict=True):
                    rough += part[code[near]]
                cut = np.partition(rough, rerank - 1)[rerank - 1]
                near = near[rough <= cut + 1e-9 * abs(cut)]
            best, d = near[:0], np.zeros(0)
            for at in range(0, len(near), chunk_rows):
                some = near[at : at + chunk_rows]
                best, d = np.concatenate([best, some]), np.concatenate([d, np.sqrt(((y[some] - v) ** 2).sum(1))])
                top = np.lexsort((ids[best], d))[:k]
                best, d = best[top], d[top]
            for col, part in zip(found, (np.full(len(best), i), ids[best], d), strict=True):
                col.append(part)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, found), strict=True)))

    tops = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(scan, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return tops.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann_search(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES = {"op8_ann": op8_ann}
ORACLE_SQL: dict[str, str] = {}
