"""Spherical k-means on Spark: fused assignment and sums in each round, centroids on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import checks
from foliant.operators.labels import cluster_labels, label_scores, shelf_scores
from foliant.operators.tables import placed
from foliant.sources.scratch import materialise


@dataclass(frozen=True)
class Clusters:
    assignments: DataFrame  # id, cluster_id, similarity
    centroids: np.ndarray
    inertia: list[float]
    rounds: int
    converged: bool


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def assign(items: DataFrame, centroids: np.ndarray, id_col: str, vector: str) -> DataFrame:
    """id, cluster_id and similarity; the first of equal similarities wins. A row without a vector has neither."""
    c = _unit(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                there = np.asarray(b.column(1).is_valid())
                s = _unit(_matrix(b.column(1).drop_null())) @ c.T if there.any() else np.zeros((0, len(c)))
                at, best = np.zeros(len(b), np.int32), np.zeros(len(b))
                at[there], best[there] = s.argmax(1), s.max(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, mask=~there), pa.array(best, mask=~there)], names=[id_col, "cluster_id", "similarity"])

    return items.select(id_col, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, f"{id_col} {items.schema[id_col].dataType.simpleString()}, cluster_id int, similarity double")


#: Seeds that a row is compared with before its least distance is written beside it: below that, comparing takes less than writing the vectors again.
SEEDS = 64


def prepared(items: DataFrame, id_col: str, vector: str) -> DataFrame:
    """id and vector of the rows that have one, written once: whatever made them is not run again in each round."""
    return materialise(items.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<double>").alias(vector)), "vectors")


def seed_centroids(items: DataFrame, k: int, seed: int, id_col: str, vector: str) -> np.ndarray:
    """k-means++ by weighted races: in each round the row with the least -ln(u) / d^2, u hashed from seed, round and id, is the next centroid (the least u where all distances are 0).

    A round is one job that reads the vectors once and brings back one row with its vector. A row's least distance is kept beside it, and written again after each SEEDS seeds, so that a row meets at most SEEDS of them in a round.
    """
    n = items.count()
    if not 1 <= k <= n:
        raise ValueError(f"k must be from 1 to {n}")
    now, chosen, ids, written = items.select(id_col, vector).withColumn("_least", F.lit(2.0)), [], [], 0
    kind = items.schema[id_col].dataType.simpleString()

    def least(b: pa.RecordBatch, seeds: np.ndarray) -> np.ndarray:
        d = np.asarray(b.column(2))
        return np.minimum(d, np.clip(1 - (_unit(_matrix(b.column(1))) @ seeds.T).max(1), 0, 2)) if len(seeds) else d

    for r in range(k):
        if r - written == SEEDS:
            seeds = np.array(chosen[written:])

            def kept(batches: Iterator[pa.RecordBatch], seeds: np.ndarray = seeds) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    if len(b):
                        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least(b, seeds))], names=[id_col, vector, "_least"])

            now, written = materialise(now.mapInArrow(kept, f"{id_col} {kind}, {vector} array<double>, _least double"), "least"), r
        seeds = np.array(chosen[written:])

        def raced(batches: Iterator[pa.RecordBatch], seeds: np.ndarray = seeds, first: bool = r == 0) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if len(b):
                    u = np.asarray(b.column(3))
                    d2 = np.zeros(len(b)) if first else least(b, seeds) ** 2
                    t = np.full(len(b), np.inf)
                    np.divide(-np.log(u), d2, out=t, where=d2 > 0)
                    best = np.flatnonzero(t == t.min())
                    best = best[u[best] == u[best].min()]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(best)), b.column(1).take(pa.array(best)), pa.array(t[best]), pa.array(u[best])], names=[id_col, vector, "_t", "_u"])

        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(r), F.col(id_col)), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
        race = now.where(~F.col(id_col).isin(ids)) if ids else now
        row = race.select(id_col, vector, "_least", u.alias("_u")).mapInArrow(raced, f"{id_col} {kind}, {vector} array<double>, _t double, _u double").orderBy("_t", "_u", id_col).limit(1).collect()[0]
        ids.append(row[id_col])
        chosen.append(_unit(np.array(row[vector], dtype=np.float64)))
    return np.array(chosen)


def spherical_kmeans(items: DataFrame, k: int, *, max_rounds: int = 100, tolerance: float = 1e-5, seed: int = 42, id_col: str = "vec_id", vector: str = "embedding") -> Clusters:
    """Rounds of one job each: a row per task and cluster (sum, count, similarity, rows whose label is new), summed by cluster. Clusters left empty move to the rows furthest from theirs.

    Vectors are written once, and that table is what the k seeds, the rounds and the final assignment each read once. Rows without a vector take no part, and are not assigned.
    Rounds end when no label changes, when no centroid moves by tolerance, or after max_rounds; converged is false in the last case.
    """
    items = prepared(items, id_col, vector)
    c, history, converged = seed_centroids(items, k, seed, id_col, vector), [], False
    dim, before = c.shape[1], None

    for rounds in range(1, max_rounds + 1):  # noqa: B007
        here = c

        def run(batches: Iterator[pa.RecordBatch], here: np.ndarray = here, before: np.ndarray | None = before) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, dim + 3))
            for b in batches:
                if len(b):
                    x = _unit(_matrix(b.column(0)))
                    s = x @ here.T
                    at = s.argmax(1)
                    new = np.ones(len(x)) if before is None else (x @ before.T).argmax(1) != at
                    np.add.at(total, at, np.column_stack([x, np.ones(len(x)), 1 - s.max(1), new]))
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32())] + [pa.array(total[:, j]) for j in range(dim + 3)], names=["cluster_id", *(f"x{j}" for j in range(dim + 3))])

        found = items.select(vector).mapInArrow(run, "cluster_id int, " + ", ".join(f"x{j} double" for j in range(dim + 3))).groupBy("cluster_id").agg(*(F.sum(f"x{j}").alias(f"x{j}") for j in range(dim + 3))).collect()
        total = np.zeros((k, dim + 3))
        for r in found:
            total[r[0]] = r[1:]
        history.append(float(total[:, dim + 1].sum()))
        if not total[:, dim + 2].any():
            converged = True
            break
        new = _unit(total[:, :dim])
        if len(empty := np.flatnonzero(total[:, dim] == 0)):
            far = assign(items, here, id_col, vector).orderBy("similarity", id_col).limit(len(empty)).join(items, id_col).orderBy("similarity", id_col).collect()
            for j, r in zip(empty, far, strict=False):
                new[j] = _unit(np.array(r[vector], dtype=np.float64))
        moved = float((1 - (new * here).sum(1)).max())
        before, c = here, new
        if moved < tolerance:
            converged = True
            break
    final = assign(items, c, id_col, vector)
    history.append(float(final.agg(F.sum(1 - F.col("similarity"))).head()[0] or 0.0))
    return Clusters(final, c, history, rounds, converged)


def rank_members(assigned: DataFrame, id_col: str = "vec_id", representatives: int = 5) -> DataFrame:
    """Rank by similarity in each cluster, from 1; its size; and whether it represents the cluster. All clusters are sorted in ranges, so that a large one is not one task's; a cluster's rank is its place less those of the clusters before."""
    ranked = placed(assigned, [F.col("cluster_id"), F.desc("similarity"), F.col(id_col)], "_place")
    sizes = assigned.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    before = F.coalesce(F.sum("cluster_size").over(Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per cluster
    ranked = ranked.join(F.broadcast(sizes.withColumn("_before", before)), "cluster_id").withColumn("cluster_rank", (F.col("_place") - F.col("_before")).cast("int")).drop("_place", "_before")
    return ranked.withColumn("is_representative", F.col("cluster_rank") <= representatives)


def size_stats(assigned: DataFrame, k: int | None = None) -> DataFrame:
    """How many clusters there are, the least, median and most members, and all members. With k, the clusters are 0 to k - 1, those without members among them, and members that are of none raise."""
    n = assigned.groupBy("cluster_id").agg(F.count("*").alias("n"))
    if k is not None:
        known = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster_id"))
        n = known.join(n, "cluster_id", "full").select(F.when(F.col("cluster_id").between(0, k - 1), F.coalesce("n", F.lit(0))).otherwise(F.raise_error(F.lit(f"a member of none of {k} clusters")).cast("long")).alias("n"))
    return n.agg(F.count("*").alias("clusters"), F.min("n").alias("least"), F.percentile("n", 0.5).alias("median"), F.max("n").alias("most"), F.sum("n").alias("members"))


def top_shelves(members: DataFrame, most: int = 8) -> DataFrame:
    """cluster_id, shelf, score and place of each cluster's heaviest cleaned shelves; ties in alphabetical order."""
    scores = shelf_scores(members)
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), "shelf"))).where(F.col("place") <= most)


def cluster_summary(members: DataFrame, names: DataFrame, representatives: int = 5) -> DataFrame:
    """A row per cluster: label, size, the names chosen for it, its 8 best names with raw scores of two decimals, its 8 heaviest shelves, and titles of its representatives. members: cluster_id, cluster_rank, book_id, title, popular_shelves; names: cluster_id, label."""
    listed = lambda df, key, value, name: df.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), value.alias("v")))), lambda s: s["v"]).alias(name))
    best = label_scores(members).where("place <= 8")
    out = members.groupBy("cluster_id").agg(F.count("*").alias("cluster_size")).join(names, "cluster_id", "left")
    out = out.join(listed(best, F.col("place"), F.struct(F.col("name").alias("label"), F.round("raw", 2).alias("score")), "top_family_scores"), "cluster_id", "left")
    out = out.join(listed(top_shelves(members), F.col("place"), F.col("shelf"), "top_cleaned_shelves"), "cluster_id", "left")
    out = out.join(listed(members.where(F.col("cluster_rank") <= representatives), F.col("cluster_rank"), F.col("title"), "representative_titles"), "cluster_id", "left")
    return out.withColumn("selected_label_families", F.split(F.regexp_replace("label", " I{2,}$", ""), " · "))


def build_clusters(vectors: DataFrame, books: DataFrame, k: int = 24, *, key: str = "book_id", vector: str = "embedding", max_rounds: int = 100, tolerance: float = 1e-5, seed: int = 42, representatives: int = 5) -> tuple[DataFrame, DataFrame]:
    """The whole job: checks, clusters, ranks, labels; a table of books (with cluster_id, cluster_label, cluster_size, cluster_rank, centroid_similarity, centroid_distance, is_representative) and one of clusters.

    Raises for blank or repeated ids, vectors that aren't finite or of one width, books without a vector and the other way round, and clusters that stay empty.
    """
    checks.require_columns(books, [key, "title", "popular_shelves"])
    checks.expect_non_blank(books, key)
    checks.expect_unique(books, key)
    checks.expect_keys(vectors.select(key), books.select(key), key)
    checks.expect_finite_vectors(vectors, vector, len(checks.expect_rows(vectors, k, "vectors").head()[vector]))
    found = spherical_kmeans(vectors, k, max_rounds=max_rounds, tolerance=tolerance, seed=seed, id_col=key, vector=vector)
    ranked = materialise(rank_members(found.assignments, key, representatives).join(books.select(key, "title", "popular_shelves"), key), "clusters")
    if (n := ranked.select("cluster_id").distinct().count()) != k:
        raise ValueError(f"{n} clusters of {k} have members")
    names = cluster_labels(ranked)
    out = ranked.join(F.broadcast(names.withColumnRenamed("label", "cluster_label")), "cluster_id", "left")
    table = out.select(key, "title", "cluster_id", "cluster_label", F.col("cluster_size").cast("int").alias("cluster_size"), F.col("cluster_rank").cast("int").alias("cluster_rank"), F.col("similarity").cast("float").alias("centroid_similarity"), (1 - F.col("similarity")).cast("float").alias("centroid_distance"), "is_representative")
    return table, cluster_summary(ranked, names, representatives)
