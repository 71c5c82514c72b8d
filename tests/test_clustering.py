import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import clustering


def plain_seeds(x, ids, u_of, k):
    """k-means++ races by comparing with all earlier seeds."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen = []
    for r in range(k):
        u = u_of(r)
        d = np.ones(len(x)) * np.inf if not chosen else np.clip(1 - (x @ x[chosen].T).max(1), 0, 2)
        t = [np.inf if not chosen or d[i] == 0 else -np.log(u[i]) / d[i] ** 2 for i in range(len(x))]
        chosen.append(min((i for i in range(len(x)) if i not in chosen), key=lambda i: (t[i], u[i], ids[i])))
    return x[chosen]


@pytest.mark.parametrize("kept", [3, 64])
def test_seeds_equal_plain_races(spark, kept, monkeypatch):
    monkeypatch.setattr(clustering, "SEEDS", kept)
    x = np.random.default_rng(4).normal(size=(120, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)

    def u_of(r):
        u = (F.pmod(F.xxhash64(F.lit(42), F.lit(r), F.col("vec_id")), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
        return [row.u for row in df.select("vec_id", u.alias("u")).orderBy("vec_id").collect()]

    assert np.allclose(clustering.seed_centroids(df, 10, 42, "vec_id", "embedding"), plain_seeds(x, range(120), u_of, 10))


def test_source_is_read_once_and_a_round_is_one_job(spark):
    read = spark.sparkContext.accumulator(0)

    def made(i):
        read.add(1)
        return [1.0 + i % 4, float(i % 7), (i * 37 % 11) / 3]

    vector = F.udf(made, "array<double>").asNondeterministic()  # else the filter and the projection each call it
    df = spark.range(0, 210, 1, 3).select(F.col("id").alias("vec_id"), vector("id").alias("embedding"))
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("kmeans", "jobs of one fit")
    found = clustering.spherical_kmeans(df, 5)
    assert found.assignments.count() == 210
    context.setLocalProperty("spark.jobGroup.id", None)
    assert read.value == 210
    # written; counted; a job a seed and a round; the final sum; this test's count. An adaptive query runs a shuffle's stages as a job of their own.
    assert len(tracker.getJobIdsForGroup("kmeans")) <= 1 + 2 + 5 + 2 * found.rounds + 2 + 2


def test_rows_without_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in clustering.assign(df, np.eye(2), "vec_id", "embedding").collect()}
    assert (rows[1].cluster_id, rows[3].cluster_id, rows[2].cluster_id, rows[2].similarity) == (0, 1, None, None)
    assert sorted(r.vec_id for r in clustering.spherical_kmeans(df, 2).assignments.collect()) == [1, 3]


def test_sizes_of_empty_clusters(spark):
    df = spark.createDataFrame([(0,), (0,), (2,)], "cluster_id int")
    assert tuple(clustering.size_stats(df, 4).head()) == (4, 0, 0.5, 2, 3) and tuple(clustering.size_stats(df).head()) == (2, 1, 1.5, 2, 3)
    with pytest.raises(Exception, match="a member of none"):
        clustering.size_stats(df, 2).collect()
