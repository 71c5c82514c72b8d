import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import scalars as S
from foliant.operators import clustering, labels, search, summaries, tables
from foliant.plans.oracle import ORACLE
from foliant.plans.queries import QUERIES
from foliant.sources.raw import BOOK_DDL, books_table, read_json_lines

SF = "/root/testdata/sf0.001"
TABLES = "customer part orders lineitem events documents embeddings".split()


def rounded(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["similar_items_topk", "recommend_topn", "catalog_sample", "stratified_waterfall_sample", "shelf_clean_counts", "dense_index", "clean_drop_reasons", "top_reviews_concat"])
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    r = duck.execute(ORACLE[name])
    names = [d[0] for d in r.description]
    want = Counter(tuple(rounded(row[names.index(c)]) for c in sorted(names)) for row in r.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(rounded(row[c]) for c in sorted(names)) for row in df.collect()) == want


def test_numbers(spark):
    rows = spark.createDataFrame([("12", 12), (" 12 ", 12), ("12.0", 7), ("1_000", 7), ("", 7), (None, 7)], "s string, want int")
    assert all(r.got == r.want for r in rows.select("want", S.safe_int(F.col("s"), 7).alias("got")).collect())


def test_unknown_items_raise(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        search.similar_items(v, 9, 3)
    with pytest.raises(ValueError):
        search.persona(v, search.favorites_frame(spark, [(0, 9)]))


def test_weights_sum_to_one(spark):
    w = [r.weight for r in search.recency_weights(search.favorites_frame(spark, [(i, i) for i in range(5)])).orderBy("pos").collect()]
    assert math.isclose(sum(w), 1) and math.isclose(w[-1] / w[0], 4)


def test_malformed_lines(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"book_id":"1","title":" A ","ratings_count":"2000"}\nnot json\n\n[1]\n{"book_id":"2","title":"B","ratings_count":"5"}\n')
    raw = read_json_lines(spark, str(tmp_path / "b.json"), BOOK_DDL)
    assert raw.where("_bad").count() == 2
    assert [(r.book_id, r.title) for r in books_table(raw).collect()] == [("1", "A")]


def test_unique_labels():
    found = labels.unique_labels({0: ["Fantasy", "Horror"], 1: ["Horror", "Fantasy"], 2: [], 3: ["Fantasy", "Horror"]})
    assert len(set(found.values())) == 4 and found[2] == "Neighborhood 2"


def test_labels_beyond_generic_names(spark, monkeypatch):
    names = [*sorted(labels.GENERIC_DISPLAYS), "Alpha", "Beta", "Gamma", "Delta"]
    scored = spark.createDataFrame([(c, n, i + 1) for c in (0, 1) for i, n in enumerate(names)], "cluster_id int, name string, place int")
    monkeypatch.setattr(labels, "label_scores", lambda members: scored)
    assert {r.cluster_id: r.label for r in labels.cluster_labels(scored).collect()} == labels.unique_labels({0: names, 1: names})


def test_runner_resumes(spark):
    items = spark.createDataFrame([("1", "p"), ("2", "p")], "book_id string, prompt string")

    def client(prompt):
        return {"book_id": "1", "top_tags": ["a", "b"], "judgment": "good"}

    log = summaries.run_pending(items, client).cache()
    assert {r.book_id: r.ok for r in log.collect()} == {"1": True, "2": False}
    assert [r.book_id for r in summaries.pending(items, log).collect()] == ["2"]


def test_dedupe_is_ordered(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "k int, v string")
    assert sorted((r.k, r.v) for r in tables.dedupe(df, ["k"], [F.col("v")]).collect()) == [(1, "a"), (2, "c")]


def test_kmeans_ends_at_a_fixed_point(spark):
    items = QUERIES["spherical_kmeans"](spark, SF).collect()
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    assert len(items) == 24 and all(r.converged for r in items) and sum(r.cluster_size for r in items) == v.count()
    x = np.array([r.embedding for r in v.orderBy("vec_id").collect()], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    # no tolerance is met: unchanged labels alone end the rounds
    found = clustering.spherical_kmeans(v, 24, tolerance=-1.0)
    at = np.array([r.cluster_id for r in found.assignments.orderBy("vec_id").collect()])
    means = np.stack([x[at == j].sum(0) for j in range(24)])
    means /= np.linalg.norm(means, axis=1, keepdims=True)
    assert found.converged and found.rounds < 100 and (at == (x @ means.T).argmax(1)).all()
    assert all(a >= b - 1e-9 for a, b in zip(found.inertia, found.inertia[1:]))
    assert not clustering.spherical_kmeans(v, 24, max_rounds=1).converged
