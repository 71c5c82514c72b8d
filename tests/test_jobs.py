import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import clustering, labels, search, serve, summaries, tables, text_search
from foliant.operators.language import strict_english, train_languages
from foliant.plans.job import preprocess
from foliant.sources import matrices
from foliant.sources.raw import id_list, line_id, lines_of, read_json_lines, skipped_books, raw_books


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(1)
    return np.vstack([rng.normal(size=(20, 6)) * 0.1 + 3 * np.eye(6)[j] for j in range(4)])


@pytest.fixture(scope="module")
def vectors(spark, points):
    return spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>")


def test_kmeans_equals_lloyd(vectors, points):
    """From the same seeds, plain Lloyd rounds on unit vectors give the same labels and centroids."""
    x, c, before = unit(points), clustering.seed_centroids(vectors, 4, 42, "vec_id", "embedding"), None
    assert len({tuple(r) for r in c.round(9)}) == 4 and np.allclose(np.linalg.norm(c, axis=1), 1)
    while True:
        at = (x @ c.T).argmax(1)
        if before is not None and (at == before).all():
            break
        before, c = at, unit(np.array([x[at == j].sum(0) for j in range(4)]))
    found = clustering.spherical_kmeans(vectors, 4, tolerance=0.0)
    assert found.converged and np.allclose(found.centroids, c)
    assert [r.cluster_id for r in found.assignments.orderBy("vec_id").collect()] == at.tolist()
    assert all(a >= b - 1e-9 for a, b in zip(found.inertia, found.inertia[1:]))


def test_kmeans_of_copies_and_bounds(spark):
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, [0.0, 1.0])], "vec_id long, embedding array<double>")
    found = clustering.spherical_kmeans(same, 3, max_rounds=5)
    assert len(found.centroids) == 3 and found.assignments.count() == 6
    with pytest.raises(ValueError):
        clustering.spherical_kmeans(same, 7)


def test_ranks_of_a_large_cluster(spark):
    rows = [(i, 0 if i < 300 else i % 3, (i * 7919 % 1000) / 1000) for i in range(400)] + [(10**12, 0, 0.5)]
    ranked = clustering.rank_members(spark.createDataFrame(rows, "vec_id long, cluster_id int, similarity double").repartition(7), representatives=3).collect()
    for c in range(3):
        own = sorted((r for r in ranked if r.cluster_id == c), key=lambda r: r.cluster_rank)
        assert [r.cluster_rank for r in own] == list(range(1, len(own) + 1)) and {r.cluster_size for r in own} == {len(own)}
        assert [r.vec_id for r in own] == [i for _, i in sorted((-s, i) for i, k, s in rows if k == c)]
        assert [r.is_representative for r in own] == [r.cluster_rank <= 3 for r in own]


def test_dense_index_of_far_ids(spark):
    ids = [5, 5, None, -(10**15), 10**15, *range(100, 400)]
    got = tables.dense_index(spark.createDataFrame([(i,) for i in ids], "k long"), "k", "idx").collect()
    assert {r.k: r.idx for r in got} == {k: i for i, k in enumerate(sorted({i for i in ids if i is not None}))}


@pytest.mark.parametrize("names, want", [
    ({0: ["A", "B", "C"], 1: ["A", "B", "D"], 2: ["A", "B", "C", "D", "E"]}, {0: "A · B · C", 1: "A · B · D", 2: "A · D · C"}),
    ({0: ["A", "B"], 1: ["B", "A"], 2: ["A", "B"]}, {0: "A · B", 1: "B · A II", 2: "A · B II"}),
    ({0: ["A"], 1: ["A"], 2: ["A"], 3: []}, {0: "A", 1: "A II", 2: "A III", 3: "Neighborhood 3"}),
])
def test_unique_labels(names, want):
    assert labels.unique_labels(names) == want


def test_cluster_job(spark, vectors):
    v = vectors.select(F.col("vec_id").cast("string").alias("book_id"), "embedding")
    books = v.select("book_id", F.concat(F.lit("t"), "book_id").alias("title"), F.lit("sci-fi,vampire,to-read").alias("popular_shelves"))
    members, summary = clustering.build_clusters(v, books, 4)
    rows = members.collect()
    assert len(rows) == 80 and {r.cluster_size for r in rows} == {20} and all(abs(r.centroid_similarity + r.centroid_distance - 1) < 1e-6 for r in rows)
    summed = summary.orderBy("cluster_id").collect()
    assert len({r.label for r in summed}) == 4 and all(len(r.representative_titles) == 5 and r.top_cleaned_shelves == ["science-fiction", "vampires"] for r in summed)
    assert [r.cluster_size for r in serve.cluster_list(members).collect()] == [20] * 4
    assert serve.neighborhood(members, 1, None).count() == 20 and serve.neighborhood(members, 1).count() == 10
    assert serve.shown_caption(7, 10) == "Top 7 most central to this neighborhood" and serve.shown_caption(7, None) == "All 7 books in this neighborhood"
    with pytest.raises(ValueError, match="not expected"):
        clustering.build_clusters(v, books.where("book_id <> '3'"), 4)


def test_thematic_search(spark):
    encoder = text_search.word_hash_encoder(32)
    books = spark.createDataFrame([("1", "whales at sea"), ("2", "court and king"), ("3", None)], "book_id string, title string")
    items = text_search.encode_items(books, encoder, None, text_col="title")
    assert [round(float(np.linalg.norm(r.embedding)), 5) for r in items.orderBy("book_id").collect()] == [1.0, 1.0, 0.0]
    v = text_search.encode_items(books, encoder, 16, text_col="title", prefix=text_search.QUERY_PREFIX)
    best = text_search.thematic_search(v, books, " whales at sea ", encoder, 1, width=16).collect()
    assert [(r.book_id, r.score) for r in best] == [("1", 1.0)]
    nothing = text_search.thematic_search(v, books, "  ", encoder, width=16)
    assert nothing.count() == 0 and nothing.columns == ["book_id", "title", "score"]


def test_search_and_recommend_edges(spark, vectors):
    assert search.top_k_cosine(vectors.where("false"), [1.0] * 6, 5).count() == 0
    assert search.top_k_cosine(vectors, [1.0] * 6, 500).count() == 80
    meta = vectors.select("vec_id", F.lit("t").alias("title"), F.lit(4.0).alias("average_rating"))
    some = search.recommend(vectors, search.favorites_frame(spark, [(0, 1)]), meta, 3)
    none = search.recommend(vectors, search.favorites_frame(spark, [(0, 10**6)]), meta, 3)
    assert some.count() == 3 and none.count() == 0 and set(none.columns) == set(some.columns)


def test_favorites_and_modes(spark):
    books = spark.createDataFrame([("a", "A", 4.0, 10), ("b", "B", 5.0, 2)], "book_id string, title string, average_rating double, ratings_count int")
    assert [(r.book_id, r._fav_order) for r in serve.favorites_page(books, ["b", "x", "a", "b"]).collect()] == [("b", 1), ("a", 3)]
    mode, rows = serve.recommendations(books, [], None)
    assert mode == "top_rated" and [r.rank for r in rows.orderBy("rank").collect()] == [1, 2]
    assert serve.recommendations(books, ["a"], lambda liked, n: (liked, n)) == ("personalized", (["a"], 5))


def test_artifacts(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")
    assert serve.require_artifacts(spark, [f"{tmp_path}/t"], [f"{tmp_path}/no"]) == []
    with pytest.raises(FileNotFoundError, match="/no"):
        serve.require_artifacts(spark, [f"{tmp_path}/no"])
    held = serve.Artifacts(spark)
    assert held.table(f"{tmp_path}/t") is held.table(f"{tmp_path}/t") and held.table(f"{tmp_path}/t").count() == 3
    held.clear()


def test_matrices_and_lists(spark, tmp_path):
    x = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "m.npy", x)
    df = matrices.read_matrix(spark, f"{tmp_path}/m.npy")
    assert [r.embedding for r in df.orderBy("row").collect()] == x.tolist()
    assert matrices.write_matrix(df, f"{tmp_path}/n.npy", "row") == 4 and (np.load(tmp_path / "n.npy") == x).all()
    assert matrices.aligned(df, df) == 4
    with pytest.raises(ValueError):
        matrices.aligned(df, df.limit(2))
    with pytest.raises(ValueError, match="several widths"):
        matrices.write_matrix(df.unionByName(spark.createDataFrame([(9, [1.0])], "row long, embedding array<float>")), f"{tmp_path}/o.npy", "row")
    ids = spark.createDataFrame([(1, "é"), (0, "b")], "rank int, book_id string")
    matrices.write_id_list(ids, f"{tmp_path}/ids.json")
    assert json.loads((tmp_path / "ids.json").read_text()) == ["b", "é"]
    assert [(r["rank"], r.id) for r in id_list(spark, f"{tmp_path}/ids.json").orderBy("rank").collect()] == [(0, "b"), (1, "é")]
    matrices.write_index_map(ids, f"{tmp_path}/map", "book_id", "rank")
    assert {json.loads(r.value)["book_id"] for r in spark.read.text(f"{tmp_path}/map").collect()} == {"b", "é"}


def test_final_artifact(spark):
    row = ("1", "T", " good ", ["p"], ["n"], [" a ", ""])
    ddl = "book_id string, title string, overall_judgment string, positive_aspects array<string>, negative_aspects array<string>, top_tags array<string>"
    ids = spark.createDataFrame([("1",)], "book_id string")
    rows, details = summaries.final_artifact(spark.createDataFrame([row], ddl), ids)
    assert [(r.overall_judgment, r.top_tags) for r in rows.collect()] == [("good", ["a"])] and details["top_tags_storage_format"] == "list" and details["final_output_rows"] == 1
    for bad in ((*row[:2], " ", *row[3:]), (*row[:5], [" "]), ("2", *row[1:])):
        with pytest.raises(ValueError):
            summaries.final_artifact(spark.createDataFrame([bad], ddl), ids)
    texts = spark.createDataFrame([('["é", " "]',), (" plain ",), (None,), ("{}",)], "top_tags string")
    stored, kind = summaries.stored_tags(texts)
    assert [r.top_tags for r in stored.collect()] == ['["é"]', "plain", "", "{}"] and kind == "json_string"


def test_log_jobs(spark, tmp_path):
    empty = summaries.compacted(summaries.empty_log(spark), f"{tmp_path}/log")
    assert empty.count() == 0 and "judgment" in empty.columns
    averages = summaries.run_averages(spark.createDataFrame([(False, 1, 2)], "ok boolean, input_chars int, output_tokens int")).head()
    assert averages.mean_input_chars is None
    assert summaries.string_list("a, b", 3) == [] and summaries.string_list([" a ", "", 2], 3) == ["a", "2"]


def test_text_and_line_filters(spark):
    model = train_languages(spark.createDataFrame([("the sea and the whales of the sea are many and wide", "en"), ("der Hund und die Katze sind nicht auf dem Dach der Maus", "de")], "text string, lang string"))
    df = spark.createDataFrame([("The sea is wide and the whales of it are many",), ("short",), (None,), ("Der Hund und die Katze sind nicht auf dem Dach mit der Maus",)], "t string")
    assert [r[0] for r in df.select(strict_english(F.col("t"), model.detect)).collect()] == [True, False, False, False]
    lines = spark.createDataFrame([('{"book_id": "12", "x": "\\"book_id\\": 7"}',), ("junk",), ('{"book_id":7}',)], "value string")
    assert [r[0] for r in lines.select(line_id(F.col("value"))).collect()] == ["12", "", "7"]
    assert lines_of(lines, spark.createDataFrame([(7,)], "book_id long")).count() == 1


def test_preprocess(spark, tmp_path):
    def write(name, rows):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("\n".join(map(json.dumps, rows)) + "\nnot json\n")

    write("books.json.gz", [{"book_id": str(i), "work_id": "w", "title": f" T{i} ", "ratings_count": str(1000 + i if i < 4 else 5), "popular_shelves": [{"name": "a"}, {"name": "b"}]} for i in range(6)])
    write("reviews.json.gz", [{"review_id": f"r{i}", "user_id": "u", "book_id": str(i), "rating": 4, "review_text": "The whales of the sea are wide and the sea is deep"} for i in range(6)] + [{"review_id": f"c{k}", "user_id": "u", "book_id": "0", "rating": 3, "language_code": k, "review_text": t} for k, t in (("en-US", "the deep sea and the whales"), ("ger", "der Hund und die Katze auf dem Dach"))])
    (tmp_path / "i.csv").write_text("user_id,book_id,is_read,rating,is_reviewed\n" + "".join(f"{u},{b},1,{3 if b else 0},0\n" for u in (1, 2) for b in range(2 + 2 * (u == 1))))
    raw = {"books": f"{tmp_path}/books.json.gz", "reviews": f"{tmp_path}/reviews.json.gz", "interactions": f"{tmp_path}/i.csv"}
    assert {r.reason: r.n for r in skipped_books(raw_books(spark, raw["books"])).collect()} == {"kept": 4, "ratings": 2, "malformed": 1}
    assert read_json_lines(spark, raw["books"], "book_id string", deal=3).rdd.getNumPartitions() == 3
    done = preprocess(spark, raw, f"{tmp_path}/out", least_user=2)
    assert sorted(r.title for r in done["books"].collect()) == ["T0", "T1", "T2", "T3"] and done["books"].count() == 4
    assert {(r.user_id, r.book_id) for r in done["interactions"].collect()} == {("1", "1"), ("1", "2"), ("1", "3")} and sorted(r.review_id for r in done["reviews"].collect()) == ["c" + "en-US", "r0", "r1", "r2", "r3"]
    small = preprocess(spark, raw, f"{tmp_path}/out", proto=1, least_user=1)
    assert [r.book_id for r in small["books"].collect()] == ["3"] and small["reviews"].count() == 1 and spark.read.parquet(f"{tmp_path}/out/books").count() == 4
    assert preprocess(spark, raw, f"{tmp_path}/out", stage="reviews")["books"].count() == 4
    with pytest.raises(ValueError):
        preprocess(spark, raw, f"{tmp_path}/out", stage="nonsense")
