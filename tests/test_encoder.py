import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import encoder, serve, text_search
from foliant.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def items(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").where("n_chars >= 200").select(F.col("doc_id").cast("string").alias("book_id"), F.concat(F.lit("t"), "doc_id").alias("title"), F.col("text").alias("search_text"))


@pytest.fixture(scope="module")
def model(items):
    return encoder.fit_encoder(items, width=64)


def test_basis_is_that_of_a_singular_value_decomposition(spark, monkeypatch):
    rng = np.random.default_rng(3)
    topics = [[f"w{i}" for i in range(j * 8, j * 8 + 8)] for j in range(5)]
    texts = [" ".join(rng.choice(topics[i % 5], 12)) for i in range(200)] + [None, "", "unknown"]
    df = spark.createDataFrame([(t,) for t in texts], "search_text string").repartition(4)
    model = encoder.fit_encoder(df, width=5, rounds=6)
    a = np.zeros((len(texts), len(model.terms)))
    for row, t in zip(a, texts, strict=True):
        at, w = model.sparse(t or "")
        row[at] = w
    _, s, v = np.linalg.svd(a)
    assert np.allclose(model.strength, s[:5], rtol=1e-5) and np.allclose(np.abs(np.linalg.det(model.basis.T @ v[:5].T)), 1, atol=1e-5)
    df_counts = {t: sum(t in set((x or "").split()) for x in texts) for t in model.terms}
    assert all(np.isclose(model.idf[i], np.log((1 + len(texts)) / (1 + df_counts[t])) + 1) for t, i in model.terms.items())
    x = model(["search_query: " + texts[0], ""])
    assert np.allclose(x[0], a[0] @ model.basis) and not x[1].any()
    monkeypatch.setattr(encoder, "MOST_NUMBERS", 100)
    with pytest.raises(ValueError, match="numbers"):
        encoder.fit_encoder(df, width=5)
    with pytest.raises(ValueError, match="no term"):
        encoder.fit_encoder(df.limit(0))


def test_near_copies_come_first(spark, items, model):
    v = text_search.encode_items(items, model, 48, prefix=text_search.ITEM_PREFIX).cache()
    texts = {r.book_id: r.search_text for r in items.collect()}
    exact = {}
    for i, t in texts.items():
        exact.setdefault(t, set()).add(i)
    right = 0
    wanted = sorted(texts, key=int)[::60]
    for i in wanted:
        words = texts[i].split()
        planted = " ".join(w for n, w in enumerate(words) if n % 9) + " entirely other ending"
        found = [r.book_id for r in text_search.thematic_search(v, items, planted, model, 3, width=48).collect()]
        right += bool(exact[texts[i]] & set(found[:1]) or i in found)
    assert right >= 0.9 * len(wanted)
    v.unpersist()


def test_stored_encoders_and_pages(spark, items, model, tmp_path):
    encoder.write_encoder(model, items, f"{tmp_path}/e")
    again = encoder.read_encoder(items, f"{tmp_path}/e")
    assert np.allclose(again(["the sea and the night"]), model(["the sea and the night"]))
    v = text_search.encode_items(items, model, 48)
    rows, page, pages, total = serve.search_page(v, items.select("book_id", "title"), items.select("book_id", F.length("search_text").alias("n")), model, "a quiet novel of the sea", 99, width=48)
    got = rows.collect()
    assert (page, pages, total) == (10, 10, 100) and [r["rank"] for r in got] == list(range(91, 101)) and all(r.n >= 200 for r in got)
    assert serve.search_page(v, items, items.select("book_id"), model, "  ", 3, width=48)[1:] == (1, 1, 0)
    assert serve.page_number(25, 99) == (3, 3) and serve.page_number(25, -1) == (1, 3) and serve.page_number(0, 2) == (1, 1)
    ranked = spark.range(25).select((F.col("id") + 1).alias("rank"))
    assert [r["rank"] for r in serve.page(ranked, 99).orderBy("rank").collect()] == [21, 22, 23, 24, 25]


def test_queries_search_the_space_of_their_own_texts(spark):
    rows = QUERIES["thematic_search"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 10 and [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)
