"""Queries over the driver's tables, one or more for each operator, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import scalars as S
from foliant.functions import shelves as H
from foliant.functions import vectors as V
from foliant.operators import checks, clustering, labels, search, serve, summaries, tables, text_search
from foliant.operators.encoder import fit_encoder
from foliant.operators.language import strict_english, train_languages
from foliant.sources.raw import BOOK_DDL, books_table, is_english, line_id, lines_of, parse_json_lines, reviews_table
from foliant.sources.scratch import materialise

BOOKS = """SELECT CAST(p_partkey AS STRING) AS book_id, p_name AS title, concat(p_type, ' ', p_brand) AS description, p_brand AS publisher,
  p_size * 40 AS num_pages, ROUND(1 + CAST(p_partkey * 37 % 401 AS DOUBLE) / 100, 2) AS average_rating,
  CAST(p_partkey * 7919 % 5000 AS INT) AS ratings_count, CAST(p_partkey * 31 % 97 AS INT) AS text_reviews_count,
  concat('to-read,', CASE p_size % 6 WHEN 0 THEN 'sci-fi' WHEN 1 THEN 'YA' WHEN 2 THEN 'historical_fiction' WHEN 3 THEN 'vampire' WHEN 4 THEN 'mystery-thriller' ELSE 'non-fiction' END,
         ',', lower(p_type), ',', CASE p_partkey % 4 WHEN 0 THEN 'read-2011' WHEN 1 THEN '5-stars' WHEN 2 THEN 'fiction' ELSE 'classic' END) AS popular_shelves FROM part"""
INTERACTIONS = "SELECT CAST(o_custkey AS STRING) AS user_id, CAST(l_partkey AS STRING) AS book_id, CAST(l_quantity AS INT) % 6 AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
REVIEWS = """SELECT CAST(doc_id AS STRING) AS review_id, CAST(doc_id % 97 AS STRING) AS user_id, CAST(doc_id % 20 AS STRING) AS book_id, CAST(doc_id * 7 % 6 AS INT) AS rating, text AS review_text,
  CASE WHEN doc_id % 3 = 0 THEN '' WHEN lang = 'en' THEN 'en-US' ELSE lang END AS language_code, CAST(n_chars % 50 AS INT) AS n_votes FROM documents"""
VIEWS = f"WITH books AS ({BOOKS}), interactions AS ({INTERACTIONS}), reviews AS ({REVIEWS})"
THEME, LIKED = " a quiet novel of the northern sea ", ["17", "3", "42", "17", "99999999"]
FAVORITES = [(0, 3), (1, 17), (2, 42), (3, 99_999)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def books(spark, d):
    return spark.sql(BOOKS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))


def interactions(spark, d):
    return spark.sql(INTERACTIONS.replace("lineitem JOIN orders", "{a} JOIN {b}"), a=table(spark, d, "lineitem"), b=table(spark, d, "orders"))


def reviews(spark, d):
    return spark.sql(REVIEWS.replace("FROM documents", "FROM {t}"), t=table(spark, d, "documents"))


def vectors(spark, d):
    return table(spark, d, "embeddings")


def _similar(spark, d):
    return search.similar_items(vectors(spark, d), 0, 10)


def _normalized(spark, d):
    v = vectors(spark, d).select("vec_id", V.normalized(V.doubles(F.col("embedding"))).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(V.norm(F.col("v")), 6).alias("length"))


def _layernorm(spark, d):
    v = vectors(spark, d).select("vec_id", V.truncated_embedding(V.doubles(F.col("embedding")), 32).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.get("v", F.lit(31)), 6).alias("last"), F.size("v").alias("width"))


def _weights(spark, d):
    favorites = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("pos"))
    return search.recency_weights(favorites, "user_id").select("user_id", "pos", F.round("weight", 6).alias("weight"))


def _recommend(spark, d):
    meta = table(spark, d, "part").select(F.col("p_partkey").alias("vec_id"), F.col("p_name").alias("title"), F.round(1 + (F.col("p_partkey") * 37 % 401).cast("double") / 100, 2).alias("average_rating"))
    out = search.recommend(vectors(spark, d), search.favorites_frame(spark, FAVORITES), meta, 5)
    return out.select("rank", "vec_id", "title", "average_rating", "similarity")


def _cold(spark, d):
    return serve.cold_start(books(spark, d)).select("book_id", "title", "average_rating", "similarity")


def _label_means(spark, d):
    import numpy as np

    v = vectors(spark, d).withColumn("e", V.doubles(F.col("embedding")))
    rows = V.vector_sum(v, ["label"], "e").orderBy("label").collect()
    return np.array([r["e"] for r in rows])


def _assign(spark, d):
    return clustering.assign(vectors(spark, d), _label_means(spark, d), "vec_id", "embedding").select("vec_id", "cluster_id", F.round("similarity", 6).alias("similarity"))


def _members(spark, d):
    v = vectors(spark, d).select("vec_id", F.col("label").alias("cluster_id"), F.round(F.get(V.doubles(F.col("embedding")), F.lit(0)), 6).alias("similarity"))
    return clustering.rank_members(v)


def _ranked(spark, d):
    return _members(spark, d).select("vec_id", "cluster_id", "cluster_rank", "cluster_size", "is_representative")


def _kmeans(spark, d):
    found = clustering.spherical_kmeans(vectors(spark, d), 24, max_rounds=100, tolerance=1e-5)
    return found.assignments.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"), F.round(F.avg("similarity"), 4).alias("mean_similarity")).withColumn("converged", F.lit(found.converged))


def _book_rows(spark, d):
    b = books(spark, d).where((S.safe_int(F.col("ratings_count")) >= 1000) & (S.text_or_empty(F.col("title")) != ""))
    return b.select("book_id", S.text_or_empty(F.col("title")).alias("title"), S.safe_int(F.col("num_pages")).alias("num_pages"), S.safe_float(F.col("average_rating")).alias("average_rating"), "ratings_count", "popular_shelves")


RAW_TAGS = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN concat('["', p_type, '"," ', p_brand, ' ",""]') WHEN 1 THEN concat(' ', p_name) WHEN 2 THEN '[]' WHEN 3 THEN NULL WHEN 4 THEN ' '
  ELSE concat('[', chr(39), p_brand, chr(39), ', ', chr(39), ' x', chr(39), ']') END AS raw FROM part"""
RAW_BOOKS = """SELECT CAST(p_partkey AS STRING) AS book_id, concat('w', CAST(p_partkey % 500 AS STRING)) AS work_id, concat(' ', p_name, ' ') AS title, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE concat(p_name, ' (1)') END AS title_without_series,
  concat(p_type, ' ', p_brand) AS description, p_brand AS publisher, CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE CAST(1900 + p_size AS STRING) END AS publication_year, CAST(p_size * 40 AS STRING) AS num_pages, 'Paperback' AS format, 'eng' AS language_code,
  CASE WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS is_ebook, CAST(CAST(p_partkey * 37 % 401 AS INT) AS STRING) AS average_rating, CAST(p_partkey * 7919 % 5000 AS STRING) AS ratings_count, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_partkey * 31 % 97 AS STRING) END AS text_reviews_count,
  concat('http://x/', CAST(p_partkey AS STRING)) AS image_url, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('i', CAST(p_partkey AS STRING)) END AS isbn, CAST(NULL AS STRING) AS isbn13, lower(p_type) AS shelf FROM part"""


def _whole_books(spark, d):
    """All columns of the books' table, from lines of JSON."""
    raw = spark.sql(RAW_BOOKS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    raw = raw.withColumn("authors", F.array(F.struct(F.col("publisher").alias("author_id")))).withColumn("popular_shelves", F.transform(F.array(F.lit("to-read"), F.lit(""), F.col("shelf")), lambda n: F.struct(n.alias("name")))).drop("shelf")
    lines = raw.select(F.to_json(F.struct(*raw.columns)).alias("value"))
    return books_table(parse_json_lines(lines, BOOK_DDL), 1000).withColumn("average_rating", F.col("average_rating").cast("double"))


def _whole_reviews(spark, d):
    """All columns of the reviews' table, of the books with ratings enough."""
    raw = reviews(spark, d).select("review_id", "user_id", "book_id", F.col("rating").cast("string").alias("rating"), F.concat(F.lit(" "), "review_text", F.lit(" ")).alias("review_text"), "language_code", F.col("n_votes").cast("string").alias("n_votes"), F.lit("x").alias("n_comments"), F.lit("2017").alias("date_added"), F.lit(False).alias("_bad"))
    return reviews_table(raw, books(spark, d).where("ratings_count >= 1000").select("book_id"), _languages(spark, d).detect)


def _active(spark, d):
    return tables.active_users(interactions(spark, d), _book_rows(spark, d), 20).groupBy("user_id").agg(F.count("*").alias("n"))


def _index(spark, d):
    return tables.dense_index(interactions(spark, d), "user_id", "user_idx")


def _languages(spark, d):
    """Trained on three quarters of the documents."""
    return train_languages(table(spark, d, "documents").where("doc_id % 4 <> 2"))


def _english(spark, d):
    r = reviews(spark, d)
    blank = (F.col("rating") == 0) & (S.text_or_empty(F.col("review_text")) == "")
    return r.where(~blank & is_english(F.col("language_code"), F.col("review_text"), _languages(spark, d).detect)).select("review_id", "book_id", "rating")


def _detected(spark, d):
    return table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 4 == 2).alias("held_out"), _languages(spark, d).detect(F.col("text")).alias("detected"))


def _first(spark, d):
    return tables.dedupe(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_quantity")])


def _content(spark, d):
    return tables.dedupe(reviews(spark, d), ["book_id", "user_id", "review_text"], [F.col("review_id").cast("long")]).select("review_id", "book_id")


def _last(spark, d):
    return tables.dedupe(table(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


def _validate(spark, d):
    return tables.validation_summary(books(spark, d), interactions(spark, d), reviews(spark, d))


def _histogram(spark, d):
    return reviews(spark, d).groupBy("rating").agg(F.count("*").alias("n"))


def _catalog(spark, d):
    return tables.catalog_sample(books(spark, d), interactions(spark, d), reviews(spark, d), 10, 10, 12).select("book_id", "title", "ratings_count", "text_reviews_count", "review_count", "interaction_count")


def _catalog_stats(spark, d):
    return tables.min_median_max(tables.catalog_sample(books(spark, d), interactions(spark, d), reviews(spark, d), 10, 10, 12), "interaction_count")


def _proto(spark, d):
    return books(spark, d).orderBy(F.desc("ratings_count"), "book_id").limit(25).select("book_id", "ratings_count")


def _gate(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", S.letters(t).cast("long").alias("letters"), S.latin_letters(t).cast("long").alias("latin"), S.word_count(t).cast("long").alias("words"), S.reads_latin(t).alias("ok"))


def _reasons(spark, d):
    return tables.drop_reasons(reviews(spark, d), books(spark, d))


def _sample(spark, d):
    r = reviews(spark, d).where("rating > 0")
    return tables.stratified_sample(r, S.rating_bucket(F.col("rating"))).select("book_id", "review_id", "bucket", "tier", "pick")


def _stats(spark, d):
    s = tables.rating_stats(interactions(spark, d).where("rating > 0"))
    return s.select("book_id", F.round("average_rating", 6).alias("average_rating"), F.round("rating_std_dev", 6).alias("rating_std_dev"), *(f"n{i}" for i in range(1, 6)))


def _distribution(spark, d):
    s = tables.rating_stats(interactions(spark, d).where("rating > 0"))
    return s.select("book_id", S.distribution_text([F.col(f"n{i}") for i in range(1, 6)]).alias("rating_distribution_text"))


def _block(spark, d):
    r = tables.stratified_sample(reviews(spark, d).where("rating > 0"), S.rating_bucket(F.col("rating")))
    text = F.concat(F.lit("REVIEW "), F.col("pick").cast("string"), F.lit(":\n"), F.trim("review_text"))
    return tables.text_block(r, "book_id", "pick", text, "\n\n", "block").select("book_id", F.md5(F.col("block").cast("binary")).alias("block_md5"), F.length("block").cast("long").alias("chars"))


def _llm_input(spark, d):
    return books(spark, d).select("book_id", "title").join(_stats(spark, d).select("book_id", "average_rating"), "book_id").join(_distribution(spark, d), "book_id").join(_block(spark, d), "book_id")


def _top_reviews(spark, d):
    r = tables.top_per_group(reviews(spark, d), ["book_id"], [F.desc("n_votes"), F.col("review_id").cast("long")], 10)
    t = tables.text_block(r, "book_id", "rank", F.col("review_text"), " | User Review: ", "reviews")
    j = books(spark, d).join(t, "book_id", "left")
    full = F.concat(F.lit("Title: "), "title", F.lit(". Description: "), "description", F.lit(" Reviews: "), F.coalesce("reviews", F.lit("")))
    return j.select("book_id", F.md5(full.cast("binary")).alias("text_md5"))


def _search_text(spark, d):
    return books(spark, d).select("book_id", S.search_text(F.col("title"), F.col("description"), F.col("popular_shelves")).alias("search_text")).where("search_text <> ''")


def _shelf_counts(spark, d):
    return books(spark, d).select(F.explode(H.clean_shelves(F.col("popular_shelves"))).alias("shelf")).groupBy("shelf").agg(F.count("*").alias("n"))


def _shelf_members(spark, d):
    b = books(spark, d).withColumn("cluster_id", (F.col("book_id").cast("int") % 7).cast("int"))
    return b.withColumn("cluster_rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("ratings_count"), "book_id")))


def _label_scores(spark, d):
    return labels.label_scores(_shelf_members(spark, d)).select("cluster_id", "name", F.round("raw", 4).alias("raw"), F.round("score", 4).alias("score"), "place")


def _labels(spark, d):
    return labels.cluster_labels(_shelf_members(spark, d))


def _pending(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("book_id"), "o_orderstatus")
    log = o.where("book_id % 2 = 0").select("book_id", (F.col("book_id") % 3 == 0).alias("ok"))
    return summaries.pending(o, log).select("book_id", "o_orderstatus")


def _jsonl(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.where("p is not null").select("event_id", F.col("p.k").alias("k"))


def _tags(spark, d):
    rows = spark.sql(RAW_TAGS.replace("FROM part", "FROM {part}"), part=table(spark, d, "part"))
    return rows.select("id", F.array_join(S.tag_list(F.col("raw")), "|").alias("tags"))


def _ui(spark, d):
    final = _catalog(spark, d).select("book_id", F.col("title").alias("final_title"))
    return serve.ui_cache(final, books(spark, d)).select("book_id", "title", "publisher", "num_pages", "average_rating")


def _enriched(spark, d):
    r = _similar(spark, d).select(F.col("vec_id").cast("string").alias("book_id"), "score")
    return serve.enrich(r, books(spark, d).select("book_id", "title", F.lit(0).alias("score"))).select("book_id", "score", "title", "score_ui")


def _page(spark, d):
    r = _similar(spark, d).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")))
    return serve.page(r, 2, 4).select("rank", "vec_id", "score")


def _slice(spark, d):
    return _members(spark, d).where("cluster_id = 3 and cluster_rank <= 10").select("vec_id", "cluster_rank", "cluster_size")


def _display(spark, d):
    b = books(spark, d)
    return b.select("book_id", S.stars(F.col("average_rating")).alias("stars"), S.initials(F.col("title")).alias("initials"), S.preview(F.col("description"), 10).alias("preview"), S.worth_showing(F.col("text_reviews_count")).alias("shown"), S.html_escape(F.concat(F.lit("<"), "publisher", F.lit("&>"))).alias("escaped"), S.percent_score(F.col("average_rating")).alias("pct"))


def _controversy(spark, d):
    s = interactions(spark, d).where("rating between 1 and 5").groupBy("book_id").agg(F.count("*").alias("n"), F.stddev_samp("rating").alias("sd"), F.avg((F.col("rating") == 1).cast("double")).alias("p1"), F.avg((F.col("rating") == 5).cast("double")).alias("p5"))
    s = s.where("n >= 20").select("book_id", "n", F.round(F.col("sd") * (F.col("p1") + F.col("p5")), 6).alias("score"))
    return s.orderBy(F.desc("score"), "book_id").limit(15).join(books(spark, d).select("book_id", "title"), "book_id", "left")


def _shelf30(spark, d):
    return books(spark, d).select(F.explode(F.split("popular_shelves", ",")).alias("shelf")).groupBy("shelf").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shelf").limit(30)


def _coverage(spark, d):
    return tables.field_coverage(reviews(spark, d), ["review_text", "language_code", "n_votes"]).withColumns({c: F.round(c, 6) for c in ("non_null", "non_empty")})


def _sparsity(spark, d):
    s = interactions(spark, d).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.countDistinct("book_id").alias("items"))
    return s.select("users", "items", F.round(1 - F.col("n").cast("double") / (F.col("users") * F.col("items")), 8).alias("sparsity"))


def _seeded(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.concat(F.lit("42"), F.col("doc_id").cast("string")).cast("binary")).alias("h")).orderBy("h", "doc_id").limit(3)


def _bins(spark, d):
    return tables.histogram(table(spark, d, "documents"), "n_chars", 50, 0, 5000).where("n > 0").select("bin", "n")


def _bins_of_all(spark, d):
    """Widths of several histograms, by name."""
    docs, b = table(spark, d, "documents"), books(spark, d)
    parts = {"chars_40": tables.histogram(docs, "n_chars", 40, 0, 5000), "chars_60": tables.histogram(docs, "n_chars", 60, 0, 2000), "pages_50": tables.histogram(b, "num_pages", 50, 0, 2000), "ratings_40": tables.histogram(b, "average_rating", 40, 1, 5)}
    rows = [h.select(F.lit(name).alias("name"), "bin", F.round("low", 6).alias("low"), "n") for name, h in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def _shares(spark, d):
    r = reviews(spark, d)
    return tables.shares(r, {"rated": F.col("rating") > 0, "ten words": S.word_count(F.col("review_text")) >= 10, "coded": S.text_or_empty(F.col("language_code")) != "", "isbn": S.has_isbn(F.col("language_code")), "voted": F.col("n_votes") > 0}).withColumn("share", F.round("share", 6))


def _summary(spark, d):
    return table(spark, d, "documents").agg(F.count("n_chars").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.stddev_samp("n_chars"), 4).alias("sd"), F.min("n_chars").alias("low"), *(F.percentile("n_chars", q).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)), F.max("n_chars").alias("high"))


def _values(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("above"), F.count("props").alias("with_props"))


def _log_length(spark, d):
    return table(spark, d, "documents").select("doc_id", F.least("n_chars", F.lit(500)).alias("clipped"), F.round(F.when(F.col("n_chars") > 0, F.log10(F.col("n_chars").cast("double"))), 6).alias("log10_chars"))


def _thematic(spark, d):
    items, encoder, v = _encoded(spark, d)
    return text_search.thematic_search(v, items, THEME, encoder, 10, width=48)


def _encoded(spark, d):
    """Documents, an encoder fitted on their texts, and their vectors."""
    items = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("book_id"), F.col("source").alias("title"), F.col("text").alias("search_text"))
    encoder = fit_encoder(items, width=64)
    return items, encoder, materialise(text_search.encode_items(items, encoder, 48, prefix=text_search.ITEM_PREFIX), "items")


def _text_page(spark, d):
    items, encoder, v = _encoded(spark, d)
    details = items.select("book_id", "title", F.length("search_text").alias("n_chars"))
    return serve.search_page(v, items, details, encoder, THEME, 99, width=48)[0].select("rank", "book_id", "title", "score", "n_chars")


def _favorites_page(spark, d):
    return serve.favorites_page(books(spark, d), LIKED).select("book_id", "title", "_fav_order")


def _labelled(spark, d):
    return _members(spark, d).withColumn("cluster_label", F.concat(F.lit("c"), F.col("cluster_id").cast("string")))


def _cluster_list(spark, d):
    return serve.cluster_list(_labelled(spark, d))


def _show_limit(spark, d):
    return serve.neighborhood(_labelled(spark, d), 2, 25).select("vec_id", "cluster_rank", "cluster_label")


def _cold_mode(spark, d):
    mode, rows = serve.recommendations(books(spark, d), [], None)
    return rows.select("rank", "book_id", F.lit(mode).alias("mode"))


def _personal_mode(spark, d):
    b = books(spark, d)
    items = vectors(spark, d).select(F.col("vec_id").cast("string").alias("book_id"), "embedding")

    def personal(liked, n):
        favorites = spark.createDataFrame(list(enumerate(liked)), "pos int, book_id string")
        return search.recommend(items, favorites, b.select("book_id", "title", "average_rating"), n, "book_id")

    mode, rows = serve.recommendations(b, [str(i) for _, i in FAVORITES], personal, 5, b.select("book_id", "publisher", "num_pages"))
    return rows.select("rank", "book_id", "title", "average_rating", "score", "publisher", "num_pages", F.lit(mode).alias("mode"))


def _members_shown(spark, d):
    m = _labelled(spark, d).withColumn("book_id", F.col("vec_id").cast("string"))
    return serve.neighborhood(m, 2, 25, books(spark, d).select("book_id", "title", "publisher")).select("book_id", "cluster_rank", "cluster_label", "title", "publisher")


def _size_stats(spark, d):
    return clustering.size_stats(_members(spark, d))


def _top_shelves(spark, d):
    return clustering.top_shelves(_shelf_members(spark, d)).select("cluster_id", "shelf", "score", "place")


def _cluster_summary(spark, d):
    m = _shelf_members(spark, d)
    names = m.select("cluster_id", F.concat(F.lit("A · c"), F.col("cluster_id").cast("string"), F.lit(" II")).alias("label")).distinct()
    s = clustering.cluster_summary(m, names)
    best = F.array_join(F.transform("top_family_scores", lambda x: F.concat_ws(":", x["label"], F.format_string("%.2f", x["score"]))), "|")
    return s.select("cluster_id", "cluster_size", best.alias("best"), *(F.array_join(c, "|").alias(c) for c in ("top_cleaned_shelves", "representative_titles", "selected_label_families")))


def _final(spark, d):
    b = books(spark, d)
    raw = F.when(F.col("book_id").cast("int") % 2 == 0, F.concat(F.lit('[" '), F.replace("popular_shelves", F.lit(","), F.lit(' ", "')), F.lit('", ""]'))).otherwise(F.col("popular_shelves"))
    outputs = b.select(F.concat(F.lit(" "), "book_id", F.lit(" ")).alias("book_id"), "title", F.concat(F.lit("  "), "description").alias("overall_judgment"), F.lit("p").alias("positive_aspects"), F.lit("n").alias("negative_aspects"), raw.alias("top_tags"))
    return summaries.final_artifact(outputs, b.select("book_id"))[0]


def _run_log(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("book_id"), (F.col("o_orderkey") % 3 == 0).alias("ok"), F.col("o_custkey").alias("input_chars"), (F.col("o_orderkey") % 1000).alias("output_tokens"), F.lit("t").alias("timestamp_utc"), F.lit(1).alias("attempts"))


def _averages(spark, d):
    return summaries.run_averages(_run_log(spark, d)).select(*(F.round(c, 6).alias(c) for c in ("mean_input_chars", "mean_output_tokens")))


def _run_counts(spark, d):
    log = _run_log(spark, d)
    return summaries.run_counts(log, log.where("output_tokens < 500"))


def _outcomes(spark, d):
    log = _run_log(spark, d)
    both = log.where("ok").select("book_id", "output_tokens").unionByName(log.where("not ok").select("book_id", F.lit("Refused").alias("error_type")), allowMissingColumns=True)
    return both.groupBy("error_type").agg(F.count("*").alias("n"), F.sum("output_tokens").alias("tokens"))


def _processed(spark, d):
    log = _run_log(spark, d)
    return summaries.run_ids(log.where("ok").select("book_id").unionAll(log.where("not ok and attempts > 0").select("book_id")), log.where("output_tokens < 500"))


def _unknown(spark, d):
    return search.unknown_favorites(vectors(spark, d), table(spark, d, "orders").select(F.col("o_custkey").alias("vec_id")).distinct())


def _llm_input_checked(spark, d):
    """Counts of the run's input, once it has passed its checks."""
    rows = table(spark, d, "part").select(F.concat(F.lit(" "), F.col("p_partkey").cast("string")).alias("book_id"), F.col("p_name").alias("title"), F.lit(1.0).alias("average_rating"), F.lit(0.5).alias("rating_std_dev"), F.col("p_type").alias("rating_distribution_text"), F.col("p_brand").alias("reviews_text_block"))
    return summaries.check_llm_input(rows, books(spark, d)).agg(F.count("*").alias("n"), F.sum(F.length("book_id")).alias("chars"))


def _review_counts(spark, d):
    return tables.counts_per_book(reviews(spark, d).where("rating > 0"), books(spark, d))


def _length_stats(spark, d):
    return tables.length_stats(table(spark, d, "documents"), "text")


def _strict(spark, d):
    return table(spark, d, "documents").select("doc_id", strict_english(F.col("text"), _languages(spark, d).detect).alias("english"))


def _counted(named):
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in named.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def _sampled(spark, d):
    return _counted(tables.sampled_tables(_catalog(spark, d), books=books(spark, d), interactions=interactions(spark, d), reviews=reviews(spark, d)))


def _prototype(spark, d):
    return _counted(tables.prototype(books(spark, d), interactions(spark, d), reviews(spark, d), 200, 5))


def _line_filter(spark, d):
    lines = table(spark, d, "orders").select(F.concat(F.lit('{"user_id": "u", "book_id": "'), F.col("o_orderkey").cast("string"), F.lit('", "n": '), F.col("o_custkey").cast("string"), F.lit("}")).alias("value"))
    wanted = table(spark, d, "part").select((F.col("p_partkey") * 3).alias("book_id"))
    return lines_of(lines, wanted).select(line_id(F.col("value")).cast("long").alias("book_id"), F.get_json_object("value", "$.n").cast("long").alias("n"))


def _compact(spark, d):
    return books(spark, d).select("book_id", summaries.compact_json(F.split("popular_shelves", ",")).alias("shelves"))


def _checked(spark, d):
    b, v = books(spark, d), vectors(spark, d)
    checks.require_columns(b, ["book_id", "title"])
    checks.expect_unique(b, "book_id")
    checks.expect_non_blank(b, "title")
    checks.expect_keys(b.select("book_id"), b, "book_id")
    checks.expect_finite_vectors(v, "embedding", 64)
    checks.expect_group_size(b.select("book_id"), "book_id", 1)
    return checks.expect_rows(checks.existing_columns(b, ["book_id", "no such column"]), 10, "books").agg(F.count("*").alias("n"))


QUERIES = {
    "similar_items_topk": _similar, "vector_l2_normalize": _normalized, "layernorm_truncate_l2": _layernorm, "recency_weights": _weights, "recommend_topn": _recommend, "coldstart_top_rated": _cold,
    "cluster_assign_step": _assign, "cluster_rank_representatives": _ranked, "spherical_kmeans": _kmeans, "books_filter_project": _book_rows, "interactions_active_users": _active, "dense_index": _index,
    "reviews_english_hybrid": _english, "language_detected": _detected, "books_table_whole": _whole_books, "reviews_table_whole": _whole_reviews, "dedupe_first": _first, "dedupe_content": _content, "dedupe_last": _last, "validate_summary": _validate, "rating_histogram": _histogram, "catalog_sample": _catalog,
    "catalog_stats": _catalog_stats, "proto_top_items": _proto, "review_quality_gate": _gate, "clean_drop_reasons": _reasons, "stratified_waterfall_sample": _sample, "rating_stats": _stats,
    "rating_distribution_text": _distribution, "reviews_text_block": _block, "llm_input_join": _llm_input, "top_reviews_concat": _top_reviews, "search_text": _search_text, "shelf_clean_counts": _shelf_counts,
    "cluster_label_scores": _label_scores, "cluster_labels": _labels, "pending_anti_join": _pending, "jsonl_tolerant_parse": _jsonl, "tags_normalize": _tags, "ui_cache_join": _ui, "result_enrichment": _enriched,
    "search_page": _page, "neighborhood_slice": _slice, "display_scalars": _display, "controversy_score": _controversy, "shelf_top30": _shelf30, "field_coverage": _coverage, "sparsity": _sparsity,
    "seeded_sample": _seeded, "equal_width_bins": _bins, "equal_width_histograms": _bins_of_all, "predicate_shares": _shares, "numeric_summary": _summary, "value_counts": _values, "clip_log_length": _log_length,
    "thematic_search": _thematic, "favorites_page": _favorites_page, "cluster_list": _cluster_list, "neighborhood_show_limit": _show_limit, "recommendations_mode": _cold_mode, "cluster_size_stats": _size_stats,
    "search_page_of_text": _text_page, "recommendations_personal": _personal_mode, "neighborhood_members": _members_shown,
    "cluster_top_shelves": _top_shelves, "cluster_summary": _cluster_summary, "final_artifact": _final, "run_averages": _averages, "run_counts": _run_counts, "run_outcomes_union": _outcomes, "processed_ids": _processed, "unknown_favorites": _unknown, "llm_input_checks": _llm_input_checked, "review_count_stats": _review_counts,
    "text_length_stats": _length_stats, "strict_english": _strict, "sampled_tables": _sampled, "prototype_subset": _prototype, "line_filter_before_parse": _line_filter, "compact_json": _compact, "input_checks": _checked,
}
