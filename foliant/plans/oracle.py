"""SQL for the queries, for DuckDB."""

from __future__ import annotations

from foliant.functions import shelves as H
from foliant.operators.language import MOST_GRAMS
from foliant.plans.queries import LIKED, RAW_BOOKS, RAW_TAGS, VIEWS

_E = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
_UNIT = "list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12))"
SIMILAR = f"""v AS (SELECT vec_id, {_E} AS e FROM embeddings),
sim AS (SELECT v.vec_id, round(list_dot_product(v.e, {_UNIT.replace('e,', 'q.e,').replace('(e', '(q.e').replace(' e)', ' q.e)')}), 6) AS score FROM v, (SELECT e FROM v WHERE vec_id = 0) q WHERE v.vec_id <> 0 ORDER BY list_dot_product(v.e, {_UNIT.replace('e,', 'q.e,').replace('(e', '(q.e').replace(' e)', ' q.e)')}) DESC, v.vec_id LIMIT 10)"""
MEMBERS = """m AS (SELECT vec_id, label AS cluster_id, row_number() OVER (PARTITION BY label ORDER BY round(CAST(embedding[1] AS DOUBLE), 6) DESC, vec_id) AS cluster_rank,
  count(*) OVER (PARTITION BY label) AS cluster_size FROM embeddings)"""
BUCKET = "CASE WHEN rating IN (1, 2) THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END"
PICKED = f"""h AS (SELECT *, {BUCKET} AS bucket, md5(concat_ws('|', '42', book_id, review_id)) AS h FROM reviews WHERE rating > 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY book_id, bucket ORDER BY h, review_id) > 4 AS INTEGER) AS tier FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY tier, h, review_id) AS pick FROM t QUALIFY pick <= 12)"""
STATS = "s AS (SELECT book_id, round(avg(rating), 6) AS average_rating, round(stddev_pop(rating), 6) AS rating_std_dev, " + ", ".join(f"count(*) FILTER (rating = {i}) AS n{i}" for i in range(1, 6)) + ", count(*) AS n FROM interactions WHERE rating > 0 GROUP BY book_id)"
_PCT = "CASE WHEN {c} * 100 % n = 0 THEN concat(CAST({c} * 100 // n AS BIGINT), '%') ELSE concat(CAST(floor({c} * 1000 / n + 0.5) AS BIGINT) // 10, '.', CAST(floor({c} * 1000 / n + 0.5) AS BIGINT) % 10, '%') END"
DIST = "concat('Rating distribution: ', " + ", ', ', ".join(f"'{i}★ ', " + _PCT.format(c=f"n{i}") for i in range(1, 6)) + ")"
BLOCK = f"{PICKED}, b AS (SELECT book_id, string_agg(concat('REVIEW ', pick, ':', chr(10), trim(review_text)), concat(chr(10), chr(10)) ORDER BY pick) AS block FROM p GROUP BY book_id)"
CATALOG = """c AS (SELECT b.book_id, title, ratings_count, text_reviews_count, r.n AS review_count, i.n AS interaction_count FROM books b JOIN (SELECT book_id, count(*) AS n FROM reviews GROUP BY 1) r USING (book_id)
  JOIN (SELECT book_id, count(*) AS n FROM interactions GROUP BY 1) i USING (book_id) WHERE r.n >= 10 AND i.n >= 10 ORDER BY ratings_count DESC, text_reviews_count DESC, book_id LIMIT 12)"""
_list = lambda xs: "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"
_map = lambda kv: "MAP {" + ", ".join(f"'{k}': '{v.replace(chr(39), chr(39) * 2)}'" for k, v in kv.items()) + "}"
_DROP = _list(H.GENERIC + H.BLOCKED)
CLEAN = f"""x AS (SELECT book_id, replace(lower(trim(unnest(string_split(popular_shelves, ',')))), '_', '-') AS t FROM books),
y AS (SELECT book_id, coalesce({_map(H.STANDS_FOR)}[t], t) AS shelf FROM x WHERE length(t) BETWEEN 1 AND 35 AND length(regexp_replace(t, '[^A-Za-z]', '', 'g')) >= 2
  AND NOT regexp_matches(t, '{H.YEAR}') AND NOT regexp_matches(t, '{H.STARS}') AND NOT regexp_matches(t, '{H.UTILITY}') AND t NOT IN {_DROP}),
z AS (SELECT * FROM y WHERE shelf NOT IN {_DROP})"""
_TITLE = "array_to_string(list_transform(list_filter(string_split(shelf, '-'), lambda p: p <> ''), lambda p: array_to_string(list_transform(string_split(p, ' '), lambda w: concat(upper(w[1]), lower(w[2:]))), ' ')), ' ')"


def _grams(of: str, source: str, where: str = "true") -> str:
    """The trigrams of a text column's letters: all with the row's own columns."""
    return f"""(SELECT * EXCLUDE (c), unnest(list_transform(range(1, len(c) - 1), lambda i: concat(c[i], c[i + 1], c[i + 2]))) AS g FROM (SELECT *, string_split(concat(' ', trim(regexp_replace(lower({of}), '[^\\p{{L}}]+', ' ', 'g')), ' '), '') AS c FROM {source} WHERE {where}))"""


#: Languages told by weights of trigrams, as a model trained on the documents that are not held out tells them.
_MODEL = f"""tn AS (SELECT lang, g, count(*) AS n FROM {_grams('text', 'documents', 'doc_id % 4 <> 2 AND lang IS NOT NULL')} GROUP BY ALL), tk AS (SELECT g FROM tn GROUP BY g ORDER BY sum(n) DESC, g LIMIT {MOST_GRAMS}),
tl AS (SELECT lang, sum(n) + (SELECT count(*) FROM tk) AS total FROM tn SEMI JOIN tk USING (g) GROUP BY lang),
tw AS (SELECT lang, g, CAST(round(1e6 * ln((coalesce(n, 0) + 1) / total)) AS BIGINT) AS weight FROM tk CROSS JOIN tl LEFT JOIN tn USING (lang, g))"""


def _told(id_: str, of: str, source: str) -> str:
    return f"told AS (SELECT {id_}, lang AS detected FROM (SELECT {id_}, lang, sum(weight * k) AS s FROM (SELECT {id_}, g, count(*) AS k FROM {_grams(of, source)} GROUP BY ALL) JOIN tw USING (g) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY {id_} ORDER BY s DESC, lang) = 1)"


_RECOMMENDED = f"""v AS (SELECT vec_id, {_E} AS e FROM embeddings), f(pos, vec_id) AS (VALUES (0, 3), (1, 17), (2, 42), (3, 99999)),
k AS (SELECT v.e, row_number() OVER (ORDER BY pos) - 1 AS i, count(*) OVER () AS n FROM f JOIN v USING (vec_id)), w AS (SELECT e, (0.4::DOUBLE + 1.2::DOUBLE * i / (n - 1)) / n AS w FROM k),
p AS (SELECT list(s ORDER BY j) AS e FROM (SELECT j, sum(w * e[j]) AS s FROM w, range(1, 65) t(j) GROUP BY j)), q AS (SELECT {_UNIT} AS q FROM p),
s AS (SELECT vec_id, list_dot_product(e, q) AS whole FROM v, q WHERE vec_id NOT IN (SELECT vec_id FROM f)),
m AS (SELECT s.vec_id, p_name AS title, coalesce(ROUND(1 + CAST(p_partkey * 37 % 401 AS DOUBLE) / 100, 2), 0) AS average_rating, whole FROM s LEFT JOIN part ON p_partkey = vec_id ORDER BY whole DESC, 3 DESC, s.vec_id LIMIT 5),
rec AS (SELECT CAST(row_number() OVER (ORDER BY whole DESC, average_rating DESC, vec_id) AS INTEGER) AS rank, vec_id, title, average_rating, round(whole, 6) AS similarity FROM m)"""
W = lambda body: f"{VIEWS} {body}"
ORACLE = {
    "similar_items_topk": f"WITH {SIMILAR} SELECT vec_id, score FROM sim",
    "vector_l2_normalize": f"WITH v AS (SELECT vec_id, {_E} AS e FROM embeddings), u AS (SELECT vec_id, {_UNIT} AS u FROM v) SELECT vec_id, round(u[1], 6) AS first, round(sqrt(list_dot_product(u, u)), 6) AS length FROM u",
    "layernorm_truncate_l2": f"""WITH v AS (SELECT vec_id, {_E} AS a FROM embeddings), m AS (SELECT vec_id, a, list_avg(a) AS m FROM v), s AS (SELECT vec_id, list_transform(a, lambda x: (x - m) / sqrt(list_avg(list_transform(a, lambda z: (z - m) * (z - m))) + 1e-5))[1:32] AS e FROM m),
u AS (SELECT vec_id, {_UNIT} AS u FROM s) SELECT vec_id, round(u[1], 6) AS first, round(u[32], 6) AS last, CAST(len(u) AS INTEGER) AS width FROM u""",
    "recency_weights": """WITH k AS (SELECT o_custkey AS user_id, o_orderkey AS pos, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT user_id, pos, round(CASE WHEN n = 1 THEN 1 ELSE (0.4::DOUBLE + 1.2::DOUBLE * i / (n - 1)) / n END, 6) AS weight FROM k""",
    "recommend_topn": f"WITH {_RECOMMENDED} SELECT rank, vec_id, title, average_rating, similarity FROM rec",
    "recommendations_personal": f"""{VIEWS}, {_RECOMMENDED} SELECT rank, CAST(vec_id AS STRING) AS book_id, rec.title, rec.average_rating, similarity AS score, publisher, num_pages, 'personalized' AS mode FROM rec LEFT JOIN books b ON book_id = CAST(vec_id AS STRING)""",
    "coldstart_top_rated": W("SELECT book_id, title, average_rating, CAST(NULL AS DOUBLE) AS similarity FROM books ORDER BY average_rating DESC, ratings_count DESC, book_id LIMIT 5"),
    "cluster_assign_step": f"""WITH v AS (SELECT vec_id, label, {_E} AS e FROM embeddings), c AS (SELECT label, list(s ORDER BY j) AS e FROM (SELECT label, j, sum(e[j]) AS s FROM v, range(1, 65) t(j) GROUP BY 1, 2) GROUP BY label),
u AS (SELECT row_number() OVER (ORDER BY label) - 1 AS cluster_id, {_UNIT} AS u FROM c), n AS (SELECT vec_id, {_UNIT} AS x FROM v)
SELECT vec_id, CAST(cluster_id AS INTEGER) AS cluster_id, round(list_dot_product(x, u), 6) AS similarity FROM n, u QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY list_dot_product(x, u) DESC, cluster_id) = 1""",
    "cluster_rank_representatives": f"WITH {MEMBERS} SELECT vec_id, cluster_id, CAST(cluster_rank AS INTEGER) AS cluster_rank, cluster_size, cluster_rank <= 5 AS is_representative FROM m",
    "books_filter_project": W("SELECT book_id, trim(title) AS title, num_pages, average_rating, ratings_count, popular_shelves FROM books WHERE ratings_count >= 1000 AND trim(title) <> ''"),
    "interactions_active_users": W("SELECT user_id, count(*) AS n FROM interactions WHERE rating > 0 AND book_id IN (SELECT book_id FROM books WHERE ratings_count >= 1000) GROUP BY user_id HAVING count(*) >= 20"),
    "dense_index": W("SELECT user_id, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INTEGER) AS user_idx FROM (SELECT DISTINCT user_id FROM interactions)"),
    "reviews_english_hybrid": W(f""", {_MODEL}, {_told('review_id', 'review_text', 'reviews')} SELECT review_id, book_id, rating FROM reviews LEFT JOIN told USING (review_id)
WHERE NOT (rating = 0 AND trim(review_text) = '') AND CASE WHEN trim(language_code) <> '' THEN starts_with(lower(language_code), 'en') WHEN length(trim(review_text)) < 20 THEN false ELSE coalesce(detected = 'en', false) END"""),
    "books_table_whole": f"""SELECT book_id, work_id, trim(title) AS title, CASE WHEN title_without_series = '' THEN trim(title) ELSE title_without_series END AS title_without_series, publisher AS primary_author_id, description, publisher, format, language_code, image_url, isbn, '' AS isbn13,
coalesce(TRY_CAST(publication_year AS INTEGER), 0) AS publication_year, CAST(num_pages AS INTEGER) AS num_pages, CAST(ratings_count AS INTEGER) AS ratings_count, coalesce(CAST(text_reviews_count AS INTEGER), 0) AS text_reviews_count, CAST(average_rating AS DOUBLE) AS average_rating, is_ebook = 'true' AS is_ebook, concat('to-read,', shelf) AS popular_shelves
FROM ({RAW_BOOKS}) WHERE CAST(ratings_count AS INTEGER) >= 1000""",
    "reviews_table_whole": W(f""", {_MODEL}, {_told('review_id', 'review_text', 'reviews')} SELECT review_id, user_id, book_id, rating, trim(review_text) AS review_text, CAST(n_votes AS INTEGER) AS n_votes, 0 AS n_comments, '2017' AS date_added FROM reviews LEFT JOIN told USING (review_id)
WHERE book_id IN (SELECT book_id FROM books WHERE ratings_count >= 1000) AND NOT (rating = 0 AND trim(review_text) = '') AND CASE WHEN trim(language_code) <> '' THEN starts_with(lower(language_code), 'en') WHEN length(trim(review_text)) < 20 THEN false ELSE coalesce(detected = 'en', false) END"""),
    "language_detected": f"WITH {_MODEL}, {_told('doc_id', 'text', 'documents')} SELECT doc_id, doc_id % 4 = 2 AS held_out, CASE WHEN text IS NOT NULL THEN coalesce(detected, 'und') END AS detected FROM documents LEFT JOIN told USING (doc_id)",
    "dedupe_first": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1",
    "dedupe_content": W("SELECT review_id, book_id FROM reviews QUALIFY row_number() OVER (PARTITION BY book_id, user_id, review_text ORDER BY CAST(review_id AS BIGINT)) = 1"),
    "dedupe_last": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "validate_summary": W("""SELECT 'books' AS metric, count(DISTINCT book_id) AS value FROM books UNION ALL SELECT 'interactions', count(*) FROM interactions UNION ALL SELECT 'reviews', count(*) FROM reviews UNION ALL SELECT 'users', count(DISTINCT user_id) FROM interactions
UNION ALL SELECT 'in_all', count(*) FROM (SELECT book_id FROM books INTERSECT SELECT book_id FROM interactions INTERSECT SELECT book_id FROM reviews) UNION ALL SELECT 'orphan_interactions', count(*) FROM (SELECT book_id FROM interactions EXCEPT SELECT book_id FROM books)
UNION ALL SELECT 'books_without_reviews', count(*) FROM (SELECT book_id FROM books EXCEPT SELECT book_id FROM reviews) UNION ALL SELECT 'in_any', count(*) FROM (SELECT book_id FROM interactions UNION SELECT book_id FROM reviews)"""),
    "rating_histogram": W("SELECT rating, count(*) AS n FROM reviews GROUP BY rating"),
    "catalog_sample": W(f", {CATALOG} SELECT * FROM c"),
    "catalog_stats": W(f", {CATALOG} SELECT min(interaction_count) AS min_value, quantile_cont(CAST(interaction_count AS DOUBLE), 0.5) AS median_value, max(interaction_count) AS max_value FROM c"),
    "proto_top_items": W("SELECT book_id, ratings_count FROM books ORDER BY ratings_count DESC, book_id LIMIT 25"),
    "review_quality_gate": """WITH c AS (SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w, length(trim(text)) AS n FROM documents)
SELECT doc_id, letters, latin, len(w) AS words, n >= 20 AND letters >= 15 AND latin >= letters * 0.85::DOUBLE AND len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}'))) >= 5 AS ok FROM c""",
    "clean_drop_reasons": W(""", a AS (SELECT *, CASE WHEN book_id NOT IN (SELECT book_id FROM books) THEN 'book' WHEN rating <= 0 THEN 'rating' WHEN trim(review_text) = '' THEN 'text' END AS r FROM reviews),
b AS (SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN row_number() OVER (PARTITION BY book_id, user_id, review_text, r IS NULL ORDER BY review_id) > 1 THEN 'duplicate' WHEN len(list_filter(string_split_regex(review_text, '\\s+'), lambda x: x <> '')) < 10 THEN 'short' ELSE 'kept' END AS reason FROM a)
SELECT reason, count(*) AS n FROM b GROUP BY reason"""),
    "stratified_waterfall_sample": W(f", {PICKED} SELECT book_id, review_id, bucket, tier, CAST(pick AS INTEGER) AS pick FROM p"),
    "rating_stats": W(f", {STATS} SELECT * EXCLUDE (n) FROM s"),
    "rating_distribution_text": W(f", {STATS} SELECT book_id, {DIST} AS rating_distribution_text FROM s"),
    "reviews_text_block": W(f", {BLOCK} SELECT book_id, md5(block) AS block_md5, length(block) AS chars FROM b"),
    "llm_input_join": W(f", {STATS}, {BLOCK} SELECT book_id, title, s.average_rating, {DIST} AS rating_distribution_text, md5(block) AS block_md5, length(block) AS chars FROM books JOIN s USING (book_id) JOIN b USING (book_id)"),
    "top_reviews_concat": W(""", r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n_votes DESC, CAST(review_id AS BIGINT)) AS rn FROM reviews QUALIFY rn <= 10), t AS (SELECT book_id, string_agg(review_text, ' | User Review: ' ORDER BY rn) AS x FROM r GROUP BY 1)
SELECT book_id, md5(concat('Title: ', title, '. Description: ', description, ' Reviews: ', coalesce(x, ''))) AS text_md5 FROM books LEFT JOIN t USING (book_id)"""),
    "search_text": W("SELECT book_id, trim(concat(lower(trim(title)), ' ', lower(trim(description)), ' ', lower(trim(popular_shelves)))) AS search_text FROM books"),
    "shelf_clean_counts": W(f", {CLEAN} SELECT shelf, count(*) AS n FROM z GROUP BY shelf"),
    "cluster_label_scores": W(f""", {CLEAN}, k AS (SELECT book_id, CAST(book_id AS INTEGER) % 7 AS cluster_id, row_number() OVER (PARTITION BY CAST(book_id AS INTEGER) % 7 ORDER BY ratings_count DESC, book_id) AS r FROM books),
g AS (SELECT cluster_id, coalesce({_map(H.FAMILY_OF)}[shelf], {_map(H.OWN_DISPLAY)}[shelf], {_TITLE}) AS name, sum(CASE WHEN r <= 10 THEN 3.0::DOUBLE WHEN r <= 50 THEN 1.5 ELSE 1.0 END) AS raw FROM z JOIN k USING (book_id) GROUP BY 1, 2),
q AS (SELECT *, raw * CASE WHEN name IN {_list(H.GENERIC_DISPLAYS)} THEN 0.15::DOUBLE ELSE 1 END AS score FROM g)
SELECT cluster_id, name, round(raw, 4) AS raw, round(score, 4) AS score, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, raw DESC, name) AS INTEGER) AS place FROM q"""),
    "pending_anti_join": "SELECT o_orderkey AS book_id, o_orderstatus FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_orderkey % 3 = 0)",
    "jsonl_tolerant_parse": "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE props IS NOT NULL AND json_valid(props)",
    "tags_normalize": f"""WITH r AS ({RAW_TAGS}), t AS (SELECT id, CASE WHEN starts_with(raw, '[') THEN CAST(from_json(replace(raw, chr(39), '"'), '["VARCHAR"]') AS VARCHAR[]) WHEN raw IS NULL THEN [] ELSE [raw] END AS tags FROM r)
SELECT id, array_to_string(list_filter(list_transform(tags, lambda x: trim(x)), lambda x: x <> ''), '|') AS tags FROM t""",
    "ui_cache_join": W(f", {CATALOG} SELECT c.book_id, b.title, publisher, num_pages, average_rating FROM c LEFT JOIN books b USING (book_id)"),
    "result_enrichment": f"{VIEWS}, {SIMILAR} SELECT CAST(vec_id AS STRING) AS book_id, score, title, CASE WHEN title IS NOT NULL THEN 0 END AS score_ui FROM sim LEFT JOIN books ON book_id = CAST(vec_id AS STRING)",
    "search_page": f"WITH {SIMILAR}, r AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank, * FROM sim) SELECT * FROM r WHERE rank BETWEEN 5 AND 8",
    "neighborhood_slice": f"WITH {MEMBERS} SELECT vec_id, CAST(cluster_rank AS INTEGER) AS cluster_rank, cluster_size FROM m WHERE cluster_id = 3 AND cluster_rank <= 10",
    "display_scalars": W("""SELECT book_id, concat(repeat('★', n), repeat('☆', 5 - n)) AS stars, array_to_string(list_transform(list_filter(string_split(regexp_replace(title, '[^A-Za-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')[1:2], lambda x: upper(x[1])), '') AS initials,
CASE WHEN length(description) > 10 THEN concat(left(description, 10), '…') ELSE description END AS preview, text_reviews_count <> 0 AS shown, concat('&lt;', publisher, '&amp;&gt;') AS escaped, CASE WHEN average_rating <= 1 THEN average_rating * 100 ELSE average_rating END AS pct
FROM (SELECT *, CAST(round_even(average_rating, 0) AS INTEGER) AS n FROM books)"""),
    "controversy_score": W(""", s AS (SELECT book_id, count(*) AS n, round(stddev_samp(rating) * (avg(CAST(rating = 1 AS INTEGER)) + avg(CAST(rating = 5 AS INTEGER))), 6) AS score FROM interactions WHERE rating BETWEEN 1 AND 5 GROUP BY 1 HAVING count(*) >= 20 ORDER BY score DESC, book_id LIMIT 15)
SELECT s.*, title FROM s LEFT JOIN books USING (book_id)"""),
    "shelf_top30": W("SELECT shelf, count(*) AS n FROM (SELECT unnest(string_split(popular_shelves, ',')) AS shelf FROM books) GROUP BY 1 ORDER BY n DESC, shelf LIMIT 30"),
    "field_coverage": W(" UNION ALL ".join(f"SELECT '{c}' AS field, '{kind}' AS kind, round(avg(CAST({c} IS NOT NULL AS INTEGER)), 6) AS non_null, round(avg(CAST(coalesce(CAST({c} AS STRING), '') <> '' AS INTEGER)), 6) AS non_empty, min(CASE WHEN CAST({c} AS STRING) <> '' THEN left(CAST({c} AS STRING), 80) END) AS sample FROM reviews" for c, kind in (("review_text", "string"), ("language_code", "string"), ("n_votes", "int")))),
    "equal_width_histograms": W(" UNION ALL ".join(f"""SELECT '{name}' AS name, i AS bin, round({low} + i * {(high - low) / bins}::DOUBLE, 6) AS low, (SELECT count(*) FROM {t} WHERE {c} BETWEEN {low} AND {high} AND least(CAST(floor(({c} - {low}) * {bins}::DOUBLE / {high - low}) AS BIGINT), {bins - 1}) = i) AS n FROM range({bins}) r(i)"""
        for name, t, c, bins, low, high in (("chars_40", "documents", "n_chars", 40, 0, 5000), ("chars_60", "documents", "n_chars", 60, 0, 2000), ("pages_50", "books", "num_pages", 50, 0, 2000), ("ratings_40", "books", "average_rating", 40, 1, 5)))),
    "predicate_shares": W(" UNION ALL ".join(f"SELECT '{name}' AS predicate, count(*) FILTER ({p}) AS n, count(*) AS rows, round(count(*) FILTER ({p}) / CAST(count(*) AS DOUBLE), 6) AS share FROM reviews"
        for name, p in (("rated", "rating > 0"), ("ten words", "len(list_filter(string_split_regex(review_text, '\\s+'), lambda x: x <> '')) >= 10"), ("coded", "trim(language_code) <> ''"), ("isbn", "language_code IS NOT NULL AND language_code NOT IN ('', 'None')"), ("voted", "n_votes > 0")))),
    "sparsity": W("SELECT users, items, round(1 - CAST(n AS DOUBLE) / (users * items), 8) AS sparsity FROM (SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT book_id) AS items FROM interactions)"),
    "seeded_sample": "SELECT doc_id, md5(concat('42', doc_id)) AS h FROM documents ORDER BY h, doc_id LIMIT 3",
    "equal_width_bins": "SELECT least(CAST(floor(n_chars / 100.0) AS BIGINT), 49) AS bin, count(*) AS n FROM documents WHERE n_chars <= 5000 GROUP BY 1",
    "numeric_summary": "SELECT count(n_chars) AS n, round(avg(n_chars), 4) AS mean, round(stddev_samp(n_chars), 4) AS sd, min(n_chars) AS low, " + ", ".join(f"quantile_cont(CAST(n_chars AS DOUBLE), {q}) AS q{int(q * 100)}" for q in (0.25, 0.5, 0.75)) + ", max(n_chars) AS high FROM documents",
    "value_counts": "SELECT event_type, count(*) AS n, round(avg(CAST(value > 50 AS INTEGER)), 6) AS above, count(props) AS with_props FROM events GROUP BY 1",
    "clip_log_length": "SELECT doc_id, least(n_chars, 500) AS clipped, round(CASE WHEN n_chars > 0 THEN log10(n_chars) END, 6) AS log10_chars FROM documents",
}

_SHELF_RANKS = "k AS (SELECT book_id, title, CAST(book_id AS INTEGER) % 7 AS cluster_id, row_number() OVER (PARTITION BY CAST(book_id AS INTEGER) % 7 ORDER BY ratings_count DESC, book_id) AS r FROM books)"
_WEIGHT = "sum(CASE WHEN r <= 10 THEN 3.0::DOUBLE WHEN r <= 50 THEN 1.5 ELSE 1.0 END)"
_TOP_SHELVES = f"{CLEAN}, {_SHELF_RANKS}, ts AS (SELECT cluster_id, shelf, {_WEIGHT} AS score, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY {_WEIGHT} DESC, shelf) AS INTEGER) AS place FROM z JOIN k USING (book_id) GROUP BY 1, 2 QUALIFY place <= 8)"
_RUN = "log AS (SELECT o_orderkey % 3 = 0 AS ok, o_custkey AS input_chars, o_orderkey % 1000 AS output_tokens FROM orders)"
_NAME = f"coalesce({_map(H.FAMILY_OF)}[shelf], {_map(H.OWN_DISPLAY)}[shelf], {_TITLE})"
ORACLE |= {
    "favorites_page": W(f", f AS (SELECT unnest({list(dict.fromkeys(LIKED))}) AS book_id, CAST(unnest(range(1, {len(set(LIKED)) + 1})) AS INTEGER) AS _fav_order) SELECT book_id, title, _fav_order FROM f JOIN books USING (book_id)"),
    "cluster_list": f"WITH {MEMBERS} SELECT DISTINCT cluster_id, concat('c', cluster_id) AS cluster_label, cluster_size FROM m",
    "neighborhood_show_limit": f"WITH {MEMBERS} SELECT vec_id, CAST(cluster_rank AS INTEGER) AS cluster_rank, concat('c', cluster_id) AS cluster_label FROM m WHERE cluster_id = 2 AND cluster_rank <= 25",
    "neighborhood_members": f"{VIEWS}, {MEMBERS} SELECT CAST(vec_id AS STRING) AS book_id, CAST(cluster_rank AS INTEGER) AS cluster_rank, concat('c', cluster_id) AS cluster_label, title, publisher FROM m LEFT JOIN books ON book_id = CAST(vec_id AS STRING) WHERE cluster_id = 2 AND cluster_rank <= 25",
    "recommendations_mode": W("SELECT CAST(row_number() OVER (ORDER BY average_rating DESC, ratings_count DESC, book_id) AS INTEGER) AS rank, book_id, 'top_rated' AS mode FROM books QUALIFY rank <= 5"),
    "cluster_size_stats": f"WITH {MEMBERS}, n AS (SELECT cluster_id, count(*) AS n FROM m GROUP BY 1) SELECT count(*) AS clusters, min(n) AS least, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median, max(n) AS most, CAST(sum(n) AS BIGINT) AS members FROM n",
    "cluster_top_shelves": W(f", {_TOP_SHELVES} SELECT * FROM ts"),
    "cluster_summary": W(f""", {_TOP_SHELVES}, g AS (SELECT cluster_id, {_NAME} AS name, {_WEIGHT} AS raw FROM z JOIN k USING (book_id) GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY raw * CASE WHEN name IN {_list(H.GENERIC_DISPLAYS)} THEN 0.15::DOUBLE ELSE 1 END DESC, raw DESC, name) AS place FROM g QUALIFY place <= 8)
SELECT cluster_id, count(*) AS cluster_size, (SELECT string_agg(concat(name, ':', printf('%.2f', raw)), '|' ORDER BY place) FROM q WHERE q.cluster_id = k.cluster_id) AS best,
  (SELECT string_agg(shelf, '|' ORDER BY place) FROM ts WHERE ts.cluster_id = k.cluster_id) AS top_cleaned_shelves, string_agg(title, '|' ORDER BY r) FILTER (r <= 5) AS representative_titles, concat('A|c', cluster_id) AS selected_label_families FROM k GROUP BY cluster_id"""),
    "final_artifact": W("""SELECT book_id, title, description AS overall_judgment, 'p' AS positive_aspects, 'n' AS negative_aspects,
  CASE WHEN CAST(book_id AS INTEGER) % 2 = 0 THEN concat('["', replace(popular_shelves, ',', '","'), '"]') ELSE popular_shelves END AS top_tags FROM books"""),
    "run_averages": f"WITH {_RUN} SELECT round(avg(input_chars), 6) AS mean_input_chars, round(avg(output_tokens), 6) AS mean_output_tokens FROM log WHERE ok",
    "run_counts": f"WITH {_RUN} SELECT count(*) AS items, count(*) FILTER (ok AND output_tokens < 500) AS succeeded, count(*) FILTER (NOT ok AND output_tokens < 500) AS failed, count(*) FILTER (NOT (ok AND output_tokens < 500)) AS unresolved FROM log",
    "run_outcomes_union": f"WITH {_RUN} SELECT CASE WHEN NOT ok THEN 'Refused' END AS error_type, count(*) AS n, CAST(sum(CASE WHEN ok THEN output_tokens END) AS BIGINT) AS tokens FROM log GROUP BY ok",
    "processed_ids": "SELECT DISTINCT CAST(o_orderkey AS STRING) AS book_id FROM orders WHERE o_orderkey % 1000 < 500",
    "unknown_favorites": "SELECT DISTINCT o_custkey AS vec_id FROM orders WHERE o_custkey NOT IN (SELECT vec_id FROM embeddings)",
    "llm_input_checks": "SELECT count(*) AS n, CAST(sum(length(CAST(p_partkey AS STRING))) AS BIGINT) AS chars FROM part",
    "review_count_stats": W(", n AS (SELECT b.book_id, count(r.book_id) AS n FROM books b LEFT JOIN (SELECT * FROM reviews WHERE rating > 0) r USING (book_id) GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS total, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median, min(n) AS least, max(n) AS most FROM n"),
    "text_length_stats": "SELECT quantile_cont(CAST(length(text) AS DOUBLE), 0.5) AS median_chars, CAST(max(length(text)) AS INTEGER) AS most_chars FROM documents",
    "strict_english": f"""WITH c AS (SELECT doc_id, text, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM documents),
e AS (SELECT doc_id, length(trim(text)) >= 20 AND letters >= 15 AND latin >= letters * 0.85::DOUBLE AND len(list_filter(t, lambda x: regexp_matches(x, '\\p{{L}}'))) >= 5 AS ok FROM c), {_MODEL}, {_told('doc_id', 'text', 'documents')}
SELECT doc_id, coalesce(ok AND detected = 'en', false) AS english FROM e LEFT JOIN told USING (doc_id)""",
    "sampled_tables": W(f", {CATALOG} SELECT 'books' AS name, count(*) AS n FROM books SEMI JOIN c USING (book_id) UNION ALL SELECT 'interactions', count(*) FROM interactions SEMI JOIN c USING (book_id) UNION ALL SELECT 'reviews', count(*) FROM reviews SEMI JOIN c USING (book_id)"),
    "prototype_subset": W(""", t AS (SELECT * FROM books ORDER BY ratings_count DESC, book_id LIMIT 200), i AS (SELECT * FROM interactions SEMI JOIN t USING (book_id))
SELECT 'books' AS name, count(*) AS n FROM t UNION ALL SELECT 'interactions', count(*) FROM i WHERE user_id IN (SELECT user_id FROM i GROUP BY 1 HAVING count(*) >= 5) UNION ALL SELECT 'reviews', count(*) FROM reviews SEMI JOIN t USING (book_id)"""),
    "line_filter_before_parse": "SELECT CAST(o_orderkey AS BIGINT) AS book_id, CAST(o_custkey AS BIGINT) AS n FROM orders WHERE o_orderkey IN (SELECT p_partkey * 3 FROM part)",
    "compact_json": W("SELECT book_id, CAST(to_json(string_split(popular_shelves, ',')) AS VARCHAR) AS shelves FROM books"),
    "input_checks": "SELECT count(*) AS n FROM part",
}
