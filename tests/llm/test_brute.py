"""Queries and stages against plain versions on small inputs; odd rows for all ten operators."""

import collections
import math
import os
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from foliant.llm import ann, hmm, licenses, ngram_join, packing, quality, secrets, sentencepiece_lattice, topk, warc

SMALL = "/root/testdata/sf0.001"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_packing_query_equals_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.op4_packing(spark, SMALL).toPandas()
    seen = 0
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        own, at = rows[rows.doc_id == r.doc_id].sort_values("start"), 0
        assert set(own.doc_tokens) == {len(ids)}
        for p in own.itertuples():
            assert p.start == at and zlib.crc32(ids[at : at + p.length].tobytes()) == p.ids_crc32
            at, seen = at + p.length, seen + 1
        assert at == len(ids)
    assert seen == len(rows)
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        n = int(s.length.sum())
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and n <= 1024 and n & (n - 1) == 0


def test_packing_hands_on_what_windows_leave(spark):
    df = spark.createDataFrame([(i, "word " * (i % 90)) for i in range(600)], "doc_id long, text string").coalesce(1)
    used = packing.pack_documents(df, window_tokens=3000).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n != 1024 for r in used) <= 10


def test_base_scores_equal_counts(spark):
    docs = [(r.doc_id, (r.text or "").encode().lower().split()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    counts = collections.Counter()
    for i, words in docs:
        if crc(i) % 7 != 2:
            counts.update([*words, None])
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in hmm.op9_hmm_scores(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, words in docs:
        tokens = [*words, None]
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 7 == 2, len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0


def test_quality_scores_equal_a_plain_version(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_outside_fold(docs, labels)
    rows = docs.orderBy("doc_id").limit(40).collect()
    got = {r.doc_id: r for r in quality.op3_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    sizes = lambda d, part: len(zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(part))
    for r in rows:
        x = (r.text or "").encode()
        parts = [x[p : p + model.chunk] for p in range(0, len(x), model.chunk)]
        a, b = ([sizes(d, p) for p in parts] for d in (model.good, model.bad))
        f = [0.0] * 4 if not x else [(sum(b) - sum(a)) / (sum(a) + sum(b)), min((v - u) / (u + v) for u, v in zip(a, b)), sum(a) / len(x), math.log1p(len(x))]
        f = [*f, *(y * y for y in f), *(f[0] * y for y in f[1:]), f[2] * f[3]]
        z = model.weights[0] + sum(w * (y - m) / s for w, y, m, s in zip(model.weights[1:], f, model.mean, model.spread))
        assert math.isclose(got[r.doc_id].score, 1 / (1 + math.exp(-max(-30, min(30, z)))), rel_tol=1e-6)
        assert got[r.doc_id].held_out == (crc(r.doc_id) % 4 == 2) and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.7)


def test_the_size_difference_carries_the_quality_score(spark):
    """Held-out ranking by the normalised difference alone is far above chance, and near that of the whole score."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_outside_fold(docs, labels)
    rows = [r for r in docs.join(labels, "doc_id").select("doc_id", "text", "quality").collect() if crc(r.doc_id) % 4 == 2][:600]
    y = np.array([r.quality for r in rows], bool)
    area = lambda s: np.mean([(s[y][:, None] > s[~y]).mean(), (s[y][:, None] >= s[~y]).mean()])
    one, whole = area(quality.features([r.text for r in rows], model)[:, 0]), area(quality.predict([r.text for r in rows], model))
    assert one > 0.8 and whole >= one - 0.02


def test_viterbi_equals_brute_force(spark):
    """Hand-made unigram pieces, with ties: of equal scores the path that enters each place from the earliest."""
    table = [("a", 1, -2.0), ("b", 2, -2.5), ("c", 3, -3.0), ("ab", 4, -4.0), ("bc", 5, -3.5), ("abc", 6, -7.0), ("5", 7, -3.0), ("55", 8, -3.0)]
    pieces = sentencepiece_lattice.Pieces(tuple(table), (0,) * 256, False)
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abc5"), rng.integers(1, 9))) for _ in range(60)} | {"555", "5" * 80})
    score = {p: (s, i) for p, i, s in table}
    for r in sentencepiece_lattice.lattice(spark.createDataFrame([(w,) for w in words], "word string"), pieces).collect():
        best = [(0.0, 0)]
        for end in range(1, len(r.word) + 1):
            best.append(max((best[at][0] + score[r.word[at:end]][0], -at) for at in range(end) if r.word[at:end] in score))
        end, ids = len(r.word), []
        while end:
            at = -best[end][1]
            ids.insert(0, score[r.word[at:end]][1])
            end = at
        assert list(r.ids) == ids, r.word


def test_keep_one_of_repeated_ids_and_clashing_names(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(1, a, 1), (1, b, 2), (2, a + " x", 3), (3, b, 4), (4, "", 5), (4, None, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id int").withColumn("row", F.lit(1)).withColumn("digest", F.lit(2)).withColumn("a.b", F.lit(3))
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.kept_id for r in kept.collect()) == [1, 2, 5, 6]
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_jaccard_join(df).collect()}
    assert got == {(1, 26): 1, (2, 27): 1, (3, 26): 1, (4, 0): 4}


def test_redact_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "token = abcdef123 end", "s", 21, 7)], "doc_id long, text string, source string, n_chars long, spans int").withColumns({"_spans": F.lit(8), "changed": F.lit(9), "span_key": F.lit(10), "a.b": F.lit(1)})
    out = secrets.redact(df)
    r = out.head()
    assert out.columns == df.columns and (r.text, r.n_chars, r.spans, r["_spans"], r.changed, r.span_key) == ("[SECRET] end", 12, 7, 8, 9, 10)


def test_opaque_strings_that_look_live(spark):
    live = ["kJ8sQ2vLx0ZtB7nWc4Rm", "q7x2m9k4v8z1t6w3r5y0"]
    plain = ["/blog/top-10-best-books-of-2011-so-far", "photo_2011-05-01_holiday_001", "averyveryverylongword2011"]
    df = spark.createDataFrame([(i, t, f"o{i}") for i, t in enumerate(live + plain)], "doc_id long, text string, source string")
    assert [len(r.spans) for r in secrets.scan_secrets(df).orderBy("doc_id").collect()] == [1, 1, 0, 0, 0]


def test_warc_of_missing_and_altered_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * (i * 40)) for i in range(60)], "page_id long, url string, html string")
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w", roll_bytes=500, shard_bytes=4000).collect()
    assert len(manifest) > 3 and warc.read_warc(spark, f"file://{tmp_path}/w").count() == 60
    path = tmp_path / "w" / manifest[0].file
    whole = path.read_bytes()
    path.write_bytes(whole[:-1] + bytes([whole[-1] ^ 1]))
    with pytest.raises(Exception, match="altered"):
        warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    os.remove(path)
    with pytest.raises(FileNotFoundError):
        warc.read_warc(spark, f"file://{tmp_path}/w")


def test_products_beyond_a_long_raise():
    with pytest.raises(OverflowError):
        topk.inner_products(np.full((1, 4), 2.0**40), np.full((1, 4), 2.0**40))


def test_long_texts_ties_and_nothing(spark):
    long = " ".join(f"w{i % 9973}" for i in range(120_000))
    ddl = "doc_id long, text string, source string, n_chars long, row string, key int, g int, word string, bucket int"
    rows = [(i, t, None, 1, "r", 1, 2, "w", 3) for i, t in ((1, long), (2, long), (2, long), (3, None), (4, ""), (None, "one two"))]
    docs, none = spark.createDataFrame(rows, ddl), spark.createDataFrame([], ddl)
    assert {r.doc_id: r.component_id for r in ngram_join.ngram_jaccard_join(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    packed = packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in packed}[3] == 1 and len(packed) == 5
    assert secrets.scan_secrets(docs).count() == 6 and licenses.scan_licenses(docs).count() == 6 and hmm.score_texts(docs, rounds=1, classes=64).count() == 6
    assert licenses.scan_licenses(none).count() == 0 and secrets.redact(none).count() == 0 and ngram_join.keep_one(none).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.exact_top_k(vectors, vectors).count() == 0 and ann.ann_search(vectors, vectors).count() == 0
