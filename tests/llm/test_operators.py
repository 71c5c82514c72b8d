import gzip
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import ann, hmm, licenses, ngram_join, packing, quality, secrets, sentencepiece_lattice, topk, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, key string, g int"
WORDS = [f"w{i}" for i in range(60)]
BASE = " ".join(WORDS)


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty texts, short ones, copies, near copies, repeated rows, and columns with names used inside."""
    rows = [(1, BASE), (2, BASE.upper()), (3, BASE + " extra"), (4, None), (5, ""), (6, "one two"), (7, "one  two"), (8, "three"), (9, "x " * 3000), (3, BASE + " extra"), (None, "nobody")]
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), "k", 1) for i, t in rows], DOC)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def brute_links(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and sets[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_join_equals_brute_force(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    for i in range(60):  # near copies around the threshold
        w = list(WORDS)
        for k in rng.choice(60, rng.integers(0, 5), replace=False):
            w[k] = f"n{rng.integers(9)}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_links(rows)
    got = ngram_join.ngram_jaccard_join(df).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("span", [1, 3])
def test_join_of_many_units_equals_brute_force(spark, monkeypatch, span):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "SPAN", span)
    monkeypatch.setattr(ngram_join, "GUESTS", 8)
    rng, rows = np.random.default_rng(5), []
    for i in range(50):
        w = list(WORDS)
        for k in rng.choice(60, rng.integers(0, 4), replace=False):
            w[k] = f"n{rng.integers(9)}"
        rows.append((i, " ".join(w)))
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_links(rows)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(56)} for i, t in rows}
    links = {i: sum(100 * len(a & b) >= 75 * len(a | b) for j, b in sets.items() if j != i) for i, a in sets.items()}
    assert {r.doc_id: r.n_links for r in got} == links


def test_packed_sets_round_trip():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 5, 300)] * 2
    assert all((a == b).all() for a, b in zip(sets, ngram_join.unpacked_sets(*ngram_join.packed_sets(sets)), strict=True))


def test_bounds_round_trip():
    home, times, lo, hi = np.array([0, 0, 7, 2**40 - 1]), np.array([1, 300, 2, 9]), np.array([0, 5, 20_000, 1]), np.array([70_000, 5, 20_001, 1])
    assert all((a == b).all() for a, b in zip((home, times, lo, hi), ngram_join._unbound(ngram_join._bounds(home, times, lo, hi)), strict=True))


def test_join_of_nothing(none):
    assert ngram_join.ngram_jaccard_join(none).count() == 0


def test_keep_one(docs):
    kept = ngram_join.keep_one(docs)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 8, 9] and kept.columns == docs.columns


def test_tree_join_equals_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.choice(30, rng.integers(1, 28))).astype(np.uint64) for _ in range(80)]
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert set(ngram_join.tree_join(sets, None, 75)) == want


def test_packing_is_whole_and_tight(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack_documents(docs.coalesce(1), with_ids=True).toPandas()
    assert all(zlib.crc32(np.array(i, dtype="<u4").tobytes()) == c for i, c in zip(rows.ids, rows.ids_crc32))
    used = rows.groupby("sequence_id").length.sum()
    assert used.max() <= 1024 and all(n & (n - 1) == 0 for n in used)
    nine = rows[rows.doc_id == 9].sort_values("start")
    assert [x for i in nine.ids for x in i] == [*t.encode("x " * 3000, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("text", ["a  b", "a \n b", " lead", "trail ", "x\n\ny", "<|endoftext|> a", "é  b", "", "tab\tx", "don't  "])
def test_chunked_ids_equal_the_library(text):
    import public_tokenizers

    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.chunked and bpe.encode(text).tolist() == bpe.whole.encode(text, add_special_tokens=False).ids


def test_packing_of_nothing(none):
    assert packing.pack_documents(none).count() == 0


def test_quality(spark, docs, none):
    rows = [(i, ("good words flow here " if i % 2 else "BAD!! JUNK!! ") * 40) for i in range(200)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit_outside_fold(train, labels)
    p = quality.predict(["good words flow here " * 30, "BAD!! JUNK!! " * 30, "", None], model)
    assert p[0] > 0.7 > p[1] and p[2] == p[3]
    assert quality.keep_good(none, model).count() == 0 and quality.keep_good(docs, model).columns == docs.columns
    assert quality.fit_quality(train, labels.where("false")).weights[0] == 0


def test_secrets(spark, none):
    own, wide = "abcdefghijk0123456789XYZ", "0123456789abcdef01234567"
    rows = [(1, f"é token = \"{wide}\" x {own}", "a"), (2, f"secret:{wide}", "b"), (3, f"api_key=short token=abc secret=token:abcdefg", "c"), (4, None, None), (None, "AKIA" + "A" * 16, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: [(s.kind, s.start, s.end, s.live) for s in r.spans] for r in secrets.scan_secrets(df).collect()}
    assert got[1] == [("assign", 2, 35, False), ("hex", 11, 35, False), ("opaque", 39, 63, True)]
    assert got[2] == [("assign", 0, 31, False), ("hex", 7, 31, False)] and got[4] == [] and got[None] == [("access", 0, 20, True)]
    assert got[3] == []
    clean = {r.doc_id: (r.text, r.n_chars) for r in secrets.redact(df).collect()}
    assert clean[1] == ("é [SECRET]\" x [SECRET]", 22) and clean[4] == (None, None)
    assert secrets.scan_secrets(none).count() == 0


def test_licenses(docs):
    df = docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\nReleased under the MIT License.")).alias("text"))
    assert {n.license for r in licenses.scan_licenses(df).collect() for n in r.notices} == {"MIT"}
    assert all(not r.notices for r in licenses.scan_licenses(docs).collect())


def test_licenses_wrapped_and_inline(spark):
    words = dict((name, text.split()) for name, text in licenses.TEMPLATES if len(text) > 150)
    wrap = lambda w: "\n".join(" ".join(w[i : i + 9]) for i in range(0, len(w), 9))
    rows = [("\n".join([BASE, BASE, wrap(words[name]), BASE]), {(name, 3)}) for name in ("Apache-2.0", "MIT", "MPL-2.0", "ISC")]
    rows += [(f"{BASE} Released under the MIT License. {BASE}", {("MIT", 1)}), (f"{BASE}\n{BASE} Licensed under CC BY-SA 4.0. {BASE}", {("CC-BY-SA-4.0", 2)})]
    rows += [(f"{BASE} {' '.join(words['MIT'])} {BASE}", {("MIT", 1)}), (f"{BASE} Released under\nthe MIT License. {BASE}\nReleased under the MIT License.", {("MIT", 1), ("MIT", 3)})]
    rows += [(f"{BASE} released under {BASE} the license {BASE} mit", set()), (wrap(words["ISC"]), {("ISC", 0)})]
    rows += [(f"{BASE}\nThis work is licensed under the GNU\nGeneral Public License, version 3. {BASE}", {("GPL-3.0", 2)})]
    got = licenses.scan_licenses(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: {(n.license, n.line) for n in r.notices} for r in got} == {i: want for i, (_, want) in enumerate(rows)}


def test_sentencepiece_equals_the_library(docs, none):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, pieces = SentencePieceProcessor(model_file=path), sentencepiece_lattice.load_pieces(path)
    df = docs.unionByName(docs.limit(1).withColumn("text", F.lit("Hello  wörld\n日本 😀 under_score!")))
    coded = sentencepiece_lattice.decode_ids(sentencepiece_lattice.encode_texts(df, pieces), pieces).collect()
    want = sorted(tuple(sp.encode(r.text or "")) for r in df.collect())
    assert sorted(tuple(r.ids) for r in coded) == want
    assert sorted(r.text for r in coded) == sorted(r.text or "" for r in df.collect())


def test_sentencepiece_of_long_and_odd_texts(spark, none):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, pieces = SentencePieceProcessor(model_file=path), sentencepiece_lattice.load_pieces(path)
    rng = np.random.default_rng(7)
    texts = [None, "", " ", "   ", "a" * 700, *(" " * n + "x" for n in (1, 7, 14, 15, 16, 17, 29, 31, 47, 130)), "the" * 60, "a\u2581b", " lead", "trail ", "\x00\u200b\n\n\n", *("".join(rng.choice(list("abehinorst ▁é.,1"), 120)) for _ in range(60))]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, g int")
    want = {i: sp.encode(t or "") for i, t in enumerate(texts)}
    for settings in ({}, {"group_chars": 200, "run_chars": 90, "cached": 5, "bucket_chars": 9}):
        got = {r.doc_id: r for r in sentencepiece_lattice.encode_texts(df, pieces, **settings).collect()}
        assert {i: list(r.ids) for i, r in got.items()} == want
        assert all(r.n_ids == len(want[i]) and r.ids_crc32 == zlib.crc32(np.array(want[i], dtype="<u4").tobytes()) for i, r in got.items())
    assert sentencepiece_lattice.encode_texts(none, pieces).count() == 0


def test_sentencepiece_query_decodes(spark):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: zlib.crc32(sp.decode(sp.encode(r.text or "")).encode()) for r in df.collect()}
    assert {r.doc_id: r.text_crc32 for r in sentencepiece_lattice.op7_sentencepiece(spark, "/root/testdata/sf0.001").collect()} == want


def vectors(spark, n=300):
    x = np.random.default_rng(3).normal(size=(n, 8))
    rows = [(i, x[i].tolist()) for i in range(n)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1100, x[5].tolist()), (None, x[0].tolist()), (1003, [1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), x


@pytest.mark.parametrize("fan_in", [2, 32])
def test_exact_top_k(spark, fan_in):
    df, x = vectors(spark)
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk.exact_top_k(df, df.where("vec_id % 100 = 0"), shard_rows=50, block_rows=2, fan_in=fan_in).collect()}
    ids = np.array([*range(300), 1001, 1100])
    z = np.floor(1024 * np.vstack([x, np.zeros(8), x[5]])).astype(int)
    for q in (0, 100, 200, 1100):
        s = z @ z[ids == q][0]
        want = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -v) for v, i in want]


def test_ann_reranks_exactly(spark):
    df, x = vectors(spark)
    got = ann.ann_search(df, df.where("vec_id % 100 = 0"), probe_share=1.0, shard_rows=50).collect()
    ids, z = np.array([*range(300), 1100]), np.vstack([x, x[5]])
    for q in (0, 100, 200, 1100):
        d = np.sqrt(((z - z[ids == q][0]) ** 2).sum(1))
        want = [i for _, i in sorted((d[k], ids[k]) for k in range(len(ids)) if ids[k] != q)[:10]]
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert ann.ann_search(df.where("false"), df).count() == 0


def test_ann_of_long_lists_and_copies(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(3000, 8)), np.repeat(rng.normal(size=(1, 8)), 1500, axis=0)])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    asked, copies = np.concatenate([ids[:3000:100], ids[3000:3004]]), np.sort(ids[3000:])
    got = ann.ann_search(df, df.where(F.col("vec_id").isin(asked.tolist())), sample_rows=8, probe_share=1.0).collect()  # a few codes for all, so that many rows tie
    found = {q: [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] for q in asked.tolist()}
    for q in ids[3000:3004]:
        assert found[q] == [i for i in copies if i != q][:10]
    hits = [len(set(found[q]) & set(ids[[j for j in np.lexsort((ids, ((x - x[ids == q][0]) ** 2).sum(1))) if ids[j] != q][:10]])) for q in asked.tolist()]
    assert sum(hits) >= 9 * len(asked)


def test_ann_prunes_by_codes_with_recall(spark):
    """Lists longer than the rerank bound, probing on, 5 % of the rows compared exactly: recall against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got: dict = {}
    for r in ann.ann_search(df, df.where("vec_id % 100 = 0"), sample_rows=150, rerank=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = [r for r in df.collect() if r.embedding is not None and np.isfinite(np.array(r.embedding, float)).all() and any(r.embedding)]
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hits = 0
    for q, found in got.items():
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        hits += len(found & set([i for i in ids[np.lexsort((ids, d))] if i != q][:10]))
    assert hits >= 9 * len(got)


def test_distance_tables_give_coded_distances():
    x = np.random.default_rng(9).normal(size=(200, 10))
    index = ann.fit_index(x, 6, parts=4, codes=16)
    at = index.nearest_lists(x, 1)[:, 0]
    codes = index.encode(x, at)
    coded = index.pad(index.coarse)[at] + np.concatenate([b[codes[:, p]] for p, b in enumerate(index.books)], axis=1)
    rough = index.constants(at, codes) + ann.squared(x[:1], index.coarse)[0][at] + index.tables(x[:1])[0][np.arange(4), codes].sum(1)
    assert np.allclose(rough, ((index.pad(x[:1]) - coded) ** 2).sum(1))


def test_hmm_likelihood_equals_sum_over_paths():
    rng = np.random.default_rng(4)
    norm = lambda a: a / a.sum(-1, keepdims=True)
    m = hmm.Hmm(norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 3))))
    seq = np.array([0, 2, 1, 1])
    total = sum(np.prod([m.start[p[0]] * m.emit[p[0], 0]] + [m.step[p[t - 1], p[t]] * m.emit[p[t], seq[t]] for t in (1, 2, 3)]) for p in np.ndindex(2, 2, 2, 2))
    assert np.isclose(hmm.log_likelihoods(m, [seq, seq[:1]])[0], np.log(total))
    begun, steps, emitted, log = hmm.expected_counts(m, [seq])
    assert np.isclose(begun.sum(), 1) and np.isclose(steps.sum(), 3) and np.isclose(emitted.sum(), 4) and np.isclose(log, np.log(total))


def test_hmm_scores(docs, none):
    rows = hmm.score_texts(docs, rounds=1, classes=64).collect()
    assert len(rows) == 11 and all(np.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (4, 5)} == {1}
    assert hmm.score_texts(none, rounds=1, classes=64).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a/ b", big), (2, None, big), (3, "u", "x"), (4, "u", "x"), (5, "u", None), (3, "u", "x"), (None, "n", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = f"file://{tmp_path}/w"
    manifest = warc.write_warc(pages, out, roll_bytes=200).collect()
    got = sorted(((r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, out).collect())
    assert got == [(0, "revisit", 2, 1200), (1, "revisit", 2, 1200), (2, "response", None, 1200), (3, "response", None, 1), (3, "response", None, 1), (4, "response", None, 1), (5, "response", None, 0)]
    again = warc.write_warc(pages, f"file://{tmp_path}/v", roll_bytes=200).collect()
    assert sorted((r.file, r.sha1) for r in manifest) == sorted((r.file, r.sha1) for r in again)
    assert warc.write_warc(pages.where("false"), f"file://{tmp_path}/e").count() == 0
    records = [f for r in manifest for f, _ in warc.parse_warc(gzip.open(tmp_path / "w" / r.file))]
    ids = [f["warc-record-id"] for f in records]
    assert len(ids) == len(set(ids)) == len(rows) + len(manifest)
    assert {f["warc-refers-to"] for f in records if f["warc-type"] == "revisit"} == {f["warc-record-id"] for f in records if f["warc-type"] == "response" and f["x-page-id"] == "2"}


def test_warc_reader_moves_no_contents(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 500) for i in range(40)], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w", shard_bytes=5000)
    plan = warc.read_warc(spark, f"file://{tmp_path}/w", with_payload=True)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "Join" not in plan


def test_warc_shards_of_far_ids_and_null_ids(spark, tmp_path):
    rows = [(i if i % 3 else None, "u", f"{i} " * 50) for i in range(90)] + [(-5, "u", "x"), (2**62, "u", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = f"file://{tmp_path}/w"
    manifest = sorted(warc.write_warc(pages, out, shard_bytes=4000, roll_bytes=1 << 20).collect(), key=lambda r: r.shard)
    assert [r.shard for r in manifest] == list(range(len(manifest))) and len(manifest) > 10
    assert max(r.records for r in manifest) <= 10 and sum(r.records for r in manifest) == 92
    ends = [(r.first_id, r.last_id) for r in manifest if r.first_id is not None]
    assert all(a <= b for a, b in ends) and all(x[1] < y[0] for x, y in zip(ends, ends[1:], strict=False))
    assert sorted((r.page_id is None, r.page_id) for r in warc.read_warc(spark, out).select("page_id").collect()) == sorted((i is None, i) for i, *_ in rows)
    again = warc.write_warc(pages.repartition(7), f"file://{tmp_path}/v", shard_bytes=4000, roll_bytes=1 << 20).collect()
    assert {(r.file, r.sha1) for r in manifest} == {(r.file, r.sha1) for r in again}


def test_ann_query_has_its_recall_at_its_own_parameters(spark):
    """The registered query on sf0.1 against brute force."""
    got: dict = {}
    for r in ann.op8_ann(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hits = sum(len(found & set([i for i in ids[np.lexsort((ids, ((x - x[ids == q][0]) ** 2).sum(1)))] if i != q][:10])) for q, found in got.items())
    assert len(got) == 20 and hits >= 9 * len(got)
