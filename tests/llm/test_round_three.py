"""Byte-level BPE, resampling and the Merkle manifest against the library and plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from foliant.llm import byte_bpe, merkle, resample

SMALL = "/root/testdata/sf0.001"
SCRAPS = ["a", "b", "e", "th", "'s", "'", "l", "ll", " ", "  ", "\n", "\t", " ", "é", "ü", "日本", "한국", "1", "23", "!", "...", "౜", "࢏", "😀", "\U00011de1", "ING", "\x1c", "\x85", "　", "Zusammen"]


@pytest.fixture(scope="module")
def library():
    path, pattern = byte_bpe.default_file()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.tokenizer(path, pattern).ranks, special_tokens={}).encode_ordinary


def test_bpe_query_equals_the_library(spark, library):
    got = {r.doc_id: r for r in byte_bpe.op11_byte_bpe(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = np.array(library(r.text or ""), "<u4")
        assert tuple(got[r.doc_id])[1:] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_bpe_of_scraps_and_long_words(library):
    bpe, rnd = byte_bpe.tokenizer(*byte_bpe.default_file()), random.Random(5)
    texts = ["".join(rnd.choice(SCRAPS) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rnd.choice("abcdefgh") for _ in range(50_000)), "a" * 50_000, " " * 5000, "é" * 9999]
    for text, ids in zip(texts, bpe.encode_all(texts), strict=True):
        assert ids.tolist() == library(text) and bpe.decode(ids) == text.encode()
    small = byte_bpe.ByteBpe(*byte_bpe.default_file(), cache=50)  # starts anew at each run
    assert [x.tolist() for x in small.encode_all(texts[:300], chars=40)] == [library(t) for t in texts[:300]]


def test_every_prefix_has_the_last_token_of_its_own_encoding():
    bpe = byte_bpe.tokenizer(*byte_bpe.default_file())
    content = "Wiederverwendungsmöglichkeiten".encode()
    known = bpe.extend(byte_bpe.Prefixes(), content)
    plain = tiktoken.Encoding("p", pat_str=r"(?s).+", mergeable_ranks=bpe.ranks, special_tokens={})
    for n in range(1, len(content) + 1):
        if content[:n] in bpe.ranks:
            assert known.last[n] == bpe.ranks[content[:n]]
        else:
            assert known.last[n] == plain._encode_single_piece(content[:n])[-1]


def test_appends_and_edits_are_exact_and_local(library):
    bpe, rnd = byte_bpe.tokenizer(*byte_bpe.default_file()), random.Random(6)
    for _ in range(400):
        held = byte_bpe.EditableText(bpe, "".join(rnd.choice(SCRAPS) for _ in range(rnd.randint(0, 20))))
        for _ in range(6):
            i = rnd.randint(0, len(held.text))
            j = rnd.randint(i, min(len(held.text), i + 4))
            new = "".join(rnd.choice(SCRAPS) for _ in range(rnd.randint(0, 4)))
            if rnd.random() < 0.3:
                i = j = len(held.text)
            text = held.text[:i] + new + held.text[j:]
            held.replace(i, j, new)
            assert held.text == text and held.ids == library(text)
    held = byte_bpe.EditableText(bpe, "many words " * 5000)
    held.encoded_bytes = 0
    held.append("and more")
    held.replace(20_000, 20_004, "few")
    assert held.encoded_bytes < 60
    with pytest.raises(ValueError):
        held.replace(5, 1, "")


def test_bpe_tables_with_odd_rows(spark, library):
    rows = [(1, None, 5), (2, "", 6), (None, "It's 12 o'clock  ", 7), (2, "", 6), (4, "x" * 20_000, 8)]
    df = spark.createDataFrame(rows, "`doc id` long, `te``xt` string, ids long")
    out = byte_bpe.encode_documents(df, id_col="doc id", text_col="te`xt")
    got = sorted(((r[0], r.ids) for r in out.collect()), key=str)
    assert got == sorted([(i, library(t or "")) for i, t, _ in rows], key=str)
    back = byte_bpe.decode_documents(out, id_col="doc id").collect()
    assert sorted([(r[0], r.text) for r in back], key=str) == sorted([(i, t or "") for i, t, _ in rows], key=str)
    assert byte_bpe.encode_documents(df.limit(0), id_col="doc id", text_col="te`xt", digests=True).collect() == []
    edits = spark.createDataFrame([(1, "one two three", 4, 7, "2"), (2, "end", None, None, "ing"), (3, None, 0, 0, None)], "doc_id long, text string, start long, end long, new string")
    done = {r.doc_id: r for r in byte_bpe.encode_edited(edits).collect()}
    assert [done[i].ids_after for i in (1, 2, 3)] == [library("one 2 three"), library("ending"), []] and done[1].ids_before == library("one two three")


def plain_words(text):
    out, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 127:
            word += c
        else:
            out, word = (out + [word] if word else out), ""
    return out + [word] if word else out


def plain_resample(docs, target, longest, buckets, per_cent, least, seed):
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]
    crc = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for table, counts in ((docs, s), (target, t)):
        for _, text in table:
            for g in grams(plain_words(text)):
                counts[crc(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        w = plain_words(text)
        found = [gain[crc(g)] for g in grams(w)]
        weight = sum(found) // len(found) if found else 0
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
        rows.append([i, len(found), weight, score, None, len(w)])
    ranked = sorted((r for r in rows if r[5] >= least and r[3] is not None), key=lambda r: (-r[3], r[0], -r[1]))
    for place, r in enumerate(ranked[: len(ranked) * per_cent // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_a_plain_version(spark, longest, monkeypatch):
    monkeypatch.setattr(resample, "ROWS", 7)
    monkeypatch.setattr(resample.Trie.__init__, "__defaults__", (None, 40))  # tries start anew often
    rnd, words = random.Random(longest), [f"w{i}" for i in range(60)] + ["Äpfel", "日本", "X9", "don't"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40))) + rnd.choice(["", "-", "\x00Q"])) for i in range(150)]
    docs += [(None, "no id " * 20), (7, docs[7][1]), (7, "other text of the same id " * 6), (900, None), (901, ""), (902, "w1 " * 20_000)]
    target = [(i, " ".join(rnd.choice(words[:20]) for _ in range(15))) for i in range(30)] + [(99, None)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score long, place long").repartition(3)
    other = spark.createDataFrame(target, "item_id long, text string")
    got = resample.resample(df, other, longest=longest, buckets=97, per_cent=30, least_words=10, seed=5).collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(docs, target, longest, 97, 30, 10, 5)
    assert resample.resample(df.limit(0), other).collect() == []
    assert len(resample.resample(df, other.limit(0)).collect()) == len(docs)


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(hashes, arity):
    """The root, and a list of (left, right) by level for each leaf."""
    paths, places, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for leaf, p in enumerate(places):
            run = level[p - p % arity : p - p % arity + arity]
            paths[leaf].append(("".join(run[: p % arity]), "".join(run[p % arity + 1 :])))
        level = [H(*level[i : i + arity]) for i in range(0, len(level), arity)]
        places = [p // arity for p in places]
    return level[0], paths


def fold(h, path):
    for left, right in path:
        h = H(left, h, right)
    return h


@pytest.mark.parametrize("arity", [2, 3])
def test_manifest_equals_a_plain_version(spark, arity, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 3)  # several passes on a small table
    value = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    rows = [(i, ["de", "en", "en", "en", "fré"][i % 5], f"tëxt {i}" * (i % 4)) for i in range(150)]
    rows += [(500, None, None), (None, "en", "x"), (None, None, ""), (7, "en", rows[7][2]), (7, "en", "other"), (501, "lone", "y" * 10_000), (502, "", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, lang string, text string, hash string").repartition(5)
    out = merkle.merkle_manifest(df, ["doc_id", "lang", "text"], "lang", "doc_id", arity=arity, other={"text": F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))})
    got = [(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.l, s.r) for s in r.path), r.folded_root) for r in out.collect()]

    groups = {}
    for r in rows:
        changed = (r[0], r[1], r[2] + "!") if r[2] is not None and r[0] is not None and r[0] % 7 == 0 else r
        groups.setdefault(r[1], []).append((r[0], H(*map(value, r)), H(*map(value, changed))))
    trees = {}
    for lang, leaves in groups.items():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = plain_tree([x[1] for x in leaves], arity)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    root, tops = plain_tree([trees[x][0] for x in langs], arity)
    want = [(i, leaf, trees[lang][0], root, tuple(p + tops[langs.index(lang)]), fold(changed, p + tops[langs.index(lang)])) for lang, leaves in groups.items() for (i, leaf, changed), p in zip(leaves, trees[lang][1], strict=True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[5] == root for r in got if r[0] is None} == {True}

    one = merkle.merkle_manifest(df.where("doc_id = 501"), ["doc_id", "text"], "lang", "doc_id").collect()
    assert len(one) == 1 and one[0].path == [] and one[0].root == one[0].subroot == one[0].leaf == one[0].folded_root
    assert merkle.merkle_manifest(df.limit(0), ["doc_id", "text"], "lang", "doc_id").collect() == []


def test_nodes_lie_in_parquet_by_level(spark):
    leaves = spark.range(600).select(F.lit("t").alias("tree"), F.col("id").alias("at"), F.lit(600).cast("long").alias("total"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("hash"))
    store = merkle.build_store(leaves)
    sizes = {r.level: r.n for p in store.passes for r in p.groupBy("level").agg(F.sum(F.size("hashes")).alias("n")).collect()}
    assert sizes == {level: -(-600 // 2**level) for level in range(10)}
    assert all("level=" in f for p in store.passes for f in p.inputFiles())
