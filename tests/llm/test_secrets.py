"""Secrets: what looks live, many matches in one text, values that are everywhere."""

import random
import string
import time
import uuid

from pyspark.sql import functions as F

from foliant.llm import secrets

NAMES = ["/wiki/World_War_2_History_Part", "/2019/05/My-Holiday-Photos-Of-Rome", "MyClassNameForTesting2Handler", "chapter-03-the-long-way-home-again", "src/main/java/org/example/App2Test", "quarterly_report_2023_final_v2_draft"]


def planted(rnd):
    base62, base36 = string.ascii_letters + string.digits, string.ascii_lowercase + string.digits
    words = ["history", "photo", "River", "Museum", "guide", "report", "Winter", "handler", "class", "index", "Station", "part"]
    live, names = [], []
    for _ in range(250):
        live += ["".join(rnd.choice(base62) for _ in range(rnd.choice([24, 32, 40]))), "".join(rnd.choice(base62 + "+/") for _ in range(40)), str(uuid.UUID(int=rnd.getrandbits(128))).upper(), "".join(rnd.choice(base36) for _ in range(32))]
        some = [rnd.choice(words) for _ in range(rnd.randint(4, 6))]
        some.insert(rnd.randint(1, len(some)), rnd.choice(["2", "2019", "v2", "03"]))
        names += ["-".join(some).lower(), "/" + "/".join(some), "_".join(w.capitalize() for w in some), "".join(w.capitalize() for w in some)]
    return live, [n for n in names if len(n) >= 20]


def test_gate_tells_tokens_from_names(spark):
    live, names = planted(random.Random(1))
    df = spark.createDataFrame([(v, True) for v in [*live, "550e8400-e29b-41d4-a716-446655440000", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"]] + [(v, False) for v in names + NAMES], "v string, live boolean")
    rows = df.select("v", "live", secrets.live_looking(F.col("v")).alias("found")).collect()
    assert not [r.v for r in rows if r.v in NAMES and r.found]
    assert all(r.found for r in rows if r.v.startswith(("550e", "wJal")))
    hits = [r for r in rows if r.found]
    assert sum(r.live for r in hits) >= 0.99 * len(hits) and sum(r.live for r in hits) >= 0.97 * sum(r.live for r in rows)


def test_names_stay_in_redacted_texts(spark):
    texts = [f"see {n} and more" for n in NAMES]
    df = spark.createDataFrame([(i, t, "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long")
    assert [r.text for r in secrets.redact(df).orderBy("doc_id").collect()] == texts


def plain_redacted(text, spans):
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + secrets.MARK
        at = max(at, b)
    return out + text[at:]


def many(n, rnd):
    return " ".join(rnd.choice([f"token={rnd.getrandbits(60):x}", f"ü {rnd.getrandbits(128):032x}", "AKIA" + "".join(rnd.choice(string.ascii_uppercase) for _ in range(16)), "plain wörds"]) for _ in range(n))


def test_many_matches_in_one_text(spark):
    rnd, took = random.Random(2), {}
    for n in (500, 2000, 16_000):
        text = many(n, rnd)
        df = spark.createDataFrame([(1, text, "s", len(text))], "doc_id long, text string, source string, n_chars long")
        began = time.time()
        found = secrets.scan_secrets(df).head().spans
        clean = secrets.redact(df).head()
        took[n] = time.time() - began
        assert len(found) > n / 2 and clean.text == plain_redacted(text, [(s.start, s.end) for s in found]) and clean.n_chars == len(clean.text)
    # eight times the matches; with work in pairs it would be 64 times
    assert took[16_000] < 10 * took[2000] + 5, took


def test_values_that_are_everywhere(spark, monkeypatch):
    monkeypatch.setattr(secrets, "WIDE", 4)
    rows = [(i, f"key token=shared{'0' * 6} and AKIA{'Q' * 16}{i % 3}", f"s{i % 2}") for i in range(12)] + [(50, "token=lonely123", "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: [(s.kind, s.owners, s.repos, s.live) for s in r.spans] for r in secrets.scan_secrets(df).collect()}
    assert got[50] == [("assign", 1, 1, True)] and all(got[i] == [("assign", 2, 12, False), ("access", 2, 4, False)] for i in range(12))


def test_blocks_and_overlapping_spans(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 7)
    monkeypatch.setattr(secrets, "STEPS", 3)
    rnd = random.Random(3)
    texts = [many(n, rnd) for n in range(12)] + ["x" * 14, "token=" + "a" * 24, "é" * 6 + "secret:" + "b" * 30 + "é"]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.scan_secrets(df).collect()}
    assert {r.doc_id: r.text for r in secrets.redact(df).collect()} == {i: plain_redacted(t, spans[i]) for i, t in enumerate(texts)}
