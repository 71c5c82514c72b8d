"""Calls of a client, their log as a stream, versions of tables, and counters of the ingest."""

import gzip
import json
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliant.functions import scalars as S
from foliant.operators import checks, client, search, serve, summaries, tables
from foliant.plans.job import preprocess
from foliant.sources import raw, versions
from foliant.streaming import resume

GOOD = {"overall_judgment": "good", "top_tags": ["A", "B"]}


def items_of(spark, n):
    return spark.createDataFrame([(str(i), str(i)) for i in range(n)], "book_id string, prompt string")


def test_attempts_are_kept(spark):
    tries = Counter()

    def flaky(prompt):
        tries[prompt] += 1
        if prompt in "01" and tries[prompt] < 3:
            raise TimeoutError("slow")
        if prompt == "1":
            raise ValueError("wrong")
        if prompt == "2":
            raise ConnectionError("gone")
        if prompt == "3":
            return {"book_id": " 3 ", **GOOD}
        if prompt == "4":
            return {"book_id": "4", "overall_judgment": "x", "top_tags": ["A", " "]}
        return {"book_id": prompt, **GOOD}

    rows = {r.book_id: r for r in summaries.run_pending(items_of(spark, 5).coalesce(1), flaky, sleep=lambda s: None).collect()}
    assert {i: (r.ok, r.attempts, r.error_type) for i, r in rows.items()} == {"0": (True, 3, None), "1": (False, 3, "ValueError"), "2": (False, 5, "ConnectionError"), "3": (True, 1, None), "4": (False, 1, "ValueError")}
    assert rows["0"].top_tags == ["A", "B"] and rows["0"].timestamp_utc.endswith("Z")


def test_answers_made_of_blocks():
    class Block:
        type, name, input = "tool_use", summaries.RESPONSE_NAME, {"book_id": "1", **GOOD}

    class Answer:
        content = [{"type": "text"}, Block()]

    for answer in (Answer(), {"content": [{"type": "tool_use", "name": summaries.RESPONSE_NAME, "input": Block.input}]}, Block.input):
        assert summaries.validated(summaries.payload_of(answer), "1")["judgment"] == "good"
    for answer in ({"content": []}, {"content": [{"type": "tool_use", "name": summaries.RESPONSE_NAME, "input": None}]}):
        with pytest.raises(ValueError):
            summaries.payload_of(answer)
    assert set(summaries.RESPONSE_SCHEMA["required"]) == set(summaries.RESPONSE_SCHEMA["properties"])


def test_retries_by_name_pace_and_order():
    class RateLimitError(Exception):
        pass

    class Sub(RateLimitError):
        pass

    again = client.retried_by_name(["RateLimitError"])
    assert again(RateLimitError()) and again(TimeoutError()) and not again(Sub()) and not again(ValueError())
    with pytest.raises(client.CallFailed) as e:
        client.with_retries(lambda: (_ for _ in ()).throw(RateLimitError("x")), again, 3, lambda s: None)
    assert e.value.attempts == 3 and isinstance(e.value.error, RateLimitError)
    now, slept = [0.0], []
    pace = client.Pace(4, sleep=slept.append, clock=lambda: now[0])
    for _ in range(4):
        pace()
    assert slept == [0.25, 0.5, 0.75]
    running, most, lock = [0], [0], threading.Lock()

    def work(i):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
        time.sleep(0.01)
        with lock:
            running[0] -= 1
        return i

    assert list(client.in_order(work, range(40), 4)) == list(range(40)) and 1 < most[0] <= 4


def test_a_job_shares_one_rate(spark):
    with pytest.raises(ValueError):
        summaries.run_pending(items_of(spark, 3), lambda p: {"book_id": p, **GOOD}, a_second=5)
    began = time.time()
    rows = summaries.run_pending(items_of(spark, 24), lambda p: {"book_id": p, **GOOD}, tasks=2, a_second=20.0, at_once=3).collect()
    assert len(rows) == 24 and all(r.ok for r in rows) and time.time() - began > 22 / 20


def test_a_killed_stream_goes_on(spark, tmp_path):
    calls, source, log = tmp_path / "calls", f"{tmp_path}/items", f"{tmp_path}/log"
    calls.mkdir()

    def answering(prompt, fail=False):
        if fail and prompt == "17":
            raise KeyboardInterrupt  # takes the task, and so the run, with it
        with open(calls / f"{prompt}-{time.time_ns()}", "w"):
            pass
        if prompt == "5":
            raise ValueError("never")
        return {"book_id": prompt, **GOOD}

    items_of(spark, 40).write.parquet(source)
    with pytest.raises(Exception):
        resume.summarize_available(spark, source, log, f"{tmp_path}/checkpoint", lambda p: answering(p, True), parts=8)
    done = {r.book_id for r in resume.read_log(spark, log).where("ok").collect()}
    assert 0 < len(done) < 40
    before = Counter(p.name.split("-")[0] for p in calls.iterdir())
    resume.summarize_available(spark, source, log, f"{tmp_path}/checkpoint", answering, parts=8)
    after = Counter(p.name.split("-")[0] for p in calls.iterdir())
    assert all(after[i] == before[i] for i in done)
    got = resume.read_log(spark, log).collect()
    assert sorted(r.book_id for r in got) == sorted(map(str, range(40))) and [r.book_id for r in got if not r.ok] == ["5"]
    items_of(spark, 42).where("book_id in ('5', '7', '40', '41')").write.mode("append").parquet(source)
    resume.summarize_available(spark, source, log, f"{tmp_path}/checkpoint", lambda p: {"book_id": p, **GOOD}, parts=8)
    last = resume.compact(spark, log, f"{tmp_path}/table")
    assert last.count() == 42 and last.where("ok").count() == 42 and resume.read_log(spark, log).count() == 43
    assert summaries.run_counts(items_of(spark, 43), last).head().unresolved == 1


def test_versions_are_swapped_in(spark, tmp_path):
    root = f"{tmp_path}/t"
    one = spark.range(3)
    assert versions.read_version(spark, root, one.schema).count() == 0 and versions.current_version(spark, root) is None
    first = versions.write_version(one, root)
    now = versions.read_version(spark, root, one.schema)
    second = versions.write_version(now.unionAll(now), root)  # reads what it replaces
    assert first != second == versions.current_version(spark, root) and versions.read_version(spark, root, one.schema).count() == 6 and now.count() == 3
    with pytest.raises(Exception):
        versions.write_version(spark.range(1).select(F.raise_error(F.lit("no")).alias("id")), root)
    assert versions.current_version(spark, root) == second
    assert versions.drop_old_versions(spark, root) == 2 and versions.read_version(spark, root, one.schema).count() == 6


def test_compacted_log_keeps_the_last_record(spark, tmp_path):
    ddl = summaries.OUTPUT_DDL
    blank = dict.fromkeys(c.split()[0] for c in ddl.split(", "))
    rows = [blank | {"book_id": b, "ok": ok, "attempts": n, "timestamp_utc": t} for b, ok, n, t in (("1", False, 5, "2024-01-01T00:00:00Z"), ("1", True, 1, "2024-01-02T00:00:00Z"), ("2", True, 1, "2024-01-01T00:00:00Z"), ("2", False, 2, "2024-01-01T00:00:00Z"))]
    raw.append_log(spark.createDataFrame([tuple(r.values()) for r in rows], ddl), f"{tmp_path}/log")
    log = raw.jsonl_records(spark, f"{tmp_path}/log", ddl)
    got = summaries.compacted(log, f"{tmp_path}/c").orderBy("book_id").collect()
    assert [(r.book_id, r.ok, r.attempts) for r in got] == [("1", True, 1), ("2", False, 2)]
    raw.write_summary(spark.createDataFrame([(1, "é")], "n int, s string"), f"{tmp_path}/s")
    assert [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/s").collect()] == [{"n": 1, "s": "é"}]


def test_tag_lists_of_blanks_have_no_tags(spark):
    def rows(tags):
        return spark.createDataFrame([("1", "T", "good", "p", "n", tags)], "book_id string, title string, overall_judgment string, positive_aspects string, negative_aspects string, top_tags string")

    ids = spark.createDataFrame([("1",)], "book_id string")
    for tags in ('[" ", ""]', "[]", " ", None):
        with pytest.raises(ValueError, match="no tags"):
            summaries.final_artifact(rows(tags), ids)
    assert summaries.final_artifact(rows('["a", " "]'), ids, 1)[0].head().top_tags == '["a"]'
    with pytest.raises(ValueError, match="2 expected"):
        summaries.final_artifact(rows("x"), ids, 2)
    with pytest.raises(ValueError, match="ids missing: 1, such as '2'"):
        summaries.final_artifact(rows("x"), spark.createDataFrame([("1",), ("2",)], "book_id string"))


def test_inputs_are_checked(spark):
    ddl = "book_id string, title string, average_rating double, rating_std_dev double, rating_distribution_text string, reviews_text_block string"
    row = (" 1 ", "T", 4.0, 1.0, "d", "r")
    ids = spark.createDataFrame([("1",)], "book_id string")
    assert summaries.check_llm_input(spark.createDataFrame([row], ddl), ids).head().book_id == "1"
    for bad, what in ((("1", " ", *row[2:]), "blank titles"), (("2", *row[1:]), "not expected"), ((None, *row[1:]), "blank ids"), ((*row[:5], ""), "blank reviews")):
        with pytest.raises(ValueError, match=what):
            summaries.check_llm_input(spark.createDataFrame([bad], ddl), ids)
    with pytest.raises(ValueError, match="repeated"):
        summaries.check_llm_input(spark.createDataFrame([row, row], ddl))
    text = spark.createDataFrame([row], ddl).select(summaries.prompt_text()).head()[0]
    assert text.startswith("Book: T") and text.endswith("r")


def test_ingest_counts_while_it_writes(spark, tmp_path):
    def write(name, rows):
        with gzip.open(tmp_path / name, "wt") as f:
            f.write("\n".join(map(json.dumps, rows)) + "\nnot json\n[1]\n")

    write("b.gz", [{"book_id": str(i), "title": "T" if i else " ", "ratings_count": str(2000 if i < 4 else 5)} for i in range(6)])
    write("r.gz", [{"review_id": f"r{i}", "user_id": "u", "book_id": str(i), "rating": 4, "review_text": "x", "language_code": "en" if i % 2 else "fr"} for i in range(6)] + [{"review_id": "e", "user_id": "u", "book_id": "1", "rating": 0, "review_text": " ", "language_code": "en"}])
    (tmp_path / "i.csv").write_text("user_id,book_id,is_read,rating,is_reviewed\n1,1,1,3,0\n1,2,1,3,0\n2,1,1,0,0\n")
    counters = {}
    made = preprocess(spark, {"books": f"{tmp_path}/b.gz", "reviews": f"{tmp_path}/r.gz", "interactions": f"{tmp_path}/i.csv"}, f"{tmp_path}/out", least_user=2, counters=counters)
    assert counters["books"] == {"malformed": 2, "ratings": 2, "title": 1, "kept": 3}
    assert counters["reviews"] == {"malformed": 2, "book": 3, "empty": 1, "language": 1, "kept": 2}
    assert counters["validate"] == {"books": 3, "interactions": 2, "reviews": 2, "users": 1, "in_all": 1, "orphan_interactions": 0, "books_without_reviews": 1, "in_any": 3}
    assert made["books"].columns == raw.books_table(raw.raw_books(spark, f"{tmp_path}/b.gz")).columns and len(made["books"].columns) == 19
    assert made["reviews"].columns == ["review_id", "user_id", "book_id", "rating", "review_text", "n_votes", "n_comments", "date_added"]


def test_validation_reads_each_table_once(spark):
    sf = "/root/testdata/sf0.001"
    from foliant.plans.queries import QUERIES

    plan = QUERIES["validate_summary"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert {t: plan.count(f"{t}.parquet") for t in ("part", "lineitem", "orders", "documents")} == dict.fromkeys(("part", "lineitem", "orders", "documents"), 1)


@pytest.mark.parametrize("least", [1, 3, 40])
def test_active_users_of_any_size(spark, least):
    rows = [(f"u{i % 7}" if i % 2 else "hot", str(i % 9), i % 4) for i in range(900)] + [("one", "1", 5), (None, "1", 5)]
    df, books = spark.createDataFrame(rows, "user_id string, book_id string, rating int"), spark.createDataFrame([(str(b),) for b in range(6)], "book_id string")
    kept = [r for r in rows if r[0] and r[2] > 0 and int(r[1]) < 6]
    n = Counter(r[0] for r in kept)
    found = tables.active_users(df, books, least)
    assert Counter(map(tuple, found.select("user_id", "book_id", "rating").collect())) == Counter(r for r in kept if n[r[0]] >= least)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Join ") == 1 and set(found.columns) == set(df.columns)


def test_small_rules(spark, tmp_path):
    (tmp_path / "ids.json").write_text('["b", " a ", "", "b", null]')
    assert [(r["rank"], r.id) for r in raw.id_list(spark, f"{tmp_path}/ids.json", 2).orderBy("rank").collect()] == [(0, "b"), (1, "a")]
    for call in (lambda: raw.id_list(spark, f"{tmp_path}/ids.json", 3), lambda: raw.id_list(spark, f"{tmp_path}/ids.json", strict=True)):
        with pytest.raises(ValueError):
            call()
    df = spark.createDataFrame([("['a', \"it's\"]", 0.125, "None"), ("plain", 35.5, "1"), ("[]", None, None)], "tags string, score double, isbn string")
    got = df.select(S.tag_list(F.col("tags")).alias("t"), S.whole_percent(F.col("score")).alias("p"), S.match_text(F.col("score")).alias("m"), S.has_isbn(F.col("isbn")).alias("i"), S.real_cover(F.lit("http://x/nophoto/1"), "host").alias("c"), S.preview(F.repeat(F.lit("x"), F.lit(300))).alias("v")).collect()
    assert [(r.t, r.p, r.m, r.i) for r in got] == [(["a", "it's"], "12", "12%", False), (["plain"], "36", "3550%", True), ([], "0", None, False)]
    assert not got[0].c and len(got[0].v) == 241
    shares = {r.predicate: (r.n, r["rows"], r.share) for r in tables.shares(df, {"scored": F.col("score") > 1, "all": F.lit(True)}).collect()}
    assert shares == {"scored": (1, 3, 1 / 3), "all": (3, 3, 1.0)}
    bins = tables.histogram(spark.createDataFrame([(0.0,), (9.9,), (10.0,), (11.0,), (None,)], "x double"), "x", 4, 0, 10).orderBy("bin").collect()
    assert [(r.bin, r.low, r.n) for r in bins] == [(0, 0.0, 1), (1, 2.5, 0), (2, 5.0, 0), (3, 7.5, 2)]
    ratings = spark.createDataFrame([(1,), (5,), (6,), (None,)], "rating int")
    checks.expect_in(ratings.where("rating < 6"), "rating", [1, 2, 3, 4, 5])
    with pytest.raises(ValueError, match="6"):
        checks.expect_in(ratings, "rating", [1, 2, 3, 4, 5])
    final, books = spark.createDataFrame([("1",)], "book_id string"), spark.createDataFrame([("1", "T")], "book_id string, title string")
    assert serve.ui_cache(final, books, size=1).count() == 1
    with pytest.raises(ValueError, match="2 expected"):
        serve.ui_cache(final, books, size=2)
    v = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in search.unknown_favorites(v, search.favorites_frame(spark, [(0, 1), (1, 9)])).collect()] == [9]
    assert raw.sample_rows(spark, f"{tmp_path}/ids.json", "a string", 5).count() == 0
