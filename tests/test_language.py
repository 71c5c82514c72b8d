import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.operators import language

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return language.train_languages(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 <> 2"))


def test_held_out_accuracy_of_each_language(spark, model):
    held = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 4 = 2 and n_chars >= 20")
    found = held.select("lang", (model.detect(F.col("text")) == F.col("lang")).alias("right")).groupBy("lang").agg(F.avg(F.col("right").cast("int")).alias("share"), F.count("*").alias("n")).collect()
    assert {r.lang for r in found} == {"en", "de", "fr", "es"} and all(r.share >= 0.97 and r.n >= 20 for r in found), found


def test_model_equals_plain_counts(spark):
    rows = [("abab", "x"), ("ab cd!", "y"), ("ABC", "y"), (None, "x"), ("zz", None)]
    model = language.train_languages(spark.createDataFrame(rows, "text string, lang string").repartition(3), most_grams=5)
    text = lambda g: "".join(chr(g >> s & (1 << 21) - 1) for s in (42, 21, 0))
    n = {"x": {" ab": 1, "aba": 1, "bab": 1, "ab ": 1}, "y": {" ab": 2, "ab ": 1, "b c": 1, " cd": 1, "cd ": 1, "abc": 1, "bc ": 1}}
    both = {g: n["x"].get(g, 0) + n["y"].get(g, 0) for g in {*n["x"], *n["y"]}}
    kept = sorted(sorted(both, key=lambda g: (-both[g], g))[:5])
    assert [text(int(g)) for g in model.grams] == kept and model.languages == ("x", "y")
    total = {k: sum(n[k].get(g, 0) for g in kept) + 5 for k in n}
    assert np.array_equal(model.weights, [[round(1e6 * np.log((n[k].get(g, 0) + 1) / total[k])) for k in ("x", "y")] for g in kept])


def test_odd_texts_and_stored_models(spark, model, tmp_path):
    df = spark.createDataFrame([("",), (None,), ("12 34 !?",), ("日本語",), ("the " * 50_000,)], "t string")
    assert [r[0] for r in df.select(model.detect(F.col("t"))).collect()] == ["und", None, "und", "und", "en"]
    language.write_model(model, spark, f"{tmp_path}/m")
    again = language.read_model(spark, f"{tmp_path}/m")
    assert again.languages == model.languages and np.array_equal(again.grams, model.grams) and np.array_equal(again.weights, model.weights)
    nothing = language.train_languages(df.limit(0).select(F.col("t").alias("text"), F.lit("x").alias("lang")))
    assert nothing.codes([" abc "]) == ["und"]


def test_codes_of_reviews_are_labels(spark):
    raw = spark.createDataFrame([("the whales of the sea", "eng"), ("der Hund auf dem Dach", "de-AT"), ("le chien et le chat", ""), (None, "fr")], "review_text string, language_code string")
    assert language.trained_on_codes(raw).languages == ("de", "en")
