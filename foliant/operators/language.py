"""Languages of texts by a multinomial model of character trigrams, trained on labelled rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.scalars import reads_latin, text_or_empty
from foliant.sources.raw import write_table

#: Trigrams that a model keeps, languages that it may tell apart, and characters that are worked on at a time.
MOST_GRAMS, MOST_LANGUAGES, CHARS = 20_000, 256, 1 << 20
UNKNOWN = "und"


def letters_only(text: Column) -> Column:
    """Lower-case letters, one space for whatever lies between words, and one at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of texts, and which text each is of. A trigram is its three code points in one number, whose order is that of the text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    within = owner[:-2] == owner[2:]
    return (codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])[within], owner[:-2][within]


def runs(texts: list[str], chars: int = CHARS) -> Iterator[tuple[int, int]]:
    """Borders of runs of texts of about chars characters."""
    start, held = 0, 0
    for i, t in enumerate(texts, 1):
        held += len(t)
        if held >= chars or i == len(texts):
            yield start, i
            start, held = i, 0


def gram_counts(labelled: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, gram and n over all rows that have a language. Batches are counted where they are read; their counts are summed before and after one shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in sorted(set(names)):
                own = [t for k, t in zip(names, texts, strict=True) if k == name]
                for start, end in runs(own):
                    grams, n = np.unique(grams_of(own[start:end])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), letters_only(F.col(text)).alias("text"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageModel:
    """languages in alphabetical order; grams, ascending; and each gram's logarithm for each language, in millionths, so that sums are exact whatever their order."""

    languages: tuple[str, ...]
    grams: np.ndarray
    weights: np.ndarray

    def codes(self, texts: list[str]) -> list[str]:
        """The likeliest language of each text that letters_only() gave (ties: in alphabetical order); und where no known trigram is."""
        out: list[str] = []
        for start, end in runs(texts):
            grams, owner = grams_of(texts[start:end])
            at = np.minimum(np.searchsorted(self.grams, grams), max(0, len(self.grams) - 1))
            known = self.grams[at] == grams if len(self.grams) else np.zeros(len(grams), bool)
            at, owner = at[known], owner[known]
            n = end - start
            sums = np.stack([np.bincount(owner, self.weights[at, j], n) for j in range(len(self.languages))], 1) if self.languages else np.zeros((n, 1))
            best, any_ = sums.argmax(1), np.bincount(owner, minlength=n) > 0
            out += [self.languages[best[i]] if any_[i] else UNKNOWN for i in range(n)]
        return out

    def detect(self, text: Column) -> Column:
        """The language of a column of texts; null texts have none."""
        @F.pandas_udf("string")
        def code(letters: pd.Series) -> pd.Series:
            known = letters.notna()
            out = pd.Series([None] * len(letters), dtype=object)
            out[known.to_numpy()] = self.codes(letters[known].tolist())
            return out

        return code(letters_only(text))


def train_languages(labelled: DataFrame, text: str = "text", lang: str = "lang", *, most_grams: int = MOST_GRAMS) -> LanguageModel:
    """A model of the languages of labelled rows: the most_grams commonest trigrams (ties: the smaller), each with ln((n + 1) / (all + grams)) by language.

    Counts are over all rows; what the driver gets is a number per kept trigram and language. Rows without text or language don't count; languages are equally likely beforehand.
    """
    spark = labelled.sparkSession
    counts = gram_counts(labelled, text, lang).persist()
    kept = counts.groupBy("gram").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "gram").limit(most_grams).select("gram")
    languages = sorted(r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    grams = np.array(sorted(r[0] for r in kept.collect()), np.int64)
    n = np.zeros((len(grams), len(languages)), np.int64)
    of_grams = spark.createDataFrame([(int(g),) for g in grams], "gram long")
    for r in counts.join(F.broadcast(of_grams), "gram").collect():
        n[np.searchsorted(grams, r["gram"]), languages.index(r["lang"])] = r["n"]
    counts.unpersist()
    sums = n.sum(0) + len(grams)
    weights = np.array([[round(1e6 * math.log((x + 1) / total)) for x, total in zip(row, sums.tolist(), strict=True)] for row in n.tolist()], np.int64).reshape(n.shape)
    return LanguageModel(tuple(languages), grams, weights)


def trained_on_codes(reviews: DataFrame, text: str = "review_text", code: str = "language_code") -> LanguageModel:
    """A model from the rows whose code says their language: en for all codes that start so, else what stands before a - or _."""
    lower = F.lower(text_or_empty(F.col(code)))
    named = F.when(F.startswith(lower, F.lit("en")), F.lit("en")).otherwise(F.split(lower, "[-_]")[0])
    return train_languages(reviews.where(lower != "").select(F.col(text).alias("text"), named.alias("lang")))


def write_model(model: LanguageModel, spark: SparkSession, path: str) -> None:
    rows = [(k, int(g), int(w)) for g, row in zip(model.grams, model.weights, strict=True) for k, w in zip(model.languages, row, strict=True)]
    write_table(spark.createDataFrame(rows, "lang string, gram long, weight long").coalesce(1), path)


def read_model(spark: SparkSession, path: str) -> LanguageModel:
    rows = spark.read.parquet(path).collect()
    languages, grams = sorted({r["lang"] for r in rows}), np.array(sorted({r["gram"] for r in rows}), np.int64)
    weights = np.zeros((len(grams), len(languages)), np.int64)
    for r in rows:
        weights[np.searchsorted(grams, r["gram"]), languages.index(r["lang"])] = r["weight"]
    return LanguageModel(tuple(languages), grams, weights)


def strict_english(text: Column, detect) -> Column:
    """The text gate, then the classifier (a function of a column that gives a code); texts that don't pass the gate aren't English, whatever it says."""
    return F.coalesce(reads_latin(text) & (detect(text) == "en"), F.lit(False))
