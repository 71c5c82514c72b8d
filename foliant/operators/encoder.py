"""A text encoder trained on the catalog: TF-IDF, and its leading directions by randomised subspace iteration over a distributed Gram product."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.text_search import ITEM_PREFIX, QUERY_PREFIX
from foliant.sources.raw import write_table
from foliant.sources.scratch import materialise

#: The driver's part of a fit is terms * (width + OVERSAMPLE) doubles, however many texts there are; a larger product raises.
OVERSAMPLE, MOST_NUMBERS, BLOCKS, NONZEROS = 10, 1 << 25, 64, 1 << 16
WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Lower-case words of letters and digits, without the prefix that tells questions from items."""
    for prefix in (QUERY_PREFIX, ITEM_PREFIX):
        text = text.removeprefix(prefix)
    return WORD.findall(text.lower())


@dataclass(frozen=True)
class TextEncoder:
    """Texts in, rows of width numbers out: 1 + ln(count) times idf of the known terms, of length 1, on the basis. Texts without a known term give zeros. Any place for an encoder takes one."""

    terms: dict[str, int]
    idf: np.ndarray
    basis: np.ndarray
    strength: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def sparse(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return weighted(text, self.terms, self.idf)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.basis.shape[1]))
        for row, text in zip(out, texts, strict=True):
            at, w = self.sparse(text)
            row += w @ self.basis[at]
        return out


def weighted(text: str, terms: dict[str, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a text's known terms; the weights have length 1."""
    counts = Counter(map(terms.get, words_of(text)))
    counts.pop(None, None)
    at = np.fromiter(counts, np.int64, len(counts))
    w = (1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))) * idf[at]
    return at, w / np.linalg.norm(w) if len(w) else w


def term_counts(texts: DataFrame, text: str) -> DataFrame:
    """term and n, the texts that hold it; batches count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = Counter(w for t in b.column(0).to_pylist() for w in set(words_of(t or "")))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def parts(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Borders of runs of rows with about most entries."""
    cuts = np.unique(np.concatenate([[0], np.searchsorted(np.cumsum(lengths), np.arange(most, int(lengths.sum()) + most, most), side="right"), [len(lengths)]]))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _lists(x: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))


def gram_product(rows: DataFrame, right: np.ndarray) -> np.ndarray:
    """A' A right, for sparse rows (at array<int>, weight array<float>) of A. Each task adds its rows up, in single precision a run of rows at a time and in double from run to run, hands on the places it met in single precision, block by block, and blocks are summed in tasks of their own."""
    places, width = right.shape
    right = right.astype(np.float32)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((places, width)), np.zeros(places, bool)
        for b in batches:
            for start, end in parts(np.asarray(b.column(0).value_lengths()), NONZEROS):
                at, w = (np.asarray(c.slice(start, end - start).flatten()) for c in b.columns)
                lengths = np.asarray(b.column(0).slice(start, end - start).value_lengths())
                row = np.repeat(np.arange(len(lengths)), lengths)
                if len(at):
                    own = np.flatnonzero(lengths)
                    first = (np.cumsum(lengths) - lengths)[own]
                    y = np.zeros((len(lengths), width), np.float32)
                    y[own] = np.add.reduceat(w[:, None] * right[at], first)
                    order = np.argsort(at, kind="stable")
                    places_met, begin = np.unique(at[order], return_index=True)
                    total[places_met] += np.add.reduceat(w[order, None] * y[row[order]], begin)
                    met[places_met] = True
        own = np.flatnonzero(met)
        for part in np.array_split(own, max(1, len(own) // 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(part % BLOCKS, pa.int32()), pa.array(part, pa.int32()), _lists(total[part].astype(np.float32))], names=["block", "place", "sums"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for place, sums in zip(b.column(1).to_pylist(), np.asarray(b.column(2).flatten(), dtype=np.float64).reshape(-1, width), strict=True):
                total[place] = total[place] + sums if place in total else sums
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], names=["place", "sums"])

    partials = rows.select("at", "weight").mapInArrow(partial, "block int, place int, sums array<float>")
    out = np.zeros((places, width))
    for r in partials.repartition("block").mapInArrow(summed, "place int, sums array<double>").collect():
        out[r["place"]] = r["sums"]
    return out


def fit_encoder(items: DataFrame, text: str = "search_text", *, width: int = 64, most_terms: int = 20_000, least_texts: int = 2, rounds: int = 2, seed: int = 42) -> TextEncoder:
    """An encoder for the texts of items: the most_terms commonest terms of least_texts texts or more (ties: alphabetically), and the width strongest directions of their TF-IDF rows.

    Terms are counted over all texts, and every text takes part in every round. The rows are written once, as places and weights; a round reads them in one pass.
    With fewer terms than width, the remaining numbers are 0. Null and empty texts have no terms; a table without terms raises.
    """
    n = items.count()
    found = term_counts(items, text).where(F.col("n") >= least_texts).orderBy(F.desc("n"), "term").limit(most_terms).collect()
    if not found:
        raise ValueError("no term is in enough texts")
    terms = {r["term"]: i for i, r in enumerate(sorted(found, key=lambda r: r["term"]))}
    idf = np.zeros(len(terms))
    for r in found:
        idf[terms[r["term"]]] = np.log((1 + n) / (1 + r["n"])) + 1
    most = min(width + OVERSAMPLE, len(terms))
    if most * len(terms) > MOST_NUMBERS:
        raise ValueError(f"{len(terms)} terms of width {most} are more than {MOST_NUMBERS} numbers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [weighted(t or "", terms, idf) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([at.tolist() for at, _ in rows], pa.list_(pa.int32())), pa.array([w.tolist() for _, w in rows], pa.list_(pa.float32()))], names=["at", "weight"])

    rows = materialise(items.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "at array<int>, weight array<float>"), "tf-idf")
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(terms), most)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(gram_product(rows, q))[0]
    values, inner = np.linalg.eigh((t := q.T @ gram_product(rows, q)) + t.T)
    order = np.argsort(-values)[:width]
    basis = q @ inner[:, order]
    basis *= np.where(basis[np.abs(basis).argmax(0), np.arange(basis.shape[1])] < 0, -1, 1)  # a direction's largest part is positive
    full = np.zeros((len(terms), width), np.float32)
    full[:, : basis.shape[1]] = basis
    return TextEncoder(terms, idf, full, np.sqrt(np.maximum(values[order] / 2, 0)))


def write_encoder(encoder: TextEncoder, items: DataFrame, path: str) -> None:
    """term, place, idf and the term's row of the basis."""
    names = sorted(encoder.terms, key=encoder.terms.get)
    rows = [(t, i, float(encoder.idf[i]), encoder.basis[i].tolist()) for i, t in enumerate(names)]
    write_table(items.sparkSession.createDataFrame(rows, "term string, place int, idf double, basis array<float>").coalesce(1), path)


def read_encoder(items: DataFrame, path: str) -> TextEncoder:
    rows = items.sparkSession.read.parquet(path).orderBy("place").collect()
    return TextEncoder({r["term"]: r["place"] for r in rows}, np.array([r["idf"] for r in rows]), np.array([r["basis"] for r in rows], np.float32))
