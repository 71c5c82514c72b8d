"""Quality classifier: text is compressed with a dictionary of good and one of bad text; the sizes become a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import held_out, read_table

FOLDS, HELD_OUT, ACCEPT = 4, 2, 0.7


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries of good and bad text, and the calibration of the features made with them."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]
    chunk: int = 2048
    level: int = 3

    def compressors(self):
        import zstandard as z

        def one(content: bytes):
            kind = z.DICT_TYPE_FULLDICT if content[:4] == b"\x37\xa4\x30\xec" else z.DICT_TYPE_RAWCONTENT
            given = z.ZstdCompressionDict(content, dict_type=kind) if content else None
            if given:
                given.precompute_compress(level=self.level)
            return z.ZstdCompressor(level=self.level, dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False)

        return one(self.good), one(self.bad)


def features(texts, model: CompressionModel) -> np.ndarray:
    """Of each text: the normalised difference of its two compressed sizes over all chunks, the lowest such difference of a chunk, the ratio under the good dictionary, and the logarithm of its length; then their squares and some products."""
    good, bad = model.compressors()
    base = np.zeros((len(texts), 4))
    for i, text in enumerate(texts):
        x = (text or "").encode("utf-8", "surrogatepass")
        a = b = 0
        low = 1.0
        for p in range(0, len(x), model.chunk):
            part = x[p : p + model.chunk]
            u, v = len(good.compress(part)), len(bad.compress(part))
            a, b, low = a + u, b + v, min(low, (v - u) / (u + v))
        if x:
            base[i] = (b - a) / (a + b), low, a / len(x), np.log1p(len(x))
    return np.column_stack([base, base**2, base[:, :1] * base[:, 1:], base[:, 2] * base[:, 3]])


def predict(texts, model: CompressionModel) -> np.ndarray:
    z = (features(texts, model) - np.array(model.mean)) / np.array(model.spread)
    return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(texts)), z]) @ np.array(model.weights), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3):
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    beta, keep = np.zeros(z.shape[1]), ridge * len(y) * np.r_[0.0, np.ones(x.shape[1])]
    for _ in range(80):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + np.diag(keep + 1e-9), z.T @ (w * (y - p)) - keep * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return mean, spread, beta


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_per_class: int = 3000, max_text_bytes: int = 200_000, max_class_bytes: int = 64 << 20, dict_bytes: int = 65_536, chunk: int = 2048) -> CompressionModel:
    """Fit on a bounded sample: of each class, the sample_per_class documents lowest by hash of id, but for texts of over max_text_bytes, and of these the first that make up max_class_bytes together: so much comes to the driver.

    Rows of labels with a null id or label, and ids labelled both ways, teach nothing. Every second row of the sample makes the
    dictionaries; the others, weighted to the classes' true shares, calibrate the features. With one class only, or none, every score is that share (0.5 without labels).
    """
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("i is not null and y in (0, 1)").groupBy("i").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("i", "y")
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(shares) < 2:
        rate = float(next(iter(shares), 0.5))
        return CompressionModel(b"", b"", (0.0,) * 12, (1.0,) * 12, (30.0 * (2 * rate - 1),) + (0.0,) * 12)
    order = F.xxhash64("i")
    chosen = known.where("y = 1").orderBy(order, "i").limit(sample_per_class).unionAll(known.where("y = 0").orderBy(order, "i").limit(sample_per_class))
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.octet_length("t") <= max_text_bytes)
    rows = sorted({(r["i"], r["y"], r["t"]) for r in own.join(F.broadcast(chosen), "i").withColumn("b", F.sum(F.octet_length("t")).over(Window.partitionBy("y").orderBy(order, "i", F.md5(F.col("t").cast("binary"))))).where(F.col("b") <= max_class_bytes).collect()}, key=lambda r: (hash_order(r[0]), r[0], r[2]))
    halves = {y: [r for r in rows if r[1] == y] for y in (0, 1)}
    made = {y: [r[2].encode("utf-8", "surrogatepass") for r in v[::2]] for y, v in halves.items()}
    rest = [r for v in halves.values() for r in (v[1::2] or v)]
    if not all(halves.values()):
        return CompressionModel(b"", b"", (0.0,) * 12, (1.0,) * 12, (0.0,) * 13)
    model = CompressionModel(_dictionary(made[1], dict_bytes, chunk), _dictionary(made[0], dict_bytes, chunk), (), (), (), chunk)
    y = np.array([r[1] for r in rest], dtype=float)
    w = np.where(y == 1, shares[1] / max(1, y.sum()), shares[0] / max(1, (1 - y).sum()))
    mean, spread, beta = _logistic(features([r[2] for r in rest], model), y, w / w.mean())
    return CompressionModel(model.good, model.bad, tuple(mean), tuple(spread), tuple(beta), chunk)


def hash_order(i) -> int:
    import zlib

    return zlib.crc32(f"order {i}".encode())


def _dictionary(texts: list[bytes], size: int, chunk: int, samples: int = 20_000) -> bytes:
    """A trained dictionary; the texts' own bytes where they are too few to train one."""
    import zstandard as z

    parts = [t[p : p + chunk] for t in texts for p in range(0, len(t), chunk)][:samples]
    try:
        return z.train_dictionary(size, parts, level=3).as_bytes()
    except z.ZstdError:
        return b"".join(parts)[:size]


def quality_score(text: Column, model: CompressionModel) -> Column:
    """The calibrated score, 0 to 1, of each whole text; null counts as empty."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(predict(s.tolist(), model))

    return score(text.cast("string"))


def fit_outside_fold(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT, id_col: str = "doc_id", **options) -> CompressionModel:
    """fit_quality on labels whose id is not in the held-out fold."""
    return fit_quality(docs, labels.where(~held_out(F.col(id_col), folds, fold)), id_col=id_col, **options)


def keep_good(docs: DataFrame, model: CompressionModel, *, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows of docs, with their own columns, that score accept at least. An empty table stays empty."""
    return docs.where(quality_score(F.col(text_col), model) >= F.lit(accept))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score. Null and empty texts get the score of a text without features; ids may repeat or be null (then not held out)."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit_outside_fold(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= F.lit(ACCEPT)).cast("int"))


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
