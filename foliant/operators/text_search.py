"""Search by text, through any encoder of texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.search import top_k_cosine

#: Texts in, a row of numbers for each out.
Encoder = Callable[[list[str]], np.ndarray]
# What tells questions from items, and the columns that are shown
QUERY_PREFIX, ITEM_PREFIX = "search_query: ", "search_document: "
SHOWN = ("book_id", "title", "average_rating", "ratings_count", "text_reviews_count", "language_code", "score")


def word_hash_encoder(width: int = 64) -> Encoder:
    """A stand-in for a model: words counted in width places by hash, with a sign."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.md5(word.encode("utf-8", "surrogatepass")).digest()[:8], "little")
                row[h % width] += 1 if h >> 63 else -1
        return out

    return encode


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def layer_normed(x: np.ndarray, width: int) -> np.ndarray:
    """Rows with mean 0 and variance 1 (epsilon 1e-5), cut to width, of length 1."""
    x = x - x.mean(1, keepdims=True)
    return _unit((x / np.sqrt((x * x).mean(1, keepdims=True) + 1e-5))[:, :width])


def encode_query(encoder: Encoder, text: str, width: int) -> list[float]:
    """The vector of a question, on the driver."""
    return layer_normed(np.asarray(encoder([QUERY_PREFIX + str(text).strip()]), dtype=np.float64), width)[0].tolist()


def encode_items(items: DataFrame, encoder: Encoder, width: int | None, *, id_col: str = "book_id", text_col: str = "search_text", prefix: str = "") -> DataFrame:
    """id and embedding (array<float>) of every row: layer norm, cut and unit length for a width, unit length alone without one (the symmetric kind). Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = np.asarray(encoder([prefix + (t or "").strip() for t in b.column(1).to_pylist()]), dtype=np.float64)
                x = _unit(x) if width is None else layer_normed(x, width)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=[id_col, "embedding"])

    return items.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{id_col} {items.schema[id_col].dataType.simpleString()}, embedding array<float>")


def thematic_search(vectors: DataFrame, books: DataFrame, query: str, encoder: Encoder, k: int = 10, *, width: int = 256, key: str = "book_id", vector: str = "embedding") -> DataFrame:
    """The k books nearest to a free text, with their score; a blank text finds none, with the same columns."""
    text = str(query).strip()
    found = top_k_cosine(vectors, encode_query(encoder, text, width), k, key, vector) if text else vectors.select(key, F.lit(0.0).alias("score")).limit(0)
    joined = found.join(books, key)
    return joined.select(*[c for c in SHOWN if c in joined.columns]).orderBy(F.desc("score"), key)
