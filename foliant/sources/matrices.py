"""Matrices of vectors as .npy files, in and out by row ranges, and id lists and index maps as JSON."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliant.operators.tables import placed

#: Bytes of rows that a partition reads, and rows that it hands on at a time.
RANGE_BYTES, ROWS = 64 << 20, 8192


def _stream(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


@dataclass(frozen=True)
class Header:
    rows: int
    width: int
    dtype: np.dtype
    start: int

    @property
    def row_bytes(self) -> int:
        return self.width * self.dtype.itemsize


def read_header(path: str) -> Header:
    """What a .npy file says about itself; raises for other than two dimensions, in row order, of numbers."""
    store, inner = _opened(path)
    with store.open_input_file(inner) as f:
        version = np.lib.format.read_magic(f)
        shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if len(shape) != 2 or by_columns or dtype.kind not in "fiu":
            raise ValueError(f"a matrix has two dimensions of numbers in row order, not {shape} of {dtype}")
        return Header(shape[0], shape[1], dtype, f.tell())


@dataclass
class RowRange(InputPartition):
    path: str
    first: int
    start: int
    stop: int
    header: Header


class MatrixReader(DataSourceReader):
    """A partition is a range of a file's rows; its bytes are all that a task reads."""

    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[RowRange]:
        store, inner = _opened(self.path)
        base = self.path.rstrip("/")
        parts = [self.path] if store.get_file_info(inner).type == fs.FileType.File else [f"{base}/{f.base_name}" for f in sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda f: f.base_name) if f.base_name.endswith(".npy")]
        out, first = [], 0
        for path in parts:
            h = read_header(path)
            step = max(1, self.range_bytes // max(1, h.row_bytes))
            out += [RowRange(path, first + at, at, min(at + step, h.rows), h) for at in range(0, h.rows, step)]
            first += h.rows
        return out

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        h = partition.header
        store, inner = _opened(partition.path)
        with store.open_input_file(inner) as f:
            for at in range(partition.start, partition.stop, ROWS):
                n = min(ROWS, partition.stop - at)
                content = f.read_at(n * h.row_bytes, h.start + at * h.row_bytes)
                if len(content) != n * h.row_bytes:
                    raise ValueError(f"{partition.path} ends before its row {at + n}")
                x = np.frombuffer(content, h.dtype).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, h.width, dtype=np.int32) if h.width else np.zeros(n + 1, np.int32)), pa.array(x))
                row = partition.first + at - partition.start
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + n)), vectors], names=["row", "embedding"])


class MatrixSource(DataSource):
    """format("npy_matrix"): row and embedding of a .npy file, or of a folder of them in order of their names. Options: path, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return "row long, embedding array<float>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))


def read_matrix(spark: SparkSession, path: str, name: str = "embedding", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """row (from 0) and vector of a two-dimensional .npy file, or of a folder of them; one file is read by as many tasks as it has ranges of range_bytes. Stores are those that pyarrow opens: local, hdfs, s3, gs."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("npy_matrix").option("rangeBytes", range_bytes).load(path).withColumnRenamed("embedding", name)


def _npy_header(rows: int, width: int) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (rows, width)})
    return out.getvalue()


def _shape(df: DataFrame, vector: str) -> tuple[int, int]:
    found = df.agg(F.count("*").alias("n"), F.count(vector).alias("there"), F.min(F.size(vector)).alias("least"), F.max(F.size(vector)).alias("most")).head()
    if found["n"] != found["there"] or found["least"] != found["most"]:
        raise ValueError("vectors are null or of several widths")
    return found["n"], found["least"] or 0


def write_matrix(df: DataFrame, path: str, order: str, vector: str = "embedding", *, shared: bool = False) -> int:
    """Vectors by order as one float32 .npy file in a file system with places in files (a local one, or a mounted one that driver and executors share: say so by shared). Gives the number of rows.

    Rows get their places from counts of sorted ranges; the driver writes the header, and each task its rows at their own offsets, the same bytes if it runs again. The file is renamed to path when all are there.
    """
    spark = df.sparkSession
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError("files of this store have no places to write at; use write_matrix_parts")
    if not (shared or spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"):
        raise ValueError("the driver and executors must share the path: say so by shared=True, or use write_matrix_parts")
    target = unquote(url.path) if url.scheme else path
    n, width = _shape(df, vector)
    ranked = placed(df.select(F.col(order).alias("_order"), F.col(vector).cast("array<float>").alias("_vector")), [F.col("_order")], "_row").select("_row", "_vector")
    header, part = _npy_header(n, width), f"{target}.part"
    with open(part, "wb") as f:
        f.write(header)
        f.truncate(len(header) + n * width * 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with open(part, "r+b") as f:
            for b in batches:
                if len(b):
                    rows, x = np.asarray(b.column(0)) - 1, np.asarray(b.column(1).flatten(), dtype="<f4").reshape(len(b), width)
                    cuts = [0, *(np.flatnonzero(np.diff(rows) != 1) + 1).tolist(), len(rows)]
                    for i, j in zip(cuts, cuts[1:], strict=False):
                        f.seek(len(header) + int(rows[i]) * width * 4)
                        f.write(x[i:j].tobytes())
                    done += len(b)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    written = ranked.mapInArrow(run, "n long").agg(F.sum("n")).head()[0] or 0
    if written != n:
        raise ValueError(f"{written} rows were written of {n}")
    os.replace(part, target)
    return n


def write_matrix_parts(df: DataFrame, path: str, order: str, vector: str = "embedding") -> int:
    """Vectors by order as a folder of float32 .npy files, in order of their names, for any store that pyarrow opens. A file is a sorted range, written by its task; a task that runs again writes the same file over. Gives the number of rows."""
    n, width = _shape(df, vector)
    ranged = df.select(F.col(order).alias("_order"), F.col(vector).cast("array<float>").alias("_vector")).repartitionByRange("_order").sortWithinPartitions("_order").withColumn("_part", F.spark_partition_id()).select("_part", "_vector")
    store, inner = _opened(path)
    store.create_dir(inner, recursive=True)
    if any(f.base_name.endswith(".npy") for f in store.get_file_info(fs.FileSelector(inner))):
        raise ValueError(f"{path} holds a matrix already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = [], None
        for b in batches:
            if len(b):
                part = b.column(0)[0].as_py()
                own.append(np.asarray(b.column(1).flatten(), dtype="<f4"))
        rows = sum(map(len, own)) // width if width else 0
        if part is not None:
            to, folder = _opened(path)
            with to.open_output_stream(f"{folder}/part-{part:08d}.npy") as f:
                f.write(_npy_header(rows, width))
                for x in own:
                    f.write(x.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["n"])

    written = ranged.mapInArrow(run, "n long").agg(F.sum("n")).head()[0] or 0
    if written != n:
        raise ValueError(f"{written} rows were written of {n}")
    return n


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    target, store = _stream(spark, path)
    stream = store.create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def aligned(vectors: DataFrame, books: DataFrame) -> int:
    """The number of rows of both; raises if they differ."""
    a, b = vectors.count(), books.count()
    if a != b:
        raise ValueError(f"{a} vectors for {b} books")
    return a


def write_id_list(ids: DataFrame, path: str, key: str = "book_id", place: str = "rank", most: int = 5_000_000) -> None:
    """Ids in order of place, as one JSON array."""
    rows = ids.select(place, key).orderBy(place).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} ids; write Parquet")
    write_bytes(ids.sparkSession, path, json.dumps([r[key] for r in rows], ensure_ascii=False).encode())


def write_index_map(index: DataFrame, path: str, key: str, place: str) -> None:
    """A JSON object a line, of an id and its place: the map itself, however long it is."""
    index.select(F.to_json(F.struct(key, place)).alias("value")).write.mode("overwrite").text(path)
