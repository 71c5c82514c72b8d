"""Lines of gzip files that are made of many members, read by many tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foliant.sources.matrices import _opened

#: Bytes of a file that a partition looks for members in, bytes read at a time, and lines handed on at a time.
RANGE_BYTES, CHUNK, LINES = 32 << 20, 1 << 20, 8192
START = b"\x1f\x8b\x08"
#: Stores that pyarrow opens; others are left to Spark's own reader.
STORES = ("file", "hdfs", "s3", "gs")


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int
    size: int


def _is_member(f, at: int) -> bool:
    """Whether a member begins there: what follows the three bytes can be decompressed."""
    head = f.read_at(1 << 16, at)
    if len(head) < 18 or head[3] & 0xE0:
        return False
    try:
        d = zlib.decompressobj(31)
        return bool(d.decompress(head, 1 << 20)) or d.eof
    except zlib.error:
        return False


def first_member(f, start: int, stop: int) -> int | None:
    """The first place from start, and before stop, where a member begins."""
    at = start
    while at < stop:
        window = f.read_at(CHUNK + len(START) - 1, at)
        found = window.find(START)
        while found >= 0:
            if at + found >= stop:
                return None
            if _is_member(f, at + found):
                return at + found
            found = window.find(START, found + 1)
        at += CHUNK
    return None


def contents(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Where the member begins that each piece of content is of, from the member at a place to the file's end. Zeros between and after members are passed over."""
    while at < size:
        d, begun = zlib.decompressobj(31), at
        while not d.eof:
            read = f.read_at(CHUNK, at)
            if not read:
                raise ValueError("the file ends within a member")
            if begun == at and not read.strip(b"\0"):
                return
            at += len(read)
            piece = d.decompress(read, 8 * CHUNK)
            yield begun, piece
            while d.unconsumed_tail and not d.eof:
                yield begun, d.decompress(d.unconsumed_tail, 8 * CHUNK)
        at -= len(d.unused_data)
        while (pad := f.read_at(CHUNK, at)) and pad[0] == 0:
            zeros = len(pad) - len(pad.lstrip(b"\0"))
            at += zeros


def lines_of_range(f, part: ByteRange) -> Iterator[bytes]:
    """The lines that begin after the range's first member begins, as far as its last one, and the line that goes on from there. The first range has the file's first line too."""
    at = 0 if part.start == 0 else first_member(f, part.start, part.stop)
    if at is None:
        return
    drop, rest = part.start > 0, b""
    for begun, piece in contents(f, at, part.size):
        if begun >= part.stop:  # another range's member: the first line end in it is the last one here
            rest += piece
            cut = rest.find(b"\n")
            if cut >= 0:
                if not drop:
                    yield rest[:cut]
                return
            continue
        own = (rest + piece).split(b"\n")
        rest = own.pop()
        if own and drop:
            own, drop = own[1:], False
        yield from own
    if rest and not drop:
        yield rest


class LineReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[ByteRange]:
        store, inner = _opened(self.path)
        info = store.get_file_info(inner)
        files = [(self.path, info.size)] if info.type == fs.FileType.File else [(f"{self.path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(store.get_file_info(fs.FileSelector(inner)), key=lambda f: f.base_name) if f.base_name.endswith(".gz")]
        return [ByteRange(path, at, min(at + self.range_bytes, size), size) for path, size in files for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.size:
            return
        store, inner = _opened(partition.path)
        held: list[str] = []
        with store.open_input_file(inner) as f:
            for line in lines_of_range(f, partition):
                held.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                if len(held) == LINES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["value"])


class LineSource(DataSource):
    """format("gzip_lines"): the lines of a .gz file, or of a folder of them. Options: path, rangeBytes."""

    @classmethod
    def name(cls) -> str:
        return "gzip_lines"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> LineReader:
        return LineReader(self.options["path"], int(self.options.get("rangebytes", self.options.get("rangeBytes", RANGE_BYTES))))


def read_lines(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Lines of a text file. A .gz file goes by ranges: each task decompresses the members that begin in its range, so a file of many members is read by many tasks; one member is one task's work, see reblock()."""
    scheme = path.split(":", 1)[0] if ":" in path.split("/", 1)[0] else "file"
    if not path.endswith(".gz") or scheme not in STORES or any(c in path for c in "*?[{,"):
        return spark.read.text(path)
    spark.dataSource.register(LineSource)
    return spark.read.format("gzip_lines").option("rangeBytes", range_bytes).load(path)


def reblock(spark: SparkSession, path: str, out: str, parts: int) -> None:
    """Write a file's lines again as parts gzip files, in no order: for dumps of one member, which are decompressed once by one task, and read by many ever after."""
    spark.read.text(path).repartition(parts).write.option("compression", "gzip").text(out)
