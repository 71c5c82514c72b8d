"""Deterministic sharded WARC writer and reader."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import materialise, read_table, scratch_path

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the public name space for URLs
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST_DDL = "shard long, file string, records long, bytes long, sha1 string, first_id long, last_id long"
#: Tasks that read archives, at most.
MOST_READERS = 10_000
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: str, nth: int = 0) -> str:
    """The id of the nth record of a page and a digest; no two records have the same."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id} {digest}' + (f' {nth}' if nth else ''))}>"


def _record(kind: str, ident: str, fields: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    head = [("WARC-Type", kind), ("WARC-Record-ID", ident), ("WARC-Date", date), ("WARC-Block-Digest", f"sha1:{digest}"), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, nth: int = 0) -> bytes:
    """A response record, or a revisit record of the page refers_to: the same without its payload. nth: how many records of the page and the digest come before it."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")]
    if url:
        fields.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is None:
        return _record("response", record_id(page_id, digest, nth), fields, block + payload, date)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _record("revisit", record_id(page_id, digest, nth), fields, block, date)


def _store(uri: str):
    """File system and path of a URI, on the machine that asks."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class _Roller:
    """Writes one shard's files: each under a temporary name until it is whole, then by its own."""

    def __init__(self, out: str, shard: int, roll_bytes: int, level: int, date: str):
        self.store, self.root = _store(out)
        self.shard, self.roll, self.level, self.date = shard, roll_bytes, level, date
        self.attempt, self.count, self.file = uuid.uuid4().hex, 0, None

    def add(self, page_id: int | None, record: bytes) -> dict | None:
        if self.file is None:
            self.name = f"shard-{self.shard:08d}-{self.count:06d}.warc.gz"
            self.temp = f"{self.root}/_temporary/{self.attempt}-{self.name}"
            self.store.create_dir(f"{self.root}/_temporary", recursive=True)
            self.file, self.sha = self.store.open_output_stream(self.temp, compression=None), hashlib.sha1()
            self.records, self.size, self.first = 0, 0, page_id
            self._put(_record("warcinfo", record_id(None, self.name), [("Content-Type", "application/warc-fields"), ("WARC-Filename", self.name)], b"format: WARC File Format 1.1\r\n", self.date))
        self._put(record)
        self.records, self.last = self.records + 1, page_id
        return self.close() if self.size >= self.roll else None

    def _put(self, record: bytes) -> None:
        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)  # a gzip member of its own, without a time in its header
        data = z.compress(record) + z.flush()
        self.file.write(data)
        self.sha.update(data)
        self.size += len(data)

    def close(self) -> dict | None:
        if self.file is None:
            return None
        self.file.close()
        self.store.move(self.temp, f"{self.root}/{self.name}")  # a second attempt at the same file has the same bytes
        self.file, self.count = None, self.count + 1
        return {"shard": self.shard, "file": self.name, "records": self.records, "bytes": self.size, "sha1": self.sha.hexdigest(), "first_id": self.first, "last_id": self.last}


def sort_key(page_id: Column, digest: Column) -> Column:
    """A string that sorts as (page_id, digest) does, null ids first."""
    return F.concat(F.coalesce(F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("-")), digest)


def _starts(keys: DataFrame, shard_bytes: int, most: int) -> list[str]:
    """The first key of each shard: all keys (key, n) in order, cut where their running bytes pass the next multiple of shard_bytes, or of a most-th of all bytes if that is more.

    Keys are sorted in ranges; where Spark's sample puts the bounds of those doesn't matter, as bytes run on from range to range. The driver gets a row per shard."""
    ranged = materialise(keys.select("key", (F.col("n") + 400).alias("b")).repartitionByRange("key").withColumn("part", F.spark_partition_id()), "warc-ranges")
    sizes = ranged.groupBy("part").agg(F.sum("b").alias("b"))
    so_far = lambda w: F.coalesce(F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("part", so_far(Window.orderBy("part")).alias("before"))  # a row per range
    size = max(shard_bytes, -(-(sizes.agg(F.sum("b")).head()[0] or 0) // most))
    at = ranged.withColumn("own", so_far(Window.partitionBy("part").orderBy("key"))).join(F.broadcast(before), "part")
    found = at.groupBy(F.floor((F.col("before") + F.col("own")) / size).alias("shard")).agg(F.min("key").alias("key")).select("key").distinct().orderBy("key")
    return [r["key"] for r in found.collect()]


def _shard_of(key: Column, starts: list[str]) -> Column:
    """The place of the last of starts that is not above key, by halving; the first start is not above any."""
    every, steps = F.split(F.lit(",".join(starts)), ","), [1 << b for b in reversed(range(len(starts).bit_length()))]
    further = lambda at, step: F.when((at + step < len(starts)) & (F.get(every, at + step) <= key), at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further) if len(starts) > 1 else F.lit(0)


def write_warc(pages: DataFrame, out: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_bytes: int = 1000, shard_bytes: int = 16 << 20, roll_bytes: int = 8 << 20, most_shards: int = 65_536, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of pages to gzipped WARC files under the URI out; returns the manifest, a row per file.

    Records are sorted by id, then digest (null ids first), and cut into shards of about shard_bytes of payload (more, if there would be over most_shards); each is one task's. A file ends once roll_bytes of compressed records are in it.
    Of rows with equal payloads of revisit_bytes at least, those with the largest id are responses and the others revisit it; if no id is known, all are responses. Null payloads are empty.
    Files are written under temporary names and moved when whole; out/_manifest names those that count, and is committed last. The same rows give the same bytes. An empty table gives an empty manifest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    keys = materialise(rows.select("page_id", "digest", F.length("payload").cast("long").alias("n")), "warc-keys")
    starts = _starts(keys.withColumn("key", sort_key(F.col("page_id"), F.col("digest"))), shard_bytes, most_shards)
    kept = keys.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("c")).where("c > 1 and keep is not null")
    repeats = keys.where(F.col("n") >= revisit_bytes).join(kept.select("digest", "keep"), "digest").where("page_id is null or page_id < keep").select("page_id", "digest", "keep").distinct()
    # a mark for each revisit comes just before its page
    marks = repeats.select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "keep")
    both = rows.withColumn("keep", F.lit(None).cast("long")).unionByName(marks).withColumn("shard", _shard_of(sort_key(F.col("page_id"), F.col("digest")), starts))
    both = both.repartitionById(max(1, len(starts)), F.col("shard")).withColumn("shard", F.col("shard").cast("long")).sortWithinPartitions("page_id", "digest", F.col("payload").isNotNull(), "url")
    names = ("shard", "page_id", "url", "payload", "digest", "keep")
    fields = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, mark, before, nth = None, None, None, 0
        done: list[dict] = []
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            for shard, page, url, payload, digest, keep in zip(*(c.to_pylist() if n != "payload" else c for n, c in zip(names, cols, strict=True)), strict=True):
                if roller is None or roller.shard != shard:
                    done += [x for x in [roller and roller.close()] if x]
                    roller = _Roller(out, shard, roll_bytes, level, date)
                if not payload.is_valid:
                    mark = (page, digest, keep)
                    continue
                known = mark[2] if mark and mark[:2] == (page, digest) else None
                before, nth = (page, digest), nth + 1 if before == (page, digest) else 0
                done += [x for x in [roller.add(page, page_record(page, url, payload.as_py(), digest, known, date, nth))] if x]
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=fields)
                done = []
        done += [x for x in [roller and roller.close()] if x]
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=fields)

    both.select(*names).mapInArrow(run, MANIFEST_DDL).write.mode("overwrite").parquet(f"{out}/_manifest")
    return pages.sparkSession.read.schema(MANIFEST_DDL).parquet(f"{out}/_manifest")


def parse_warc(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode().rstrip("\r\n").partition(": ")
            fields[k.lower()] = v
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n" or len(block) != int(fields["content-length"]):
            raise ValueError(f"record {fields.get('warc-record-id')} is cut off")
        yield fields, block


class _Summed(io.RawIOBase):
    """A stream whose bytes are counted and digested as they are read."""

    def __init__(self, stream):
        self.stream, self.sha1, self.size = stream, hashlib.sha1(), 0

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        read = self.stream.read(len(into))
        into[: len(read)] = read
        self.sha1.update(read)
        self.size += len(read)
        return len(read)


def _page_row(f: dict[str, str], block: bytes, with_payload: bool) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    known = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    if f["warc-block-digest"] != f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}" or f["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != known):
        raise ValueError(f"record {f['warc-record-id']} does not match its digest")
    number = lambda k: int(f[k]) if k in f else None
    row = {"page_id": number("x-page-id"), "url": f.get("warc-target-uri"), "record_type": f["warc-type"], "refers_to": number("x-refers-to-page-id"), "payload_bytes": size, "payload_digest": known}
    return row | ({"payload": payload if f["warc-type"] == "response" else None} if with_payload else {})


def read_warc(spark: SparkSession, out: str, with_payload: bool = False) -> DataFrame:
    """The page records of the files that out/_manifest names. Raises if one of them is gone, or has other bytes or another number of records than the manifest says, and if a record doesn't match its digests.

    The manifest's rows are what is dealt to tasks; each opens its files and reads them as streams, so no file is held whole, and none is moved."""
    manifest = spark.read.schema(MANIFEST_DDL).parquet(f"{out}/_manifest").select("file", "records", "bytes", "sha1")
    n = min(max(1, manifest.count()), MOST_READERS)

    def lost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out)
        for batch in batches:
            sizes = [i.size for i in store.get_file_info([f"{root}/{name}" for name in batch.column(0).to_pylist()])]
            yield batch.select(["file"]).filter(pa.array([size != want for size, want in zip(sizes, batch.column(1).to_pylist(), strict=True)], pa.bool_()))

    if gone := [r["file"] for r in manifest.select("file", "bytes").mapInArrow(lost, "file string").limit(5).collect()]:
        raise FileNotFoundError(f"gone, or not as long as the manifest says: {gone}")
    ddl = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out)
        for batch in batches:
            for name, records, size, sha1 in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, seen = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    content = _Summed(f)
                    try:
                        for found, block in parse_warc(io.BufferedReader(gzip.GzipFile(fileobj=io.BufferedReader(content, 1 << 20)), 1 << 20)):
                            if found["warc-type"] != "warcinfo":
                                seen += 1
                                rows.append(_page_row(found, block, with_payload))
                            if len(rows) >= 2000:
                                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                                rows = []
                    except (ValueError, KeyError, EOFError, gzip.BadGzipFile, zlib.error) as e:
                        raise ValueError(f"{name} has been altered: {e}") from e
                if (content.size, content.sha1.hexdigest()) != (size, sha1):
                    raise ValueError(f"{name} has been altered")
                if seen != records:
                    raise ValueError(f"{seen} records of {records} in {name}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return manifest.repartition(n, "file").mapInArrow(run, ddl)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    out = scratch_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HTML = "coalesce(html, '')"
ORACLE_SQL = {
    "op10_warc": f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode({_HTML})) AS BIGINT) AS payload_bytes, sha1({_HTML}) AS payload_digest FROM pages),
k AS (SELECT payload_digest AS d, max(page_id) AS keep FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keep > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keep > page_id THEN keep END AS refers_to
FROM p LEFT JOIN k ON d = payload_digest AND payload_bytes >= 1000"""
}
QUERIES = {"op10_warc": op10_warc}
