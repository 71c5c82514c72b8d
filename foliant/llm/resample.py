"""Importance resampling towards a target: hashed n-gram counts from word tries, gains on their nodes, and a draw by seeded scores."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import LOWER, UPPER, quoted, read_table, setting, unused
from foliant.operators.tables import placed
from foliant.sources.scratch import materialise

#: A word's bytes, after A-Z are lowered, are 0-9, a-z and all beyond ASCII; any other ends it.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Rows of an Arrow batch, and nodes of a trie that is started anew at the next batch.
ROWS, NODES = 1024, 400_000


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


class Node(dict):
    """An n-gram in a trie of words: its next words, its count, the CRC-32 of its text, and the gain of its bucket (where a trie has gains)."""

    __slots__ = ("count", "crc", "gain", "gains")

    def __init__(self, crc: int | None, gains: list[int] | None):
        self.count, self.crc, self.gains = 0, crc, gains
        self.gain = gains[crc % len(gains)] if gains is not None and crc is not None else 0

    def __missing__(self, word: bytes) -> Node:
        """The CRC goes on from this node's state, so no n-gram is ever put together."""
        node = self[word] = Node(zlib.crc32(word) if self.crc is None else zlib.crc32(word, zlib.crc32(b" ", self.crc)), self.gains)
        return node


class Trie:
    """The n-grams of a partition's texts; buckets' totals are taken from the nodes whenever the trie starts anew, so that its size is bounded and no count is lost."""

    def __init__(self, longest: int, buckets: int, gains: list[int] | None = None, most: int = NODES):
        self.longest, self.buckets, self.gains, self.most = longest, buckets, gains, most
        self.totals = np.zeros(buckets, np.int64)
        self.root = Node(None, gains)
        self.size = 0

    def walk(self, words: list[bytes]) -> Iterator[list[Node]]:
        """The nodes of the runs of 1, 2, ... words, run by run."""
        nodes = list(map(self.root.__getitem__, words))
        yield nodes
        for n in range(1, self.longest):
            nodes = [node[word] for node, word in zip(nodes, words[n:], strict=False)]
            yield nodes

    def count(self, words: list[bytes]) -> None:
        for nodes in self.walk(words):
            for node in nodes:
                node.count += 1

    def score(self, words: list[bytes]) -> int:
        return sum(node.gain for nodes in self.walk(words) for node in nodes)

    def renew(self, last: bool = False) -> None:
        """Between texts: take the totals where the trie is full or done."""
        below, self.size = [self.root], 0
        while below:
            self.size += sum(map(len, below))
            below = [node for parent in below for node in parent.values()]
            if last and below:
                crcs = np.fromiter((node.crc for node in below), np.int64, len(below))
                self.totals += np.bincount(crcs % self.buckets, np.fromiter((node.count for node in below), np.int64, len(below)), self.buckets).astype(np.int64)
        if last:
            self.root = Node(None, self.gains)


def bucket_counts(texts: DataFrame, text_col: str = "text", *, longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket and n: how many n-grams of 1 to longest words fall in each bucket, over all whole texts. Each partition counts in a trie of its own and hands on its buckets' totals, which are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, buckets)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                trie.count(words_of(text))
            trie.renew()
            if trie.size > trie.most:
                trie.renew(last=True)
        trie.renew(last=True)
        held = np.flatnonzero(trie.totals)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(trie.totals[held], pa.int64())], names=["bucket", "n"])

    rows = texts.select(F.col(quoted(text_col)).cast("string").alias("text"))
    with setting(texts.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS)):
        return rows.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> list[int]:
    """floor(1000 * ln of the target's over the source's share) by bucket, with one added to each count. The driver holds a number per bucket, whatever the tables' size."""
    s, t = ({r["bucket"]: r["n"] for r in counts.collect()} for counts in (source, target))
    over, under = float(sum(s.values()) + buckets), float(sum(t.values()) + buckets)
    return [math.floor(1000 * math.log((float(t.get(k, 0) + 1) * over) / (float(s.get(k, 0) + 1) * under))) for k in range(buckets)]


def scored(docs: DataFrame, gains: list[int], *, id_col: str = "doc_id", text_col: str = "text", longest: int = 1, seed: int = 2024) -> DataFrame:
    """id, n_words, n_features, weight (the floored mean of the features' gains, 0 without any) and score (weight and a Gumbel number from the seed and the id) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(longest, len(gains), gains)
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                n = sum(max(0, len(words) - i) for i in range(longest))
                found.append((len(words), n, trie.score(words) // n if n else 0))
            trie.renew()
            if trie.size > trie.most:
                trie = Trie(longest, len(gains), gains)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=[id_col, "n_words", "n_features", "weight"])

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS)):
        found = rows.mapInArrow(run, f"{quoted(id_col)} {kind}, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(quoted(id_col)).cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return found.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))))


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000, per_cent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """id, n_features, weight, score and rank of every row of docs; rank is 1, 2, ... for the per_cent of the documents of least_words words or more whose scores are highest (ties to smaller ids), null for all others.

    All texts of both tables are counted, and all documents scored. Null and empty texts have no features and weight 0. A row without an id has no score and is not among those drawn from; rows of one id are scored each, equal ones share nothing but ties
    (more features first). Columns that aren't named don't count, whatever their names. Without documents there are no rows; without a target all gains come from zero counts.
    """
    gains = bucket_gains(bucket_counts(docs, text_col, longest=longest, buckets=buckets), bucket_counts(target, target_text, longest=longest, buckets=buckets), buckets)
    rows = materialise(scored(docs, gains, id_col=id_col, text_col=text_col, longest=longest, seed=seed), "scores")
    out, place = unused(rows.columns, "out"), unused(rows.columns, "place")
    rows = rows.withColumn(out, (~(F.coalesce(F.col("n_words") >= least_words, F.lit(False)) & F.col("score").isNotNull())).cast("int"))
    drawn = rows.where(F.col(out) == 0).count() * per_cent // 100
    ranked = placed(rows, [F.col(out), F.desc("score"), F.col(quoted(id_col)), F.desc("n_features")], place)
    return ranked.select(quoted(id_col), "n_features", "weight", "score", F.when((F.col(out) == 0) & (F.col(place) <= drawn), F.col(place)).cast("long").alias("rank"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_WORDS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

QUERIES = {"op12_resample": op12_resample}
ORACLE_SQL = {
    "op12_resample": f"""WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents), b AS (SELECT {_WORDS} AS w FROM benchmark),
dw AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM d) GROUP BY r, word), bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY word),
known AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
bucket AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(word)), lambda i: CAST(concat('0x', substr(hex(encode(word)), 2 * i + 1, 2)) AS BIGINT))), lambda a, b: xor(a >> 8, tab[xor(a, b) % 256 + 1])), 4294967295) % 10000 AS k FROM known, crc),
s AS (SELECT k, sum(n) AS n FROM dw JOIN bucket USING (word) GROUP BY k), t AS (SELECT k, sum(n) AS n FROM bw JOIN bucket USING (word) GROUP BY k),
gains AS (SELECT k, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * ((SELECT CAST(sum(n) AS DOUBLE) FROM s) + 10000) / ((CAST(coalesce(s.n, 0) AS DOUBLE) + 1) * (coalesce((SELECT CAST(sum(n) AS DOUBLE) FROM t), 0) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (k)),
weights AS (SELECT r, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM dw JOIN bucket USING (word) JOIN gains USING (k) GROUP BY r),
scores AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('2024:', doc_id)), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)),
places AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * (SELECT count(*) FROM places) // 100 THEN place END AS rank FROM scores LEFT JOIN places USING (r)""",
}
