"""SentencePiece encoding and decoding on a relational lattice of substrings."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from foliant.llm.common import Bank, Numbers, bucketed, quoted, read_table, setting

SPACE = "▁"
#: Words of so many letters at most are folded in one number; cells of 48 places in a row of a longer word's state.
SHORT, CELLS = 60, 48
#: A task's cache of words holds so many, and an Arrow batch so many texts: what a worker needs beside its group's units.
WORDS, ROWS = 200_000, 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: So many places of a long word go on together.
STEP = 32


@dataclass(frozen=True)
class Pieces:
    """Normal pieces with ids and scores, ids of single bytes, and whether the model merges pairs (bpe) or takes the best path (unigram)."""

    table: tuple[tuple[str, int, float], ...]
    byte_ids: tuple[int, ...]
    bpe: bool
    late: tuple[tuple[str, int], ...] = ()

    @property
    def alphabet(self) -> frozenset[str]:
        return frozenset(p for p, _, _ in self.table if len(p) == 1)

    @property
    def pairs(self) -> frozenset[str]:
        return frozenset(p[i : i + 2] for p, _, _ in self.table for i in range(len(p) - 1))

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.table)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value, shift, at = value | (data[at] & 127) << shift, shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def is_bpe(proto: bytes) -> bool:
    """Whether the model's training settings (field 2) name the type (field 3) BPE, which is 2."""
    trained = next((v for k, v in _fields(proto) if k == 2), b"")
    return next((v for k, v in _fields(trained) if k == 3), 1) == 2


def _reachable(table: tuple[tuple[str, int, float], ...]) -> tuple[tuple[tuple[str, int, float], ...], tuple[tuple[str, int], ...]]:
    """The pieces that merging makes of their own text; a piece arises in a word by those same merges, as none of them looks beyond it. Raises if their scores rise.

    Of pieces (runs of spaces) with merges of the same score: the last place where one of those begins, before which the piece can't arise.
    """
    score, out, late = {p: s for p, _, s in table}, [], []
    for row in table:
        parts, merges = list(row[0]), []
        while len(parts) > 1:
            best, i = max((score.get(a + b, -math.inf), -i) for i, (a, b) in enumerate(pairwise(parts)))
            if best == -math.inf:
                break
            if merges and best > merges[-1][0]:
                raise ValueError(f"merges towards {row[0]!r} rise in score")
            merges.append((best, sum(map(len, parts[:-i]))))
            parts[-i : 2 - i] = ["".join(parts[-i : 2 - i])]
        if len(parts) == 1:
            out.append(row)
            place = max((at for s, at in merges if s == row[2]), default=0)
            late += [(row[0], place)] * (place > 0)
    return tuple(out), tuple(late)


def load_pieces(path: str) -> Pieces:
    """The pieces of a model file; raises if its words can't be taken apart as units() does."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
    table = tuple((sp.id_to_piece(i), i, sp.get_score(i)) for i in range(n) if not special[i])
    byte_ids = tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))
    bpe = is_bpe(sp.serialized_model_proto())
    kept, late = _reachable(table) if bpe else (table, ())
    found = Pieces(kept, byte_ids, bpe, late)
    letters = found.alphabet
    if sp.encode("a  b", out_type=str)[0][:1] != SPACE or any(c not in letters for p, _, _ in table for c in p) or any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in table):
        raise ValueError("this model's normalisation or pieces are not supported")
    return found


def words_of(text: str) -> list[str]:
    """What follows the mark of a space, word by word; the model puts a space before the text. In runs of spaces, all but the first go with the word."""
    if not text:
        return []
    if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
        return [w[1:] for w in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + text.replace(" ", SPACE))]
    return text.split(" ")


class Cutter:
    """Cuts words into units, stretches that no piece crosses: between neighbours that stand side by side in no piece."""

    def __init__(self, pieces: Pieces):
        letters = sorted(pieces.alphabet)
        self.place = np.zeros(0x110000, np.int32)
        self.place[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.beside = np.zeros((len(letters) + 1, len(letters) + 1), bool)
        for pair in pieces.pairs:
            self.beside[self.place[ord(pair[0])], self.place[ord(pair[1])]] = True

    def cut(self, words: list[str]) -> tuple[list[str], np.ndarray]:
        """The words' units in a row, and how many each has; the mark of a space goes before each word."""
        if not words:
            return [], np.zeros(0, np.int64)
        text = SPACE + SPACE.join(words)
        at = self.place[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        borders = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        apart = np.r_[True, ~self.beside[at[:-1], at[1:]]]
        apart[borders] = True
        begins = np.flatnonzero(apart)
        return [text[i:j] for i, j in pairwise([*begins.tolist(), len(text)])], np.diff(np.r_[np.searchsorted(begins, borders), len(begins)])


def lattice(words: DataFrame, pieces: Pieces, width: int | None = None) -> DataFrame:
    """word and ids of each distinct word (none twice): substrings of bounded length are exploded, joined with the piece table (whose size is the model's), grouped by word, and folded. width: over how many tasks words are dealt."""
    late = dict(pieces.late)
    ranks = {v: i for i, v in enumerate(sorted({row[2] for row in pieces.table}, reverse=True))}
    table = F.broadcast(words.sparkSession.createDataFrame([(*row, ranks[row[2]], late.get(row[0], 0)) for row in pieces.table], "piece string, id int, score double, rank int, late int"))
    n = F.length("word")
    keyed = words.select("word", n.alias("n"), F.when(n <= SHORT, F.col("word")).otherwise(F.concat(F.lit("\0"), F.md5(F.col("word").cast("binary")))).alias("key"))
    keyed = keyed.repartition(width, "key") if width else keyed
    # a long word goes on in parts, under a short name, or each of its substrings would have to be looked for in the whole word
    parts = keyed.withColumn("base", F.explode(F.expr(f"sequence(0, n - 1, IF(n <= {SHORT}, {SHORT}, {STEP}))"))).withColumn("size", F.expr(f"IF(n <= {SHORT}, n, least({STEP}, n - base))"))
    parts = parts.select("key", "n", "base", "size", F.expr(f"IF(n <= {SHORT}, word, substring(word, base + 1, {STEP + pieces.longest}))").alias("part"), F.expr(f"IF(n > {SHORT} AND base = 0, word, null)").alias("whole"))
    spread = parts.withColumn("o", F.explode(F.expr("sequence(0, size - 1)"))).select("key", "n", "part", "o", (F.col("base") + F.col("o")).alias("at"), F.expr("IF(base + o = 0, whole, null)").alias("whole"))
    spread = spread.withColumn("len", F.explode(F.expr(f"sequence(1, least({pieces.longest}, n - at))"))).select("key", "n", "at", "len", "whole", F.expr("substring(part, o + 1, len)").alias("piece"))
    edges = spread.join(table, "piece")
    if pieces.bpe:
        small = max(i for _, i, _ in pieces.table) < 1 << 18 and len(ranks) <= 1 << 18 and pieces.longest < 32
        return _merged(edges, SHORT if small else 0)
    whole = edges.groupBy("key").agg(F.max("n").alias("n"), F.coalesce(F.max("whole"), F.first("key")).alias("word"), F.map_from_entries(F.collect_list(F.struct((F.col("at").cast("long") * 4096 + F.col("len")).alias("k"), F.struct("score", "id").alias("v")))).alias("m"))
    cut = whole.withColumn("b", _best_path(F.col("n"), F.col("m"), pieces.longest))
    return cut.select("word", F.expr("transform(sequence(0, size(b) - 2), i -> try_element_at(m, cast(b[i] AS bigint) * 4096 + b[i + 1] - b[i]).id)").alias("ids"))


def _merged(edges: DataFrame, short: int) -> DataFrame:
    """The ids after merging pairs by falling score (ties: the first that can arise), as a fold over the word's edges in that order.

    The state has a bit for each place, set while it is a boundary. An edge is merged if both of its ends and one place between are boundaries.
    Each edge needs one look only, as load_pieces() found that a piece's score is below those of the merges that lead to it.
    In words of up to short letters the state and each edge are one number. In longer ones, the state has cells of 48 bits in rows of CELLS, so that a merge copies one row and the list of rows.
    """
    small = F.col("n") <= short
    number = "shiftleft(cast(rank AS bigint), 45) | shiftleft(cast(at + late AS bigint), 39) | shiftleft(cast(len - late AS bigint), 34) | shiftleft(cast(63 - at AS bigint), 28) | shiftleft(cast(len AS bigint), 23) | cast(id AS bigint)"
    record = f"struct(rank, at + late AS turn, len - late AS reach, -at AS back, at, len, cast(at div {48 * CELLS} AS int) AS r, cast(at div 48 % {CELLS} AS int) AS c, cast(at % 48 AS int) AS o, shiftleft(2L, len) - 1 AS mask, shiftleft(1L, len) | 1L AS ends, id)"
    e = edges.groupBy("key").agg(F.max("n").alias("n"), F.coalesce(F.max("whole"), F.first("key")).alias("word"), F.sort_array(F.collect_list(F.when(small, F.expr(number)))).alias("ks"), F.sort_array(F.collect_list(F.when(~small, F.expr(record)))).alias("es"))
    at, ln = "(63 - (shiftright(e, 28) & 63))", "(shiftright(e, 23) & 31)"
    both = f"(shiftleft(1L, cast({at} AS int)) | shiftleft(1L, cast({at} + {ln} AS int)))"
    span = f"(shiftleft(2L, cast({at} + {ln} AS int)) - shiftleft(1L, cast({at} AS int)))"
    few = e.withColumn("st", F.expr(f"aggregate(filter(ks, e -> {ln} > 1), shiftleft(2L, n) - 1, (st, e) -> IF(bit_count(st & {span}) = 3 AND (st & {both}) = {both}, st & ~({span} ^ {both}), st))"))
    few = F.expr(f"transform(array_sort(transform(filter(ks, e -> (st & {span}) = {both}), e -> shiftleft({at}, 18) | e & 262143)), e -> cast(e & 262143 AS int))"), few
    cell = f"(shiftright({{0}}[e.r][e.c], e.o) | shiftleft(IF(e.c = {CELLS - 1}, {{0}}[e.r + 1][0], {{0}}[e.r][e.c + 1]), 48 - e.o)) & e.mask"
    cleared = f"transform(st, (row, k) -> CASE WHEN k = e.r OR k = e.r + 1 AND e.c = {CELLS - 1} THEN transform(row, (x, i) -> CASE WHEN k = e.r AND i = e.c THEN x & ~shiftleft(w ^ e.ends, e.o) WHEN k = e.r AND i = e.c + 1 OR k = e.r + 1 AND i = 0 THEN x & ~shiftright(w ^ e.ends, 48 - e.o) ELSE x END) ELSE row END)"
    fold = f"aggregate(filter(es, e -> e.len > 1), array_repeat(array_repeat({(1 << 48) - 1}L, {CELLS}), cast(n div {48 * CELLS} AS int) + 2), (st, e) -> transform(array({cell.format('st')}), w -> IF(bit_count(w) = 3 AND (w & e.ends) = e.ends, {cleared}, st))[0])"
    many = few[1].withColumn("b", F.when(~small, F.expr(fold)))
    ids = F.expr(f"transform(array_sort(transform(filter(es, e -> ({cell.format('b')}) = e.ends), e -> struct(e.at, e.id))), t -> t.id)")
    return many.select("word", F.when(small, few[0]).otherwise(ids).alias("ids"))


def _best_path(n: Column, m: Column, longest: int) -> Column:
    """Viterbi: boundaries of the path of the highest sum of scores. The fold keeps, for each place, the best score and the place before it (of equal scores the earliest place, as the library does)."""
    state = F.array(F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("p")))

    def step(acc: Column, end: Column) -> Column:
        into = F.transform(F.sequence(F.greatest(end - longest, F.lit(0)), end - 1), lambda i: F.struct((F.get(acc, i)["s"] + F.try_element_at(m, i.cast("long") * 4096 + end - i)["score"]).alias("s"), (-i).alias("p")))
        return F.concat(acc, F.array(F.array_max(into)))

    full = F.aggregate(F.sequence(F.lit(1), n), state, step)
    back = lambda acc: F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda b, _: F.when(F.get(b, F.lit(0)) > 0, F.concat(F.array(-F.get(acc, F.get(b, F.lit(0)))["p"]), b)).otherwise(b))
    return F.get(F.transform(F.array(full), back), F.lit(0))


def _pressed(x: np.ndarray) -> bytes:
    """Numbers below 2**32, compressed byte plane by byte plane."""
    return ZstdCompressor(level=3).compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4")[:, 0].astype(np.int64)


def _pressed_units(units: list[str]) -> tuple[bytes, bytes]:
    return _pressed(np.array([len(u) for u in units])), ZstdCompressor(level=3).compress("".join(units).encode("utf-8", "surrogatepass"))


def _units(lengths: bytes, data: bytes) -> list[str]:
    text = ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")
    return [text[i:j] for i, j in pairwise([0, *np.cumsum(_numbers(lengths)).tolist()])]


def _gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    each = length[wanted]
    ends = np.cumsum(each)
    return flat[np.repeat(start[wanted] - ends + each, each) + np.arange(ends[-1] if len(ends) else 0)]


class _Group:
    """Texts of a task as numbers of its distinct units; close() gives their rows."""

    def __init__(self, cutter: Cutter, buckets: int):
        self.cutter, self.buckets = cutter, buckets
        self.words, self.numbers, self.bank, self.bucket = Numbers(), Numbers(), Bank(), np.zeros(0, np.int64)
        self.held: list[tuple[list, list[np.ndarray]]] = []

    def add(self, docs: list, texts: list[str]) -> None:
        if len(self.words) > WORDS:
            self.words, self.bank = Numbers(), Bank()
        each = [np.fromiter(map(self.words.__getitem__, words_of(t)), np.int64) for t in texts]
        units, counts = self.cutter.cut(self.words.fresh)
        self.bank.add(np.fromiter(map(self.numbers.__getitem__, units), "<u4", len(units)), counts)
        self.bucket = np.r_[self.bucket, np.array([zlib.crc32(u.encode("utf-8", "surrogatepass")) % self.buckets for u in self.numbers.fresh], np.int64)]
        self.words.fresh, self.numbers.fresh = [], []
        self.held.append((docs, [self.bank.gather(x)[0] for x in each]))

    def close(self, g: int) -> Iterator[tuple]:
        counts = np.zeros(len(self.numbers), np.int64)
        for _, codes in self.held:
            counts += np.bincount(np.concatenate(codes), minlength=len(counts))
        order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]  # the commonest units get the lowest numbers
        own = np.zeros(len(counts), np.int64)
        own[order] = np.arange(len(order))
        for docs, codes in self.held:
            yield g, docs, [len(c) for c in codes], _pressed(own[np.concatenate(codes)]), None, None, None, None
        names = list(self.numbers)
        sort = np.lexsort((order, self.bucket[order]))
        found, begins = np.unique(self.bucket[order][sort], return_index=True)
        for k, a, b in zip(found.tolist(), begins, [*begins[1:], len(sort)], strict=True):
            yield g, None, None, None, k, _pressed(sort[a:b]), *_pressed_units([names[i] for i in order[sort[a:b]]])
        self.held = []


def encode_texts(docs: DataFrame, pieces: Pieces, *, id_col: str = "doc_id", text_col: str = "text", group_chars: int = 24 << 20, run_chars: int = 2 << 20, cached: int = 400_000, bucket_chars: int = 4 << 20, with_ids: bool = True) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of unsigned little-endian 32-bit ids) and text_crc32 (of the text decoded from the ids, as UTF-8) of every row, and its ids if wanted.

    1. Texts of a task are put into groups of about group_chars and become numbers of their group's units; they lie in a bucketed table, and are not shuffled. 2. A group's units go, compressed, to buckets by hash, one for about bucket_chars of text.
    3. Distinct units are encoded once each on the lattice. 4. In each bucket, the groups' units get their ids, and go back to the groups, where texts are put together. Characters that are no piece become their UTF-8 bytes' ids.
    Null and empty texts have no ids; null ids stay null; repeated rows are returned each; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(quoted(id_col)).cast("string").alias("doc_id"), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).alias("text"))
    buckets = max(64, (rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // bucket_chars)
    raw, byte_ids = _raw(pieces), np.array(pieces.byte_ids, np.int32)
    fields = pa.schema([("g", pa.int64()), ("docs", pa.list_(pa.string())), ("lengths", pa.list_(pa.int32())), ("codes", pa.binary()), ("bucket", pa.int32()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("units", pa.binary())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(pieces)
        g, size, group = TaskContext.get().partitionId() << 24, 0, _Group(cutter, buckets)
        ready = lambda rows: (pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), fields, strict=True)], schema=fields) for part in batched(rows, 64))
        run, held = ([], []), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                run[0].append(doc)
                run[1].append(text)
                held += len(text) + 1
                if held >= run_chars:
                    group.add(*run)
                    run, size, held = ([], []), size + held, 0
                    if size >= group_chars:
                        yield from ready(group.close(g))
                        g, size, group = g + 1, 0, group if len(group.numbers) < cached else _Group(cutter, buckets)
        if run[0]:
            group.add(*run)
        if group.held:
            yield from ready(group.close(g))

    def distinct(rows: pa.Table) -> pa.Table:
        return pa.table({"word": pa.array(sorted(set().union(*(_units(a, b) for a, b in zip(rows.column("sizes").to_pylist(), rows.column("units").to_pylist(), strict=True)))), pa.string())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        """Of each group's units in a bucket: their numbers, how many ids each has, and the ids."""
        listed, names = known.column("ids").combine_chunks(), known.column("word").to_pylist()
        place, length = {w: i for i, w in enumerate(names)}, (listed.value_lengths().to_numpy().astype(np.int64) if len(names) else np.zeros(0, np.int64))
        flat, start = (listed.flatten().to_numpy() if len(names) else np.zeros(0, np.int32)), np.cumsum(length) - length
        out = []
        for g, numbers, sizes, data in zip(*(asked.column(c).to_pylist() for c in ("g", "numbers", "sizes", "units")), strict=True):
            for u in _units(sizes, data):
                if u not in place:  # a character that is no piece
                    place[u] = len(place)
                    more = byte_ids[list(u.encode("utf-8", "surrogatepass"))]
                    start, length, flat = np.r_[start, len(flat)], np.r_[length, len(more)], np.r_[flat, more]
            wanted = np.fromiter(map(place.__getitem__, _units(sizes, data)), np.int64)
            out.append((g, numbers, _pressed(length[wanted]), _pressed(_gathered(flat, start, length, wanted))))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 4, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["g", "numbers", "sizes", "ids"])

    def assemble(texts: pa.Table, own: pa.Table) -> pa.Table:
        column = lambda c: [_numbers(x) for x in own.column(c).to_pylist()] or [np.zeros(0, np.int64)]
        n, flat = np.concatenate(column("numbers")), np.concatenate(column("ids")).astype(np.int32)
        sizes = np.concatenate(column("sizes"))
        start, length = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        start[n], length[n] = np.cumsum(sizes) - sizes, sizes
        decoded = [b"".join([raw.get(i, b"") for i in ids]) for ids in (flat[a : a + k].tolist() for a, k in zip(start, length, strict=True))]
        names, ids, text_crc = [], [], []
        for docs_ids, lengths, codes in zip(*(texts.column(c).to_pylist() for c in ("docs", "lengths", "codes")), strict=True):
            names += docs_ids
            for c in np.split(_numbers(codes), np.cumsum(lengths)[:-1]):
                ids.append(_gathered(flat, start, length, c))
                text_crc.append(zlib.crc32(_text(b"".join(map(decoded.__getitem__, c.tolist()))).encode()))
        offsets = np.cumsum([0, *map(len, ids)])
        columns = {"doc_id": pa.array(names, pa.string()), "n_ids": pa.array(np.diff(offsets), pa.int64()), "ids_crc32": pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), "text_crc32": pa.array(text_crc, pa.int64())}
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids or [np.zeros(0)]), pa.int32()))
        return pa.table(columns)

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with setting(spark, BATCH, str(ROWS)):
        numbered = bucketed(rows.mapInArrow(number, "g long, docs array<string>, lengths array<int>, codes binary, bucket int, numbers binary, sizes binary, units binary"), "numbered", "g", width)
    asked = numbered.where("bucket IS NOT NULL").select("bucket", "g", "numbers", "sizes", "units").repartition(width, "bucket")
    words = asked.groupBy("bucket").applyInArrow(distinct, "word string")
    known = lattice(words, pieces, width).withColumn("home", (F.crc32(F.col("word").cast("binary")) % buckets).cast("int"))
    back = asked.groupBy("bucket").cogroup(known.groupBy("home")).applyInArrow(answer, "g long, numbers binary, sizes binary, ids binary")
    texts = numbered.where("codes IS NOT NULL").select(F.col("g").alias("home"), "docs", "lengths", "codes")
    coded = texts.groupBy("home").cogroup(back.groupBy("g")).applyInArrow(assemble, "doc_id string, n_ids long, ids_crc32 long, text_crc32 long" + ", ids array<int>" * with_ids)
    return coded.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def _raw(pieces: Pieces) -> dict[int, bytes]:
    return {i: p.encode() for p, i, _ in pieces.table} | {i: bytes([b]) for b, i in enumerate(pieces.byte_ids)}


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


def decode_ids(coded: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """coded with text: the pieces' texts in a row, spaces for their mark, without the one put before the first word."""
    raw = _raw(pieces)

    @F.arrow_udf("string")
    def decode(column: pa.Array) -> pa.Array:
        return pa.array([None if ids is None else _text(b"".join([raw.get(i, b"") for i in ids])) for ids in column.to_pylist()], pa.string())

    return coded.withColumn("text", decode(ids_col))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: its number of ids, their crc32 (as unsigned little-endian 32-bit), and the crc32 of the text decoded from them."""
    import public_tokenizers

    pieces = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return encode_texts(read_table(spark, sf_dir, "documents"), pieces, with_ids=False)


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
