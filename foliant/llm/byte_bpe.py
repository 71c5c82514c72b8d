"""Byte-level BPE by prefix dynamic programming: each byte prefix of a piece has one valid last token, which is stored."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Bank, Numbers, quoted, read_table, setting

#: A space before something else than white space starts a new piece, whatever stands around it. A text without ODD is cut there at each space.
CUT, ODD = regex.compile(r" (?=\S)"), regex.compile(r" (?:\s|\Z)")
ROWS = 2048


class Merges:
    """The merges that a rank file implies.

    A token of several bytes is made of two others in one way: they end up side by side, unmerged, when its bytes are merged by the tokens before it.
    Tokens for which there are no such two never come from merges; they only stand for a whole piece of just their bytes.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.left, self.right, self.made = {}, {}, {}
        self.reached: dict[bytes, int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.reached[token] = rank
                continue
            for cut in range(1, len(token)):
                a, b = self.reached.get(token[:cut]), self.reached.get(token[cut:])
                if a is not None and b is not None and self.beside(a, b):
                    self.left[rank], self.right[rank], self.made[a, b] = a, b, rank
                    self.reached[token] = rank
                    break

    def beside(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a and b: undo their merges, the last first, and see whether one across the border would have come before."""
        before = float("inf")
        while True:
            across = self.made.get((a, b))
            if across is not None and across < before:
                return False
            when_a, when_b = (a if a in self.left else -1), (b if b in self.left else -1)
            if when_a == when_b == -1:
                return True
            if when_a > when_b:  # of equal merges the left one comes first
                before, a = a, self.right[a]
            else:
                before, b = b + 1, self.left[b]


class Prefixes:
    """The last token of each byte prefix of one piece; last[0] stands for the empty prefix."""

    __slots__ = ("content", "last")

    def __init__(self):
        self.content, self.last = b"", [-1]


class ByteBpe:
    """Encodes and decodes as the tiktoken library does with a rank file and a pattern; without special tokens.

    A text is cut before each space that something else than white space follows; such chunks don't depend on each other, so each distinct one is split once,
    and each distinct piece encoded once. At most cache chunks and pieces, of cache_chars characters, are kept (more only while one run of texts lasts).
    """

    def __init__(self, path: str, pattern: str, cache: int = 1_000_000, cache_chars: int = 1 << 23):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.merges = Merges(self.ranks)
        self.longest = max(map(len, self.ranks))
        self.token = {i: t for t, i in self.ranks.items()}
        self.endings = ahocorasick.Automaton()
        for token, rank in self.merges.reached.items():
            self.endings.add_word(token.decode("latin-1"), (rank, len(token)))
        self.endings.make_automaton()
        self.pattern, self.newer = regex.compile(pattern), newer_characters()
        self.cache, self.cache_chars, self.pairs = cache, cache_chars, {}
        self._empty()

    def _empty(self) -> None:
        self.chunks, self.pieces_of, self.pieces, self.ids = Numbers(), Bank(), Numbers(), Bank()
        self.chars = 0

    def extend(self, known: Prefixes, more: bytes) -> Prefixes:
        """Store the last tokens of the prefixes that end in more; those stored already stay right."""
        last, pairs, n = known.last, self.pairs, len(known.content)
        known.content += more
        last += [-1] * len(more)
        from_ = max(0, n - self.longest + 1)
        for end, (token, length) in self.endings.iter(known.content[from_:].decode("latin-1")):
            end += from_ + 1
            if last[end] < 0:
                before = last[end - length]
                if before < 0:
                    fits = end == length
                elif (fits := pairs.get(key := before << 32 | token)) is None:
                    fits = pairs[key] = self.merges.beside(before, token)
                if fits:
                    last[end] = token
        if more and last[-1] < 0:
            raise ValueError("a byte has no token")
        if len(pairs) > self.cache:
            pairs.clear()
        return known

    def ids_of(self, known: Prefixes) -> list[int]:
        """The piece's ids, read from its last prefix back."""
        if (whole := self.ranks.get(known.content)) is not None:
            return [whole]
        out, end = [], len(known.content)
        while end:
            out.append(known.last[end])
            end -= len(self.token[known.last[end]])
        return out[::-1]

    def split(self, text: str) -> list[str]:
        """Matches of the pattern, one after the other."""
        if text.isascii() or self.newer.isdisjoint(text):
            return self.pattern.findall(text)
        known = "".join("\ue000" if c in self.newer else c for c in text)  # neither a letter nor a number nor white space
        return [text[m.start() : m.end()] for m in self.pattern.finditer(known)]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and how many each has. Pieces go in order of their bytes, so that each goes on from the prefix that it shares with the one before."""
        contents = [p.encode() for p in pieces]
        order = sorted(range(len(pieces)), key=contents.__getitem__)
        flat, lengths, known = [], [], Prefixes()
        for i in order:
            content = contents[i]
            whole = self.ranks.get(content)
            if whole is None:
                shared = shared_bytes(known.content, content)
                known.content, known.last = content[:shared], known.last[: shared + 1]
                found = self.ids_of(self.extend(known, content[shared:]))
                flat += found
                lengths.append(len(found))
            else:
                flat.append(whole)
                lengths.append(1)
        by_bytes = Bank()
        by_bytes.add(np.array(flat, "<u4"), np.array(lengths, np.int64))
        return by_bytes.gather(np.argsort(np.array(order, np.int64)))

    def _number(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))

    def encode_run(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text. A text is its first chunk, and numbered chunks that each follow a space."""
        if len(self.chunks) + len(self.pieces) > self.cache or self.chars > self.cache_chars:
            self._empty()
        firsts, later = [], []
        for text in texts:
            first, *rest = CUT.split(text) if ODD.search(text) else text.split(" ")
            firsts.append(self._number(self.split(first)))
            later.append(np.fromiter(map(self.chunks.__getitem__, rest), np.int64, len(rest)))
        fresh, self.chunks.fresh = [" " + w for w in self.chunks.fresh], []
        found = self.split("".join(fresh))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        borders = np.cumsum(np.fromiter(map(len, fresh), np.int64, len(fresh)))
        self.pieces_of.add(self._number(found), np.diff(np.searchsorted(ends, borders), prepend=-1))
        self.chars += int(borders[-1]) if fresh else 0
        self.ids.add(*self.encode_pieces(self.pieces.fresh))
        self.pieces.fresh = []
        for first, rest in zip(firsts, later, strict=True):
            yield self.ids.gather(np.concatenate([first, self.pieces_of.gather(rest)[0]]))[0]

    def encode_all(self, texts: list[str], chars: int = 1 << 23) -> Iterator[np.ndarray]:
        """Ids of each text; worked on in runs of about chars characters."""
        run, held = [], 0
        for text in texts:
            run.append(text)
            held += len(text)
            if held >= chars:
                yield from self.encode_run(run)
                run, held = [], 0
        yield from self.encode_run(run)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


class EditableText:
    """A text's ids, kept right while it is changed: what a change doesn't reach is not encoded again, and a changed piece goes on from its last unchanged prefix."""

    def __init__(self, bpe: ByteBpe, text: str = ""):
        self.bpe, self.text, self.encoded_bytes = bpe, "", 0
        self.chunks: list[tuple[str, list[Prefixes]]] = []
        self.append(text)

    @property
    def ids(self) -> list[int]:
        return [i for _, pieces in self.chunks for p in pieces for i in self.bpe.ids_of(p)]

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put new in the place of the characters from start to end."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError("the span is not within the text")
        # The chunk of the character before start is the first that can change: what comes decides how its white space and apostrophes are cut.
        first, at = 0, 0
        while first < len(self.chunks) and at + len(self.chunks[first][0]) < start:
            at += len(self.chunks[first][0])
            first += 1
        if first == len(self.chunks) and first:
            first -= 1
            at -= len(self.chunks[first][0])
        # The chunk that holds the character at end is the last; where white space follows, or nothing does, so does the cut.
        last, stop = first, at
        while last < len(self.chunks) and stop <= end:
            stop += len(self.chunks[last][0])
            last += 1
        middle = self.text[at:start] + new + self.text[end:stop]
        self.text = self.text[:start] + new + self.text[end:]
        old = [p for _, pieces in self.chunks[first:last] for p in pieces]
        words = CUT.split(middle)
        head = words[:1] if not (middle.startswith(" ") and len(words) > 1 and not words[0]) else []
        chunks = head + [" " + w for w in words[1:]]
        self.chunks[first:last] = [(c, [self._piece(p.encode(), old) for p in self.bpe.split(c)]) for c in chunks if c]

    def _piece(self, content: bytes, old: list[Prefixes]) -> Prefixes:
        """The piece's prefixes, from the old piece in its place as far as both are equal."""
        shared, found = 0, Prefixes()
        if old:
            known = old.pop(0)
            shared = shared_bytes(known.content, content)
            found.content, found.last = content[:shared], known.last[: shared + 1]
        self.encoded_bytes += len(content) - shared
        return self.bpe.extend(found, content[shared:])


@lru_cache(maxsize=1)
def newer_characters() -> frozenset[str]:
    """Characters that the regex module takes for letters or numbers, and tiktoken's older Unicode tables don't; they are found by asking both."""
    import tiktoken

    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    odd: set[str] = set()
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        theirs = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        own, other = set(regex.findall(kind, every)), set(bytes(theirs.encode_ordinary(every)).decode())
        if other - own:
            raise ValueError("tiktoken's Unicode tables are newer than those of the regex module")
        odd |= own - other
    return frozenset(odd)


def shared_bytes(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    for n, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return n
    return min(len(a), len(b))


@lru_cache(maxsize=4)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One a worker process, kept for its later tasks."""
    return ByteBpe(path, pattern)


def default_file() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, path: str | None = None, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id, n_tokens and ids (array<int>) of every row; with digests, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes that decoding the ids gives) in place of the ids.

    Whole texts are encoded where they are read, without a shuffle. Null texts are empty: no ids. Null ids stay null, repeated rows come each, other columns are ignored whatever
    their names, an empty table gives no rows. A text without spaces takes time linear in its bytes, and some 50 bytes of memory a byte while it is encoded.
    """
    if path is None:
        path, own = default_file()
        pattern = pattern or own
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                lengths, first, second = [], [], []
                for ids in bpe.encode_all([t or "" for t in part.column(1).to_pylist()]):
                    lengths.append(len(ids))
                    first.append(hashlib.sha256(ids.tobytes()).hexdigest() if digests else ids.astype(np.int32))
                    second.append(hashlib.sha256(bpe.decode(ids)).hexdigest() if digests else None)
                cols = [part.column(0), pa.array(lengths, pa.int64())]
                cols += [pa.array(first, pa.string()), pa.array(second, pa.string())] if digests else [pa.array(first, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids",))])

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS)):
        return rows.mapInArrow(run, f"{quoted(id_col)} {kind}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>"))


def decode_documents(encoded: DataFrame, path: str | None = None, pattern: str | None = None, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids; null ids give a null text. Bytes that are no UTF-8 come as U+FFFD; an id that the file has not raises."""
    if path is None:
        path, own = default_file()
        pattern = pattern or own
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return encoded.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(ids_col)).cast("array<int>").alias("ids")).mapInArrow(run, f"{quoted(id_col)} {kind}, text string")


def encode_edited(docs: DataFrame, path: str | None = None, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", start_col: str = "start", end_col: str = "end", new_col: str = "new") -> DataFrame:
    """id, ids before and after (array<int>), and encoded_bytes of rows that each hold a text and one change of it: new in the place of the characters from start to end (an append: both the text's length; null: that too).

    encoded_bytes tells how many bytes the change took to encode, besides the prefixes that stay.
    """
    if path is None:
        path, own = default_file()
        pattern = pattern or own
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for batch in batches:
            before, after, work = [], [], []
            for text, start, end, new in zip(*(batch.column(i).to_pylist() for i in range(1, 5)), strict=True):
                held = EditableText(bpe, text or "")
                before.append(held.ids)
                held.encoded_bytes = 0
                start = len(held.text) if start is None else start
                held.replace(start, max(start, len(held.text) if end is None else end), new or "")
                after.append(held.ids)
                work.append(held.encoded_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in (before, after)), pa.array(work, pa.int64())], names=[id_col, "ids_before", "ids_after", "encoded_bytes"])

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"), F.col(quoted(start_col)).cast("long").alias("start"), F.col(quoted(end_col)).cast("long").alias("end"), F.col(quoted(new_col)).cast("string").alias("new"))
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", "64"):
        return rows.mapInArrow(run, f"{quoted(id_col)} {kind}, ids_before array<int>, ids_after array<int>, encoded_bytes long")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), digests=True)


QUERIES = {"op11_byte_bpe": op11_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
