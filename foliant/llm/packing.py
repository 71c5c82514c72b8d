"""Cost-balanced packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import Bank, Numbers, read_table

PIECE_COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library, without special tokens being added.

    A text is cut before each space that another character than white space follows; the pre-tokeniser cuts
    there too, whatever stands around it, so each distinct chunk is encoded once, and texts are put together from chunks' ids. Texts with other runs of white space
    that hold a space, and texts that hold a special token, go to the library as a whole. At most cache chunks are kept (more, while one call lasts, only for a single text).
    """

    def __init__(self, path: str, cache: int = 800_000):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, vocab = spec.get("pre_tokenizer") or {}, spec["model"]["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        as_char = {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        as_byte = {c: b for b, c in as_char.items()}
        ranks = {bytes(as_byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        ids = [vocab[t] for t in merged]
        self.chunked = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and ids == sorted(ids) and set(ranks.values()) == set(range(256)) | set(ids) and not any(" " in s or not s for s in self.special)
        if self.chunked:
            self.plain = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.cache = cache
        self._empty()

    def _empty(self) -> None:
        self.heads, self.later, self.head_ids, self.later_ids = Numbers(), Numbers(), Bank(), Bank()

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str], chars: int = 1 << 21) -> list[np.ndarray]:
        """Ids of each text; worked on in runs of about chars characters."""
        out, run, held = [], [], 0
        for text in texts:
            run.append(text)
            held += len(text)
            if held >= chars:
                out += self._encode_run(run)
                run, held = [], 0
        return out + (self._encode_run(run) if run else [])

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encode_run(self, texts: list[str]) -> list[np.ndarray]:
        if not self.chunked:
            return [self._whole(t) for t in texts]
        if len(self.later) + len(self.heads) > self.cache:
            self._empty()
        heads, numbers, counts = [], [], []
        for text in texts:
            head, *rest = text.split(" ")
            heads.append(self.heads[head])
            counts.append(len(rest))
            numbers.append(np.fromiter(map(self.later.__getitem__, rest), np.int64, len(rest)))
        for known, bank, lead in ((self.heads, self.head_ids, ""), (self.later, self.later_ids, " ")):
            bank.add(*self._encode_chunks(known.fresh, lead))
            known.fresh = []
        flat = np.concatenate(numbers)
        ids, each = self.later_ids.gather(flat)
        text_of = np.repeat(np.arange(len(texts)), counts)
        odd = np.bincount(text_of, self.later_ids.length[flat] < 0, len(texts)) + (self.head_ids.length[heads] < 0)
        ends = np.cumsum(np.bincount(text_of, each, len(texts))).astype(np.int64)
        begun = np.concatenate([[0], ends[:-1]])
        return [self._whole(t) if odd[i] else np.concatenate([self.head_ids.gather(np.array([heads[i]]))[0], ids[begun[i] : ends[i]]]) for i, t in enumerate(texts)]

    def _encode_chunks(self, chunks: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and how many each has, -1 for one that a run of white space or a special token reaches into."""
        joined = "".join(chunks)
        special = any(s in joined for s in self.special)
        good = [not (lead and (not c or c[0].isspace()) or special and any(s in c for s in self.special)) for c in chunks]
        own = [lead + c for c, ok in zip(chunks, good, strict=True) if ok]
        lengths = np.full(len(chunks), -1, np.int64)
        if not lead:  # without a space before it, a chunk has no border of its own
            found = [self.plain(c) for c in own]
            lengths[np.array(good, bool)] = [len(x) for x in found]
            return np.fromiter(chain.from_iterable(found), "<u4"), lengths
        ids = np.array(self.plain("".join(own)), "<u4")
        borders = np.cumsum([len(c.encode()) for c in own], dtype=np.int64)
        ends = np.cumsum(self.sizes[ids])
        at = np.searchsorted(ends, borders)
        if len(own) and (at[-1] >= len(ends) or (ends[at] != borders).any()):
            raise ValueError("a token crosses the border of two chunks")
        lengths[np.array(good, bool)] = np.diff(at, prepend=-1)
        return ids, lengths


def capacities(total: int, limit: int) -> np.ndarray:
    """Whole sequences, then the rest in powers of two: they hold total exactly."""
    full, rest = divmod(total, limit)
    return np.array([limit] * full + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1], dtype=np.int64)


def assign(lengths: list[int], limit: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece.

    Documents in descending order (ties: as they come) go to the sequence of lowest estimated cost (ties: the first)
    with room for them. Where none has, a document is cut, and fills the sequence of lowest cost that has any room.
    """
    room = capacities(sum(lengths), limit)
    size, cost, out = room.copy(), np.zeros(len(room)), []
    nxt = 0
    tails = []
    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        start = 0
        while lengths[d] - start >= limit:  # fills an empty sequence by itself
            out.append((d, start, limit, nxt, 0))
            room[nxt], cost[nxt] = 0, linear * limit + quadratic * limit * limit
            nxt, start = nxt + 1, start + limit
        if lengths[d] > start:
            tails.append((d, start))
    own = slice(nxt, None)
    free, spent = room[own], cost[own]
    for d, start in sorted(tails, key=lambda t: t[1] - lengths[t[0]]):
        while (left := lengths[d] - start) > 0:
            fits = free >= left
            s = int(np.argmin(np.where(fits, spent, np.inf))) if fits.any() else int(np.argmin(np.where(free > 0, spent, np.inf)))
            n = min(left, int(free[s]))
            out.append((d, start, n, nxt + s, int(size[nxt + s] - free[s])))
            free[s] -= n
            spent[s] += linear * n + quadratic * n * n
            start += n
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 1024, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 6144, window_tokens: int = 1 << 22, with_ids: bool = False) -> DataFrame:
    """Pack docs into sequences of at most max_tokens; one row per piece.

    A document is its ids, then end_id. Each task packs its documents in windows of about window_tokens (512 documents more
    may pass that), so there is no shuffle, and memory is bounded by the window and its longest texts. What a window's full sequences don't hold goes on to the next window; the task's last one
    ends in sequences of powers of two. So sequences hold the tokens exactly, and none is padded.
    The estimated cost of a piece of n tokens is linear * n + quadratic * n * n.

    Null and empty texts are the end id alone. A null id stays null. Repeated rows are packed each. Columns beside the two are ignored. An
    empty table gives no rows. with_ids adds the pieces' ids (ids array<int>). Sequence ids are unique; they come from the task's number, so the same input splits give the same ids again.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    schema = pa.schema([(c, pa.int64()) for c in PIECE_COLUMNS] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(tokenizer_path)
        base, end = TaskContext.get().partitionId() << 33, np.array([end_id], dtype="<u4")
        held: list[tuple[int | None, np.ndarray, int, int]] = []  # id, tokens, and which of them are still to be packed

        def window(last: bool) -> pa.RecordBatch:
            nonlocal base, held
            pieces = assign([b - a for _, _, a, b in held], max_tokens, linear, quadratic)
            full = sum(b - a for _, _, a, b in held) // max_tokens
            rest = [] if last else [p for p in pieces if p[3] >= full]
            rows = [(held[d][0], held[d][2] + a, n, held[d][1], s, o) for d, a, n, s, o in pieces if last or s < full]
            held = [(held[d][0], held[d][1], held[d][2] + a, held[d][2] + a + n) for d, a, n, _, _ in rest]
            cols = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [zlib.crc32(x[a : a + n]) for _, a, n, x, _, _ in rows], [len(r[3]) for r in rows], [base + r[4] for r in rows], [r[5] for r in rows]]
            if with_ids:
                cols.append([x[a : a + n] for _, a, n, x, _, _ in rows])
            base += full
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            docs_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(texts), 512):
                found = bpe.encode_all([t or "" for t in texts.slice(at, 512).to_pylist()])
                for doc, x in zip(docs_ids[at : at + 512], found, strict=True):
                    x = np.concatenate([x, end])
                    held.append((doc, x, 0, len(x)))
                if sum(b - a for _, _, a, b in held) >= window_tokens:
                    yield window(False)
        if held:
            yield window(True)

    ddl = ", ".join(f"{c} long" for c in PIECE_COLUMNS) + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLE_SQL: dict[str, str] = {}
