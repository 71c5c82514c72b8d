"""Hidden Markov language model: Baum-Welch over the whole corpus, exact likelihoods by scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import held_out, materialise, read_table, words_of

FOLDS, HELD_OUT = 7, 2
END = b""  # the token after a text's last word; no word is empty


@dataclass(frozen=True)
class Hmm:
    """States emit classes of words (hash classes, so that the model has one size for every corpus); a class emits its words by their counts."""

    start: np.ndarray  # states
    step: np.ndarray  # states x states
    emit: np.ndarray  # states x classes


class _Classes(dict):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        c = self[word] = zlib.crc32(word) % self.n
        return c


def first_guess(totals: np.ndarray, states: int, seed: int) -> Hmm:
    """Classes by their counts, with seeded noise that tells the states apart; states that mostly stay."""
    rng = np.random.default_rng(seed)
    emit = (totals + 1.0) * np.exp(rng.normal(0, 1, (states, len(totals))))
    stay = 0.9 if states > 1 else 1.0
    step = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(step, stay)
    return Hmm(np.full(states, 1 / states), step, emit / emit.sum(1, keepdims=True))


def _lockstep(seqs: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sequences by descending length, padded; and at each step how many go on."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    lengths = np.array([len(seqs[i]) for i in order])
    padded = np.zeros((lengths[0], len(seqs)), dtype=np.int32)
    for column, i in enumerate(order):
        padded[: len(seqs[i]), column] = seqs[i]
    return order, padded, np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")


def _alike(seqs: list[np.ndarray], most: int = 4_000_000) -> Iterator[list[int]]:
    """Sequences of like length together, so that their padded table has most places at most (more only for one longer sequence)."""
    group: list[int] = []
    for i in sorted(range(len(seqs)), key=lambda i: -len(seqs[i])):
        if group and len(seqs[group[0]]) * (len(group) + 1) > most:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


def log_likelihoods(model: Hmm, seqs: list[np.ndarray]) -> np.ndarray:
    """Natural logarithm of the probability of each sequence of classes: forward recursion, scaled at each step, all sequences in lockstep. Memory does not grow with length but for the sequences themselves."""
    out, emit = np.zeros(len(seqs)), np.ascontiguousarray(model.emit.T)
    for group in _alike(seqs):
        order, padded, active = _lockstep([seqs[i] for i in group])
        total = np.zeros(len(group))
        a = np.broadcast_to(model.start, (len(group), len(model.start)))
        for t, n in enumerate(active):
            a = (a[:n] @ model.step if t else a[:n]) * emit[padded[t, :n]]
            s = a.sum(1)
            total[:n] += np.log(s)
            a = a / s[:, None]
        out[np.array(group)[order]] = total
    return out


def expected_counts(model: Hmm, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Forward-backward: expected starts, steps and emissions (states x classes), and the log-likelihood."""
    k, emit = len(model.start), np.ascontiguousarray(model.emit.T)
    _, padded, active = _lockstep(seqs)
    alpha, scale, log = [], [], 0.0
    a = np.broadcast_to(model.start, (len(seqs), k))
    for t, n in enumerate(active):
        a = (a[:n] @ model.step if t else a[:n]) * emit[padded[t, :n]]
        s = a.sum(1)
        a = a / s[:, None]
        alpha.append(a)
        scale.append(s)
        log += float(np.log(s).sum())
    steps, gammas, b = np.zeros((k, k)), [None] * len(active), None
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        if b is None:
            b = np.ones((n, k))
        else:
            m = len(b)
            ahead = emit[padded[t + 1, :m]] * b / scale[t + 1][:, None]
            steps += (alpha[t][:m].T @ ahead) * model.step
            now = np.ones((n, k))
            now[:m] = ahead @ model.step.T
            b = now
        gammas[t] = alpha[t] * b
    gamma = np.concatenate(gammas)
    classes = np.concatenate([padded[t, :n] for t, n in enumerate(active)])
    emitted = np.stack([np.bincount(classes, weights=gamma[:, j], minlength=model.emit.shape[1]) for j in range(k)])
    return gammas[0].sum(0), steps, emitted, log


def _chopped(seq: np.ndarray, most: int) -> list[np.ndarray]:
    return [seq[i : i + most] for i in range(0, len(seq), most)]


def baum_welch(sequences: DataFrame, totals: np.ndarray, *, states: int, rounds: int, seed: int, window: int = 512) -> Hmm:
    """sequences: classes as packed uint16. Each round's counts are summed over partitions by class; the driver gets a row per class."""
    model, classes = first_guess(totals, states, seed), len(totals)
    names = [f"s{j}" for j in range(states)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, steps, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
        held, size = [], 0

        def add():
            nonlocal begun, steps, emitted
            a, b, c, _ = expected_counts(model, held)
            begun, steps, emitted = begun + a, steps + b, emitted + c

        for batch in batches:
            for x in batch.column(0):
                for part in _chopped(np.frombuffer(x.as_py(), dtype=np.uint16), window):
                    held.append(part)
                    size += len(part)
                    if size >= 400_000:
                        add()
                        held, size = [], 0
        if held:
            add()
        # rows below 0 are the starts (-1) and the steps from each state (-2 and down)
        key = np.concatenate([np.arange(classes), [-1], -2 - np.arange(states)])
        rows = np.concatenate([emitted.T, begun[None], steps])
        some = rows.any(axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(key[some])] + [pa.array(rows[some, j]) for j in range(states)], names=["key", *names])

    for _ in range(rounds):
        ddl = "key long, " + ", ".join(f"{n} double" for n in names)
        found = sequences.mapInArrow(count, ddl).groupBy("key").agg(*(F.sum(n).alias(n) for n in names)).collect()
        begun, steps, emitted = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
        for r in found:
            v = np.array(r[1:])
            if r["key"] >= 0:
                emitted[:, r["key"]] = v
            elif r["key"] == -1:
                begun = v
            else:
                steps[-2 - r["key"]] = v
        # a little of every event keeps unseen ones possible
        share = (totals + 1.0) / (totals + 1.0).sum()
        emitted, steps, begun = emitted + 50.0 * share, steps + 1.0, begun + 1.0
        model = Hmm(begun / begun.sum(), steps / steps.sum(1, keepdims=True), emitted / emitted.sum(1, keepdims=True))
    return model


def score_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, fold: int = HELD_OUT, states: int = 8, classes: int = 4096, rounds: int = 4, seed: int = 42, group_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Tokens are words [^\\x20\\x09-\\x0D]+ with A-Z lowered, then an end. The model learns from all rows outside the held-out fold: exact counts of all tokens, and the HMM by Baum-Welch over all of their sequences (in windows of 512 tokens).
    P(text) = forward likelihood of its classes * product of (c + 1) / (C + V + 1), with C and V the tokens and distinct tokens of the word's class. base_score is the sum of log10((c + 1) / (N + V + 1)).

    Texts are put into groups of about group_bytes (more only for a longer text). Each group's distinct words, not its tokens, are joined with the counts, and come back to the group.
    Null texts are empty: the end alone. Null ids are trained on, and stay null. Repeated rows count each. Columns beside the two are ignored. An empty table gives no rows; without training rows counts are 0.
    """
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), held_out(F.col(id_col), folds, fold).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("g", pa.int64()), ("doc_id", pa.string()), ("held_out", pa.bool_()), ("text", pa.string()), ("seq", pa.binary())])

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, size, base = _Classes(classes), 0, TaskContext.get().partitionId() << 24
        for b in batches:
            gs, seqs = [], []
            for text in b.column(2):
                text = text.as_py()
                words = words_of(text)
                words.append(END)
                seqs.append(np.fromiter(map(of.__getitem__, words), dtype=np.uint16, count=len(words)).tobytes())
                gs.append(base + size // group_bytes)
                size += len(text.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), *b.columns, pa.array(seqs, pa.binary())], schema=schema)

    grouped = materialise(rows.mapInArrow(group, "g long, doc_id string, held_out boolean, text string, seq binary"), "texts")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen, known = None, Counter(), set()

        def close():
            every = sorted(known.union(seen))
            for i in range(0, len(every), 50_000):
                part = every[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(part), pa.int64()), pa.array(part, pa.binary()), pa.array([seen[w] for w in part], pa.int64())], names=["g", "word", "n"])

        for b in batches:
            for g, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if g != now:
                    if now is not None:
                        yield from close()
                    now, seen, known = g, Counter(), set()
                tokens = words_of(text.as_py())
                tokens.append(END)
                known.update(tokens) if out else seen.update(tokens)
        if now is not None:
            yield from close()

    vocabulary = materialise(grouped.select("g", "held_out", "text").mapInArrow(words, "g long, word binary, n long"), "words")
    counts = vocabulary.groupBy("word").agg(F.sum("n").alias("c"))
    counts = materialise(counts.withColumn("class", F.crc32("word") % classes), "counts")
    by_class = counts.groupBy("class").agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).collect()
    total, distinct = np.zeros(classes), np.zeros(classes)
    for r in by_class:
        total[r["class"]], distinct[r["class"]] = r["c"], r["v"]
    n_train, v_train = int(total.sum()), int(distinct.sum())
    model = baum_welch(grouped.where("not held_out").select("seq"), total, states=states, rounds=rounds, seed=seed)
    floor = np.log10(total + distinct + 1.0)

    def score(texts: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(texts):
            return pd.DataFrame({n: [] for n in names})
        place = {w: i for i, w in enumerate(counted["word"])}
        c = counted["c"].to_numpy()
        logs, seqs, rows = np.log10(c + 1.0), [], []
        kinds = np.fromiter((zlib.crc32(w) % classes for w in counted["word"]), dtype=np.uint16, count=len(counted))
        for doc, out, text in zip(texts["doc_id"], texts["held_out"], texts["text"], strict=True):
            tokens = words_of(text)
            tokens.append(END)
            at = np.fromiter(map(place.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            seq = kinds[at]
            own = float(logs[at].sum())
            rows.append((doc, out, len(at), int((c[at] > 0).sum()), n_train, own - len(at) * np.log10(n_train + v_train + 1.0), own - float(floor[seq].sum())))
            seqs.append(seq)
        done = pd.DataFrame(rows, columns=names)
        done["score"] += log_likelihoods(model, seqs) / np.log(10)
        return done

    # one row for each group and distinct word of it: a frequent word has as many rows as there are groups
    counted = vocabulary.select("g", "word").join(counts.select("word", "c"), "word")
    ddl = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = grouped.drop("seq").groupBy("g").cogroup(counted.groupBy("g")).applyInPandas(score, ddl)
    return scored.withColumn("doc_id", F.col("doc_id").cast(docs.schema[id_col].dataType))


def op9_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"))


QUERIES = {"op9_hmm_scores": op9_hmm_scores}
ORACLE_SQL: dict[str, str] = {}
