"""N-gram Jaccard join: documents whose shingle sets overlap enough are linked, found with prefix tokens and prefix trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import materialise, quoted, read_table, setting, words_of
from foliant.llm.graph import connected_components

SHINGLE, PERCENT = 5, 75
HOT_SHARE, HOT_SEEN, HOT_MOST = 64, 4, 1_000_000
BLOCK, SPAN, GUESTS, WEIGHT = 384, 4, 1536, 500  # sets of a unit, units of a host, and sets of the guests that one task compares with it; a set counts once more for each so many shingles
BUCKET, WINDOW, MIN_BITS = 1_000_000, 1_000_000, 4  # tokens that meet in one task, and that a task gathers before it deals them; 2 to the power of MIN_BITS buckets at least
RUNTIME_FILTER = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # splitmix64's constants


class _WordHash(dict):
    """64-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text; of fewer words than size, one of them all; none without words."""
    words = words_of(text)
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(size, len(h))
    if not n:
        return h
    x = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        x = _mix(x + _MIX[0] + h[k : len(h) - n + 1 + k])
    return np.unique(x)


def least_overlap(a: int, b: int, percent: int) -> int:
    """The smallest intersection with which 100 * intersection >= percent * union for sets of a and b."""
    return -(-percent * (a + b) // (100 + percent))


def shared_at_least(n: int) -> int:
    """How many tokens the prefixes of two linked sets, the smaller of n, must share. More than one, so that a passage in common makes no candidates."""
    return 1 + 6 * n // 100


def prefix_length(n: int, percent: int) -> int:
    """So many first tokens, in one order, of two linked sets have shared_at_least of the smaller in common."""
    return min(n, n - -(-percent * n // 100) + shared_at_least(n))


def kept_bits(x: np.ndarray, bits: int) -> np.ndarray:
    """The first bits + 40 bits of each token, those that are dealt: bits name the bucket, and 5 bytes go with it."""
    return x >> np.uint64(24 - bits)


def packed(x: np.ndarray, width: int) -> bytes:
    """The lower width bytes of each number."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes, width: int) -> np.ndarray:
    x = np.zeros((len(data) // width, 8), dtype=np.uint8)
    x[:, :width] = np.frombuffer(data, dtype=np.uint8).reshape(-1, width)
    return x.reshape(-1).view("<u8")


def squeezed(x: np.ndarray, width: int) -> bytes:
    """The lower width bytes of each number, compressed byte by byte: zeros in front cost nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=6).compress(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def unsqueezed(data: bytes, width: int) -> np.ndarray:
    import zstandard

    return unpacked(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(width, -1).T.tobytes(), width)


def _bounds(home: np.ndarray, times: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Sorted homes as differences, with their numbers; what hi is above lo, as that is mostly 0."""
    return squeezed(np.concatenate([np.diff(home, prepend=0), times, lo, hi - lo]), 5)


def _unbound(data: bytes) -> tuple[np.ndarray, ...]:
    home, times, lo, hi = np.split(unsqueezed(data, 5).astype(np.int64), 4)
    return np.cumsum(home), times, lo, hi + lo


def components_of_pairs(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


class PrefixTree:
    """Ordered sets as paths; a node holds the run of tokens that its sets share below its parent."""

    __slots__ = ("children", "hi", "lo", "rows", "run")

    def __init__(self, sets: list[np.ndarray], order: list[int], depth: int = 0):
        """order: places in sets, sorted as sequences. All of them agree on their first depth tokens."""
        first, last = sets[order[0]], sets[order[-1]]
        m = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:m] != last[depth:m])
        end = depth + int(differ[0]) if len(differ) else m
        self.run = first[depth:end]
        sizes = [len(sets[i]) for i in order]
        self.lo, self.hi = min(sizes), max(sizes)
        self.rows = [i for i in order if len(sets[i]) == end]
        rest = [i for i in order if len(sets[i]) > end]
        self.children, at = [], 0
        while at < len(rest):
            token, stop = sets[rest[at]][end], at
            while stop < len(rest) and sets[rest[stop]][end] == token:
                stop += 1
            self.children.append((rest[at:stop], end))
            at = stop

    def expand(self, sets: list[np.ndarray]) -> None:
        work = [self]
        while work:
            node = work.pop()
            node.children = [PrefixTree(sets, order, depth) for order, depth in node.children]
            work += node.children

    def linked(self, y: np.ndarray, has: np.ndarray, percent: int) -> list[int]:
        """Rows whose sets link with y; has: which tokens y has. Overlaps are counted once for all sets below a node, and subtrees are left
        as soon as the tokens that remain there, or remain of y, can't make up the least overlap for the smallest set below."""
        out, work, n = [], [(self, 0, 0)], len(y)
        while work:
            node, overlap, depth = work.pop()
            if 100 * node.hi < percent * n or 100 * n < percent * node.lo:
                continue
            left = n
            if len(node.run):
                overlap += int(np.count_nonzero(has[node.run]))
                depth += len(node.run)
                left = n - int(np.searchsorted(y, node.run[-1], side="right"))
            for i in node.rows:
                if 100 * overlap >= percent * (depth + n - overlap):
                    out.append(i)
            if overlap + min(node.hi - depth, left) >= least_overlap(max(node.lo, depth), n, percent):
                work += [(c, overlap, depth) for c in node.children]
        return out


def tree_join(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Linked pairs (i of left, j of right), or i < j of left if right is None. Tokens are ordered by how many sets have them, most first, so that paths are shared."""
    every = left + (right or [])
    vocab, places, counts = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    rank = np.empty(len(vocab), dtype=np.int64)
    rank[np.lexsort((vocab, -counts))] = np.arange(len(vocab))
    ends = np.cumsum([len(s) for s in every])
    ranked = [np.sort(x) for x in np.split(rank[places], ends[:-1])]
    stored = ranked[len(left) :] if right is not None else ranked
    order = sorted(range(len(stored)), key=lambda i: stored[i].astype(">u4").tobytes())
    tree = PrefixTree(stored, order)
    tree.expand(stored)
    has, out = np.zeros(len(vocab), dtype=bool), []
    for i, y in enumerate(ranked[: len(left)]):
        has[y] = True
        out += [(i, j) for j in tree.linked(y, has, percent) if right is not None or i < j]
        has[y] = False
    return out


def _hot_tokens(docs: DataFrame, size: int) -> np.ndarray:
    """Shingles that many different texts share, as a sample of every HOT_SHARE-th text shows: the HOT_MOST most frequent at most.
    They come last in the order of tokens. Any order gives the same links; this one keeps prefixes rare."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for b in batches:
            found = [shingle_set(t, size, hashes) for t in b.column(0).to_pylist()]
            if found:
                x, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(n)], names=["token", "n"])

    sample = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HOT_SHARE)) == 0).groupBy(F.md5(F.col("text").cast("binary"))).agg(F.min("text").alias("text")).select("text")
    counted = sample.mapInArrow(tokens, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_SEEN)
    return np.sort(counted.orderBy(F.desc("n"), "token").limit(HOT_MOST).select("token").toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64))


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    if not len(of):
        return np.zeros(len(x), dtype=bool)
    return of[np.minimum(np.searchsorted(of, x), len(of) - 1)] == x


def node_of(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def _home(s: np.ndarray, often: np.ndarray) -> int | None:
    """A token, in 40 bits, by which like sets lie together; sets of one home that have nothing in common cost time, not links."""
    first = (s[often] if 2 * often.sum() >= len(s) else s)[:1]
    return int(first[0] >> np.uint64(24)) if len(first) else None


def _signatures(docs: DataFrame, size: int, hot: Broadcast) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, key (of the set), node (its first 8 bytes as a number) and home."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("node", pa.int64()), ("home", pa.int64())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHash()
        for b in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                s = shingle_set(text, size, hashes)
                key = hashlib.md5(s.tobytes()).digest()
                for col, v in zip(rows, (doc, hashlib.md5((text or "").encode()).digest(), len(s), key, node_of(key), _home(s, _member(s, hot.value))), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return docs.mapInArrow(sign, "doc_id long, digest binary, n_shingles long, key binary, node long, home long")


def _merged(token, home, lo, hi):
    """Sorted by token, then home, with one row of each pair."""
    at = np.lexsort((home, token))
    token, home, lo, hi = token[at], home[at], lo[at], hi[at]
    new = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (home[1:] != home[:-1])]) if len(token) else np.zeros(0, dtype=np.int64)
    return token[new], home[new], (np.minimum.reduceat(lo, new) if len(new) else lo), (np.maximum.reduceat(hi, new) if len(new) else hi)


def _dealt(docs: DataFrame, size: int, percent: int, hot: Broadcast, bits: int) -> DataFrame:
    """Rows of a bucket: its tokens by home (5 bytes each), and once for those of a home and of sets of one size the home, how many tokens they are, and the bounds of the sizes, compressed.

    Tokens are gathered over whole windows of a task, so that copies merge and a row holds many tokens. Two tokens of one set that are the same as dealt would count once: such a set gets the lower bound 0, with which one token in common is enough."""
    names = ("bucket", "token", "bounds")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = _WordHash(), [], 0

        def rows() -> pa.RecordBatch:
            each = [len(t) for t, *_ in held]
            home, lo, hi = (np.repeat(np.array([h[k] for h in held], np.int64), each) for k in (1, 2, 3))
            token, home, lo, hi = _merged(np.concatenate([t for t, *_ in held]), home, lo, hi)
            bucket = (token >> np.uint64(40)).astype(np.int64)
            order = np.lexsort((hi, lo, home, bucket))
            token, home, lo, hi, bucket = (x[order] for x in (token, home, lo, hi, bucket))
            own = np.flatnonzero(np.r_[True, (home[1:] != home[:-1]) | (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
            lo, hi, times = lo[own], hi[own], np.diff(np.r_[own, len(home)])
            found, at = np.unique(bucket, return_index=True)
            at, at_home = np.r_[at, len(bucket)], np.r_[np.searchsorted(own, at), len(own)]
            spans = list(zip(at, at[1:], at_home, at_home[1:], strict=False))
            home = home[own]
            cols = [[packed(token[i:j], 5) for i, j, _, _ in spans], [_bounds(*(x[i:j] for x in (home, times, lo, hi))) for _, _, i, j in spans]]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=names)

        for b in batches:
            for text in b.column(1):
                s = shingle_set(text.as_py(), size, hashes)
                if not len(s):
                    continue
                often = _member(s, hot.value)
                tokens = kept_bits(np.concatenate([s[~often], s[often]])[: prefix_length(len(s), percent)], bits)
                held.append((tokens, _home(s, often), len(s) if len(np.unique(tokens)) == len(tokens) else 0, len(s)))
                n += len(tokens)
                if n >= WINDOW:
                    yield rows()
                    held, n = [], 0
        if held:
            yield rows()

    return docs.mapInArrow(deal, "bucket long, token binary, bounds binary")


def _candidate_homes(docs: DataFrame, signed: DataFrame, size: int, percent: int, hot: Broadcast) -> DataFrame:
    """Pairs of different homes (a < b) whose prefixes have enough tokens in common and whose sizes allow a link.

    Copies have one home and the same tokens; they are merged before the shuffle, in each window, and after it. Prefixes are made anew from the texts: to write them takes more than to make them.
    """
    total = signed.agg(F.sum(F.col("n_shingles"))).head()[0] or 0
    bits = min(24, max(MIN_BITS, int(total * (100 - percent + 6) // 100 // BUCKET).bit_length()))

    def summed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby(["a", "b"], as_index=False, sort=False).agg({"n": "sum", "lo": "min"})

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        home, times, lo, hi = (np.concatenate(x) for x in zip(*map(_unbound, pdf["bounds"]), strict=True))
        token, home, lo, hi = _merged(unpacked(b"".join(pdf["token"]), 5), *(np.repeat(x, times) for x in (home, lo, hi)))
        found, held, lag = [pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "lo": np.zeros(0, np.int64)})], 0, 1
        at = np.arange(max(0, len(token) - 1))
        while len(at := at[at + lag < len(token)]) and len(at := at[token[at] == token[at + lag]]):
            fit = at[(100 * hi[at + lag] >= percent * lo[at]) & (100 * hi[at] >= percent * lo[at + lag])]
            found.append(pd.DataFrame({"a": home[fit], "b": home[fit + lag], "n": 1, "lo": np.minimum(lo[fit], lo[fit + lag])}))
            held += len(fit)
            if held > 500_000:
                found = [summed(found)]
                held = len(found[0])
            lag += 1
        return summed(found)

    met = _dealt(docs, size, percent, hot, bits).groupBy("bucket").applyInPandas(meet, "a long, b long, n long, lo long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"))
    return met.where(F.col("n") >= 1 + F.floor(F.col("lo") * 6 / 100)).select("a", "b")


def packed_sets(sets: list[np.ndarray]) -> tuple[bytes, bytes, bytes]:
    """Sizes, vocabulary and steps of sorted sets: each set is its places in their common vocabulary, as compressed differences. Near copies take some bits a token. The vocabulary goes as differences too."""
    vocab, places = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets], dtype="<u4")
    steps = np.diff(places, prepend=0)
    starts = np.cumsum(sizes[:-1], dtype=np.int64)
    steps[starts] = places[starts]
    return sizes.tobytes(), squeezed(np.diff(vocab, prepend=np.uint64(0)), 8), squeezed(steps, 4)


def unpacked_sets(sizes: bytes, vocab: bytes, steps: bytes) -> list[np.ndarray]:
    words = np.cumsum(unsqueezed(vocab, 8), dtype=np.uint64)
    return [words[np.cumsum(x)] for x in np.split(unsqueezed(steps, 4).astype(np.int64), np.cumsum(np.frombuffer(sizes, dtype="<u4"), dtype=np.int64)[:-1])]


_PACK = "nodes binary, copies binary, sizes binary, vocab binary, steps binary"


def _packs(texts: DataFrame, sides: DataFrame, size: int) -> DataFrame:
    """texts: key, copies, home, part and text; sides: home, part, task, side and alone. Gives a row for each of sides, with the sets of its unit (home, part), packed once where its texts and sides meet. Texts of another set than key's, as rows of one id can have, are left out."""
    fields = [("task", pa.string()), ("side", pa.int32()), ("alone", pa.bool_()), *((c.split()[0], pa.binary()) for c in _PACK.split(", "))]
    schema = pa.schema(fields)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, unit, hashes = None, {}, [], _WordHash()
        for b in batches:
            out: list[list] = []
            for i, (home, part, kind, key, copies, task, side, alone) in enumerate(zip(*(c.to_pylist() for c in b.columns[:8]), strict=True)):
                if (home, part) != now:
                    now, held, unit = (home, part), {}, []
                if kind == 0:
                    if key not in held:
                        s = shingle_set(b.column(8)[i].as_py(), size, hashes)
                        if hashlib.md5(s.tobytes()).digest() == key:
                            held[key] = (copies, s)
                    continue
                if not unit and not held:  # a part that no set fell into
                    continue
                if not unit:
                    nodes, times = (np.array(x, dtype="<i8").tobytes() for x in zip(*((node_of(k), n) for k, (n, _) in held.items()), strict=True))
                    unit, held = [nodes, times, *packed_sets([s for _, s in held.values()])], {}
                out.append([task, side, alone, *unit])
                if len(out) >= 64:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    none = lambda kind: F.lit(None).cast(kind)
    both = texts.select("home", "part", F.lit(0).alias("kind"), "key", "copies", none("string").alias("task"), none("int").alias("side"), none("boolean").alias("alone"), "text")
    both = both.unionAll(sides.select("home", "part", F.lit(1), none("binary"), none("long"), "task", "side", "alone", none("string")))
    return both.repartition("home", "part").sortWithinPartitions("home", "part", "kind").mapInArrow(pack, f"task string, side int, alone boolean, {_PACK}")


def _verified(tasks: DataFrame, percent: int) -> DataFrame:
    """tasks: packed units by task: those of the host (side 0; alone if its own sets are to be compared), then its guests. Gives (a, b, links): edges that span the links of each task, and with a = b and links above 0 how many documents each set links to."""

    def opened(units: list[list]) -> tuple[list[int], list[int], list[np.ndarray]]:
        nodes, copies = (np.frombuffer(b"".join(u[k] for u in units), dtype="<i8").tolist() for k in (0, 1))
        return nodes, copies, [s for _, _, *packed in units for s in unpacked_sets(*packed)]

    def joined(host: list[list], alone: bool, guests: list[list]) -> pa.RecordBatch:
        one, copies, left = opened(host)
        linked = [(one[i], copies[i], one[j], copies[j]) for i, j in tree_join(left, None, percent)] if alone and len(left) > 1 else []
        if guests:
            two, others, right = opened(guests)
            linked += [(two[i], others[i], one[j], copies[j]) for i, j in tree_join(right, left, percent)]
        links: dict[int, int] = {}
        for a, n, b, m in linked:
            links[a], links[b] = links.get(a, 0) + m, links.get(b, 0) + n
        rows = [(a, b, 0) for a, b in components_of_pairs([(a, b) for a, _, b, _ in linked])] + [(a, a, n) for a, n in links.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, host, first, guests = None, [], False, []
        for b in batches:
            for task, side, alone, *unit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if task != now:
                    if host:
                        yield joined(host, first, guests)
                    now, host, first, guests = task, [], False, []
                if side == 0:
                    host.append(unit)
                    first = alone
                else:
                    guests.append(unit)
        if host:
            yield joined(host, first, guests)

    return tasks.select("task", "side", "alone", *(c.split()[0] for c in _PACK.split(", "))).mapInArrow(run, "a long, b long, links long")


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text")).where("doc_id is not null")


def _joined(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """docs: doc_id and text. Gives doc_id, digest (of the text), n_shingles, component_id, n_links, class_id, and component: null without shingles, else one number for all that links reach."""
    hot = docs.sparkSession.sparkContext.broadcast(_hot_tokens(docs, size))
    signed = materialise(_signatures(docs, size, hot), "shingles")
    classes = materialise(signed.where("n_shingles > 0").groupBy("key").agg(F.min("node").alias("node"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min("home").alias("home")), "classes")
    across = materialise(_candidate_homes(docs, signed, size, percent, hot), "homes")
    ends = across.select(F.col("a").alias("home")).unionAll(across.select("b")).distinct().withColumn("met", F.lit(True))
    weight = F.sum(F.lit(1) + F.floor(F.col("n_shingles") / WEIGHT))
    homes = classes.groupBy("home").agg(F.count("*").alias("n"), weight.alias("w")).join(ends, "home", "left").where("n > 1 or met")
    homes = materialise(homes.select("home", "w", F.ceil(F.col("w") / BLOCK).cast("int").alias("parts")), "units")
    one, two = (homes.select(F.col("home").alias(h), F.col("w").alias(f"w{h}"), F.col("parts").alias(f"p{h}")) for h in "ab")
    larger = F.struct("wa", "a") > F.struct("wb", "b")
    way = lambda x, y: F.struct(F.col(x).alias("host"), F.ceil(F.col(f"p{x}") / SPAN).cast("int").alias("hosts"), F.col(y).alias("home"), F.col(f"w{y}").alias("w"), F.col(f"p{y}").alias("parts"))
    met = across.join(one, "a").join(two, "b").select(F.when(larger, way("a", "b")).otherwise(way("b", "a")).alias("m")).select("m.*")
    met = met.unionAll(homes.where(F.col("parts") > SPAN).select(F.col("home").alias("host"), F.ceil(F.col("parts") / SPAN).cast("int"), "home", "w", "parts"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = met.withColumn("at", spread("hosts")).withColumn("part", spread("parts")).where((F.col("host") != F.col("home")) | (F.col("at") < F.floor(F.col("part") / SPAN))).select("host", "at", "home", "part", (F.col("w") / F.col("parts")).alias("w"))
    tasks = met.groupBy("host", "at").agg(F.ceil(F.sum("w") / GUESTS).cast("int").alias("tasks"))
    units = homes.withColumn("part", spread("parts")).select(F.col("home").alias("host"), "part", F.floor(F.col("part") / SPAN).cast("int").alias("at")).join(tasks, ["host", "at"], "left").withColumn("k", F.explode(F.sequence(F.lit(0), F.coalesce("tasks", F.lit(1)) - 1)))
    guests = met.join(tasks, ["host", "at"]).withColumn("k", F.pmod(F.xxhash64("home", "part"), F.col("tasks")).cast("int"))
    task = F.md5(F.concat_ws(" ", "host", "at", "k")).alias("task")
    sides = units.select(task, F.lit(0).alias("side"), (F.col("k") == 0).alias("alone"), F.col("host").alias("home"), "part").unionAll(guests.select(task, F.lit(1), F.lit(False), "home", "part"))
    wanted = classes.select("rep", "key", "copies", "home").join(homes, "home")
    wanted = materialise(wanted.select("rep", "key", "copies", "home", F.pmod(F.xxhash64("rep", "key"), F.col("parts")).cast("int").alias("part")), "wanted")
    texts = wanted.where("copies > 0").join(docs.withColumnRenamed("doc_id", "rep"), "rep")  # a filter that all rows pass: Spark makes a Bloom filter for the other side's shuffle of filtered tables only
    with setting(docs.sparkSession, RUNTIME_FILTER, "1"):
        found = materialise(_verified(_packs(texts, sides, size).repartition("task").sortWithinPartitions("task"), percent), "links")
    linked = connected_components(found.where("a <> b").select("a", "b")).join(classes.select("node", "rep"), "node")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = linked.join(least, "component").select("node", "component", "component_id")
    links = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    rows = signed.where("n_shingles > 0").select("doc_id", "digest", "n_shingles", "key").join(classes.select("key", "node", "rep", "copies"), "key").join(linked, "node", "left").join(links, "node", "left")
    rows = rows.select("doc_id", "digest", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("rep").alias("class_id"), F.coalesce("component", "node").alias("component"))
    none = F.lit(None).cast("long")  # texts without words pass by the joins, where they would all have one key
    return rows.unionAll(signed.where("n_shingles = 0").select("doc_id", "digest", "n_shingles", "doc_id", F.lit(0).cast("long"), "doc_id", none))


def ngram_jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links and class_id of every document.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct shingles of size words (A-Z lowered, words [^\\x20\\x09-\\x0D]+).
    class_id is the smallest id with the same set; component_id the smallest that links reach; n_links counts linked documents, copies included. Hashes of 64 bits stand for shingles.

    1. Documents of one set make a class. 2. Of two linked sets, the first tokens in one global order share some: these go, packed, to
    buckets by hash, where homes (groups of like sets) that meet often enough become candidates. 3. The sets of a home are a unit, or several of about BLOCK sets, each packed once.
    Of two candidates the larger home's units, SPAN at a time, are hosts, and those of the other their guests, as are later units of one home. Each host is joined by prefix trees with itself and, in tasks of about GUESTS sets, with its guests.
    Nothing is capped: a large group of near copies has many units, whose pairs are dealt over all tasks.

    Null ids take no part and are not returned. Null and empty texts, or ones without words, have no shingles and link with nothing: each is its own component. Repeated rows are returned each, and are copies of each other;
    rows of one id with different texts are judged by their texts. Columns beside the two are ignored. An empty table gives no rows.
    """
    return _joined(_own(docs, id_col, text_col), size, percent).select("doc_id", "n_shingles", "component_id", "n_links", "class_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the row with the smallest id, with its own columns; ties go to the smaller md5 of the text, then to the smaller hash of the row. Rows with a null id, and texts without words, stay.

    An id that stands at several texts is judged text by text. Columns of docs may have any names."""
    joined = _joined(_own(docs, id_col, text_col), SHINGLE, PERCENT)
    kept = joined.where("component is not null").groupBy("component").agg(F.min(F.struct("doc_id", "digest")).alias("m")).select("m.*")
    plain = joined.where("component is null").select("doc_id", "digest").distinct()
    own = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"), F.col(quoted(id_col)).cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary"))).alias("digest"))
    one = own.join(kept, ["doc_id", "digest"], "left_semi").groupBy("doc_id", "digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    rest = own.join(plain, ["doc_id", "digest"], "left_semi")
    return one.select("row.*").unionAll(rest.select("row.*")).unionAll(own.where("doc_id is null").select("row.*"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


QUERIES = {"op2_ngram_jaccard": op2_ngram_jaccard}
ORACLE_SQL = {
    "op2_ngram_jaccard": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS t FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM e x JOIN e y ON x.t = y.t AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1),
k AS (SELECT a, count(*) AS k FROM l GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, component_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links FROM n JOIN c ON c.a = n.doc_id LEFT JOIN k ON k.a = n.doc_id"""
}
