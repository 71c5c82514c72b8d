"""Secret scan: spans of fixed patterns, and of opaque strings that the whole corpus shows to be one owner's. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.vectors import let
from foliant.llm.common import materialise, quoted, read_table, unused

#: kind, pattern, group that holds the value, least length of the value; in the order of the list that ties follow
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),  # as AKIA[A-Z0-9]+ of 20 or more: a shorter run has no longer match inside it
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # as [0-9a-f]+ of 24 or more
)
OPAQUE = r"[A-Za-z0-9+/_=-]{20,}"
WORD = "[A-Z]?[a-z]{2,}"  # as in names, slugs and paths
#: Turns between letters and digits, outside separators, that show a string to be live-looking by themselves; and tenths of its letters that make it a name if they are in words.
TURNS, WORDY = 5, 8
MARK = "[SECRET]"
#: Matches that are folded at a time, code points of a text that are cut at a time, repositories from which on a value is joined by broadcast, and values that may be.
STEPS, BLOCK, WIDE, WIDE_VALUES = 256, 4096, 5000, 100_000


def _spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, ord, kind, end, value>> of the leftmost non-overlapping matches; starts come from the lengths of what lies between them, in runs of STEPS that are then put one after the other."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("match"), values.alias("value"))
    kind_of = "array<struct<start:long,ord:int,kind:string,end:long,value:string>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind_of).alias("out"))

    def add(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["gap"])
        end = start + F.coalesce(F.length(s["match"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), s["value"].alias("value"))
        good = s["match"].isNotNull() & (F.length(s["value"]) >= least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def runs(all_: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / STEPS).cast("int")), lambda i: F.aggregate(F.slice(all_, i * STEPS + 1, F.lit(STEPS)), zero, add))

    def placed(done: Column) -> Column:
        begun = F.aggregate(done, F.array(F.lit(0).cast("long")), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
        move = lambda s, by: F.struct((s["start"] + by).alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value"))
        return F.flatten(F.transform(F.arrays_zip(done.alias("r"), begun.alias("by")), lambda z: F.transform(F.coalesce(z["r"]["out"], F.array().cast(kind_of)), lambda s: move(s, z["by"]))))

    return F.when(F.regexp_like(text, F.lit(pattern)), let(steps, lambda all_: let(runs(all_), placed))).otherwise(zero["out"])


def live_looking(value: Column) -> Column:
    """A string with a digit that either turns often between letters and digits, or has letters of both cases that are mostly not in words; names, slugs and paths do neither."""
    n = lambda pattern: F.regexp_count(value, F.lit(pattern))
    letters, outside = F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.length(F.regexp_replace(F.regexp_replace(value, WORD, ""), "[^A-Za-z]", ""))
    turns = n("[A-Za-z]+") + n("[0-9]+") - n("[A-Za-z0-9]+")
    return value.rlike("[0-9]") & ((turns >= TURNS) | (value.rlike("[a-z]") & value.rlike("[A-Z]") & ((letters - outside) * 10 < letters * WORDY)))


def candidates(docs: DataFrame, *, id_col: str, text_col: str, owner_col: str, repo_col: str) -> DataFrame:
    """doc_id, key, owner, repo, base and opaque (spans with hashed values) of every row. key tells rows of one id with different texts apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"))
    rows = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    for order, (kind, pattern, group, least) in enumerate(KINDS):
        rows = rows.withColumn(kind, _spans(F.col("text"), kind, order, pattern, group, least))
    rows = rows.withColumn("opaque", _spans(F.col("text"), "opaque", len(KINDS), OPAQUE, 0, 20))
    hashed = lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"), F.md5(s["value"].cast("binary")).alias("hash"))
    base = F.concat(*(F.col(k) for k, *_ in KINDS))
    return rows.select("doc_id", "key", "owner", "repo", F.transform(base, hashed).alias("base"), F.transform(F.filter("opaque", lambda o: live_looking(o["value"])), hashed).alias("opaque"))


def spans_apart(found: DataFrame) -> DataFrame:
    """The rows (key, start, ord, end, and others) without opaque spans that overlap another kind's span of their text. A text's spans are sorted once, so that the work grows with them, not with their pairs."""
    own = Window.partitionBy("key").orderBy("start", "ord")
    base = F.col("ord") < len(KINDS)
    before = F.max(F.when(base, F.col("end"))).over(own.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(own.rowsBetween(1, Window.unboundedFollowing))
    marked = found.withColumns({"_before": before, "_after": after})
    return marked.where(base | ((F.coalesce("_before", F.col("start")) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end")))).drop("_before", "_after")


def row_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(" "), F.md5(text.cast("binary"))).cast("binary"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, owners, repos: by how many distinct owners, and repositories of them, each candidate is used. Counted in steps, so that a value that is everywhere is spread by its repositories first."""
    pairs = found.select("hash", "owner", "repo").groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repos"))


def with_ownership(found: DataFrame) -> DataFrame:
    """The rows with owners and repos of their hash. Values in WIDE repositories or more, of which there are at most a WIDE-th of the rows, go along by broadcast where they are few; so no task gets all rows of one of them."""
    counts = materialise(ownership(found), "ownership")
    wide = counts.where(F.col("repos") >= WIDE)
    n = wide.limit(WIDE_VALUES + 1).count()
    if not 0 < n <= WIDE_VALUES:
        return found.join(counts, "hash")
    rest = found.join(F.broadcast(wide.select("hash")), "hash", "left_anti").join(counts.where(F.col("repos") < WIDE), "hash")
    return rest.unionByName(found.join(F.broadcast(wide), "hash"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", most_owners: int = 1, most_repos: int = 3) -> DataFrame:
    """doc_id, key and spans: array<struct<start, ord, kind, end, hash, owners, repos, live>> of every row, by start, then kind.

    Kinds assign, access and hex are always in it. A candidate whose value at most most_owners owners use, in most_repos repositories of theirs at most, is live; a wider used one is an example.
    Opaque strings (20 or more characters of an alphabet of tokens, outside the other spans) are in it only if live and live-looking, see live_looking(): names, slugs and paths are not. Ends are exclusive; places are code points.

    Null texts are empty and have no spans; null ids stay null; null owners or repositories count as one. Repeated rows are returned each. Columns beside the four are ignored. An empty table gives no rows.
    """
    rows = materialise(candidates(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=repo_col), "candidates")
    each = rows.where(F.size("base") + F.size("opaque") > 0).select("key", "owner", "repo", F.explode(F.concat("base", "opaque")).alias("s")).select("key", "owner", "repo", "s.*")
    each = materialise(spans_apart(each), "spans")
    judged = with_ownership(each).drop("owner", "repo").withColumn("live", (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos))
    spans = judged.where("live or kind <> 'opaque'").groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", "ord", "kind", "end", "hash", "owners", "repos", "live"))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.select("doc_id", "key").join(spans, "key", "left").select("doc_id", "key", F.coalesce("spans", none).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", owner_col: str = "source", mark: str = MARK) -> DataFrame:
    """docs with each found span (or run of spans that overlap) replaced by mark, and its length set anew where a text changed. All rows and columns stay."""
    key, cuts, changed = (unused(docs.columns, c) for c in ("span_key", "cuts", "changed"))
    found = scan_secrets(docs, id_col=id_col, text_col=text_col, owner_col=owner_col, repo_col=id_col).where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("spans"))
    text = F.col(quoted(text_col))
    joined = docs.withColumn(key, row_key(F.col(quoted(id_col)), F.coalesce(text.cast("string"), F.lit("")))).join(block_cuts(found).select(F.col("key").alias(key), F.col("cuts").alias(cuts)), key, "left")

    def cut(block: Column, number: Column) -> Column:
        """The block without what lies in its cuts, and with the mark where one begins."""
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
        add = lambda acc, c: F.struct(c["end"].alias("at"), F.concat(acc["out"], F.substring(block, acc["at"] + 1, c["start"] - acc["at"]), F.when(c["first"], mark).otherwise("")).alias("out"))
        return F.aggregate(F.coalesce(F.try_element_at(F.col(cuts), number), F.array().cast("array<struct<start:int,end:int,first:boolean>>")), zero, add, lambda a: F.concat(a["out"], F.substring(block, a["at"] + 1, F.lit(BLOCK))))

    blocks = F.transform(F.sequence(F.lit(0), (F.length(text) / BLOCK).cast("int")), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK)))
    clean = F.when(F.col(cuts).isNull(), text).otherwise(F.array_join(F.transform(blocks, cut), ""))
    out = joined.withColumn(changed, F.col(cuts).isNotNull()).withColumn(text_col, clean)
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col(changed), F.length(text).cast(docs.schema[length_col].dataType)).otherwise(F.col(quoted(length_col))))
    return out.select(*map(quoted, docs.columns))


def block_cuts(found: DataFrame) -> DataFrame:
    """key and cuts (map of a block's number to its start, end and first, in order) of texts with spans: runs of spans that overlap are one, and are dealt to the blocks of BLOCK code points that they lie in; first is set in the block where a run begins."""
    each = found.select("key", F.explode("spans").alias("s")).select("key", "s.start", "s.end")
    own = Window.partitionBy("key").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0)).withColumn("run", F.sum("new").over(own))
    runs = each.groupBy("key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    parts = runs.select("key", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))).alias("block"))
    low = F.col("block") * BLOCK
    part = F.struct(F.greatest(F.lit(0), F.col("start") - low).cast("int").alias("start"), F.least(F.lit(BLOCK), F.col("end") - low).cast("int").alias("end"), (F.col("start") >= low).alias("first"))
    by_block = parts.groupBy("key", F.col("block").cast("int").alias("block")).agg(F.array_sort(F.collect_list(part)).alias("cuts"))
    return by_block.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("block", "cuts"))).alias("cuts"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "opaque")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k, *_ in KINDS), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


QUERIES = {"op5_secrets": op5_secrets}


def _sql() -> str:
    """The same in SQL: starts from the lengths of the pieces between matches."""
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [("assign", assign, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24), ("opaque", OPAQUE, 0, 20)]
    one = lambda o, k, p, g, n: f"""SELECT doc_id, source, {o} AS ord, '{k}' AS kind, st AS s, st + length(m) AS e, v FROM (
  SELECT doc_id, source, m, v, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS st
  FROM (SELECT doc_id, source, ms, pieces, unnest(ms) AS m, unnest(vs) AS v, unnest(range(1, len(ms) + 1)) AS i FROM
    (SELECT doc_id, source, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {g}) AS vs, string_split_regex(t, '{p}') AS pieces FROM d))) WHERE length(v) >= {n}"""  # noqa: E731
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
a AS ({' UNION ALL '.join(one(o, *k) for o, k in enumerate(kinds))}),
b AS (SELECT * FROM a WHERE ord < 3 UNION ALL
  SELECT * FROM a o WHERE ord = 3 AND regexp_matches(v, '[0-9]') AND (len(regexp_extract_all(v, '[A-Za-z]+')) + len(regexp_extract_all(v, '[0-9]+')) - len(regexp_extract_all(v, '[A-Za-z0-9]+')) >= {TURNS} OR regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')
    AND (length(regexp_replace(v, '[^A-Za-z]', '', 'g')) - length(regexp_replace(regexp_replace(v, '{WORD}', '', 'g'), '[^A-Za-z]', '', 'g'))) * 10 < length(regexp_replace(v, '[^A-Za-z]', '', 'g')) * {WORDY}) AND NOT EXISTS (SELECT 1 FROM a x WHERE x.ord < 3 AND x.doc_id = o.doc_id AND x.s < o.e AND o.s < x.e)),
f AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT (source, doc_id)) AS repos FROM b GROUP BY v),
j AS (SELECT b.*, owners <= 1 AND repos <= 3 AS live FROM b JOIN f USING (v)),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, ord) FILTER (ord < 3) AS base, string_agg(concat(kind, ':', s, ':', e), ',' ORDER BY s, ord) AS spans FROM j WHERE live OR ord < 3 GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


ORACLE_SQL = {"op5_secrets": _sql()}
