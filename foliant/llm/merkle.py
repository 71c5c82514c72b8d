"""Merkle manifest of a table: a tree of hashes for each group of rows, a tree of their roots, and proofs; nodes lie in Parquet by level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import quoted, read_table
from foliant.sources.scratch import materialise, scratch_path

#: Levels that one pass over sorted nodes makes: with runs of 2, a block of 256 consecutive nodes is read as one row.
LEVELS = 8


def digest(c: Column) -> Column:
    """Lowercase hex sha256 of a text's UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: list[Column]) -> Column:
    return digest(F.concat(*map(field, columns)))


def placed_leaves(leaves: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """leaves with at, their place in their tree from 0, and total, the tree's leaves.

    Rows are sorted in ranges, whatever tree they are of, and written once; a range's first places come from counts, so that no task holds a tree.
    Rows that are equal in all of order are told apart by their place in the written table.
    """
    numbered = materialise(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    runs = materialise(numbered.repartitionByRange(tree, *order, "_row").sortWithinPartitions(tree, *order, "_row").drop("_row").withColumn("_at", F.monotonically_increasing_id()), "leaf-runs")
    runs = runs.withColumn("_run", F.shiftright("_at", 33))
    counts = runs.groupBy("_run", tree).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(tree).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_run", tree, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(tree)).alias("total"))
    return runs.join(counts, ["_run", tree]).withColumn("at", F.col("_at") + F.col("_shift")).drop("_run", "_at", "_shift")


@dataclass(frozen=True)
class NodeStore:
    """Nodes by level: passes[i] holds level (the partition, LEVELS * i and on), tree, block, height, total (the tree's nodes at the pass's first level) and hashes, a block's nodes of the level in order. roots: tree, root, and ends, the pass that ends in the root."""

    passes: list[DataFrame]
    roots: DataFrame
    arity: int

    @property
    def span(self) -> int:
        return self.arity**LEVELS


def _parents(hashes: Column, arity: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(hashes) / F.lit(arity)).cast("int") - 1), lambda j: digest(F.array_join(F.slice(hashes, j * arity + 1, F.lit(arity)), "")))


def build_store(leaves: DataFrame, arity: int = 2) -> NodeStore:
    """The trees over leaves (tree, at, total, hash).

    A pass reads the last level written, in blocks of arity ** LEVELS consecutive nodes; within a block each level is made from the one before, and all of them go sorted to Parquet
    partitioned by level. The top of a block is a node of the next pass. A block is the most that one row holds; passes number log(nodes) / log(block).
    """
    spark, nodes, passes = leaves.sparkSession, leaves.select("tree", "at", "total", "hash"), []
    most = nodes.agg(F.max("total")).head()[0] or 0
    span, single = arity**LEVELS, F.col("total") == 1
    roots = nodes.where(single).select("tree", F.col("hash").alias("root"), F.lit(0).alias("ends"))
    while most > 1:
        height = F.size(F.filter(F.array(*(F.lit(arity**i) for i in range(LEVELS))), lambda n: F.col("total") > n))  # levels that the tree still needs, LEVELS at most
        blocks = nodes.where(~single).groupBy("tree", F.floor(F.col("at") / span).cast("long").alias("block"), "total").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]).alias("hashes"))
        made = F.aggregate(F.filter(F.array(*(F.lit(i) for i in range(1, LEVELS))), lambda i: i < F.col("height")), F.array(F.col("hashes")), lambda levels, _: F.concat(levels, F.array(_parents(F.element_at(levels, -1), arity))))
        rows = blocks.withColumn("height", height).select("tree", "block", "height", "total", F.posexplode(made).alias("_level", "hashes"))
        rows = rows.select("tree", "block", "height", "total", "hashes", (F.col("_level") + LEVELS * len(passes)).cast("int").alias("level"))
        path = scratch_path(spark, "nodes")
        rows.repartitionByRange("level", "tree", "block").sortWithinPartitions("level", "tree", "block").write.partitionBy("level").option("compression", "zstd").parquet(path)
        passes.append(spark.read.schema(rows.schema).parquet(path))
        last = passes[-1].where(F.col("level") == F.col("height") - 1 + LEVELS * (len(passes) - 1))
        nodes = last.select("tree", F.col("block").alias("at"), F.ceil(F.col("total") / span).cast("long").alias("total"), F.get(_parents(F.col("hashes"), arity), F.lit(0)).alias("hash"))
        roots = roots.unionByName(nodes.where(single).select("tree", F.col("hash").alias("root"), F.lit(len(passes) - 1).alias("ends")))
        most = -(-most // span)
    return NodeStore(passes, roots, arity)


def proofs(store: NodeStore, leaves: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """leaves (tree, at, and others) with path and root: the path has a struct for each level, from the leaf up, of the joined hashes left and right of the own node in its run.

    above: tree, path and root that take the place of an empty path and the tree's own root at its root. Passes are read from the top down; blocks of nodes meet the leaves or nodes below them by (tree, block), in a merge join.
    """
    arity, span = store.arity, store.span
    ends = store.roots.withColumn("path", F.array().cast("array<struct<l:string,r:string>>")) if above is None else store.roots.select("tree", "ends").join(above, "tree")
    kept = [c for c in leaves.columns if c not in ("tree", "at")]
    upper: DataFrame | None = None
    for i in reversed(range(max(1, len(store.passes)))):
        if i == 0:
            rows = leaves.select("tree", "at", F.struct(*kept).alias("own"))
        else:
            rows = store.passes[i].where(F.col("level") == LEVELS * i).select("tree", F.posexplode("hashes").alias("p", "own"), "block").select("tree", (F.col("block") * span + F.col("p")).alias("at"), "own")
        rows = rows.groupBy("tree", F.floor(F.col("at") / span).cast("long").alias("block")).agg(F.collect_list(F.struct("at", "own")).alias("rows"))
        if i < len(store.passes):
            levels = store.passes[i].groupBy("tree", "block").agg(F.array_sort(F.collect_list(F.struct("level", "hashes"))).alias("levels"))
        else:
            levels = rows.select("tree", "block").limit(0).withColumn("levels", F.lit(None).cast("array<struct<level:int,hashes:array<string>>>"))
        tops = ends.where(F.col("ends") == i).select("tree", F.lit(0).cast("long").alias("block"), "path", "root")
        tops = tops if upper is None else upper.unionByName(tops)
        joined = rows.join(levels, ["tree", "block"], "left").join(tops, ["tree", "block"])

        def steps(at: Column) -> Column:
            def step(x: Column, level: Column) -> Column:
                place = F.floor(at / F.pow(F.lit(float(arity)), level)).cast("int")
                own = F.pmod(place, F.lit(arity))
                return F.struct(F.array_join(F.slice(x["hashes"], place - own + 1, own), "").alias("l"), F.array_join(F.slice(x["hashes"], place + 2, arity - 1 - own), "").alias("r"))

            return F.transform(F.coalesce("levels", F.array().cast("array<struct<level:int,hashes:array<string>>>")), step)

        found = F.transform("rows", lambda x: F.struct(x["at"].alias("at"), x["own"].alias("own"), F.concat(steps(F.pmod(x["at"], F.lit(span))), F.col("path")).alias("path")))
        out = joined.select("tree", "root", F.inline(found))
        upper = out.select("tree", F.col("at").alias("block"), "path", "root")
    return out.select("tree", "at", *(F.col("own")[c].alias(c) for c in kept), "path", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["l"], h, s["r"])))


def proof_text(path: Column) -> Column:
    """The siblings' hashes, level by level, left to right."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.array(s["l"], s["r"]))), "")


def merkle_manifest(rows: DataFrame, columns: list[str], group: str, order: str, *, arity: int = 2, other: dict[str, Column] | None = None) -> DataFrame:
    """order's column, leaf, subroot, root, path and folded_root of each row; the last from a leaf in which the columns of other have other values, and the path of the real ones.

    A leaf is the sha256 of the columns as fields; leaves of a group ascend by order (nulls first; ties by leaf), every arity of them become one, until one is left, the group's subroot.
    Subroots by group (null first, bytewise) give the root in the same way. Null values are fields of their own, also in group and order; repeated rows are leaves each; one row has an empty path; an empty table gives no rows;
    columns that aren't named don't count. Texts are hashed where they are read; what is sorted and joined after that is a few hundred bytes a row.
    """
    own, changed = [F.col(quoted(c)) for c in columns], [(other or {}).get(c, F.col(quoted(c))) for c in columns]
    tree = F.coalesce(F.concat(F.lit("="), F.col(quoted(group)).cast("string")), F.lit("-"))  # "-" comes before "="
    leaves = rows.select(tree.alias("tree"), F.col(quoted(order)).alias("_id"), leaf_of(own).alias("hash"), leaf_of(changed).alias("_changed"))
    leaves = materialise(placed_leaves(leaves, "tree", ["_id", "hash"]), "placed-leaves")
    store = build_store(leaves, arity)
    tops = store.roots.select(F.lit("").alias("tree"), F.col("tree").alias("_group"), F.col("root").alias("hash"))
    tops = materialise(placed_leaves(tops, "tree", ["_group"]), "placed-roots")
    above = proofs(build_store(tops, arity), tops.select("tree", "at", "_group", F.col("hash").alias("subroot")))
    # the subroot rides with the paths: it is set where a tree ends, and so needs no join by group
    found = proofs(store, leaves.select("tree", "at", "_id", "hash", "_changed"), above.select(F.col("_group").alias("tree"), F.struct("root", "subroot").alias("root"), "path"))
    out = found.select(F.col("_id").alias(order), F.col("hash").alias("leaf"), F.col("root")["subroot"].alias("subroot"), F.col("root")["root"].alias("root"), "path", "_changed")
    return out.withColumn("folded_root", folded(F.col("_changed"), F.col("path"))).drop("_changed")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    tampered = F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    found = merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", other={"n_chars": tampered})
    return found.select("doc_id", "leaf", "subroot", "root", digest(proof_text(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op13_merkle_manifest": op13_merkle_manifest}

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE concat(strlen(CAST({0} AS VARCHAR)), ':', CAST({0} AS VARCHAR)) END"


def _leaf(n_chars: str) -> str:
    return "sha256(concat(" + ", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + "))"


def _tree(name: str, leaves: str) -> str:
    """Nodes of all levels l over leaves (k, i, h, n), and the path of each leaf: its siblings by level."""
    return f"""{name} AS (SELECT k, 0 AS l, i, h, n FROM {leaves} UNION ALL SELECT k, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY k, l, i // 2),
{name}_path AS (SELECT f.k, f.i, v.l, (f.i >> v.l) % 2 = 1 AS is_left, coalesce(t.h, '') AS h FROM {leaves} f JOIN (SELECT DISTINCT k, l FROM {name} WHERE n > 1) v ON f.k = v.k LEFT JOIN {name} t ON t.k = v.k AND t.l = v.l AND t.i = xor(f.i >> v.l, 1))"""


ORACLE_SQL = {
    "op13_merkle_manifest": f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
docs AS (SELECT documents.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, tab[xor(a, b) % 256 + 1])), 4294967295) AS id_crc FROM documents, crc),
rows0 AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE concat('=', lang) END AS k, {_leaf("n_chars")} AS h, {_leaf("CASE WHEN id_crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS changed FROM docs),
leaves AS (SELECT doc_id, k, h, changed, row_number() OVER (PARTITION BY k ORDER BY doc_id, h) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM rows0),
{_tree("nodes", "leaves")},
subroots AS (SELECT k AS g, '' AS k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_tree("tops", "subroots")},
path AS (SELECT k, i, l, is_left, h FROM nodes_path UNION ALL SELECT f.k, f.i, 1000 + p.l, p.is_left, p.h FROM leaves f JOIN subroots s ON f.k = s.g JOIN tops_path p ON p.i = s.i),
paths AS (SELECT k, i, list({{'before': is_left, 'h': h}} ORDER BY l) AS p FROM path GROUP BY k, i),
folds AS (SELECT k, i, changed AS h, p, 1 AS step FROM leaves LEFT JOIN paths USING (k, i) UNION ALL SELECT k, i, sha256(CASE WHEN p[step].before THEN concat(p[step].h, h) ELSE concat(h, p[step].h) END), p, step + 1 FROM folds WHERE step <= len(p))
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(coalesce(list_reduce(list_prepend('', list_transform(f.p, lambda x: x.h)), lambda a, b: concat(a, b)), '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM leaves l JOIN subroots s ON l.k = s.g JOIN tops r ON r.n = 1 JOIN folds f ON f.k = l.k AND f.i = l.i AND f.step = coalesce(len(f.p), 0) + 1""",
}
