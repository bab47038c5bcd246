"""Merkle manifest of a dataset: a hash tree for each group of rows, and one over the groups.

A row's leaf is the SHA-256 of its fields, each written as `-` (null) or UTF-8 byte count,
`:` and value; a node is the SHA-256 of its children's digests as hex text, left to right.
Leaves are numbered within their group by a range sort: a row's number is its place in its
partition plus the sizes of the group's earlier partitions, so no group passes through one
task. Then every level is an equijoin of the nodes with themselves on (tree, number), once
for each other slot of a run: the sibling's number is computed (number XOR 1 for runs of two,
else the run's start plus the slot that lies so many slots further, around). Rows of slot zero
emit the parents. A tree is done when one node remains; the groups' roots are the leaves of
the last tree.

Proofs go the other way: a node's path is its siblings, then its parent's path. Each level
joins its nodes with the paths of the level above, so a path is not carried up level by level
for every leaf. Levels and paths are written tables of 32-byte digests.

Defined cases: a null doc_id or source is a value of its own, before all others; very long
texts are hashed whole, in place, and never shuffled; rows that tie in the order are put by
leaf, then as they were first written, so repeated rows have equal leaves and places of their
own; an empty table has no root (None) and no rows; other columns are ignored. DataFrame
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_table, write_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: low bits of monotonically_increasing_id: the row's place in its partition
PLACE_BITS = 33
#: name of the tree over the groups' roots; groups' own names are '' (null) and 's' plus their value
TOP = "top"


def digest(x: Column) -> Column:
    """SHA-256 of a string or binary, as 32 bytes."""
    return F.unhex(F.sha2(x.cast("binary"), 256))


def as_hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def nothing() -> Column:
    return F.lit(b"")


def leaf_of(*fields: Column) -> Column:
    """Leaf digest of a row's fields."""
    text = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]))


def tree_name(group: Column) -> Column:
    g = group.cast("string")
    return F.when(g.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), g))


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves (tree, ...) with idx, the place in the tree by `order`, and n, the tree's leaves; written."""
    placed = leaves.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    placed = write_table(placed.withColumns({"part": F.shiftright("at", PLACE_BITS), "at": F.col("at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))}), "placed")
    runs = placed.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    # a tree has at most one run for each partition
    w = Window.partitionBy("tree")
    before = F.sum("c").over(w.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select(F.col("tree").alias("r_tree"), F.col("part").alias("r_part"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base"), F.sum("c").over(w).alias("n"))
    runs = write_table(runs, "runs")
    out = placed.join(runs.hint("merge"), (F.col("tree") == F.col("r_tree")) & (F.col("part") == F.col("r_part")))
    out = write_table(out.drop("r_tree", "r_part", "part").withColumn("idx", F.col("at") + F.col("base")).drop("at", "base"), "numbered")
    drop_table(placed, runs)
    return out


def sibling(idx: Column, shift: int, arity: int) -> Column:
    """Number of the sibling `shift` slots further in the run, around."""
    if arity == 2:
        return idx.bitwiseXOR(F.lit(1).cast("long"))
    slot = idx % arity
    return idx - slot + (slot + shift) % arity


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (tree, idx, n, h, ...) with left and right: the run's other digests before and after the node's own."""
    d = nodes
    for s in range(1, arity):
        other = nodes.select(F.col("tree").alias(f"t{s}"), F.col("idx").alias(f"i{s}"), F.col("h").alias(f"h{s}"))
        d = d.join(other.hint("merge"), (F.col("tree") == F.col(f"t{s}")) & (sibling(F.col("idx"), s, arity) == F.col(f"i{s}")), "left").drop(f"t{s}", f"i{s}")
    slot = F.col("idx") % arity
    at = []
    for j in range(arity):
        c = F.when(slot == j, nothing())
        for s in range(1, arity):
            c = c.when((slot + s) % arity == j, F.coalesce(F.col(f"h{s}"), nothing()))
        at.append(c)
    left = F.concat(*[F.when(slot > j, at[j]).otherwise(nothing()) for j in range(arity)])
    right = F.concat(*[F.when(slot < j, at[j]).otherwise(nothing()) for j in range(arity)])
    return d.withColumns({"left": left, "right": right}).drop(*[f"h{s}" for s in range(1, arity)])


def parent(left: Column, own: Column, right: Column) -> Column:
    return digest(as_hex(F.concat(left, own, right)))


@dataclass
class Forest:
    """Levels of some trees, from the leaves up: tables (tree, idx, n, h, left, right) of nodes with a parent, and the roots (tree, h)."""

    levels: list[DataFrame]
    roots: DataFrame


def grown(nodes: DataFrame, arity: int) -> Forest:
    """All levels over nodes (tree, idx, n, h, other columns at the leaves only)."""
    levels, roots = [], []
    tall = nodes.agg(F.max("n")).first()[0] or 0
    while tall > 1:
        roots.append(nodes.filter("n = 1").select("tree", "h"))
        level = write_table(with_siblings(nodes.filter("n > 1"), arity), "level")
        levels.append(level)
        up = lambda x: F.floor((x + (arity - 1)) / arity).cast("long")
        nodes = level.filter(F.col("idx") % arity == 0).select("tree", F.floor(F.col("idx") / arity).cast("long").alias("idx"), up(F.col("n")).alias("n"), parent(F.col("left"), F.col("h"), F.col("right")).alias("h"))
        tall = -(-tall // arity)
    roots.append(nodes.filter("n = 1").select("tree", "h"))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return Forest(levels, write_table(out, "roots"))


def step() -> Column:
    return F.array(F.struct("left", "right"))


def descended(forest: Forest, tops: DataFrame, arity: int) -> DataFrame:
    """tree, idx, path, top of the lowest level's parents: siblings from there to the end of `tops` (tree, path, top)."""
    done = []
    tops = tops.withColumn("at", F.lit(0).cast("long"))
    paths = tops.select("tree", F.lit(0).cast("long").alias("idx"), "path", "top")
    for level in reversed(forest.levels[1:]):
        nodes = level.select("tree", "idx", "left", "right", F.floor(F.col("idx") / arity).cast("long").alias("up"))
        above = paths.select(F.col("tree").alias("p_tree"), F.col("idx").alias("p_idx"), "path", "top")
        own = nodes.join(above.hint("merge"), (F.col("tree") == F.col("p_tree")) & (F.col("up") == F.col("p_idx"))).select("tree", "idx", F.concat(step(), "path").alias("path"), "top")
        # trees that end below start here from their root
        paths = write_table(own.unionByName(tops.select("tree", F.col("at").alias("idx"), "path", "top").join(nodes.select("tree").distinct().hint("merge"), "tree", "left_anti")), "paths")
        done.append(paths)
    if len(done) > 1:
        drop_table(*done[:-1])
    return paths


def folded(leaf: Column, path: Column) -> Column:
    """Root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda h, s: parent(s["left"], h, s["right"]))


def siblings_of(path: Column) -> Column:
    return F.aggregate(path, nothing(), lambda b, s: F.concat(b, s["left"], s["right"]))


@dataclass
class Manifest:
    """root (hex, None for an empty table) and leaves: doc_id, tree, leaf, changed (leaf of the row as found later, or null), subroot, path (structs left, right from the leaf's level up)."""

    root: str | None
    leaves: DataFrame


def trees(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", arity: int = 3, changed: Column | None = None) -> tuple[DataFrame, Forest, DataFrame, Forest]:
    """Leaves of docs, the groups' trees, the groups' roots as leaves, and the tree over them."""
    changed = F.lit(None).cast("binary") if changed is None else changed
    leaves = docs.select(F.col(order).alias("doc_id"), tree_name(F.col(group)).alias("tree"), leaf_of(*[F.col(f) for f in fields]).alias("h"), changed.alias("changed"), F.monotonically_increasing_id().alias("no"))
    leaves = write_table(leaves, "leaves")
    nodes = numbered(leaves, ["doc_id", "h", "no"]).drop("no")
    drop_table(leaves)
    below = grown(nodes, arity)
    tops = numbered(below.roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), "h"), ["of"])
    return nodes, below, tops, grown(tops, arity)


def root_of(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", arity: int = 3) -> str | None:
    """The root alone, as hex."""
    root = trees(docs, fields, group, order, arity)[3].roots.first()
    return root and root["h"].hex()


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", arity: int = 3, later: dict[str, Column] | None = None) -> Manifest:
    """Tree of docs. `later`: for fields that may have changed since, their value then; null where unchanged."""
    later = later or {}
    changed = None
    if later:
        some = F.lit(False)
        for c in later.values():
            some = some | c.isNotNull()
        changed = F.when(some, leaf_of(*[F.coalesce(later[f], F.col(f)) if f in later else F.col(f) for f in fields]))
    nodes, below, tops, above = trees(docs, fields, group, order, arity, changed)
    root = above.roots.first()
    if root is None:
        return Manifest(None, nodes.select("doc_id", "tree", F.col("h").alias("leaf"), "changed", F.col("h").alias("subroot"), F.array().cast("array<struct<left:binary,right:binary>>").alias("path")))
    empty = F.array().cast("array<struct<left:binary,right:binary>>")
    # paths of the groups' roots to the one root
    if above.levels:
        ends = descended(above, above.roots.select("tree", empty.alias("path"), F.lit(None).cast("binary").alias("top")), arity)
        first = above.levels[0].select("of", "h", "left", "right", F.floor(F.col("idx") / arity).cast("long").alias("up"))
        ends = first.join(ends.select(F.col("idx").alias("p_idx"), "path").hint("merge"), F.col("up") == F.col("p_idx")).select(F.col("of").alias("tree"), F.concat(step(), "path").alias("path"), F.col("h").alias("top"))
    else:
        ends = tops.select(F.col("of").alias("tree"), empty.alias("path"), F.col("h").alias("top"))
    ends = write_table(ends, "ends")
    drop_table(tops, above.roots, below.roots, *above.levels)
    lone = nodes.filter("n = 1").join(ends.hint("merge"), "tree").select("doc_id", "tree", F.col("h").alias("leaf"), "changed", F.col("top").alias("subroot"), "path")
    if not below.levels:
        return Manifest(root["h"].hex(), lone)
    paths = descended(below, ends, arity)
    drop_table(*below.levels[1:])
    paths = paths.select(F.col("tree").alias("p_tree"), F.col("idx").alias("p_idx"), "path", "top")
    rows = below.levels[0].withColumn("up", F.floor(F.col("idx") / arity).cast("long"))
    rows = rows.join(paths.hint("merge"), (F.col("tree") == F.col("p_tree")) & (F.col("up") == F.col("p_idx")))
    rows = rows.select("doc_id", "tree", F.col("h").alias("leaf"), "changed", F.col("top").alias("subroot"), F.concat(step(), "path").alias("path"))
    return Manifest(root["h"].hex(), rows.unionByName(lone))


def verified(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf; digests as hex."""
    root = F.lit(m.root).cast("string")
    d = m.leaves.select("doc_id", as_hex(F.col("leaf")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2(as_hex(siblings_of(F.col("path"))).cast("binary"), 256).alias("proof_sha256"), as_hex(folded(F.coalesce("changed", "leaf"), F.col("path"))).alias("folded_root"))
    return d.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Contract query: manifest of all documents, runs of three, checked against tampered ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return verified(manifest(docs, later={"text": tampered}))


#: crc32's parity is a sum over the digits' bits, so list_reduce over bytes and bits does
ORACLE_OP11 = r"""
WITH RECURSIVE
d AS (
  SELECT doc_id, source, lang, n_chars, text, CASE WHEN list_reduce(
      list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
    ) % 2 = 1 THEN replace(text, chr(10), '') END AS tampered
  FROM documents),
p AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM d),
l AS (
  SELECT doc_id, coalesce('s' || source, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(coalesce(tampered, text)) || ':' || coalesce(tampered, text), '-')) AS later
  FROM p),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM l),
up AS (
  SELECT 0 AS lvl, g, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lvl + 1, g, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY lvl, g, idx // 3, n),
subs AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, n, h FROM subs
  UNION ALL
  SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 3, n),
nodes AS (SELECT lvl, g, idx, n, h FROM up UNION ALL SELECT lvl, 'top', idx, n, h FROM top),
runs AS (SELECT lvl, g, idx // 3 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
walk AS (
  SELECT l.doc_id, l.leaf AS own, 0 AS lvl, l.g, l.idx, l.n, l.later AS acc, '' AS proof FROM leaves l
  UNION ALL
  SELECT w.doc_id, w.own, w.lvl + 1, w.g, w.idx // 3, (w.n + 2) // 3,
         sha256(array_to_string(r.hs[1 : w.idx % 3], '') || w.acc || array_to_string(r.hs[w.idx % 3 + 2 :], '')),
         w.proof || array_to_string(r.hs[1 : w.idx % 3], '') || array_to_string(r.hs[w.idx % 3 + 2 :], '')
  FROM walk w JOIN runs r ON r.lvl = w.lvl AND r.g = w.g AND r.run = w.idx // 3 WHERE w.n > 1),
mid AS (SELECT w.doc_id, w.own, w.acc, w.proof, s.h AS subroot, s.idx, s.n FROM walk w JOIN subs s ON s.g = w.g WHERE w.n = 1),
climb AS (
  SELECT doc_id, own, subroot, 0 AS lvl, idx, n, acc, proof FROM mid
  UNION ALL
  SELECT w.doc_id, w.own, w.subroot, w.lvl + 1, w.idx // 3, (w.n + 2) // 3,
         sha256(array_to_string(r.hs[1 : w.idx % 3], '') || w.acc || array_to_string(r.hs[w.idx % 3 + 2 :], '')),
         w.proof || array_to_string(r.hs[1 : w.idx % 3], '') || array_to_string(r.hs[w.idx % 3 + 2 :], '')
  FROM climb w JOIN runs r ON r.lvl = w.lvl AND r.g = 'top' AND r.run = w.idx // 3 WHERE w.n > 1)
SELECT c.doc_id, c.own AS leaf, c.subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.acc AS folded_root, c.acc = t.h AS verified
FROM climb c, (SELECT h FROM top WHERE n = 1) t WHERE c.n = 1
"""
