"""A Merkle manifest of a dataset: digests stored at every few levels, proofs recomputed from them.

Every row is a leaf, the leaves of a group form a binary tree, and the roots of all groups, by name,
form one more tree, whose root stands for the dataset. A run of two nodes becomes the digest of both,
a lone last node the digest of itself. Of each tree only the levels 0, EVERY, 2 EVERY, ... and the root
are stored. A proof needs nodes of all levels: extraction takes the stored nodes of each aligned
subtree (2^EVERY neighbours), regenerates the levels between them and the subtree's top, emits the
siblings that lie on each path, and drops the rest. So the manifest is the leaves plus 1/2^EVERY of
them, and a proof of few rows regenerates only the subtrees that hold them.

Places in a tree come from prefix sums over sorted ranges, so a group of any size is split; subtrees
are bounded by 2^EVERY nodes. Everything runs on built-in functions.

Defined results: null columns enter a leaf as `-`; a null group is a tree of its own and comes first; null
keys come first in their tree; rows of one key stand in the order of their leaves, and repeated rows are
leaves of their own; a lone leaf is its tree's root, and a lone tree's root the root; an empty or very long text
is hashed whole; an empty table gives no rows and no root; other columns, whatever their names, are ignored
unless asked for in `keep`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithara.session import written

#: Levels from one stored level to the next; a subtree has 2^EVERY nodes at most.
EVERY = 8


def sha256(*texts: Column) -> Column:
    """Lower-case hex digest of the texts after each other."""
    return F.sha2(F.concat(*texts) if len(texts) > 1 else texts[0], 256)


def field(value: Column) -> Column:
    """`-` for null, else the value's bytes in UTF-8, counted and written out."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    return sha256(*map(field, columns))


@dataclass
class Forest:
    """Trees by name: stored[s] has the nodes of level s * every of all trees that reach so far; roots, one of each tree.

    All have _tree, _idx (place, from 0), _size (nodes of the tree at this level) and digest; level 0 also what was kept.
    """

    stored: list[DataFrame]
    roots: DataFrame
    every: int


@dataclass
class Manifest:
    groups: Forest
    top: Forest


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with _idx and _size, by order within _tree."""
    rows = rows.repartitionByRange("_tree", *order).sortWithinPartitions("_tree", *order)
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    upto = Window.partitionBy("_tree").orderBy("_part")
    spans = rows.groupBy("_tree", part.alias("_part")).agg(F.min("_at").alias("_low"), F.count("*").alias("_n"))
    spans = spans.withColumns({"_base": F.sum("_n").over(upto) - F.col("_n"), "_size": F.sum("_n").over(Window.partitionBy("_tree"))})
    spans = written(spans.select("_tree", "_part", (F.col("_low") - F.col("_base")).alias("_shift"), "_size"), "spans")
    rows = rows.withColumn("_part", part).join(spans, ["_tree", "_part"])
    return rows.withColumn("_idx", F.col("_at") - F.col("_shift")).drop("_part", "_at", "_shift", *order)


def _subtrees(nodes: DataFrame, every: int, *more: Column) -> DataFrame:
    """One row for each aligned subtree: its stored nodes in order, all its levels, its height."""
    kept = [c for c in nodes.columns if c not in ("_tree", "_size")]
    of = nodes.groupBy("_tree", F.shiftright("_idx", every).alias("_up")).agg(F.max("_size").alias("_size"), F.array_sort(F.collect_list(F.struct("_idx", *[c for c in kept if c != "_idx"]))).alias("_nodes"), *more)
    size = F.col("_size")
    height = F.when(size > 1, F.least(F.lit(every), F.length(F.bin(size - 1)))).otherwise(F.lit(0))

    def parents(level: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
        return F.transform(pairs, lambda i: sha256(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))))

    steps = F.slice(F.array(*[F.lit(j) for j in range(every)]), F.lit(1), F.col("_height"))
    levels = F.aggregate(steps, F.array(F.transform("_nodes", lambda x: x["digest"])), lambda acc, _: F.concat(acc, F.array(parents(F.element_at(acc, -1)))))
    return of.withColumn("_height", height).withColumn("_levels", levels)


def _forest(nodes: DataFrame, every: int) -> Forest:
    """Store each every-th level of the trees over nodes (_tree, _idx, _size, digest)."""
    stored, roots = [nodes], []
    most = nodes.agg(F.max("_size")).first()[0] or 1
    while True:
        up = _subtrees(stored[-1].select("_tree", "_idx", "_size", "digest"), every)
        size = F.ceil(F.col("_size") / (1 << every))
        tops = written(up.select("_tree", F.col("_up").alias("_idx"), size.alias("_size"), F.get(F.element_at("_levels", -1), F.lit(0)).alias("digest")), "level")
        roots.append(tops.filter("_size = 1").select("_tree", "digest"))
        most = -(-most // (1 << every))
        if most == 1:
            break
        stored.append(tops.filter("_size > 1"))
    out = roots[0]
    for r in roots[1:]:
        out = out.unionByName(r)
    return Forest(stored, out, every)


def build(docs: DataFrame, columns: Sequence[str], group: str = "lang", key: str = "doc_id", keep: dict[str, Column] | None = None, every: int = EVERY) -> Manifest:
    """The manifest of docs: a tree for each value of group, leaves by key; keep: columns to store with the leaves."""
    keep = keep or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("_tree"), F.col(key).alias("_key"), leaf(*map(F.col, columns)).alias("digest"), *[c.alias(n) for n, c in keep.items()])
    rows = written(rows.withColumn("_leaf", F.col("digest")), "leaves")
    groups = _forest(_ranked(rows, ["_key", "_leaf"]), every)
    roots = groups.roots.select(F.lit("").alias("_tree"), F.col("_tree").alias("_name"), "digest", F.col("_tree").alias("_of"))
    return Manifest(groups, _forest(_ranked(roots, ["_name"]), every))


def _paths(forest: Forest, level: int, wanted: Column | None = None) -> DataFrame:
    """The stored nodes of a level with _path: from the node to its tree's root, for each level whether the sibling is on the left, and the sibling (null: none)."""
    nodes, every = forest.stored[level], forest.every
    trees = _subtrees(nodes, every, *([] if wanted is None else [F.bool_or(wanted).alias("_wanted")]))
    trees = trees if wanted is None else trees.filter("_wanted")
    none = F.array().cast("array<struct<left:boolean,digest:string>>")
    if level + 1 < len(forest.stored):
        above = _paths(forest, level + 1).select("_tree", F.col("_idx").alias("_up"), F.col("_path").alias("_rest"))
        trees = trees.join(above, ["_tree", "_up"], "left").withColumn("_rest", F.coalesce("_rest", none))
    else:
        trees = trees.withColumn("_rest", none)
    steps = F.slice(F.array(*[F.lit(j) for j in range(every)]), F.lit(1), F.col("_height"))

    def siblings(node: Column) -> Column:
        def at(j: Column) -> Column:
            place = F.call_function("shiftright", node["_idx"] % (1 << every), j).cast("int")
            return F.struct((place % 2 == 1).alias("left"), F.get(F.get(F.col("_levels"), j), place.bitwiseXOR(F.lit(1))).alias("digest"))

        return F.concat(F.transform(steps, at), F.col("_rest"))

    kept = [c for c in nodes.columns if c not in ("_tree", "_size")]
    each = F.transform("_nodes", lambda x: F.struct(*[x[c].alias(c) for c in kept], siblings(x).alias("_path")))
    out = trees.select("_tree", F.inline(each))
    return out if wanted is None else out.filter(wanted)


def proofs(m: Manifest, wanted: Column | None = None) -> DataFrame:
    """The leaves (all, or those of a condition on what was kept) with leaf, merkle_path, subroot and root.

    merkle_path leads from the leaf to the root: for each level whether the sibling is on the left, and the sibling (null: the node has none).
    """
    root = m.top.roots.first()
    tops = _paths(m.top, 0).select(F.col("_of").alias("_tree"), F.col("digest").alias("subroot"), F.col("_path").alias("_top"), F.lit(root and root["digest"]).alias("root"))
    out = _paths(m.groups, 0, wanted).join(written(tops, "tops"), "_tree")
    kept = [c for c in m.groups.stored[0].columns if c not in ("_tree", "_size", "_idx", "digest")]
    return out.select(*kept, F.col("digest").alias("leaf"), F.concat("_path", "_top").alias("merkle_path"), "subroot", "root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, s: sha256(F.when(s["left"], F.coalesce(s["digest"], F.lit(""))).otherwise(F.lit("")), node, F.when(~s["left"], F.coalesce(s["digest"], F.lit(""))).otherwise(F.lit(""))))


def path_digest(path: Column) -> Column:
    """Digest of all siblings of a path, from the leaf up."""
    return sha256(F.array_join(F.transform(path, lambda s: s["digest"]), ""))
