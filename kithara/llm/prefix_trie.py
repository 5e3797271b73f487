"""A prefix trie of conversations, by digests of blocks of turns.

A conversation is cut into blocks of BLOCK turns, and the key of a block is the digest of the key before it
and of its turns, so conversations with equal beginnings have equal keys. They are grouped by these keys
first. Where all conversations that pass a block's start have the same block next, the turns inside it have
the same members and need no grouping. Only blocks where siblings diverge (several different blocks follow
one key) are refined: the distinct blocks, with their counts, are opened turn by turn. Most of a corpus
is tails that a single conversation has, and these are never opened.

Nodes carry sums over their members, so subtrees need no walk over the levels. The smallest member of a
node owns it; a conversation owns the end of its path, from some depth on. Of a subtree, the bytes of all
distinct nodes are the bytes that its members own, so what sharing saves (members - 1 times the bytes of
each node's last turn) and how many childless nodes there are follow from sums over members.

Digests only (SHA-256) are grouped, by partial sums, so a beginning that very many conversations share
is split; the ids of conversations that end at one node are joined in pieces, and one task only hashes
the pieces after each other. A conversation's turn digests (not its texts) are one row.

Defined results: turns come in order of `turn` (null first), turns of one number by their digests; null
roles and texts are empty; rows without a conversation id belong to none and are left out; repeated rows
are turns of their own; a conversation without turns ends at the root; an empty table has no nodes; an empty
or very long text is a text like any other; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithara.session import written

#: Turns of a block.
BLOCK = 4
#: Ids that a piece of a node's list of ends holds, at most 2^PIECE.
PIECE = 12
ROOT = hashlib.sha256(b"").digest()


def turns(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id and turns, in order: the digest of role and text and the bytes of the text."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    one = F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(text_).cast("long").alias("bytes"))
    got = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return got.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))))


def blocks(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block of each conversation: its key, the key before it, its turns' digests, their bytes and those before it; last says whether the conversation ends there. One without turns has one row, with the root's key and no parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for conv, digests, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                total, before, key = sum(sizes), 0, ROOT
                if not digests:
                    out.append((conv, ROOT, None, 0, b"", [], 0, 0, True))
                for i in range(0, len(digests), block):
                    own = b"".join(digests[i : i + block])
                    parent, key = key, hashlib.sha256(key + own).digest()
                    out.append((conv, key, parent, i, own, sizes[i : i + block], before, total, i + block >= len(digests)))
                    before += sum(sizes[i : i + block])
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    schema = pa.schema([("conv_id", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("digests", pa.binary()), ("sizes", pa.list_(pa.int64())), ("before", pa.int64()), ("total", pa.int64()), ("last", pa.bool_())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    flat = convs.select(F.col("conv_id").cast("long"), F.transform("turns", lambda t: t["digest"]).alias("digests"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    return flat.mapInArrow(run, "conv_id long, key binary, parent binary, depth long, digests binary, sizes array<long>, before long, total long, last boolean")


def distinct_blocks(rows: DataFrame) -> DataFrame:
    """Each different block once, with its smallest member, its members, their bytes, and whether siblings diverge in it."""
    own = ("parent", "depth", "digests", "sizes", "before")
    first = [F.first(c).alias(c) for c in own]  # one key, one path
    once = written(rows.filter(F.col("parent").isNotNull()).groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.sum("total").alias("total"), *first), "blocks_once")
    deep = once.filter("depth > 0")
    several = deep.groupBy("parent").agg(F.count("*").alias("_ways")).filter("_ways > 1").select("parent", F.lit(True).alias("diverges"))
    deep = deep.join(several, "parent", "left").withColumn("diverges", F.coalesce("diverges", F.lit(False)))
    return once.filter("depth = 0").withColumn("diverges", F.lit(True)).unionByName(deep)


def pieces(once: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Runs of nodes with the same members: blocks in which no siblings diverge, and the single turns of others.

    first is the depth of the first node, key that of the last one, parent the key above the first; sums are those over members.
    """
    same = [F.col(c) for c in ("key", "parent")] + [(F.col("depth") + 1).alias("first"), F.col("sizes"), F.col("before")]
    whole = once.filter(~F.col("diverges")).select(*same, *[c.alias(n) for n, c in sums.items() if n != "conv_id"], F.col("conv_id"))
    width = F.size("sizes")

    def upto(i: Column) -> Column:
        cut = F.concat(F.col("parent"), F.substring(F.col("digests"), F.lit(1), 32 * i))
        return F.when(i == 0, F.col("parent")).when(i == width, F.col("key")).otherwise(F.unhex(F.sha2(cut, 256)))

    def node(i: Column) -> Column:
        before = F.aggregate(F.slice("sizes", F.lit(1), i - 1), F.col("before"), lambda a, x: a + x)
        return F.struct(upto(i).alias("key"), upto(i - 1).alias("parent"), (F.col("depth") + i).alias("first"), F.slice("sizes", i, F.lit(1)).alias("sizes"), before.alias("before"))

    opened = once.filter("diverges").select("conv_id", *[c.alias(n) for n, c in sums.items() if n != "conv_id"], F.inline(F.transform(F.sequence(F.lit(1), width), node)))
    merged = {n: F.min(n) if n in ("conv_id", "entry") else F.sum(n) for n in sums}
    opened = opened.groupBy("key").agg(*[F.first(c).alias(c) for c in ("parent", "first", "sizes", "before")], *[c.alias(n) for n, c in merged.items()])
    return whole.unionByName(opened)


def _joined_ids(rows: DataFrame) -> DataFrame:
    """key and ends_sha256: the digest of the ids of conversations that end at the key, ascending, comma-joined."""
    ends = rows.filter("last").select("key", "conv_id").repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    ends = ends.withColumn("_piece", F.shiftright(F.monotonically_increasing_id(), PIECE))
    parts = ends.groupBy("key", "_piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            keys, found = [], []
            for k, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    keys.append(key)
                    found.append(state.hexdigest())
                key, state = k, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return parts.repartition("key").sortWithinPartitions("key", "_piece").select("key", "ids").mapInArrow(run, "key binary, ends_sha256 string")


def trie(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """All nodes of the trie over convs (conv_id, one row each, and turns: digests and bytes in order).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    rows = written(blocks(convs, block), "blocks")
    once = written(distinct_blocks(rows), "distinct_blocks")
    found = written(pieces(once, {"conv_id": F.col("conv_id"), "n": F.col("n")}), "pieces")
    children = written(found.groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "key"), "children")
    found = found.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))

    # What a conversation owns: from the piece of least depth on; the last node it owns may be childless.
    owned = found.groupBy("conv_id").agg(F.min("before").alias("entry"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    per_conv = rows.select("conv_id", "key", "parent", "total").join(owned, "conv_id", "left")
    owns = F.coalesce(F.col("total") - F.col("entry"), F.lit(0))
    per_conv = written(per_conv.select("conv_id", "key", "parent", "total", owns.alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "entry"), "owned")
    # The smallest member owns the node, so of all members that own any of the path it has the least entry.
    sums = per_conv.filter(F.col("parent").isNotNull()).groupBy("key").agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("leaf"), F.min("entry").alias("entry"))
    weights = {n: F.col(n) for n in ("conv_id", "n", "total", "owned", "leaf", "entry")}
    nodes = pieces(once.join(sums, "key"), weights).join(children, "key", "left").join(_joined_ids(rows), "key", "left")

    ends = written(_joined_ids(rows), "ends")
    weights = {n: F.col(n) for n in ("conv_id", "n", "total", "owned", "leaf", "entry")}
    nodes = pieces(once.join(sums, "key"), weights).join(children, "key", "left").join(ends, "key", "left")
    nodes = written(nodes.drop("key"), "nodes")

    each = per_conv.filter(F.col("parent").isNull() | (F.col("parent") == ROOT))  # one row a conversation
    top = each.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum(F.col("total") - F.col("owned")).alias("saved_tokens"))
    below, ended = (t.filter(F.col("key") == ROOT).first() for t in (children, ends))
    least = top.first()["conv_id"]
    none = F.lit(hashlib.sha256().hexdigest())
    root = top.filter("n_convs > 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.lit(below["n_children"] if below else 0).cast("long").alias("n_children"), "n_leaves" if below else F.lit(1).cast("long").alias("n_leaves"),
        "saved_tokens", F.lit(ended["ends_sha256"]).alias("ends_sha256") if ended else none.alias("ends_sha256"),
    )

    parents = found.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    first = nodes.filter("first = 1").drop("parent").withColumn("above", F.lit(least).cast("long"))
    nodes = first.unionByName(nodes.filter("first > 1").join(parents, "parent").drop("parent"))
    width = F.size("sizes")

    def node(size: Column, i: Column) -> Column:
        end, before = i == width - 1, F.aggregate(F.slice("sizes", F.lit(1), i), F.col("before"), lambda a, x: a + x)
        return F.struct(
            F.col("conv_id"), (F.col("first") + i).alias("depth"), F.when(i == 0, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
            F.when(end, F.coalesce("n_children", F.lit(0))).otherwise(1).cast("long").alias("n_children"), F.col("leaf").alias("n_leaves"),
            (F.col("total") - F.col("owned") - F.col("entry") - (F.col("n") - 1) * before).alias("saved_tokens"), F.when(end, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"),
        )

    return root.unionByName(nodes.select(F.inline(F.transform("sizes", node))))
