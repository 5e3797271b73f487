import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from kithara.llm import prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def in_order(rows):
    """{conv_id: turns as (role, text)} by turn, nulls first, then by digest."""
    out = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append(((turn is not None, turn or 0, digest(role, text)), (role, text)))
    return {c: [t for _, t in sorted(x)] for c, x in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    return out


def slow(convs):
    """The trie by plain sets, node by node."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    rows = []
    for path in members:
        todo, leaves, saved = [path], 0, 0
        while todo:
            p = todo.pop()
            leaves += p not in children
            saved += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
            todo += children.get(p, [])
        ends = sorted(c for c in members[path] if len(convs[c]) == len(path))
        above = min(members[path[:-1]]) if path else None
        rows.append((min(members[path]), len(path), above, len(members[path]), len(children.get(path, [])), leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def fast(spark, rows, block=4):
    convs = prefix_trie.turns(spark.createDataFrame(rows, SCHEMA + ", key string").withColumn("parent", F.lit(1)))
    return got(prefix_trie.trie(convs, block))


def got(df):
    return sorted([tuple(r[c] for c in COLUMNS) for r in df.collect()], key=str)


def random_rows(seed, n=60):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        length, shared = rnd.randint(1, 11), rnd.randint(0, 11)
        for t in range(length):
            text = f"common {t}" if t < shared else rnd.choice(["a", "é", "", None, f"own {c} {t}"])
            rows.append((c * 7 - 50, t if t else None, rnd.choice(["user", "user", None]) if t >= shared else "user", text, "x"))
    return rows


@pytest.mark.parametrize("block", [1, 3, 4, 16])
def test_against_plain_sets(spark, block):
    rows = random_rows(block)
    assert fast(spark, rows, block) == slow(in_order(rows))


def test_rebuilt_conversations(spark, tmp_path):
    rows = [r[:4] for s in (1, 2) for r in random_rows(s, 80)]
    rows += [(None, 0, "user", "left out"), (4, None, None, None), (4, None, None, None), (4, 3, "user", "tie"), (4, 3, "user", "tied"), (10**12, 1, "user", "long " * 50000)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    want = slow(rebuilt(in_order(rows)))
    assert got(queries.op13_prefix_trie(spark, str(tmp_path))) == want
    assert sum(r[1] == 0 for r in want) == 1


def test_no_turns_and_no_conversations(spark):
    shape = "conv_id long, turns array<struct<digest:binary,bytes:long>>"
    none = hashlib.sha256(b"").hexdigest()
    assert prefix_trie.trie(spark.createDataFrame([], shape)).count() == 0
    assert got(prefix_trie.trie(spark.createDataFrame([(9, []), (10, [])], shape))) == [(9, 0, None, 2, 0, 1, 0, hashlib.sha256(b"9,10").hexdigest())]
    mixed = got(prefix_trie.trie(spark.createDataFrame([(9, []), (3, [(digest("", "ab"), 2)])], shape)))
    assert mixed == [(3, 0, None, 2, 1, 1, 0, hashlib.sha256(b"9").hexdigest()), (3, 1, 3, 1, 0, 1, 0, hashlib.sha256(b"3").hexdigest())]
    assert none != mixed[0][-1]


def test_many_conversations_of_one_text_end_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, t, "user", f"same {t}", "x") for c in range(300) for t in range(6)] + [(1000 + c, 0, "user", "same 0", "x") for c in range(40)]
    assert fast(spark, rows) == slow(in_order(rows))


def test_lone_tails_are_not_opened(spark):
    """Blocks after the last divergence have one member and stay whole."""
    rows = [(c, t, "user", "hello" if t == 0 else f"{c} {t}", "x") for c in range(20) for t in range(40)]
    convs = prefix_trie.turns(spark.createDataFrame(rows, SCHEMA + ", key string"))
    once = prefix_trie.distinct_blocks(prefix_trie.blocks(convs))
    assert once.count() == 20 * 10 and once.filter("diverges").count() == 20
    assert fast(spark, rows) == slow(in_order(rows))
