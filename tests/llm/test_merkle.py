import hashlib

import pytest
from pyspark.sql import functions as F

from kithara.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves):
    """All levels of a tree, from the leaves up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([digest(*level[i : i + 2]) for i in range(0, len(level), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        out.append(level[i ^ 1] if i ^ 1 < len(level) else None)
        i //= 2
    return out


def slow(rows):
    """{(doc_id, leaf): (subroot, root, siblings)}, repeated rows by their first place."""
    first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((first(r[0]), leaf(r), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[1] for x in sorted(groups[g])]) for g in names]
    top = tree([t[-1][0] for t in trees])
    out = {}
    for k, g in enumerate(names):
        for i, (_, h, key) in enumerate(sorted(groups[g])):
            out.setdefault((key, h), []).append((trees[k][-1][0], top[-1][0], siblings(trees[k], i) + siblings(top, k)))
    return out


def rows_of(spark, rows, every, **extra):
    docs = spark.createDataFrame(rows, SCHEMA)
    m = merkle.build(docs, COLUMNS, keep={"doc_id": F.col("doc_id"), **extra}, every=every)
    return m, merkle.proofs(m)


def sample(n):
    langs = ["en", "en", "en", None, "fr", "abé", "", "z"]
    rows = [(i * 3 % 1000, f"s{i % 4}" if i % 9 else None, langs[i % 8] if i % 50 else "lone%d" % i, None if i % 11 == 0 else i, "" if i % 13 == 0 else "text é %d" % i) for i in range(n)]
    return rows + [(None, None, None, None, None), (None, "a", "en", 1, "x"), (3, "s", "en", 1, "same"), (3, "s", "en", 1, "same"), (7, "s", "en", 1, "long " * 40000)]


@pytest.mark.parametrize("every", [1, 3, 8])
def test_against_a_plain_tree(spark, every):
    rows = sample(150)
    want = slow(rows)
    _, found = rows_of(spark, rows, every)
    found = found.withColumn("back", merkle.folded(F.col("leaf"), F.col("merkle_path"))).withColumn("proof", merkle.path_digest(F.col("merkle_path")))
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        # repeated rows are equal leaves in different places
        assert (r.subroot, r.root, [s.digest for s in r.merkle_path]) in want[(r.doc_id, r.leaf)]
        assert r.back == r.root
        assert r.proof == digest(*[s.digest for s in r.merkle_path if s.digest])
    assert len({tuple(map(str, r.merkle_path)) for r in got if r.doc_id == 3 and r.leaf == leaf((3, "s", "en", 1, "same"))}) == 2


def test_a_changed_leaf_does_not_fold_to_the_root(spark):
    rows = sample(60)
    _, found = rows_of(spark, rows, 2, bad=merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")))
    got = found.withColumn("back", merkle.folded(F.col("bad"), F.col("merkle_path"))).collect()
    changed = [r for r in got if r.bad != r.leaf]
    assert 0 < len(changed) < len(got)
    assert all((r.back == r.root) == (r.bad == r.leaf) for r in got)


def test_only_every_few_levels_are_stored_and_wanted_subtrees_regenerated(spark):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(200)]
    m, found = rows_of(spark, rows, 3)
    assert [s.count() for s in m.groups.stored] == [200, 25, 4]
    few = merkle.proofs(m, F.col("doc_id").isin(5, 77))
    assert sorted(r.doc_id for r in few.collect()) == [5, 77]
    all_of = {r.doc_id: r.merkle_path for r in found.collect()}
    assert all(all_of[r.doc_id] == r.merkle_path for r in few.collect())
    assert merkle._subtrees(m.groups.stored[0], 3, F.bool_or(F.col("doc_id").isin(5, 77)).alias("w")).filter("w").count() == 2


def test_empty_one_row_and_clashing_columns(spark):
    m, found = rows_of(spark, [], 8)
    assert found.count() == 0 and m.top.roots.count() == 0
    row = (1, None, None, None, None)
    _, found = rows_of(spark, [row], 8)
    r = found.first()
    assert r.leaf == leaf(row) == r.subroot == r.root and r.merkle_path == []
    docs = spark.createDataFrame([(*row, "x", "y", 1)], SCHEMA + ", _tree string, digest string, _idx int")
    assert merkle.proofs(merkle.build(docs, COLUMNS)).first().root == r.root
