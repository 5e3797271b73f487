import random

import numpy as np
import pyarrow as pa
import xxhash

from kithara.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def slow_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def texts(n, seed=5):
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(400)]
    out = [None, "", "One", "one  TWO\tthree", "É À\x0bx y z", "\x00a b c d e f"]
    while len(out) < n:
        t = [rnd.choice(words) for _ in range(rnd.randint(1, 600))]
        out.append(" ".join(t))
        if rnd.random() < 0.5:
            t[rnd.randrange(len(t))] = "changed"
            out.append("\n".join(t))
    return out


def test_fingerprints_follow_the_definition():
    t = texts(200)
    assert [int(x) for x in simhash.fingerprints(pa.array(t))] == [slow_fingerprint(x) for x in t]


def test_components_against_all_pairs(spark):
    t = texts(300)
    t += t[6:40]
    rows = [(i, x, "clash", i) for i, x in enumerate(t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long").repartition(5)
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    fps = [slow_fingerprint(x) for x in t]
    assert got == {i: (f, c) for i, (f, c) in enumerate(zip(fps, slow_components(fps), strict=True))}
    kept = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert kept == set(slow_components(fps))
    assert simhash.representatives(docs).columns == [*docs.columns]


def test_links_split_hot_buckets_and_both_depths(spark, monkeypatch):
    rnd = random.Random(1)
    base = rnd.getrandbits(64)
    fps = {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 6))) for _ in range(300)} | {rnd.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - 2**64 if f >> 63 else f,) for f in fps], "fp long")
    want = slow_components(fps)
    for mean, block in ((64, 2048), (64, 16), (0, 2048)):
        monkeypatch.setattr(simhash, "MEAN", mean)
        monkeypatch.setattr(simhash, "BLOCK", block)
        edges = [(r.src & (2**64 - 1), r.dst & (2**64 - 1)) for r in simhash.links(frame).collect()]
        parent = {f: f for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            assert (a ^ b).bit_count() <= 4
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        assert [find(f) for f in fps] == [fps[i] for i in want]


def test_nulls_repeats_and_empty(spark):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (4, None), (9, ""), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 3), (None, 3), (3, 3), (3, 3), (4, 4), (9, 4), (None, None)], key=str)
    kept = sorted(((r.doc_id, r.text) for r in simhash.representatives(docs).collect()), key=str)
    assert kept == sorted([(3, "a b c d e"), (4, None), (None, "alone here")], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.representatives(docs.limit(0)).count() == 0


def test_votes_over_long_runs():
    h = np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64)
    at = np.array([0, 1, 700, 701, 3000])
    votes = simhash._votes(h, at)
    for k in range(4):
        part = h[at[k] : at[k + 1]]
        assert (votes[k] == [((part >> np.uint64(b)) & np.uint64(1)).sum() for b in range(64)]).all()
