import numpy as np

from kithara.llm import neighbours


def exact(ids, x, asked, k):
    out = {}
    for q in asked:
        v = min(tuple(x[i]) for i in range(len(ids)) if ids[i] == q)
        best = {}
        for i, s in zip(ids, (x * np.array(v)).sum(1), strict=True):
            if i != q:
                best[i] = max(best.get(i, -np.inf), s)
        out[q] = sorted(((-s, i) for i, s in best.items()))[:k]
    return out


def test_recall_scores_and_ties(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(3000, 16)), np.ones((700, 16))]).astype(np.float32).astype(float)
    ids = rng.permutation(len(x))
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    odd = [(9001, None), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [1.0] * 15 + [None]), (9005, [1.0] * 3), (9006, [float("inf")] * 16), (None, [5.0] * 16), (9020, None)]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows + odd + rows[:50]], "vec_id long, embedding array<float>, id int, part string").repartition(5)
    asked = [int(i) for i in ids if i % 20 == 0]
    got = {}
    for r in neighbours.search(frame, (neighbours.F.col("vec_id") % 20 == 0)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(asked)
    want = exact(ids, x, asked, 20)
    hits = 0
    by = dict(zip(ids, x, strict=True))
    for q in asked:
        r = sorted(got[q])
        assert [a for a, _, _ in r] == list(range(1, 21))
        assert all(abs(s - float((by[v] * by[q]).sum())) < 1e-12 for _, v, s in r)
        assert [(-s, v) for _, v, s in r] == sorted((-s, v) for _, v, s in r)
        hits += len({v for _, v, _ in r} & {i for _, i in want[q]})
    assert hits / (20 * len(asked)) >= 0.9


def test_blocks_and_few_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROW_BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(1)
    for n in (1, 2, 15, 400):
        x = np.round(rng.normal(size=(n, 4)), 1).astype(np.float32).astype(float) + 0.01
        x[n // 2 :] = x[0]
        frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = {}
        for r in neighbours.search(frame, neighbours.F.col("vec_id") % 20 == 0, 5).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
        want = exact(np.arange(n), x, range(0, n, 20), 5)
        assert all(len(got.get(q, [])) == len(w) for q, w in want.items())
        found = sum(len({v for _, v in got.get(q, [])} & {i for _, i in w}) for q, w in want.items())
        assert found >= 0.9 * sum(map(len, want.values()))
    assert neighbours.search(frame.limit(0), neighbours.F.lit(True)).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(2).normal(size=(1000, 8))
    part = neighbours.balanced_parts(neighbours.neighbour_graph(x, 10), 8)
    assert np.bincount(part).min() >= 124 and np.bincount(part).max() <= 126


def test_parts_follow_the_rows_as_far_as_the_sample_goes():
    x = np.random.default_rng(3).normal(size=(4096, 4))
    assert [neighbours.fit(x[:n], total, 5).parts for n, total in ((4096, 4096), (4096, 100_000), (4096, 10**9), (100, 100))] == [64, 256, 512, 8]
