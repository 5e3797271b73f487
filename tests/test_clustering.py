import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kithara.operators import communities, components, density, knn, merging, metric_index, ranges, reduction
from kithara.operators.components import connected_components
from kithara.operators.forest import spanning_forest
from kithara.operators.metric_index import PivotIndex


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("local", [components.LOCAL_EDGES, 0])
def test_components_of_random_graphs_chains_and_stars(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rnd = random.Random(3)
    graphs = [[(rnd.randrange(60), rnd.randrange(60)) for _ in range(m)] for m in (20, 45)]
    graphs += [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)], [(59 - i, 58 - i) for i in range(40)]]
    for edges in graphs:
        got = {r.node: r.root for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "src long, dst long")).collect()}
        want = roots(60, edges)
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert got == {x: want[x] for x in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.3, (25, 3)) for c in (0, 2, 4)] + [rng.uniform(-2, 6, (15, 3))])
    x[7] = x[3]
    rows = [(i, "sample" if i % 3 else "background", v.tolist(), "A" * (8 + i % 5)) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "point_id long, source string, embedding array<double>, cdr3 string").repartition(3).cache()


def lists(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return [[(d[i, j], j) for j in sorted(range(len(x)), key=lambda j: (d[i, j], j != i, j))[:k]] for i in range(len(x))]  # noqa: B023


def test_neighbours_in_blocks(spark, cloud, monkeypatch):
    x, points = cloud
    for block in (4096, 17):
        monkeypatch.setattr(knn, "BLOCK", block)
        got = {}
        for r in knn.nearest(points, points, 6).collect():
            got.setdefault(r.src, []).append((r["rank"], r.dst, r.dist))
        for i, want in enumerate(lists(x, 6)):
            own = sorted(got[i])
            assert [d for _, d, _ in own] == [j for _, j in want]
            assert [d for _, _, d in own] == pytest.approx([d for d, _ in want])
        joint = {(r.src, r["rank"]): r.dst for r in knn.split_nearest(points, 6).collect()}
        assert joint == {(i, k): j for i, w in enumerate(lists(x, 6)) for k, (_, j) in enumerate(w)}
    with pytest.raises(ValueError):
        knn.check_finite(spark.createDataFrame([(1, [float("nan")])], "point_id long, embedding array<double>"))


def brute_vdbscan(nb, eps, m, rule):
    core = [sum(d <= eps[i] for d, _ in w) >= m for i, w in enumerate(nb)]
    edges = []
    for i, w in enumerate(nb):
        for d, j in w:
            limit = {"asymmetric": eps[i], "min": min(eps[i], eps[j]), "max": max(eps[i], eps[j])}[rule]
            if i != j and core[i] and core[j] and d <= limit:
                edges.append((i, j))
    root = roots(len(nb), edges)
    out = [root[i] if core[i] else None for i in range(len(nb))]
    for i, w in enumerate(nb):
        if not core[i]:
            out[i] = next((root[j] for d, j in w if j != i and core[j] and d <= eps[j]), None)
    names = {r: k for k, r in enumerate(sorted({r for r in out if r is not None}))}
    return [-1 if r is None else names[r] for r in out]


def test_vdbscan_rules(spark, cloud):
    x, points = cloud
    edges = knn.nearest(points, points, 7).cache()
    eps = [0.25 + 0.1 * (i % 5) for i in range(len(x))]
    radius = spark.createDataFrame(list(enumerate(eps)), "point_id long, eps double")
    for rule in density.RULES:
        got = dict(density.vdbscan(edges, radius, 4, rule).collect())
        assert [got[i] for i in range(len(x))] == brute_vdbscan(lists(x, 7), eps, 4, rule)
    none = dict(density.vdbscan(edges, radius, 8, "min").collect())
    assert set(none.values()) == {-1}
    with pytest.raises(ValueError):
        density.vdbscan(edges, radius, 4, "other")


def test_dbscan_with_and_without_prefilter(spark, cloud):
    x, points = cloud
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    pairs = knn.within(points, 0.45).cache()
    assert {(r.src, r.dst) for r in pairs.collect()} == set(zip(*np.nonzero(d <= 0.45), strict=True))
    nb = [sorted((d[i, j], j) for j in np.flatnonzero(d[i] <= 0.45)) for i in range(len(x))]
    got = dict(density.dbscan(points, pairs, 4).collect())
    want = brute_vdbscan(nb, [0.45] * len(x), 4, "min")
    assert [got[i] for i in range(len(x))] == want
    assert {r.cluster_id for r in density.dbscan_within(points, -1.0, 4).collect()} == {-1}
    for edges in (None, knn.nearest(points, points, 6)):
        got = dict(density.dbscan_within(points, 0.45, 4, edges).collect())
        assert [got[i] for i in range(len(x))] == want
    sweep = {r.eps: r.n_noise for r in density.noise_by_radius(points, [0.2, 0.45], 4).collect()}
    assert sweep[0.45] == want.count(-1) and sweep[0.2] >= sweep[0.45]


def test_length_groups_and_radius(spark):
    def groups(xs, share):
        df = density.length_groups(spark.createDataFrame([(x,) for x in xs], "length int"), share)
        return {r.length: r.gid for r in df.collect()}

    assert groups([10, 10, 11, 11, 12], 0.4) == {10: 0, 11: 1, 12: 1}
    assert groups([10, 10, 11, 11, 12], 1.0) == {10: 0, 11: 0, 12: 0}
    assert groups([7], 0.05) == {7: 0}
    known = spark.createDataFrame([(10, 0), (12, 1)], "length int, gid int")
    got = density.nearest_group(spark.createDataFrame([(x,) for x in (9, 10, 11, 12, 40)], "length int"), known)
    assert {r.length: r.gid for r in got.collect()} == {9: 0, 10: 0, 11: 0, 12: 1, 40: 1}
    d = spark.createDataFrame([(x,) for x in (0.0, 0.8, 0.9, 1.0)], "d double")
    assert density.chord_radius(d).first().eps == 0.8
    with pytest.raises(ValueError):
        density.chord_radius(d, least=5)
    with pytest.raises(ValueError):
        density.length_groups(spark.createDataFrame([(None,)], "length int"))


def test_leiden_splits_two_cliques_and_is_never_worse_than_singletons(spark):
    edges = [(a, b, 1.0) for base in (0, 10) for a in range(base, base + 6) for b in range(a + 1, base + 6)] + [(5, 10, 0.1)]
    graph = spark.createDataFrame(edges, "a long, b long, weight double")
    points = spark.createDataFrame([(i, "sample") for i in [*range(6), *range(10, 16), 99]], "point_id long, source string")
    got = dict(communities.leiden_clusters(points, graph, least=2).collect())
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(10, 16)}) == 1 and got[0] != got[10] and got[99] == -1
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 40, 120), rng.integers(0, 40, 120)
    keep = a < b
    frame = pd.DataFrame({"a": a[keep], "b": b[keep], "weight": 1.0}).drop_duplicates(["a", "b"])
    label = pd.Series(communities.leiden(40, frame["a"].to_numpy(), frame["b"].to_numpy(), frame["weight"].to_numpy()))
    assert communities.modularity(label, frame) > communities.modularity(pd.Series(range(40)), frame)
    for c in label.unique():
        own = set(label.index[label == c])
        inner = [(x, y) for x, y in zip(frame["a"], frame["b"], strict=True) if x in own and y in own]
        if len(own) > 1:
            assert len({r for i, r in enumerate(roots(40, inner)) if i in own}) == 1
    again = dict(communities.hierarchical_leiden(points, graph, least=2, least_within=2).collect())
    assert again[99] == -1 and again[0] != again[10]


def test_composed_algorithms(spark, cloud):
    x, points = cloud
    edges = knn.nearest(points, points, 7).cache()
    radius = spark.createDataFrame([(i, 0.5) for i in range(len(x))], "point_id long, eps double")
    labels = density.vdbscan(edges, radius, 4).cache()
    fine = communities.vdbscan_leiden(points, labels, knn.neighbour_graph(edges))
    pair = {r.point_id: (r.cluster_id, r.fine) for r in labels.join(fine.withColumnRenamed("cluster_id", "fine"), "point_id").collect()}
    assert {(a == -1) == (b == -1) for a, b in pair.values()} == {True}
    assert len({b for _, b in pair.values()}) == len(set(pair.values()))
    split = communities.leiden_dbscan(points, knn.neighbour_graph(edges), knn.within(points, 0.45), least=4)
    assert split.count() == len(x)


def test_merging_chains_and_hamming(spark):
    rows = [(0, "AAAA"), (1, "AAAA"), (1, "CCCC"), (2, "CCCC"), (3, "CCCC"), (4, "GGGG"), (5, "GGGC"), (6, "GGG"), (-1, "AAAA"), (7, None)]
    m = spark.createDataFrame(rows, "cluster_id long, sequence string")
    assert dict(merging.merge_clusters(m, "sequence").collect()) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 6, 7: 7}
    assert dict(merging.merge_clusters(m, "sequence", 1).collect())[5] == 4
    rnd = random.Random(1)
    seqs = ["".join(rnd.choice("AB") for _ in range(rnd.choice([3, 5]))) for _ in range(40)]
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string")
    for t in (0, 1, 2):
        got = {(r.left_seq, r.right_seq, r.distance) for r in merging.hamming_join(df, df, t).collect()}
        dist = lambda a, b: sum(p != q for p, q in zip(a, b, strict=True))
        assert got == {(a, b, dist(a, b)) for a in seqs for b in seqs if len(a) == len(b) and dist(a, b) <= t}


def test_reduction_keeps_distances(spark, cloud, tmp_path):
    x, points = cloud
    z = (x - x.mean(0)) / x.std(0)
    got = {r.point_id: r.embedding for r in reduction.standardized(points).collect()}
    assert np.allclose([got[i] for i in range(len(x))], z)
    t = reduction.BackgroundTransform.fit(points.filter("source = 'background'"), 3)
    t.save(str(tmp_path / "t"))
    again = reduction.BackgroundTransform.load(str(tmp_path / "t"))
    p = {r.point_id: r.embedding for r in again.transform(points).collect()}
    bg = np.array([i % 3 == 0 for i in range(len(x))])
    w = (x - x[bg].mean(0)) / x[bg].std(0, ddof=1)
    p = np.array([p[i] for i in range(len(x))])
    assert np.allclose(np.linalg.norm(p[:5, None] - p[None], axis=2), np.linalg.norm(w[:5, None] - w[None], axis=2))
    assert again.metadata()["n_components"] == 3


def test_pieces_find_what_wildcards_cannot(spark):
    """Substitutions anywhere in sequences of 0 to 60 letters, against all pairs."""
    import random

    rnd = random.Random(4)
    rows = ["", "A", "B", "AB", "BA"]
    for _ in range(40):
        s = [rnd.choice("ACDE") for _ in range(rnd.choice([3, 9, 14, 45, 60]))]
        rows.append("".join(s))
        for _ in range(rnd.randint(0, 4)):
            s[rnd.choice([0, len(s) - 1, rnd.randrange(len(s))])] = rnd.choice("ACDE")
        rows.append("".join(s))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(rows)], "cluster_id long, sequence string")
    for m in (2, 3):
        want = {(a, b) for a in rows for b in rows if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= m}
        assert {(r.left_seq, r.right_seq) for r in merging.hamming_join(df, df, m).collect()} == want
    root = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) <= 2:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    assert {r.cluster_id: r.merged_cluster_id for r in merging.merge_clusters(df, "sequence", 2).collect()} == dict(enumerate(root))


def test_resampled_curves_repeat_themselves(spark):
    d = spark.range(3000).select((F.col("id") % 3 == 0).cast("int").alias("gid"), F.col("id").alias("point_id"), F.rand(1).alias("d"))
    n = {r.gid: r["count"] for r in density.resampled(d, ["gid"], least=400, share=0.3).groupBy("gid").count().collect()}
    assert 320 < n[1] < 480 and 500 < n[0] < 700
    first = sorted(r.point_id for r in density.resampled(d, least=50, share=0.1).collect())
    assert first == sorted(r.point_id for r in density.resampled(d.repartition(7), least=50, share=0.1).collect())
    assert density.resampled(d, ["gid"]).count() == 3000


def test_ranks_of_a_hot_group_are_dealt_to_many_tasks(spark):
    df = spark.range(4000).select((F.col("id") % 10 == 0).cast("int").alias("g"), F.pmod(F.xxhash64("id"), F.lit(500)).alias("d"), "id")
    got = ranges.ranked_in_ranges(df, ["g"], ["d", "id"], "rank")
    rows = got.orderBy("g", "rank").collect()
    assert [(r.g, r["rank"]) for r in rows] == [(0, i) for i in range(3600)] + [(1, i) for i in range(400)]
    assert all((a.g, a.d, a.id) < (b.g, b.d, b.id) for a, b in zip(rows, rows[1:]))


def test_radii_of_one_source_come_from_lists_within_it(spark, cloud):
    """One sample point among many of the background has none of its own in joint lists, yet a distance."""
    x, points = cloud
    few = points.withColumn("source", F.when(F.col("point_id") % 12 == 0, "sample").otherwise("background"))
    edges = knn.nearest(few, few, 5)
    for basis in density.BASES:
        own = [i for i in range(len(x)) if basis == "all" or (i % 12 == 0) == (basis == "sample")]
        want = {i: np.sort(np.sqrt(((x[own] - x[i]) ** 2).sum(1)))[3] for i in own}
        got = {r.point_id: r.d for r in density.of_basis(edges, few, 4, basis).collect()}
        assert got == pytest.approx(want)
    with pytest.raises(ValueError):
        density.of_basis(edges, few, 4, "other")


@pytest.mark.parametrize("seed", [1, 2])
def test_pivot_index_equals_comparing_all(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.2, (60, 4)) for c in (0, 3, 9)] + [rng.uniform(-3, 12, (40, 4)), np.full((50, 4), 3.0)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, embedding array<double>")
    index = PivotIndex(points, ring=16, asks=20, pivots=9)
    got = {}
    for r in index.nearest(points, 7).collect():
        got.setdefault(r.src, []).append((r["rank"], r.dst, r.dist))
    for i, want in enumerate(lists(x, 7)):
        own = sorted(got[i])
        assert [d for _, d, _ in own] == [j for _, j in want]
        assert [d for _, _, d in own] == pytest.approx([d for d, _ in want])
    other = spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(rng.uniform(-3, 12, (30, 4)))], "point_id long, embedding array<double>")
    assert sorted(map(tuple, index.nearest(other, 500).collect())) == sorted(map(tuple, knn.nearest(other, points, 500).collect()))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for radius in (0.0, 0.3, 4.0):
        near = index.within(points, radius).collect()
        assert len(near) == (d <= radius).sum() and all(d[r.src, r.dst] <= radius for r in near)
    none = PivotIndex(points.limit(0))
    assert none.nearest(points, 3).count() == 0 and none.within(points, 3.0).count() == 0 and index.nearest(points.limit(0), 3).count() == 0


def test_pivot_index_visits_few_rings_where_points_cluster(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (40, 6)) + rng.uniform(-50, 50, 6) for _ in range(40)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, embedding array<double>").cache()
    index = PivotIndex(points, ring=20, pivots=80)
    found = index.nearest(points, 5)
    assert found.count() == 5 * len(x) and index.rings >= 80
    assert index.visits < 0.15 * len(x) * index.rings
    monkeypatch.setattr(knn, "DIRECT", 0)
    assert sorted(map(tuple, knn.nearest(points, points, 5).collect())) == sorted(map(tuple, found.collect()))
    before = index.visits
    index.within(points, 0.2).count()
    assert index.visits - before < 0.15 * len(x) * index.rings


def test_leiden_through_tables_is_as_good_as_in_one_task(spark, monkeypatch):
    """Planted communities in one component: quality within 1 % of one task's, communities connected."""
    monkeypatch.setattr(communities, "MOST_ROUNDS", 9)
    rng = np.random.default_rng(8)
    n, groups = 240, 12
    of = np.arange(n) % groups
    a, b = rng.integers(0, n, 9000), rng.integers(0, n, 9000)
    keep = (a < b) & ((of[a] == of[b]) | (rng.random(9000) < 0.04))
    frame = pd.DataFrame({"a": a[keep], "b": b[keep], "weight": rng.uniform(0.5, 1, keep.sum())}).drop_duplicates(["a", "b"])
    frame = pd.concat([frame, pd.DataFrame({"a": [1000, 1001], "b": [1001, 1002], "weight": [1.0, 1.0]})])
    graph = spark.createDataFrame(frame)
    quality = lambda label: communities.modularity(pd.Series(label), frame)
    one = dict(communities.communities(graph).collect())
    for most in (len(frame) // 3,):
        many = dict(communities.communities(graph, most_edges=most).collect())
        assert set(many) == set(one) and quality(many) > 0.99 * quality(one)
        assert all(min(i for i in many if many[i] == r) == r for r in set(many.values()))
        for r in set(many.values()):
            own = {i for i in many if many[i] == r}
            inner = [(x, y) for x, y in zip(frame["a"], frame["b"], strict=True) if x in own and y in own]
            assert len({q for i, q in enumerate(roots(1003, inner)) if i in own}) == 1


def test_spanning_forest_by_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 90, 260), rng.integers(0, 90, 260)
    w = rng.integers(0, 12, 260) / 4  # many ties
    rows = [(int(x), int(y), float(v)) for x, y, v in zip(a, b, w, strict=True)]
    least = {}
    for x, y, v in rows:
        if x != y:
            k = (min(x, y), max(x, y))
            least[k] = min(v, least.get(k, v))
    want, root = set(), list(range(90))
    for v, (x, y) in sorted((v, k) for k, v in least.items()):
        if root[x] != root[y]:
            want.add((x, y, v))
            low, high = sorted((root[x], root[y]))
            root = [low if r == high else r for r in root]
    edges = spark.createDataFrame([*rows, (None, 3, 1.0), (200, 201, 5.0)], "a long, b long, weight double")
    for local in (1_000_000, 40, 0):
        assert set(map(tuple, spanning_forest(edges, local).collect())) == want | {(200, 201, 5.0)}
    assert spanning_forest(edges.limit(0)).count() == 0


def test_a_sweep_of_radii_equals_dbscan_at_each(spark, cloud):
    x, points = cloud
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for least in (1, 3, 6):
        radii = [0.0, 0.1, 0.25, 0.3, 0.45, 0.6, 0.8]
        got = {r.eps: (r.n_noise, r.n_clusters) for r in density.noise_by_radius(points, radii, least).collect()}
        for r in radii:
            inside = [i for i in range(len(x)) if np.sum(d[i] <= r) > 1]
            nb = [sorted((d[i, j], j) for j in inside if d[i, j] <= r) if i in inside else [] for i in range(len(x))]
            want = brute_vdbscan(nb, [r] * len(x), least, "min")
            assert got[r] == (want.count(-1), len(set(want) - {-1})), (least, r)
    with pytest.raises(ValueError):
        density.noise_by_radius(points, [], 3)


def test_common_ends_of_sequences_are_no_keys(spark):
    """20,000 sequences with one beginning and one end: keys come from what is between."""
    rnd = random.Random(2)
    seqs = sorted({"CASS" + "".join(rnd.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(8)) + "EQYF" for _ in range(20_000)})
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string")
    keys = merging.rare_piece_keys(df, 2, "sequence").groupBy("key").count()
    # before, one key held every sequence and the join had 4 * 10^8 rows
    assert keys.agg({"count": "max"}).first()[0] < 1000
    assert keys.selectExpr("sum(count * count)").first()[0] < 3_000_000


def test_blocks_within_a_source_are_kept_between_runs(spark, cloud, tmp_path, monkeypatch):
    x, points = cloud
    folder = f"file://{tmp_path}/blocks"
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(knn.split_nearest(points, 4))
    assert rows(knn.split_nearest(points, 4, stored=folder)) == want
    assert len(list((tmp_path / "blocks").iterdir())) == 2
    computed, own = [], knn.nearest
    monkeypatch.setattr(knn, "nearest", lambda a, b, k, *r: computed.append((a, b)) or own(a, b, k, *r))
    again = knn.split_nearest(points.repartition(7), 4, stored=folder)
    assert rows(again) == want and len(computed) == 2  # only those across
    assert any("/blocks/self_4_" in f for f in again.inputFiles())
    few = knn.truncated(points, 9)
    assert sorted(r.point_id for r in few.filter("source = 'background'").collect()) == [3 * i for i in range(9)]
    assert rows(knn.split_nearest(few, 4, stored=folder)) == rows(knn.split_nearest(few, 4))
    assert len(list((tmp_path / "blocks").iterdir())) == 3  # the sample's block served both
    for size in (0, 1000):
        with pytest.raises(ValueError):
            knn.truncated(points, size)


def test_leiden_then_dbscan_equals_dbscan_in_each_community(spark, cloud):
    x, points = cloud
    graph = knn.neighbour_graph(knn.nearest(points, points, 7)).cache()
    group = {r.point_id: r.root for r in communities.communities(graph).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = dict(communities.leiden_dbscan(points, graph, knn.within(points, 0.45), least=4, keep_below=10).collect())
    names, lead = {}, {}
    for g in {group.get(i, i) for i in range(len(x))}:
        own = [i for i in range(len(x)) if group.get(i, i) == g]
        if len(own) < 10:
            lead |= dict.fromkeys(own, min(own))
            continue
        nb = [sorted((d[i, j], own.index(j)) for j in own if d[i, j] <= 0.45) for i in own]
        found = brute_vdbscan(nb, [0.45] * len(own), 4, "min")
        for c in set(found) - {-1}:
            names[g, c] = min(i for i, f in zip(own, found, strict=True) if f == c)
        lead |= {i: names.get((g, f)) for i, f in zip(own, found, strict=True)}
    pairs = {(got[i], lead[i]) for i in range(len(x))}
    assert len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs})
    assert {i for i in got if got[i] == -1} == {i for i in lead if lead[i] is None}


def test_dense_points_are_linked_in_few_rows(spark, monkeypatch):
    """1,200 points all within the radius of each other, and two chains: block by block and through the index."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.uniform(0, 0.01, (1200, 3)), [[i * 0.9, 5, 0] for i in range(30)], [[i * 0.9, 9, 0] for i in range(40)], [[99, 9, 9]]])
    points = spark.createDataFrame([(i, v.tolist(), 0.1) for i, v in enumerate(x)], "point_id long, embedding array<double>, core_d double").cache()
    monkeypatch.setattr(knn, "BLOCK", 400)
    monkeypatch.setattr(knn, "BLOCK_BYTES", 1)
    sides = -(-len(x) // 400)
    for direct in (1 << 26, 0):
        monkeypatch.setattr(knn, "DIRECT", direct)
        monkeypatch.setattr(knn, "WAITING", 5000)
        for use, weight in ((knn.connecting(1.0), None), (knn.lightest(1.0), "core_d")):
            links = knn.compared(points, points, 1.0, use, weight=weight).cache()
            assert links.count() < 2 * len(x) * sides  # of 1.4 million pairs
            want = roots(len(x), [(i, i + 1) for i in [*range(1199), *range(1200, 1229), *range(1230, 1269)]])
            assert {r.node: r.root for r in connected_components(links).collect()} == {i: r for i, r in enumerate(want) if i < 1270}
        got = dict(density.dbscan_within(points, 1.0, 3).collect())
        assert [got[i] for i in (0, 1199, 1200, 1229, 1230, 1269, 1270)] == [0, 0, 1, 1, 2, 2, -1]
        sweep = {r.eps: (r.n_noise, r.n_clusters) for r in density.noise_by_radius(points, [0.5, 1.0], 3).collect()}
        assert sweep == {0.5: (71, 1), 1.0: (1, 3)}


def test_points_without_structure_move_in_few_copies(spark, monkeypatch):
    """Every ring may hold a neighbour of every point: compared block by block, and through shelves where that is forced."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(600, 16))
    x /= np.sqrt((x * x).sum(1))[:, None]
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, embedding array<double>").cache()
    want = sorted(map(tuple, knn.nearest(points, points, 5).collect()))
    index, direct = PivotIndex(points, ring=8), []
    plain = knn.block_by_block
    monkeypatch.setattr(knn, "block_by_block", lambda *a: direct.append(1) or plain(*a))
    assert sorted(map(tuple, index.nearest(points, 5).collect())) == want and direct
    monkeypatch.setattr(metric_index, "MOST_SHARE", 2.0)
    index = PivotIndex(points, ring=8)
    asks = index._asks(knn.named(points, "point_id", "embedding"), 1.5)
    planned = index._planned(asks, 0, None)
    visits, copies = planned.agg(F.sum("visits"), F.sum(F.size("to"))).first()
    assert visits > 600 * 40 and copies <= 600 * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(knn, "WAITING", 100)
    assert sorted(map(tuple, index.nearest(points, 5).collect())) == want
    near = sorted(map(tuple, knn.within(points, 1.0).collect()))
    assert sorted(map(tuple, index.within(points, 1.0).collect())) == near


def test_leiden_dbscan_lists_no_pairs(spark, cloud, monkeypatch):
    x, points = cloud
    graph = knn.neighbour_graph(knn.nearest(points, points, 5)).cache()
    want = sorted(map(tuple, communities.leiden_dbscan(points, graph, knn.within(points, 0.45), least=4).collect()))
    monkeypatch.setattr(knn, "within", None)
    for block in (4096, 17):
        monkeypatch.setattr(knn, "BLOCK", block)
        assert sorted(map(tuple, communities.leiden_dbscan(points, graph, least=4, radius=0.45).collect())) == want
    with pytest.raises(ValueError):
        communities.leiden_dbscan(points, graph)


def test_communities_are_found_once(spark, cloud):
    """What follows reads them written: no plan runs Leiden again for each place where they are read."""
    _, points = cloud
    graph = knn.neighbour_graph(knn.nearest(points, points, 4))
    everywhere = points.select("point_id", F.lit(0).cast("long").alias("cluster_id"))
    outer = communities.leiden_clusters(points, graph, least=0)
    for labels in (outer, communities.hierarchical_leiden(points, graph), communities.vdbscan_leiden(points, everywhere, graph)):
        assert "FlatMapGroupsInPandas" not in labels._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, communities.hierarchical_leiden(points, graph, least=0, first=outer).collect())) == sorted(map(tuple, communities.hierarchical_leiden(points, graph, least=0).collect()))
    want = sorted(map(tuple, communities.leiden_dbscan(points, graph, least=4, radius=0.45).collect()))
    assert sorted(map(tuple, communities.leiden_dbscan(points, graph, least=4, radius=0.45, first=outer).collect())) == want


def test_nearest_of_many_are_told_in_one_pass(monkeypatch):
    """Only the first candidates are ordered; the others are met once by a bound, and the lists are those of all distances."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(9001, 8))
    few = np.round(x[:1500, :2])
    copies = np.where(rng.random((1500, 1)) < 0.6, x[:1, :3], x[:1500, :3])
    clusters = rng.integers(0, 4, (1500, 1)) * 1000.0 + 1e-3 * x[:1500, :3]
    ordered = []
    plain = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **named: ordered.append(a.size) or plain(a, *rest, **named))
    for points in (x, few, copies, clusters, x[:1500] + 1e6, x[:1500] * 1e-30, x[np.argsort(-np.abs(x).sum(1))], np.ones((700, 3))):
        ids, ask = rng.permutation(3 * len(points))[: len(points)], points[:60]
        for k in (1, 5, 600):
            ordered.clear()
            src, dst, dist = (np.concatenate(c) for c in zip(*knn.k_best(k)(ids[:60], ask, ids, points), strict=True))
            if points is x and k < 600:
                assert sum(ordered) < 0.1 * 60 * len(points)
            for i in range(60):
                d = np.sqrt(((points - ask[i]) ** 2).sum(1))
                want = np.lexsort((ids, ids != ids[i], d))[:k]
                at = np.flatnonzero(src == ids[i])
                at = at[np.lexsort((dst[at], dst[at] != ids[i], dist[at]))][:k]
                assert (dst[at] == ids[want]).all() and (dist[at] == d[want]).all()
