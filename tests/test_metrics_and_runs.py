import math
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from kithara.functions import text
from kithara.operators import cluster_metrics, cohort, evaluation, longitudinal, runs
from kithara.plans.compare import ALGORITHMS, Config, compare
from kithara.sources import repertoire
from kithara.streaming import counts


def test_geometry_of_a_hand_made_graph(spark):
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, -1)], "point_id long, cluster_id long")
    rows = [(0, 0, 0.0), (0, 1, 1.0), (0, 3, 5.0), (1, 0, 1.0), (1, 2, 2.0), (2, 1, 2.0), (2, 5, 4.0), (3, 4, 1.0), (4, 3, 1.0), (5, 0, 9.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, dist double")
    got = {r.cluster_id: r for r in cluster_metrics.geometry(labels, edges).collect()}
    core = {0: 5.0, 1: 2.0, 2: 4.0, 3: 1.0, 4: 1.0, 5: 9.0}
    inside = sorted(max(core[a], core[b], d) for a, b, d in rows if a != b and {a, b} <= {0, 1, 2})
    outside = sorted(max(core[a], core[b], d) for a, b, d in rows if a in (0, 1, 2) and b > 2)

    def quantile(x, p):
        at = (len(x) - 1) * p
        lo = math.floor(at)
        return x[lo] + (x[min(lo + 1, len(x) - 1)] - x[lo]) * (at - lo)

    c, s = quantile(inside, 0.9), quantile(outside, 0.1)
    assert got[0].internal_edges_n == len(inside) and got[0].external_edges_n == len(outside)
    assert got[0].cohesion == pytest.approx(c) and got[0].separation == pytest.approx(s)
    assert got[0].density_validity == pytest.approx((s - c) / max(s, c))
    assert got[1].external_edges_n == 0 and got[1].density_validity is None and -1 not in got
    summary = spark.createDataFrame([(0, 6, 1, 7, 20, 20, 0.5, 0.01), (1, 6, 1, 7, 20, 20, 0.5, 0.2)], "cluster_id long, sample long, background long, cluster_size long, total_sample long, total_background long, log_fold_change double, enrichment_fdr_zbinom double")
    full = cluster_metrics.enrichment_metrics(summary).join(cluster_metrics.geometry(labels, edges, summary), "cluster_id", "left")
    out = {r.cluster_id: r for r in cluster_metrics.candidate_flags(cluster_metrics.odds_metrics(full)).collect()}
    assert out[0].log2_odds == pytest.approx(math.log2(6.5 / 14.5) - math.log2(1.5 / 19.5))
    assert out[0].density_validity_enriched_only is None and out[1].is_sample_knn_closed and not out[1].is_good_candidate_relaxed
    assert out[1].log_fold_change_possig is None and out[0].log_fold_change_possig == 0.5


def test_validity_cases(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (0.0, 0.0), (None, 1.0)], "c double, s double")
    assert [r.v for r in df.select(cluster_metrics.validity(F.col("c"), F.col("s")).alias("v")).collect()] == [0.5, -0.5, 0.0, None]


def test_classification_by_hand(spark):
    rows = [("r", "e", 0, False, "positive"), ("r", "e", 0, False, "positive"), ("r", "e", 0, False, "negative"), ("r", "e", 1, False, "positive"), ("r", "e", 2, False, "unlabeled"), ("r", "e", -1, True, "positive"), ("r", "e", -1, True, "negative")]
    a = spark.createDataFrame(rows, "run_id string, epitope string, cluster_id int, is_noise boolean, truth_label string")
    m = evaluation.classification_metrics(a).first()
    assert (m.precision, m.recall, m.f1) == (0.75, 0.75, 0.75)
    assert m.weighted_cluster_purity == 0.75 and m.positive_cluster_concentration_top1 == 0.5 and m.positive_cluster_concentration_top5 == 0.75
    assert m.positive_fragmentation == 2 and m.positive_fragmentation_norm == pytest.approx(2 / 3) and m.n_clusters == 3 and m.noise_fraction == pytest.approx(2 / 7)


def test_overlap_of_three_donors_with_an_empty_one(spark):
    schema = "method string, parameter_json string, run_id string, donor_id string, cluster_id int, is_noise boolean, sample_label string, cdr3 string, v_gene string, j_gene string, chain string"
    row = lambda d, c, k, s="sample": ("m", "{}", f"r{d}", d, c, False, s, k, "v", None, "beta")
    a = spark.createDataFrame([row("P1", 0, "A"), row("P1", 0, "B"), row("P1", 1, "C"), row("P2", 0, "A"), row("P2", 1, "B"), row("X", 0, "A", "background")], schema)
    e = spark.createDataFrame([("rP1", "P1", 0, True), ("rP2", "P2", 0, True)], "run_id string, donor_id string, cluster_id int, is_significant boolean")
    got = {(r.donor_id_a, r.donor_id_b): r for r in evaluation.cross_donor_overlap(a, e).collect()}
    assert set(got) == {("P1", "P2"), ("P1", "X"), ("P2", "X")}
    t = got["P1", "P2"]
    assert (t.raw_overlap_count, t.raw_overlap_fraction, t.enriched_overlap_count, t.enriched_overlap_fraction, t.is_twin_pair) == (2, 1.0, 1, 1.0, True)
    assert got["P1", "X"].raw_overlap_fraction == 0 and not got["P1", "X"].is_twin_pair


def test_run_tables(spark):
    rows = [("a", 0, 8, 10, 2, 0.5, 0.01), ("a", 1, 2, 3, 1, 0.2, 0.5), ("a", -1, 1, 5, 4, 0.9, 0.01), ("b", 0, 4, 4, 0, -0.5, 0.01), ("b", 1, 4, 8, 4, 0.5, 0.02)]
    c = spark.createDataFrame(rows, "run_id string, cluster_id int, sample long, cluster_size long, background long, log_fold_change double, enrichment_fdr_zbinom double")
    t = {r.run_id: r for r in runs.run_level_table(c, ["log_fold_change"]).collect()}
    assert t["a"].n_clusters_in_summary == 3 and t["a"].n_clusters_total == 2 and t["a"].n_clusters_enriched == 1
    assert t["a"]["log_fold_change__max"] == 0.9 and t["a"]["cluster_size_all__mean"] == 6.5
    s = {r.run_id: r.lfc_mass_shift for r in runs.lfc_mass_signed(c).collect()}
    assert s["a"] == 1 and s["b"] == pytest.approx(0)
    d = {r.run_id: r for r in runs.dense_score(c).collect()}
    assert d["a"].effective_sample_cluster_size == 8 and d["a"].coverage_rank_pct == 1 and d["b"].coverage_rank_pct == 0.5
    zero = runs.dense_score(c.withColumn("enrichment_fdr_zbinom", F.lit(1.0))).collect()
    assert all(r.effective_size_penalty == 0 and r.dense_score == 0 for r in zero)
    f = runs.fragmentation(c.withColumn("e", F.lit(False)), enriched="e").first()
    assert (f.median_enriched_cluster_size, f.fraction_enriched_clusters_size_le_3, f.max_enriched_cluster_size, f.fragmentation_score) == (0, 1, 0, 1)


def test_manifests_and_updates(spark):
    g = runs.grid(spark, {"k": [1, 2], "eps_k": [1, 3]})
    assert g.count() == 4 and runs.invalid_configs(g, "k", "eps_k").count() == 2
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", None)], "k int, v string, t int")
    assert sorted(r.v for r in runs.latest(a, ["k"], ["t"]).collect()) == ["y", "z"]
    assert runs.best_key_pair(a, a.select(F.col("v").alias("w"), "k"), [("v", "k"), ("v", "w"), ("k", "k")]) == ("v", "w")
    with pytest.raises(ValueError):
        runs.updated_from(a, a, ["k"], ["v"])
    with pytest.raises(ValueError):
        runs.row_counts_agree(a, a.limit(1))
    up = runs.union_tables([a, spark.createDataFrame([(9,)], "z int")])
    assert up.columns == ["k", "v", "t", "z"] and up.count() == 4
    tm = a.groupBy().agg(runs.trimmed_mean(F.col("k").cast("double"), 0.34).alias("m")).first().m
    assert tm == 1


def test_text_expressions(spark):
    df = spark.createDataFrame([("TRBV1/2*01, x", "s_1", "A, b,,C"), (None, "b_q", None)], "g string, i string, l string")
    r = df.select(
        text.normalize_gene(F.col("g")).alias("g"), text.chain_name(F.col("g")).alias("c"), text.source_of_id(F.col("i")).alias("s"), text.split_list(F.col("l")).alias("l"), text.trim_allele(F.col("g")).alias("t"),
        text.parameters(F.lit('{"k": 3}'), ["k"])["param_k"].alias("k"), text.safe_ratio(F.lit(0), F.lit(0)).alias("z"), text.capped(F.lit(None).cast("double"), 0, 1).alias("n"),
    ).collect()
    assert (r[0].g, r[0].c, r[0].s, r[0].l, r[0].k, r[0].z, r[0].n) == ("TRBV1_2", "beta", "sample", ["A", "b", "C"], "3", None, None)
    assert (r[1].g, r[1].c, r[1].s, r[1].l, r[1].t) == ("", None, "background", [], None)
    for bad in ("q_1", None):
        with pytest.raises(Exception, match="no source in the id"):
            spark.createDataFrame([(bad,)], "i string").select(text.source_of_id(F.col("i"))).collect()
    ids = spark.createDataFrame([("set__vdbscan_leiden__k-3",), ("plain",)], "r string")
    got = ids.select(*[c.alias(n) for n, c in text.run_identity(F.col("r")).items()]).collect()
    assert tuple(got[0]) == ("set", "vdbscan_leiden", "k-3") and tuple(got[1]) == (None, None, None)


def test_topsis_with_a_constant_metric(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0, 9.0), (2, 2.0, 5.0, 1.0)], "i int, a double, b double, c double")
    got = {r.i: (r.topsis_score, r.topsis_rank) for r in cohort.topsis(df, {"a": 1, "b": 1, "c": 1}, ["c"]).collect()}
    assert got == {2: (1.0, 1), 1: (0.0, 2)}


def test_selection(spark):
    df = spark.createDataFrame([("a", 0.5, None, 0.1, 0.2), ("b", 0.5, 1.0, 0.1, 0.9), ("c", 0.4, 9.0, 0.9, 0.0)], "run_id string, lfc_mass_share double, overlap_fold_change double, retained_fraction double, fragmentation_score double")
    assert longitudinal.selected_config(df).first().run_id == "b"


def test_reading_and_writing(spark, tmp_path):
    df = spark.createDataFrame([("CASS", "TRBV1*01,TRBV2", "TRBJ2", "3"), ("CAST", "TRBV3", "TRBJ1", "x")], "junction_aa string, v_call string, j_call string, count string")
    repertoire.write_tsv(df, f"{tmp_path}/t")
    own = {r.cdr3: r for r in repertoire.standardized_clonotypes(repertoire.read_tsv(spark, f"{tmp_path}/t")).collect()}
    assert own["CASS"].v_gene == "TRBV1" and own["CASS"].chain == "beta" and own["CASS"]["count"] == 3 and own["CAST"]["count"] is None
    for row, schema in ((("", "v", "j"), "cdr3 string, v string, j string"), (("C", " ", "j"), "cdr3 string, `v.segm` string, j string"), (("C", "v"), "cdr3 string, v string")):
        with pytest.raises(ValueError):
            repertoire.standardized_clonotypes(spark.createDataFrame([row], schema))
    smoke = spark.createDataFrame([(1, "CASSL", "TRBV1*01", "TRBJ1")], "clone_id int, cdr3aa_beta string, v_beta string, j_beta string")
    assert tuple(repertoire.standardized_clonotypes(smoke).first()) == ("1", "CASSL", "TRBV1", "TRBJ1", "beta", 1)
    alpha = spark.createDataFrame([("x", "CAV", "TRAV1", "TRAJ1")], "clonotype_id string, cdr3_alpha_aa string, TRAV string, TRAJ_IMGT string")
    assert tuple(repertoire.standardized_clonotypes(alpha).first()) == ("x", "CAV", "TRAV1", "TRAJ1", "alpha", 1)
    named = spark.createDataFrame([("C", "v", "j", "TRA"), ("C", "v", "j", None)], "cdr3 string, `v.segm` string, `j.segm` string, locus string")
    assert [r.chain for r in repertoire.standardized_clonotypes(named).collect()] == ["alpha", "beta"]
    runs_ = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, x int")
    repertoire.write_runs(runs_, f"{tmp_path}/runs")
    meta = spark.createDataFrame([("r1", "ok", "m"), ("r2", "error", "m")], "run_id string, status string, mode string")
    assert [r.x for r in repertoire.runs_table(spark, f"{tmp_path}/runs", meta, mode="m").collect()] == [1]
    assert repertoire.read_columns(spark, f"{tmp_path}/runs", ["x", "none"]).columns == ["x"]
    df.withColumn("emb_1", F.lit(0.5)).write.parquet(f"{tmp_path}/wide")
    assert repertoire.read_metadata(spark, f"{tmp_path}/wide").columns == ["junction_aa", "v_call", "j_call"]
    for patient, run in (("p1", "algo_leiden__kn_7"), ("p2", "algo_leiden__kn_9"), ("p2", "other")):
        (tmp_path / "tree" / patient / run).mkdir(parents=True)
        (tmp_path / "tree" / patient / run / "summary.tsv").write_text("cluster_id\tsample\n1\t5\n2\t6\n")
        (tmp_path / "tree" / patient / run / "clusters.tsv").write_text("other\n")
    found = repertoire.run_summaries(spark, f"{tmp_path}/tree", "algo_").orderBy("patient", "cluster_id").collect()
    assert [(r.patient, r.run_id, r.cluster_id, r.sample, r.method, r.k_neighbors) for r in found] == [
        (p, f"algo_leiden__kn_{k}", c, n, "leiden", k) for p, k in (("p1", 7), ("p2", 9)) for c, n in ((1, 5), (2, 6))
    ]
    with tarfile.open(tmp_path / "runs.tar.gz", "w:gz") as tar:
        tar.add(tmp_path / "tree", "tree")
    held = repertoire.archived_tables(spark, f"{tmp_path}/runs.tar.gz", "summary.tsv")
    back = repertoire.archived_rows(held, "cluster_id int, sample int, none string").collect()
    assert sorted((r.member, r.cluster_id, r.sample, r.none) for r in back) == sorted((f"tree/{p}/{x}/summary.tsv", c, n, None) for p, x in (("p1", "algo_leiden__kn_7"), ("p2", "algo_leiden__kn_9"), ("p2", "other")) for c, n in ((1, 5), (2, 6)))
    repertoire.write_tables(f"{tmp_path}/debug", {"a": df})
    assert spark.read.parquet(f"{tmp_path}/debug/a").count() == 2


@pytest.mark.parametrize("mode", ["w", "w:gz"])
def test_archives_in_pieces(spark, tmp_path, mode):
    """Members over many pieces, lines longer than a piece, blank first lines, header only, empty; plain and compressed."""
    rnd = random.Random(5)
    long_ = "x" * 500
    tables = {f"m{i}.tsv": [(j, rnd.choice(["a", "b\u00e9", long_])) for j in range(300)] for i in range(3)}
    (tmp_path / "in").mkdir()
    for name, rows in tables.items():
        end = "\r\n" if name == "m1.tsv" else "\n"
        body = end.join(["n\ts", *(f"{n}\t{s}" for n, s in rows)])
        (tmp_path / "in" / name).write_bytes((("\n\n" if name == "m0.tsv" else "") + body + ("" if name == "m2.tsv" else end)).encode())
    (tmp_path / "in" / "head.tsv").write_text("n\ts")
    (tmp_path / "in" / "empty.tsv").write_text("")
    (tmp_path / "in" / "other.txt").write_text("n\ts\n1\t2\n")
    (tmp_path / "a dir").mkdir()
    for k in (1, 2):
        with tarfile.open(tmp_path / "a dir" / f"{k}.tar", mode) as tar:
            tar.add(tmp_path / "in", "in")
    for piece in (100, 1 << 12, 8 << 20):
        held = repertoire.archived_tables(spark, f"{tmp_path}/a dir", piece=piece).cache()
        assert all(r.header == "n\ts" for r in held.select("header").distinct().collect())
        sizes = held.groupBy("member").count().collect()
        assert {r.member for r in sizes} == {"in/head.tsv", *(f"in/{m}" for m in tables)}
        if piece == 100:
            assert min(r["count"] for r in sizes if r.member != "in/head.tsv") > 100 and held.selectExpr("max(length(content))").first()[0] < 800
        back = repertoire.archived_rows(held, "n int, s string").collect()
        want = [(f"{k}.tar", f"in/{m}", n, v) for k in (1, 2) for m, rows in tables.items() for n, v in rows]
        assert sorted((r.archive.rsplit("/", 1)[1], r.member, r.n, r.s) for r in back) == sorted(want)
    if mode == "w":
        whole = (tmp_path / "a dir" / "1.tar").read_bytes()
        (tmp_path / "cut.tar").write_bytes(whole[: len(whole) // 2 // 512 * 512])
        with pytest.raises(Exception, match="ends inside|unexpected end"):
            repertoire.archived_tables(spark, f"{tmp_path}/cut.tar").collect()


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    rows = [(i % 3 - 1, "sample" if i % 2 else "background", dt.datetime(2024, 1, 1 + i // 10, i % 10)) for i in range(60)]
    df = spark.createDataFrame(rows, "cluster_id int, source string, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    counts.start(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {tuple(r) for r in counts.windowed_counts(df).collect()}
    assert got <= want and len(got) >= len(want) - 2 and len(got) > 5


@pytest.mark.parametrize("algorithm", ALGORITHMS)
def test_whole_comparison(spark, algorithm):
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (20, 4)) for c in (0, 3)])
    rows = [(i, "sample" if (i < 20) == (i % 4 > 0) else "background", v.tolist(), "A" * (9 + i % 3)) for i, v in enumerate(x)]
    p = spark.createDataFrame(rows, "point_id long, source string, embedding array<double>, cdr3 string")
    r = compare(p, Config(algorithm=algorithm, components=3, k_neighbors=8))
    assert r.members.count() == 40 and r.summary.count() >= 1 and "is_good_candidate" in r.summary.columns
    assert r.enriched.count() <= 40
    with pytest.raises(ValueError):
        Config(eps_k=9, k_neighbors=3)


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from kithara.session import shared_folder

    unset = SimpleNamespace(get=lambda *a: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master)))
    for master in ("local", "local[4]", "local[*]"):
        assert shared_folder(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master=master, applicationId=master))).startswith("file://")


def test_run_folders_of_different_layouts(spark, tmp_path):
    texts = {"p1/a_1/summary.tsv": "cluster_id\tsample\tbackground\n1\t5\t7\n2\t6\t8\n", "p1/a_2/summary.tsv": "cluster_id\tfold\tsample\n1\t0.5\t9\n",
             "p2/a_1/summary_x.tsv": "cluster_id\tsample\tbackground\nc3\t1\t2\n", "p2/b_1/summary.tsv": "cluster_id\tfold\tsample\n4\t1.5\t3\n"}
    for name, text_ in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text_)
    found = repertoire.run_summaries(spark, str(tmp_path), "a_", parse=lambda c: {})
    got = sorted((r.patient, r.run_id, r.cluster_id, r.sample, r.background, r.fold) for r in found.collect())
    assert got == [("p1", "a_1", "1", 5, 7, None), ("p1", "a_1", "2", 6, 8, None), ("p1", "a_2", "1", 9, None, 0.5), ("p2", "a_1", "c3", 1, 2, None)]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        repertoire.run_summaries(spark, str(tmp_path / "empty"))


def test_summaries_of_large_groups_by_ranks_in_ranges(spark, monkeypatch):
    """The same rows whether a group's values fit one buffer or only those next to each quantile are picked out."""
    i = F.col("id")
    c = spark.range(600).select(
        F.when(i % 50 == 0, None).otherwise(F.concat(F.lit("r"), (i % 3 == 0).cast("int").cast("string"))).alias("run_id"), F.when(i % 29 == 0, -1).otherwise(i).cast("long").alias("cluster_id"),
        (i % 40).cast("double").alias("sample"), (i % 23).cast("double").alias("background"), (i % 63).alias("cluster_size"), F.when(i % 7 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(90)) / 9).alias("log_fold_change"),
        F.when(i % 3 == 0, None).otherwise((i % 5) / 10).alias("empty_in_one"), (F.pmod(i, F.lit(10)) / 100).alias("enrichment_fdr_zbinom"),
    ).repartition(5)

    def all_of():
        tables = [runs.run_level_table(c, ["log_fold_change", "empty_in_one"]), runs.metric_statistics(c, ["log_fold_change", "empty_in_one"]), runs.distribution(c, "log_fold_change", ["run_id"]), runs.distribution(c, "log_fold_change")]
        return [sorted(([tuple(sorted(r.asDict().items())) for r in t.collect()]), key=str) for t in tables]

    small = all_of()
    monkeypatch.setattr(runs, "ONE_TASK", 5)
    for one, many in zip(small, all_of(), strict=True):
        assert len(one) == len(many) > 0
        for a, b in zip(one, many, strict=True):
            assert [k for k, _ in a] == [k for k, _ in b]
            for (k, x), (_, y) in zip(a, b, strict=True):
                assert x == y or x == pytest.approx(y, rel=1e-12), k
