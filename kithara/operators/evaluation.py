"""Clusterings against labelled truth, known clonotypes and other donors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithara.functions.text import match_key, trim_allele


def with_truth(assignments: DataFrame, truth: DataFrame, keys: Sequence[str] = ("cdr3", "v_gene", "j_gene", "chain")) -> DataFrame:
    """Assignments with truth_label from the first truth row of their keys; unlabeled where there is none."""
    first = truth.groupBy(*keys).agg(F.min("truth_label").alias("truth_label"))
    out = assignments.drop("truth_label").join(first, list(keys), "left")
    return out.withColumn("truth_label", F.coalesce("truth_label", F.lit("unlabeled")))


def classification_metrics(assignments: DataFrame, by: Sequence[str] = ("run_id", "epitope")) -> DataFrame:
    """Precision, recall, F1, purity, concentration and fragmentation of each run and epitope.

    A labelled point counts as recovered if it lies in any cluster but noise.
    """
    noise = F.coalesce("is_noise", F.lit(False))
    pos, neg = F.coalesce(F.col("truth_label") == "positive", F.lit(False)), F.coalesce(F.col("truth_label") == "negative", F.lit(False))
    rows = assignments.withColumns({"_pos": pos, "_neg": neg, "_in": ~noise & (F.col("cluster_id") >= 0), "_noise": noise})
    clusters = rows.groupBy(*by, F.when(~F.col("_noise"), F.col("cluster_id")).alias("c")).agg(
        F.count("*").alias("n"), F.count_if("_pos").alias("p"), F.count_if("_neg").alias("m"),
        F.count_if(F.col("_pos") & F.col("_in")).alias("tp"), F.count_if(F.col("_neg") & F.col("_in")).alias("fp"),
        F.count_if(F.col("_pos") & ~F.col("_in")).alias("fn"), F.count_if("_noise").alias("noise"),
    )
    order = Window.partitionBy(*by).orderBy(F.col("c").isNull(), F.desc("p"), "c")
    clusters = clusters.withColumn("r", F.row_number().over(order))
    real = F.col("c").isNotNull()
    df = clusters.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("p").alias("positives"),
        F.coalesce(F.sum(F.when(real, F.col("p") + F.col("m"))), F.lit(0)).alias("labeled"),
        F.coalesce(F.sum(F.when(real, F.greatest("p", "m"))), F.lit(0)).alias("pure"),
        F.coalesce(F.sum(F.when(real & (F.col("r") <= 1), F.col("p"))), F.lit(0)).alias("top1"),
        F.coalesce(F.sum(F.when(real & (F.col("r") <= 5), F.col("p"))), F.lit(0)).alias("top5"),
        F.count_if(real & (F.col("p") > 0)).alias("positive_fragmentation"),
        F.count_if(real).alias("n_clusters"), (F.sum("noise") / F.sum("n")).alias("noise_fraction"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    df = df.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    one = F.lit(1)
    return df.select(
        *by, "precision", "recall", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        (F.col("pure") / F.greatest("labeled", one)).alias("weighted_cluster_purity"),
        (F.col("top1") / F.greatest("positives", one)).alias("positive_cluster_concentration_top1"),
        (F.col("top5") / F.greatest("positives", one)).alias("positive_cluster_concentration_top5"),
        "positive_fragmentation", (F.col("positive_fragmentation") / F.greatest("tp", one)).alias("positive_fragmentation_norm"),
        "n_clusters", "noise_fraction",
    )


def known_recovery(assignments: DataFrame, enrichment: DataFrame, known: DataFrame) -> DataFrame:
    """One row for each known clonotype, run, donor and way of matching (cdr3_only, cdr3_vj).

    The candidate cluster is that of the least clonotype_id among matching sample points outside noise.
    """
    runs = assignments.select("run_id", "donor_id").distinct()
    ranks = enrichment.select(
        "run_id", "donor_id", F.col("cluster_id").alias("candidate_cluster_id"), "q_value", "log2FC", "is_significant", "cluster_size", "n_sample", "n_background",
        F.dense_rank().over(Window.partitionBy("run_id", "donor_id").orderBy("q_value")).alias("cluster_rank_by_q_value"),
        F.dense_rank().over(Window.partitionBy("run_id", "donor_id").orderBy(F.desc("log2FC"))).alias("cluster_rank_by_log2FC"),
    )
    out = None
    for match_type, parts in (("cdr3_only", ["cdr3"]), ("cdr3_vj", ["cdr3", "v_gene", "j_gene"])):
        key = match_key(*map(F.col, parts)).alias("key")
        hits = assignments.select("run_id", "donor_id", key, "sample_label", "cluster_id", "is_noise", "clonotype_id")
        sample = F.col("sample_label") == "sample"
        open_ = sample & ~F.coalesce("is_noise", F.lit(False))
        hits = hits.groupBy("run_id", "donor_id", "key").agg(
            F.bool_or(sample).alias("post"), F.bool_or(F.col("sample_label") == "background").alias("pre"),
            F.min_by("cluster_id", F.when(open_, F.struct("clonotype_id", "cluster_id"))).alias("candidate_cluster_id"),
        )
        wanted = known.select("known_id", "cdr3", key)
        # Known clonotypes and runs are small; every pair of them is a row of the result.
        grid = wanted.crossJoin(runs)
        row = grid.join(hits, ["run_id", "donor_id", "key"], "left").withColumn("candidate_cluster_id", F.coalesce("candidate_cluster_id", F.lit(-1)).cast("long"))
        row = row.join(ranks, ["run_id", "donor_id", "candidate_cluster_id"], "left").select(
            "run_id", "donor_id", "known_id", "cdr3", F.lit(match_type).alias("match_type"),
            F.coalesce("post", F.lit(False)).alias("is_present_in_post_sample"), F.coalesce("pre", F.lit(False)).alias("is_present_in_pre_sample"),
            "candidate_cluster_id", (F.col("candidate_cluster_id") >= 0).alias("is_candidate_clustered"),
            F.coalesce("is_significant", F.lit(False)).alias("is_in_significant_cluster"), "q_value", "log2FC",
            "cluster_rank_by_q_value", "cluster_rank_by_log2FC", "cluster_size", "n_sample", "n_background",
        )
        out = row if out is None else out.unionByName(row)
    return out


def with_recovery_rate(recovery: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """The share of significant hits of each group on all its rows."""
    hit = F.col("is_in_significant_cluster").cast("double")
    return recovery.withColumn("known_recovery_rate", F.avg(hit).over(Window.partitionBy(*by)))


def overlap_fraction(both: Column, a: Column, b: Column) -> Column:
    """Of the smaller set; 0 if either is empty."""
    return F.when((a > 0) & (b > 0), both / F.least(a, b)).otherwise(0.0)


#: Pairs of donors that are twins (fixed values).
TWINS = (("P1", "P2"), ("Q1", "Q2"), ("S1", "S2"))


def cross_donor_overlap(assignments: DataFrame, enrichment: DataFrame, by: Sequence[str] = ("method", "parameter_json")) -> DataFrame:
    """Shared sample clonotypes of each pair of donors of a configuration, all and enriched ones."""
    sig = enrichment.filter("is_significant").select("run_id", "donor_id", "cluster_id").distinct().withColumn("hit", F.lit(True))
    post = assignments.filter(F.col("sample_label") == "sample").withColumn("key", match_key(*[F.col(c) for c in ("cdr3", "v_gene", "j_gene", "chain")]))
    post = post.join(sig, ["run_id", "donor_id", "cluster_id"], "left")
    hit = F.coalesce("hit", F.lit(False)) & ~F.coalesce("is_noise", F.lit(False))
    keys = post.groupBy(*by, "run_id", "donor_id", "key").agg(F.bool_or(hit).alias("enriched"))
    sizes = assignments.select(*by, "run_id", "donor_id").distinct().join(
        keys.groupBy(*by, "run_id", "donor_id").agg(F.count("*").alias("n"), F.count_if("enriched").alias("m")), [*by, "run_id", "donor_id"], "left"
    ).na.fill(0, ["n", "m"])
    side = lambda df, s: df.select(*by, *[F.col(c).alias(f"{c}_{s}" if c != "key" else c) for c in df.columns if c not in by])
    ordered = (F.col("donor_id_a") < F.col("donor_id_b")) | ((F.col("donor_id_a") == F.col("donor_id_b")) & (F.col("run_id_a") < F.col("run_id_b")))
    pairs = side(sizes, "a").join(side(sizes, "b"), list(by)).filter(ordered)
    shared = side(keys, "a").join(side(keys, "b"), [*by, "key"]).filter(ordered)
    ends = [*by, "run_id_a", "donor_id_a", "run_id_b", "donor_id_b"]
    shared = shared.groupBy(*ends).agg(F.count("*").alias("raw_overlap_count"), F.count_if(F.col("enriched_a") & F.col("enriched_b")).alias("enriched_overlap_count"))
    df = pairs.join(shared, ends, "left").na.fill(0, ["raw_overlap_count", "enriched_overlap_count"])
    df = df.withColumns({"raw_overlap_fraction": overlap_fraction(F.col("raw_overlap_count"), F.col("n_a"), F.col("n_b")), "enriched_overlap_fraction": overlap_fraction(F.col("enriched_overlap_count"), F.col("m_a"), F.col("m_b"))})
    twin = F.lit(False)
    for a, b in TWINS:
        twin = twin | (F.col("donor_id_a").isin(a, b) & F.col("donor_id_b").isin(a, b))
    return df.select(
        *ends, "raw_overlap_count", "raw_overlap_fraction", "enriched_overlap_count", "enriched_overlap_fraction",
        F.when(F.col("raw_overlap_fraction") > 0, F.col("enriched_overlap_fraction") / F.col("raw_overlap_fraction")).otherwise(0.0).alias("overlap_fold_change"), twin.alias("is_twin_pair"),
    )


def key_set_confusion(predicted: DataFrame, positive: DataFrame, negative: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: TP, FP, TN, FN, precision, recall, F1 of key sets; keys of neither set do not count."""
    flag = lambda df, n: df.select(*keys).distinct().withColumn(n, F.lit(True))
    all_ = flag(positive, "p").join(flag(negative, "n"), list(keys), "full").join(flag(predicted, "x"), list(keys), "left")
    pos, hit = F.coalesce("p", F.lit(False)), F.coalesce("x", F.lit(False))
    return confusion(all_.select(pos.alias("truth"), hit.alias("predicted")))


def confusion(rows: DataFrame, by: Sequence[str] = (), truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    """Counts and scores of boolean truth and prediction."""
    t, p = F.col(truth), F.col(predicted)
    df = rows.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    df = df.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return df.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def paired_flags(pairs: DataFrame, hits: dict[str, DataFrame], keys: dict[str, Sequence[str]], valid: str = "valid") -> DataFrame:
    """Pairs of chains with truth_alpha, truth_beta, hit_alpha and hit_beta.

    A chain's key is true if any of its pairs is valid, and a hit if the clustered keys of the chain hold
    it (hits: alpha and beta to tables with the chain's key columns). Keys with a null are no hits.
    """
    for chain in ("alpha", "beta"):
        own = list(keys[chain])
        same = lambda t, other: [F.col(f"{t}.{c}").eqNullSafe(F.col(f"{other}.{c}")) for c in own]  # noqa: B023, E731
        truth = pairs.groupBy(*own).agg(F.coalesce(F.bool_or(valid), F.lit(False)).alias(f"truth_{chain}"))
        pairs = pairs.alias("p").join(truth.alias("t"), same("p", "t"), "left").select("p.*", f"truth_{chain}")
        found = hits[chain].select(*own).na.drop().distinct().withColumn(f"hit_{chain}", F.lit(True))
        pairs = pairs.join(found, own, "left").withColumn(f"hit_{chain}", F.coalesce(f"hit_{chain}", F.lit(False)))
    return pairs


def paired_confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion of six combinations: each chain, either and both by themselves, and the truth of either against one chain.

    rows: truth_alpha, truth_beta, hit_alpha, hit_beta.
    """
    truths = {"alpha": F.col("truth_alpha"), "beta": F.col("truth_beta"), "or": F.col("truth_alpha") | F.col("truth_beta"), "and": F.col("truth_alpha") & F.col("truth_beta")}
    hits = {"alpha": F.col("hit_alpha"), "beta": F.col("hit_beta"), "or": F.col("hit_alpha") | F.col("hit_beta"), "and": F.col("hit_alpha") & F.col("hit_beta")}
    combos = [("alpha", "alpha"), ("beta", "beta"), ("or", "or"), ("and", "and"), ("or", "alpha"), ("or", "beta")]
    stacked = F.explode(F.array(*[F.struct(F.lit(t).alias("truth_kind"), F.lit(p).alias("hit_kind"), truths[t].alias("truth"), hits[p].alias("predicted")) for t, p in combos]))
    return confusion(rows.select(*by, stacked.alias("x")).select(*by, "x.*"), [*by, "truth_kind", "hit_kind"])


def motif_baseline(motifs: DataFrame, truth: DataFrame, with_genes: bool = False, valid: str = "valid") -> DataFrame:
    """One row: precision, recall and F1 (with counts) of calling a truth row valid where its sequence is a motif member.

    motifs: cdr3 and, with genes, v_gene and j_gene, which may list several after commas; truth: the same and `valid`.
    Alleles do not count.
    """
    keys = ["cdr3", "v_gene", "j_gene"] if with_genes else ["cdr3"]
    for g in keys[1:]:
        motifs = motifs.withColumn(g, F.explode(F.transform(F.split(g, ","), lambda x: trim_allele(F.trim(x)))))
        truth = truth.withColumn(g, trim_allele(F.col(g)))
    known = motifs.select(*keys).na.drop().distinct().withColumn("_hit", F.lit(True))
    rows = truth.join(known, keys, "left").select(F.coalesce(F.col(valid), F.lit(False)).alias("truth"), F.coalesce("_hit", F.lit(False)).alias("predicted"))
    return confusion(rows)


def truth_by_key(rows: DataFrame, keys: Sequence[str], label: str = "truth") -> DataFrame:
    """Rows of the same key collapse; any positive makes it positive."""
    return rows.groupBy(*keys).agg(F.bool_or(label).alias(label))
