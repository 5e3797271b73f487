"""Reports over donors and configurations: reference matches, donor runs, configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithara.functions.text import match_key
from kithara.operators import runs

RUN = ("run_id", "donor_id")


def reference_matches(assignments: DataFrame, reference: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Assignments with has_match, match_type (cdr3_vj before cdr3_only), epitopes, and is_enriched_clonotype."""
    listed = lambda: F.array_join(F.array_sort(F.collect_set("epitope")), ";").alias("e")
    out = assignments
    for name, parts in (("vj", ("cdr3", "v_gene", "j_gene")), ("seq", ("cdr3",))):
        hits = reference.groupBy(match_key(*map(F.col, parts)).alias(f"_k_{name}")).agg(listed()).withColumnRenamed("e", f"_e_{name}")
        out = out.withColumn(f"_k_{name}", match_key(*map(F.col, parts))).join(hits, f"_k_{name}", "left")
    sig = enrichment.filter("is_significant").select(*RUN, "cluster_id").distinct().withColumn("_sig", F.lit(True))
    out = out.join(sig, [*RUN, "cluster_id"], "left")
    return out.withColumns({
        "has_match": F.col("_e_seq").isNotNull(), "match_type": F.when(F.col("_e_vj").isNotNull(), "cdr3_vj").when(F.col("_e_seq").isNotNull(), "cdr3_only"),
        "epitopes": F.coalesce("_e_vj", "_e_seq"), "is_enriched_clonotype": F.coalesce("_sig", F.lit(False)) & ~F.coalesce("is_noise", F.lit(False)),
    }).drop("_k_vj", "_e_vj", "_k_seq", "_e_seq", "_sig")


def donor_run_summary(matches: DataFrame, enrichment: DataFrame) -> DataFrame:
    """One row a run and donor: clonotypes, matches and their recovery, enriched clusters, scores."""
    n = lambda c: F.countDistinct(F.when(c, F.col("clonotype_id")))
    sample, match = F.col("sample_label") == "sample", F.col("has_match")
    points = matches.groupBy(*RUN).agg(
        n(sample).alias("n_sample_clonotypes"), n(F.col("sample_label") == "background").alias("n_background_clonotypes"),
        n(sample & match).alias("n_matches_in_post"), n((F.col("sample_label") == "background") & match).alias("n_matches_in_background"),
        n(sample & match & F.col("is_enriched_clonotype")).alias("n_matches_in_enriched_clonotypes"),
    )
    with_match = matches.filter(match & (F.col("cluster_id") >= 0)).select(*RUN, "cluster_id").distinct().withColumn("_m", F.lit(True))
    clusters = enrichment.join(with_match, [*RUN, "cluster_id"], "left").withColumn("_m", F.coalesce("_m", F.lit(False)))
    e = lambda c: F.when(F.col("is_significant"), F.col(c))
    own = clusters.groupBy(*RUN).agg(
        F.count("*").alias("n_candidate_clusters"), F.count_if("is_significant").alias("n_enriched_clusters"), F.count_if("_m").alias("n_clusters_with_match"),
        F.count_if(F.col("_m") & F.col("is_significant")).alias("n_enriched_clusters_with_match"), F.coalesce(F.sum(e("n_sample")), F.lit(0)).alias("n_sample_clonotypes_in_enriched_clusters"),
        F.coalesce(F.median(e("log2FC")), F.lit(0.0)).alias("median_enriched_log2fc"), F.coalesce(F.max(e("log2FC")), F.lit(0.0)).alias("max_enriched_log2fc"), F.coalesce(F.median(e("q_value")), F.lit(1.0)).alias("median_enriched_qvalue"),
    )
    df = own.join(points, list(RUN), "left").na.fill(0)
    one = F.lit(1)
    df = df.withColumns({
        "retained_fraction": F.col("n_sample_clonotypes_in_enriched_clusters") / F.greatest("n_sample_clonotypes", one),
        "fraction_matches_recovered": F.col("n_matches_in_enriched_clonotypes") / F.greatest("n_matches_in_post", one),
        "fraction_match_clusters_enriched": F.col("n_enriched_clusters_with_match") / F.greatest("n_clusters_with_match", one),
    })
    return df.join(runs.lfc_mass_share(enrichment, RUN), list(RUN)).join(runs.fragmentation(enrichment, RUN), list(RUN))


def config_medians(donor_runs: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Median of each metric over the donors of a configuration."""
    return donor_runs.groupBy(*by).agg(F.count("*").alias("n_donors"), *[F.median(F.col(m).cast("double")).alias(m) for m in metrics])


def best_by_metric(configs: DataFrame, metrics: Sequence[str], lower: Sequence[str] = (), by: Sequence[str] = ("run_id",)) -> DataFrame:
    """(metric, by, value): the best configuration of each metric, ties by name."""
    long = runs.unpivoted(configs, by, metrics)
    sign = F.when(F.col("metric").isin(*lower), -F.col("value")).otherwise(F.col("value")) if lower else F.col("value")
    return runs.best_per_group(long, ["metric"], [sign.desc(), *[F.asc(b) for b in by]]).drop("best_rank")


def selected_config(configs: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """The configuration that comes first in the order of selection."""
    return configs.orderBy(*runs.selection_order(), *by).limit(1)
