"""Metrics of single clusters: smoothed enrichment, geometry of neighbour edges, odds, candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithara.functions.text import is_enriched

#: Fixed values of the metrics.
ALPHA, CORE_K, FDR_LEVEL, FDR_CAP, FDR_FLOOR, LEAST_SAMPLE = 0.5, 15, 0.05, 50.0, 1e-300, 5


def enrichment_metrics(summary: DataFrame, fdr: str = "enrichment_fdr_zbinom") -> DataFrame:
    """Usage, smoothed fold change, support and scores; expects total_sample and total_background."""
    a, b = F.col("sample").cast("double"), F.col("background").cast("double")
    s, n = F.col("total_sample").cast("double"), F.col("total_background").cast("double")
    enriched = is_enriched(F.col(fdr), F.col("log_fold_change"), F.col("cluster_id"))
    df = summary.withColumns({
        "sample_usage": a / F.nullif(s, F.lit(0.0)), "background_usage": b / F.nullif(n, F.lit(0.0)),
        "sample_fraction_in_cluster": a / F.nullif(F.col("cluster_size").cast("double"), F.lit(0.0)),
        "log_fold_change_possig": F.when(enriched, F.col("log_fold_change")),
        "log2fc_smooth": F.log2((a + ALPHA) / F.nullif(s, F.lit(0.0))) - F.log2((b + ALPHA) / F.nullif(n, F.lit(0.0))),
        "minus_log10_fdr": F.when(F.col(fdr).isNotNull(), -F.log10(F.greatest(F.col(fdr), F.lit(FDR_FLOOR)))),
        "support_log": F.log1p(a),
    })
    gain = F.when(F.col("log2fc_smooth").isNotNull(), F.greatest(F.col("log2fc_smooth"), F.lit(0.0)))
    capped = F.when(F.col("minus_log10_fdr").isNotNull(), F.least(F.col("minus_log10_fdr"), F.lit(FDR_CAP)))
    return df.withColumns({"fc_smooth": F.pow(F.lit(2.0), "log2fc_smooth"), "enrichment_support_score": gain * F.col("support_log"), "enrichment_stat_score": gain * F.col("support_log") * capped})


def neighbour_distance(labels: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(cluster_id, name): mean distance of its points to their nearest other point of the list."""
    first = edges.filter("src <> dst").groupBy(F.col("src").alias("point_id")).agg(F.min("dist").alias("d"))
    return labels.join(first, "point_id").groupBy("cluster_id").agg(F.avg("d").alias(name))


def core_distances(edges: DataFrame, k: int = CORE_K) -> DataFrame:
    """(point_id, core): the k-th smallest distance to another point, or the largest if there are fewer."""
    order = Window.partitionBy("src").orderBy("dist", "dst")
    own = edges.filter("src <> dst and dst >= 0").withColumn("i", F.row_number().over(order))
    return own.filter(F.col("i") <= k).groupBy(F.col("src").alias("point_id")).agg(F.max("dist").alias("core"))


def validity(cohesion: Column, separation: Column) -> Column:
    top = F.when(cohesion.isNotNull() & separation.isNotNull(), F.greatest(cohesion, separation))
    return F.when(top > 0, (separation - cohesion) / top).when(top == 0, 0.0)


def reach_edges(labels: DataFrame, edges: DataFrame, k: int = CORE_K) -> DataFrame:
    """(src_cluster, dst_cluster, reach) of edges that leave clustered points; reach: mutual reachability."""
    core = core_distances(edges, k)
    side = lambda e: labels.join(core, "point_id", "left").select(F.col("point_id").alias(e), F.col("cluster_id").alias(f"{e}_cluster"), F.col("core").alias(f"{e}_core"))
    own = edges.filter("src <> dst and dst >= 0").join(side("src"), "src").join(side("dst"), "dst").filter("src_cluster <> -1")
    whole = F.col("src_core").isNotNull() & F.col("dst_core").isNotNull()
    return own.select("src_cluster", "dst_cluster", F.when(whole, F.greatest("src_core", "dst_core", "dist")).alias("reach"))


def geometry(labels: DataFrame, edges: DataFrame, summary: DataFrame | None = None, k: int = CORE_K, fdr: str = "enrichment_fdr_zbinom") -> DataFrame:
    """One row a cluster: edges inside and outside, cohesion, separation, density_validity, geometry_score.

    With a summary also density_validity_enriched_only, over edges between enriched clusters (at least two).
    """
    reach = reach_edges(labels, edges, k)
    stats = _sides(reach)
    df = labels.filter("cluster_id <> -1").select("cluster_id").distinct().join(stats, "cluster_id", "left")
    df = df.withColumns({"internal_edges_n": F.coalesce("internal_edges_n", F.lit(0)), "external_edges_n": F.coalesce("external_edges_n", F.lit(0)), "density_validity": validity(F.col("cohesion"), F.col("separation"))})
    df = df.withColumn("geometry_score", F.when(F.col("density_validity").isNotNull(), F.greatest("density_validity", F.lit(0.0))))
    if summary is None:
        return df
    ids = summary.filter(is_enriched(F.col(fdr), F.col("log_fold_change"), F.col("cluster_id"))).select("cluster_id").distinct()
    inner = reach.join(ids.withColumnRenamed("cluster_id", "src_cluster"), "src_cluster", "left_semi").join(ids.withColumnRenamed("cluster_id", "dst_cluster"), "dst_cluster", "left_semi")
    own = _sides(inner).select("cluster_id", validity(F.col("cohesion"), F.col("separation")).alias("v"))
    finite = own.filter("v is not null").count()
    own = own if finite >= 2 else own.limit(0)
    return df.join(own.withColumnRenamed("v", "density_validity_enriched_only"), "cluster_id", "left")


def _sides(reach: DataFrame) -> DataFrame:
    inside = F.when(F.col("src_cluster") == F.col("dst_cluster"), F.col("reach"))
    outside = F.when(F.col("src_cluster") != F.col("dst_cluster"), F.col("reach"))
    return reach.groupBy(F.col("src_cluster").alias("cluster_id")).agg(
        F.count(inside).alias("internal_edges_n"), F.count(outside).alias("external_edges_n"),
        F.percentile(inside, F.lit(0.9)).alias("cohesion"), F.percentile(outside, F.lit(0.1)).alias("separation"),
    )


def odds_metrics(df: DataFrame) -> DataFrame:
    """log2_odds and dbcv_with_odds; expects counts, totals and density_validity."""
    a, b = F.col("sample").cast("double"), F.col("background").cast("double")
    s, n = F.col("total_sample").cast("double"), F.col("total_background").cast("double")
    odds = F.log2((a + ALPHA) / (s - a + ALPHA)) - F.log2((b + ALPHA) / (n - b + ALPHA))
    df = df.withColumn("log2_odds", odds)
    gate = F.when(a > 0, 1.0).otherwise(0.0)
    score = F.greatest(F.col("density_validity"), F.lit(0.0)) * gate * F.greatest(F.col("log2_odds"), F.lit(0.0)) * F.log1p(a)
    return df.withColumn("dbcv_with_odds", F.when(F.col("density_validity").isNotNull(), score))


def candidate_flags(df: DataFrame, fdr: str = "enrichment_fdr_zbinom") -> DataFrame:
    """Geometry flags (null for noise), auxiliary_validity, and the strict and relaxed candidate rules (false for noise)."""
    inside, outside = F.coalesce("internal_edges_n", F.lit(0)), F.coalesce("external_edges_n", F.lit(0))
    closed = (inside > 0) & (outside == 0)
    dense = F.coalesce(F.col("density_validity") > 0, F.lit(False))
    base = (F.col(fdr) < FDR_LEVEL) & (F.col("log2fc_smooth") > 0) & (F.col("sample") >= LEAST_SAMPLE) & (F.col("cluster_id") != -1)
    real = lambda c: F.when(F.col("cluster_id") != -1, c)
    return df.withColumns({
        "has_density_validity": real((inside > 0) & (outside > 0) & F.col("density_validity").isNotNull()), "is_sample_knn_closed": real(closed),
        "auxiliary_validity": real(F.col("geometry_score") * F.greatest(F.col("log2fc_smooth"), F.lit(0.0)) * F.col("support_log")),
        "is_good_candidate": F.coalesce(base & dense, F.lit(False)), "is_good_candidate_relaxed": F.coalesce(base & (dense | closed), F.lit(False)),
    })
