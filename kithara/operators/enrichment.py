"""Which clusters are enriched in sample over background, by several tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithara.functions import stats
from kithara.functions.text import is_enriched

NOISE = -1
TESTS = ("zbinom", "binom", "fisher")


def cluster_counts(points: DataFrame, by: Sequence[str] = (), cluster: str = "cluster_id", source: str = "source") -> DataFrame:
    """sample, background and cluster_size of each cluster but noise; both columns exist whatever the data."""
    own = lambda s: F.count_if(F.col(source) == s).alias(s)
    counts = points.filter(F.col(cluster) != NOISE).groupBy(*by, cluster).agg(own("sample"), own("background"))
    return counts.withColumn("cluster_size", F.col("sample") + F.col("background"))


def source_totals(points: DataFrame, by: Sequence[str] = (), source: str = "source") -> DataFrame:
    """Totals of all points, noise included."""
    return points.groupBy(*by).agg(F.count_if(F.col(source) == "sample").alias("total_sample"), F.count_if(F.col(source) == "background").alias("total_background"))


def _with_totals(counts: DataFrame, totals: DataFrame, by: Sequence[str]) -> DataFrame:
    if by:
        return counts.join(totals, list(by))
    row = totals.first()
    return counts.withColumns({"total_sample": F.lit(row["total_sample"]), "total_background": F.lit(row["total_background"])})


def enrichment_summary(points: DataFrame, by: Sequence[str] = (), tests: Sequence[str] = ("zbinom",), cluster: str = "cluster_id", source: str = "source") -> DataFrame:
    """Counts, totals, log_fold_change (log10) and, for each test, p-value and q-value of every cluster."""
    df = _with_totals(cluster_counts(points, by, cluster, source), source_totals(points, by, source), by)
    a, b, s, n = (F.col(c) for c in ("sample", "background", "total_sample", "total_background"))
    df = df.withColumn("log_fold_change", stats.log10_fold_change(a, b, s, n))
    for test in tests:
        p, q = f"enrichment_pvalue_{test}", f"enrichment_fdr_{test}"
        if test == "zbinom":
            df = df.withColumn("z", stats.z_binomial(a, b, s, n)).withColumn(p, stats.two_sided_normal("z"))
        elif test == "binom":
            df = df.withColumn(p, stats.binomial_min_tail(a, s, b / n))
        elif test == "fisher":
            df = df.withColumn(p, stats.fisher_greater(a, s - a, b, n - b))
        else:
            raise ValueError(f"unknown test {test!r}; one of {TESTS}")
        df = stats.with_fdr(df, p, q, by, (cluster,))
    return df


def enriched_members(points: DataFrame, summary: DataFrame, by: Sequence[str] = (), test: str = "zbinom", cluster: str = "cluster_id", level: float = 0.05) -> DataFrame:
    """The points of enriched clusters."""
    rule = is_enriched(F.col(f"enrichment_fdr_{test}"), F.col("log_fold_change"), F.col(cluster), level)
    return points.join(summary.filter(rule).select(*by, cluster), [*by, cluster], "left_semi")


def volcano(summary: DataFrame, test: str = "zbinom", level: float = 0.05) -> DataFrame:
    """What a volcano plot shows: log_fold_change, -log10(p + 1e-10), significance."""
    p, q = F.col(f"enrichment_pvalue_{test}"), F.col(f"enrichment_fdr_{test}")
    return summary.select("*", (-F.log10(p + 1e-10)).alias("minus_log10_p"), (q < level).alias("is_significant"))


def significance_line(summary: DataFrame, by: Sequence[str] = (), test: str = "zbinom", level: float = 0.05) -> DataFrame:
    """The largest p-value that is still significant."""
    p = F.when(F.col(f"enrichment_fdr_{test}") < level, F.col(f"enrichment_pvalue_{test}"))
    return summary.groupBy(*by).agg(F.max(p).alias("p_line"))


def evaluation_enrichment(assignments: DataFrame, by: Sequence[str] = ("run_id", "donor_id")) -> DataFrame:
    """The evaluation's own test: P(X >= n), log2FC of fractions, q < 0.05 and log2FC > 0."""
    rows = assignments.withColumn("_c", F.when(F.coalesce(F.col("is_noise"), F.lit(False)), NOISE).otherwise(F.col("cluster_id")))
    own = rows.filter("_c >= 0").groupBy(*by, F.col("_c").alias("cluster_id")).agg(
        F.count_if(F.col("sample_label") == "sample").alias("n_sample"), F.count_if(F.col("sample_label") == "background").alias("n_background")
    )
    totals = rows.groupBy(*by).agg(
        F.count_if(F.col("sample_label") == "sample").alias("total_sample"), F.count_if(F.col("sample_label") == "background").alias("total_background"),
        *[F.min(c).alias(c) for c in ("method", "parameter_json") if c in rows.columns],
    )
    df = own.join(totals, list(by))
    share = lambda n, t: F.when(F.col(t) > 0, F.col(n) / F.col(t)).otherwise(0.0)
    df = df.withColumns({"sample_fraction": share("n_sample", "total_sample"), "background_fraction": share("n_background", "total_background"), "cluster_size": F.col("n_sample") + F.col("n_background")})
    df = df.withColumn("log2FC", F.log2((F.col("sample_fraction") + 1e-9) / (F.col("background_fraction") + 1e-9)))
    df = df.withColumn("p_value", stats.binomial_upper_tail("n_sample", "total_sample", "background_fraction"))
    df = stats.with_fdr(df, "p_value", "q_value", by, ("cluster_id",))
    return df.withColumn("is_significant", is_enriched(F.col("q_value"), F.col("log2FC")))


def summarize_enrichment(enrichment: DataFrame, by: Sequence[str] = ("run_id", "donor_id")) -> DataFrame:
    """One row a run and donor: how many clusters are enriched, by how much, how pure."""
    sig = lambda c: F.when(F.col("is_significant"), F.col(c))
    weight = F.greatest(sig("n_sample"), F.when(F.col("is_significant"), F.lit(1)))
    n = F.count_if("is_significant")
    return enrichment.groupBy(*by).agg(
        F.countDistinct("cluster_id").alias("number_of_proposed_clusters"),
        n.alias("number_of_significant_enriched_clusters"),
        (n / F.greatest(F.countDistinct("cluster_id"), F.lit(1))).alias("fraction_of_significant_clusters"),
        F.coalesce(F.sum(sig("n_sample")), F.lit(0)).alias("number_of_retained_post_vaccination_clonotypes"),
        (F.coalesce(F.sum(sig("n_sample")), F.lit(0)) / F.greatest(F.max("total_sample"), F.lit(1))).alias("retained_fraction"),
        F.coalesce(F.median(sig("log2FC")), F.lit(0.0)).alias("median_log2FC_enriched"),
        F.coalesce(F.max(sig("log2FC")), F.lit(0.0)).alias("max_log2FC_enriched"),
        F.coalesce(F.median(sig("q_value")), F.lit(1.0)).alias("median_q_value_enriched"),
        (F.coalesce(F.sum(sig("n_background")), F.lit(0)) / F.greatest(F.coalesce(F.sum(sig("cluster_size")), F.lit(0)), F.lit(1))).alias("background_contamination"),
        F.coalesce(F.sum(sig("log2FC") * weight) / F.sum(weight), F.lit(0.0)).alias("weighted_enrichment_score"),
    )
