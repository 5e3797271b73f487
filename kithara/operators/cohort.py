"""Clusters across patients: usage, prevalence tests, ranking."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kithara.functions.stats import fisher_two_sided
from kithara.functions.text import smoothed_ratio
from kithara.operators.ranges import ranked_in_ranges
from kithara.session import written


def patient_lookup(rows: DataFrame, keys: Sequence[str], patient: str = "sample_name") -> DataFrame:
    """Distinct (keys, patient), with trimmed, non-empty keys."""
    clean = rows.select(*[F.nullif(F.trim(F.col(k).cast("string")), F.lit("")).alias(k) for k in keys], patient)
    return clean.na.drop().distinct()


def usage_by_group(members: DataFrame, case: str, control: str, cluster: str = "cluster_id", patient: str = "sample_name", group: str = "sample_group") -> DataFrame:
    """Cluster sizes and how many patients of either group have a member, with the groups' totals."""
    use = lambda g: F.countDistinct(F.when(F.col(group) == g, F.col(patient)))
    df = members.groupBy(cluster).agg(F.count("*").alias("cluster_size"), F.countDistinct(patient).alias("n_samples"), use(case).alias("case_usage"), use(control).alias("control_usage"))
    t = members.agg(use(case).alias("a"), use(control).alias("b")).first()
    return df.withColumns({"total_case": F.lit(max(t["a"], 1)), "total_control": F.lit(max(t["b"], 1))})


def prevalence(usage: DataFrame) -> DataFrame:
    """patient_fc, its logarithm, log_cluster_size and the two-sided Fisher p of case against control usage."""
    a, n, b, m = (F.col(c) for c in ("case_usage", "total_case", "control_usage", "total_control"))
    df = usage.withColumns({"patient_fc": smoothed_ratio(a, n, b, m), "log_cluster_size": F.log10(F.greatest("cluster_size", F.lit(1)))})
    return df.withColumns({"log_patient_fc": F.log10("patient_fc"), "fisher_p": fisher_two_sided(a, n - a, b, m - b)})


def merged_summary(members: DataFrame, case: str = "case", control: str = "control", cluster: str = "merged_cluster_id", patient: str = "sample_name", group: str = "sample_group", source: str = "source", pattern: str = "as_pattern", pgen: str = "pgen") -> DataFrame:
    """One row a merged cluster: sizes, samples, any pattern, mean probability, counts and shares by source, usage and prevalence."""
    usage = usage_by_group(members, case, control, cluster, patient, group)
    from_ = lambda s: F.count_if(F.col(source) == s)
    own = members.groupBy(cluster).agg(
        F.coalesce(F.bool_or(pattern), F.lit(False)).alias("as_pattern"), F.avg(pgen).alias("pgen"), from_("sample").alias("sample"), from_("background").alias("background"),
    )
    df = prevalence(usage).join(own, cluster)
    df = df.withColumns({f"{s}_fraction": F.col(s) / F.greatest("cluster_size", F.lit(1)) for s in ("sample", "background")})
    return log_probability(df.withColumn("n_patients", F.col("n_samples")))


def log_probability(df: DataFrame, column: str = "pgen", floor: float = 1e-16) -> DataFrame:
    """log_pgen of mean generation probabilities; the model that gives them is the user's."""
    return df.withColumn("log_pgen", F.log10(F.when(F.col(column).isNotNull(), F.greatest(F.col(column), F.lit(floor)))))


def sequence_probability(model) -> Callable:
    """A column function from a user's model: a callable from a list of sequences to a list of probabilities."""

    @F.pandas_udf(DoubleType())
    def probability(sequence: pd.Series) -> pd.Series:
        return pd.Series(model(list(sequence)), dtype=float)

    return probability


def clonotype_usage(rows: DataFrame, keys: Sequence[str], patient: str = "sample_name") -> DataFrame:
    """(keys, usage): in how many samples a clonotype occurs."""
    return rows.groupBy(*keys).agg(F.countDistinct(patient).alias("usage"))


def sample_share(members: DataFrame, keys: Sequence[str], cluster: str = "cluster_id", patient: str = "sample_name") -> DataFrame:
    """(cluster, patient, share): which part of a sample's distinct clonotypes lies in the cluster."""
    own = members.select(cluster, patient, *keys).distinct()
    whole = members.select(patient, *keys).distinct().groupBy(patient).agg(F.count("*").alias("_n"))
    return own.groupBy(cluster, patient).agg(F.count("*").alias("_k")).join(whole, patient).select(cluster, patient, (F.col("_k") / F.col("_n")).alias("share"))


def topsis(df: DataFrame, weights: Mapping[str, float], costs: Sequence[str] = (), score: str = "topsis_score", ties: Sequence[str] = ()) -> DataFrame:
    """Closeness to the best of all metrics (min-max scaled, costs turned round), and its rank."""
    total = sum(weights.values())
    df = written(df, "metrics")
    ends = df.agg(*[f(F.col(m).cast("double")).alias(f"{n}_{i}") for i, m in enumerate(weights) for n, f in (("low", F.min), ("high", F.max))]).first()
    best, worst = F.lit(0.0), F.lit(0.0)
    for i, m in enumerate(weights):
        x, low, high, w = F.col(m).cast("double"), ends[f"low_{i}"], ends[f"high_{i}"], weights[m] / total
        varies = low is not None and high > low
        y = (x - low) / (high - low) if varies else F.lit(0.0)
        y = (1 - y if m in costs else y) * w
        top, bottom = (w, 0.0) if varies else (w, w) if m in costs else (0.0, 0.0)
        best, worst = best + (y - top) ** 2, worst + (y - bottom) ** 2
    best, worst = F.sqrt(best), F.sqrt(worst)
    df = df.withColumn(score, F.when(best + worst > 0, worst / (best + worst)).otherwise(0.0))
    ranked = ranked_in_ranges(df.withColumn("_down", -F.col(score)), [], ["_down", *ties], "topsis_rank")
    return ranked.drop("_down").withColumn("topsis_rank", (F.col("topsis_rank") + 1).cast("int"))


def most_supported(records: DataFrame, group: str, keys: Sequence[str]) -> DataFrame:
    """For each group the key of most records, ties by key, with its support."""
    n = records.groupBy(group, *keys).agg(F.count("*").alias("support"))
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("support"), *keys))).filter("_r = 1").drop("_r")


def top_groups(records: DataFrame, group: str, n: int, distinct: Sequence[str] = ()) -> DataFrame:
    """The n groups of most records, or of most distinct keys; ties by name."""
    size = F.countDistinct(*distinct) if distinct else F.count("*")
    return records.groupBy(group).agg(size.alias("support")).orderBy(F.desc("support"), group).limit(n)


def specific_and_public(records: DataFrame, keys: Sequence[str], target: str, study: str, least: int = 2) -> DataFrame:
    """Keys with exactly one target, in at least `least` studies."""
    df = records.groupBy(*keys).agg(F.countDistinct(target).alias("n_targets"), F.countDistinct(study).alias("n_studies"), F.min(target).alias(target))
    return df.filter((F.col("n_targets") == 1) & (F.col("n_studies") >= least)).drop("n_targets")


def public_clusters(members: DataFrame, least: int = 2, cluster: str = "cluster_id", patient: str = "sample_name") -> DataFrame:
    return members.groupBy(cluster).agg(F.countDistinct(patient).alias("n_samples")).filter(F.col("n_samples") >= least)


def normalized_crosstab(rows: DataFrame, row: str, column: str) -> DataFrame:
    """(row, column, n, share) with shares that add up to one within a row."""
    n = rows.groupBy(row, column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def presence_matrix(rows: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """One row for each `row` and a 0/1 column for each of the values."""
    df = rows.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1)))
    return df.select(row, *[(F.coalesce(F.col(f"`{v}`"), F.lit(0)) > 0).cast("int").alias(str(v)) for v in values])


def logo_counts(sequences: DataFrame, sequence: str = "cdr3", by: Sequence[str] = ()) -> DataFrame:
    """(by, position, residue, n): what a sequence logo is drawn from."""
    at = F.posexplode(F.filter(F.split(F.col(sequence), ""), lambda x: x != "")).alias("position", "residue")
    return sequences.select(*by, at).groupBy(*by, "position", "residue").agg(F.count("*").alias("n"))


def recall_of_public(predicted: DataFrame, public: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: public keys found and missed, recall, and their share among clustered keys."""
    p = public.select(*keys).distinct().withColumn("pub", F.lit(True))
    x = predicted.select(*keys).distinct().withColumn("hit", F.lit(True))
    both = p.join(x, list(keys), "full")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    df = both.agg(F.count_if(yes("pub") & yes("hit")).alias("tp"), F.count_if(yes("pub") & ~yes("hit")).alias("fn"), F.count_if(yes("hit")).alias("clustered"))
    return df.withColumns({"recall": F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0)), "public_share": F.coalesce(F.col("tp") / F.nullif(F.col("clustered"), F.lit(0)), F.lit(0.0))})
