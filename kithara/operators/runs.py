"""Tables over many runs: manifests, metadata, run-level summaries, scores, correlations, selection."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithara.functions.stats import average_rank, percent_rank
from kithara.functions.text import is_enriched, parameter_tag, parameters, safe_ratio
from kithara.operators.ranges import ONE_TASK, joined, largest_group, quantiles, ranked_values
from kithara.session import written

NOISE = -1


def grid(spark: SparkSession, parameters: Mapping[str, Sequence]) -> DataFrame:
    """All combinations of the parameters' values, with parameter_json (sorted keys) and parameter_tag."""
    frame = spark.range(1).drop("id")
    for name, values in parameters.items():
        frame = frame.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    names = sorted(parameters)
    return frame.withColumns({"parameter_json": F.to_json(F.struct(*names)), "parameter_tag": parameter_tag({n: F.col(n) for n in names})})


def manifest(datasets: DataFrame, configs: DataFrame) -> DataFrame:
    """Every dataset with every configuration, with run_id dataset__method__tag."""
    both = datasets.crossJoin(configs)
    return both.withColumn("run_id", F.concat_ws("__", "dataset", "method", "parameter_tag"))


def invalid_configs(configs: DataFrame, k: str = "k_neighbors", kth: str = "eps_k") -> DataFrame:
    """Configurations whose radius needs more neighbours than are listed; their runs end as errors."""
    return configs.filter(F.col(kth) > F.col(k)).withColumns({"status": F.lit("error"), "error_message": F.lit("kth exceeds the number of neighbours")})


def union_tables(tables: Iterable[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def with_run_parameters(rows: DataFrame, names: Sequence[str], json: str = "parameter_json") -> DataFrame:
    """Rows with a param_* column for each name; what does not parse is null."""
    return rows.withColumns(parameters(F.col(json), names))


def in_order(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A left join whose rows come in the order of a column of the left side."""
    return rows.join(lookup, list(keys), "left").orderBy(order)


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key."""
    down = [F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last() for c in order]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*down))).filter("_r = 1").drop("_r")


def by_precedence(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of all sources; for each key the first source that has it wins. One row a key and source is assumed."""
    tagged = [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    return union_tables(tagged).withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("_p"))).filter("_r = 1").drop("_r", "_p")


def best_key_pair(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> tuple[str, str]:
    """The pair of id columns that share most distinct values; the first of equals."""
    counts = [left.select(F.col(a).cast("string").alias("k")).intersect(right.select(F.col(b).cast("string").alias("k"))).filter("k is not null").count() for a, b in pairs]
    return pairs[max(range(len(pairs)), key=lambda i: (counts[i], -i))]


def row_counts_agree(repertoire: DataFrame, embedding: DataFrame) -> None:
    a, b = repertoire.count(), embedding.count()
    if a != b:
        raise ValueError(f"{a} clonotypes and {b} embeddings")


def updated_from(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with the columns taken from the lookup; repeated or missing keys are errors."""
    if lookup.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError("the lookup repeats a key")
    if rows.join(lookup, list(keys), "left_anti").limit(1).count():
        raise ValueError("the lookup misses a key")
    return rows.drop(*columns).join(lookup.select(*keys, *columns), list(keys))


def enriched_flag(fdr: str = "enrichment_fdr_zbinom", lfc: str = "log_fold_change") -> Column:
    return is_enriched(F.col(fdr), F.col(lfc), F.col("cluster_id"))


#: Quantiles of a metric's summary.
QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def _with_quantiles(rows: DataFrame, by: Sequence[str], out: list[Column], asked: dict[str, tuple[Column, dict[str, float]]]) -> DataFrame:
    """rows.groupBy(by).agg(out) and, as name__suffix, the quantiles asked for of each expression.

    An aggregate that holds a group's values serves groups of up to ONE_TASK rows; larger ones go through ranges.
    """
    rows = written(rows, "rows")
    if largest_group(rows, by) <= ONE_TASK:
        return rows.groupBy(*by).agg(*out, *[F.percentile(x.cast("double"), F.lit(q)).alias(f"{n}__{s}") for n, (x, at) in asked.items() for s, q in at.items()])
    every = sorted({q for _, at in asked.values() for q in at.values()})
    found = quantiles(rows, {n: x for n, (x, _) in asked.items()}, every, by)
    found = found.select(*by, *[F.col(n)[every.index(q)].alias(f"{n}__{s}") for n, (_, at) in asked.items() for s, q in at.items()])
    return joined(rows.groupBy(*by).agg(*out), found, by)


def run_level_table(clusters: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("run_id",), fdr: str = "enrichment_fdr_zbinom") -> DataFrame:
    """One row a run: counts, sizes and sample fractions of all and enriched clusters, summaries of metrics.

    The summaries take in the noise row; the counts and contrasts leave it out.
    """
    real = F.col("cluster_id") != NOISE
    rows = clusters.withColumns({"_e": enriched_flag(fdr), "_f": F.col("sample") / F.nullif(F.col("sample") + F.col("background"), F.lit(0))})
    e = lambda c: F.when(F.col("_e"), F.col(c))
    a = lambda c: F.when(real, F.col(c))
    out = [F.count("*").alias("n_clusters_in_summary"), F.count_if(real).alias("n_clusters_total"), F.count_if("_e").alias("n_clusters_enriched")]
    asked = {}
    for name, c in (("cluster_size", "cluster_size"), ("sample_fraction", "_f")):
        for who, pick in (("all", a), ("enriched", e)):
            out.append(F.avg(pick(c)).alias(f"{name}_{who}__mean"))
            asked[f"{name}_{who}"] = (pick(c), {"median": 0.5})
    for flag in ("is_good_candidate", "is_good_candidate_relaxed"):
        if flag in clusters.columns:
            hit = F.coalesce(F.col(flag), F.lit(False))
            stem = "good_candidate" + flag.removeprefix("is_good_candidate")
            out += [F.count_if(hit).alias(f"{stem}_count"), F.avg(hit.cast("double")).alias(f"{stem}_fraction")]
    for m in metrics:
        x = F.col(m).cast("double")
        out += [F.avg(x).alias(f"{m}__mean"), F.max(x).alias(f"{m}__max")]
        asked[m] = (x, QUARTILES)
    return _with_quantiles(rows, by, out, asked)


def density_contrast(clusters: DataFrame, by: Sequence[str] = ("run_id",), fdr: str = "enrichment_fdr_zbinom") -> DataFrame:
    """Mean cohesion, and density as its inverse, of enriched and other clusters, and their ratio."""
    e = enriched_flag(fdr)
    rows = clusters.filter((F.col("cluster_id") != NOISE) & (F.col("cohesion") != 0)).withColumns({"_e": e, "_d": 1 / F.col("cohesion")})
    pick = lambda c, yes: F.avg(F.when(F.col("_e") == yes, F.col(c)))
    df = rows.groupBy(*by).agg(
        pick("cohesion", True).alias("cohesion_enriched__mean"), pick("cohesion", False).alias("cohesion_non_enriched__mean"),
        pick("_d", True).alias("density_proxy_enriched__mean"), pick("_d", False).alias("density_proxy_non_enriched__mean"),
    )
    ratio = F.when(F.col("density_proxy_non_enriched__mean") != 0, F.col("density_proxy_enriched__mean") / F.col("density_proxy_non_enriched__mean"))
    df = clusters.select(*by).distinct().join(df, list(by), "left").withColumn("density_ratio", ratio)
    return df.withColumn("density_log2_ratio", F.when(F.col("density_ratio") > 0, F.log2("density_ratio")))


def dense_score(clusters: DataFrame, group: Sequence[str] = (), run: str = "run_id", fdr: str = "enrichment_fdr_zbinom") -> DataFrame:
    """Run selection score: sample mass of enriched clusters, balance of their sizes, and their fold change.

    Ranks and size limits are taken within each group of runs.
    """
    rows = clusters.filter(F.col("cluster_id") != NOISE).withColumn("_e", enriched_flag(fdr))
    w = F.when(F.col("_e"), F.col("sample").cast("double"))
    df = rows.groupBy(*group, run).agg(
        F.sum(F.col("sample").cast("double")).alias("total_sample"), F.coalesce(F.sum(w), F.lit(0.0)).alias("sample_mass_enriched"),
        F.coalesce(F.sum(F.when(F.col("_e"), (F.col("sample") + F.col("background")).cast("double"))), F.lit(0.0)).alias("cluster_mass_enriched"),
        F.sum(w * w).alias("_w2"), F.sum(w * F.col("log_fold_change")).alias("_wl"), F.sum(F.when(F.col("log_fold_change").isNotNull(), w)).alias("_wt"),
    )
    mass = F.col("sample_mass_enriched")
    n_eff = F.when((mass > 0) & (F.col("_w2") > 0), mass * mass / F.col("_w2"))
    df = df.withColumns({
        "background_mass_enriched": F.col("cluster_mass_enriched") - mass, "sample_coverage_enriched": mass / F.nullif(F.col("total_sample"), F.lit(0.0)),
        "effective_n_enriched_clusters": n_eff, "effective_sample_cluster_size": mass / n_eff, "lfc_sample_weighted": F.when(F.col("_wt") > 0, F.col("_wl") / F.col("_wt")),
    })
    whole = Window.partitionBy(*group)
    size = F.col("effective_sample_cluster_size")
    df = df.withColumns({
        "coverage_rank_pct": percent_rank(mass, group), "lfc_rank_pct": percent_rank(F.col("lfc_sample_weighted"), group),
        "eff_low_threshold": F.when(F.count(size).over(whole) > 0, F.greatest(F.percentile(size, F.lit(0.25)).over(whole), F.lit(2.0))), "eff_high_threshold": F.percentile(size, F.lit(0.75)).over(whole),
    })
    one = F.lit(1.0)
    penalty = F.when(size > 0, F.least(one, size / F.col("eff_low_threshold")) * F.least(one, F.col("eff_high_threshold") / size))
    none = (mass == 0) & (F.col("total_sample") > 0)
    df = df.withColumns({"effective_size_penalty": F.when(none, 0.0).otherwise(penalty), "lfc_rank_pct": F.when(none, 0.0).otherwise(F.col("lfc_rank_pct"))})
    df = df.withColumn("dense_score_base", F.col("coverage_rank_pct") * F.col("effective_size_penalty"))
    df = df.withColumns({"dense_score": F.col("dense_score_base") * F.col("lfc_rank_pct"), "dense_score_soft": F.col("dense_score_base") * (0.5 + 0.5 * F.col("lfc_rank_pct"))})
    return df.drop("_w2", "_wl", "_wt", "total_sample")


def lfc_mass_signed(clusters: DataFrame, by: Sequence[str] = ("run_id",), power: float = 1.5, fdr: str = "enrichment_fdr_zbinom", level: float = 0.05) -> DataFrame:
    """In [-1, 1]: significant gain against loss, weighted by |log fold change| and sample ** power."""
    w = F.abs("log_fold_change") * F.pow(F.col("sample").cast("double"), F.lit(power))
    hit = (F.col(fdr) < level) & (F.col("cluster_id") != NOISE)
    gain, loss = (F.coalesce(F.sum(F.when(hit & c, w)), F.lit(0.0)) for c in (F.col("log_fold_change") > 0, F.col("log_fold_change") < 0))
    df = clusters.groupBy(*by).agg(gain.alias("_g"), loss.alias("_l"))
    return df.select(*by, F.when(F.col("_g") + F.col("_l") > 0, (F.col("_g") - F.col("_l")) / (F.col("_g") + F.col("_l"))).alias("lfc_mass_shift"))


def lfc_mass_share(clusters: DataFrame, by: Sequence[str] = ("run_id",), q: str = "q_value", lfc: str = "log2FC") -> DataFrame:
    """In [0, 1]: the share of positive fold changes, weighted by -log10 q; 0 if there is nothing."""
    w = -F.log10(F.least(F.greatest(F.col(q), F.lit(1e-300)), F.lit(1.0)))
    use = F.col(q).isNotNull() & F.col(lfc).isNotNull()
    up, all_ = F.sum(F.when(use, F.greatest(F.col(lfc), F.lit(0.0)) * w)), F.sum(F.when(use, F.abs(lfc) * w))
    return clusters.groupBy(*by).agg(F.coalesce(up / (all_ + 1e-12), F.lit(0.0)).alias("lfc_mass_share"))


def fragmentation(clusters: DataFrame, by: Sequence[str] = ("run_id",), enriched: str = "is_significant", size: str = "cluster_size") -> DataFrame:
    """Sizes of enriched clusters: median, share of at most 3, largest, and the fragmentation score."""
    x = F.when(F.col(enriched), F.col(size).cast("double"))
    df = clusters.groupBy(*by).agg(
        F.coalesce(F.median(x), F.lit(0.0)).alias("median_enriched_cluster_size"), F.coalesce(F.avg(F.when(x.isNotNull(), (x <= 3).cast("double"))), F.lit(1.0)).alias("fraction_enriched_clusters_size_le_3"),
        F.coalesce(F.max(x), F.lit(0.0)).alias("max_enriched_cluster_size"), F.sum(x).alias("_s"),
    )
    giant = F.col("max_enriched_cluster_size") / F.greatest(F.lit(1.0), F.col("_s"))
    return df.withColumn("fragmentation_score", F.when(F.col("_s").isNull(), 1.0).otherwise(0.5 * F.col("fraction_enriched_clusters_size_le_3") + 0.5 * giant)).drop("_s")


def assignment_proxies(assignments: DataFrame, by: Sequence[str] = ("run_id",)) -> DataFrame:
    """Coverage, entropy, effective number, size variation and singletons of a clustering."""
    real = assignments.filter((F.col("cluster_id") >= 0) & ~F.coalesce("is_noise", F.lit(False)))
    sizes = real.groupBy(*by, "cluster_id").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    df = sizes.groupBy(*by).agg(
        F.sum("n").alias("clustered"), F.count("*").alias("n_clusters"), (-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12))).alias("entropy"), (1 / F.sum(F.col("p") * F.col("p"))).alias("effective_clusters"),
        (F.stddev_samp("n") / F.avg("n")).alias("size_cv"), F.avg((F.col("n") == 1).cast("double")).alias("singleton_cluster_share"),
        (F.count_if(F.col("n") == 1) / F.sum("n")).alias("singleton_point_share"), F.max("p").alias("largest_share"),
    )
    df = df.withColumn("entropy_normalized", F.when(F.col("n_clusters") > 1, F.col("entropy") / F.ln(F.col("n_clusters").cast("double"))).otherwise(0.0))
    totals = assignments.groupBy(*by).agg(F.count("*").alias("points"))
    return totals.join(df, list(by), "left").withColumn("coverage", F.coalesce("clustered", F.lit(0)) / F.col("points"))


def knn_proxies(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how far neighbour lists stay within clusters, over edges to other points."""
    side = lambda e: labels.select(F.col("point_id").alias(e), F.col("cluster_id").alias(f"c_{e}"))
    own = edges.filter("src <> dst").join(side("src"), "src").join(side("dst"), "dst").filter("c_src >= 0")
    same = F.col("c_src") == F.col("c_dst")
    point = own.groupBy("src").agg(F.count_if(same).alias("same"), F.count("*").alias("n"), F.min_by(same, F.struct("dist", "dst")).alias("first"))
    a = point.agg((F.sum("same") / F.sum("n")).alias("same_cluster_edge_share"), F.avg(F.col("first").cast("double")).alias("first_neighbour_agreement"), F.avg("same").alias("mean_same_neighbours"))
    b = own.agg(F.avg(F.when(same, F.col("dist"))).alias("within_distance"), F.avg(F.when(~same, F.col("dist"))).alias("between_distance"))
    return a.crossJoin(b).withColumn("distance_ratio", F.col("within_distance") / F.col("between_distance"))


def proxy_table(assignment: DataFrame, neighbours: DataFrame, runs: DataFrame, keys: Sequence[str] = ("run_id",), columns: Sequence[str] = ("method", "epitope", "f1")) -> DataFrame:
    """Assignment and neighbour proxies of all runs that have either, with the runs' own columns where there are any."""
    own = runs.select(*keys, *columns).distinct()
    return assignment.join(neighbours, list(keys), "full").join(own, list(keys), "left")


def missing_runs(expected: DataFrame, present: DataFrame, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """Expected runs that are not there."""
    return expected.join(present.select(*keys).distinct(), list(keys), "left_anti")


def selected_runs(runs: DataFrame, manifest: DataFrame, mode: str = "all", prefix: str = "") -> DataFrame:
    """Runs whose id has the prefix and whose dataset mode, by their name or by the manifest, is the wanted one.

    A name gives the mode as its first part before `__`.
    """
    runs = runs.filter(F.col("run_id").startswith(prefix))
    if mode == "all":
        return runs
    known = manifest.filter(F.col("dataset_mode") == mode).select("run_id").distinct().withColumn("_known", F.lit(True))
    named = F.split_part(F.col("run_id"), F.lit("__"), F.lit(1)) == mode
    return runs.join(known, "run_id", "left").filter(named | F.coalesce("_known", F.lit(False))).drop("_known")


def metric_correlations(runs: DataFrame, metrics: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, n, pearson, spearman) of each metric with the target; ties at mean ranks."""
    long = unpivoted(runs, [*by, target], metrics).filter(F.col(target).isNotNull())
    keys = [*by, "metric"]
    long = long.withColumns({"_x": average_rank(F.col("value"), keys), "_y": average_rank(F.col(target), keys)})
    return long.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("value", target).alias("pearson"), F.corr("_x", "_y").alias("spearman"))


def unpivoted(df: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """ids, metric, value; null values left out."""
    return df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(ids), list(metrics), "metric", "value").filter("value is not null")


def grid_summary(rows: DataFrame, by: Sequence[str], value: str, collapse: float = 0.0) -> DataFrame:
    """Spread of a score over a grid, and the share of runs at or below `collapse`."""
    x = F.col(value)
    return rows.groupBy(*by).agg(
        F.count(x).alias("n_runs"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.avg((x <= collapse).cast("double")).alias("collapse_rate"), (F.max(x) - F.min(x)).alias("range"),
    )


def best_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group, with best_rank."""
    return rows.withColumn("best_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("best_rank") <= n)


def min_rank(value: str, by: Sequence[str] = ()) -> Column:
    """Rank from the largest; ties share the least rank, nulls come last."""
    return F.rank().over(Window.partitionBy(*by).orderBy(F.desc_nulls_last(value)))


def selection_order() -> list[Column]:
    """How configurations are chosen: mass shift, overlap fold change, retention, then least fragmentation."""
    return [F.desc_nulls_last("lfc_mass_share"), F.desc_nulls_last("overlap_fold_change"), F.desc_nulls_last("retained_fraction"), F.asc_nulls_last("fragmentation_score")]


def trimmed_mean(values: Column, share: float = 0.1) -> Column:
    """An aggregate: the mean without the lowest and highest tenth, from three values on."""
    xs = F.array_sort(F.collect_list(values))
    cut = F.when(F.size(xs) >= 3, F.floor(F.size(xs) * share)).otherwise(0).cast("int")
    kept = F.slice(xs, cut + 1, F.greatest(F.size(xs) - 2 * cut, F.lit(0)))
    return F.when(F.size(xs) > 0, F.aggregate(kept, F.lit(0.0), lambda s, x: s + x) / F.size(kept))


def weighted_mean(value: Column, weight: Column) -> Column:
    both = value.isNotNull() & weight.isNotNull()
    return F.sum(F.when(both, value * weight)) / F.nullif(F.sum(F.when(both, weight)), F.lit(0))


def metric_statistics(clusters: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("run_id",), weight: str = "sample", share: float = 0.1) -> DataFrame:
    """Trimmed and weighted means and the share above 0 of each metric; trimming goes by ranks in ranges where a group is large."""
    clusters = written(clusters.select(*dict.fromkeys([*by, *metrics, weight])), "rows")
    large = largest_group(clusters, by) > ONE_TASK
    out = []
    for m in metrics:
        x = F.col(m).cast("double")
        out += [] if large else [trimmed_mean(x, share).alias(f"{m}__trimmed_mean")]
        out += [weighted_mean(x, F.col(weight).cast("double")).alias(f"{m}__weighted_mean"), F.avg((x > 0).cast("double")).alias(f"{m}__gt0_fraction")]
    df = clusters.groupBy(*by).agg(*out)
    if not large:
        return df
    cut = F.when(F.col("_n") >= 3, F.floor(F.col("_n") * share)).otherwise(0)
    kept = ranked_values(clusters, {m: F.col(m) for m in metrics}, by).filter((F.col("_rank") >= cut) & (F.col("_rank") < F.col("_n") - cut))
    means = kept.groupBy(*by).agg(*[F.avg(F.when(F.col("_what") == m, F.col("_x"))).alias(f"{m}__trimmed_mean") for m in metrics])
    return joined(df, means, by)


def distribution(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and nine quantiles of a value."""
    at = {"min": 0.0, "q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99, "max": 1.0}
    df = _with_quantiles(rows.select(*by, value), by, [F.count(value).alias("n")], {"_q": (F.col(value), at)})
    return df.select(*by, "n", *[F.col(f"_q__{n}").alias(n) for n in at])


def drawn(rows: DataFrame, n: int, key: str, seed: int = 17) -> DataFrame:
    """n rows without replacement, the same for the same seed."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def method_comparison(quality: DataFrame, enrichment: DataFrame, known: DataFrame, keys: Sequence[str] = ("method", "parameter_json")) -> DataFrame:
    """Full join of quality and enrichment means with recovery means where there are any."""
    return quality.join(enrichment, list(keys), "full").join(known, list(keys), "left")


def global_proxies(runs: DataFrame) -> DataFrame:
    """coverage, log10 clusters and throughput of runs with n_points, n_clusters, noise_fraction, runtime_seconds."""
    return runs.withColumns({"coverage": 1 - F.col("noise_fraction"), "log10_clusters": F.log10(F.greatest(F.col("n_clusters"), F.lit(1))), "throughput": safe_ratio(F.col("n_points").cast("double"), F.col("runtime_seconds"))})
