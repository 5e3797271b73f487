"""Column expressions for sequences, genes, identifiers, labels and parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_column(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """The first candidate that the frame has; an error, or None, if it has none."""
    for c in candidates:
        if c in df.columns:
            return c
    if required:
        raise ValueError(f"none of {list(candidates)} among {df.columns}")
    return None


def normalize_gene(gene: Column) -> Column:
    """First of a comma list, trimmed, without allele, with / as _; a null is empty."""
    first = F.trim(F.split_part(F.coalesce(gene, F.lit("")), F.lit(","), F.lit(1)))
    return F.replace(F.regexp_replace(first, r"\*.*$", ""), F.lit("/"), F.lit("_"))


def trim_allele(gene: Column) -> Column:
    return F.regexp_replace(gene, r"\*.*$", "")


def chain_name(marker: Column) -> Column:
    """alpha or beta from TRA, TRB, alpha, beta or a gene name; else null."""
    m = F.upper(F.trim(marker))
    return F.when(m.startswith("TRB") | (m == "BETA"), "beta").when(m.startswith("TRA") | (m == "ALPHA"), "alpha")


def chain_of_columns(df: DataFrame, default: str = "beta") -> Column:
    """The chain of each row: from a chain or locus column, or else from which chain's columns the table has."""
    for c in ("chain", "locus"):
        if c in df.columns:
            return F.coalesce(chain_name(F.col(f"`{c}`")), F.lit(default))
    if any(c in df.columns for c in BETA_COLUMNS):
        return F.lit("beta")
    return F.lit("alpha" if any(c in df.columns for c in ALPHA_COLUMNS) else default)


#: Columns that only tables of one chain have (fixed values).
BETA_COLUMNS = ("cdr3aa_TRB", "v_TRB", "j_TRB", "TRBV", "TRBJ", "cdr3_beta_aa")
ALPHA_COLUMNS = ("cdr3aa_TRA", "v_TRA", "j_TRA", "TRAV", "TRAJ", "cdr3_alpha_aa")


def source_of_id(clone_id: Column) -> Column:
    """sample or background from the id's prefix; any other id is an error."""
    failed = F.raise_error(F.concat(F.lit("no source in the id "), F.coalesce(clone_id, F.lit("null")))).cast("string")
    return F.when(clone_id.startswith("s_"), "sample").when(clone_id.startswith("b_"), "background").otherwise(failed)


def starts_with_motif(sequence: Column, motif: str) -> Column:
    """Whether a sequence begins with a motif, which may be a pattern such as `CAS[SR]..G`."""
    return F.coalesce(sequence.rlike(f"^(?:{motif})"), F.lit(False))


#: Parts of a tagged run name: what they stand for, and their type (fixed values).
RUN_TAGS = {
    "kn": ("k_neighbors", "int"), "ekn": ("eps_k_neighbors", "int"), "ms": ("cluster_min_samples", "int"), "eps": ("eps_estimation_based_on", "string"),
    "sym": ("vdbscan_sym_rule", "string"), "lr": ("leiden_resolution", "double"), "pc": ("cluster_pc_components", "int"), "test": ("enrichment_test", "string"),
}


def tagged_run(name: Column) -> dict[str, Column]:
    """method and parameters of a name such as `algo_vdbscan__kn_16__lr_0p5`; parts that are missing are null."""
    parts = F.filter(F.split(name, "__"), lambda x: x != "")
    out = {"method": F.regexp_replace(F.try_element_at(parts, F.lit(1)), "^algo_", "")}
    for tag, (column, kind) in RUN_TAGS.items():
        own = F.filter(F.slice(parts, 2, 1000), lambda x: x.startswith(f"{tag}_"))  # noqa: B023
        value = F.substring(F.try_element_at(own, F.lit(1)), len(tag) + 2, 1000)
        out[column] = F.nullif(value, F.lit("")) if kind == "string" else F.replace(value, F.lit("p"), F.lit(".")).try_cast(kind)
    return out


def match_key(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def is_enriched(fdr: Column, lfc: Column, cluster: Column | None = None, level: float = 0.05) -> Column:
    """Strictly below the level and above no change; never for the noise cluster or nulls."""
    rule = (fdr < level) & (lfc > 0)
    return F.coalesce(rule if cluster is None else rule & (cluster != -1), F.lit(False))


def truth_label(padj: Column, threshold: float) -> Column:
    return F.when(padj < threshold, "positive").when(padj.isNotNull(), "negative").otherwise("unlabeled")


def is_alphabetic(sequence: Column) -> Column:
    return F.coalesce(sequence.rlike("^[A-Za-z]+$"), F.lit(False))


def capped(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clipping that keeps nulls."""
    y = x
    if low is not None:
        y = F.when(x.isNotNull(), F.greatest(y, F.lit(low)))
    if high is not None:
        y = F.when(x.isNotNull(), F.least(y, F.lit(high)))
    return y


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; null for 0 / 0 and infinity for other x / 0."""
    return F.when(b != 0, a / b).when(a != 0, F.signum(a.cast("double")) * float("inf"))


def smoothed_ratio(a: Column, n: Column, b: Column, m: Column, pseudo: float = 0.5) -> Column:
    return (a / n + pseudo) / (b / m + pseudo)


def parameters(json: Column, names: Sequence[str]) -> dict[str, Column]:
    """param_* columns from a JSON text; nulls where it does not parse."""
    return {f"param_{n}": F.get_json_object(json, f"$.{n}") for n in names}


def parameter_tag(values: Mapping[str, Column]) -> Column:
    """name-value parts for those that are not null."""
    parts = [F.when(v.isNotNull(), F.concat(F.lit(f"{n}-"), F.replace(v.cast("string"), F.lit("."), F.lit("p")))) for n, v in values.items()]
    return F.concat_ws("_", *parts)


def run_identity(run_id: Column) -> dict[str, Column]:
    """method and dataset of an id `dataset__method__tag`."""
    pattern = r"^(.+?)__([a-z_]+?)(?:__(.*))?$"
    return {k: F.nullif(F.regexp_extract(run_id, pattern, i), F.lit("")) for k, i in (("dataset", 1), ("method", 2), ("tag", 3))}


def split_list(values: Column, by: str = ",") -> Column:
    """Trimmed, non-empty entries of a separated list."""
    return F.filter(F.transform(F.split(F.coalesce(values, F.lit("")), F.lit(by)), lambda x: F.trim(x)), lambda x: x != "")


def has_only_of(values: Column, wanted: str, interest: Sequence[str]) -> Column:
    """Whether a list holds `wanted` and no other entry of the set of interest."""
    kept = F.array_intersect(values, F.array(*map(F.lit, interest)))
    return F.coalesce((F.size(kept) == 1) & F.array_contains(kept, wanted), F.lit(False))


def members_hash(ids: Column) -> Column:
    """An aggregate: SHA-1 of the sorted ids, joined by commas."""
    return F.sha1(F.array_join(F.array_sort(F.collect_list(ids.cast("string"))), ","))


def confusion_category(truth: Column, predicted: Column) -> Column:
    return F.when(truth & predicted, "TP").when(truth, "FN").when(predicted, "FP").otherwise("TN")


def repaired_status(status: Column, error: Column, marks: Mapping[str, str]) -> Column:
    """The status that an error text stands for, where it holds one of the marks."""
    out = status
    for text, becomes in marks.items():
        out = F.when(F.coalesce(error.contains(text), F.lit(False)), becomes).otherwise(out)
    return out


def dominant_values(df: DataFrame, keys: Sequence[str], value: str, k: int = 3) -> DataFrame:
    """For each key the k most frequent values as `a(5);b(2)`, ties by name."""
    from pyspark.sql import Window

    n = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    n = n.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
    text = F.concat(F.col(value), F.lit("("), F.col("n"), F.lit(")"))
    listed = F.array_sort(F.collect_list(F.struct("r", text.alias("t"))))
    return n.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ";").alias(f"top_{value}"))
