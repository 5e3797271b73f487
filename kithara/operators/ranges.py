"""Order within groups of any size: ranks and running values over sorted ranges, so that no group is gathered in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithara.session import written


def ranked_in_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """df with the rank from 0 of each row in its group's order; no group is gathered in one task.

    Rows are dealt by ranges of group and order; a rank is the place in the range and the rows before it.
    """
    dealt = df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sizes = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_part").alias("_p"), before.alias("_before"))
    local = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1
    same = F.col("_part") == F.col("_p")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    return dealt.withColumn("_local", local).join(starts, same).withColumn(name, F.col("_before") + F.col("_local")).select(*df.columns, name)


#: Rows of a group that one task orders; larger groups are dealt to many.
ONE_TASK = 1_000_000


def largest_group(df: DataFrame, by: Sequence[str]) -> int:
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def fdr_in_ranges(df: DataFrame, p: str, q: str, by: Sequence[str] = (), ties: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q-values of the non-null p within groups of any size.

    A rank is the place in a range and the rows before it; the least of all later ratios is that of
    the rest of the range and of the ranges after it.
    """
    names = ["_part", "_none", "_before", "_n", "_r", "_later"]
    dealt = df.drop(*names).withColumn("_none", F.col(p).isNull()).repartitionByRange(*by, "_none", p, *ties)
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "fdr_ranges")
    sizes = dealt.groupBy(*by, "_part").agg(F.count(p).alias("_k"))
    upto = Window.partitionBy(*by).orderBy("_part")
    sizes = sizes.select(*by, "_part", (F.sum("_k").over(upto) - F.col("_k")).alias("_before"), F.sum("_k").over(Window.partitionBy(*by)).alias("_n"))

    def with_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
        other = parts.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_part").alias("_p"), *[c for c in parts.columns if c not in (*by, "_part")])
        same = F.col("_part") == F.col("_p")
        for c in by:
            same &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        return rows.join(other, same).drop("_p", *[f"_b_{c}" for c in by])

    order = Window.partitionBy(*by, "_part").orderBy("_none", p, *ties)
    rows = with_part(dealt.withColumn("_i", F.row_number().over(order)), written(sizes, "fdr_sizes"))
    rows = written(rows.withColumn("_r", F.col(p) * F.col("_n") / (F.col("_before") + F.col("_i"))), "fdr_ratios")
    after = Window.partitionBy(*by).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    least = rows.groupBy(*by, "_part").agg(F.min("_r").alias("_least"))
    least = written(least.select(*by, "_part", F.min("_least").over(after).alias("_later")), "fdr_later")
    down = Window.partitionBy(*by, "_part").orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    out = with_part(rows, least).withColumn(q, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_r").over(down), F.col("_later"))))
    return out.select(*[c for c in df.columns if c != q], q)


def joined(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """left with the columns of right's row of the same keys, null keys too; without keys right is one row."""
    if not by:
        return left.crossJoin(right)
    right = right.withColumnsRenamed({c: f"_j_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_j_{c}"))
    return left.join(right, same, "left").drop(*[f"_j_{c}" for c in by])


def ranked_values(rows: DataFrame, values: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """(by, _what, _x, _rank, _n): the non-null values of each name with their rank from 0 and their number, in ranges."""
    long = rows.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("_what"), x.cast("double").alias("_x")) for k, x in values.items()]))).filter("_x is not null")
    ranked = written(ranked_in_ranges(long, [*by, "_what"], ["_x"], "_rank"), "ranked_values")
    return joined(ranked, written(ranked.groupBy(*by, "_what").agg(F.count("*").alias("_n")), "value_counts"), [*by, "_what"])


def quantiles(rows: DataFrame, values: Mapping[str, Column], at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, an array for each name): quantiles of the non-null values, linear between neighbours, from groups of any size.

    Only the values at the ranks next to each quantile are picked out; nothing is kept of a group.
    """
    place = [F.lit(q) * (F.col("_n") - 1) for q in at]
    end = lambda r: F.max(F.when(F.col("_rank") == r, F.col("_x")))
    low, high = [end(F.floor(x)) for x in place], [end(F.ceil(x)) for x in place]
    part = [F.max(x - F.floor(x)) for x in place]
    found = ranked_values(rows, values, by).groupBy(*by, "_what").agg(F.array(*[a + (b - a) * t for a, b, t in zip(low, high, part, strict=True)]).alias("_q"))
    found = found.groupBy(*by).agg(*[F.max(F.when(F.col("_what") == k, F.col("_q"))).alias(k) for k in values])
    return joined(rows.select(*by).distinct(), found, by) if by else found
