"""Sharding by proportional stratified interleaving.

The rows of each source are shuffled by a seeded hash and ranked; row r of n has the fractional
rank (r + u) / n, where u, between 0 and 1, is the source's own by hash, so that sources of few rows
do not all stand at the same places. All rows are sorted by fractional rank and cut into shards of
equal counts, so each shard holds every source in its share of the whole, give or take a row.

No source is gathered in one task: ranks are prefix sums over hash ranges, positions are prefix
sums over ranges of the fractional rank, and both kinds of ranges hold near equal numbers of rows
whatever the sizes of the sources. How many rows a source has in a range of fractional ranks
follows from its size; only ranges in which it has rows are counted, so many small sources cost no
more than their rows.

Defined results: null sources form a source of their own; the shuffle is by key and `ties`, so rows
of one key, or of a null key, are spread as well; rows that agree in both are alike and stand in any
order; repeated rows are rows of their own; an empty or very long text is a row like any other; an
empty table gives an empty result; input columns named like the added ones are replaced. Law:
`rows`, so equal texts may lie in different shards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithara.session import free_of, written

#: Rows that one range should hold; ranges are not fewer than LEAST. More than MOST only makes ranges longer.
ROWS_A_RANGE, LEAST, MOST = 100_000, 256, 65_536
#: Steps between two ranks.
STEPS = 256


def shard(docs: DataFrame, shards: int = 16, source: str = "source", key: str = "doc_id", seed: int = 11, ties: Sequence[str] | None = None) -> DataFrame:
    """All rows with their columns and shard, slot (place in the shard, from 0).

    ties: the columns that tell rows of one key apart; all columns but maps, if not given.
    """
    docs = free_of(docs, ["shard", "slot", "_src", "_draw", "_range", "_rank", "_u", "_base", "_n", "_part", "_first", "_pos"])
    if ties is None:
        ties = [c for c, t in docs.dtypes if "map<" not in t and c != key]
    total = docs.count()
    ranges = min(MOST, max(LEAST, -(-total // ROWS_A_RANGE)))
    rows = docs.withColumn("_src", F.coalesce(F.col(source).cast("string"), F.lit("␀")))
    rows = rows.withColumn("_draw", F.xxhash64(F.lit(seed), F.col(key).cast("string"), *ties))
    rows = rows.withColumn("_range", F.shiftrightunsigned("_draw", 64 - 16) * ranges)
    rows = rows.withColumn("_range", F.expr("_range div 65536").cast("int"))

    counts = rows.groupBy("_src", "_range").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumns({"_base": F.coalesce(F.sum("n").over(upto), F.lit(0)), "_n": F.sum("n").over(Window.partitionBy("_src"))})
    base = base.withColumn("_u", F.pmod(F.xxhash64(F.lit(seed), "_src"), F.lit(STEPS)))
    base = written(base.select("_src", "_range", "_base", "_n", "_u"), "source_ranges")

    part = f"(({STEPS} * _rank + _u) * {ranges}) div ({STEPS} * _n)"
    # One task holds a hash range of all sources; within it the rows of a source are consecutive ranks.
    order = Window.partitionBy("_range", "_src").orderBy("_draw", F.col(key).cast("string"))
    placed = rows.repartition(F.col("_range")).withColumn("_rank", F.row_number().over(order) - 1)
    placed = placed.join(base, ["_src", "_range"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    placed = placed.withColumn("_part", F.expr(part).cast("int"))

    # The source's ranks in a part begin at the least r with (STEPS r + u) ranges >= STEPS n part.
    first = f"greatest(0, ({STEPS} * _n * (_part + %d) - _u * {ranges} + {STEPS * ranges - 1}) div {STEPS * ranges})"
    sources = base.groupBy("_src").agg(F.max("_n").alias("_n"), F.max("_u").alias("_u"))
    small = sources.filter(F.col("_n") < ranges).withColumn("_rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    small = small.select(F.expr(part).cast("int").alias("_part"), F.lit(1).cast("long").alias("n"))
    large = sources.filter(F.col("_n") >= ranges).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    large = large.select("_part", F.expr(f"least(_n, {first % 1}) - least(_n, {first % 0})").alias("n"))
    parts = small.unionByName(large).groupBy("_part").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most MOST rows
    parts = written(parts.select("_part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_first")), "parts")

    order = Window.partitionBy("_part").orderBy((STEPS * F.col("_rank") + F.col("_u")) / (STEPS * F.col("_n")), "_src", "_rank")
    placed = placed.withColumn("_pos", F.row_number().over(order) - 1)
    placed = placed.join(parts, "_part").withColumn("_pos", F.col("_pos") + F.col("_first"))
    placed = placed.withColumn("shard", F.expr(f"(_pos * {shards}) div {max(total, 1)}").cast("int"))
    placed = placed.withColumn("slot", F.expr(f"_pos - (shard * {total}L + {shards - 1}) div {shards}"))
    return placed.select(*docs.columns, "shard", "slot")
