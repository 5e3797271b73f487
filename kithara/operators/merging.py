"""Clusters that share sequences: merging by equal or nearly equal keys, and Hamming joins."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithara.operators.components import connected_components
from kithara.session import written


def wildcard_keys(sequence: Column, mismatches: int) -> Column:
    """The sequence itself, or with one mismatch all keys of it in which one position is starred.

    Two sequences of equal length differ in at most that many places if and only if they share a key.
    """
    if mismatches == 0:
        return F.array(sequence)
    if mismatches > 1:
        raise ValueError("keys that stand for a link exist for one mismatch at most")
    length = F.length(sequence)
    at = F.sequence(F.lit(1), F.greatest(length, F.lit(1)))
    keys = F.transform(at, lambda i: F.concat(F.substring(sequence, 1, i - 1), F.lit("*"), F.substring(sequence, i + 1, length)))
    return F.when(length == 0, F.array(sequence)).otherwise(keys)


#: Pieces that a sequence is cut into, over those that mismatches can spoil.
SOUND_PIECES = 4


def rare_piece_keys(sequences: DataFrame, mismatches: int, on: str) -> DataFrame:
    """(on, key): keys that two of the distinct sequences share if they have equal length and differ in at most `mismatches` places.

    A sequence is cut into mismatches + SOUND_PIECES pieces of near equal length, of which SOUND_PIECES at least
    agree. All pieces (with place and length) are ranked by how many sequences have them; of two
    sequences that agree in so many, the mismatches + 2 rarest pieces of each have two in common (prefix filtering).
    So each pair of these is a key, and pieces that most sequences have, as their common beginnings and ends, are in none
    unless nothing rarer is left. What shares a key must still be compared.
    """
    length, n = F.length(on), mismatches + SOUND_PIECES
    cut = lambda i: F.floor(length * i / n).cast("int")
    pieces = F.array(*[F.struct(length.alias("length"), F.lit(i).alias("place"), F.substring(on, cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")) for i in range(n)])
    each = sequences.select(on, F.inline(pieces))
    often = written(each.groupBy("length", "place", "piece").agg(F.count("*").alias("n")), "pieces")
    ranked = each.join(often, ["length", "place", "piece"]).groupBy(on, "length").agg(F.array_sort(F.collect_list(F.struct("n", "place", "piece"))).alias("rare"))
    few = F.array_sort(F.transform(F.slice("rare", 1, mismatches + 2), lambda p: F.struct(p["place"].alias("place"), p["piece"].alias("piece"))))
    both = lambda i, j: F.concat_ws("|", "length", F.col("few")[i]["place"], F.col("few")[j]["place"], F.col("few")[i]["piece"], F.col("few")[j]["piece"])
    return ranked.withColumn("few", few).select(on, F.explode(F.array(*[both(i, j) for i, j in combinations(range(mismatches + 2), 2)])).alias("key"))


def hamming(a: Column, b: Column) -> Column:
    """Positions in which two sequences of equal length differ; null for different lengths."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(pairs, F.lit(0), lambda s, x: s + x))


def hamming_join(left: DataFrame, right: DataFrame, mismatches: int = 1, on: str = "sequence") -> DataFrame:
    """(left_seq, right_seq, distance) of distinct sequences of equal length within the mismatches."""
    own = [df.select(F.col(on).alias("seq")).filter(F.col(on).isNotNull()).distinct() for df in (left, right)]
    if mismatches < 2:
        keyed = [df.withColumn("key", F.explode(wildcard_keys(F.col("seq"), mismatches))) for df in own]
    else:  # one order of pieces for both sides
        keys = written(rare_piece_keys(own[0].union(own[1]).distinct(), mismatches, "seq"), "keys")
        keyed = [keys.join(df, "seq", "left_semi") for df in own]
    pairs = keyed[0].withColumnRenamed("seq", "left_seq").join(keyed[1].withColumnRenamed("seq", "right_seq"), "key").select("left_seq", "right_seq").distinct()
    return pairs.withColumn("distance", hamming(F.col("left_seq"), F.col("right_seq"))).filter(F.col("distance") <= mismatches)


def merge_clusters(members: DataFrame, sequence: str, mismatches: int = 0, cluster: str = "cluster_id", source: str | None = None) -> DataFrame:
    """(cluster, merged_cluster_id): clusters joined through shared keys; the id is the least cluster's.

    With `source` only its sample rows join clusters. A cluster links to the least cluster of each key, so
    a key that many clusters share gives one edge each.
    """
    rows = members.filter(F.col(cluster) != -1)
    own = rows if source is None else rows.filter(F.col(source) == "sample")
    own = own.filter(F.col(sequence).isNotNull()).select(F.col(cluster).cast("long").alias("c"), F.col(sequence).alias("sequence"))
    keyed = own.select("c", F.explode(wildcard_keys(F.col("sequence"), min(mismatches, 1))).alias("key")).distinct()
    least = keyed.groupBy("key").agg(F.min("c").alias("m"), F.max("c").alias("x")).filter("m < x").select("key", "m")
    edges = keyed.join(least, "key").filter("c > m").select(F.col("c").alias("src"), F.col("m").alias("dst"))
    if mismatches > 1:  # clusters of one sequence are linked above; sequences farther apart link their least clusters
        first = written(own.groupBy("sequence").agg(F.min("c").alias("c")), "least_clusters")
        pairs = hamming_join(first, first, mismatches).filter("left_seq < right_seq")
        for side in ("left", "right"):
            pairs = pairs.join(first.select(F.col("sequence").alias(f"{side}_seq"), F.col("c").alias(f"{side}_c")), f"{side}_seq")
        edges = edges.unionByName(pairs.select(F.col("left_c").alias("src"), F.col("right_c").alias("dst")))
    found = connected_components(edges)
    ids = rows.select(F.col(cluster).cast("long").alias("node")).distinct()
    return ids.join(found, "node", "left").select(F.col("node").alias(cluster), F.coalesce("root", "node").alias("merged_cluster_id"))


def cluster_usage(members: DataFrame, patients: DataFrame, keys: list[str], cluster: str = "cluster_id", patient: str = "sample_name") -> DataFrame:
    """(cluster, usage): distinct patients that hold a member; patients: long table of keys and patient."""
    own = members.filter(F.col(cluster) != -1).select(cluster, *keys).distinct()
    return own.join(patients.select(*keys, patient).distinct(), keys).groupBy(cluster).agg(F.countDistinct(patient).alias("usage"))
