"""Density clustering over neighbour lists: length groups, radii, vDBSCAN and DBSCAN.

Labels are numbered from 0 by the least core point of each cluster; noise is -1.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithara.operators.components import connected_components
from kithara.operators.forest import spanning_forest
from kithara.operators.knee import polynomial_radius
from kithara.operators.knn import compared, connecting, first_neighbour_distance, in_groups, k_best, kth_distance, least_reach, lightest, nearest, ranked
from kithara.operators.ranges import ranked_in_ranges
from kithara.session import written


def length_groups(lengths: DataFrame, least_share: float = 0.05, length: str = "length") -> DataFrame:
    """(length, gid): consecutive lengths until a group holds its least share; a rest joins the last group.

    The walk is over distinct lengths, of which sequences have few, so it runs on one array.
    """
    if lengths.filter(F.col(length).isNull()).limit(1).count():
        raise ValueError("a sequence has no length")
    counts = lengths.groupBy(F.col(length).alias("length")).agg(F.count("*").alias("n"))
    sorted_ = F.array_sort(F.collect_list(F.struct("length", "n")))
    whole = counts.agg(sorted_.alias("xs"), F.sum("n").alias("total")).filter("total > 0")
    start = F.struct(F.lit(0).alias("gid"), F.lit(0).cast("long").alias("acc"), F.expr("cast(array() as array<struct<length:long,gid:int>>)").alias("out"))
    need = F.ceil(F.col("total") * least_share)

    def step(s: Column, x: Column) -> Column:
        acc = s["acc"] + x["n"]
        out = F.concat(s["out"], F.array(F.struct(x["length"].cast("long").alias("length"), s["gid"].alias("gid"))))
        closed = acc >= F.col("need")
        return F.struct(F.when(closed, s["gid"] + 1).otherwise(s["gid"]).alias("gid"), F.when(closed, F.lit(0).cast("long")).otherwise(acc).alias("acc"), out.alias("out"))

    whole = whole.withColumn("need", need).withColumn("s", F.aggregate("xs", start, step))
    last = F.greatest(F.when(F.col("s.acc") > 0, F.col("s.gid") - 1).otherwise(F.col("s.gid")), F.lit(0))
    rows = whole.select(F.explode("s.out").alias("x"), last.alias("last"))
    return rows.select("x.length", F.least("x.gid", "last").alias("gid"))


def nearest_group(lengths: DataFrame, groups: DataFrame, length: str = "length") -> DataFrame:
    """(length, gid) for each distinct length: that of the nearest known length, ties to the shorter."""
    own = lengths.select(F.col(length).alias("length")).distinct()
    # Both sides are distinct sequence lengths: tens of rows.
    known = groups.select(F.array_sort(F.collect_list(F.struct("length", "gid")).over(Window.partitionBy())).alias("known")).limit(1)
    pairs = own.join(F.broadcast(known))
    best = F.array_min(F.transform("known", lambda k: F.struct(F.abs(k["length"] - F.col("length")).alias("far"), k["length"].alias("at"), k["gid"].alias("gid"))))
    return pairs.select("length", best["gid"].alias("gid"))


#: Whose distances radii are learned from: sample points among sample points, background among background, or all.
BASES = ("sample", "background", "all")


def of_basis(edges: DataFrame, points: DataFrame, kth: int, basis: str = "all") -> DataFrame:
    """(point_id, d): kth distances (the point itself is the first) of the points of a basis among points of the same basis.

    For `all` they are read off the neighbour lists `edges`. Lists over both sources say too little of one source
    (a point among many of the other has few of its own in its list), so a basis of one source gets lists of
    its own over the embeddings of `points`; every one of its points has a distance if there are kth of them.
    """
    if basis not in BASES:
        raise ValueError(f"basis {basis!r}; one of {BASES}")
    if basis != "all":
        own = written(points.filter(F.col("source") == basis).select("point_id", "embedding"), "basis")
        edges = nearest(own, own, kth)
    return kth_distance(edges, kth)


def resampled(distances: DataFrame, by: Sequence[str] = (), least: int = 20_000, share: float = 0.2, seed: int = 17) -> DataFrame:
    """Distances (by, point_id, d) that a radius may be learned from: of each group `share`, but about `least` where it has them.

    Points are drawn by a seeded hash, so a draw repeats itself.
    """
    sizes = distances.groupBy(*by).agg(F.count("*").alias("_n"))
    own = distances.join(sizes, list(by)) if by else distances.crossJoin(sizes)  # one row without groups
    part = F.greatest(F.lit(float(least)) / F.col("_n"), F.lit(share))
    return own.filter(F.pmod(F.xxhash64("point_id", F.lit(seed)), F.lit(1_000_000)) < part * 1_000_000).drop("_n")


def chord_radius(distances: DataFrame, by: Sequence[str] = (), d: str = "d", least: int = 1) -> DataFrame:
    """(by, eps): the point of the sorted distances that lies farthest above the chord of the curve.

    Ties go to the first. A group of fewer than `least` distances is an error.
    """
    small = distances.groupBy(*by).count().filter(F.col("count") < least).limit(1).count()
    if small:
        raise ValueError(f"a group has fewer than {least} distances")
    x = ranked_in_ranges(distances.select(*by, F.col(d).alias("d")), by, ["d"], "i")
    ends = x.groupBy(*by).agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    x = x.join(ends, list(by)) if by else x.crossJoin(ends)  # one row without groups
    line = F.col("low") + (F.col("high") - F.col("low")) * F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    return x.groupBy(*by).agg(F.max_by("d", F.struct(F.round(F.col("d") - line, 12), -F.col("i"))).alias("eps"))


def knee_radius(distances: DataFrame, by: Sequence[str] = (), d: str = "d", degree: int = 10, sensitivity: float = 1.0, least: int = 1) -> DataFrame:
    """(by, eps): the polynomial knee of each group's sorted distances, or the chord's farthest point where there is no knee."""
    own = written(distances.select(*by, F.col(d).alias("d")), "distances")
    knees = polynomial_radius(own, by, "d", degree, sensitivity).withColumnRenamed("eps", "knee")
    chord = chord_radius(own, by, "d", least)
    if not by:
        chord, knees = chord.withColumn("_all", F.lit(0)), knees.withColumn("_all", F.lit(0))
    on = list(by) or ["_all"]
    return chord.join(knees, on, "left").select(*by, F.coalesce("knee", "eps").alias("eps"))


def distance_curve(distances: DataFrame, by: Sequence[str] = (), d: str = "d") -> DataFrame:
    """The sorted distances of each group with their rank from 1."""
    return ranked_in_ranges(distances, by, [d, "point_id"], "curve_rank").withColumn("curve_rank", (F.col("curve_rank") + 1).cast("int"))


def radius_of_points(groups: DataFrame, radii: DataFrame) -> DataFrame:
    """(point_id, eps) from (point_id, gid) and (gid, eps); a group without a radius is an error."""
    if groups.join(radii, "gid", "left_anti").limit(1).count():
        raise ValueError("a group has no radius")
    return groups.join(radii, "gid").select("point_id", "eps")


def numbered(labels: DataFrame) -> DataFrame:
    """(point_id, cluster_id) from (point_id, root): clusters in order of root, null roots noise."""
    roots = ranked_in_ranges(labels.select("root").filter("root is not null").distinct(), [], ["root"], "cluster_id")
    roots = roots.withColumn("cluster_id", F.col("cluster_id").cast("long"))
    return labels.join(roots, "root", "left").select("point_id", F.coalesce("cluster_id", F.lit(-1).cast("long")).alias("cluster_id"))


RULES = ("asymmetric", "min", "max")


def vdbscan(edges: DataFrame, radius: DataFrame, least: int, rule: str = "asymmetric") -> DataFrame:
    """(point_id, cluster_id) from neighbour lists and a radius (point_id, eps) for each point.

    A point is core if at least `least` listed neighbours, itself included, lie within its radius. Cores
    link along listed edges within the radius of the source, or the smaller or larger of both (`rule`).
    Any other point takes the cluster of the first listed core within whose radius it lies.
    """
    if rule not in RULES:
        raise ValueError(f"rule {rule!r}; one of {RULES}")
    own = edges.join(radius.select(F.col("point_id").alias("src"), F.col("eps").alias("eps_src")), "src")
    cores = own.groupBy("src").agg((F.count_if(F.col("dist") <= F.col("eps_src")) >= least).alias("core")).filter("core")
    cores = written(cores.select(F.col("src").alias("point_id")).join(radius, "point_id"), "cores")
    target = cores.select(F.col("point_id").alias("dst"), F.col("eps").alias("eps_dst"))
    to_core = own.join(target, "dst").filter("src <> dst")
    limit = {"asymmetric": F.col("eps_src"), "min": F.least("eps_src", "eps_dst"), "max": F.greatest("eps_src", "eps_dst")}[rule]
    from_core = to_core.join(cores.select(F.col("point_id").alias("src")), "src", "left_semi")
    found = connected_components(from_core.filter(F.col("dist") <= limit).select("src", "dst"))
    roots = cores.select("point_id").join(found.withColumnRenamed("node", "point_id"), "point_id", "left").select("point_id", F.coalesce("root", "point_id").alias("root"))
    roots = written(roots, "core_roots")
    border = to_core.filter(F.col("dist") <= F.col("eps_dst")).join(cores.select(F.col("point_id").alias("src")), "src", "left_anti")
    border = border.groupBy("src").agg(F.min_by("dst", F.struct("dist", "rank")).alias("dst"))
    border = border.join(roots.select(F.col("point_id").alias("dst"), "root"), "dst").select(F.col("src").alias("point_id"), "root")
    labelled = roots.unionByName(border)
    return numbered(radius.select("point_id").join(labelled, "point_id", "left"))


def dbscan(points: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """(point_id, cluster_id) from all pairs (src, dst, dist) within the radius, self pairs included.

    A point in reach of cores of several clusters takes that of the nearest core, then of the least id.
    """
    cores = pairs.groupBy("src").agg((F.count("*") >= least).alias("core")).filter("core").select(F.col("src").alias("point_id"))
    cores = written(cores, "cores")
    as_ = lambda c: cores.select(F.col("point_id").alias(c))
    to_core = pairs.filter("src <> dst").join(as_("dst"), "dst", "left_semi")
    found = connected_components(to_core.join(as_("src"), "src", "left_semi").select("src", "dst"))
    roots = cores.join(found.withColumnRenamed("node", "point_id"), "point_id", "left").select("point_id", F.coalesce("root", "point_id").alias("root"))
    roots = written(roots, "core_roots")
    border = to_core.join(as_("src"), "src", "left_anti").groupBy("src").agg(F.min_by("dst", F.struct("dist", "dst")).alias("dst"))
    border = border.join(roots.select(F.col("point_id").alias("dst"), "root"), "dst").select(F.col("src").alias("point_id"), "root")
    return numbered(points.select("point_id").join(roots.unionByName(border), "point_id", "left"))


def dbscan_within(points: DataFrame, radius: float, least: int, edges: DataFrame | None = None) -> DataFrame:
    """DBSCAN of the points (point_id, embedding) whose nearest other point is within the radius; all others are noise.

    Labels are those of `dbscan` over all pairs within the radius, but no task writes these, so dense data cost no
    rows that grow with their square: a point is core if its `least`-th neighbour is near enough; of the links of
    cores each block of points keeps no more than connect what they connect; any other point asks for its nearest core.
    edges: neighbour lists of the points with at least `least` (and two) each, if there are any already.
    """
    own = written(points.select("point_id", "embedding"), "points")
    edges = written(nearest(own, own, max(least, 2)), "edges") if edges is None else edges
    close = written(first_neighbour_distance(edges).filter(F.col("d") <= radius).select("point_id"), "close")
    enough = kth_distance(edges, least).filter(F.col("d") <= radius).select("point_id").join(close, "point_id", "left_semi")
    cores = written(own.join(enough, "point_id", "left_semi"), "cores")
    found = connected_components(compared(cores, cores, radius, connecting(radius)))
    roots = cores.select("point_id").join(found.withColumnRenamed("node", "point_id"), "point_id", "left").select("point_id", F.coalesce("root", "point_id").alias("root"))
    roots = written(roots, "core_roots")
    rest = written(own.join(close, "point_id", "left_semi").join(roots, "point_id", "left_anti"), "rest")
    border = nearest(rest, cores, 1).filter(F.col("dist") <= radius)
    border = border.join(roots.select(F.col("point_id").alias("dst"), "root"), "dst").select(F.col("src").alias("point_id"), "root")
    return numbered(points.select("point_id").join(roots.unionByName(border), "point_id", "left"))


def dbscan_in_groups(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(point_id, root) of DBSCAN within each group of points (point_id, embedding, group), by the least core of a cluster; noise is absent.

    Roots are those of `dbscan` over all pairs of a group within the radius, which are not listed: each block of points
    keeps of a point its `least` nearest within its group, and of the links of cores as many as connect what they connect.
    """
    groups = ranked_in_ranges(points.select("group").distinct(), [], ["group"], "_number")
    own = written(points.join(groups, "group").select("point_id", "embedding", "_number"), "points")
    lists = ranked(compared(own, own, radius, in_groups(k_best(least)), weight="_number"), least)
    enough = written(kth_distance(lists, least).filter(F.col("d") <= radius).select("point_id"), "enough")
    cores = written(own.join(enough, "point_id", "left_semi"), "cores")
    found = connected_components(compared(cores, cores, radius, in_groups(connecting(radius)), weight="_number"))
    roots = cores.select("point_id").join(found.withColumnRenamed("node", "point_id"), "point_id", "left").select("point_id", F.coalesce("root", "point_id").alias("root"))
    roots = written(roots, "core_roots")
    rest = written(own.join(roots, "point_id", "left_anti"), "rest")
    border = ranked(compared(rest, cores, radius, in_groups(k_best(1)), weight="_number"), 1).filter(F.col("dist") <= radius)
    border = border.join(roots.select(F.col("point_id").alias("dst"), "root"), "dst").select(F.col("src").alias("point_id"), "root")
    return roots.unionByName(border)


def reach(points: DataFrame, radius: float, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From which radius on, up to the given one, DBSCAN with the prefilter has what: cores (point_id, core_d), a spanning
    forest of the links of cores (a, b, weight), and points (point_id, d) that are in any cluster.

    A point is core from the distance of its `least`-th neighbour on (itself counted) and not before it has a
    neighbour at all; two cores are linked from the largest of their core distances and their own distance on; any
    point belongs to a cluster from where it is core or within reach of a core. Each block of points keeps its own
    spanning forest, and each point its own best core in a block: pairs are not listed.
    """
    own = written(points.select("point_id", "embedding"), "points")
    lists = written(nearest(own, own, max(least, 2)), "lists")
    first = first_neighbour_distance(lists).withColumnRenamed("d", "_first")
    kth = kth_distance(lists, least).join(first, "point_id").select("point_id", F.greatest("d", "_first").alias("core_d")).filter(F.col("core_d") <= radius)
    all_ = written(own.join(kth, "point_id", "left"), "weighted")
    cores = all_.filter("core_d is not null")
    near = compared(all_.fillna({"core_d": 0.0}), cores, radius, least_reach(radius), weight="core_d").select(F.col("src").alias("point_id"), F.col("dist").alias("d"))
    forest = spanning_forest(compared(cores, cores, radius, lightest(radius), weight="core_d").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dist").alias("weight")))
    member = near.unionByName(cores.select("point_id", F.col("core_d").alias("d"))).groupBy("point_id").agg(F.min("d").alias("d"))
    return cores.select("point_id", "core_d"), written(forest, "forest"), member


def noise_by_radius(points: DataFrame, radii: Sequence[float], least: int) -> DataFrame:
    """(eps, n_noise, n_clusters) of DBSCAN with the prefilter for each radius of a sweep.

    One spanning forest serves all radii: at a radius there are as many clusters as cores less links of the forest.
    """
    if not radii:
        raise ValueError("no radius")
    cores, forest, member = reach(points, max(radii), least)
    at = sorted(set(radii))
    step = lambda x: F.size(F.filter(F.array(*map(F.lit, at)), lambda r: r < x))
    kinds = [cores.select(F.lit("core").alias("kind"), step(F.col("core_d")).alias("step")), forest.select(F.lit("link").alias("kind"), step(F.col("weight")).alias("step")), member.select(F.lit("member").alias("kind"), step(F.col("d")).alias("step"))]
    counts = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).groupBy("kind", "step").count().collect()  # radii + 1 rows of each kind
    upto = lambda kind, i: sum(r["count"] for r in counts if r["kind"] == kind and r["step"] <= i)
    total = points.count()
    rows = [(float(r), total - upto("member", at.index(r)), upto("core", at.index(r)) - upto("link", at.index(r))) for r in radii]
    return points.sparkSession.createDataFrame(rows, "eps double, n_noise long, n_clusters long")
