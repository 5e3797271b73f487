"""A whole comparison: embeddings of sample and background to enriched clusters."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kithara.operators import cluster_metrics, communities, density, enrichment, knee, knn, reduction
from kithara.session import local_session, written

ALGORITHMS = ("dbscan", "vdbscan", "leiden", "hierarchical_leiden", "leiden_dbscan", "vdbscan_leiden")

#: How radii follow from sorted distances: the polynomial's knee (the chord where it has none), the chord, the spline's bend.
RADIUS_METHODS = {"knee": density.knee_radius, "chord": density.chord_radius, "spline": knee.spline_elbow}


@dataclass(frozen=True)
class Config:
    algorithm: str = "vdbscan"
    k_neighbors: int = 16
    eps_k: int = 4
    core_min_samples: int = 3
    symmetrization: str = "asymmetric"
    components: int = 50
    gamma: float = 1.0
    least_cluster: int = 5
    least_share: float = 0.05
    tests: tuple[str, ...] = ("zbinom",)
    auxiliary: bool = True
    eps: float | None = None
    radius_basis: str = "all"
    resample: bool = False
    radius_method: str = "knee"
    stored_blocks: str | None = None
    background_size: int | None = None

    def __post_init__(self) -> None:
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {self.algorithm!r}; one of {ALGORITHMS}")
        if self.radius_method not in RADIUS_METHODS:
            raise ValueError(f"unknown radius method {self.radius_method!r}; one of {tuple(RADIUS_METHODS)}")
        if self.eps_k > self.k_neighbors:
            raise ValueError("eps_k exceeds k_neighbors")


@dataclass
class Result:
    members: DataFrame
    summary: DataFrame
    enriched: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)


def labels_of(points: DataFrame, edges: DataFrame, config: Config) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(point_id, cluster_id) by the configured algorithm, and the tables it went through."""
    c, more = config, {}
    d = knn.kth_distance(edges, c.eps_k)
    graph = knn.neighbour_graph(edges) if "leiden" in c.algorithm else None
    if c.algorithm.startswith("vdbscan"):
        lengths = points.select("point_id", F.length("cdr3").alias("length"))
        groups = density.length_groups(lengths, c.least_share)
        own = lengths.join(density.nearest_group(lengths, groups), "length").select("point_id", "gid")
        curve = density.of_basis(edges, points, c.eps_k, c.radius_basis).join(own, "point_id")
        radii = RADIUS_METHODS[c.radius_method](density.resampled(curve, ["gid"]) if c.resample else curve, ["gid"])
        radius = written(density.radius_of_points(own, radii), "radius")
        more |= {"length_groups": groups, "radii": radii, "distance_curve": density.distance_curve(d.join(own, "point_id"), ["gid"])}
        labels = density.vdbscan(edges, radius, c.core_min_samples, c.symmetrization)
        if c.algorithm == "vdbscan_leiden":
            labels = communities.vdbscan_leiden(points, written(labels, "vdbscan"), graph, c.gamma)
        return labels, more
    if c.algorithm in ("dbscan", "leiden_dbscan"):
        eps = c.eps if c.eps is not None else RADIUS_METHODS[c.radius_method](d).first()["eps"]
        if c.algorithm == "dbscan":
            return density.dbscan_within(points, eps, c.core_min_samples, edges if c.k_neighbors >= max(c.core_min_samples, 2) else None), more
        return communities.leiden_dbscan(points, graph, gamma=c.gamma, least=c.core_min_samples, radius=eps), more
    run = communities.leiden_clusters if c.algorithm == "leiden" else communities.hierarchical_leiden
    return run(points, graph, c.gamma, least=c.least_cluster), more


def compare(points: DataFrame, config: Config = Config()) -> Result:
    """points: point_id, source (sample or background), embedding, cdr3, and any other columns."""
    if config.background_size is not None:
        points = knn.truncated(points, config.background_size)
    knn.check_finite(points)
    space = written(reduction.reduced(points.select("point_id", "source", "cdr3", "embedding"), config.components), "space")
    lists = knn.nearest(space, space, config.k_neighbors) if config.stored_blocks is None else knn.split_nearest(space, config.k_neighbors, stored=config.stored_blocks)
    edges = written(lists, "edges")
    labels, more = labels_of(space, edges, config)
    labels = written(labels, "labels")
    members = points.drop("cluster_id").join(labels, "point_id")
    summary = written(enrichment.enrichment_summary(members, tests=config.tests), "summary")
    if config.auxiliary and "zbinom" in config.tests:
        inner = edges.join(points.filter("source = 'sample'").select(F.col("point_id").alias("src")), "src", "left_semi")
        inner = inner.join(points.filter("source = 'sample'").select(F.col("point_id").alias("dst")), "dst", "left_semi")
        own = labels.join(points.filter("source = 'sample'").select("point_id"), "point_id", "left_semi")
        full = cluster_metrics.enrichment_metrics(summary).join(cluster_metrics.geometry(own, inner, summary), "cluster_id", "left")
        full = full.join(cluster_metrics.neighbour_distance(own, inner, "sample_nearest_neighbor_distance"), "cluster_id", "left")
        summary = cluster_metrics.candidate_flags(cluster_metrics.odds_metrics(full))
    enriched = enrichment.enriched_members(members, summary, test=config.tests[0])
    return Result(members, summary, enriched, {"edges": edges, **more})


def main(argv: list[str] | None = None) -> None:
    """Command line: compare a parquet table of points and write the three result tables."""
    from kithara.sources.repertoire import write_outputs, write_tables

    p = argparse.ArgumentParser(prog="kithara", description=main.__doc__)
    p.add_argument("points")
    p.add_argument("output")
    p.add_argument("--algorithm", choices=ALGORITHMS, default="vdbscan")
    p.add_argument("--k-neighbors", type=int, default=16)
    p.add_argument("--eps-k", type=int, default=4)
    p.add_argument("--core-min-samples", type=int, default=3)
    p.add_argument("--components", type=int, default=50)
    p.add_argument("--gamma", type=float, default=1.0)
    p.add_argument("--radius-basis", choices=density.BASES, default="all")
    p.add_argument("--radius-method", choices=RADIUS_METHODS, default="knee")
    p.add_argument("--stored-blocks", help="a folder in which neighbour lists within a source are kept between runs")
    p.add_argument("--background-size", type=int, help="take the first so many background points only")
    p.add_argument("--debug-tables", help="a folder for the tables in between")
    a = p.parse_args(argv)
    spark = local_session()
    config = Config(algorithm=a.algorithm, k_neighbors=a.k_neighbors, eps_k=a.eps_k, core_min_samples=a.core_min_samples, components=a.components, gamma=a.gamma, radius_basis=a.radius_basis, radius_method=a.radius_method, stored_blocks=a.stored_blocks, background_size=a.background_size)
    r = compare(spark.read.parquet(a.points), config)
    write_outputs(a.output, r.members.drop("embedding"), r.summary, r.enriched.drop("embedding"))
    if a.debug_tables:
        write_tables(a.debug_tables, r.tables)


if __name__ == "__main__":
    main()
