"""Queries over the driver's tables, one for each operator, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithara.functions import stats, text
from kithara.operators import cluster_metrics, cohort, communities, density, enrichment, evaluation, knee, knn, longitudinal, merging, reduction, runs
from kithara.operators.components import connected_components
from kithara.operators.metric_index import PivotIndex
from kithara.plans import views
from kithara.plans.compare import Config, compare
from kithara.plans.views import ASSIGN_SQL, PARAMS_SQL, PATIENTS_SQL, POINTS_SQL
from kithara.session import written
from kithara.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
RUN = ("run_id", "donor_id")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = _positive_zeros(sql)
        return f

    return add


def _positive_zeros(sql: str) -> str:
    """Every round(...) of the SQL as (0.0 + round(...)), which turns -0 into 0 as `rounded` does."""
    out, at = [], 0
    for m in re.finditer(r"\bround\(", sql):
        end, depth = m.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if m.start() >= at:
            out += [sql[at : m.start()], f"(0.0 + {sql[m.start() : end]})"]
            at = end
    return "".join([*out, sql[at:]])


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal; -0 becomes 0."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- SQL pieces
LOG_BINOM = "lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1)"
#: Two-sided normal tail by its series; from 4 on by its continued fraction.
NORMAL = """CASE WHEN {z} IS NULL THEN NULL WHEN abs({z}) >= 4 THEN 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) /
    list_reduce(list_prepend(abs({z}), list_transform(range(100, 0, -1), lambda k: k::DOUBLE)), lambda f, k: abs({z}) + k / f) WHEN {z} = 0 THEN 1.0 ELSE 2 * (0.5 - exp(-{z} * {z} / 2) / sqrt(2 * pi()) *
    list_sum(list_transform(range(0, 121), lambda k: exp((2 * k + 1) * ln(abs({z})) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1))))) END"""
Z = "CASE WHEN s * (b + 1e-6) * (n - b) > 0 THEN (n * a - s * b) / sqrt(s * (b + 1e-6) * (n - b)) END"
LFC = "log10(((a + 1e-9) / s) / ((b + 1e-9) / n))"


def bh_sql(source: str, p: str, by: str, ties: str, q: str = "q") -> str:
    """source with BH q-values; by and ties are column lists."""
    part = f"PARTITION BY {by}" if by else ""
    return f"""(SELECT * EXCLUDE (r_, i_), least(1.0, min(r_) OVER ({part} ORDER BY {p} DESC, {', '.join(t + ' DESC' for t in ties.split(', '))} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {q}
    FROM (SELECT *, {p} * count({p}) OVER ({part}) / row_number() OVER ({part} ORDER BY {p}, {ties}) AS r_, 0 AS i_ FROM {source}))"""


SUPPLIER_SQL = """cnt AS (SELECT l_suppkey AS cluster_id, count(*) FILTER (l_returnflag = 'R') AS sample, count(*) FILTER (l_returnflag <> 'R') AS background FROM lineitem GROUP BY 1),
 c AS (SELECT *, sample + background AS cluster_size, sample::DOUBLE AS a, background::DOUBLE AS b, (sum(sample) OVER ())::DOUBLE AS s, (sum(background) OVER ())::DOUBLE AS n FROM cnt)"""
#: Enrichment by run and cluster of the assignments.
CLUSTER_SQL = f"""{ASSIGN_SQL},
 tot AS (SELECT run_id, (count(*) FILTER (sample_label = 'sample'))::DOUBLE AS s, (count(*) FILTER (sample_label = 'background'))::DOUBLE AS n FROM assign GROUP BY 1),
 cc AS (SELECT run_id, cluster_id, count(*) FILTER (sample_label = 'sample') AS sample, count(*) FILTER (sample_label = 'background') AS background FROM assign WHERE cluster_id <> -1 GROUP BY 1, 2),
 c0 AS (SELECT cc.*, sample + background AS cluster_size, sample::DOUBLE AS a, background::DOUBLE AS b, s, n FROM cc JOIN tot USING (run_id)),
 c1 AS (SELECT *, {Z} AS z, {LFC} AS lfc FROM c0), c2 AS (SELECT *, {NORMAL.format(z='z')} AS p FROM c1),
 clu AS (SELECT *, coalesce(q < 0.3 AND lfc > 0, false) AS e FROM {bh_sql('c2', 'p', 'run_id', 'cluster_id')})"""
#: The driver's tables carry little signal, so these queries call clusters enriched below this q.
LEVEL = 0.3
#: The evaluation's enrichment by run and donor.
EVAL_SQL = f"""{ASSIGN_SQL},
 et AS (SELECT run_id, donor_id, count(*) FILTER (sample_label = 'sample') AS total_sample, count(*) FILTER (sample_label = 'background') AS total_background, min(method) AS method, min(parameter_json) AS parameter_json FROM assign GROUP BY 1, 2),
 ec AS (SELECT run_id, donor_id, cluster_id, count(*) FILTER (sample_label = 'sample') AS n_sample, count(*) FILTER (sample_label = 'background') AS n_background FROM assign WHERE NOT is_noise GROUP BY 1, 2, 3),
 e0 AS (SELECT *, n_sample / total_sample AS sample_fraction, n_background / total_background AS background_fraction, n_sample + n_background AS cluster_size FROM ec JOIN et USING (run_id, donor_id)),
 e1 AS (SELECT *, log2((sample_fraction + 1e-9) / (background_fraction + 1e-9)) AS log2FC,
   CASE WHEN background_fraction <= 0 THEN CASE WHEN n_sample > 0 THEN 0.0 ELSE 1.0 END ELSE
   list_sum(list_transform(range(n_sample, total_sample + 1), lambda i: exp({LOG_BINOM.format(n='total_sample')} + i * ln(background_fraction) + (total_sample - i) * ln(1 - background_fraction)))) END AS p_value FROM e0),
 ev AS (SELECT *, q_value < 0.5 AND log2FC > 0 AS is_significant FROM {bh_sql('e1', 'p_value', 'run_id, donor_id', 'cluster_id', 'q_value')})"""


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    source = F.when(F.col("l_returnflag") == "R", "sample").otherwise("background")
    return table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("cluster_id"), source.alias("source"), "l_orderkey", "l_linenumber", "l_partkey")


def cluster_table(spark: SparkSession, folder: str) -> DataFrame:
    a = views.assignments(spark, folder).withColumnRenamed("sample_label", "source")
    return enrichment.enrichment_summary(a, ["run_id"])


def donor_enrichment_table(spark: SparkSession, folder: str) -> DataFrame:
    e = enrichment.evaluation_enrichment(views.assignments(spark, folder))
    return e.withColumn("is_significant", text.is_enriched(F.col("q_value"), F.col("log2FC"), level=0.5))


# ---------------------------------------------------------------- enrichment
@query(f"""WITH {SUPPLIER_SQL}, d AS (SELECT *, {Z} AS z FROM c), e AS (SELECT *, {NORMAL.format(z='z')} AS p FROM d)
SELECT cluster_id, sample, background, cluster_size, round({LFC}, 6) AS log_fold_change, round(z, 6) AS z, round(p, 6) AS p, round(q, 6) AS q FROM {bh_sql('e', 'p', '', 'cluster_id')}""")
def enrichment_summary(spark: SparkSession, folder: str) -> DataFrame:
    df = enrichment.enrichment_summary(suppliers(spark, folder))
    return rounded(df.select("cluster_id", "sample", "background", "cluster_size", "log_fold_change", "z", F.col("enrichment_pvalue_zbinom").alias("p"), F.col("enrichment_fdr_zbinom").alias("q")))


@query(f"""WITH {SUPPLIER_SQL}, p AS (SELECT cluster_id, (sample / cluster_size)::DOUBLE AS p FROM c) SELECT cluster_id, round(p, 6) AS p, round(q, 6) AS q FROM {bh_sql('p', 'p', '', 'cluster_id')}""")
def bh_fdr(spark: SparkSession, folder: str) -> DataFrame:
    c = enrichment.cluster_counts(suppliers(spark, folder)).select("cluster_id", (F.col("sample") / F.col("cluster_size")).alias("p"))
    return rounded(stats.with_fdr(c, "p", "q", ties=("cluster_id",)))


@query(f"""WITH {SUPPLIER_SQL} SELECT cluster_id, round(least(1.0, list_sum(list_transform(range(sample, least(cluster_size, s::BIGINT) + 1), lambda i:
  exp(lgamma(cluster_size + 1) - lgamma(i + 1) - lgamma(cluster_size - i + 1) + lgamma(s + n - cluster_size + 1) - lgamma(s - i + 1) - lgamma(n - cluster_size + i + 1) - lgamma(s + n + 1) + lgamma(s + 1) + lgamma(n + 1))))), 6) AS p FROM c""")
def fisher_greater(spark: SparkSession, folder: str) -> DataFrame:
    df = enrichment.enrichment_summary(suppliers(spark, folder), tests=("fisher",))
    return rounded(df.select("cluster_id", F.col("enrichment_pvalue_fisher").alias("p")))


@query(f"""WITH {SUPPLIER_SQL}, t AS (SELECT cluster_id, list_sum(list_transform(range(0, sample + 1), lambda i: exp({LOG_BINOM.format(n='s')} + i * ln(b / n) + (s - i) * ln(1 - b / n)))) AS f FROM c)
SELECT cluster_id, round(least(f, 1 - f), 6) AS p FROM t""")
def binom_min_tail(spark: SparkSession, folder: str) -> DataFrame:
    df = enrichment.enrichment_summary(suppliers(spark, folder), tests=("binom",))
    return rounded(df.select("cluster_id", F.col("enrichment_pvalue_binom").alias("p")))


@query(f"""WITH {CLUSTER_SQL} SELECT run_id, clonotype_id, cluster_id FROM assign JOIN clu USING (run_id, cluster_id) WHERE e""")
def enriched_members(spark: SparkSession, folder: str) -> DataFrame:
    a = views.assignments(spark, folder)
    return enrichment.enriched_members(a, cluster_table(spark, folder), ["run_id"], level=LEVEL).select("run_id", "clonotype_id", "cluster_id")


@query(f"""WITH {CLUSTER_SQL} SELECT run_id, round(max(CASE WHEN q < 0.3 THEN p END), 6) AS p_line FROM clu GROUP BY 1""")
def significance_line(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(enrichment.significance_line(cluster_table(spark, folder), ["run_id"], level=LEVEL))


@query(f"""WITH {CLUSTER_SQL} SELECT run_id, cluster_id, round(-log10(p + 1e-10), 4) AS minus_log10_p, q < 0.3 AS is_significant FROM clu""")
def volcano_frame(spark: SparkSession, folder: str) -> DataFrame:
    v = enrichment.volcano(cluster_table(spark, folder), level=LEVEL)
    return rounded(v.select("run_id", "cluster_id", "minus_log10_p", "is_significant"), 4)


@query(f"""WITH {EVAL_SQL} SELECT run_id, donor_id, cluster_id, n_sample, n_background, total_sample AS total_sample, round(log2FC, 6) AS log2FC, round(p_value, 6) AS p_value, round(q_value, 6) AS q_value, is_significant FROM ev""")
def donor_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    e = donor_enrichment_table(spark, folder)
    return rounded(e.select(*RUN, "cluster_id", "n_sample", "n_background", "total_sample", "log2FC", "p_value", "q_value", "is_significant"))


@query(f"""WITH {EVAL_SQL} SELECT run_id, donor_id, count(DISTINCT cluster_id) AS number_of_proposed_clusters, count(*) FILTER (is_significant) AS number_of_significant_enriched_clusters,
  round(count(*) FILTER (is_significant) / count(DISTINCT cluster_id), 6) AS fraction_of_significant_clusters, coalesce(sum(n_sample) FILTER (is_significant), 0)::BIGINT AS number_of_retained_post_vaccination_clonotypes,
  round(coalesce(sum(n_sample) FILTER (is_significant), 0) / max(total_sample), 6) AS retained_fraction, round(coalesce(median(log2FC) FILTER (is_significant), 0), 6) AS median_log2FC_enriched,
  round(coalesce(max(log2FC) FILTER (is_significant), 0), 6) AS max_log2FC_enriched, round(coalesce(median(q_value) FILTER (is_significant), 1), 6) AS median_q_value_enriched,
  round(coalesce(sum(n_background) FILTER (is_significant), 0) / greatest(coalesce(sum(cluster_size) FILTER (is_significant), 0), 1), 6) AS background_contamination,
  round(coalesce(sum(log2FC * greatest(n_sample, 1)) FILTER (is_significant) / sum(greatest(n_sample, 1)) FILTER (is_significant), 0), 6) AS weighted_enrichment_score FROM ev GROUP BY 1, 2""")
def donor_enrichment_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(enrichment.summarize_enrichment(donor_enrichment_table(spark, folder)))


# ---------------------------------------------------------------- vectors and graphs
@query("""WITH u AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
 m AS (SELECT i, avg(x) AS mu, stddev_pop(x) AS sd FROM u GROUP BY i)
SELECT vec_id AS point_id, i AS dim, round((x - mu) / CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 6) AS x FROM u JOIN m USING (i)""")
def standardize(spark: SparkSession, folder: str) -> DataFrame:
    p = reduction.standardized(views.points(spark, folder))
    return rounded(p.select("point_id", F.posexplode("embedding").alias("dim", "x")).withColumn("dim", F.col("dim").cast("long")))


def _knn_sql(a: str, b: str, k: int) -> str:
    return f"""WITH {POINTS_SQL}, d AS (SELECT q.point_id AS src, p.point_id AS dst, list_distance(q.embedding, p.embedding) AS dist FROM pts q, pts p WHERE {a} AND {b}),
 r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst <> src, dst) - 1 AS rank FROM d) SELECT src, rank, dst, round(dist, 6) AS dist FROM r WHERE rank < {k}"""


@query(_knn_sql("true", "true", 8))
def knn_self(spark: SparkSession, folder: str) -> DataFrame:
    p = views.points(spark, folder)
    return rounded(knn.nearest(p, p, 8)).withColumn("rank", F.col("rank").cast("long"))


@query(_knn_sql("q.source = 'sample'", "p.source = 'background'", 5))
def knn_cross(spark: SparkSession, folder: str) -> DataFrame:
    p = views.points(spark, folder)
    return rounded(knn.nearest(p.filter("source = 'sample'"), p.filter("source = 'background'"), 5)).withColumn("rank", F.col("rank").cast("long"))


@query(_knn_sql("true", "true", 6))
def knn_joint_merge(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(knn.split_nearest(views.points(spark, folder), 6)).withColumn("rank", F.col("rank").cast("long"))


@query(_knn_sql("true", "true", 8))
def knn_self_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of knn_self by way of the pivot index, whatever the size."""
    p = views.points(spark, folder)
    return rounded(PivotIndex(p, ring=128).nearest(p, 8)).withColumn("rank", F.col("rank").cast("long"))


def edges_table(spark: SparkSession, folder: str, k: int = 8) -> DataFrame:
    p = views.points(spark, folder)
    return written(knn.nearest(p, p, k), "edges")


EDGES_SQL = f"""{POINTS_SQL}, dd AS (SELECT q.point_id AS src, p.point_id AS dst, list_distance(q.embedding, p.embedding) AS dist FROM pts q, pts p),
 edg AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst <> src, dst) - 1 AS rank FROM dd) WHERE rank < 8)"""


@query(f"""WITH {EDGES_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(1 / (1 + min(dist)), 6) AS weight FROM edg WHERE src <> dst GROUP BY 1, 2""")
def knn_graph(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(knn.neighbour_graph(edges_table(spark, folder)))


@query(f"""WITH {EDGES_SQL} SELECT len(cdr3) AS length, count(*) AS n, round(avg(dist), 6) AS mean_d, round(median(dist), 6) AS median_d FROM edg JOIN pts ON src = point_id WHERE rank = 5 GROUP BY 1""")
def density_by_length(spark: SparkSession, folder: str) -> DataFrame:
    lengths = views.points(spark, folder).select("point_id", F.length("cdr3").cast("long").alias("length"))
    return rounded(knn.density_by_length(edges_table(spark, folder), lengths))


LENGTH_SQL = """cn AS (SELECT (n_chars // 500)::BIGINT AS length, count(*) AS n FROM documents GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY length) AS i, ceil(sum(n) OVER () * 0.05) AS need FROM cn),
 w(i, length, gid, acc) AS (SELECT i, length, 0, n::DOUBLE FROM o WHERE i = 1
  UNION ALL SELECT o.i, o.length, CASE WHEN acc >= need THEN gid + 1 ELSE gid END, CASE WHEN acc >= need THEN 0 ELSE acc END + n FROM w JOIN o ON o.i = w.i + 1),
 lst AS (SELECT arg_max(gid, i) AS g, arg_max(acc, i) AS acc, (SELECT max(need) FROM o) AS need FROM w),
 grp AS (SELECT length, least(gid, (SELECT greatest(CASE WHEN acc >= need THEN g ELSE g - 1 END, 0) FROM lst)) AS gid FROM w)"""


def document_lengths(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.expr("n_chars div 500").alias("length"))


@query(f"""WITH RECURSIVE {LENGTH_SQL} SELECT length, gid FROM grp""")
def length_groups(spark: SparkSession, folder: str) -> DataFrame:
    return density.length_groups(document_lengths(spark, folder))


@query(f"""WITH RECURSIVE {LENGTH_SQL}, own AS (SELECT DISTINCT (l_partkey % 90)::BIGINT AS length FROM lineitem),
 f AS (SELECT own.length, grp.gid, row_number() OVER (PARTITION BY own.length ORDER BY abs(grp.length - own.length), grp.length) AS r FROM own, grp) SELECT length, gid FROM f WHERE r = 1""")
def nearest_group(spark: SparkSession, folder: str) -> DataFrame:
    groups = density.length_groups(document_lengths(spark, folder))
    return density.nearest_group(table(spark, folder, "lineitem").select((F.col("l_partkey") % 90).alias("length")), groups)


RADIUS_SQL = f"""{EDGES_SQL}, kd AS (SELECT src AS point_id, len(cdr3) % 3 AS gid, dist AS d FROM edg JOIN pts ON src = point_id WHERE rank = 3),
 cv AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY gid) AS n, min(d) OVER (PARTITION BY gid) AS lo, max(d) OVER (PARTITION BY gid) AS hi FROM kd),
 ab AS (SELECT *, row_number() OVER (PARTITION BY gid ORDER BY round(d - (lo + (hi - lo) * i / greatest(n - 1, 1)), 12) DESC, i) AS r FROM cv), eps AS (SELECT gid, d AS eps FROM ab WHERE r = 1)"""


def radius_table(spark: SparkSession, folder: str, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    own = views.points(spark, folder).select("point_id", (F.length("cdr3") % 3).cast("long").alias("gid"))
    radii = density.chord_radius(knn.kth_distance(edges, 4).join(own, "point_id"), ["gid"], least=4)
    return written(radii, "radii"), own


@query(f"""WITH {RADIUS_SQL} SELECT gid, round(eps, 6) AS eps FROM eps""")
def eps_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(radius_table(spark, folder, edges_table(spark, folder))[0])


def _vdbscan_sql(limit: str) -> str:
    return f"""WITH RECURSIVE {RADIUS_SQL}, pe AS (SELECT point_id, eps FROM pts JOIN eps ON len(cdr3) % 3 = gid),
 cr AS (SELECT src AS point_id FROM edg JOIN pe ON src = point_id GROUP BY src HAVING count(*) FILTER (dist <= eps) >= 3),
 lk AS (SELECT src, dst FROM edg JOIN pe a ON a.point_id = src JOIN pe b ON b.point_id = dst WHERE src <> dst AND dist <= {limit} AND src IN (FROM cr) AND dst IN (FROM cr)),
 bo AS (SELECT src AS a, dst AS b FROM lk UNION SELECT dst, src FROM lk),
 re(point_id, root) AS (SELECT point_id, point_id FROM cr UNION SELECT re.point_id, bo.b FROM re JOIN bo ON re.root = bo.a),
 ro AS (SELECT point_id, min(root) AS root FROM re GROUP BY 1),
 br AS (SELECT src AS point_id, arg_min(dst, rank) AS c FROM edg JOIN pe b ON b.point_id = dst WHERE src <> dst AND dist <= b.eps AND dst IN (FROM cr) AND src NOT IN (FROM cr) GROUP BY 1),
 al AS (SELECT * FROM ro UNION ALL SELECT br.point_id, ro.root FROM br JOIN ro ON ro.point_id = br.c)
SELECT pts.point_id, CASE WHEN root IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY root NULLS LAST) - 1 END AS cluster_id FROM pts LEFT JOIN al USING (point_id)"""


def _vdbscan(rule: str, limit: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        edges = edges_table(spark, folder)
        radii, own = radius_table(spark, folder, edges)
        return density.vdbscan(edges, written(density.radius_of_points(own, radii), "radius"), 3, rule)

    run.__name__ = f"vdbscan_{rule}"
    query(_vdbscan_sql(limit))(run)


for _rule, _limit in (("asymmetric", "a.eps"), ("min", "least(a.eps, b.eps)"), ("max", "greatest(a.eps, b.eps)")):
    _vdbscan(_rule, _limit)

DBSCAN_EPS = 1.12


@query(f"""WITH RECURSIVE {POINTS_SQL}, al AS (SELECT q.point_id AS src, p.point_id AS dst, list_distance(q.embedding, p.embedding) AS dist FROM pts q, pts p WHERE list_distance(q.embedding, p.embedding) <= {DBSCAN_EPS}),
 ke AS (SELECT DISTINCT src FROM al WHERE src <> dst), dd AS (SELECT * FROM al WHERE src IN (FROM ke) AND dst IN (FROM ke)),
 cr AS (SELECT src FROM dd GROUP BY src HAVING count(*) >= 3), re(p, r) AS (SELECT src, src FROM cr UNION SELECT re.p, dd.dst FROM re JOIN dd ON re.r = dd.src WHERE dd.dst IN (FROM cr)),
 ro AS (SELECT p AS point_id, min(r) AS root FROM re GROUP BY 1),
 br AS (SELECT src AS point_id, arg_min(dst, (dist, dst)) AS c FROM dd WHERE src <> dst AND dst IN (FROM cr) AND src NOT IN (FROM cr) GROUP BY 1),
 la AS (SELECT * FROM ro UNION ALL SELECT br.point_id, ro.root FROM br JOIN ro ON ro.point_id = br.c)
SELECT pts.point_id, CASE WHEN root IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY root NULLS LAST) - 1 END AS cluster_id FROM pts LEFT JOIN la USING (point_id)""")
def dbscan_prefilter(spark: SparkSession, folder: str) -> DataFrame:
    return density.dbscan_within(views.points(spark, folder), DBSCAN_EPS, 3)


def _merge_sql(key: str) -> str:
    return f"""WITH RECURSIVE mem AS (SELECT p_partkey % 400 AS c, substr(md5((p_partkey % 400 * 7 + p_size % 3)::VARCHAR), 1, 3) AS seq FROM part),
 ky AS (SELECT DISTINCT c, {key} AS k FROM mem), ed AS (SELECT DISTINCT a.c AS a, b.c AS b FROM ky a JOIN ky b USING (k)),
 re(c, r) AS (SELECT DISTINCT c, c FROM mem UNION SELECT re.c, ed.b FROM re JOIN ed ON re.r = ed.a) SELECT c AS cluster_id, min(r) AS merged_cluster_id FROM re GROUP BY 1"""


def sequence_members(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("p_partkey") % 400
    seq = F.substring(F.md5((c * 7 + F.col("p_size") % 3).cast("string")), 1, 3)
    return table(spark, folder, "part").select(c.alias("cluster_id"), seq.alias("sequence"), "p_partkey")


@query(_merge_sql("seq"))
def merge_shared_key(spark: SparkSession, folder: str) -> DataFrame:
    return merging.merge_clusters(sequence_members(spark, folder), "sequence")


@query(_merge_sql("unnest([substr(seq, 1, i - 1) || '*' || substr(seq, i + 1) for i in range(1, len(seq) + 1)])").replace("substr(md5((p_partkey % 400 * 7 + p_size % 3)::VARCHAR), 1, 3)", "substr(md5((p_partkey % 400 * 7 + p_size % 3)::VARCHAR), 1, 5)"))
def merge_hamming1(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("p_partkey") % 400
    rows = table(spark, folder, "part").select(c.alias("cluster_id"), F.substring(F.md5((c * 7 + F.col("p_size") % 3).cast("string")), 1, 5).alias("sequence"))
    return merging.merge_clusters(rows, "sequence", 1)


@query("""WITH s AS (SELECT DISTINCT substr(md5(p_partkey::VARCHAR), 1, 4) AS x FROM part), t AS (SELECT DISTINCT substr(md5(s_suppkey::VARCHAR), 3, 4) AS y FROM supplier)
SELECT x AS left_seq, y AS right_seq, hamming(x, y)::INT AS distance FROM s, t WHERE hamming(x, y) <= 1""")
def hamming_join(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "part").select(F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 4).alias("sequence"))
    b = table(spark, folder, "supplier").select(F.substring(F.md5(F.col("s_suppkey").cast("string")), 3, 4).alias("sequence"))
    return merging.hamming_join(a, b, 1)


# ---------------------------------------------------------------- metrics of clusters
@query(f"""WITH {CLUSTER_SQL}, m AS (SELECT *, log2((a + 0.5) / s) - log2((b + 0.5) / n) AS g, least(-log10(greatest(q, 1e-300)), 50) AS f FROM clu)
SELECT run_id, cluster_id, round(a / s, 6) AS sample_usage, round(b / n, 6) AS background_usage, round(a / cluster_size, 6) AS sample_fraction_in_cluster, round(g, 6) AS log2fc_smooth, round(pow(2, g), 6) AS fc_smooth,
 round(ln(1 + a), 6) AS support_log, round(greatest(g, 0) * ln(1 + a), 6) AS enrichment_support_score, round(greatest(g, 0) * ln(1 + a) * f, 4) AS enrichment_stat_score FROM m""")
def aux_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    df = cluster_metrics.enrichment_metrics(cluster_table(spark, folder))
    six = ["sample_usage", "background_usage", "sample_fraction_in_cluster", "log2fc_smooth", "fc_smooth", "support_log", "enrichment_support_score"]
    return rounded(df.select("run_id", "cluster_id", *six, F.round("enrichment_stat_score", 4).alias("enrichment_stat_score")))


GEO_SQL = f"""{EDGES_SQL}, sp AS (SELECT point_id, cluster_id FROM pts WHERE source = 'sample'), se AS (SELECT src, dst, dist FROM edg WHERE src <> dst AND src IN (SELECT point_id FROM sp) AND dst IN (SELECT point_id FROM sp)),
 co AS (SELECT src AS point_id, max(dist) AS core FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS i FROM se) WHERE i <= 15 GROUP BY 1),
 rc AS (SELECT a.cluster_id AS ca, b.cluster_id AS cb, CASE WHEN x.core IS NOT NULL AND y.core IS NOT NULL THEN greatest(x.core, y.core, dist) END AS reach FROM se JOIN sp a ON a.point_id = src JOIN sp b ON b.point_id = dst LEFT JOIN co x ON x.point_id = src LEFT JOIN co y ON y.point_id = dst),
 ge AS (SELECT ca AS cluster_id, count(reach) FILTER (ca = cb) AS internal_edges_n, count(reach) FILTER (ca <> cb) AS external_edges_n, quantile_cont(reach, 0.9) FILTER (ca = cb) AS cohesion, quantile_cont(reach, 0.1) FILTER (ca <> cb) AS separation FROM rc GROUP BY 1),
 gv AS (SELECT sc.cluster_id, coalesce(internal_edges_n, 0) AS internal_edges_n, coalesce(external_edges_n, 0) AS external_edges_n, cohesion, separation,
   CASE WHEN cohesion IS NOT NULL AND separation IS NOT NULL THEN CASE WHEN greatest(cohesion, separation) > 0 THEN (separation - cohesion) / greatest(cohesion, separation) ELSE 0 END END AS v FROM (SELECT DISTINCT cluster_id FROM sp) sc LEFT JOIN ge USING (cluster_id))"""


def point_summary(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sample labels, edges among sample points, and the clusters' enrichment."""
    p = views.points(spark, folder)
    own = p.filter("source = 'sample'").select("point_id", "cluster_id")
    side = lambda c: own.select(F.col("point_id").alias(c))
    edges = written(edges_table(spark, folder).join(side("src"), "src", "left_semi").join(side("dst"), "dst", "left_semi"), "sample_edges")
    return own, edges, written(enrichment.enrichment_summary(p), "summary")


@query(f"""WITH {GEO_SQL} SELECT cluster_id, internal_edges_n, external_edges_n, round(cohesion, 6) AS cohesion, round(separation, 6) AS separation, round(v, 6) AS density_validity, round(CASE WHEN v IS NOT NULL THEN greatest(v, 0) END, 6) AS geometry_score FROM gv""")
def aux_geometry(spark: SparkSession, folder: str) -> DataFrame:
    own, edges, _ = point_summary(spark, folder)
    return rounded(cluster_metrics.geometry(own, edges))


POINT_CLUSTERS_SQL = f"""{GEO_SQL}, pc AS (SELECT cluster_id, count(*) FILTER (source = 'sample') AS sample, count(*) FILTER (source = 'background') AS background FROM pts GROUP BY 1),
 p0 AS (SELECT *, sample::DOUBLE AS a, background::DOUBLE AS b, (sum(sample) OVER ())::DOUBLE AS s, (sum(background) OVER ())::DOUBLE AS n FROM pc), p1 AS (SELECT *, {Z} AS z, {LFC} AS lfc FROM p0), p2 AS (SELECT *, {NORMAL.format(z='z')} AS p FROM p1),
 pq AS (SELECT *, log2((a + 0.5) / s) - log2((b + 0.5) / n) AS g FROM {bh_sql('p2', 'p', '', 'cluster_id')}),
 od AS (SELECT pq.*, gv.* EXCLUDE (cluster_id), log2((a + 0.5) / (s - a + 0.5)) - log2((b + 0.5) / (n - b + 0.5)) AS log2_odds FROM pq LEFT JOIN gv USING (cluster_id))"""


def candidates_table(spark: SparkSession, folder: str) -> DataFrame:
    own, edges, summary = point_summary(spark, folder)
    df = cluster_metrics.enrichment_metrics(summary).join(cluster_metrics.geometry(own, edges, summary), "cluster_id", "left")
    return cluster_metrics.candidate_flags(cluster_metrics.odds_metrics(df))


@query(f"""WITH {POINT_CLUSTERS_SQL} SELECT cluster_id, round(log2_odds, 6) AS log2_odds, round(CASE WHEN v IS NOT NULL THEN greatest(v, 0) * CASE WHEN a > 0 THEN 1 ELSE 0 END * greatest(log2_odds, 0) * ln(1 + a) END, 6) AS dbcv_with_odds FROM od""")
def aux_odds(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(candidates_table(spark, folder).select("cluster_id", "log2_odds", "dbcv_with_odds"))


@query(f"""WITH {POINT_CLUSTERS_SQL}, f AS (SELECT *, coalesce(internal_edges_n, 0) > 0 AND coalesce(external_edges_n, 0) = 0 AS closed, coalesce(q < 0.05 AND g > 0 AND sample >= 5, false) AS base FROM od)
SELECT cluster_id, closed AS is_sample_knn_closed, base AND coalesce(v > 0, false) AS is_good_candidate, base AND (coalesce(v > 0, false) OR closed) AS is_good_candidate_relaxed, round(CASE WHEN v IS NOT NULL THEN greatest(v, 0) * greatest(g, 0) * ln(1 + a) END, 6) AS auxiliary_validity FROM f""")
def aux_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(candidates_table(spark, folder).select("cluster_id", "is_sample_knn_closed", "is_good_candidate", "is_good_candidate_relaxed", "auxiliary_validity"))


# ---------------------------------------------------------------- evaluation
@query(f"""WITH {ASSIGN_SQL}, x AS (SELECT *, truth_label = 'positive' AS pos, truth_label = 'negative' AS neg FROM assign),
 t AS (SELECT run_id, epitope, count(*) FILTER (pos AND NOT is_noise) AS tp, count(*) FILTER (neg AND NOT is_noise) AS fp, count(*) FILTER (pos AND is_noise) AS fn, count(*) FILTER (pos) AS np, avg(is_noise::INT) AS nf FROM x GROUP BY 1, 2),
 k AS (SELECT run_id, epitope, cluster_id, count(*) FILTER (pos) AS p, count(*) FILTER (neg) AS m FROM x WHERE NOT is_noise GROUP BY 1, 2, 3),
 r AS (SELECT *, row_number() OVER (PARTITION BY run_id, epitope ORDER BY p DESC, cluster_id) AS r FROM k),
 g AS (SELECT run_id, epitope, sum(p + m) AS lab, sum(greatest(p, m)) AS pure, sum(p) FILTER (r <= 1) AS t1, sum(p) FILTER (r <= 5) AS t5, count(*) FILTER (p > 0) AS fr, count(*) AS nc FROM r GROUP BY 1, 2),
 z AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re FROM t JOIN g USING (run_id, epitope))
SELECT run_id, epitope, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, round(pure / greatest(lab, 1), 6) AS weighted_cluster_purity,
 round(t1 / greatest(np, 1), 6) AS positive_cluster_concentration_top1, round(t5 / greatest(np, 1), 6) AS positive_cluster_concentration_top5, fr AS positive_fragmentation, round(fr / greatest(tp, 1), 6) AS positive_fragmentation_norm, nc AS n_clusters, round(nf, 6) AS noise_fraction FROM z""")
def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluation.classification_metrics(views.assignments(spark, folder)))


@query(f"""WITH {EVAL_SQL}, kn AS (SELECT p_partkey AS known_id, p_name AS cdr3, p_brand AS v_gene, p_type AS j_gene FROM part WHERE p_size <= 3),
 rk AS (SELECT *, dense_rank() OVER (PARTITION BY run_id, donor_id ORDER BY round(q_value, 9)) AS rq, dense_rank() OVER (PARTITION BY run_id, donor_id ORDER BY round(log2FC, 9) DESC) AS rl FROM ev),
 mt AS (SELECT 'cdr3_only' AS match_type UNION ALL SELECT 'cdr3_vj'),
 ak AS (SELECT run_id, donor_id, match_type, CASE match_type WHEN 'cdr3_only' THEN cdr3 ELSE cdr3 || '|' || v_gene || '|' || j_gene END AS k, bool_or(sample_label = 'sample') AS post, bool_or(sample_label = 'background') AS pre,
   arg_min(cluster_id, clonotype_id) FILTER (sample_label = 'sample' AND NOT is_noise) AS c FROM assign, mt GROUP BY ALL)
SELECT r.run_id, r.donor_id, known_id, kn.cdr3, mt.match_type, coalesce(post, false) AS is_present_in_post_sample, coalesce(pre, false) AS is_present_in_pre_sample, coalesce(ak.c, -1)::BIGINT AS candidate_cluster_id, rk.rl AS cluster_rank_by_log2FC, coalesce(is_significant, false) AS is_in_significant_cluster
FROM kn, mt, (SELECT DISTINCT run_id, donor_id FROM assign) r LEFT JOIN ak ON ak.run_id = r.run_id AND ak.donor_id = r.donor_id AND ak.match_type = mt.match_type AND ak.k = CASE mt.match_type WHEN 'cdr3_only' THEN kn.cdr3 ELSE kn.cdr3 || '|' || kn.v_gene || '|' || kn.j_gene END
LEFT JOIN rk ON rk.run_id = r.run_id AND rk.donor_id = r.donor_id AND rk.cluster_id = ak.c""")
def known_recovery(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "part").filter("p_size <= 3").select(F.col("p_partkey").alias("known_id"), F.col("p_name").alias("cdr3"), F.col("p_brand").alias("v_gene"), F.col("p_type").alias("j_gene"))
    e = donor_enrichment_table(spark, folder).withColumns({"q_value": F.round("q_value", 9), "log2FC": F.round("log2FC", 9)})
    r = evaluation.known_recovery(views.assignments(spark, folder), e, known)
    return r.select(*RUN, "known_id", "cdr3", "match_type", "is_present_in_post_sample", "is_present_in_pre_sample", "candidate_cluster_id", F.col("cluster_rank_by_log2FC").cast("long").alias("cluster_rank_by_log2FC"), "is_in_significant_cluster")


@query(f"""WITH {EVAL_SQL}, po AS (SELECT method, parameter_json, run_id, donor_id, cdr3 || '|' || v_gene || '|' || j_gene || '|' || chain AS k, bool_or(coalesce(s.is_significant, false)) AS e
   FROM assign LEFT JOIN (SELECT run_id, donor_id, cluster_id, is_significant FROM ev WHERE is_significant) s USING (run_id, donor_id, cluster_id) WHERE sample_label = 'sample' GROUP BY ALL),
 sz AS (SELECT method, parameter_json, run_id, donor_id, count(*) AS n, count(*) FILTER (e) AS m FROM po GROUP BY ALL),
 pr AS (SELECT a.method, a.parameter_json, a.run_id AS ra, a.donor_id AS da, b.run_id AS rb, b.donor_id AS db, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb FROM sz a JOIN sz b USING (method, parameter_json) WHERE a.donor_id < b.donor_id),
 sh AS (SELECT a.method, a.parameter_json, a.run_id AS ra, a.donor_id AS da, b.run_id AS rb, b.donor_id AS db, count(*) AS x, count(*) FILTER (a.e AND b.e) AS y FROM po a JOIN po b USING (method, parameter_json, k) WHERE a.donor_id < b.donor_id GROUP BY ALL),
 f AS (SELECT pr.*, coalesce(x, 0) AS x, coalesce(y, 0) AS y, CASE WHEN na > 0 AND nb > 0 THEN coalesce(x, 0) / least(na, nb) ELSE 0 END AS fx, CASE WHEN ma > 0 AND mb > 0 THEN coalesce(y, 0) / least(ma, mb) ELSE 0 END AS fy FROM pr LEFT JOIN sh USING (method, parameter_json, ra, da, rb, db))
SELECT method, parameter_json, ra AS run_id_a, da AS donor_id_a, rb AS run_id_b, db AS donor_id_b, x AS raw_overlap_count, round(fx, 6) AS raw_overlap_fraction, y AS enriched_overlap_count, round(fy, 6) AS enriched_overlap_fraction, round(CASE WHEN fx > 0 THEN fy / fx ELSE 0 END, 6) AS overlap_fold_change, false AS is_twin_pair FROM f""")
def cross_donor_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluation.cross_donor_overlap(views.assignments(spark, folder), donor_enrichment_table(spark, folder)))


LABELS_SQL = "lb AS (SELECT doc_id, toxic = 1 AS truth, quality = 0 AS predicted, doc_id % 4 AS g FROM labels)"


@query(f"""WITH {LABELS_SQL}, c AS (SELECT g, count(*) FILTER (truth AND predicted) AS tp, count(*) FILTER (NOT truth AND predicted) AS fp, count(*) FILTER (NOT truth AND NOT predicted) AS tn, count(*) FILTER (truth AND NOT predicted) AS fn FROM lb GROUP BY 1),
 d AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM c)
SELECT g, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM d""")
def confusion_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "labels").select((F.col("toxic") == 1).alias("truth"), (F.col("quality") == 0).alias("predicted"), (F.col("doc_id") % 4).alias("g"))
    return rounded(evaluation.confusion(rows, ["g"]))


@query("""WITH pos AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_size < 20), neg AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_size >= 20), x AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_partkey % 2 = 0),
 u AS (SELECT p_name, p_brand, true AS t FROM pos UNION ALL SELECT p_name, p_brand, false FROM neg WHERE (p_name, p_brand) NOT IN (FROM pos)), f AS (SELECT t, (p_name, p_brand) IN (FROM x) AS h FROM u),
 c AS (SELECT count(*) FILTER (t AND h) AS tp, count(*) FILTER (NOT t AND h) AS fp, count(*) FILTER (NOT t AND NOT h) AS tn, count(*) FILTER (t AND NOT h) AS fn FROM f)
SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def confusion_sets(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return rounded(evaluation.key_set_confusion(p.filter("p_partkey % 2 = 0"), p.filter("p_size < 20"), p.filter("p_size >= 20"), ["p_name", "p_brand"]))


@query("""WITH r AS (SELECT l_quantity > 25 AS ta, l_discount > 0.05 AS tb, l_tax > 0.04 AS ha, l_returnflag = 'R' AS hb FROM lineitem),
 s AS (SELECT unnest([{'t': 'alpha', 'h': 'alpha', 'x': ta, 'y': ha}, {'t': 'beta', 'h': 'beta', 'x': tb, 'y': hb}, {'t': 'or', 'h': 'or', 'x': ta OR tb, 'y': ha OR hb}, {'t': 'and', 'h': 'and', 'x': ta AND tb, 'y': ha AND hb}, {'t': 'or', 'h': 'alpha', 'x': ta OR tb, 'y': ha}, {'t': 'or', 'h': 'beta', 'x': ta OR tb, 'y': hb}]) AS q FROM r)
SELECT q.t AS truth_kind, q.h AS hit_kind, count(*) FILTER (q.x AND q.y) AS tp, count(*) FILTER (NOT q.x AND q.y) AS fp, count(*) FILTER (NOT q.x AND NOT q.y) AS tn, count(*) FILTER (q.x AND NOT q.y) AS fn FROM s GROUP BY 1, 2""")
def confusion_paired(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select((F.col("l_quantity") > 25).alias("truth_alpha"), (F.col("l_discount") > 0.05).alias("truth_beta"), (F.col("l_tax") > 0.04).alias("hit_alpha"), (F.col("l_returnflag") == "R").alias("hit_beta"))
    return evaluation.paired_confusion(rows).select("truth_kind", "hit_kind", "tp", "fp", "tn", "fn")


@query("""WITH t AS (SELECT p_name, p_brand, p_type, min(CASE WHEN p_size < 15 THEN 'positive' ELSE 'negative' END) AS tl FROM part WHERE p_size < 40 GROUP BY 1, 2, 3)
SELECT coalesce(tl, 'unlabeled') AS truth_label, count(*) AS n FROM lineitem JOIN part p ON l_partkey = p_partkey LEFT JOIN t USING (p_name, p_brand, p_type) GROUP BY 1""")
def truth_join(spark: SparkSession, folder: str) -> DataFrame:
    truth = table(spark, folder, "part").filter("p_size < 40").select(F.col("p_name").alias("cdr3"), F.col("p_brand").alias("v_gene"), F.col("p_type").alias("j_gene"), F.lit("beta").alias("chain"), F.when(F.col("p_size") < 15, "positive").otherwise("negative").alias("truth_label"))
    return evaluation.with_truth(views.assignments(spark, folder), truth).groupBy("truth_label").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- runs
@query("""SELECT r_name AS dataset, m AS method, k, g AS gamma, '{"gamma":' || g || ',"k":' || k || '}' AS parameter_json, r_name || '__' || m || '__gamma-' || replace(g::VARCHAR, '.', 'p') || '_k-' || k AS run_id
FROM region, (SELECT unnest(['vdbscan', 'leiden']) AS m), (SELECT unnest([5, 10, 15]) AS k), (SELECT unnest([0.5, 1.5]::DOUBLE[]) AS g)""")
def manifest_cross(spark: SparkSession, folder: str) -> DataFrame:
    g = runs.grid(spark, {"k": [5, 10, 15], "gamma": [0.5, 1.5]}).withColumn("method", F.explode(F.array(F.lit("vdbscan"), F.lit("leiden"))))
    d = table(spark, folder, "region").select(F.col("r_name").alias("dataset"))
    return runs.manifest(d, g).select("dataset", "method", "k", "gamma", "parameter_json", "run_id")


@query(f"""WITH {PARAMS_SQL} SELECT user_id, event_id, method, round(score, 6) AS score FROM par QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def metadata_latest(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.latest(views.parameter_runs(spark, folder), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "method", "score"))


def _summaries_sql(columns: dict[str, str]) -> str:
    return ", ".join(f"round(avg({x}), 6) AS {c}__mean, round(median({x}), 6) AS {c}__median, round(max({x}), 6) AS {c}__max, round(quantile_cont({x}, 0.25), 6) AS {c}__q25, round(quantile_cont({x}, 0.75), 6) AS {c}__q75" for c, x in columns.items())


def level_table(spark: SparkSession, folder: str) -> DataFrame:
    """Clusters with q-values scaled, so that the default level of 0.05 stands for LEVEL."""
    return cluster_table(spark, folder).withColumn("enrichment_fdr_zbinom", F.col("enrichment_fdr_zbinom") * (0.05 / LEVEL))


@query(f"""WITH {CLUSTER_SQL} SELECT run_id, count(*) AS n_clusters_in_summary, count(*) AS n_clusters_total, count(*) FILTER (e) AS n_clusters_enriched, round(avg(cluster_size), 6) AS cluster_size_all__mean, round(median(cluster_size), 6) AS cluster_size_all__median,
 round(avg(cluster_size) FILTER (e), 6) AS cluster_size_enriched__mean, round(median(cluster_size) FILTER (e), 6) AS cluster_size_enriched__median, round(avg(a / (a + b)), 6) AS sample_fraction_all__mean, round(median(a / (a + b)), 6) AS sample_fraction_all__median,
 round(avg(a / (a + b)) FILTER (e), 6) AS sample_fraction_enriched__mean, round(median(a / (a + b)) FILTER (e), 6) AS sample_fraction_enriched__median, {_summaries_sql({'log_fold_change': 'lfc', 'sample': 'a'})} FROM clu GROUP BY 1""")
def run_level_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.run_level_table(level_table(spark, folder), ["log_fold_change", "sample"]))


@query(f"""WITH {CLUSTER_SQL}, d AS (SELECT run_id, e, z * z + 1 AS c FROM clu), f AS (SELECT run_id, avg(c) FILTER (e) AS a, avg(c) FILTER (NOT e) AS b, avg(1 / c) FILTER (e) AS x, avg(1 / c) FILTER (NOT e) AS y FROM d GROUP BY 1)
SELECT run_id, round(a, 4) AS cohesion_enriched__mean, round(b, 4) AS cohesion_non_enriched__mean, round(x, 4) AS density_proxy_enriched__mean, round(y, 4) AS density_proxy_non_enriched__mean, round(x / y, 4) AS density_ratio, round(log2(x / y), 4) AS density_log2_ratio FROM f""")
def density_contrast(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.density_contrast(level_table(spark, folder).withColumn("cohesion", F.col("z") * F.col("z") + 1)), 4)


def _avg_rank(x: str, part: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER ({part} ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY {(part.replace('PARTITION BY ', '') + ', ') if part else ''}{x}) - 1) / 2) / count({x}) OVER ({part}) END"


@query(f"""WITH {CLUSTER_SQL}, m AS (SELECT run_id, substr(run_id, 5)::INT % 2 AS g, sum(a) AS t, coalesce(sum(a) FILTER (e), 0) AS mass, sum(a * a) FILTER (e) AS w2, sum(a * lfc) FILTER (e) / sum(a) FILTER (e) AS lw FROM clu GROUP BY 1),
 s AS (SELECT *, CASE WHEN mass > 0 THEN w2 / mass END AS sz FROM m),
 r AS (SELECT *, {_avg_rank('mass', 'PARTITION BY g')} AS cov, {_avg_rank('lw', 'PARTITION BY g')} AS lr, greatest(quantile_cont(sz, 0.25) OVER (PARTITION BY g), 2) AS lo, quantile_cont(sz, 0.75) OVER (PARTITION BY g) AS hi FROM s),
 p AS (SELECT *, CASE WHEN mass = 0 AND t > 0 THEN 0 ELSE least(1, sz / lo) * least(1, hi / sz) END AS pen, CASE WHEN mass = 0 AND t > 0 THEN 0 ELSE lr END AS lr2 FROM r)
SELECT run_id, round(mass, 6) AS sample_mass_enriched, round(cov, 6) AS coverage_rank_pct, round(sz, 6) AS effective_sample_cluster_size, round(pen, 6) AS effective_size_penalty, round(lr2, 6) AS lfc_rank_pct, round(cov * pen, 6) AS dense_score_base, round(cov * pen * lr2, 6) AS dense_score, round(cov * pen * (0.5 + 0.5 * lr2), 6) AS dense_score_soft FROM p""")
def dense_score(spark: SparkSession, folder: str) -> DataFrame:
    t = level_table(spark, folder).withColumn("g", F.substring("run_id", 5, 9).cast("int") % 2)
    d = runs.dense_score(t, ["g"])
    return rounded(d.select("run_id", "sample_mass_enriched", "coverage_rank_pct", "effective_sample_cluster_size", "effective_size_penalty", "lfc_rank_pct", "dense_score_base", "dense_score", "dense_score_soft"))


@query(f"""WITH {CLUSTER_SQL}, w AS (SELECT run_id, q < 0.3 AS h, lfc, abs(lfc) * pow(a, 1.5) AS w FROM clu), g AS (SELECT run_id, coalesce(sum(w) FILTER (h AND lfc > 0), 0) AS u, coalesce(sum(w) FILTER (h AND lfc < 0), 0) AS d FROM w GROUP BY 1)
SELECT run_id, round(CASE WHEN u + d > 0 THEN (u - d) / (u + d) END, 6) AS lfc_mass_shift FROM g""")
def lfc_mass_signed(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.lfc_mass_signed(level_table(spark, folder)))


@query(f"""WITH {EVAL_SQL}, w AS (SELECT run_id, donor_id, log2FC AS l, -log10(least(greatest(q_value, 1e-300), 1)) AS w FROM ev) SELECT run_id, donor_id, round(sum(greatest(l, 0) * w) / (sum(abs(l) * w) + 1e-12), 4) AS lfc_mass_share FROM w GROUP BY 1, 2""")
def lfc_mass_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.lfc_mass_share(donor_enrichment_table(spark, folder), RUN), 4)


FRAG_SQL = """coalesce(median(cluster_size) FILTER (is_significant), 0) AS med, coalesce(avg((cluster_size <= 3)::INT) FILTER (is_significant), 1) AS tiny, coalesce(max(cluster_size) FILTER (is_significant), 0) AS big, sum(cluster_size) FILTER (is_significant) AS tot"""


@query(f"""WITH {EVAL_SQL}, f AS (SELECT run_id, donor_id, {FRAG_SQL} FROM ev GROUP BY 1, 2) SELECT run_id, donor_id, round(med, 6) AS median_enriched_cluster_size, round(tiny, 6) AS fraction_enriched_clusters_size_le_3, round(big::DOUBLE, 6) AS max_enriched_cluster_size,
 round(CASE WHEN tot IS NULL THEN 1 ELSE 0.5 * tiny + 0.5 * big / greatest(1, tot) END, 6) AS fragmentation_score FROM f""")
def fragmentation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.fragmentation(donor_enrichment_table(spark, folder), RUN))


@query(f"""WITH {ASSIGN_SQL}, z AS (SELECT run_id, cluster_id, count(*) AS n FROM assign WHERE NOT is_noise GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY run_id) AS p FROM z),
 g AS (SELECT run_id, sum(n)::BIGINT AS clustered, count(*) AS n_clusters, -sum(p * ln(p + 1e-12)) AS entropy, 1 / sum(p * p) AS eff, stddev_samp(n) / avg(n) AS cv, avg((n = 1)::INT) AS sc, count(*) FILTER (n = 1) / sum(n) AS sp, max(p) AS lg FROM p GROUP BY 1), t AS (SELECT run_id, count(*) AS points FROM assign GROUP BY 1)
SELECT run_id, points, clustered, n_clusters, round(entropy, 6) AS entropy, round(eff, 6) AS effective_clusters, round(cv, 6) AS size_cv, round(sc, 6) AS singleton_cluster_share, round(sp, 6) AS singleton_point_share, round(lg, 6) AS largest_share, round(entropy / ln(n_clusters), 6) AS entropy_normalized, round(clustered / points, 6) AS coverage FROM g JOIN t USING (run_id)""")
def assignment_proxies(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.assignment_proxies(views.assignments(spark, folder)))


@query(f"""WITH {EDGES_SQL}, e AS (SELECT src, dst, dist, a.cluster_id = b.cluster_id AS same FROM edg JOIN pts a ON a.point_id = src JOIN pts b ON b.point_id = dst WHERE src <> dst),
 p AS (SELECT src, count(*) FILTER (same) AS s, count(*) AS n, arg_min(same, (dist, dst)) AS f FROM e GROUP BY 1)
SELECT round((SELECT sum(s) / sum(n) FROM p), 6) AS same_cluster_edge_share, round((SELECT avg(f::INT) FROM p), 6) AS first_neighbour_agreement, round((SELECT avg(s) FROM p), 6) AS mean_same_neighbours, round(avg(dist) FILTER (same), 6) AS within_distance, round(avg(dist) FILTER (NOT same), 6) AS between_distance, round(avg(dist) FILTER (same) / avg(dist) FILTER (NOT same), 6) AS distance_ratio FROM e""")
def knn_proxies(spark: SparkSession, folder: str) -> DataFrame:
    labels = views.points(spark, folder).select("point_id", "cluster_id")
    return rounded(runs.knn_proxies(labels, edges_table(spark, folder)))


@query(f"""WITH {CLUSTER_SQL}, u AS (SELECT cluster_size AS y, metric, value FROM (SELECT cluster_size::DOUBLE AS cluster_size, a AS sample, b AS background FROM clu) UNPIVOT (value FOR metric IN (sample, background))),
 r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2 AS rx, rank() OVER (PARTITION BY metric ORDER BY y) + (count(*) OVER (PARTITION BY metric, y) - 1) / 2 AS ry FROM u)
SELECT metric, count(*) AS n, round(corr(value, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY 1""")
def metric_correlations(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.metric_correlations(cluster_table(spark, folder), ["sample", "background"], "cluster_size"))


@query(f"""WITH {PARAMS_SQL} SELECT method, count(score) AS n_runs, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(stddev_samp(score), 6) AS std, min(score) AS min, max(score) AS max, round(avg((score <= 1)::INT), 6) AS collapse_rate, round(max(score) - min(score), 6) AS range FROM par GROUP BY 1""")
def grid_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.grid_summary(views.parameter_runs(spark, folder), ["method"], "score", 1.0))


@query(f"""WITH {PARAMS_SQL} SELECT method, k, event_id, score, row_number() OVER (PARTITION BY method, k ORDER BY score DESC, event_id)::INT AS best_rank FROM par QUALIFY best_rank <= 2""")
def best_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return runs.best_per_group(views.parameter_runs(spark, folder), ["method", "k"], [F.desc("score"), F.asc("event_id")], 2).select("method", "k", "event_id", "score", "best_rank")


@query(f"""WITH {PARAMS_SQL}, g AS (SELECT method, k, round(avg(score), 6) AS s FROM par GROUP BY 1, 2) SELECT method, k, s, rank() OVER (PARTITION BY method ORDER BY s DESC NULLS LAST)::INT AS r FROM g""")
def rank_min_desc(spark: SparkSession, folder: str) -> DataFrame:
    g = views.parameter_runs(spark, folder).groupBy("method", "k").agg(F.round(F.avg("score"), 6).alias("s"))
    return g.withColumn("r", runs.min_rank("s", ["method"]))


@query(f"""WITH {PARAMS_SQL}, x AS (SELECT method, list(score ORDER BY score) AS xs, avg((score > 0)::INT) AS g, sum(score * k::DOUBLE) / sum(k::DOUBLE) AS w FROM par GROUP BY 1), y AS (SELECT *, xs[floor(0.1 * len(xs))::INT + 1 : len(xs) - floor(0.1 * len(xs))::INT] AS t FROM x)
SELECT method, round(list_sum(t) / len(t), 6) AS score__trimmed_mean, round(w, 6) AS score__weighted_mean, round(g, 6) AS score__gt0_fraction FROM y""")
def metric_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.metric_statistics(views.parameter_runs(spark, folder), ["score"], ["method"], "k"))


@query("""SELECT event_type, count(value) AS n, round(min(value), 6) AS min, """ + ", ".join(f"round(quantile_cont(value, {v}), 6) AS {k}" for k, v in (("q01", 0.01), ("q05", 0.05), ("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q95", 0.95), ("q99", 0.99))) + """, round(max(value), 6) AS max FROM events GROUP BY 1""")
def distribution(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.distribution(table(spark, folder, "events"), "value", ["event_type"]))


@query("""SELECT c_custkey FROM customer ORDER BY md5('17|' || c_custkey), c_custkey LIMIT 40""")
def sample_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return runs.drawn(table(spark, folder, "customer").select("c_custkey"), 40, "c_custkey")


@query(f"""WITH {EVAL_SQL}, e AS (SELECT method, parameter_json, avg(log2FC) AS mean_log2fc FROM ev GROUP BY 1, 2), q AS (SELECT method, parameter_json, avg((truth_label = 'positive')::INT) AS positive_share FROM assign WHERE run_id <> 'run_2' GROUP BY 1, 2), k AS (SELECT method, parameter_json, avg((p_size <= 3)::INT) AS known_share FROM assign WHERE run_id <> 'run_3' GROUP BY 1, 2)
SELECT method, parameter_json, round(positive_share, 6) AS positive_share, round(mean_log2fc, 6) AS mean_log2fc, round(known_share, 6) AS known_share FROM q FULL JOIN e USING (method, parameter_json) LEFT JOIN k USING (method, parameter_json)""")
def method_comparison(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["method", "parameter_json"]
    a = views.assignments(spark, folder)
    q = a.filter("run_id <> 'run_2'").groupBy(*keys).agg(F.avg((F.col("truth_label") == "positive").cast("int")).alias("positive_share"))
    e = donor_enrichment_table(spark, folder).groupBy(*keys).agg(F.avg("log2FC").alias("mean_log2fc"))
    k = a.filter("run_id <> 'run_3'").groupBy(*keys).agg(F.avg((F.col("p_size") <= 3).cast("int")).alias("known_share"))
    return rounded(runs.method_comparison(q, e, k))


@query(f"""WITH {PARAMS_SQL}, a AS (SELECT method, k, 1 AS p, round(avg(score), 6) AS f1 FROM par WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT method, k, 2 AS p, round(avg(score), 6) AS f1 FROM par GROUP BY 1, 2) SELECT method, k, f1 FROM (FROM a UNION ALL FROM b) QUALIFY row_number() OVER (PARTITION BY method, k ORDER BY p) = 1""")
def source_precedence(spark: SparkSession, folder: str) -> DataFrame:
    p = views.parameter_runs(spark, folder)
    mean = lambda df: df.groupBy("method", "k").agg(F.round(F.avg("score"), 6).alias("f1"))
    return runs.by_precedence([mean(p.filter("event_id % 2 = 0")), mean(p)], ["method", "k"])


# ---------------------------------------------------------------- longitudinal
MATCH_SQL = f"""{EVAL_SQL}, ref AS (SELECT p_name AS cdr3, p_brand AS v_gene, p_type AS j_gene, 'E' || p_size AS epitope FROM part WHERE p_size <= 3),
 vj AS (SELECT cdr3, v_gene, j_gene, array_to_string(list_sort(list_distinct(list(epitope))), ';') AS ev_ FROM ref GROUP BY 1, 2, 3), sq AS (SELECT cdr3, array_to_string(list_sort(list_distinct(list(epitope))), ';') AS es_ FROM ref GROUP BY 1),
 mat AS (SELECT assign.*, es_ IS NOT NULL AS has_match, CASE WHEN ev_ IS NOT NULL THEN 'cdr3_vj' WHEN es_ IS NOT NULL THEN 'cdr3_only' END AS match_type, coalesce(ev_, es_) AS epitopes, coalesce(sg.is_significant, false) AND NOT is_noise AS en
   FROM assign LEFT JOIN vj USING (cdr3, v_gene, j_gene) LEFT JOIN sq USING (cdr3) LEFT JOIN (SELECT run_id, donor_id, cluster_id, is_significant FROM ev WHERE is_significant) sg USING (run_id, donor_id, cluster_id))"""


def matches_table(spark: SparkSession, folder: str) -> DataFrame:
    ref = table(spark, folder, "part").filter("p_size <= 3").select(F.col("p_name").alias("cdr3"), F.col("p_brand").alias("v_gene"), F.col("p_type").alias("j_gene"), F.concat(F.lit("E"), "p_size").alias("epitope"))
    return longitudinal.reference_matches(views.assignments(spark, folder), ref, donor_enrichment_table(spark, folder))


@query(f"""WITH {MATCH_SQL} SELECT clonotype_id, has_match, match_type, epitopes, en AS is_enriched_clonotype FROM mat""")
def reference_matches(spark: SparkSession, folder: str) -> DataFrame:
    return matches_table(spark, folder).select("clonotype_id", "has_match", "match_type", "epitopes", "is_enriched_clonotype")


DONOR_SQL = f"""{MATCH_SQL}, pn AS (SELECT run_id, donor_id, count(DISTINCT clonotype_id) FILTER (sample_label = 'sample') AS ns, count(DISTINCT clonotype_id) FILTER (sample_label = 'sample' AND has_match) AS nm, count(DISTINCT clonotype_id) FILTER (sample_label = 'sample' AND has_match AND en) AS ne FROM mat GROUP BY 1, 2),
 wm AS (SELECT DISTINCT run_id, donor_id, cluster_id, true AS m FROM mat WHERE has_match AND cluster_id >= 0),
 cl AS (SELECT run_id, donor_id, count(*) AS nc, count(*) FILTER (is_significant) AS nec, count(*) FILTER (m) AS ncm, count(*) FILTER (m AND is_significant) AS necm, coalesce(sum(n_sample) FILTER (is_significant), 0) AS ret, coalesce(median(log2FC) FILTER (is_significant), 0) AS ml,
   sum(greatest(log2FC, 0) * -log10(least(greatest(q_value, 1e-300), 1))) / (sum(abs(log2FC) * -log10(least(greatest(q_value, 1e-300), 1))) + 1e-12) AS share, {FRAG_SQL} FROM ev LEFT JOIN wm USING (run_id, donor_id, cluster_id) GROUP BY 1, 2),
 don AS (SELECT *, ret / greatest(ns, 1) AS retained, ne / greatest(nm, 1) AS recov, CASE WHEN tot IS NULL THEN 1 ELSE 0.5 * tiny + 0.5 * big / greatest(1, tot) END AS frag FROM cl JOIN pn USING (run_id, donor_id))"""


@query(f"""WITH {DONOR_SQL} SELECT run_id, donor_id, nc AS n_candidate_clusters, nec AS n_enriched_clusters, ncm AS n_clusters_with_match, necm AS n_enriched_clusters_with_match, ns AS n_sample_clonotypes, nm AS n_matches_in_post, ne AS n_matches_in_enriched_clonotypes,
 round(retained, 6) AS retained_fraction, round(recov, 6) AS fraction_matches_recovered, round(ml, 6) AS median_enriched_log2fc, round(share, 4) AS lfc_mass_share, round(frag, 6) AS fragmentation_score FROM don""")
def longitudinal_summary(spark: SparkSession, folder: str) -> DataFrame:
    d = longitudinal.donor_run_summary(matches_table(spark, folder), donor_enrichment_table(spark, folder))
    d = d.withColumn("lfc_mass_share", F.round("lfc_mass_share", 4))
    return rounded(d.select(*RUN, "n_candidate_clusters", "n_enriched_clusters", "n_clusters_with_match", "n_enriched_clusters_with_match", "n_sample_clonotypes", "n_matches_in_post", "n_matches_in_enriched_clonotypes", "retained_fraction", "fraction_matches_recovered", "median_enriched_log2fc", "lfc_mass_share", "fragmentation_score"))


@query(f"""WITH {DONOR_SQL}, md AS (SELECT run_id, count(*) AS n_donors, round(median(retained), 6) AS retained_fraction, round(median(share), 4) AS lfc_mass_share, round(median(frag), 6) AS fragmentation_score FROM don GROUP BY 1) SELECT * FROM md""")
def config_medians(spark: SparkSession, folder: str) -> DataFrame:
    d = longitudinal.donor_run_summary(matches_table(spark, folder), donor_enrichment_table(spark, folder))
    m = longitudinal.config_medians(d, ["retained_fraction", "lfc_mass_share", "fragmentation_score"])
    return rounded(m.withColumn("lfc_mass_share", F.round("lfc_mass_share", 4)))


@query(f"""WITH {DONOR_SQL}, md AS (SELECT run_id, round(median(retained), 4) AS retained_fraction, round(median(frag), 4) AS fragmentation_score FROM don GROUP BY 1), u AS (FROM md UNPIVOT (value FOR metric IN (retained_fraction, fragmentation_score)))
SELECT metric, run_id, value FROM u QUALIFY row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'fragmentation_score' THEN -value ELSE value END DESC, run_id) = 1""")
def best_by_metric(spark: SparkSession, folder: str) -> DataFrame:
    d = longitudinal.donor_run_summary(matches_table(spark, folder), donor_enrichment_table(spark, folder))
    m = rounded(longitudinal.config_medians(d, ["retained_fraction", "fragmentation_score"]), 4)
    return longitudinal.best_by_metric(m, ["retained_fraction", "fragmentation_score"], ["fragmentation_score"])


# ---------------------------------------------------------------- cohort
USAGE_SQL = f"""{PATIENTS_SQL}, us AS (SELECT cluster_id, count(*) AS cluster_size, count(DISTINCT sample_name) AS n_samples, count(DISTINCT sample_name) FILTER (seg = 'BUILDING') AS a, count(DISTINCT sample_name) FILTER (seg <> 'BUILDING') AS b FROM pat GROUP BY 1),
 tt AS (SELECT count(DISTINCT sample_name) FILTER (seg = 'BUILDING') AS n, count(DISTINCT sample_name) FILTER (seg <> 'BUILDING') AS m FROM pat), uu AS (SELECT * FROM us, tt)"""


@query(f"""WITH {USAGE_SQL} SELECT cluster_id, cluster_size, n_samples, a AS case_usage, b AS control_usage, n AS total_case, m AS total_control FROM uu""")
def cohort_usage(spark: SparkSession, folder: str) -> DataFrame:
    u = cohort.usage_by_group(views.patients(spark, folder), "case", "control")
    return u.withColumns({c: F.col(c).cast("long") for c in ("total_case", "total_control")})


@query(f"""WITH {USAGE_SQL}, h AS (SELECT *, a + b AS k, list_transform(range(greatest(0, a + b - m), least(a + b, n) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(n + m - a - b + 1) - lgamma(n - i + 1) - lgamma(m - a - b + i + 1) - lgamma(n + m + 1) + lgamma(n + 1) + lgamma(m + 1))) AS ps FROM uu)
SELECT cluster_id, round((a / n + 0.5) / (b / m + 0.5), 6) AS patient_fc, round(log10((a / n + 0.5) / (b / m + 0.5)), 6) AS log_patient_fc, round(log10(cluster_size), 6) AS log_cluster_size,
 round(least(1, list_sum(list_filter(ps, lambda p: p <= ps[(a - greatest(0, k - m) + 1)::INT] * (1 + 1e-7)))), 6) AS fisher_p FROM h""")
def cohort_fisher(spark: SparkSession, folder: str) -> DataFrame:
    u = cohort.usage_by_group(views.patients(spark, folder), "case", "control")
    return rounded(cohort.prevalence(u).select("cluster_id", "patient_fc", "log_patient_fc", "log_cluster_size", "fisher_p"))


@query(f"""WITH {USAGE_SQL}, x AS (SELECT cluster_id, (a - min(a) OVER ()) / (max(a) OVER () - min(a) OVER ()) * 0.5 AS u, (1 - (b - min(b) OVER ()) / (max(b) OVER () - min(b) OVER ())) * 0.25 AS v, (cluster_size - min(cluster_size) OVER ()) / (max(cluster_size) OVER () - min(cluster_size) OVER ()) * 0.25 AS w FROM uu),
 y AS (SELECT cluster_id, sqrt((u - max(u) OVER ()) ** 2 + (v - max(v) OVER ()) ** 2 + (w - max(w) OVER ()) ** 2) AS p, sqrt((u - min(u) OVER ()) ** 2 + (v - min(v) OVER ()) ** 2 + (w - min(w) OVER ()) ** 2) AS q FROM x) SELECT cluster_id, round(q / (p + q), 6) AS topsis_score FROM y""")
def topsis(spark: SparkSession, folder: str) -> DataFrame:
    u = cohort.usage_by_group(views.patients(spark, folder), "case", "control")
    return rounded(cohort.topsis(u, {"case_usage": 2, "control_usage": 1, "cluster_size": 1}, ["control_usage"], ties=["cluster_id"]).select("cluster_id", "topsis_score"))


@query("""SELECT p_brand, count(*) AS support FROM part GROUP BY 1 ORDER BY support DESC, p_brand LIMIT 5""")
def top_epitopes(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.top_groups(table(spark, folder, "part"), "p_brand", 5)


@query("""WITH n AS (SELECT p_brand, p_name, p_type, count(*) AS support FROM part GROUP BY 1, 2, 3) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY support DESC, p_name, p_type) = 1""")
def top_clonotype(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.most_supported(table(spark, folder, "part"), "p_brand", ["p_name", "p_type"])


@query("""SELECT p_name, p_brand, count(DISTINCT p_size) AS n_studies, min(p_type) AS p_type FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) = 1 AND count(DISTINCT p_size) >= 2""")
def specific_public(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.specific_and_public(table(spark, folder, "part"), ["p_name", "p_brand"], "p_type", "p_size")


@query("""WITH n AS (SELECT l_shipmode, l_returnflag, n FROM (SELECT l_linenumber AS l_shipmode, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)) SELECT l_shipmode AS l_linenumber, l_returnflag, n, round(n / sum(n) OVER (PARTITION BY l_shipmode), 6) AS share FROM n""")
def crosstab_normalized(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cohort.normalized_crosstab(table(spark, folder, "lineitem"), "l_linenumber", "l_returnflag"))


@query("""SELECT p_brand, (count(*) FILTER (p_type = 'ECONOMY') > 0)::INT AS "ECONOMY", (count(*) FILTER (p_type = 'SMALL') > 0)::INT AS "SMALL" FROM part GROUP BY 1""")
def presence_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.presence_matrix(table(spark, folder, "part"), "p_brand", "p_type", ["ECONOMY", "SMALL"])


@query(f"""WITH {CLUSTER_SQL} SELECT run_id, cluster_id, metric, round(value, 6) AS value FROM (SELECT run_id, cluster_id, a AS sample, lfc AS log_fold_change FROM clu) UNPIVOT (value FOR metric IN (sample, log_fold_change))""")
def unpivot_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(runs.unpivoted(cluster_table(spark, folder), ["run_id", "cluster_id"], ["sample", "log_fold_change"]))


@query("""WITH n AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand) AS r FROM n) SELECT p_type, string_agg(p_brand || '(' || n || ')', ';' ORDER BY r) AS top_p_brand FROM r WHERE r <= 3 GROUP BY 1""")
def vj_usage(spark: SparkSession, folder: str) -> DataFrame:
    return text.dominant_values(table(spark, folder, "part"), ["p_type"], "p_brand")


@query("""WITH s AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token FROM part) SELECT p_partkey, trim(token) AS token FROM s WHERE trim(token) <> ''""")
def explode_lists(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.explode(text.split_list(F.col("p_name"), " ")).alias("token"))


@query("""WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS t FROM part) SELECT p_partkey FROM s WHERE list_contains(t, 'ring') AND len(list_intersect(t, ['ring', 'small', 'red'])) = 1""")
def hla_exclusive(spark: SparkSession, folder: str) -> DataFrame:
    has = text.has_only_of(text.split_list(F.col("p_name"), " "), "ring", ["ring", "small", "red"])
    return table(spark, folder, "part").filter(has).select("p_partkey")


@query("""SELECT substr(p_name, 1, 1) AS initial, i AS position, substr(p_name, (i + 1)::INT, 1) AS residue, count(*) AS n FROM part, (SELECT unnest(range(0, (SELECT max(len(p_name)) FROM part))) AS i) WHERE i < len(p_name) GROUP BY 1, 2, 3""")
def logo_counts(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part").withColumn("initial", F.substring("p_name", 1, 1))
    return cohort.logo_counts(p, "p_name", ["initial"]).withColumn("position", F.col("position").cast("long"))


@query("""WITH pub AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_size < 10), x AS (SELECT DISTINCT p_name, p_brand FROM part WHERE p_partkey % 3 = 0), c AS (SELECT (SELECT count(*) FROM pub WHERE (p_name, p_brand) IN (FROM x)) AS tp, (SELECT count(*) FROM pub WHERE (p_name, p_brand) NOT IN (FROM x)) AS fn, (SELECT count(*) FROM x) AS clustered)
SELECT tp, fn, clustered, round(tp / (tp + fn), 6) AS recall, round(tp / clustered, 6) AS public_share FROM c""")
def public_recall(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "part")
    return rounded(cohort.recall_of_public(p.filter("p_partkey % 3 = 0"), p.filter("p_size < 10"), ["p_name", "p_brand"]))


@query(f"""WITH {ASSIGN_SQL} SELECT run_id, cluster_id, sha1(string_agg(clonotype_id, ',' ORDER BY clonotype_id)) AS members FROM assign GROUP BY 1, 2""")
def membership_hash(spark: SparkSession, folder: str) -> DataFrame:
    a = views.assignments(spark, folder)
    return a.groupBy("run_id", "cluster_id").agg(text.members_hash(F.col("clonotype_id")).alias("members"))


@query("""SELECT p_partkey, replace(regexp_replace(trim(split_part(p_type || '*01,x', ',', 1)), '\\*.*$', ''), '/', '_') AS gene, p_name ~ '^[A-Za-z]+$' AS alphabetic, CASE WHEN p_size < 10 THEN 'positive' WHEN p_size IS NOT NULL THEN 'negative' ELSE 'unlabeled' END AS truth, p_brand || '|' || p_type AS key FROM part""")
def scalar_expressions(spark: SparkSession, folder: str) -> DataFrame:
    gene = text.normalize_gene(F.concat("p_type", F.lit("*01,x")))
    return table(spark, folder, "part").select("p_partkey", gene.alias("gene"), text.is_alphabetic(F.col("p_name")).alias("alphabetic"), text.truth_label(F.col("p_size"), 10).alias("truth"), text.match_key(F.col("p_brand"), F.col("p_type")).alias("key"))


@query(f"""WITH {PATIENTS_SQL} SELECT cluster_id, count(DISTINCT sample_name) AS n_samples FROM pat GROUP BY 1 HAVING count(DISTINCT sample_name) >= 2""")
def public_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.public_clusters(views.patients(spark, folder))


@query(f"""WITH {PATIENTS_SQL}, k AS (SELECT DISTINCT cluster_id, cdr3 FROM pat), l AS (SELECT DISTINCT cdr3, sample_name FROM pat WHERE seg = 'BUILDING') SELECT cluster_id, count(DISTINCT sample_name) AS usage FROM k JOIN l USING (cdr3) GROUP BY 1""")
def cluster_usage(spark: SparkSession, folder: str) -> DataFrame:
    p = views.patients(spark, folder)
    lookup = cohort.patient_lookup(p.filter("sample_group = 'case'"), ["cdr3"])
    return merging.cluster_usage(p, lookup, ["cdr3"])


@query(f"""WITH {PATIENTS_SQL} SELECT cdr3, count(DISTINCT sample_name) AS usage FROM pat GROUP BY 1""")
def clonotype_usage(spark: SparkSession, folder: str) -> DataFrame:
    return cohort.clonotype_usage(views.patients(spark, folder), ["cdr3"])


@query(f"""WITH {PATIENTS_SQL}, n AS (SELECT sample_name, count(DISTINCT cdr3) AS n FROM pat GROUP BY 1) SELECT cluster_id, sample_name, round(count(DISTINCT cdr3) / any_value(n), 6) AS share FROM pat JOIN n USING (sample_name) GROUP BY 1, 2""")
def sample_share(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cohort.sample_share(views.patients(spark, folder), ["cdr3"]))


@query(f"""WITH {PATIENTS_SQL} SELECT DISTINCT cdr3, cluster_id, sample_name FROM pat WHERE trim(cdr3) <> ''""")
def patient_lookup(spark: SparkSession, folder: str) -> DataFrame:
    p = cohort.patient_lookup(views.patients(spark, folder), ["cdr3", "cluster_id"])
    return p.withColumn("cluster_id", F.col("cluster_id").cast("long"))


@query(f"""WITH {ASSIGN_SQL}, r AS (SELECT DISTINCT run_id, parameter_json FROM assign) SELECT run_id, json_extract_string(parameter_json, '$.k') AS param_k, json_extract_string(parameter_json, '$.gamma') AS param_gamma FROM r""")
def run_parameters(spark: SparkSession, folder: str) -> DataFrame:
    r = views.assignments(spark, folder).select("run_id", "parameter_json").distinct()
    return runs.with_run_parameters(r, ["k", "gamma"]).drop("parameter_json")


@query("""WITH r AS (SELECT r_name || '__vdbscan_leiden__k-' || r_regionkey AS run_id FROM region) SELECT run_id, regexp_extract(run_id, '^(.+?)__([a-z_]+?)(?:__(.*))?$', 1) AS dataset, regexp_extract(run_id, '^(.+?)__([a-z_]+?)(?:__(.*))?$', 2) AS method, regexp_extract(run_id, '^(.+?)__([a-z_]+?)(?:__(.*))?$', 3) AS tag FROM r""")
def run_identity(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "region").select(F.concat("r_name", F.lit("__vdbscan_leiden__k-"), "r_regionkey").alias("run_id"))
    return r.select("run_id", *[c.alias(n) for n, c in text.run_identity(F.col("run_id")).items()])


@query("""SELECT p_partkey, CASE WHEN p_size < 20 AND p_partkey % 2 = 0 THEN 'TP' WHEN p_size < 20 THEN 'FN' WHEN p_partkey % 2 = 0 THEN 'FP' ELSE 'TN' END AS category FROM part""")
def confusion_category(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", text.confusion_category(F.col("p_size") < 20, F.col("p_partkey") % 2 == 0).alias("category"))


@query("""SELECT p_name, p_brand, bool_or(p_size < 5) AS truth FROM part GROUP BY 1, 2""")
def truth_by_key(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.truth_by_key(table(spark, folder, "part").withColumn("truth", F.col("p_size") < 5), ["p_name", "p_brand"])


@query(f"""WITH {EDGES_SQL}, d AS (SELECT src AS point_id, dist AS d, len(cdr3) AS gid FROM edg JOIN pts ON src = point_id WHERE rank = 3) SELECT gid, point_id, round(d, 6) AS d, row_number() OVER (PARTITION BY gid ORDER BY d, point_id)::INT AS curve_rank FROM d""")
def distance_curve(spark: SparkSession, folder: str) -> DataFrame:
    own = views.points(spark, folder).select("point_id", F.length("cdr3").cast("long").alias("gid"))
    d = knn.kth_distance(edges_table(spark, folder), 4).join(own, "point_id")
    return rounded(density.distance_curve(d, ["gid"])).select("gid", "point_id", "d", "curve_rank")


@query(f"""WITH {EDGES_SQL} SELECT src AS point_id, round(min(dist), 6) AS d FROM edg WHERE src <> dst GROUP BY 1""")
def first_neighbour(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(knn.first_neighbour_distance(edges_table(spark, folder)))


@query(f"""WITH {GEO_SQL}, f AS (SELECT src, min(dist) AS d FROM se GROUP BY 1) SELECT sp.cluster_id, round(avg(d), 6) AS sample_nearest_neighbor_distance FROM f JOIN sp ON sp.point_id = src GROUP BY 1""")
def neighbour_distance(spark: SparkSession, folder: str) -> DataFrame:
    own, edges, _ = point_summary(spark, folder)
    return rounded(cluster_metrics.neighbour_distance(own, edges, "sample_nearest_neighbor_distance"))


@query(f"""WITH {CLUSTER_SQL} SELECT run_id, cluster_id, round(CASE WHEN z < 0 THEN p - 1 ELSE 1 - p END, 6) AS local_statistic FROM clu""")
def local_statistic(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(cluster_table(spark, folder).select("run_id", "cluster_id", stats.centred_normal("z").alias("local_statistic")))


@query(f"""WITH {ASSIGN_SQL}, g AS (SELECT run_id, count(*) AS n_points, count(DISTINCT cluster_id) FILTER (NOT is_noise) AS n_clusters, avg(is_noise::INT) AS nf FROM assign GROUP BY 1) SELECT run_id, round(1 - nf, 6) AS coverage, round(log10(greatest(n_clusters, 1)), 6) AS log10_clusters, round(n_points / 2.5, 6) AS throughput FROM g""")
def global_proxies(spark: SparkSession, folder: str) -> DataFrame:
    g = views.assignments(spark, folder).groupBy("run_id").agg(F.count("*").alias("n_points"), F.countDistinct(F.when(~F.col("is_noise"), F.col("cluster_id"))).alias("n_clusters"), F.avg(F.col("is_noise").cast("int")).alias("noise_fraction"), F.lit(2.5).alias("runtime_seconds"))
    return rounded(runs.global_proxies(g).select("run_id", "coverage", "log10_clusters", "throughput"))


@query(f"""WITH {EVAL_SQL}, r AS (SELECT run_id, donor_id, cluster_id, is_significant FROM ev) SELECT run_id, donor_id, cluster_id, round(avg(is_significant::INT) OVER (PARTITION BY run_id), 6) AS known_recovery_rate FROM r""")
def recovery_rate(spark: SparkSession, folder: str) -> DataFrame:
    e = donor_enrichment_table(spark, folder).withColumnRenamed("is_significant", "is_in_significant_cluster")
    return rounded(evaluation.with_recovery_rate(e).select(*RUN, "cluster_id", "known_recovery_rate"))


@query("""SELECT 'D' || (l_suppkey % 6) AS donor, date_trunc('month', l_shipdate) AS window_start, l_partkey % 20 AS cluster_id, count(*) FILTER (l_returnflag = 'R') AS sample, count(*) FILTER (l_returnflag <> 'R') AS background FROM lineitem GROUP BY 1, 2, 3""")
def monthly_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.concat(F.lit("D"), (F.col("l_suppkey") % 6).cast("string")).alias("donor"), F.date_trunc("month", "l_shipdate").alias("window_start"), (F.col("l_partkey") % 20).alias("cluster_id"), F.when(F.col("l_returnflag") == "R", "sample").otherwise("background").alias("source"))
    return enrichment.cluster_counts(rows, ["donor", "window_start"]).drop("cluster_size")


# ---------------------------------------------------------------- without a SQL form
def distances_by_group(spark: SparkSession, folder: str) -> DataFrame:
    own = views.points(spark, folder).select("point_id", (F.length("cdr3") % 3).cast("long").alias("gid"))
    return knn.kth_distance(edges_table(spark, folder), 4).join(own, "point_id")


@query()
def eps_by_knee(spark: SparkSession, folder: str) -> DataFrame:
    """Radii by the knee of a polynomial fitted to the sorted distances of each group."""
    return density.knee_radius(distances_by_group(spark, folder), ["gid"])


@query()
def eps_by_spline(spark: SparkSession, folder: str) -> DataFrame:
    """Radii where the smoothed curve of sorted distances bends most."""
    return knee.spline_elbow(distances_by_group(spark, folder), ["gid"])


@query()
def pca_distances(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours after standardizing and projecting to eight components."""
    p = written(reduction.reduced(views.points(spark, folder).select("point_id", "source", "embedding"), 8), "space")
    return rounded(knn.nearest(p, p, 4), 4)


@query()
def leiden_clusters(spark: SparkSession, folder: str) -> DataFrame:
    p = views.points(spark, folder)
    return communities.leiden_clusters(p, knn.neighbour_graph(edges_table(spark, folder)))


@query()
def hierarchical_leiden(spark: SparkSession, folder: str) -> DataFrame:
    p = views.points(spark, folder)
    return communities.hierarchical_leiden(p, knn.neighbour_graph(edges_table(spark, folder)))


@query()
def full_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """The whole pipeline with vDBSCAN and Leiden inside its clusters."""
    r = compare(views.points(spark, folder), Config(algorithm="vdbscan_leiden", components=16, k_neighbors=8))
    return r.summary.select("cluster_id", "sample", "background", "cluster_size", "log_fold_change", "density_validity", "is_good_candidate_relaxed")


@query()
def vdbscan_leiden(spark: SparkSession, folder: str) -> DataFrame:
    p, edges = views.points(spark, folder), edges_table(spark, folder)
    radii, own = radius_table(spark, folder, edges)
    labels = written(density.vdbscan(edges, written(density.radius_of_points(own, radii), "radius"), 3), "labels")
    return communities.vdbscan_leiden(p, labels, knn.neighbour_graph(edges))


@query()
def leiden_dbscan(spark: SparkSession, folder: str) -> DataFrame:
    p = views.points(spark, folder)
    return communities.leiden_dbscan(p, knn.neighbour_graph(edges_table(spark, folder)), radius=DBSCAN_EPS)


SWEEP = (0.9, 0.96, 1.0, 1.04, 1.06, 1.08, 1.1, DBSCAN_EPS)


def _sweep_sql(eps: float) -> str:
    return f"""(WITH RECURSIVE {POINTS_SQL}, al AS (SELECT q.point_id AS src, p.point_id AS dst FROM pts q, pts p WHERE list_distance(q.embedding, p.embedding) <= {eps}),
 ke AS (SELECT DISTINCT src FROM al WHERE src <> dst), dd AS (SELECT * FROM al WHERE src IN (FROM ke) AND dst IN (FROM ke)),
 cr AS (SELECT src FROM dd GROUP BY src HAVING count(*) >= 3), re(p, r) AS (SELECT src, src FROM cr UNION SELECT re.p, dd.dst FROM re JOIN dd ON re.r = dd.src WHERE dd.dst IN (FROM cr)),
 ro AS (SELECT p, min(r) AS root FROM re GROUP BY 1), br AS (SELECT DISTINCT src FROM dd WHERE dst IN (FROM cr) AND src NOT IN (FROM cr))
SELECT {eps}::DOUBLE AS eps, (SELECT count(*) FROM pts) - (SELECT count(*) FROM ro) - (SELECT count(*) FROM br) AS n_noise, (SELECT count(DISTINCT root) FROM ro) AS n_clusters)"""


@query(" UNION ALL ".join(map(_sweep_sql, SWEEP)))
def noise_by_radius(spark: SparkSession, folder: str) -> DataFrame:
    """Noise and clusters of DBSCAN over a sweep of radii."""
    return density.noise_by_radius(views.points(spark, folder), SWEEP, 3)


@query(f"""WITH {POINTS_SQL} SELECT count(*) AS points, 0 AS broken_communities, true AS better_than_components, true AS better_than_single_points FROM pts""")
def leiden_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """What must hold of communities: every point is in one, each is connected, and modularity exceeds that of trivial partitions."""
    p = views.points(spark, folder)
    graph = written(knn.neighbour_graph(edges_table(spark, folder)), "graph")
    roots = written(communities.communities(graph), "communities")
    whole = connected_components(graph, "a", "b").select(F.col("node").alias("point_id"), "root")
    side = lambda c: roots.select(F.col("point_id").alias(c), F.col("root").alias(f"r{c}"))
    inside = graph.join(side("a"), "a").join(side("b"), "b").filter("ra = rb")
    pieces = connected_components(inside, "a", "b").withColumnRenamed("root", "piece").withColumnRenamed("node", "point_id")
    pieces = roots.join(pieces, "point_id", "left").withColumn("piece", F.coalesce("piece", "point_id"))
    broken = pieces.groupBy("root").agg(F.countDistinct("piece").alias("n")).agg(F.count_if(F.col("n") > 1).cast("int").alias("broken_communities"))
    alone = roots.select("point_id", F.col("point_id").alias("root"))
    own, one, none = (communities.partition_modularity(graph, x).first()["modularity"] for x in (roots, whole, alone))
    labelled = p.select("point_id").join(roots, "point_id", "left").agg(F.count("*").alias("points"))
    return labelled.crossJoin(broken).select("*", F.lit(own > one).alias("better_than_components"), F.lit(own > none).alias("better_than_single_points"))


LONG_SQL = """lg AS (SELECT DISTINCT md5((p_partkey % 300)::VARCHAR) || substr(md5('x' || (p_partkey % 300)), 1, 11) || (p_partkey % 4) || (p_partkey % 5) AS seq FROM part)"""


@query(f"""WITH {LONG_SQL} SELECT a.seq AS left_seq, b.seq AS right_seq, hamming(a.seq, b.seq)::INT AS distance FROM lg a, lg b WHERE substr(a.seq, 1, 20) = substr(b.seq, 1, 20) AND hamming(a.seq, b.seq) <= 2""")
def hamming_join_long(spark: SparkSession, folder: str) -> DataFrame:
    """Two mismatches at the ends of sequences of 45 letters."""
    k = F.col("p_partkey")
    head, tail = F.md5((k % 300).cast("string")), F.substring(F.md5(F.concat(F.lit("x"), (k % 300).cast("string"))), 1, 11)
    s = table(spark, folder, "part").select(F.concat(head, tail, (k % 4).cast("string"), (k % 5).cast("string")).alias("sequence"))
    return merging.hamming_join(s, s, 2)


@query(_merge_sql("seq").replace("ed AS (SELECT DISTINCT a.c AS a, b.c AS b FROM ky a JOIN ky b USING (k))", "ed AS (SELECT DISTINCT a.c AS a, b.c AS b FROM ky a, ky b WHERE hamming(a.k, b.k) <= 2)").replace("1, 3) AS seq", "1, 8) AS seq"))
def merge_hamming2(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("p_partkey") % 400
    rows = table(spark, folder, "part").select(c.alias("cluster_id"), F.substring(F.md5((c * 7 + F.col("p_size") % 3).cast("string")), 1, 8).alias("sequence"))
    return merging.merge_clusters(rows, "sequence", 2)


def _motif_sql(keys: str) -> str:
    return f"""WITH m AS (SELECT DISTINCT {keys} FROM part WHERE p_size > 30), t AS (SELECT p_size % 2 = 0 AS v, ({keys}) IN (FROM m) AS h FROM part),
 c AS (SELECT count(*) FILTER (v AND h) AS tp, count(*) FILTER (NOT v AND h) AS fp, count(*) FILTER (NOT v AND NOT h) AS tn, count(*) FILTER (v AND NOT h) AS fn FROM t)
SELECT tp, fp, tn, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"""


def _motif_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, folder, "part")
    genes = F.concat("p_brand", F.lit("*01, other*02")).alias("v_gene")
    motifs = p.filter("p_size > 30").select(F.col("p_name").alias("cdr3"), genes, F.concat(F.lit("other ,"), "p_type").alias("j_gene"))
    return motifs, p.select(F.col("p_name").alias("cdr3"), F.concat("p_brand", F.lit("*03")).alias("v_gene"), F.col("p_type").alias("j_gene"), (F.col("p_size") % 2 == 0).alias("valid"))


@query(_motif_sql("p_name"))
def motif_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluation.motif_baseline(*_motif_tables(spark, folder)))


@query(_motif_sql("p_name, p_brand, p_type"))
def motif_baseline_genes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluation.motif_baseline(*_motif_tables(spark, folder), with_genes=True))


@query("""SELECT p_partkey, p_brand ~ '^(?:Brand#[12]|x)' AS hit FROM part""")
def motif_match(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", text.starts_with_motif(F.col("p_brand"), "Brand#[12]|x").alias("hit"))


@query(f"""WITH {ASSIGN_SQL}, a AS (SELECT run_id, round((count(*) FILTER (cluster_id >= 0)) / count(*), 6) AS coverage FROM assign GROUP BY 1),
 b AS (SELECT 'run_' || (p_size % 9) AS run_id, round(avg(p_retailprice), 6) AS mean_price FROM part GROUP BY 1), r AS (SELECT DISTINCT run_id, method FROM assign WHERE run_id <> 'run_2')
SELECT run_id, coverage, mean_price, method FROM a FULL JOIN b USING (run_id) LEFT JOIN r USING (run_id)""")
def proxy_table(spark: SparkSession, folder: str) -> DataFrame:
    a = views.assignments(spark, folder)
    one = runs.assignment_proxies(a).select("run_id", "coverage")
    two = table(spark, folder, "part").groupBy(F.concat(F.lit("run_"), (F.col("p_size") % 9).cast("string")).alias("run_id")).agg(F.avg("p_retailprice").alias("mean_price"))
    return rounded(runs.proxy_table(one, two, a.filter("run_id <> 'run_2'"), columns=["method"]))


@query(f"""WITH {PATIENTS_SQL}, t AS (SELECT greatest(count(DISTINCT sample_name) FILTER (seg = 'BUILDING'), 1) AS n, greatest(count(DISTINCT sample_name) FILTER (seg <> 'BUILDING'), 1) AS m FROM pat),
 s AS (SELECT cluster_id, count(*) AS cluster_size, count(DISTINCT sample_name) AS n_samples, count(DISTINCT sample_name) FILTER (seg = 'BUILDING') AS case_usage, count(DISTINCT sample_name) FILTER (seg <> 'BUILDING') AS control_usage,
   bool_or(cdr3 LIKE 'b%') AS as_pattern, avg(len(cdr3) / 1e6) AS pgen, count(*) FILTER (sample_name % 3 = 0) AS sample, count(*) FILTER (sample_name % 3 <> 0) AS background FROM pat GROUP BY 1)
SELECT cluster_id, cluster_size, n_samples, case_usage, control_usage, as_pattern, sample, background, round(sample / cluster_size, 6) AS sample_fraction, round(background / cluster_size, 6) AS background_fraction,
 round((case_usage / n + 0.5) / (control_usage / m + 0.5), 6) AS patient_fc, round(log10(pgen), 6) AS log_pgen FROM s, t""")
def merged_summary(spark: SparkSession, folder: str) -> DataFrame:
    m = views.patients(spark, folder).withColumnRenamed("cluster_id", "merged_cluster_id")
    m = m.withColumns({"source": F.when(F.col("sample_name") % 3 == 0, "sample").otherwise("background"), "as_pattern": text.starts_with_motif(F.col("cdr3"), "b"), "pgen": F.length("cdr3") / 1e6})
    s = cohort.merged_summary(m).withColumnRenamed("merged_cluster_id", "cluster_id")
    return rounded(s.select("cluster_id", "cluster_size", "n_samples", "case_usage", "control_usage", "as_pattern", "sample", "background", "sample_fraction", "background_fraction", "patient_fc", "log_pgen"))


MANIFEST_SQL = """mf AS (SELECT r_name AS dataset, r_name || '__' || m || '__k-' || k AS run_id, k FROM region, (SELECT unnest(['vdbscan', 'leiden']) AS m), (SELECT unnest([5, 10, 15]) AS k))"""


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    g = runs.grid(spark, {"k": [5, 10, 15]}).withColumn("method", F.explode(F.array(F.lit("vdbscan"), F.lit("leiden"))))
    return runs.manifest(table(spark, folder, "region").select(F.col("r_name").alias("dataset")), g).select("dataset", "run_id", "k")


@query(f"""WITH {MANIFEST_SQL} SELECT run_id, k FROM mf WHERE dataset IN ('ASIA', 'AFRICA') AND run_id LIKE 'A%'""")
def selected_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a mode by their name, or by the manifest."""
    m = _manifest(spark, folder)
    known = m.select("run_id", F.when(F.col("dataset") == "AFRICA", "ASIA").otherwise("other").alias("dataset_mode"))
    return runs.selected_runs(m, known, "ASIA", "A").select("run_id", "k")


@query(f"""WITH {MANIFEST_SQL} SELECT run_id, k FROM mf WHERE k <> 10""")
def missing_runs(spark: SparkSession, folder: str) -> DataFrame:
    m = _manifest(spark, folder)
    return runs.missing_runs(m.select("run_id", "k"), m.filter("k = 10"))


@query("""SELECT event_id, event_type AS method, (event_id % 40)::INT AS k_neighbors, CASE WHEN event_id % 3 <> 0 THEN (event_id % 3) / 4 END AS leiden_resolution, 'sample' AS eps_estimation_based_on, NULL::INT AS cluster_pc_components FROM events""")
def tagged_runs(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    lr = F.when(e % 3 == 1, "lr_0p25").when(e % 3 == 2, "lr_0p5")
    name = F.concat_ws("__", F.concat(F.lit("algo_"), "event_type"), F.concat(F.lit("kn_"), (e % 40).cast("string")), lr, F.lit("eps_sample"), F.lit("pc_many"))
    own = text.tagged_run(name)
    return table(spark, folder, "events").select("event_id", *[own[c].alias(c) for c in ("method", "k_neighbors", "leiden_resolution", "eps_estimation_based_on", "cluster_pc_components")])


@query("""WITH r AS (SELECT l_suppkey % 50 AS a1, l_linenumber AS a2, l_partkey % 70 AS b1, l_returnflag AS b2, l_discount > 0.09 AS v, l_quantity > 49 AS h FROM lineitem),
 ka AS (SELECT a1, a2, bool_or(v) AS t, bool_or(h) AS x FROM r GROUP BY 1, 2), kb AS (SELECT b1, b2, bool_or(v) AS t, bool_or(h) AS x FROM r GROUP BY 1, 2)
SELECT ka.t AS truth_alpha, kb.t AS truth_beta, ka.x AS hit_alpha, kb.x AS hit_beta, count(*) AS n FROM r JOIN ka USING (a1, a2) JOIN kb USING (b1, b2) GROUP BY 1, 2, 3, 4""")
def paired_flags(spark: SparkSession, folder: str) -> DataFrame:
    keys = {"alpha": ["a1", "a2"], "beta": ["b1", "b2"]}
    rows = table(spark, folder, "lineitem").select(
        (F.col("l_suppkey") % 50).alias("a1"), F.col("l_linenumber").alias("a2"), (F.col("l_partkey") % 70).alias("b1"), F.col("l_returnflag").alias("b2"), (F.col("l_discount") > 0.09).alias("valid"), (F.col("l_quantity") > 49).alias("h"),
    )
    hits = {c: rows.filter("h").select(*k) for c, k in keys.items()}
    return evaluation.paired_flags(rows.drop("h"), hits, keys).groupBy("truth_alpha", "truth_beta", "hit_alpha", "hit_beta").agg(F.count("*").alias("n"))


def _basis_sql(basis: str) -> str:
    only = "" if basis == "all" else f"JOIN pts a ON a.point_id = src JOIN pts b ON b.point_id = dst WHERE a.source = '{basis}' AND b.source = '{basis}'"
    return f"""SELECT '{basis}' AS basis, count(*) AS n, round(sum(d), 4) AS total FROM (SELECT dist AS d, row_number() OVER (PARTITION BY src ORDER BY dist, dst <> src, dst) AS r FROM dd {only}) WHERE r = 4"""


@query(f"""WITH {EDGES_SQL} {' UNION ALL '.join(map(_basis_sql, density.BASES))}""")
def radius_bases(spark: SparkSession, folder: str) -> DataFrame:
    """Distances that radii are learned from, by basis."""
    edges, p = edges_table(spark, folder), views.points(spark, folder)
    rows = [density.of_basis(edges, p, 4, b).agg(F.lit(b).alias("basis"), F.count("*").alias("n"), F.sum("d").alias("total")) for b in density.BASES]
    return rounded(runs.union_tables(rows), 4)


def _nested(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """One row: noise of the inner clustering, and inner clusters that lie in more than one outer cluster."""
    both = inner.join(outer.select("point_id", F.col("cluster_id").alias("outer_id")), "point_id")
    lost = both.groupBy("cluster_id").agg(F.countDistinct("outer_id").alias("n")).filter("cluster_id >= 0 and n > 1").agg(F.count("*").cast("int").alias("split_clusters"))
    return inner.agg(F.count_if(F.col("cluster_id") == -1).alias("noise")).crossJoin(lost)


@query(f"""SELECT count(*) FILTER (cluster_id = -1) AS noise, 0 AS split_clusters FROM ({_vdbscan_sql("a.eps")})""")
def vdbscan_leiden_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Leiden inside density clusters adds no noise and crosses no cluster."""
    edges = edges_table(spark, folder)
    radii, own = radius_table(spark, folder, edges)
    outer = written(density.vdbscan(edges, written(density.radius_of_points(own, radii), "radius"), 3, "asymmetric"), "vdbscan")
    inner = communities.vdbscan_leiden(views.points(spark, folder), outer, knn.neighbour_graph(edges))
    return _nested(outer, written(inner, "inner"))


@query(f"""WITH {POINTS_SQL} SELECT 0 AS noise, 0 AS split_clusters FROM pts LIMIT 1""")
def hierarchical_leiden_nested(spark: SparkSession, folder: str) -> DataFrame:
    """The second level, with clusters of any size, crosses no community of the first."""
    p, graph = views.points(spark, folder), written(knn.neighbour_graph(edges_table(spark, folder)), "graph")
    outer = written(communities.leiden_clusters(p, graph, least=0), "outer")
    return _nested(outer, written(communities.hierarchical_leiden(p, graph, least=0, least_within=0, first=outer), "inner"))


@query(f"""WITH {POINTS_SQL} SELECT count(*) AS points, 0 AS split_clusters FROM pts""")
def leiden_dbscan_nested(spark: SparkSession, folder: str) -> DataFrame:
    """DBSCAN inside communities labels every point and crosses no community."""
    p, graph = views.points(spark, folder), written(knn.neighbour_graph(edges_table(spark, folder)), "graph")
    outer = written(communities.leiden_clusters(p, graph, least=0), "outer")
    inner = written(communities.leiden_dbscan(p, graph, radius=DBSCAN_EPS, first=outer), "inner")
    return _nested(outer, inner).select(F.lit(inner.join(p, "point_id", "left_semi").count()).alias("points"), "split_clusters")
