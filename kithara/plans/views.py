"""Domain tables derived from the driver's tables, once for Spark and once as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithara.sources.tables import table

ASSIGN_SQL = """assign AS (SELECT 'run_' || l_linenumber AS run_id, 'D' || (l_suppkey % 6) AS donor_id, 'm' || (l_linenumber % 3) AS method,
    '{"k":' || l_linenumber || '}' AS parameter_json, 'E' || (l_partkey % 3) AS epitope,
    CASE WHEN l_partkey % 37 = 0 THEN -1 ELSE l_partkey % 37 END AS cluster_id, l_partkey % 37 = 0 AS is_noise,
    CASE WHEN l_returnflag = 'R' THEN 'sample' ELSE 'background' END AS sample_label,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS clonotype_id,
    p_name AS cdr3, p_brand AS v_gene, p_type AS j_gene, 'beta' AS chain, p_size,
    CASE WHEN l_discount > 0.06 THEN 'positive' WHEN l_discount > 0.02 THEN 'negative' ELSE 'unlabeled' END AS truth_label
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
POINTS_SQL = """pts AS (SELECT vec_id AS point_id, CASE WHEN (label < 3 AND vec_id % 4 <> 0) OR (label >= 3 AND vec_id % 4 = 0) THEN 'sample' ELSE 'background' END AS source,
    embedding::DOUBLE[] AS embedding, label::BIGINT AS cluster_id, substr(md5(vec_id::VARCHAR), 1, (8 + vec_id % 9)::INT) AS cdr3 FROM embeddings)"""
PATIENTS_SQL = """pat AS (SELECT c_custkey AS sample_name, c_mktsegment AS seg, l_partkey % 41 AS cluster_id, p_name AS cdr3
  FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"""
PARAMS_SQL = """par AS (SELECT event_id, user_id, ts, event_type AS method, json_extract_string(props, '$.k') AS k, value AS score FROM events)"""


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    l = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_discount")  # noqa: E741
    p = table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey"))
    text = lambda c: F.col(c).cast("string")
    return rows.select(
        F.concat(F.lit("run_"), text("l_linenumber")).alias("run_id"), F.concat(F.lit("D"), (F.col("l_suppkey") % 6).cast("string")).alias("donor_id"),
        F.concat(F.lit("m"), (F.col("l_linenumber") % 3).cast("string")).alias("method"), F.concat(F.lit('{"k":'), text("l_linenumber"), F.lit("}")).alias("parameter_json"),
        F.concat(F.lit("E"), (F.col("l_partkey") % 3).cast("string")).alias("epitope"),
        F.when(F.col("l_partkey") % 37 == 0, -1).otherwise(F.col("l_partkey") % 37).alias("cluster_id"), (F.col("l_partkey") % 37 == 0).alias("is_noise"),
        F.when(F.col("l_returnflag") == "R", "sample").otherwise("background").alias("sample_label"),
        F.concat_ws("-", text("l_orderkey"), text("l_linenumber"), text("l_partkey"), text("l_suppkey")).alias("clonotype_id"),
        F.col("p_name").alias("cdr3"), F.col("p_brand").alias("v_gene"), F.col("p_type").alias("j_gene"), F.lit("beta").alias("chain"), "p_size",
        F.when(F.col("l_discount") > 0.06, "positive").when(F.col("l_discount") > 0.02, "negative").otherwise("unlabeled").alias("truth_label"),
    )


def points(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("vec_id")
    sample = ((F.col("label") < 3) & (v % 4 != 0)) | ((F.col("label") >= 3) & (v % 4 == 0))
    return table(spark, folder, "embeddings").select(
        v.alias("point_id"), F.when(sample, "sample").otherwise("background").alias("source"), F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("long").alias("cluster_id"), F.substring(F.md5(v.cast("string")), F.lit(1), (8 + v % 9).cast("int")).alias("cdr3"),
    )


def patients(spark: SparkSession, folder: str) -> DataFrame:
    """Customers of one segment are cases, all others controls."""
    c, o, l, p = (table(spark, folder, t) for t in ("customer", "orders", "lineitem", "part"))  # noqa: E741
    rows = c.join(o, F.col("o_custkey") == F.col("c_custkey")).join(l, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    group = F.when(F.col("c_mktsegment") == "BUILDING", "case").otherwise("control")
    return rows.select(F.col("c_custkey").alias("sample_name"), group.alias("sample_group"), (F.col("l_partkey") % 41).alias("cluster_id"), F.col("p_name").alias("cdr3"))


def parameter_runs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return e.select("event_id", "user_id", "ts", F.col("event_type").alias("method"), F.get_json_object("props", "$.k").alias("k"), F.col("value").alias("score"))
