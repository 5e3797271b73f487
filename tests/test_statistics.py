import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kithara.functions import stats
from kithara.operators import enrichment


def choose(n, k):
    return math.comb(n, k)


def test_tails_against_exact_sums():
    for n, p in ((1, 0.5), (7, 0.1), (40, 0.9), (200, 0.013)):
        for k in range(-1, n + 1):
            exact = sum(choose(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))
            assert abs(float(stats.binomial_sf(k, n, p)[0]) - exact) < 1e-12
    for a, b, c, d in ((0, 5, 0, 7), (3, 2, 1, 9), (5, 0, 0, 5), (2, 8, 7, 3)):
        greater, both = (float(x[0]) for x in stats.hypergeometric_tails(*(np.array([v]) for v in (a, b, c, d))))
        low = max(0, a + c - c - d)
        exact = [choose(a + b, x) * choose(c + d, a + c - x) / choose(a + b + c + d, a + c) for x in range(low, min(a + b, a + c) + 1)]
        assert greater == pytest.approx(sum(exact[a - low :])) and both == pytest.approx(sum(p for p in exact if p <= exact[a - low] * (1 + 1e-7)))


def test_functions_over_arrays():
    x = np.concatenate([np.linspace(0, 8, 161), [15.0, 26.0]])
    assert stats.erfc(x) == pytest.approx([math.erfc(v) for v in x], rel=1e-11)
    y = np.concatenate([np.linspace(0.5, 40, 80), [1e3, 1e6, 1e9]])
    assert stats.log_gamma(y) == pytest.approx([math.lgamma(v) for v in y], rel=1e-13, abs=1e-12)
    assert stats.regularized_beta(np.array([0.3, 0.0, 1.0]), np.array([2.0, 1, 1]), np.array([3.0, 1, 1])) == pytest.approx([0.3483, 0, 1])


def test_tails_of_a_batch_do_not_depend_on_each_other(spark):
    rows = [(i % 9, i % 7, (i * 5) % 11, (i * 3) % 8) for i in range(60)]
    frame = pd.DataFrame(rows).T.reset_index(drop=True).T
    columns = [frame[k] for k in range(4)]
    whole = stats._fisher(0, *columns)
    assert [v for i in range(0, 60, 7) for v in stats._fisher(0, *(c[i : i + 7] for c in columns))] == list(whole)
    assert stats._fisher(0, *(pd.Series([x]) for x in (1.0, None, 2.0, 3.0))).isna().all()
    for (a, b, c, d), got in zip(rows, whole, strict=True):
        exact = sum(choose(a + b, x) * choose(c + d, a + c - x) for x in range(a, min(a + b, a + c) + 1)) / choose(a + b + c + d, a + c)
        assert got == pytest.approx(exact)


def test_fdr_keeps_order_and_nulls(spark):
    df = spark.createDataFrame([(0, 0.04), (1, 0.001), (2, 0.02), (3, 0.5), (4, None)], "i int, p double")
    q = [r.q for r in stats.with_fdr(df, "p", "q", ties=("i",)).orderBy("i").collect()]
    assert q == [pytest.approx(0.04 * 4 / 3), pytest.approx(0.004), pytest.approx(0.04), pytest.approx(0.5), None]


def test_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(0, 5.0), (1, 1.0), (2, 5.0), (3, None), (4, 9.0)], "i int, x double")
    rows = df.select("i", stats.average_rank(F.col("x")).alias("r"), stats.percent_rank(F.col("x")).alias("p")).orderBy("i").collect()
    assert [r.r for r in rows] == [2.5, 1.0, 2.5, None, 4.0]
    assert [r.p for r in rows] == [0.625, 0.25, 0.625, None, 1.0]


def test_counts_without_one_source_and_with_noise(spark):
    rows = spark.createDataFrame([(-1, "sample"), (0, "sample"), (0, "sample"), (1, "sample")], "cluster_id int, source string")
    got = {r.cluster_id: (r.sample, r.background, r.cluster_size) for r in enrichment.cluster_counts(rows).collect()}
    assert got == {0: (2, 0, 2), 1: (1, 0, 1)}
    s = enrichment.enrichment_summary(rows).collect()
    assert all(r.total_sample == 4 and r.z is None and r.enrichment_fdr_zbinom is None for r in s)


def test_enrichment_of_a_known_table(spark):
    pts = [(0, "sample")] * 8 + [(0, "background")] * 2 + [(1, "sample")] * 2 + [(1, "background")] * 8 + [(-1, "sample")] * 10 + [(-1, "background")] * 10
    rows = spark.createDataFrame(pts, "cluster_id int, source string")
    got = {r.cluster_id: r for r in enrichment.enrichment_summary(rows, tests=enrichment.TESTS).collect()}
    a, b, s, n = 8, 2, 20, 20
    z = (n * a - s * b) / math.sqrt(s * (b + 1e-6) * (n - b))
    assert got[0].z == pytest.approx(z)
    assert got[0].enrichment_pvalue_zbinom == pytest.approx(math.erfc(z / math.sqrt(2)))
    assert got[0].log_fold_change == pytest.approx(math.log10(4), abs=1e-6)
    assert got[0].enrichment_pvalue_fisher == pytest.approx(sum(choose(20, x) * choose(20, 10 - x) for x in (8, 9, 10)) / choose(40, 10))
    assert got[0].enrichment_pvalue_binom == pytest.approx(sum(choose(20, i) * 0.1**i * 0.9 ** (20 - i) for i in range(9, 21)))
    members = enrichment.enriched_members(rows, enrichment.enrichment_summary(rows))
    assert members.count() == 10 and members.select("cluster_id").distinct().first()[0] == 0
    with pytest.raises(ValueError):
        enrichment.enrichment_summary(rows, tests=("none",))


def test_evaluation_special_cases(spark):
    rows = [("r", "d", 0, False, "sample")] * 3 + [("r", "d", 1, False, "background")] * 3 + [("r", "d", 0, True, "sample"), ("r", "d", -1, False, "background")]
    a = spark.createDataFrame(rows, "run_id string, donor_id string, cluster_id int, is_noise boolean, sample_label string")
    got = {r.cluster_id: r for r in enrichment.evaluation_enrichment(a).collect()}
    assert got[0].p_value == 0 and got[1].p_value == 1 and got[0].total_sample == 4 and got[0].is_significant and not got[1].is_significant
    row = enrichment.summarize_enrichment(enrichment.evaluation_enrichment(a)).first()
    assert row.number_of_significant_enriched_clusters == 1 and row.retained_fraction == 0.75 and row.background_contamination == 0


def test_fisher_of_any_margins_against_whole_laws():
    import time
    from fractions import Fraction
    from math import comb

    rng = np.random.default_rng(5)
    tables = [tuple(int(v) for v in rng.integers(0, m, 4)) for m in (3, 6, 30, 60) for _ in range(25)] + [(0, 0, 0, 0), (0, 5, 0, 7), (9, 0, 0, 9), (0, 9, 9, 0), (40, 2, 3, 60)]
    greater, both = stats.hypergeometric_tails(*np.array(tables, float).T)
    for (a, b, c, d), g, t in zip(tables, greater, both, strict=True):
        row, col, n = a + b, a + c, a + b + c + d
        law = {x: Fraction(comb(row, x) * comb(n - row, col - x), comb(n, col)) for x in range(max(0, row + col - n), min(row, col) + 1)}
        assert g == pytest.approx(float(sum(p for x, p in law.items() if x >= a)), rel=1e-9, abs=1e-14)
        assert t == pytest.approx(float(sum(p for p in law.values() if p <= law[a] * (1 + Fraction(1, 10**7)))), rel=1e-9, abs=1e-14)
    began = time.time()
    m = 10**8
    greater, both = stats.hypergeometric_tails(*np.array([(m // 2, m // 2, m // 2, m // 2), (m // 2 + 10_000, m // 2, m // 2, m // 2 + 10_000), (5, m, 3, m)], float).T)
    # the second is 5000 above its mean, with a variance of m / 8: the root of 2 in spreads; the third is 5 of 8 by fair coins
    assert greater[0] == pytest.approx(0.5, abs=1e-3) and both[0] == pytest.approx(1)
    assert both[1] == pytest.approx(2 * greater[1], rel=1e-3) and greater[1] == pytest.approx(math.erfc(1) / 2, rel=1e-3)
    assert greater[2] == pytest.approx(sum(comb(8, k) for k in (5, 6, 7, 8)) / 256, rel=1e-6)
    assert time.time() - began < 30


def test_fdr_of_a_large_group_in_many_tasks(spark, monkeypatch):
    rows = spark.range(900).select(F.when(F.col("id") % 9 == 0, None).otherwise((F.col("id") % 3 == 0).cast("int")).alias("g"), "id", F.when(F.col("id") % 11 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(400)) / 400).alias("p")).repartition(6)
    want = {r.id: (r.g, r.p, r.q) for r in stats.with_fdr(rows, "p", "q", ["g"], ["id"]).collect()}
    whole = {r.id: r.q for r in stats.with_fdr(rows, "p", "q", ties=["id"]).collect()}
    monkeypatch.setattr(stats.ranges, "ONE_TASK", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: (r.g, r.p, r.q) for r in stats.with_fdr(rows, "p", "q", ["g"], ["id"]).collect()}
        again = {r.id: r.q for r in stats.with_fdr(rows, "p", "q", ties=["id"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 900 and got == want and again == whole
    p = sorted((v[1], i) for i, v in want.items() if v[1] is not None)
    q, least = {}, 1.0
    for k in range(len(p), 0, -1):
        least = min(least, p[k - 1][0] * len(p) / k)
        q[p[k - 1][1]] = least
    assert {i: v for i, v in whole.items() if v is not None} == pytest.approx(q)
