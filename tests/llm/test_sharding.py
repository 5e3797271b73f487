import random
from collections import Counter

from pyspark.sql import functions as F

from kithara.llm import sharding


def frame(spark, n, seed=0):
    rnd = random.Random(seed)
    rows = [(i, "t" * (i % 7), rnd.choice(["hot"] * 6 + ["a", "b", None]), -1) for i in range(n)]
    rows += rows[:3] + [(None, None, "a", 0), (None, None, None, 0)] if n > 3 else []
    return spark.createDataFrame(rows, "doc_id long, text string, source string, shard int").repartition(5)


def check(rows, shards):
    n = len(rows)
    by = Counter(r.shard for r in rows)
    assert set(by) <= set(range(shards)) and max(by.values()) - min(by.get(s, 0) for s in range(shards)) <= 1
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(by[s]))
    for src, total in Counter(r.source for r in rows).items():
        each = Counter(r.shard for r in rows if r.source == src)
        for s in range(shards):
            assert abs(each.get(s, 0) - total * by.get(s, 0) / n) <= 2


def test_law_and_mixture(spark, monkeypatch):
    for n, rows_a_range in ((1000, 100_000), (997, 2), (5, 100_000)):
        monkeypatch.setattr(sharding, "ROWS_A_RANGE", rows_a_range)
        docs = frame(spark, n)
        rows = sharding.shard(docs, 16, ties=("text",)).collect()
        assert len(rows) == docs.count()
        check(rows, 16)
        again = sharding.shard(docs.repartition(3), 16, ties=("text",)).collect()
        key = lambda r: (str(r.doc_id), str(r.source), r.shard, r.slot)
        assert sorted(map(key, rows)) == sorted(map(key, again))


def test_order_follows_the_fractional_rank(spark):
    docs = spark.createDataFrame([(i, "x", "a" if i % 4 else "b") for i in range(400)], "doc_id long, text string, source string")
    rows = sorted(sharding.shard(docs, 1).collect(), key=lambda r: r.slot)
    seen, share = Counter(), {"a": 300, "b": 100}
    hashed = spark.createDataFrame([("a",), ("b",)], "s string").select("s", F.pmod(F.xxhash64(F.lit(11), "s"), F.lit(sharding.STEPS)).alias("u"))
    offset = {r.s: r.u for r in hashed.collect()}
    last = -1.0
    for r in rows:
        rank = (seen[r.source] + offset[r.source] / sharding.STEPS) / share[r.source]
        assert rank >= last
        last = rank
        seen[r.source] += 1


def test_empty(spark):
    assert sharding.shard(frame(spark, 0), 16).count() == 0


def test_many_small_sources(spark):
    docs = spark.createDataFrame([(i, "x", f"s{i // 2}" if i < 2000 else "large") for i in range(3000)], "doc_id long, text string, source string")
    rows = sharding.shard(docs, 7).collect()
    by = Counter(r.shard for r in rows)
    assert max(by.values()) - min(by.values()) <= 1
    small = Counter(r.shard for r in rows if r.source != "large")
    assert all(abs(small[s] - 2000 / 7) < 60 for s in range(7))
    assert all(abs(sum(r.source == "large" for r in rows if r.shard == s) - 1000 / 7) < 60 for s in range(7))


def test_a_hot_null_key_is_spread_and_clashing_columns_are_replaced(spark):
    rows = [(None if i % 3 else i, f"text {i}", "a", i, i) for i in range(3000)] + [(None, "long " * 200_000, "a", 1, 1), (None, "", None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int, _rank int").repartition(4)
    got = sharding.shard(docs, 16).collect()
    check(got, 16)
    half = [r for r in got if r.doc_id is None and r.text != ""]
    first = Counter(r.shard for r in half)
    assert max(first.values()) < 2 * len(half) / 16
