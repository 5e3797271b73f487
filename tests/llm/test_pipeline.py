import random

import pytest

import corpus_pipeline
from kithara.llm import decontamination
from kithara.llm import queries as q

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small folder of tables with planted copies, leaks and toxic documents."""
    rnd = random.Random(6)
    vocab = [f"word{i}" for i in range(900)]
    pick = lambda k: " ".join(rnd.choices(vocab, k=k))
    items = [(i, pick(30) + "\n" + pick(8)) for i in range(12)]
    docs, labels = [], []
    for i in range(500):
        toxic = rnd.random() < 0.15
        text = pick(rnd.randint(30, 150)).split()
        if toxic:
            for _ in range(3):
                text.insert(rnd.randint(0, len(text)), rnd.choice(["vileterm", "grimterm"]))
        docs.append((i, " ".join(text), rnd.choice(["en", "fr"]), f"src{rnd.choice([0, 0, 0, 1, 2, 3])}", 0))
        labels.append((i, 1, int(toxic)))
    docs += [(1000 + i, docs[i][1], "en", "src0", 0) for i in range(40)]
    docs += [(2000 + i, pick(20) + " " + items[i % 12][1] + " " + pick(20), "en", "src1", 0) for i in range(24)]
    docs += [(3000, None, "en", "src0", 0), (3001, "", None, None, 0), (None, pick(50), "en", "src2", 0)]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 1").collect()}
    items = [(r.item_id, *decontamination.question_and_answer(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, folder)
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        if name == "toxicity":
            gone = {k for k, _ in before} - set(ids)
            assert len(gone & toxic) > 0.9 * len(toxic) and len({g for g in gone if g is None or g < 1000} - toxic) <= 10
        elif name == "near_duplicates":
            sets = [shingles(t) for _, t in before]
            root = list(range(len(before)))
            for i in range(len(before)):
                for j in range(i):
                    both = len(sets[i] & sets[j])
                    if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                        low, high = sorted((root[i], root[j]))
                        root = [low if r == high else r for r in root]
            best = {}
            for (k, _), r in zip(before, root, strict=True):
                best[r] = min(best.get(r, k), k, key=lambda x: (x is None, x))
            assert sorted(map(str, ids)) == sorted(map(str, best.values()))
        elif name == "decontamination":
            table = spark.createDataFrame(items, "item_id long, question string, answer string")
            held = {r.doc_id for r in decontamination.matches(docs, table).collect()}
            assert {k for k in held if k is not None and k >= 2000} == {k for k, _ in before if k is not None and 2000 <= k < 3000}
            assert sorted(map(str, ids)) == sorted(str(k) for k, _ in before if k not in held)
        elif name == "mixing":
            assert set(ids) <= {k for k, _ in before} and ids
        else:
            n = [sum(r.shard == s for r in rows) for s in range(q.SHARDS)]
            assert sorted(map(str, ids)) == sorted(str(k) for k, _ in before) and max(n) - min(n) <= 1
        assert out.columns == columns + (["shard", "slot"] if name == "sharding" else [])
        path = f"{folder}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)


def test_run_and_empty_documents(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for t in ("documents", "labels", "benchmark"):
        frame = spark.read.parquet(f"{folder}/{t}.parquet")
        (frame.limit(0) if t == "documents" else frame).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_rows_clashing_columns_and_a_very_long_text(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long_ = spark.createDataFrame([(9000, "long word " * 100_000, "en", "src0", 0), (9001, "other word " * 100_000, "fr", "src1", 0)], docs.schema)
    docs = docs.unionByName(docs.limit(20)).unionByName(long_)
    names = ("shard", "_same", "_key", "_draw", "mix_path", "_whole", "toxic_score", "TOXIC_limit", "_row", "_n")
    docs = docs.select("*", *[q.F.lit(i).alias(n) for i, n in enumerate(names)])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert set(out.columns) >= {"doc_id", "text", "lang", "source", "n_chars"}
        rows = out.select("doc_id").collect()
        assert rows and {9000, 9001} <= {r.doc_id for r in rows} or name == "mixing"


def test_queries_cover_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name in ("op3_maxent_scores", "op4_token_files", "op5_line_winnowing", "op7_stratified_sharding", "op8_simhash_pigeonring", "op9_cnn_toxicity"):
        assert q.QUERIES[name](spark, SF).count() == n, name
