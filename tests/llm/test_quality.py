import random

import numpy as np
import pyarrow as pa
import pytest

from kithara.llm import quality


def corpus(n=700, seed=4):
    """Prose is good; words with symbols after them, capitals and words said again and again are not."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rnd.choice(["an", "er", "th", "é", "on", "in"]) for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(4, 250))]
        good = int(rnd.random() < 0.8)
        if not good:
            kind = rnd.randint(0, 2)
            words = [w + "$$$" for w in words] if kind == 0 else [w.upper() + "!" for w in words] if kind == 1 else words[:2] * (len(words) // 2)
        rows.append((i, " ".join(words), good))
    return rows


@pytest.fixture(scope="module")
def small():
    p = quality.started(1)
    rng = np.random.default_rng(2)
    p["bias"] += rng.normal(0, 0.3, quality.FILTERS).astype(np.float32)
    return p


def plain_logit(p, text):
    """Window by window and chunk by chunk."""
    lead = quality.WIDTH - 1
    hops = -(-(len(text) + lead) // quality.HOP)
    symbols = [quality.PAD] * lead + list(text) + [quality.PAD] * (hops * quality.HOP - len(text))
    best = []
    for h in range(hops):
        found = [np.concatenate([p["bytes"][symbols[w + k]] for k in range(quality.WIDTH)]) @ p["filters"] for w in range(h * quality.HOP, (h + 1) * quality.HOP)]
        best.append(np.max(found, axis=0))
    chunks = [np.maximum(best[k], best[k + 1]) for k in range(hops - 1)] or best
    f = np.maximum(np.array(chunks) + p["bias"], 0)
    hidden = np.maximum(np.concatenate([f.mean(0), f.max(0)]) @ p["hidden"] + p["hidden_bias"], 0)
    return hidden @ p["out"] + p["out_bias"][0]


def test_network_against_loops_and_chunks_stay_within_a_text(small, monkeypatch):
    texts = ["", "a", "short one", "x" * 119, "y" * 120, "z" * 121, "é long " * 90, None, "w\n" * 700]
    m = quality.Model(small)
    want = [1 / (1 + np.exp(-plain_logit(small, (t or "").encode()))) for t in texts]
    assert np.allclose(quality.score_texts(m, pa.array(texts)), want, atol=1e-5)
    monkeypatch.setattr(quality, "SLICE", 256)
    assert np.allclose(quality.score_texts(m, pa.array(texts)), want, atol=1e-5)
    assert np.allclose(quality.score_texts(m, pa.array(["left", *texts])[1:]), want, atol=1e-5)
    assert len(quality.score_texts(m, pa.array([], pa.string()))) == 0


def test_gradients_against_differences(small):
    p = {k: v.astype(np.float64) for k, v in small.items()}
    rng = np.random.default_rng(7)
    texts = [rng.integers(32, 120, n).astype(np.uint8) for n in (5, 300, 700, 130)]
    raw, off = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    y = np.array([1.0, 0, 1, 0])

    def loss():
        z = quality.logits(quality.Model(p), raw, off)
        return np.mean(np.log1p(np.exp(z)) - y * z)

    g = quality.gradients(p, raw, off, y)
    for name, value in p.items():
        flat, got = value.reshape(-1), g[name].reshape(-1)
        for i in np.argsort(-np.abs(got))[:3]:
            kept, step = flat[i], 1e-3
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert (up - down) / (2 * step) == pytest.approx(got[i], rel=0.05, abs=2e-4), (name, i)


def test_held_out_accuracy_and_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t, _ in rows], "doc_id long, text string, quality_score string, _order string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, quality int")
    m = quality.train(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, m).collect()}
    assert len(got) == len(rows)
    held = [(got[i], y) for i, _, y in rows if i % 5 == 0]
    assert all(0 <= s <= 1 for s, _ in held)
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.95
    again = quality.train(docs.repartition(5), labels)
    assert all(np.array_equal(m.params[k], again.params[k]) for k in m.params)
    # whole texts count: junk at the end of a long clean text changes its score
    clean = next(t for i, t, y in rows if y and len(t) > 900)
    long = " ".join([clean] * 30)
    a, b = quality.score_texts(m, pa.array([long, long + " $$$".join(["x" * 9] * 2000)]))
    assert b < a


def test_nulls_empty_long_and_one_class(spark):
    rows = corpus(150) + [(1000, None, 0), (1001, "", 1), (1002, "prose " * 60000, 1), (None, "th an", 0), (7, "again", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1), (5000, 1)], "doc_id long, quality int")
    m = quality.train(docs, labels)
    got = quality.score(docs, m).collect()
    assert len(got) == len(rows) and all(0 <= r.quality_score <= 1 for r in got)
    assert len({r.quality_score for r in got if r.doc_id in (1000, 1001)}) == 1
    assert quality.score(docs.limit(0), m).count() == 0
    for none in (labels.limit(0), labels.filter("quality = 1")):
        one = quality.train(docs, none)
        assert one.constant is not None and 0 <= one.constant <= 1
        assert quality.score(docs, one).agg({"quality_score": "max"}).first()[0] == one.constant


def test_the_sample_is_bounded(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda texts, good, counts: seen.update(texts=texts, good=good, counts=counts))
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    quality.train(docs, labels, sample_bytes=5000)
    for c in (0, 1):
        assert 0 < sum(len(t) for t, g in zip(seen["texts"], seen["good"]) if g == c) <= 5000
    assert sum(seen["counts"]) == 200
    quality.train(docs, labels, sample=9)
    assert len(seen["texts"]) == 18
