import math
import random
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from kithara.llm import maxent


def corpus(n=240, seed=1):
    rnd = random.Random(seed)
    langs = [[f"{p}{i}" for i in range(60)] for p in ("aa", "bb", "cc")]
    rows = []
    for i in range(n):
        words = langs[i % 3]
        rows.append((i, " ".join(rnd.choices(words, [1 / (k + 1) for k in range(60)], k=rnd.randint(1, 200))).title()))
    return rows + [(1000, None), (1001, ""), (1002, "\x00 É é \x0b new"), (None, "aa1 aa2"), (5, rows[5][1]), (1003, "w " * 60000 + "z" * 5000)]


def words(t):
    return [*(t or "").encode().lower().split(), None]


def held(k):
    return zlib.crc32(("" if k is None else str(k)).encode()) % 10 == 0


def test_counts_and_base_against_brute_force_and_the_model_is_better(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 1.0) for k, t in rows], "doc_id long, text string, score double").repartition(5)
    out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0
    got = sorted(maxent.score(docs, out).collect(), key=lambda r: (str(r.doc_id), r.base_score))
    c = Counter(w for k, t in rows if not held(k) for w in words(t))
    total, distinct = sum(c.values()), len(c)
    want = []
    for k, t in rows:
        w = words(t)
        want.append((k, held(k), len(w), sum(c[x] > 0 for x in w), total, sum(math.log10((c[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)))
    want.sort(key=lambda r: (str(r[0]), r[5]))
    for a, b in zip(got, want, strict=True):
        assert (a.doc_id, a.held_out, a.n_tokens, a.n_known, a.train_tokens) == b[:5]
        assert abs(a.base_score - b[5]) < 1e-9 * a.n_tokens + 1e-9
    own = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in own) > sum(r.base_score for r in own) + 0.1 * sum(r.n_tokens for r in own)
    assert all(r.score < 0 for r in got)


def plain_score(m, rows, counts):
    """The model's log10 probability of each text, word by word and feature by feature."""
    mask = 2**64 - 1
    A, B = int(maxent._A), int(maxent._B)

    def mixed(x):
        x &= mask
        x = ((x ^ (x >> 33)) * A) & mask
        return x ^ (x >> 29)

    def hash_of(w):
        return int(maxent.END) if w is None else xxhash.xxh64_intdigest(w)

    def ending(w):
        return maxent.ENDINGS if w is None else (w[-1] * 31 + (w[-2] if len(w) > 1 else 0)) % maxent.ENDINGS

    out = []
    for _, text in rows:
        own = words(text)
        total = 0.0
        for i, w in enumerate(own):
            h = [hash_of(own[i - k]) if i >= k else int(maxent.BEGIN) for k in (1, 2, 3)]
            e = [ending(own[i - k]) if i >= k else maxent.ENDINGS + 1 for k in (1, 2)]
            one = mixed(h[0] + A)
            features = [one, mixed(one ^ mixed(h[1] ^ B)), mixed(h[1] + B), mixed(h[2] ^ A), mixed(e[0] + (A ^ B)), mixed(e[0] * 64 + e[1] + (A & B))]
            code = hash_of(w)
            for level in range(m.levels):
                node = code >> (64 - 4 * level) if level else 0
                branch = (code >> (60 - 4 * level)) & 15
                z = [float(x) for x in m.shares[level][node]]
                for f in maxent.BROAD if level < 2 else maxent.NARROW:
                    row = (((features[f] ^ (((node + 16**level) * B) & mask)) * A) & mask) >> (64 - m.bits)
                    z = [x + float(y) for x, y in zip(z, m.weights[row], strict=True)]  # half precision
                z = [min(x, maxent.MOST_LOGIT) for x in z]
                top = max(z)
                total += z[branch] - top - math.log(sum(math.exp(x - top) for x in z))
            total += math.log((counts[w] + 0.1) / m.mass[code >> (64 - 4 * m.levels)])
        out.append(total / math.log(10))
    return out


def test_score_equals_a_plain_loop_over_the_weights(spark):
    rows = [r for r in corpus() if r[0] != 1003]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 10 == 0
    table = maxent.chunks(docs, out, "doc_id", "text")
    m = maxent.train(table, maxent.word_counts(table))
    assert m.levels >= 1 and (m.weights != 0).any()
    assert all(maxent.np.allclose(maxent.np.exp(s).sum(1), 1, atol=1e-5) for s in m.shares)
    counts = Counter(w for k, t in rows if not held(k) for w in words(t))
    want = sorted(zip((str(k) for k, _ in rows), plain_score(m, rows, counts), strict=True))
    got = sorted((str(r.doc_id), r.score) for r in maxent.score(docs, out).collect())
    for a, b in zip(got, want, strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-4 * (1 + abs(b[1]))


def test_scores_do_not_depend_on_the_run_or_the_number_of_tasks(spark):
    docs = spark.createDataFrame(corpus(120), "doc_id long, text string")
    out = F.col("doc_id") % 7 == 0
    found = [sorted((str(r.doc_id), r.score) for r in maxent.score(docs.repartition(n), out).collect()) for n in (1, 5, 5)]
    assert found[0] == found[1] == found[2]


def test_more_vocabulary_gives_more_classes_and_more_tokens_more_rows(spark):
    small, large = ([(i, " ".join(f"w{(i * 37 + k) % v}" for k in range(400))) for i in range(n)] for n, v in ((10, 50), (2000, 6000)))
    models = []
    for rows in (small, large):
        table = maxent.chunks(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False), "doc_id", "text")
        models.append(maxent.train(table, maxent.word_counts(table)))
    assert models[0].levels < models[1].levels and models[0].bits < models[1].bits
    assert models[1].tokens == 2000 * 401 and models[1].distinct == 6001


def test_nothing_to_learn_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in maxent.score(docs, F.lit(True)).collect()}
    assert got[1].train_tokens == 0 and got[1].base_score == 0 and got[1].n_tokens == 3 and got[2].n_tokens == 1
    assert maxent.score(docs.limit(0), F.lit(False)).count() == 0
