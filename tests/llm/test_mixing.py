import hashlib
import random
import re

from pyspark.sql import functions as F

from kithara.llm import mixing

WEIGHTS = {("d0",): 3, ("d1",): 1, ("d0", "en"): 5, ("d0", "fr"): 1, ("d2",): 0, ("d0", "en", "s1"): 4}


def tokens(t):
    return len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))


def share_out(caps, weights, budget):
    """Water-filling by repeated rounds; the rest after rounding goes one by one in order of cap / weight."""
    caps = {k: (c if weights[k] else 0) for k, c in caps.items()}
    out, open_ = dict.fromkeys(caps, 0), {k for k, c in caps.items() if c}
    budget = min(budget, sum(caps.values()))
    while open_:
        w = sum(weights[k] for k in open_)
        left = budget - sum(out[k] for k in caps if k not in open_)
        full = {k for k in open_ if caps[k] * w <= weights[k] * left}
        if not full:
            order = sorted(open_, key=lambda k: (caps[k] / weights[k], k))
            for k in order:
                out[k] = left * weights[k] // w
            for k in order[: left - sum(out[k] for k in order)]:
                out[k] += 1
            break
        for k in full:
            out[k] = caps[k]
        open_ -= full
    return out


def brute(rows, share, epochs, seed):
    leaves = {}
    for k, t, *path in rows:
        leaves.setdefault(tuple(mixing.NONE if p is None else p for p in path), []).append((k, tokens(t), mixing.NONE if t is None else hashlib.md5(t.encode()).hexdigest()))
    size = {p: sum(n for _, n, _ in r) for p, r in leaves.items()}
    weight = lambda p: WEIGHTS.get(p, 1)
    cap = {p: n * epochs if all(weight(p[:d]) for d in (1, 2, 3)) else 0 for p, n in size.items()}
    given = {(): min(sum(size.values()) * share[0] // share[1], sum(cap.values()))}
    for d in (1, 2, 3):
        for up in {p[: d - 1] for p in leaves}:
            kids = {p[:d] for p in leaves if p[: d - 1] == up}
            given |= share_out({k: sum(c for p, c in cap.items() if p[:d] == k) for k in kids}, {k: weight(k) for k in kids}, given[up])
    out = []
    for p, r in leaves.items():
        if not size[p]:
            continue
        whole, rest = divmod(given[p], size[p])
        out += [(k, p, e, n) for e in range(whole) for k, n, _ in r]
        key = lambda x: (hashlib.md5(f"{seed}|{whole}|{mixing.NONE if x[0] is None else x[0]}|{x[2]}".encode()).hexdigest(), x[1])  # noqa: B023, E731
        for k, n, _ in sorted(r, key=key):
            if rest <= 0:
                break
            out.append((k, p, whole, min(n, rest)))
            rest -= n
    return out, given


def corpus(seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        d = rnd.choice(["d0"] * 5 + ["d1", "d2", None])
        rows.append((i, "w " * rnd.choice([0, 1, 5, 40]), d, rnd.choice(["en", "en", "fr", None]), rnd.choice(["s1", "s1", "s1", "s2", "s3"])))
    return rows + [(None, "a b c", "d1", "en", "s9"), (7, "x y", "d1", "en", "s9"), (7, "x y", "d1", "en", "s9"), (900, None, "d3", "en", "s0"), (901, "long " * 30000, "d4", "de", "s1")]


def run(docs, share, epochs):
    levels = {"domain": F.col("domain"), "lang": F.col("lang"), "source": F.col("source")}
    return mixing.mix(docs, levels, WEIGHTS, share, epochs, 7)


def test_equals_brute_force(spark):
    schema = "doc_id long, text string, domain string, lang string, source string"
    for seed, share, epochs in ((0, (3, 4), 4), (1, (2, 1), 3), (2, (1, 50), 1), (3, (9, 1), 2)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, schema).withColumn("mix_epoch", F.lit("clash")).repartition(5)
        got = [(r.doc_id, tuple(r.mix_path), r.mix_epoch, r.mix_taken) for r in run(docs, share, epochs).collect()]
        want, given = brute(rows, share, epochs, 7)
        assert sorted(got, key=str) == sorted(want, key=str)
        assert sum(x[3] for x in got) == given[()] == sum(v for p, v in given.items() if len(p) == 3)


def test_empty_and_zero(spark):
    schema = "doc_id long, text string, domain string, lang string, source string"
    docs = spark.createDataFrame([(1, None, "d0", "en", "s1"), (2, "", "d1", "en", "s1")], schema)
    assert run(docs, (1, 1), 2).count() == 0
    assert run(docs.limit(0), (1, 1), 2).count() == 0


def test_rows_of_a_null_key_are_spread_over_the_ranges(spark, monkeypatch):
    """A third of all rows has no key; the range in which the budget ends still holds few rows."""
    monkeypatch.setattr(mixing, "ROWS_A_RANGE", 20)
    schema = "doc_id long, text string, domain string, lang string, source string"
    rows = [(None if i % 3 == 0 else i, "w " * (1 + i % 4) + str(i), "d0", "en", "s1") for i in range(6000)]
    docs = spark.createDataFrame(rows, schema)
    first = sorted(map(str, run(docs, (1, 2), 1).collect()))
    assert sorted(map(str, run(docs.repartition(7), (1, 2), 1).collect())) == first
    drawn = {hashlib.md5(f"7|0|{mixing.NONE if k is None else k}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest() for k, t, *_ in rows}
    ranges = [sum(d.startswith(f"{x:03x}") for d in drawn) for x in range(0, 4096, 64)]
    assert len(drawn) == 6000 and max(ranges) < 20


def test_taken_texts_are_cut_at_the_token(spark):
    rows = [(0, "  one two\n three\tfour ", 4, 2), (1, "one two", 2, 2), (2, "é\u00a0x y", 2, 1), (3, None, 0, 0), (4, "a " * 30000, 30000, 29999)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mix_tokens long, mix_taken long")
    got = {r.doc_id: r.text for r in mixing.taken_text(df).collect()}
    assert got == {0: "  one two", 1: "one two", 2: "é\u00a0x", 3: None, 4: ("a " * 29999).rstrip()}
