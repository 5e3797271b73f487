import math
import random
import re
from collections import Counter

import pytest

from kithara.llm import decontamination as dc


def words(t):
    return re.findall(rb"[a-z0-9\x80-\xff]+", (t or "").encode().lower())


def grams(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def overlap(part, own):
    k = min(5, len(part))
    return len(grams(part, k) & grams(own, k)) / len(grams(part, k)) if k else 1


def slow(docs, items):
    items = [(i, words(q), words(a)) for i, q, a in items if words(q) + words(a)]
    all_ = [q + a for _, q, a in items]
    n, mean = len(all_), sum(map(len, all_)) / len(all_)
    df = Counter(t for w in all_ for t in set(w))
    length = max([32, *map(len, all_)])
    out = set()
    impact = []
    for w in all_:
        s = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, f in Counter(w).items()}
        total = sum(s.values())
        impact.append({t: x / total for t, x in s.items()})
    for d, text in docs:
        w = words(text)
        for a in range(0, max(1, len(w)), length):
            own = w[a : a + 2 * length]
            if not own:
                continue
            for (i, q, ans), s in zip(items, impact, strict=True):
                if sum(s.get(t, 0) for t in set(own)) >= dc.THRESHOLD - 1e-4:
                    if min(overlap(q, own), overlap(ans, own)) >= dc.OVERLAP:
                        out.add((d, i))
    return out


def corpus(seed=1, n_items=60):
    rnd = random.Random(seed)
    vocab = [f"v{i}" for i in range(300)]
    pick = lambda k: " ".join(rnd.choices(vocab, [1 / (i + 1) for i in range(300)], k=k))
    items = [(i, pick(rnd.randint(1, 40)), pick(rnd.randint(0, 8))) for i in range(n_items)] + [(900, "", ""), (901, "?!", "")]
    docs = []
    for d in range(120):
        text = pick(rnd.randint(0, 300))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            i, q, a = rnd.choice(items)
            part = (q + ". " + a).split()
            if rnd.random() < 0.4 and part:
                part[rnd.randrange(len(part))] = "changed"
            at = text.split()
            k = rnd.randint(0, len(at))
            text = " ".join(at[:k] + [x.title() + rnd.choice(["", "***", ","]) for x in part] + at[k:])
        docs.append((d, text))
    return docs + [(500, None), (501, ""), (502, docs[0][1]), (None, docs[1][1])], items


@pytest.mark.parametrize(("shard", "entries"), [(1024, 4_000_000), (16, 4_000_000), (1024, 300), (7, 40)])
def test_equals_brute_force_whatever_the_shards_and_passes(spark, monkeypatch, shard, entries):
    monkeypatch.setattr(dc, "SHARD", shard)
    monkeypatch.setattr(dc, "PASS_ENTRIES", entries)
    docs, items = corpus()
    want = slow(docs, items)
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, bm25_share int, _key int").repartition(4)
    table = spark.createDataFrame([(*x, "clash") for x in [*items, items[3]]], "item_id long, question string, answer string, text string")
    rows = dc.matches(frame, table).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in rows) == sorted((str(d), i) for d, i in want) and len(want) > 30
    kept = dc.clean(frame.drop("_key"), table)
    assert kept.columns == ["doc_id", "text", "bm25_share"]
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_reported_shares_do_not_depend_on_the_passes(spark, monkeypatch):
    docs, items = corpus(2)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    table = spark.createDataFrame(items, "item_id long, question string, answer string")
    whole = sorted(map(str, dc.matches(frame, table).collect()))
    monkeypatch.setattr(dc, "PASS_ENTRIES", 100)
    assert sorted(map(str, dc.matches(frame, table).collect())) == whole and whole
    for a, b in ((frame.limit(0), table), (frame, table.limit(0))):
        assert dc.matches(a, b).count() == 0


def test_item_inside_a_very_long_text(spark):
    rnd = random.Random(3)
    pick = lambda k: " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(k))
    question, answer = pick(30), pick(8)
    docs = [(1, pick(150_000) + " " + question + " " + answer + " " + pick(50_000)), (2, pick(100_000))]
    table = spark.createDataFrame([(7, question, answer)], "item_id long, question string, answer string")
    found = dc.matches(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()
    assert [(r.doc_id, r.item_id) for r in found] == [(1, 7)] and 149_900 <= found[0].word <= 150_000


def test_split_of_items(spark):
    items = spark.createDataFrame([(1, "Who is it?\nNobody at all"), (2, "One. Two. Three"), (3, "only"), (4, None), (5, "a\n")], "item_id long, text string")
    got = {r.item_id: (r.question, r.answer) for r in dc.split_items(items).collect()}
    assert got == {1: ("Who is it?", "Nobody at all"), 2: ("One. Two", "Three"), 3: ("only", ""), 4: ("", ""), 5: ("a\n", "")}
