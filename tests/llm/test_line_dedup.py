import random

from kithara.llm import line_dedup

LEAST = 6


def slow(rows, least):
    """Texts without the lines of any run of `least` words or more, of whatever length, that stands earlier."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    seen, runs = {}, []
    for at, (_, text) in enumerate(distinct):
        lines = [(n, tuple(x.lower().split())) for n, x in enumerate((text or "").split("\n")) if x.split()]
        for i in range(len(lines)):
            run, total = (), 0
            for j in range(i, len(lines)):
                run, total = hash((run, lines[j][1])), total + len(lines[j][1])
                if total >= least:
                    place = (at, lines[i][0])
                    seen[run] = min(seen.get(run, place), place)
                    runs.append((run, place, lines[j][0]))
    gone = [set() for _ in distinct]
    for run, (at, head), tail in runs:
        if seen[run] < (at, head):
            gone[at].update(range(head, tail + 1))
    by = {r: None if r[1] is None else "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in g) for r, g in zip(distinct, gone, strict=True)}
    return [(r[0], by[r]) for r in rows]


def corpus(n=60, seed=3):
    rnd = random.Random(seed)
    pool = [" ".join("w%d" % rnd.randint(0, 50) for _ in range(rnd.choice([1, 1, 2, 3, 7, 12]))) for _ in range(40)]
    passage = [rnd.choice(pool) for _ in range(9)]
    rows = []
    for i in range(n):
        lines = [rnd.choice(pool + ["", "  "]) if rnd.random() < 0.3 else f"own {i} {rnd.random()} line" for _ in range(rnd.randint(0, 15))]
        if rnd.random() < 0.4:
            a = rnd.randint(0, 5)
            lines[2:2] = [x.upper() + " " for x in passage[a : a + rnd.randint(2, 9)]]
        if rnd.random() < 0.2:
            lines += ["same short"] * rnd.randint(1, 8)
        rows.append((i, "\n".join(lines)))
    return rows + [(None, "\n".join(passage)), (200, None), (201, ""), (5, rows[5][1]), (202, rows[7][1]), (203, "x " * 4000 + "\n" + "y\n" * 300)]


def test_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id long, text string, line_runs string").repartition(5)
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup(docs, LEAST).collect()), key=str)
    assert got == sorted(slow(rows, LEAST), key=str)
    assert sum(a != b for a, b in zip(sorted(rows, key=str), sorted(slow(rows, LEAST), key=str), strict=True)) > 10
    assert line_dedup.dedup(docs.limit(0), LEAST).count() == 0


def test_passage_over_fifty_words_is_kept_once(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    docs = spark.createDataFrame([(i, f"head {i} of it\n{passage}\ntail {i} of it") for i in range(20)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()}
    assert [i for i in got if passage in got[i]] == [0]
    assert all(got[i] == f"head {i} of it\ntail {i} of it" for i in range(1, 20))


def test_only_selected_lines_are_grouped_and_only_repeated_ones_opened(spark, monkeypatch):
    """Of texts without repeats nothing but selections is written; windows are those that selected a repeated line."""
    rnd = random.Random(9)
    own = lambda i: "\n".join(" ".join(f"{i}x{rnd.randint(0, 10**9)}" for _ in range(rnd.randint(1, 9))) for _ in range(60))
    passage = "\n".join(f"p{k} of the passage that repeats" for k in range(8))
    rows = [(i, own(i) + ("\n" + passage if i < 3 else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tables = {}
    monkeypatch.setattr(line_dedup, "written", lambda df, label: tables.setdefault(label, df.cache()))
    runs = line_dedup.repeated_runs(docs).collect()
    assert sorted(r.key for r in runs) == [1, 2]
    lines = tables["lines"].collect()
    selected, all_ = sum(len(r.spots) for r in lines), sum(len(r.hash) for r in lines)
    assert selected < 0.5 * all_
    windows = tables["windows"].collect()
    assert {r.key for r in windows} == {0, 1, 2} and len(windows) < 3 * 10
    assert tables["open_lines"].count() == 3
