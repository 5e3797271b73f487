import random

from kithara.llm import line_dedup, queries

LEAST = 6


def whole_runs(rows, least):
    """Texts without the lines of any run of `least` words or more that stands earlier, whatever its length."""
    seen, runs = {}, []
    for at, (_, text) in enumerate(rows):
        lines = [(n, tuple(x.lower().split())) for n, x in enumerate(text.split("\n")) if x.split()]
        for i in range(len(lines)):
            for j in range(i, len(lines)):
                run = tuple(x for _, x in lines[i : j + 1])
                if sum(map(len, run)) >= least:
                    place = (at, lines[i][0])
                    seen[run] = min(seen.get(run, place), place)
                    runs.append((run, place, lines[j][0]))
    cut = [[] for _ in rows]
    for run, (at, head), tail in runs:
        if seen[run] < (at, head):
            cut[at].append((head, tail))
    out = []
    for (key, text), ranges in zip(rows, cut, strict=True):
        merged = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        gone = {i for a, b in merged for i in range(a, b + 1)}
        out.append((key, "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)))
    return out


def test_runs_are_deleted_to_their_ends(spark):
    rnd = random.Random(4)
    pool = [" ".join("w%d" % rnd.randint(0, 50) for _ in range(rnd.choice([1, 1, 2, 3, 5, 7]))) for _ in range(30)]
    passage = [rnd.choice(pool) for _ in range(9)]
    rows = []
    for i in range(50):
        lines = [rnd.choice([*pool, "", "  "]) if rnd.random() < 0.3 else f"own {i} {rnd.random()} line" for _ in range(rnd.randint(0, 12))]
        if rnd.random() < 0.5:
            a = rnd.randint(0, 5)
            lines[2:2] = passage[a : a + rnd.randint(2, 9)]
        rows.append((i, "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = whole_runs(rows, LEAST)
    assert sorted((r.doc_id, r.text) for r in line_dedup.dedup(docs, LEAST).collect()) == want


def lines_of(*words):
    """A run of lines of so many words."""
    return "\n".join(" ".join(f"r{i}x{k}" for k in range(n)) for i, n in enumerate(words))


def test_runs_whose_ends_hold_no_window(spark):
    texts = [(1, "first of one\n" + lines_of(20, 5, 6) + "\nend of one"), (2, "first of two\n" + lines_of(20, 5, 6) + "\nend of two")]
    long_ = lines_of(5, 20, 9, 10).replace("r", "q")
    texts += [(3, "first of three\n" + long_ + "\nend of three"), (4, long_)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: texts[0][1], 2: "first of two\nend of two", 3: texts[2][1], 4: ""}


def test_a_longer_run_may_stand_elsewhere_than_its_first_window(spark):
    window, tail = lines_of(12, 12), "two words"
    texts = [(1, window + "\nother line"), (2, window + "\n" + tail + "\nown of two"), (3, window + "\n" + tail + "\nown of three")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: texts[0][1], 2: tail + "\nown of two", 3: "own of three"}


def test_a_hot_line_and_a_hot_window(spark):
    """One run in every document, and one line that is common but never in a repeated run."""
    run = lines_of(8, 9, 7)
    texts = [(i, f"own {i} first\nthe common line\nown {i} then\n{run}\nlast {i}") for i in range(3000)]
    found = line_dedup.repeated_runs(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)).collect()
    assert len(found) == 2999 and all([tuple(x) for x in r.runs] == [(3, 5, 0)] for r in found)


def test_query_deletes_short_tail(spark, tmp_path):
    long_, short = " ".join(f"a{i}" for i in range(30)), "a short line of five"
    texts = [(i, f"head {i}\n{long_}\n{short}\nend {i}") for i in range(4)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed_lines for r in queries.op5_line_winnowing(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 2, 2: 2, 3: 2}
