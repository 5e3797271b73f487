"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (say domain, language, source). At every node it is dealt to the
children in proportion to their weights; a child that cannot use its share (its subtree holds too
few tokens, even when repeated `max_epochs` times) keeps what it can and the rest goes to its
siblings. Only what all siblings together cannot use was already withheld one level up, so
shortages move among siblings before they move among ancestors. Every leaf then reads its rows in
seeded epochs: an epoch is a permutation of the leaf's rows, whole epochs are taken first, and of
the last epoch the shortest prefix that reaches the leaf's budget.

Defined results: a null text has no tokens; null level values form a branch of their own; a leaf
without tokens gets no budget and none of its rows; weight 0 excludes a subtree; repeated rows are
rows of their own; the permutation is by a hash of key and text, so rows of one key, or of a null
key, are permuted as well, and rows that still tie are alike; a very long text is one row, of which
the last epoch may take a part; an empty table gives an empty result; input columns named like the
added ones are replaced; an empty text is a row without tokens. Budgets are integers and add up exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kithara.session import free_of, written

#: Levels are compared as text; this stands for a null.
NONE = "␀"
OUT = ("mix_path", "mix_epoch", "mix_tokens", "mix_taken")
ROWS_A_RANGE = 1000
WORDS = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it is; the whole text if it has no more."""
    parts = F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])")
    return F.when(word_count(text) <= n, text).otherwise(F.array_join(F.slice(parts, F.lit(1), n.cast("int")), ""))


def taken_text(mixed: DataFrame, text: str = "text") -> DataFrame:
    """Rows of `mix` with their texts cut to the tokens that were taken."""
    cut = F.when(F.col("mix_taken") < F.col("mix_tokens"), first_words(F.col(text), F.col("mix_taken"))).otherwise(F.col(text))
    return mixed.withColumn(text, cut)


def _weight(levels: Sequence[str], weights: Mapping[tuple, int]) -> Column:
    """The weight of the node named by `levels`; 1 where none is given."""
    own = {k: v for k, v in weights.items() if len(k) == len(levels)}
    if not own:
        return F.lit(1).cast("decimal(38,0)")
    name = F.concat_ws("\x1f", *levels)
    known = F.create_map(*[F.lit(x) for k, v in own.items() for x in ("\x1f".join(k), int(v))])
    return F.coalesce(F.try_element_at(known, name), F.lit(1)).cast("decimal(38,0)")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[tuple, int], share: tuple[int, int], max_epochs: int) -> DataFrame:
    """One row a leaf with its token budget, from one row a leaf with its `tokens`.

    share: the whole budget as a fraction (numerator, denominator) of all tokens.
    """
    whole = "decimal(38,0)"
    nodes = leaves.select(*levels, F.col("tokens").cast(whole).alias("tokens"))
    live = F.lit(1).cast(whole)
    for depth in range(1, len(levels) + 1):
        w = _weight(levels[:depth], weights)
        nodes = nodes.withColumn(f"w{depth}", w)
        live = live * F.when(w > 0, F.lit(1)).otherwise(F.lit(0)).cast("decimal(1,0)")
    nodes = nodes.withColumn("cap", F.expr("CAST(tokens * %d AS decimal(38,0))" % max_epochs) * F.when(live > 0, F.lit(1)).otherwise(F.lit(0)).cast("decimal(1,0)"))
    nodes = nodes.withColumn("cap", F.col("cap").cast(whole))
    all_tokens = F.sum("tokens").over(Window.partitionBy())
    top = F.floor(all_tokens * share[0] / share[1]).cast(whole)
    nodes = nodes.withColumn("given0", F.least(top, F.sum("cap").over(Window.partitionBy()).cast(whole)))
    for depth in range(1, len(levels) + 1):
        parent, node = list(levels[: depth - 1]), list(levels[:depth])
        cap, w, given = f"c{depth}", f"w{depth}", f"given{depth - 1}"
        level = nodes.groupBy(*node).agg(F.sum("cap").cast(whole).alias(cap), F.first(w).alias(w), F.first(given).alias("P"))
        level = level.withColumn(w, F.when(F.col(cap) > 0, F.col(w)).otherwise(F.lit(0)).cast(whole))
        ratio = (F.col(cap).cast("double") / F.nullif(F.col(w), F.lit(0)).cast("double")).alias("ratio")
        order = Window.partitionBy(*parent).orderBy(F.coalesce(ratio, F.lit(0.0)), levels[depth - 1])
        before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
        level = level.withColumns({
            "used": F.coalesce(F.sum(cap).over(before), F.lit(0)).cast(whole),
            "open_w": F.coalesce(F.sum(w).over(after), F.lit(0)).cast(whole),
        })
        full = (F.col(cap) * F.col("open_w")).cast(whole) <= (F.col(w) * (F.col("P") - F.col("used")).cast(whole)).cast(whole)
        level = level.withColumn("full", full)
        siblings = Window.partitionBy(*parent)
        level = level.withColumns({
            "rest": (F.col("P") - F.sum(F.when(F.col("full"), F.col(cap)).otherwise(F.lit(0).cast(whole))).over(siblings)).cast(whole),
            "rest_w": F.sum(F.when(F.col("full"), F.lit(0).cast(whole)).otherwise(F.col(w))).over(siblings).cast(whole),
        })
        level = level.withColumn("even", F.when(F.col("full"), F.col(cap)).otherwise(F.expr(f"CAST(CAST(rest * {w} AS decimal(38,0)) div nullif(rest_w, 0) AS decimal(38,0))")))
        lost = F.col("rest") - F.sum(F.when(F.col("full"), F.lit(0).cast(whole)).otherwise(F.col("even"))).over(siblings)
        nth = F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.lit(1))).over(order.rowsBetween(Window.unboundedPreceding, 0))
        level = level.withColumns({"lost": lost, "nth": nth})
        one = F.when(~F.col("full") & (F.col("nth") <= F.col("lost")), F.lit(1)).otherwise(F.lit(0)).cast(whole)
        level = level.select(*node, (F.coalesce(F.col("even"), F.lit(0).cast(whole)) + one).cast(whole).alias(f"given{depth}"))
        nodes = nodes.join(level, node)
    return nodes.select(*levels, F.col("tokens").cast("long").alias("tokens"), F.col(f"given{len(levels)}").cast("long").alias("budget"))


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[tuple, int],
    share: tuple[int, int] = (1, 1),
    max_epochs: int = 4,
    seed: int = 7,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """The chosen rows with all their columns and mix_path, mix_epoch, mix_tokens, mix_taken.

    levels: name to expression, from the root down. A row comes once for each epoch that takes it.
    mix_taken is smaller than mix_tokens only where a leaf's budget ends inside that row.

    The rows of a leaf are never gathered: prefix sums over hash ranges tell which range the budget
    ends in, and only that range is ordered row by row. Ranges follow the leaf's rows: each is a
    prefix of the hash, as long as is needed for ROWS_A_RANGE rows or fewer.
    """
    names = [f"_mix_{i}" for i in range(len(levels))]
    docs = free_of(docs, [*names, *OUT, "_whole", "_rest", "_digits", "_print", "_draw", "_range", "_end", "_before"])
    path = [F.coalesce(e.cast("string"), F.lit(NONE)).alias(n) for n, e in zip(names, levels.values(), strict=True)]
    rows = docs.withColumn("mix_tokens", word_count(F.col(text)))
    leaves = rows.select(*path, "mix_tokens").groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("n"))
    leaves = written(leaves, "leaf_tokens")
    digits = leaves.select(*names, F.greatest(F.lit(1), F.ceil(F.log(16.0, F.col("n") / ROWS_A_RANGE))).cast("int").alias("_digits"))
    leaves = budgets(leaves, names, weights, share, max_epochs).join(digits, names)
    leaves = leaves.withColumn("_whole", F.expr("coalesce(budget div nullif(tokens, 0), 0)"))
    leaves = leaves.withColumn("_rest", F.col("budget") - F.col("_whole") * F.col("tokens"))
    leaves = written(leaves.select(*names, "_whole", "_rest", "_digits"), "leaves")

    def drawn(frame: DataFrame) -> DataFrame:
        own = [F.coalesce(x, F.lit(NONE)) for x in (F.col(key).cast("string"), F.col("_print"))]
        word = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_whole"), *own))
        return frame.withColumn("_draw", word).withColumn("_range", F.substring(F.col("_draw"), F.lit(1), F.col("_digits")))

    slim = docs.select(*path, F.col(key), F.md5(text).alias("_print"), word_count(F.col(text)).alias("mix_tokens"))
    slim = drawn(slim.join(leaves.filter("_rest > 0"), names))
    sums = slim.groupBy(*names, "_rest", "_range").agg(F.sum("mix_tokens").alias("sum"))
    upto = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("sum").over(upto), F.lit(0)))
    ends = sums.filter((F.col("_before") < F.col("_rest")) & (F.col("_before") + F.col("sum") >= F.col("_rest")))
    ends = ends.select(*names, F.col("_range").alias("_end"), "_before")
    leaves = written(leaves.join(ends, names, "left"), "leaf_ends")

    rows = rows.select("*", F.md5(text).alias("_print"), *path).join(leaves, names).withColumn("mix_path", F.array(*names))
    kept = [*docs.columns, *OUT]
    whole = rows.filter("_whole > 0").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole") - 1)))
    whole = whole.withColumn("mix_taken", F.col("mix_tokens")).select(*kept)
    last = drawn(rows.filter("_rest > 0")).withColumn("mix_epoch", F.col("_whole"))
    early = last.filter(F.col("_range") < F.col("_end")).withColumn("mix_taken", F.col("mix_tokens")).select(*kept)
    order = Window.partitionBy(*names).orderBy("_draw", "mix_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = last.filter(F.col("_range") == F.col("_end"))
    edge = edge.withColumn("_before", F.col("_before") + F.coalesce(F.sum("mix_tokens").over(order), F.lit(0)))
    edge = edge.filter(F.col("_before") < F.col("_rest"))
    edge = edge.withColumn("mix_taken", F.least("mix_tokens", F.col("_rest") - F.col("_before"))).select(*kept)
    return whole.unionByName(early).unionByName(edge)
