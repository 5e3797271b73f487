"""The numbered operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithara.llm import decontamination, line_dedup, maxent, merkle, mixing, neighbours, prefix_trie, quality, sharding, simhash, token_files, toxicity, url_reputation
from kithara.session import written
from kithara.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------- op1: mixing to target weights
#: The tree is domain, language, source. A source's domain follows from its number.
MIX_DOMAINS = ("web", "books", "code", "forum")
MIX_WEIGHTS = {
    ("web",): 4, ("books",): 3, ("code",): 2, ("forum",): 1,
    ("web", "en"): 5, ("web", "fr"): 2, ("web", "de"): 2, ("web", "es"): 1,
    ("books", "en"): 2, ("books", "fr"): 3, ("books", "de"): 3, ("books", "es"): 4,
    ("code", "en"): 8, ("forum", "es"): 9,
    ("web", "en", "src0"): 2, ("books", "fr", "src5"): 3,
}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (3, 4), 4, 7


def mix_levels(lang, source) -> dict:
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    number = F.when(number != "", number.cast("int"))
    domain = F.element_at(F.array(*map(F.lit, MIX_DOMAINS)), F.coalesce(number % len(MIX_DOMAINS), F.lit(0)) + 1)
    return {"domain": domain, "lang": lang, "source": source}


def mixed(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, mix_levels(F.col("lang"), F.col("source")), MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    path = F.col("mix_path")
    return out.select(
        "doc_id", path[0].alias("domain"), path[1].alias("lang"), path[2].alias("source"),
        F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_taken").alias("taken_tokens"),
    )


def _op1_sql() -> str:
    weight = lambda n: "CASE " + " ".join(f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(('domain', 'lang', 'source'), k))} THEN {w}" for k, w in MIX_WEIGHTS.items() if len(k) == n) + " ELSE 1 END"
    number = "TRY_CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT)"
    with_ = [f"""
docs AS (SELECT doc_id, coalesce(lang, '{mixing.NONE}') AS lang, coalesce(source, '{mixing.NONE}') AS source,
  list_extract([{', '.join(map(repr, MIX_DOMAINS))}], (coalesce({number} % {len(MIX_DOMAINS)}, 0) + 1)::BIGINT) AS domain,
  coalesce(md5(text), '{mixing.NONE}') AS m, coalesce(len(regexp_extract_all(text, '{mixing.WORDS}')), 0)::HUGEINT AS t FROM documents)""", f"""
leaves AS (SELECT domain, lang, source, sum(t)::HUGEINT AS t, sum(t)::HUGEINT * {MIX_EPOCHS} AS cap FROM docs GROUP BY ALL)""", f"""
b0 AS (SELECT least((sum(t) * {MIX_SHARE[0]}) // {MIX_SHARE[1]}, sum(cap))::HUGEINT AS given FROM leaves)"""]
    cols = ("domain", "lang", "source")
    for d in (1, 2, 3):
        own, up = ", ".join(cols[:d]), ", ".join(cols[: d - 1])
        part = f"PARTITION BY {up}" if up else ""
        prior = f"JOIN b{d - 1} USING ({up})" if up else "CROSS JOIN b0"
        with_.append(f"""
n{d} AS (SELECT {own}, sum(cap)::HUGEINT AS cap, ({weight(d)})::HUGEINT AS w FROM leaves GROUP BY {own}),
s{d} AS (SELECT n{d}.*, given, row_number() OVER ({part} ORDER BY cap::DOUBLE / w, {cols[d - 1]}) AS o FROM n{d} {prior}),
u{d} AS (SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(CASE WHEN cap > 0 THEN w ELSE 0 END) OVER ({part} ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM s{d}),
f{d} AS (SELECT *, cap * open_w <= w * (given - used) AS is_full FROM u{d}),
r{d} AS (SELECT *, given - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part or ''}) AS rest,
  sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part or ''}) AS rest_w,
  sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER ({part} ORDER BY o) AS nth FROM f{d}),
e{d} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (rest * w) // rest_w END AS even FROM r{d}),
b{d} AS (SELECT {own}, (even + CASE WHEN NOT is_full AND nth <= rest - sum(CASE WHEN is_full THEN 0 ELSE even END) OVER ({part or ''}) THEN 1 ELSE 0 END)::HUGEINT AS given FROM e{d})""")
    with_.append(f"""
plan AS (SELECT leaves.*, given // t AS whole, given % t AS rest FROM leaves JOIN b3 USING (domain, lang, source) WHERE t > 0),
rows_ AS (SELECT docs.doc_id, domain, lang, source, docs.t, whole, rest,
  md5('{MIX_SEED}|' || whole::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '{mixing.NONE}') || '|' || m) AS draw FROM docs JOIN plan USING (domain, lang, source)),
cut AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY domain, lang, source ORDER BY draw, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM rows_)
SELECT doc_id, domain, lang, source, unnest(range(whole::BIGINT)) AS epoch, t::BIGINT AS n_tokens, t::BIGINT AS taken_tokens FROM rows_
UNION ALL SELECT doc_id, domain, lang, source, whole::BIGINT, t::BIGINT, least(t, rest - before)::BIGINT FROM cut WHERE before < rest""")
    return "WITH " + ",".join(with_)


# ---------------------------------------------------------------- op2: nearest neighbours
def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


# ---------------------------------------------------------------- op3: language-model scores
def op3_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"), crc_remainder("doc_id", 10) == 0)


# ---------------------------------------------------------------- op4: token files
END_ID = 2


def op4_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.digest(spark, token_files.write(docs, tokenizer, END_ID))


# ---------------------------------------------------------------- op5: line dedup
def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kept_crc32 is that of the text after the cut; runs are `head-tail<source`, lines from 0; source_ids lists the sources."""
    out = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.aggregate("line_runs", F.lit(0), lambda n, r: n + r["tail"] - r["head"] + 1)
    runs = F.transform("line_runs", lambda r: F.concat(r["head"], F.lit("-"), r["tail"], F.lit("<"), F.coalesce(r["source"].cast("string"), F.lit(""))))
    return out.select(
        "doc_id", "line_count", F.coalesce(cut, F.lit(0)).alias("removed_lines"), F.coalesce(F.size("line_runs"), F.lit(0)).alias("removed_runs"),
        F.array_join(runs, ",").alias("runs"), F.array_distinct(F.transform("line_runs", lambda r: r["source"])).alias("source_ids"), F.octet_length("text").alias("kept_bytes"), F.crc32(F.encode("text", "UTF-8")).alias("kept_crc32"),
    )


# ---------------------------------------------------------------- op6: benchmark decontamination
def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.split_items(table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    return decontamination.matches(table(spark, sf_dir, "documents"), benchmark_items(spark, sf_dir))


# ---------------------------------------------------------------- op7: sharding
SHARDS, SHARD_SEED = 16, 11


def op7_stratified_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law `rows`: counts differ by at most one, so no row belongs to a grown shard (null)."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32")
    )
    out = sharding.shard(docs, SHARDS, seed=SHARD_SEED, ties=("size", "text_crc32"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


# ---------------------------------------------------------------- op8: SimHash near-duplicates
def op8_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- op9: toxicity
def crc_remainder(column: str, of: int) -> F.Column:
    return F.crc32(F.encode(F.coalesce(F.col(column).cast("string"), F.lit("")), "UTF-8")) % of


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), learn=crc_remainder("doc_id", 5) != 0)


def op9_cnn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    out = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return out.select(
        "doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"), F.col("toxic_limit").alias("lang_limit"), F.col("toxic_reject").cast("int").alias("rejected"),
    )


# ---------------------------------------------------------------- op10: URL reputation
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: A host goes where it is 60 % likely (the bound of that confidence) that its bad rate is above this share of that of all labelled pages.
BOUND_Z, RATE_SHARE = 0.2533, 1.0


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is that of the document of the same number: bad if toxic or of low quality."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = F.when(F.coalesce("toxic", "quality").isNotNull(), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int"))
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    out = url_reputation.judge(pages, outcomes, URL_RULES, z=BOUND_Z, share=RATE_SHARE)
    return out.select("page_id", "host", "path", "rule", "verdict", (F.round("bad_low", 6) + 0.0).alias("bad_low"))


def _op10_sql() -> str:
    two = ", ".join(f"'{x}'" for x in url_reputation.TWO_LABELS)
    fits = []
    for what, text in sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits.append((f"(host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}')", text, what))
    case = lambda i: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[i]}'" for f in fits) + " END"
    low, high = url_reputation.PRIOR_STRENGTH
    strength = lambda t: f"""(SELECT CASE WHEN coalesce(sum(n * (n - 1) * m * (1 - m)), 0) = 0 THEN {high} ELSE
      1 / least(1 / (1 + {low}), greatest(1 / (1 + {high}), sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)))) - 1 END AS k FROM {t})"""  # noqa: E731
    label = lambda n, s: f"array_to_string(string_split({s}, '.')[-{n}:], '.')"
    return f"""
WITH p AS (SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{url_reputation.UPPER}', '{url_reputation.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE coalesce(toxic, quality) IS NOT NULL GROUP BY doc_id),
h0 AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad,
    regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS name FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h AS (SELECT *, CASE WHEN {label(2, 'name')} IN ({two}) THEN {label(2, 'name')} ELSE {label(1, 'name')} END AS suffix,
    CASE WHEN {label(2, 'name')} IN ({two}) THEN {label(3, 'name')} ELSE {label(2, 'name')} END AS domain FROM h0),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM h) AS m FROM h GROUP BY suffix),
sk AS {strength('s')}, su AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM s, sk),
d AS (SELECT suffix, domain, sum(h.n) AS n, sum(h.bad) AS bad, any_value(su.m) AS m FROM h JOIN su USING (suffix) GROUP BY suffix, domain),
dk AS {strength('d')}, du AS (SELECT suffix, domain, (bad + k * m) / (n + k) AS m FROM d, dk),
hm AS (SELECT host, n, bad, m FROM h JOIN du USING (suffix, domain)),
hk AS {strength('hm')}, rate AS (SELECT host, n, k, (bad + k * m) / (n + k) AS r FROM hm, hk),
low AS (SELECT host, r - {BOUND_Z} * sqrt(r * (1 - r) / (n + k + 1)) AS bad_low FROM rate)
SELECT page_id, host, path, {case(1)} AS rule, coalesce({case(2)}, CASE WHEN bad_low > {RATE_SHARE} * (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM h) THEN 'block' ELSE 'allow' END) AS verdict,
  0.0 + round(bad_low, 6) AS bad_low FROM p JOIN low USING (host)"""


# ---------------------------------------------------------------- op11: Merkle manifest
MERKLE_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no decimal form, so such a row is not tampered with."""
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in MERKLE_COLUMNS]
    columns[3] = F.col("n_chars").cast("decimal(20,0)") + 1
    tampered = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7 == 0, merkle.leaf(*columns))
    found = merkle.proofs(merkle.build(docs, MERKLE_COLUMNS, keep={"doc_id": F.col("doc_id"), "tampered": tampered}))
    claimed = merkle.folded(F.coalesce("tampered", "leaf"), F.col("merkle_path"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("merkle_path")).alias("proof_sha256"), claimed.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 by its polynomial: the table of all bytes (to be joined, one row), and the sum over the ASCII letters of a text.
CRC_TABLE_SQL = """crc_steps AS (SELECT i, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(v ORDER BY i) AS steps FROM crc_steps WHERE k = 8)"""


def crc_sql(text: str) -> str:
    letters = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {letters}), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295)"


def _op11_sql() -> str:
    field = lambda c: f"coalesce(strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR, '-')"
    row = lambda n: f"sha256({' || '.join(field(n if c == 'n_chars' else c) for c in MERKLE_COLUMNS)})"
    tree = lambda name, first: f"""
{name} AS ({first} UNION ALL
  SELECT grp, lvl + 1, idx // 2, (m + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE m > 1 GROUP BY grp, lvl, idx // 2, m)"""  # noqa: E731
    steps = lambda leaves, nodes, base: f"""SELECT p.id, {base} + l.lvl AS lvl, CASE WHEN s.h IS NULL THEN '-' WHEN (p.idx >> l.lvl) & 1 = 1 THEN 'L' ELSE 'R' END AS side, s.h
  FROM {leaves} p JOIN (SELECT DISTINCT grp, lvl FROM {nodes} WHERE m > 1) l ON l.grp IS NOT DISTINCT FROM p.grp
  LEFT JOIN {nodes} s ON s.grp IS NOT DISTINCT FROM p.grp AND s.lvl = l.lvl AND s.idx = xor(p.idx >> l.lvl, 1)"""  # noqa: E731
    return f"""
WITH RECURSIVE {CRC_TABLE_SQL},
d AS (SELECT row_number() OVER () AS id, doc_id, lang AS grp, {row('n_chars')} AS leaf,
  CASE WHEN {crc_sql('doc_id::VARCHAR')} % 7 = 0 THEN {row('n_chars::HUGEINT + 1')} END AS bad FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS m FROM d),
{tree('nodes', 'SELECT grp, 0 AS lvl, idx, m, leaf AS h FROM placed')},
subs AS (SELECT grp AS lang, h, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS idx, count(*) OVER () AS m FROM nodes WHERE m = 1),
{tree('tops', "SELECT 'all' AS grp, 0 AS lvl, idx, m, h FROM subs")},
under AS (SELECT p.id, 'all' AS grp, s.idx, s.h AS subroot FROM placed p JOIN subs s ON s.lang IS NOT DISTINCT FROM p.grp),
steps AS ({steps('placed', 'nodes', 0)} UNION ALL {steps('under', 'tops', 1000)}),
paths AS (SELECT id, string_agg(h, '' ORDER BY lvl) AS siblings, list(side || coalesce(h, '') ORDER BY lvl) AS path FROM steps GROUP BY id),
found AS (SELECT p.doc_id, p.leaf, u.subroot, (SELECT h FROM tops WHERE m = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
  list_reduce(list_prepend(coalesce(bad, leaf), coalesce(path, [])), lambda a, b: CASE b[1] WHEN 'L' THEN sha256(b[2:] || a) WHEN 'R' THEN sha256(a || b[2:]) ELSE sha256(a) END) AS folded_root
  FROM placed p JOIN under u USING (id) LEFT JOIN paths USING (id))
SELECT *, folded_root = root AS verified FROM found"""


# ---------------------------------------------------------------- op12: quality
GOOD_FROM = 0.3


def op12_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), learn=crc_remainder("doc_id", 5) != 0)
    out = quality.score(docs, model)
    return out.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= GOOD_FROM).cast("int").alias("predicted"))


# ---------------------------------------------------------------- op13: conversation prefix trie
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation c begins with the first turns of conversation c - c % 5 in place of its own."""
    own = written(prefix_trie.turns(table(spark, sf_dir, "conversations")), "turns")
    other = own.select(F.col("conv_id").alias("from_conv"), F.col("turns").alias("from_turns"))
    convs = own.withColumns({"from_conv": F.col("conv_id") - F.col("conv_id") % 5, "cut": crc_remainder("conv_id", 9).cast("int")}).join(other, "from_conv", "left")
    begin = F.coalesce(F.slice("from_turns", F.lit(1), F.col("cut")), F.slice("turns", F.lit(1), F.lit(0)))
    return prefix_trie.trie(convs.select("conv_id", F.concat(begin, F.slice("turns", F.col("cut") + 1, F.size("turns"))).alias("turns")))


def _op13_sql() -> str:
    return f"""
WITH RECURSIVE {CRC_TABLE_SQL},
t AS (SELECT conv_id, strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, bytes, digest, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t),
c AS (SELECT conv_id, {crc_sql('conv_id::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t), crc_table),
rebuilt AS (SELECT c.conv_id, own.pos, digest, bytes FROM c JOIN own ON own.conv_id = c.conv_id - c.conv_id % 5 AND own.pos <= h
  UNION ALL SELECT c.conv_id, own.pos, digest, bytes FROM c JOIN own ON own.conv_id = c.conv_id AND own.pos > h),
paths AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS k, bytes FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
nodes AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(bytes) AS bytes, left(k, len(k) - 64) AS above FROM paths GROUP BY k, depth),
kids AS (SELECT above AS k, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY above),
own_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (k)),
under AS (SELECT p.k, sum((o.n_children = 0)::INT) AS n_leaves, sum((o.n - 1) * o.bytes) AS saved FROM own_nodes o JOIN paths p ON p.conv_id = o.conv_id AND p.depth <= o.depth GROUP BY p.k),
ends AS (SELECT k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(k, depth) AS k FROM paths GROUP BY conv_id) GROUP BY k)
SELECT o.conv_id::BIGINT AS conv_id, o.depth::BIGINT AS depth, up.conv_id::BIGINT AS parent_conv_id, o.n::BIGINT AS n_convs, o.n_children::BIGINT AS n_children,
  n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM own_nodes o JOIN under USING (k) LEFT JOIN ends USING (k) LEFT JOIN nodes up ON up.k = o.above AND o.depth > 0"""


QUERIES: dict[str, Query] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_learned_partitions": op2_learned_partitions,
    "op3_maxent_scores": op3_maxent_scores,
    "op4_token_files": op4_token_files,
    "op5_line_winnowing": op5_line_winnowing,
    "op6_bm25_decontamination": op6_bm25_decontamination,
    "op7_stratified_sharding": op7_stratified_sharding,
    "op8_simhash_pigeonring": op8_simhash_pigeonring,
    "op9_cnn_toxicity": op9_cnn_toxicity,
    "op10_host_reputation": op10_host_reputation,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_byte_cnn_quality": op12_byte_cnn_quality,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op1_source_mixing": _op1_sql(), "op10_host_reputation": _op10_sql(), "op11_merkle_manifest": _op11_sql(), "op13_prefix_trie": _op13_sql()}
