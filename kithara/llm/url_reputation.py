"""URL filters: written rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host. The bad rate of a suffix is shrunk to the
rate of all pages, that of a registered domain to its suffix, that of a host to its domain, each by
a beta prior whose strength is fitted to the level by moments. A host is blocked where the lower
bound of its posterior bad rate lies above a limit: by default `share` of the rate of all labelled
pages, so a host goes once it is, with the confidence that `z` asks for, about as bad as the average
page or worse.

Defined results: a null url or one without `://` has an empty host and path, judged like a host of
that name; pages without outcomes count for nothing; hosts without outcomes take their domain's
rate; a bound that equals the limit does not block; of rules of one length the later by name wins;
a very long url is judged whole; repeated rows count as often as they come; an empty table gives an
empty result; input columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kithara.session import free_of, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels under which names are registered (fixed values).
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "com.br", "co.in", "com.cn", "co.kr", "co.nz", "co.za", "com.mx", "com.tr")
PRIOR_STRENGTH = (1.0, 1000.0)


def url_host(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def name_of(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return F.when(two.isin(*TWO_LABELS), F.substring_index(name, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; nulls where none fits."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(action)
    return rule, action


def _strength(level: DataFrame) -> float:
    """The beta prior's strength (pseudo-outcomes) from the spread of `bad` around n * m."""
    n, y, m = F.col("n"), F.col("bad"), F.col("m")
    row = level.agg(
        F.sum((y - n * m) * (y - n * m) - n * m * (1 - m)).alias("over"),
        F.sum(n * (n - 1) * m * (1 - m)).alias("room"),
    ).first()
    low, high = PRIOR_STRENGTH
    if not row["room"]:
        return high
    rho = min(1 / (1 + low), max(1 / (1 + high), row["over"] / row["room"]))
    return 1 / rho - 1


def _shrunk(strength: float) -> Column:
    return (F.col("bad") + strength * F.col("m")) / (F.col("n") + strength)


def host_reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """host, n, bad, bad_rate (posterior mean), bad_low (its lower bound), all_rate (of all pages), from host, n, bad."""
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    hosts = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    hosts = written(hosts, "hosts")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    all_rate = (total["bad"] + 1.0) / (total["n"] + 2.0)
    suffixes = suffixes.withColumn("m", F.lit(all_rate))
    up = suffixes.select("suffix", _shrunk(_strength(suffixes)).alias("m"))
    domains = domains.join(up, "suffix")
    up = domains.select("suffix", "domain", _shrunk(_strength(domains)).alias("m"))
    hosts = written(hosts.join(up, ["suffix", "domain"]), "hosts_and_priors")
    k = _strength(hosts)
    rate = _shrunk(k)
    hosts = hosts.withColumn("bad_rate", rate)
    spread = F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (F.col("n") + k + 1))
    return hosts.select("host", "n", "bad", "bad_rate", (F.col("bad_rate") - z * spread).alias("bad_low"), F.lit(all_rate).alias("all_rate"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]] = (), limit: float | None = None, z: float = 1.645, share: float = 1.0, key: str = "page_id", url: str = "url") -> DataFrame:
    """All pages with their columns and host, path, rule, verdict, bad_low.

    outcomes: `key` and bad (0 or 1), any number of rows a page; a null bad is no outcome.
    limit: the bad rate above which a host is blocked; None stands for `share` of the rate of all labelled pages.
    """
    pages = free_of(pages, ["host", "path", "rule", "verdict", "bad_low", "all_rate", "_action", "_id"])
    pages = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    known = outcomes.filter("bad is not null").groupBy(F.col(key).alias("_id")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counts = pages.select("host", F.col(key).alias("_id")).join(known, "_id", "left")
    counts = counts.select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    standing = written(host_reputation(counts, z).select("host", "bad_low", "all_rate"), "standing")
    rule, action = matched_rule(F.col("host"), F.col("path"), rules)
    judged = pages.join(standing, "host", "left").withColumns({"rule": rule, "_action": action})
    most = F.col("all_rate") * share if limit is None else F.lit(limit)
    own = F.when(F.col("bad_low") > most, F.lit("block")).otherwise(F.lit("allow"))
    kept = [c for c in pages.columns]
    return judged.withColumn("verdict", F.coalesce("_action", own)).select(*kept, "rule", "verdict", "bad_low")
