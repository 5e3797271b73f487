import math

import pytest

from kithara.llm import url_reputation as ur
from kithara.llm.queries import URL_RULES, op10_host_reputation

URLS = [
    None, "", "no scheme.com/en/", "http://A.Example.COM/en/x?q#f", "https://www.example.com/en/a", "https://x.www.example.com/en/", "http://example.com", "http://example.com?x=/en/",
    "ftp://net/es/1", "http://a.net/es/1", "http://internet/es/1", "http://a.net/fr", "http://b.co.uk:80/p", "http://user@c.co.uk/p", "a://b://c/d", "http:///path", "http://é.com/é/\n?x", "http://m.example.org/en/1",
]


def parsed(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    path = rest[end:]
    stop = min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    return host, path[:stop]


def ruled(host, path):
    best = None
    for what, text in URL_RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[1])):
            best = (what, text)
    return best


def brute_low(hosts, z):
    """hosts: host to (n, bad)."""

    def names(h):
        h = h.rpartition("@")[2]
        head, colon, tail = h.rpartition(":")
        h = head if colon and (tail == "" or tail.isascii() and tail.isdigit()) else h
        parts = h.split(".")
        two = ".".join(parts[-2:])
        return (two, ".".join(parts[-3:])) if two in ur.TWO_LABELS else (parts[-1], two)

    def strength(level):
        room = sum(n * (n - 1) * m * (1 - m) for n, y, m in level)
        if not room:
            return ur.PRIOR_STRENGTH[1]
        over = sum((y - n * m) ** 2 - n * m * (1 - m) for n, y, m in level)
        return 1 / min(1 / (1 + ur.PRIOR_STRENGTH[0]), max(1 / (1 + ur.PRIOR_STRENGTH[1]), over / room)) - 1

    def add(key):
        out = {}
        for h, (n, y) in hosts.items():
            a, b = out.get(key(h), (0, 0))
            out[key(h)] = (a + n, b + y)
        return out

    suffix, domain = add(lambda h: names(h)[0]), add(names)
    m0 = (sum(y for _, y in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    ks = strength([(n, y, m0) for n, y in suffix.values()])
    ms = {s: (y + ks * m0) / (n + ks) for s, (n, y) in suffix.items()}
    kd = strength([(n, y, ms[d[0]]) for d, (n, y) in domain.items()])
    md = {d: (y + kd * ms[d[0]]) / (n + kd) for d, (n, y) in domain.items()}
    kh = strength([(n, y, md[names(h)]) for h, (n, y) in hosts.items()])
    out = {}
    for h, (n, y) in hosts.items():
        r = (y + kh * md[names(h)]) / (n + kh)
        out[h] = r - z * math.sqrt(r * (1 - r) / (n + kh + 1))
    return out


def test_against_brute_force(spark):
    rows = [(i, URLS[i % len(URLS)], "clash") for i in range(400)] + [(1000 + i, f"http://bad{i % 3}.spam.org/{i}", "c") for i in range(90)] + [(None, "http://z.org/", "c"), (3, URLS[3], "c")]
    outcomes = [(i, int(i % 5 == 0)) for i in range(400) if i % 3] + [(1000 + i, 1) for i in range(60)] + [(3, 1), (None, 1), (4, None), (99999, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(4)
    table = spark.createDataFrame(outcomes, "page_id long, bad int")
    got = ur.judge(pages, table, URL_RULES).collect()
    known = {}
    for k, b in outcomes:
        if b is not None:
            n, y = known.get(k, (0, 0))
            known[k] = (n + 1, y + b)
    hosts = {}
    for k, u, _ in rows:
        n, y = known.get(k, (0, 0)) if k is not None else (0, 0)
        a, b = hosts.get(parsed(u)[0], (0, 0))
        hosts[parsed(u)[0]] = (a + n, b + y)
    low = brute_low(hosts, 1.645)
    assert len(got) == len(rows)
    rate = (sum(y for _, y in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    assert all(r.verdict == ("block" if low[r.host] > 0.1 else "allow") for r in ur.judge(pages, table, limit=0.1).collect())
    verdicts = set()
    for r in got:
        host, path = parsed(r.url)
        rule = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[1]), r
        assert abs(r.bad_low - low[host]) < 1e-9
        assert r.verdict == (rule[0] if rule else "block" if low[host] > rate else "allow")
        verdicts.add((rule is None, r.verdict))
    assert verdicts == {(True, "allow"), (True, "block"), (False, "allow"), (False, "block")}


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    assert ur.judge(pages, none, URL_RULES).first().verdict == "allow"
    assert ur.judge(pages.limit(0), none, URL_RULES).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_the_method_decides_pages_without_a_rule(spark, sf):
    got = op10_host_reputation(spark, f"/root/testdata/{sf}").filter("rule is null").groupBy("verdict").count().collect()
    assert {r.verdict for r in got} == {"allow", "block"}


def test_very_long_url(spark):
    url = "HTTP://" + "a." * 5000 + "net/es/" + "p" * 100_000
    pages = spark.createDataFrame([(1, url), (1, url)], "page_id long, url string")
    got = ur.judge(pages, spark.createDataFrame([], "page_id long, bad int"), URL_RULES).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("a." * 5000 + "net", "/es/" + "p" * 100_000, "net/es/", "block")] * 2
