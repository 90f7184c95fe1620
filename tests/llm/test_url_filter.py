"""URL filter: rules against a loop, models on made-up hosts, odd URLs."""

import random

import numpy as np

from ledgerwatch.llm import url_filter
from ledgerwatch.llm.queries import RULES

SCHEMA = "page_id long, url string, html string, host int, rule string, score string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", 1, "r", "s") for r in rows], SCHEMA)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    cut = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return host, tail[:cut]


def rule(host, path):
    best = None
    for verdict, own in RULES.items():
        for r in own:
            h, _, p = r.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r) > len(best[0])):
                best = (r, verdict)
    return best or (None, None)


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x", "http://example.net/EN/", "http://net/", "http://xnet/", "http://a.net",
    "http://a.net?x=/", "http://a.org/fr/1#f", "http://org/fr/", "https://example.com/de/2?u=://z.net/", "ftp://b.example.com/de", "x://É.org/fr/",
    "http://a.net:80/", "http://u@a.net/x", "://n.net/", "a/b://c.net/d", "http://example.net/en/" + "y" * 70_000,
]


def test_parts_and_rules(spark):
    got = {r.page_id: r for r in url_filter.judge(pages(spark, list(enumerate(URLS))), RULES).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parts(url)
        name, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name)
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
        assert 0 <= got[i].score <= 1


def test_models_carry_rules_over(spark):
    """Names like the blocked ones' are blocked on hosts no rule knows, and the other way round."""
    rng = random.Random(3)
    good, bad = ["garden", "recipes", "museum", "library"], ["casino", "pills", "poker", "jackpot"]
    rows = [
        (i, f"http://{rng.choice(bad if i % 2 else good)}{rng.randrange(999)}.{'net' if i % 2 else 'org/fr'}/{rng.randrange(99)}") for i in range(600)
    ]
    asks = [(1000, "http://library7.museum.info/1"), (1001, "http://casino-poker8.info/2")]
    got = {r.page_id: r.verdict for r in url_filter.judge(pages(spark, rows + asks), RULES).collect()}
    assert got[1000] == "allow" and got[1001] == "block"


def test_long_urls_are_scored_whole():
    rng = np.random.default_rng(1)
    sums = [rng.integers(0, 5, (2, url_filter.ORDERS, 1 << url_filter.BITS)).astype(np.float32) for _ in range(2)]
    model = url_filter.UrlModel(sums[0], sums[0].sum() * 0 + sums[0] + sums[1], 1.0, 0.0)
    url = "ab/c" * 40_000
    long = model.raw(url)
    slow = 0.0
    data = b"\0" * url_filter.ORDERS + url.encode() + b"\1"
    rate = np.full((2, len(data) - url_filter.ORDERS), 1 / 256)
    for order, (gram, context) in enumerate(url_filter._cells(data, url_filter.ORDERS)):
        rate = (model.grams[:, order][:, gram] + url_filter.WEIGHT * rate) / (model.contexts[:, order][:, context] + url_filter.WEIGHT)
    slow = float(np.log(rate[1] / rate[0]).sum()) / rate.shape[1]
    assert abs(long - slow) < 1e-6


def test_all_ruled_urls_are_counted(spark):
    """However many there are: what one fifth calibrates on, the counts have of all others."""
    rows = spark.range(42_000).selectExpr("concat('a.org/fr/', id) as url", "0 as rejected")
    rows = rows.unionByName(spark.createDataFrame([("b.net/", 1)], "url string, rejected int"))
    counted = rows.where("pmod(xxhash64(7, url), 5) <> 0 and rejected = 0").count()
    model = url_filter.fit(rows)
    first, _ = url_filter._cells(b"\0" * url_filter.ORDERS + b"a", url_filter.ORDERS)[0]
    assert counted > 30_000 and model.grams[0, 0, first[0]] >= counted


def test_one_class_nulls_repeats_and_none(spark):
    rows = [(None, "http://a.org/fr/1"), (1, "http://b.org/fr/"), (1, "http://b.org/fr/"), (2, None), (3, "http://c.info/")]
    got = sorted((r.page_id or 0, r.verdict) for r in url_filter.judge(pages(spark, rows), RULES).collect())
    assert got == [(0, "allow"), (1, "allow"), (1, "allow"), (2, "allow"), (3, "allow")]
    assert url_filter.judge(pages(spark, []), RULES).count() == 0
