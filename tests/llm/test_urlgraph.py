import random

import duckdb
import pytest

from docquarry.llm import urlgraph as u
from tests.oracle import differences


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://A.Example.COM/en/7?x#y", "a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("https://x.com/en/1", "x.com", "/en/1", "com/en/", "block"),
        ("https://com/en/", "com", "/en/", "com/en/", "block"),
        ("https://notcom/en/", "notcom", "/en/", None, "allow"),
        ("ftp://www.example.net/de/81", "www.example.net", "/de/81", "example.net/de/8", "block"),
        ("ftp://www.example.net/de/7", "www.example.net", "/de/7", "net/de/", "allow"),
        ("http://example.org?/es/", "example.org", "", None, "allow"),
        ("http://h://x/es/", "h:", "//x/es/", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://ÄB/p\nq#z", "Äb", "/p\nq", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], None, "x") for i, c in enumerate(cases)], "page_id long, url string, html string, host string")
    got = sorted(u.judged(df).collect())
    assert [(r.host, r.path, r.rule) for r in got] == [c[1:4] for c in cases]
    assert [r.verdict for r in got if r.rule] == [c[4] for c in cases if c[3]]


def test_links_name_other_hosts(spark):
    html = '<a href="http://B.com/x">1</a><a class=z href=//c.org/y>2</a><A HREF=\'https://b.com\'>3</A><a href="/own">4</a><a href="http://a.com/">5</a><link href="http://z.com">'
    got = u.host_links(spark.createDataFrame([("http://a.com/p", html), (None, html), ("http://a.com/q", None)], "url string, html string")).collect()
    assert sorted((r.src, r.dst, r.n) for r in got) == [("a.com", "b.com", 2), ("a.com", "c.org", 1)]


def test_ranks_equal_brute_force(spark):
    rng = random.Random(3)
    hosts = [f"h{i}" for i in range(10)]
    edges = {(a, b): rng.randint(1, 4) for a in hosts for b in hosts if a != b and rng.random() < 0.25 and a != "h9"}
    seeds = {"h0": (3, 0), "h1": (1, 0), "h2": (0, 2), "h5": (0, 1)}

    def rank(links, p):
        out = {h: sum(n for (a, _), n in links.items() if a == h) for h in hosts}
        r = dict(p)
        for _ in range(200):
            new = dict.fromkeys(hosts, 0.0)
            for (a, b), n in links.items():
                new[b] += r.get(a, 0) * n / out[a]
            mass = sum(new.values())
            r = {h: (1 - u.DAMPING * mass) * p.get(h, 0) + u.DAMPING * new[h] for h in hosts}
        return r

    trust = rank(edges, {"h0": 0.75, "h1": 0.25})
    distrust = rank({(b, a): n for (a, b), n in edges.items()}, {"h2": 2 / 3, "h5": 1 / 3})
    got = u.ranks(spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n long"), spark.createDataFrame([(h, g, b) for h, (g, b) in seeds.items()], "host string, good long, bad long")).collect()
    for r in got:
        assert r.trust == pytest.approx(trust[r.host], abs=1e-5) and r.distrust == pytest.approx(distrust[r.host], abs=1e-5)


def test_distrust_reaches_who_links_to_blocked_hosts(spark):
    pages = [(1, "http://bad.com/en/1", ""), (2, "http://friend.info/a", '<a href="http://bad.com/en/1">'), (3, "http://good.net/de/1", '<a href="http://liked.info/">'), (4, "http://liked.info/b", ""), (5, "http://other.info/", "")]
    got = {r.page_id: r.verdict for r in u.judged(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    strict = spark.createDataFrame([("friend.info", 1.0)], "host string, threshold double")
    assert {r.page_id: r.verdict for r in u.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), thresholds=strict).collect()}[2] == "allow"


def test_a_graph_of_links_equals_sql(spark):
    rng = random.Random(9)
    hosts = ["a.com", "b.com", "c.net", "d.net", "e.org", "f.info", "g.info", "h.example.com", "i.de"]
    pages = []
    for i in range(120):
        links = "".join(f'<a class="x" href="{rng.choice(["http:", "https:", ""])}//{rng.choice(hosts)}/p">' for _ in range(rng.randint(0, 3)))
        pages.append((i if i % 7 else None, f"http://{rng.choice(hosts).title()}/{rng.choice(['en', 'de', 'es', 'xx'])}/{rng.randint(1, 9)}?q#f", links or None))
    pages += [(500, None, '<a href="http://a.com">'), (501, "no scheme", ""), (502, "http://lonely.xyz/", "x" * 3_000_000 + '<a href="//e.org">')]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", df.toPandas().astype({"page_id": "Int64"}))
    assert not differences(u.judged(df), con, u.judged_sql())
    assert len({r.distrust_share for r in u.judged(df).collect()}) > 6


def test_a_ring_settles(spark):
    n = 60
    links = spark.createDataFrame([(f"h{i}", f"h{(i + 1) % n}", 1) for i in range(n)], "src string, dst string, n long")
    got = {r.host: r.trust for r in u.ranks(links, spark.createDataFrame([("h0", 1, 0)], "host string, good long, bad long")).collect()}
    want = {f"h{i}": (1 - u.DAMPING) * u.DAMPING**i / (1 - u.DAMPING**n) for i in range(n)}
    assert sum(abs(got.get(h, 0) - w) for h, w in want.items()) < 1e-5


def test_no_pages(spark):
    assert u.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_ranks_that_do_not_settle_are_an_error(spark, monkeypatch):
    assert 4 * u.DAMPING**u.ROUNDS < u.SETTLED
    monkeypatch.setattr(u, "ROUNDS", 2)
    links = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "src string, dst string, n long")
    with pytest.raises(RuntimeError):
        u.ranks(links, spark.createDataFrame([("a", 1, 0)], "host string, good long, bad long"))
