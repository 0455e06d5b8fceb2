"""Operators on vectors and URLs, and the components they share."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelake.llm import neighbours, topk, urls
from sitelake.llm.components import components
from tests.llm import helpers

VECTORS = "vec_id long, embedding array<float>, score string, v int, q string, rank string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "s", 1, "q", "r") for i, v in vectors], VECTORS)


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    return [(0, None), (1, [1.0, nan]), (2, [1.0, None]), (3, [inf, 0.0]), (4, [0.0, 0.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0])] + [
        (6, [1.0]), (7, [1.0, 2.0]), (8, []), (None, [1.0, 1.0]), (9, [-3.0, 0.5])
    ]


# --- 4 ----------------------------------------------------------------------


def test_neighbour_recall(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(3000, 24)).astype(np.float32)
    x[500:700] = x[0]  # a large group of equal vectors
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hit, exact = 0, x.astype(float) @ x.astype(float).T
    for q, rows in got.items():
        assert [r for r, *_ in sorted(rows)] == list(range(1, 21))
        assert all(abs(exact[q, i] - s) < 1e-9 for _, i, s in rows)
        least = np.sort(np.delete(exact[q], q))[-20]
        hit += sum(s >= least - 1e-9 for *_, s in rows)
    assert hit / (20 * len(got)) >= 0.9


def test_neighbour_recall_over_many_runs(spark, monkeypatch):
    # 125 runs in each of two orders: the graph and the search find the rest.
    monkeypatch.setattr(neighbours.first_graph, "__defaults__", (2, 64))
    x = np.random.default_rng(6).normal(size=(8000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    rows = neighbours.nearest(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)]), F.col("vec_id") % 20 == 0, 20).collect()
    exact = x[::20] @ x.T
    exact[np.arange(400), np.arange(0, 8000, 20)] = -2
    best = np.argsort(-exact, axis=1)[:, :20]
    assert len(rows) == 20 * 400
    assert sum(r.vec_id in best[r.query_id // 20] for r in rows) / len(rows) >= 0.95


def test_neighbours_of_odd_vectors(spark):
    rows = neighbours.nearest(frame(spark, odd_vectors()), F.col("vec_id") >= 0, 20).collect()
    there = {5: (1, 2), 6: (1, 0), 7: (1, 2), 9: (-3, 0.5)}
    for q in there:
        want = helpers.best({i: np.array(v, float) for i, v in there.items()}, q, 20)
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [(i, s) for _, i, s in own] == want
    assert {r.query_id for r in rows} == set(there)
    assert neighbours.nearest(frame(spark, []), F.col("vec_id") >= 0, 5).collect() == []
    assert neighbours.nearest(frame(spark, [(1, [1.0])]), F.col("vec_id") >= 0, 5).collect() == []


# --- 6 ----------------------------------------------------------------------


@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_top_k_is_exact(spark, spread):
    draw = np.random.default_rng(8)
    centers = draw.normal(size=(12, 8))
    x = np.floor(256 * (centers[draw.integers(0, 12, 5000)] + spread * draw.normal(size=(5000, 8))))
    x[100:2500] = x[0]  # one pivot holds many equal vectors
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 250 == 0, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    vectors = dict(enumerate(x))
    assert set(got) == set(range(0, 5000, 250))
    for q, rows in got.items():
        assert [(i, s) for _, i, s in sorted(rows)] == helpers.best(vectors, q, 5)


def test_top_k_of_odd_vectors(spark):
    rows = topk.top_k(frame(spark, odd_vectors()), F.col("vec_id") >= 0, 4).collect()
    there = {4: (0, 0), 5: (1, 2), 6: (1, 0), 7: (1, 2), 8: (0, 0), 9: (-3, 0.5)}
    for q in there:
        own = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [(i, s) for _, i, s in own] == helpers.best({i: np.array(v, float) for i, v in there.items()}, q, 4)
    assert {r.query_id for r in rows} == set(there)
    assert topk.top_k(frame(spark, []), F.col("vec_id") >= 0, 4).collect() == []


# --- 7 and components -------------------------------------------------------


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 400)] + [(7, 7), (None, 3), (500, 400), (500, 400)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == helpers.groups([(a, b) for a, b in pairs if a is not None and a != b])
    assert components(spark.createDataFrame([], "a string, b string")).collect() == []


def link(rel, href):
    return f'<html><LINK href="{href}" rel="x {rel}"></html>'


PAGES = [
    (1, "http://Shop.Example.com/en/a", None),  # blocked by rule
    (2, "https://a.org/x#top", link("canonical", "http://shop.example.com/en/a")),
    (3, "http://b.org/y", "<meta http-equiv='Refresh' content='0; URL=https://a.org/x'>"),
    (4, "http://www.example.com/en/q", link("canonical", "/EN")),  # allowed by rule
    (5, "http://c.org/", link("canonical", "")),
    (6, "http://d.org/p", link("stylesheet", "http://shop.example.com/en/a")),
    (7, None, "<p>"),
    (8, "no scheme", "<p>"),
    (9, "http://x.net?es", ""),
    (10, "http://x.net/es/1", ""),
    (11, "ftp://e.org/z", link("canonical", "http://mid.org/m")),
    (12, "ftp://www.example.com/en/mid", link("canonical", "http://mid.org/m")),
    (13, "http://f.org/z", link("canonical", "http://mid2.org/m")),
    (2, "https://a.org/x#top", link("canonical", "http://shop.example.com/en/a")),
]


def test_verdicts(spark):
    df = spark.createDataFrame([(*p, "h", "p", "v", "r") for p in PAGES], "page_id long, url string, html string, host string, path string, verdict string, rule string")
    redirects = spark.createDataFrame([("http://mid2.org/m", "http://y.net/fr/1"), (None, "http://q.org/"), ("x", "y")], "src string, dst string")
    rows = urls.judge(df, redirects=redirects).collect()
    assert len(rows) == len(PAGES)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert got[1] == ("shop.example.com", "/en/a", "example.com/en/", "block")
    assert got[2] == ("a.org", "/x", None, "block") and got[3] == ("b.org", "/y", None, "block")
    assert got[4] == ("www.example.com", "/en/q", "www.example.com/en/", "allow")
    assert got[5][3] == got[6][3] == "allow"
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9] == ("x.net", "", None, "allow") and got[10][2:] == ("net/es/", "block")
    assert got[11][3] == "allow" and got[12][3] == "allow"
    assert got[13][3] == "block"
    assert urls.judge(df.limit(0)).collect() == []


def test_an_allow_rule_precedes_a_blocked_alias(spark):
    pages = [(1, "http://www.example.com/en/a", link("canonical", "http://bad.net/es/x")), (2, "http://free.org/", link("canonical", "http://bad.net/es/x"))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(df).collect()} == {1: "allow", 2: "block"}


LINKING = [  # (url, html, where its links go)
    ("http://a.org/en/deep/p.html", '<link rel=canonical href="../../x/./y">', ["http://a.org/x/y"]),
    ("http://a.org/en/p", '<link rel="canonical" href="./q">', ["http://a.org/en/q"]),
    ("http://a.org/en/p", '<link rel="canonical" href="../../../up">', ["http://a.org/up"]),
    ("http://a.org/p", '<link rel="canonical" href="/q?a=1&amp;b=2#top">', ["http://a.org/q?a=1&b=2#top"]),
    ("http://a.org/p", '<link rel="&#99;anonical" href="?n=2">', ["http://a.org/p?n=2"]),
    ("http://a.org/p", '<!-- <link rel="canonical" href="/no"> --><p>', []),
    ("http://a.org/p", """<script>var t = '<link rel="canonical" href="/no">';</script><link rel=canonical href=/yes>""", ["http://a.org/yes"]),
    ("http://a.org/p", "<script><link rel=canonical href=/no>", []),
    ("http://a.org/p", '<p title=\'<link rel="canonical" href="/no">\'>', []),
    ("http://a.org/p", "<base href='/b/c'><LINK HREF=d REL='alternate Canonical'>", ["http://a.org/b/d"]),
    ("http://a.org/p", "<meta http-equiv=refresh content='3'><meta name=refresh content='0;url=/no'>", []),
    ("http://a.org/p", """<meta http-equiv=Refresh content="0; url='/q r'">""", ["http://a.org/q r"]),
    ("ftp://a.org/p", "<meta http-equiv=refresh content='1,/q'>", ["http://a.org/q"]),
    ("http://a.org/p", "<link rel=canonical href='#x'><link rel=canonical href=' '><link rel=canonical>", []),
    ("http://a.org/p", "<link rel=canonical href='https://b.org/x/../y'><link rel=canonical href='mailto:a@b'>", ["http://b.org/y", "mailto:a@b"]),
    ("http://a.org/p", "<link rel=canonical href='http://[bad'><link rel=canonical href='//b.org'>", ["http://b.org"]),
]


@pytest.mark.parametrize("url, html, found", LINKING)
def test_links_a_page_declares(url, html, found):
    assert urls.page_links(url, html) == found


def test_blocks_travel_along_declared_links(spark):
    """Against a plain walk over the links, with a chain of aliases, relative links and null rows."""
    pages = [
        ("http://one.org/a/b/c", link("canonical", "../../two")),
        ("http://one.org/two", "<meta http-equiv=refresh content='0;url=http://three.org/x?a=1&amp;b=2'>"),
        ("http://three.org/x?a=1&b=2", link("canonical", "http://host.net/fr/./end")),
        ("http://four.org/", "<!--" + link("canonical", "http://host.net/fr/end") + "-->"),
        ("http://www.example.com/en/ok", link("canonical", "http://one.org/two")),
        ("http://five.org/r/s", link("canonical", "../t")),
        ("http://five.org/t", None),
        *[(None, link("canonical", "http://host.net/fr/end"))] * 3,
        *[("http://three.org/x?a=1&b=2", "<p>")] * 2,
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")

    def bare(url):
        return url.partition("://")[2].partition("#")[0]

    edges = [(bare(u), bare(t)) for u, h in pages if u and h for t in urls.page_links(u, h)]
    blocked = {"host.net/fr/end"}
    for _ in edges:
        blocked |= {x for a, b in edges for x in (a, b) if {a, b} & blocked}
    want = {}
    for i, (u, _) in enumerate(pages):
        allowed = not u or u.startswith("http://www.example.com/en/") or bare(u) not in blocked
        want[i] = "allow" if allowed else "block"
    got = {r.page_id: r.verdict for r in urls.judge(df).collect()}
    assert got == want and [i for i, v in got.items() if v == "block"] == [0, 1, 2, 10, 11]
