"""Link audits of small sites: what is read, reached, missing."""

import pytest
from sitelake.operators import audit, crawl, ordering
from sitelake.sources.folders import read_named, to_docs

SCHEMA = "site string, rel string, text string, readable boolean, truncated boolean"


class Site:
    """Files of one site, how they are read, and what the audit says."""

    def __init__(self, files, entry="index.html", truncated=(), unreadable=()):
        self.files, self.entry, self.truncated, self.unreadable = files, entry, truncated, unreadable


SITES = {
    # Pages of a tree that link up, down and across, with gaps.
    "bakery": Site(
        {
            "index.html": """<h1 id=welcome>Bakery</h1><a href="#welcome">top</a><a href="#opening-hours">hours</a>
            <a href="breads/">breads</a><a href="order.html">order</a><img src=oven.jpg><img src="OVEN.jpg">""",
            "breads/index.html": '<a href="rye.html">rye</a><a href="../">home</a><a href="/index.html?from=breads#welcome">up</a>',
            "breads/rye.html": '<img src="../oven.jpg"><a href="index.html">all breads</a>',
        }
    ),
    # Links to elsewhere, and things that look like links.
    "harbour": Site(
        {
            "index.html": """<a href="https://tides.example/today"><a href="//maps.example/pier"><a href="https:ferries">
            <a href="http:berth.html"><a href="mailto:master@harbour.example"><a href="tel:112"><a href="about:blank">
            <img src="data:image/gif,R0lG"><script src=crane.js>var fake = '<a href="sunk.html">';</script>""",
            "berth.html": "",
            "crane.js": "",
        }
    ),
    "vault": Site({"index.html": '<a href="../../private/keys.txt">keys</a>'}),
    # Bases inside, outside and above the site.
    "atlas": Site(
        {
            "index.html": '<base href="maps/"><a href=north.html><a href="../deep/leak.html">',
            "maps/north.html": '<base href="https://atlas.example/en/"><a href=legend.html><a href=/about.html><img src=rose.png>',
            "deep/leak.html": '<base href="../../gone/"><img src=pic.png>',
        }
    ),
    "press": Site(
        {
            "index.html": """<link rel=stylesheet href=print.css><td style="background:url('paper.png')">
            <img srcset="data:image/gif;base64,R0,lGOD 1x, cover.png 2x, cover-big.png 3x">""",
            "print.css": "/* url(old.png) */ @import 'type/fonts.css'; h1{src:url(https://type.example/serif.woff2)}",
            "type/fonts.css": "b{src:url(..\\press\\ink.png)} i{src:url(../cover.png)}",
            "cover.png": "",
            "press/ink.png": "",
        }
    ),
    "museum": Site(
        {
            "index.html": '<img src="Halls/Vase.JPG"><a href="o\u0308sterreich.html"><img src="halls\\urn.png">',
            "halls/vase.jpg": "",
            "halls/urn.png": "",
            "\u00f6sterreich.html": "",
        }
    ),
    "ferry": Site(
        {
            "index.html": '<a href="lines">lines</a><a href="stops/">stops</a><a href="piers/">piers</a>',
            "lines/index.html": '<a href="night.html">night line</a>',
            "lines/night.html": "",
            "stops/plan.png": "",
        }
    ),
    "ledger": Site(
        {"index.html": '<a href="#total"><link href=rows.css>', "rows.css": "td{}"}, truncated=["index.html", "rows.css"]
    ),
    "attic": Site(
        {
            "index.html": "<a href=box.html><a href=BOX.html#lid><a href=shelf.html>",
            "box.html": "",
            "shelf.html": "<a href=./box.html>",
        },
        unreadable=["box.html"],
    ),
    "sealed": Site({"index.html": "<a href=inside.html>", "inside.html": ""}, unreadable=["index.html"]),
    "wall": Site({"index.html": "<img src=brick.gif>" * 45}),
    "kiosk": Site({"welcome": "<video poster=still.jpg></video>"}, entry="welcome"),
}


class Audited:
    """All sites checked in one crawl, as plain values."""

    def __init__(self, spark, lazy):
        rows = [
            (name, rel, text, rel not in site.unreadable, rel in site.truncated)
            for name, site in SITES.items()
            for rel, text in site.files.items()
        ]
        docs = spark.createDataFrame(rows, SCHEMA)
        entries = spark.createDataFrame([(n, s.entry) for n, s in SITES.items()], "site string, entry string")
        files = docs.select("site", "rel")
        run = crawl.crawl_lazily(crawl.among(docs), files, entries) if lazy else crawl.crawl(docs, files, entries)
        self.reports = {r["site"]: r.asDict() for r in run.report().collect()}
        self.groups = audit.broken_report(run.broken()).orderBy("rank").collect()
        self.listed = {kind: run.pages(kind).orderBy("pos").collect() for kind in ("html", "css")}
        self.levels = {(r["site"], r["url"]): r["lvl"] for r in run.visits.collect()}


class Result:
    """What the crawl says of one site."""

    def __init__(self, audited, name):
        self.report = audited.reports[name]
        groups = [g for g in audited.groups if g["site"] == name]
        self.broken = [(g["path"], g["reason"], g["source_count"]) for g in groups]
        self.sources = {g["path"]: [(s["page"], s["href"]) for s in g["sources"]] for g in groups}
        self.pages = [r["file"] for r in audited.listed["html"] if r["site"] == name]
        self.sheets = [r["file"] for r in audited.listed["css"] if r["site"] == name]
        self.levels = {url: lvl for (site, url), lvl in audited.levels.items() if site == name}


@pytest.fixture(scope="module", params=[False, True], ids=["whole", "lazy"])
def site(spark, request):
    audited = Audited(spark, request.param)
    return lambda name: Result(audited, name)


def test_gaps_in_a_tree_of_pages(site):
    found = site("bakery")
    assert found.pages == ["index.html", "breads/index.html", "breads/rye.html"]
    assert found.levels == {"index.html": 0, "breads/index.html": 1, "breads/rye.html": 2}
    # In the order they were met, spellings together, absent anchors last.
    assert found.broken == [("order.html", "missing", 1), ("oven.jpg", "missing", 3), ("index.html#opening-hours", "anchor", 1)]
    assert found.sources["oven.jpg"] == [("index.html", "oven.jpg"), ("index.html", "OVEN.jpg"), ("breads/rye.html", "../oven.jpg")]
    assert (found.report["verdict"], found.report["broken_links"]) == ("broken", 5)


def test_links_to_elsewhere(site):
    found = site("harbour")
    assert (found.broken, found.pages) == ([], ["index.html", "berth.html"])
    assert (found.report["external"], found.report["reached"], found.report["verdict"]) == (3, 3, "clean")


def test_links_above_the_site(site):
    assert site("vault").broken == [("../../private/keys.txt", "escape", 1)]


def test_bases(site):
    found = site("atlas")
    assert (found.report["external"], found.report["reached"]) == (3, 3)
    assert found.broken == [("../gone/", "escape", 1), ("../gone/pic.png", "escape", 1)]


def test_styles_sources_and_imports(site):
    found = site("press")
    assert {b[:2] for b in found.broken} == {("cover-big.png", "missing"), ("paper.png", "missing")}
    assert found.sheets == ["print.css", "type/fonts.css"]
    assert (found.report["external"], found.report["reached"]) == (1, 5)


def test_names_in_other_forms(site):
    found = site("museum")
    assert found.broken == []
    assert found.report["reached"] == found.report["files"] == 4


def test_folders_with_and_without_a_slash(site):
    found = site("ferry")
    assert found.broken == [("stops/index.html", "missing", 1), ("piers", "missing", 1), ("night.html", "missing", 1)]
    assert found.sources["night.html"] == [("lines", "night.html")]
    assert "lines/night.html" not in found.pages


def test_cut_documents_leave_the_verdict_open(site):
    found = site("ledger")
    assert found.broken == []
    assert [found.report[k] for k in ("truncated", "stylesheets", "verdict")] == [2, 1, "incomplete"]


def test_documents_that_cannot_be_read(site):
    assert site("attic").broken == [("box.html", "unreadable", 3)]
    lost = site("sealed")
    assert lost.broken == [("index.html", "unreadable", 1)]
    assert lost.sources["index.html"] == [("entr\u00e9e", "index.html")]


def test_sources_are_shown_up_to_the_limit_and_all_counted(site):
    found = site("wall")
    assert found.broken == [("brick.gif", "missing", 45)]
    assert len(found.sources["brick.gif"]) == 20


def test_an_entry_of_unknown_kind_is_read_as_html(site):
    found = site("kiosk")
    assert (found.broken, found.report["pages"]) == ([("still.jpg", "missing", 1)], 1)


def test_seeds_in_natural_order(spark):
    files = [("s", "12-end.html", "<a href=x.png>"), ("s", "3-middle.html", "<a href=more/notes.html>"), ("s", "more/notes.html", "")]
    docs = spark.createDataFrame([(*f, True, False) for f in files], SCHEMA)
    seeds = ordering.seed_pages(docs, ["index.html"]).withColumnRenamed("rel", "entry")
    run = crawl.crawl(docs, docs.select("site", "rel"), seeds)
    assert [r["file"] for r in run.pages().orderBy("pos").collect()] == ["3-middle.html", "12-end.html", "more/notes.html"]


@pytest.mark.parametrize("edges, want", [([(1, 2), (2, 3), (3, 1), (4, 5)], {1: 0, 2: 1, 3: 2}), ([(2, 1)], {1: 0})])
def test_reachable(spark, edges, want):
    found = crawl.reachable(
        spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(1,)], "node int")
    )
    assert {r["node"]: r["lvl"] for r in found.collect()} == want


def test_deep_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(21)], "src int, dst int")
    found = crawl.reachable(edges, spark.createDataFrame([(0,)], "node int"))
    assert {r["node"]: r["lvl"] for r in found.collect()} == {i: i for i in range(22)}


def test_a_lazy_crawl_opens_what_it_reaches(spark, tmp_path):
    site = {"index.html": "<a href=docs>d</a><a href=docs/>d</a><a href=gone.html>", "docs/index.html": "<a href=../index.html>", "apart.html": "<a href=lost.html>"}
    for rel, text in site.items():
        (tmp_path / rel).parent.mkdir(exist_ok=True)
        (tmp_path / rel).write_text(text)
    files = spark.createDataFrame([("s", rel) for rel in [*site, "lost.html", "gone.html"]], "site string, rel string")
    entries = spark.createDataFrame([("s", "index.html")], "site string, entry string")
    asked = []

    def read(wanted):
        asked.extend(r["rel"] for r in wanted.collect())
        return to_docs(read_named(wanted, str(tmp_path)))

    run = crawl.crawl_lazily(read, files, entries)
    assert sorted(asked) == ["docs/index.html", "gone.html", "index.html"]
    assert {(r["rel"], r["readable"]) for r in run.parsed.collect()} == {("index.html", True), ("docs/index.html", True), ("gone.html", False)}
    assert {r["url"]: r["lvl"] for r in run.visits.collect()} == {"index.html": 0, "docs": 1, "docs/index.html": 1, "gone.html": 1}
    # Shown as "docs", its links start from the folder above.
    assert {(r["path"], r["reason"]) for r in run.broken().collect()} == {("gone.html", "unreadable"), ("../index.html", "escape")}
    outside = spark.createDataFrame([("s", "../x"), ("s", "docs")], "site string, rel string")
    assert [r["content"] for r in read_named(outside, str(tmp_path)).collect()] == [None, None]
    nothing = crawl.crawl_lazily(read, files, entries.limit(0))
    assert nothing.visits.collect() == nothing.links.collect() == nothing.broken().collect() == []


def test_total_of_a_report(spark):
    rows = [("a", 2, 1, "clean"), ("b", 3, 0, "incomplete")]
    report = spark.createDataFrame(rows, "site string, pages long, broken_links long, verdict string")
    got = {r["site"]: (r["total"], r["pages"], r["broken_links"], r["verdict"]) for r in audit.with_total(report).collect()}
    assert got == {"a": (False, 2, 1, "clean"), "b": (False, 3, 0, "incomplete"), None: (True, 5, 1, "incomplete")}
    assert audit.with_total(report.limit(0)).collect() == []
