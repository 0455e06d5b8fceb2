"""Archive files written here and read through the Spark sources."""

import gzip
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sitelake.constants import ENTRY_NAMES, MAX_WARC_RECORD
from sitelake.functions.paths import content_type
from sitelake.operators import archives, catalog, crawl, ordering
from sitelake.sources.folders import WALKS, FolderReader, read_folder, to_docs, visible_notes
from sitelake.sources.sites import read_site, write_site
from sitelake.sources.warc import read_wacz, read_warc
from sitelake.sources.zips import read_zip_catalog, read_zip_members


def record(uri, body=b"", kind="response", ctype="text/html", status="200 OK", length=None):
    if kind == "response":
        body = f"HTTP/1.1 {status}\r\nContent-Type: {ctype}\r\n\r\n".encode() + body
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {uri}\r\nContent-Type: {ctype}\r\n"
    return head.encode() + f"Content-Length: {len(body) if length is None else length}\r\n\r\n".encode() + body + b"\r\n\r\n"


def site_of(records):
    """The files a site gets from its records, text decoded and links rewritten."""
    kept = archives.keep_responses(records).filter("rel is not null").withColumn("order", F.struct("file", "seq"))
    kept = archives.drop_path_clashes(kept, "order")
    origins = archives.site_origins(kept)
    files = archives.latest_payload(kept, "order").select(
        "site", "rel", F.make_valid_utf8(F.col("payload").cast("string")).alias("text")
    )
    return archives.rewrite_site(files, origins)


def as_dict(files):
    return {r["rel"]: r["text"] for r in files.select("rel", "text").collect()}


def test_warc_site(spark, tmp_path):
    page = b'<img src="https://cdn.test/x/Figures/a.png"><a href="http://127.0.0.1:8/2.html">'
    data = record("http://127.0.0.1:8/1.html", page) + record("https://cdn.test/x/Figures/a.png", b"PNG", ctype="image/png")
    data += record("http://127.0.0.1:8/gone.html", b"x", status="404 Not Found") + record("urn:pageinfo:x", b"{}", "resource")
    (tmp_path / "one.warc").write_bytes(data)
    files = site_of(read_warc(spark, str(tmp_path / "one.warc")))
    assert as_dict(files) == {"1.html": '<img src="figures/a.png"><a href="/2.html">', "figures/a.png": "PNG"}
    assert [tuple(r) for r in ordering.seed_pages(files, ENTRY_NAMES).collect()] == [("one", "1.html")]


def test_multi_member_gzip_and_nested_pages(spark, tmp_path):
    records = [
        record("https://ex.com/", b'<link href="https://ex.com/s.css?v=1"><a href="https://ex.com/blog/">'),
        record("https://ex.com/s.css?v=1", b"a{}", ctype="text/css"),
        record("<https://ex.com/blog/>", b"blog"),
        record("https://ex.com/blog/page/2/", b"two"),
        record("https://ex.com/blog", b"newest"),
    ]
    (tmp_path / "site.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
    records = read_warc(spark, str(tmp_path))
    assert [r["seq"] for r in records.orderBy("seq").collect()] == [0, 1, 2, 3, 4]
    assert as_dict(site_of(records)) == {
        "index.html": '<link href="/s.css?v=1"><a href="/blog/">',
        "s.css": "a{}",
        "blog/index.html": "newest",
        "blog/page/2/index.html": "two",
    }


def test_wacz(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "col.wacz", "w") as archive:
        archive.writestr("archive/b.warc.gz", gzip.compress(record("http://x/b.html", b"b")))
        archive.writestr("deep/er/a.warc", record("http://x/a.html", b"a"))
        archive.writestr("datapackage.json", "{}")
    records = read_wacz(spark, str(tmp_path / "*.wacz"))
    assert as_dict(site_of(records)) == {"a.html": "a", "b.html": "b"}
    assert {r["site"] for r in records.select("site").collect()} == {"col"}
    with zipfile.ZipFile(tmp_path / "none.wacz", "w") as archive:
        archive.writestr("x.txt", "x")
    with pytest.raises(Exception, match="no WARC"):
        read_wacz(spark, str(tmp_path / "none.wacz")).collect()


@pytest.mark.parametrize(
    "tail, message",
    [
        (record("http://x/", length=MAX_WARC_RECORD + 1), str(MAX_WARC_RECORD + 1)),
        (b"GARBAGE\r\n", "unexpected"),
        (b"WARC/1.0\r\nWARC-Type: x\r\n\r\n", "without"),
        (record("http://x/", length="12x"), "invalid"),
        (record("http://x/", b"abc", length=9999), "cut short"),
    ],
)
def test_malformed_warc(spark, tmp_path, tail, message):
    (tmp_path / "bad.warc").write_bytes(record("http://x/ok.html", b"ok") + tail)
    path = str(tmp_path / "bad.warc")
    with pytest.raises(Exception, match=message):
        read_warc(spark, path).collect()
    rows = read_warc(spark, path, "DROPMALFORMED").orderBy("seq").collect()
    assert rows[0]["target_uri"] == "http://x/ok.html"
    assert message in rows[1]["_error"]


def test_records_after_a_bad_one(spark, tmp_path):
    bad = [record("http://x/big", b"z" * 500), b"GARBAGE\r\nmore\r\n", b"WARC/1.0\r\nWARC-Type: x\r\n\r\nlost body\r\n", record("http://x/", length="12x")]
    data = b"".join(record(f"http://x/{i}", b"ok") + b for i, b in enumerate(bad)) + record("http://x/last", b"ok")
    (tmp_path / "w.warc").write_bytes(data)
    (tmp_path / "index.cdx").write_bytes(b"no records")
    rows = read_warc(spark, str(tmp_path), "DROPMALFORMED", largest=200).collect()
    assert [r["target_uri"] for r in rows if r["_error"] is None] == [*(f"http://x/{i}" for i in range(4)), "http://x/last"]
    assert sum(r["_error"] is not None for r in rows) == 4
    bare = read_warc(spark, str(tmp_path), "DROPMALFORMED", types=("request",), body=False).filter("_error IS NULL")
    assert bare.count() == 0


def test_payloads_are_cut_by_bytes(spark):
    payload = bytes(range(256))
    heads = ["X-T: café é".encode(), b"X-T: plain", "X-T: 漢字".encode()]
    bodies = [(i, b"HTTP/1.1 200 OK\r\n" + h + b"\r\nContent-Type: image/png\r\n\r\n" + payload) for i, h in enumerate(heads)]
    bodies.append((9, b"HTTP/1.1 200 OK\r\nContent-Type: text/html"))
    df = spark.createDataFrame(bodies, "n int, body binary")
    status, kind, cut = archives.split_http(F.col("body"))
    rows = {r["n"]: r for r in df.select("n", status.alias("s"), kind.alias("k"), cut.alias("p")).collect()}
    assert all((rows[i]["s"], rows[i]["k"], bytes(rows[i]["p"])) == (200, "image/png", payload) for i in range(3))
    assert rows[9]["s"] is None and rows[9]["p"] is None


def test_path_clashes(spark):
    rows = [("s", 1, "a/y"), ("s", 2, "a"), ("s", 3, "a/x"), ("s", 4, "b"), ("s", 5, "b/c"), ("s", 6, "b/c/d"), ("s", 7, "b")]
    kept = archives.drop_path_clashes(spark.createDataFrame(rows, "site string, seq int, rel string"))
    assert sorted(r["seq"] for r in kept.collect()) == [1, 3, 4, 7]


def test_audit_of_a_warc(spark, tmp_path):
    data = record("http://h/1.html", b'<a href="absent.html"><img src="http://h/p.png"><a href="http://h/">')
    data += record("http://h/", b'<a href="http://h/1.html">') + record("http://h/p.png", b"P", ctype="image/png")
    (tmp_path / "w.warc").write_bytes(data)
    files = site_of(read_warc(spark, str(tmp_path / "w.warc"))).cache()
    docs = files.withColumns({"truncated": F.lit(False), "readable": F.lit(True)})
    entries = files.filter("rel = 'index.html'").select("site", F.col("rel").alias("entry"))
    report = crawl.crawl(docs, files, entries).report().first()
    assert (report["pages"], report["external"], report["broken_links"], report["reached"]) == (2, 0, 1, 3)


def zip_of(path, members):
    with zipfile.ZipFile(path, "w") as archive:
        for name, content in members.items():
            archive.writestr(name, content)


def test_zip_catalog_and_members(spark, tmp_path):
    zip_of(tmp_path / "a.zip", {"index.html": "home", "docs/": "", "docs/é.html": "x" * 10})
    zip_of(tmp_path / "b.ZIP", {"n.md": "# N"})
    listed = read_zip_catalog(spark, str(tmp_path)).select("name", "size", "is_dir", "ordinal").collect()
    assert sorted(map(tuple, listed)) == [
        ("docs/", 0, True, 1), ("docs/é.html", 10, False, 2), ("index.html", 4, False, 0), ("n.md", 3, False, 0),
    ]
    named = read_zip_members(spark, str(tmp_path), ["index.html", "n.md"]).select("name", "content")
    assert sorted((r["name"], bytes(r["content"])) for r in named.collect()) == [("index.html", b"home"), ("n.md", b"# N")]


def test_parts_cover_every_member_once():
    from sitelake.sources.zips import BYTES_PER_TASK, zip_parts

    parts = zip_parts("x.zip", 3 * BYTES_PER_TASK + 1)
    assert len(parts) == 4
    members = [SimpleNamespace(n=i, header_offset=i * i * 100, compress_size=50) for i in range(10)]
    assert [m.n for part in parts for m in part.slice(members)] == list(range(10))


def test_filters_on_names_reach_the_zip(spark, tmp_path):
    zip_of(tmp_path / "a.zip", {"index.html": "home", "big.bin": "y" * 1000})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = read_zip_members(spark, str(tmp_path)).filter("name = 'index.html'").select("name", "size")
        assert [tuple(r) for r in found.collect()] == [("index.html", 4)]
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")


def test_listing_a_large_zip_reads_little(tmp_path, monkeypatch):
    from sitelake.sources import zips

    big = tmp_path / "big.zip"
    zip_of(big, {"huge.bin": b"\0" * (8 << 20), "index.html": "home"})
    counted = []

    class Counting:
        def __init__(self, file):
            self.file = file

        def read(self, n=-1):
            data = self.file.read(None if n < 0 else n)
            counted.append(len(data))
            return data

        def __getattr__(self, name):
            return getattr(self.file, name)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

    opened = zips.open_random
    monkeypatch.setattr(zips, "open_random", lambda *a: Counting(opened(*a)))
    options = {"path": str(big), "names": "index.html"}
    list(zips.CatalogReader(options).read(zips.ZipPart(str(big), 0, 1)))
    list(zips.MembersReader(options).read(zips.ZipPart(str(big), 0, 1)))
    assert sum(counted) < 2 << 20


MEMBERS = {
    "root": ["index.html", "native/a.css", "site/OUVRIR.html", "__MACOSX/._OUVRIR.html"],
    "wrapped": ["site/OUVRIR.html", "site/a.css", "__MACOSX/site/._a.css", ".DS_Store"],
    "twice": ["a/b/index.htm", "a/b/c.png", "a/b/d/"],
    "notes": ["notes/page.md", "notes/figures/a.png"],
    "two": ["notes/page.md", "figures/a.png", ".hidden/secret.md"],
    "cased": ["site/Ouvrir.HTML", "site/photo.JPG"],
    "order": ["INDEX.html", "Index.html", "ouvrir.html"],
    "none": ["a.png"],
    "hidden": [".git/index.html", "__MACOSX/index.html"],
    "empty": ["a/"],
}
CLASSES = {
    "root": ("", "site", "index.html"),
    "wrapped": ("site", "site", "OUVRIR.html"),
    "twice": ("a/b", "site", "index.htm"),
    "notes": ("notes", "notes", None),
    "two": ("", "notes", None),
    "cased": ("site", "site", "Ouvrir.HTML"),
    "order": ("", "site", "ouvrir.html"),
    "none": (None, "none", None),
    "hidden": (None, "none", None),
    "empty": (None, "none", None),
}


def member_rows(spark, groups):
    rows = [(archive, name) for archive, names in groups.items() for name in names]
    return archives.normalize_members(spark.createDataFrame(rows, "archive string, name string"))


def test_classify_archives(spark):
    found = archives.classify_archives(member_rows(spark, MEMBERS)).collect()
    assert {r["archive"]: (r["root"], r["kind"], r["entry"]) for r in found} == CLASSES


def test_rebase(spark):
    rows = member_rows(spark, {"wrapped": MEMBERS["wrapped"]})
    found = archives.rebase(rows, archives.classify_archives(rows))
    assert sorted(r["rel"] for r in found.collect()) == ["OUVRIR.html", "a.css"]


def test_lookup_prefers_exact_then_lower_then_smallest(spark):
    files = spark.createDataFrame(
        [("a", "index.html"), ("a", "Index.html"), ("b", "INDEX.HTML"), ("b", "Index.html"), ("c", "É.html")],
        "site string, rel string",
    )
    asked = spark.createDataFrame(
        [("a", "Index.html"), ("a", "INDEX.html"), ("b", "index.html"), ("b", "Index.html"), ("c", "É.HTML"), ("c", "é.html")],
        "site string, path string",
    )
    found = {(r["site"], r["path"]): r["found"] for r in catalog.folded_lookup(asked, files).collect()}
    assert found == {
        ("a", "Index.html"): "Index.html",
        ("a", "INDEX.html"): "index.html",
        ("b", "index.html"): "INDEX.HTML",
        ("b", "Index.html"): "Index.html",
        ("c", "É.HTML"): "É.html",
        ("c", "é.html"): None,
    }


def test_select_archive(spark):
    listing = {
        "c/one": ["one.wacz", "a.wacz", "z.zip"],
        "c/two": ["index.html", "x.wacz"],
        "c/three": ["readme.txt"],
        "c/four": ["notes.md", "x.zip"],
        "c/five": ["archive/b.warc.gz", "archive/a.WARC", "c.warc"],
        "c/six": ["deep/n.md"],
        "c/seven": ["wrap/index.html", "wrap/x.zip"],
    }
    rows = [(folder, path, True) for folder, names in listing.items() for path in names]
    chosen = archives.select_archive(spark.createDataFrame(rows, "folder string, path string, is_file boolean"))
    assert {r["folder"]: (r["chosen"], r["site"]) for r in chosen.collect()} == {
        "c/one": ("one.wacz", "one"),
        "c/two": ("", "two"),
        "c/three": (None, None),
        "c/four": ("x.zip", "x"),
        "c/five": ("archive/a.WARC", "a"),
        "c/six": ("", "six"),
        "c/seven": ("", "seven"),
    }


def test_folders_and_site_tables(spark, tmp_path):
    root = tmp_path / "site"
    (root / "docs").mkdir(parents=True)
    (root / ".git").mkdir()
    (root / "index.html").write_bytes(b"a\xffb")
    (root / "docs" / "x.png").write_bytes(b"P")
    (root / ".git" / "y.html").write_bytes(b"no")
    (root / "_static").mkdir()
    (root / "_static" / "s.css").write_bytes(b"p{}")
    found = {r["rel"]: r["size"] for r in read_folder(spark, str(root), content=False).collect()}
    assert found == {"index.html": 3, "docs/x.png": 1, ".git/y.html": 2, "_static/s.css": 3}
    (root / "_static" / "s.css").unlink()
    cut = to_docs(read_folder(spark, str(root)), limit=1).filter("rel = 'index.html'").first()
    assert (cut["text"], cut["truncated"]) == ("a", True)
    docs = to_docs(read_folder(spark, str(root), visible=visible_notes()))
    assert {r["rel"]: (r["kind"], r["text"]) for r in docs.collect()} == {"index.html": ("html", "a�b"), "docs/x.png": (None, "P")}
    files = read_folder(spark, str(root), visible=visible_notes()).select("site", "rel", F.col("content").alias("payload"))
    write_site(files, str(tmp_path / "out"))
    stored = read_site(spark, str(tmp_path / "out"))
    assert "payload" not in stored.columns
    assert sorted((r["rel"], r["size"]) for r in stored.collect()) == [("docs/x.png", 1), ("index.html", 3)]
    assert read_site(spark, str(tmp_path / "out"), payload=True).count() == 2


def test_requests(spark):
    files = spark.createDataFrame([("s", "index.html"), ("s", "Docs/index.html"), ("s", "a b.css")], "site string, rel string")
    urls = ["/", "/docs", "/docs/", "/A%20B.css?v=1", "/nope", "/../x", "/a//b"]
    requests = spark.createDataFrame([("s", u) for u in urls], "site string, url string")
    found = catalog.route_requests(requests, files).withColumn("type", content_type(F.col("rel")))
    assert {r["url"]: (r["status"], r["rel"]) for r in found.collect()} == {
        "/": (200, "index.html"),
        "/docs": (200, "Docs/index.html"),
        "/docs/": (200, "Docs/index.html"),
        "/A%20B.css?v=1": (200, "a b.css"),
        "/nope": (404, None),
        "/../x": (403, None),
        "/a//b": (403, None),
    }


def test_many_small_folders_are_dealt_to_a_bounded_number_of_tasks(tmp_path):
    names = [f"f{i}/deep/{i}.txt" for i in range(1500)] + ["top.txt"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    reader = FolderReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(parts) <= WALKS + 1
    rows = [row for part in parts for batch in reader.read(part) for row in batch.to_pylist()]
    assert sorted((r["rel"], r["content"].decode()) for r in rows) == sorted((n, n) for n in names)
