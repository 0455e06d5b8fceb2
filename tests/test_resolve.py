"""Link resolution against known cases and against a plain model."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitelake.operators.resolve import resolve_links, with_page_base

REMOTE = "https://ex.com/sub/"

CASES = [
    # document, base href, href, class, path or url, fragment
    ("index.html", REMOTE, "a.html", "external", "https://ex.com/sub/a.html", None),
    ("index.html", REMOTE, "/b.html", "external", "https://ex.com/b.html", None),
    ("index.html", REMOTE, "../x.html", "external", "https://ex.com/x.html", None),
    ("index.html", REMOTE, "../../../x/", "external", "https://ex.com/x/", None),
    ("index.html", REMOTE, "https:a.html", "external", "https://ex.com/sub/a.html", None),
    ("index.html", REMOTE, "http:foo.html", "external", "http://foo.html/", None),
    ("sub/index.html", None, "http:foo.html", "local", "sub/foo.html", None),
    ("sub/index.html", None, "http:/foo.html", "local", "foo.html", None),
    ("sub/index.html", None, "https:foo", "external", "https://foo/", None),
    ("sub/index.html", None, "https:foo/bar?q#f", "external", "https://foo/bar?q", None),
    ("sub/index.html", None, "https:", "skip", None, None),
    ("sub/index.html", None, "about:blank", "skip", None, None),
    ("sub/index.html", None, "  ", "skip", None, None),
    ("sub/index.html", None, "img\\bar.png", "local", "sub/img/bar.png", None),
    ("sub/index.html", None, "img%5Cbar.png", "local", "sub/img\\bar.png", None),
    ("sub/index.html", None, "http:\\\\ex.com\\a", "external", "http://ex.com/a", None),
    ("sub/index.html", None, "//cdn.x/y#z", "external", "//cdn.x/y", None),
    ("sub/index.html", None, "../../out/a.png", "escape", "../out/a.png", None),
    ("sub/index.html", None, "..", "local", "", None),
    ("sub/index.html", None, "../..", "escape", "..", None),
    ("sub/index.html", "../../out/", "a.png", "escape", "../out/a.png", None),
    ("sub/index.html", "../../out/", "/a.png", "local", "a.png", None),
    ("index.html", "files/", "a.png", "local", "files/a.png", None),
    ("index.html", "files/", "#x", "local", "files", "x"),
    ("sub/index.html", None, "#a%20b", "local", "sub/index.html", "a b"),
    ("sub/index.html", None, "x%2Fy%2e%2E/z?q#%20", "local", "sub/x/y../z", None),
    ("sub/index.html", None, "a/%2e%2e/b", "local", "sub/b", None),
    ("docs/", None, "page.html", "local", "docs/page.html", None),
    ("docs", None, "page.html", "local", "page.html", None),
]


def resolve(spark, rows):
    df = spark.createDataFrame(rows, "id int, url string, base_href string, href string")
    found = resolve_links(with_page_base(df)).select(
        "id", "target.cls", F.coalesce("target.url", "target.path"), "target.fragment", "target.is_dir"
    )
    return {r[0]: tuple(r[1:]) for r in found.collect()}


def test_known_links(spark):
    found = resolve(spark, [(i, *case[:3]) for i, case in enumerate(CASES)])
    for i, case in enumerate(CASES):
        assert found[i][:3] == case[3:], case


def model(url, href):
    """Relative paths on a local page, step by step."""
    stack = [s for s in url.split("/") if s]
    if not url.endswith("/"):
        stack = stack[:-1]
    if href.startswith("/"):
        stack = []
    above = 0
    for piece in href.split("/"):
        if piece in ("", "."):
            continue
        if piece != "..":
            stack.append(piece)
        elif stack:
            stack.pop()
        else:
            above += 1
    is_dir = href.split("/")[-1] in ("", ".", "..")
    if not above:
        return "local", "/".join(stack), None, is_dir
    label = "../" * above + "/".join(stack) + ("/" if is_dir and stack else "")
    return "escape", label if stack else label.rstrip("/"), None, is_dir


PIECE = st.sampled_from(["", ".", "..", "a", "b c", "é", "x.html"])
HREF = st.lists(PIECE, min_size=1, max_size=6).map("/".join).filter(lambda h: h and not h.startswith("//"))
URL = st.lists(st.sampled_from(["a", "b", "é"]), min_size=1, max_size=3).map("/".join)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(URL, HREF), min_size=60, max_size=120))
def test_relative_paths_follow_the_model(spark, pairs):
    found = resolve(spark, [(i, url, None, href) for i, (url, href) in enumerate(pairs)])
    for i, (url, href) in enumerate(pairs):
        assert found[i] == model(url, href), (url, href)
