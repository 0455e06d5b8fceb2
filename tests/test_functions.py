"""Column functions."""

import unicodedata
from urllib.parse import quote, unquote_to_bytes

from pyspark.sql import functions as F

from sitelake.functions import models, paths, slugs, text


def values(spark, column, rows, schema="s string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.coalesce(1).select(column).collect()]


def test_slugs(spark):
    names = ["Austin,_Texas", "Bachelor's_degree", "Call_of_Duty:_Black_Ops", "___", "Été/ÇA"]
    once = values(spark, slugs.normalize_slug(F.col("s")), names)
    assert once == ["austin-texas", "bachelor-s-degree", "call-of-duty-black-ops", "", "t-a"]
    assert values(spark, slugs.normalize_slug(F.col("s")), once) == once
    files = ["Slate_grokipedia.md", "Slate_Wikipedia.MD", "Slate.md"]
    assert values(spark, slugs.article_slug(F.col("s")), files) == ["slate"] * 3
    assert values(spark, slugs.source_rank(F.col("s")), files) == [2, 1, 0]


def test_percent_codes(spark):
    coded = ["100%", "%2", "%zz%41", "a+b", "%ff", "%C3%A9", "a%2Fb"]
    want = [unquote_to_bytes(c).decode("utf-8", "replace") for c in coded]
    assert values(spark, paths.percent_decode(F.col("s")), coded) == want
    plain = ["é ~*", "a/b?c=d&e", "-_.~", "日本"]
    assert values(spark, paths.percent_encode(F.col("s")), plain) == [quote(p, safe="~") for p in plain]
    assert values(spark, paths.percent_encode_path(F.col("s")), ["a b/é"]) == ["a%20b/%C3%A9"]
    query = ["q=x+%41&b=1", "b=1&q", "a=1", "%71=z"]
    assert values(spark, paths.query_param(F.col("s"), "q"), query) == ["x A", "", None, "z"]


def test_fold_key_is_nfc_and_ascii_lower_case(spark):
    names = ["Img/A.PNG", "étÉ", "É", "ÉA", None]
    want = [
        n if n is None else "".join(c.lower() if c.isascii() else c for c in unicodedata.normalize("NFC", n))
        for n in names
    ]
    assert values(spark, paths.fold_key(F.col("s")), names) == want


def test_url_to_rel(spark):
    cases = [
        ("http://127.0.0.1:8/1.html", False, "1.html"),
        ("<http://x/1.html>", False, "1.html"),
        ("http://x.com", False, "index.html"),
        ("http://x/", True, "index.html"),
        ("http://x/blog/", True, "blog/index.html"),
        ("http://x/blog/page/2/", False, "blog/page/2/index.html"),
        ("https://x/style.css?ver=4", False, "style.css"),
        ("https://x/about", True, "about/index.html"),
        ("https://x/about", False, "about"),
        ("https://x/a/Figures/q.png", False, "figures/q.png"),
        ("https://x/a/../q", False, None),
        ("https://x//a//b", False, "a/b"),
    ]
    column = paths.url_to_rel(F.col("s"), F.col("h"))
    assert values(spark, column, [c[:2] for c in cases], "s string, h boolean") == [c[2] for c in cases]


def test_members_and_requests(spark):
    names = ["a\\b.html", "/a/", "a/../b", "a//b", "./a", "", "/", "a\x00b", "ok.html"]
    assert values(spark, paths.normalize_member(F.col("s")), names) == [
        "a/b.html", "a", None, None, None, None, None, None, "ok.html",
    ]
    urls = ["/", "/a%20b?x", "/../secret", "/a//b", "/x%5Cy", "/docs/", "/%2e%2e/x"]
    assert values(spark, paths.safe_request_path(F.col("s")), urls) == ["", "a b", None, None, None, "docs", None]


def test_link_policies(spark):
    dests = ["", "#x", "a.md", "https://x", "HTTP://x", "//evil", "javascript:x", "data:x", "a:b"]
    assert values(spark, paths.note_link_allowed(F.col("s")), dests) == [True] * 5 + [False] * 4
    urls = [" https://x/a ", "https://x/a b", "ftp://x", "javascript:x", "https://x/\x07"]
    assert values(spark, paths.answer_link(F.col("s")), urls) == ["https://x/a", "#", "#", "#", "#"]


def test_context_windows(spark):
    cards = [
        '{"parameters": "temperature 1\\nnum_ctx    8192", "model_info": {"a.context_length": 5}}',
        '{"parameters": "num_ctx 0", "model_info": {"a.context_length": 32768}}',
        '{"model_info": {"a.context_length": 4096.0}}',
        '{"model_info": {"a.context_length": 1.5, "b.context_length": -1}}',
        "{}",
    ]
    assert values(spark, models.context_window(F.col("s")), cards) == [8192, 32768, 4096, None, None]


def test_clean_html(spark):
    pages = [
        "a<SCRIPT x>no</script>b<style>no</STYLE>c",
        "a<script>never closed",
        "a<scripty>kept</scripty>",
        "a<style/>no</style>b<script",
    ]
    assert values(spark, text.clean_html(F.col("s")), pages) == ["abc", "a", "a<scripty>kept</scripty>", "ab"]


def test_titles(spark):
    notes = [
        ("# Title  \nx", "a/b.md", "Title"),
        ("﻿\n  \n # Late\n", "b.md", "Late"),
        ("text\n# Not", "a/My note.md", "My note"),
        ("## Sub", "x.y.md", "x.y"),
        ("", "z.md", "z"),
    ]
    found = values(spark, text.note_title(F.col("s"), F.col("r")), [n[:2] for n in notes], "s string, r string")
    assert found == [n[2] for n in notes]


def test_rewriting(spark):
    origins = F.array(F.lit("http://ex.com"), F.lit("http://ex.com.au"))
    pages = ['<a href="http://ex.com.au/x"> //ex.com/y http://ex.com', "http://other.com"]
    assert values(spark, text.rewrite_origins(F.col("s"), origins), pages) == ['<a href="/x"> /y ', "http://other.com"]
    figures = ['src="https://cdn/x/Figures/a.png?w=1" b', "/Figures/b.png", "https://a/b https://c/Figures/d e"]
    assert values(spark, text.rewrite_figures(F.col("s")), figures) == [
        'src="figures/a.png?w=1" b', "/Figures/b.png", "https://a/b figures/d e",
    ]
