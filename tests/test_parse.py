"""Links, anchors and bases of HTML and CSS."""

import pyarrow as pa

from sitelake.functions.pieces import pieces
from sitelake.operators.parse import (
    _parse_batches,
    anchor_rows,
    css_links,
    html_items,
    link_rows,
    note_link_rows,
    parse_docs,
    srcset_links,
)


def hrefs(html):
    return [href for _, _, href in html_items(html)[0]]


def test_elements_and_attributes():
    html = """<a href=x.html>1</a><IMG SRC='a.png' srcset="b.png 1x, c.png 2x"><video poster=p.jpg src=v.mp4>
    <object data="o.swf"></object><form action=go></form><link href=" s.css "><a name=n href=""><p href=no>"""
    assert hrefs(html) == ["x.html", "a.png", "b.png", "c.png", "v.mp4", "p.jpg", "o.swf", "go", "s.css"]


def test_comments_scripts_and_declarations():
    html = """<!doctype html><!-- <a href=no> --><script src=app.js>var a = '<a href=no>';</script >
    <?php <a href=no2>?><a href=yes><!-- <a href=no3>"""
    assert hrefs(html) == ["app.js", "yes"]


def test_quotes_and_unterminated_markup():
    assert hrefs('<a title="x > y" href=ok>z</a>< a href=no><a href="open') == ["ok"]
    assert hrefs("<a / href=no><a href=a/b?c=d&amp;e>") == ["a/b?c=d&e"]
    assert hrefs("<script src=s.js>never closed <a href=no>") == ["s.js"]
    assert hrefs("<style>a{b:url(one.png)}") == ["one.png"]


def test_first_attribute_wins_and_every_id_counts():
    links, ids, base = html_items('<a href=1 href=2 id=x ID=y name=z><p id="" name=w><base href=" "><base href=b/><base href=c>')
    assert [h for _, _, h in links] == ["1"]
    assert ids == ["x", "y", "z"]
    assert base == "b/"


def test_entities():
    html = '<a href="&amp;&lt;&gt;&quot;&apos;&#65;&#x42;&#xD800;&nbsp;&amp"></a>'
    assert hrefs(html) == ["&<>\"'AB&#xD800;&nbsp;&amp"]


def test_style_attributes_come_first():
    assert hrefs('<img src=a.png style="background:url(b.png)">') == ["b.png", "a.png"]


def test_css():
    css = r"""/* url("nope.png") */ @import "one.css"; @IMPORT url( 'two.css' );
    a{b:url(three.png )} c{content:"url(no.png)"} curl(no) d{e:URL("fo\"ur.png" )} f{g:url(img\plain.png)} h{i:url()}"""
    assert css_links(css) == ["one.css", "two.css", "three.png", 'fo"ur.png', "img\\plain.png"]
    assert css_links("a url(/* x") == ["/* x"]
    assert css_links("x /* url(no.png)") == []
    assert css_links("'unterminated url(yes.png)") == ["yes.png"]


def test_srcset():
    assert srcset_links("data:image/png;base64,AAAA,BB 1x, gone.png 2x,,last.png") == [
        "data:image/png;base64,AAAA,BB", "gone.png", "last.png",
    ]


def test_parse_docs(spark):
    docs = spark.createDataFrame(
        [
            ("s", "a.html", "html", "<base href=x/><a id=i href=1><a href=2>"),
            ("s", "b.css", "css", "a{b:url(c.png)}"),
            ("s", "c.html", "html", None),
        ],
        "site string, rel string, kind string, text string",
    )
    parsed = parse_docs(docs)
    links = link_rows(parsed).select("rel", "pos", "href", "base_href").collect()
    assert sorted(map(tuple, links), key=str) == [("a.html", 0, "1", "x/"), ("a.html", 1, "2", "x/"), ("b.css", 0, "c.png", None)]
    assert [tuple(r) for r in anchor_rows(parsed, "rel").collect()] == [("a.html", "i")]


def test_note_links(spark):
    note = """# T
[a](x.md) ![i](<p q.png> "t") [b](/page/A_(x)#f 'title') <https://h/x>
`[no](1)` [r][Ref One] [short] [nested [x]](y)
```
[no](2)
```
[ref one]: r.md "title"
[short]: <s t.md>
"""
    df = spark.createDataFrame([("n.md", note)], "rel string, text string")
    found = note_link_rows(df).orderBy("pos").select("dest", "is_image").collect()
    assert [tuple(r) for r in found] == [
        ("x.md", False), ("p q.png", True), ("/page/A_(x)#f", False), ("https://h/x", False),
        ("r.md", False), ("s t.md", False), ("y", False),
    ]


def test_long_lines_of_brackets(spark):
    texts = ["[" + "x" * 200_000, "[" * 50_000, "[a](" + "(" * 50_000, "[" + "\\a" * 50_000 + "](y)", "[a](b)" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    found = note_link_rows(df).groupBy("n").count().collect()
    assert {r["n"]: r["count"] for r in found}[4] == 20_000


def test_batches_are_parsed_in_pieces_of_bounded_size():
    texts = ["x" * 10, None, "y" * 3_000_000, "z" * 3_000_000, "w" * 9_000_000, "", '<a href="/v">' + "v" * 10]
    batch = pa.RecordBatch.from_pydict({"n": list(range(7)), "kind": ["html"] * 7, "text": pa.array(texts, pa.string())})
    assert [p.column("n").to_pylist() for p in pieces(batch, "text")] == [[0, 1, 2], [3], [4], [5, 6]]
    assert [p.num_rows for p in pieces(batch.slice(0, 0), "text")] == [0]
    parsed = list(_parse_batches(iter([batch])))
    assert len(parsed) == 4
    rows = [row for part in parsed for row in part.to_pylist()]
    assert [row["n"] for row in rows] == list(range(7))
    assert [[link["href"] for link in row["links"]] for row in rows] == [[]] * 6 + [["/v"]]
