"""Documents to links, anchors and bases.

One Arrow pass per document: tokenizing markup needs a scan with state (quotes,
comments, script bodies) that SQL expressions cannot hold. The rest of the work
on links is native.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.constants import WHITE_SPACE
from sitelake.functions.pieces import pieces

ASCII = re.ASCII | re.IGNORECASE | re.DOTALL

# Everything up to the next tag worth a look: text, comments, declarations,
# closing tags and tags without attributes are passed over in one match. Then
# an opening tag, or the unterminated rest.
MARKUP = re.compile(
    r"""(?:[^<]++|<!--.*?-->|<(?!!--)[!?/][^>]*+>"""
    r"""|<(?!(?:script|style)[/>])(?:[^!?/"'> \t\n\f\r][^"'> \t\n\f\r]*+)?+>)*+"""
    r"""(?:<(?P<tag>(?![!?/])(?:[^"'>]++|"[^"]*+"|'[^']*+')*+)>|(?P<rest><.*))""",
    ASCII,
)
# Attributes any element may carry.
COMMON_ATTRIBUTE = re.compile(r"id|style", ASCII)
NAME = re.compile(r"[^ \t\n\f\r/]*")
ATTRIBUTE = re.compile(
    r"""[ \t\n\f\r]*+(?P<name>[^ \t\n\f\r=/]++)"""
    r"""(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+"""
    r"""(?:"(?P<dq>[^"]*+)"?|'(?P<sq>[^']*+)'?|(?P<raw>[^ \t\n\f\r]*+)))?+"""
)
ENTITY = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#[xX]\+?([0-9A-Fa-f]+)|#\+?([0-9]+));", re.ASCII)
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
CLOSING = {
    name: re.compile(rf"</{name}[ \t\n\f\r]*>", ASCII) for name in ("script", "style")
}
CSS_TOKEN = re.compile(
    r"""/\*(?:.*?\*/|.*)"""
    r"""|(?<![A-Za-z0-9_-])url\([ \t\n\f\r]*+(?:"(?P<udq>(?:[^"\\]|\\.)*+)"[^)]*+\)?"""
    r"""|'(?P<usq>(?:[^'\\]|\\.)*+)'[^)]*+\)?|(?P<uraw>(?!["']|\Z)[^)]*+)\)?)"""
    r"""|(?<![A-Za-z0-9_-])@import[ \t\n\f\r]*+(?:"(?P<idq>(?:[^"\\]|\\.)*+)\""""
    r"""|'(?P<isq>(?:[^'\\]|\\.)*+)')"""
    r"""|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'""",
    ASCII,
)
CSS_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
SRCSET = re.compile(
    r"[ \t\n\f\r]*+(?:(?P<data>data:[^ \t\n\f\r]*+)|(?P<url>[^ \t\n\f\r,]*+))[^,]*+,?", ASCII
)

# Which attributes of which elements hold links, in link order.
LINK_ATTRIBUTES = {
    "a": ["href"],
    "area": ["href"],
    "link": ["href"],
    "img": ["src", "srcset"],
    "script": ["src", "srcset"],
    "iframe": ["src", "srcset"],
    "embed": ["src", "srcset"],
    "source": ["src", "srcset"],
    "audio": ["src", "srcset"],
    "track": ["src", "srcset"],
    "input": ["src", "srcset"],
    "video": ["src", "srcset", "poster"],
    "object": ["data"],
    "form": ["action"],
}

KNOWN_TAGS = {*LINK_ATTRIBUTES, "base", "style"}

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _entity(match: re.Match) -> str:
    name, hexadecimal, decimal = match.groups()
    if name:
        return NAMED[name]
    digits = (hexadecimal or decimal).lstrip("0") or "0"
    code = int(digits, 16 if hexadecimal else 10) if len(digits) < 10 else 0x110000
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return match.group()
    return chr(code)


def css_links(css: str) -> list[str]:
    """``url(...)`` and ``@import`` targets of a style sheet, in order."""
    found = []
    for token in CSS_TOKEN.finditer(css):
        part = token.lastgroup
        if part is None:
            continue
        value = token[part]
        value = value.strip(WHITE_SPACE) if part == "uraw" else CSS_ESCAPE.sub(r"\1", value)
        if value:
            found.append(value)
    return found


def srcset_links(value: str) -> list[str]:
    found, at = [], 0
    while at < len(value):
        token = SRCSET.match(value, at)
        if token.end() == at:
            break
        at = token.end()
        url = (token["data"] or token["url"] or "").strip(WHITE_SPACE)
        if url:
            found.append(url)
    return found


def tag_attributes(text: str, at: int = 0) -> list[tuple[str, str]]:
    """Attributes of a tag in order, names lower-cased, entities decoded."""
    found = []
    while token := ATTRIBUTE.match(text, at):
        at = token.end()
        value = token["dq"] or token["sq"] or token["raw"] or ""
        if "&" in value:
            value = ENTITY.sub(_entity, value)
        found.append((token["name"].translate(LOWER), value))
    return found


def html_items(html: str) -> tuple[list[tuple[str, str, str]], list[str], str | None]:
    """Links ``(tag, attribute, href)`` in document order, ids, and the base."""
    links: list[tuple[str, str, str]] = []
    ids: dict[str, None] = {}
    base, at = None, 0
    while token := MARKUP.match(html, at):
        at = token.end()
        tag = token["tag"]
        if tag is None:
            break
        end = NAME.match(tag).end()
        name = tag[:end].translate(LOWER)
        if not name or not (name in KNOWN_TAGS or COMMON_ATTRIBUTE.search(tag, end)):
            continue
        attributes = tag_attributes(tag, end)
        first: dict[str, str] = {}
        for key, value in attributes:
            first.setdefault(key, value)
            if value and (key == "id" or (key == "name" and name == "a")):
                ids[value] = None
            if key == "style":
                links += [(name, key, url) for url in css_links(value)]
        if name == "base":
            base = base or first.get("href", "").strip(WHITE_SPACE) or None
        for key in LINK_ATTRIBUTES.get(name, ()):
            value = first.get(key, "")
            urls = srcset_links(value) if key == "srcset" else [value.strip(WHITE_SPACE)]
            links += [(name, key, url) for url in urls if url]
        if name in CLOSING:
            close = CLOSING[name].search(html, at)
            if name == "style":
                body = html[at : close.start() if close else len(html)]
                links += [(name, "text", url) for url in css_links(body)]
            if close is None:
                break
            at = close.end()
    return links, list(ids), base


PARSED_DDL = (
    "links array<struct<pos:int,tag:string,attr:string,href:string>>,"
    " ids array<string>, base_href string"
)


def _lists(rows: list[list], values: pa.Array) -> pa.ListArray:
    offsets = pa.array(accumulate((len(r) for r in rows), initial=0), type=pa.int32())
    return pa.ListArray.from_arrays(offsets, values)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in pieces(whole, "text")):
        links, ids, bases = [], [], []
        for kind, text in zip(batch.column("kind").to_pylist(), batch.column("text")):
            text = text.as_py() or ""
            if kind == "css":
                items, anchors, base = [("css", "text", url) for url in css_links(text)], [], None
            else:
                items, anchors, base = html_items(text)
            links.append(items)
            ids.append(anchors)
            bases.append(base)
        tags, attrs, hrefs = zip(*(link for items in links for link in items)) if any(links) else ((), (), ())
        fields = {
            "pos": pa.array([pos for items in links for pos in range(len(items))], type=pa.int32()),
            "tag": pa.array(tags, type=pa.string()),
            "attr": pa.array(attrs, type=pa.string()),
            "href": pa.array(hrefs, type=pa.string()),
        }
        keep = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(n) for n in keep),
                _lists(links, pa.StructArray.from_arrays(list(fields.values()), names=list(fields))),
                _lists(ids, pa.array([i for anchors in ids for i in anchors], type=pa.string())),
                pa.array(bases, type=pa.string()),
            ],
            names=[*keep, "links", "ids", "base_href"],
        )


def parse_docs(docs: DataFrame) -> DataFrame:
    """Replace ``text`` by what the markup holds.

    ``docs(…, kind, text)`` → ``(…, kind, links, ids, base_href)``. Only the
    columns given travel to Python, so select no more than is needed.
    """
    kept = [f for f in docs.schema.fields if f.name != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(_parse_batches, f"{ddl}, {PARSED_DDL}")


def link_rows(parsed: DataFrame) -> DataFrame:
    """One row per link: position in the document, element, attribute, href."""
    keep = [c for c in parsed.columns if c not in ("links", "ids")]
    return parsed.select(*keep, F.inline("links"))


def anchor_rows(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per distinct id of each document."""
    return parsed.select(*keys, F.explode("ids").alias("fragment"))


# Markdown links. Every repeated step is possessive, so a text is read once and no
# label or destination is too long.
CODE_START = re.compile(r"^ {0,3}(?P<fence>`{3,}|~{3,})[^\n]*\n|(?P<ticks>`+)", re.M)
TICKS = re.compile(r"`+")
LABEL = r"\[((?:[^\[\]\\\n]++|\\.|\[[^\[\]\n]*+\])*+)\]"
DESTINATION = r"(?:<([^<>\n]*)>|((?:[^\s()<]++|\([^\s()]*+\))*+))"
TITLE = r"(?:[ \t\n]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?"
LINK = re.compile(
    rf"(?P<mark>!?){LABEL}"
    rf"(?:\([ \t]*\n?[ \t]*{DESTINATION}{TITLE}[ \t]*\n?[ \t]*(?P<inline>\))|(?:\[(?P<ref>[^\[\]]*)\])?(?![\[(:]))"
    r"|<(?P<auto>[A-Za-z][A-Za-z0-9+.\-]{1,31}:[^\s<>]*)>",
    re.A | re.S,
)
DEFINITION = re.compile(r"^ {0,3}\[([^\[\]\n]+)\]:[ \t]*\n?[ \t]*(?:<([^<>\n]*)>|([^\s<]\S*))[^\n]*$", re.A | re.M)


def without_code(text: str) -> str:
    """Fenced blocks and code spans replaced by a space each.

    A span ends at the next run of as many back-ticks as it begins with; all runs
    are listed once, so openings without an end cost no further look at the text.
    """
    if "`" not in text and "~~~" not in text:
        return text
    runs: dict[int, list[int]] = {}
    for run in TICKS.finditer(text):
        runs.setdefault(run.end() - run.start(), []).append(run.start())
    parts, kept, at = [], 0, 0
    while start := CODE_START.search(text, at):
        fence, at = start["fence"], start.end()
        if fence:
            close = re.compile(rf"^ {{0,3}}{fence}[`~]*[ \t]*$", re.M).search(text, at)
            end = close.end() if close else len(text)
        else:
            same = runs[at - start.start()]
            following = bisect_left(same, at)
            if following == len(same):
                continue
            end = same[following] + at - start.start()
        parts += [text[kept : start.start()], " "]
        kept = at = end
    return "".join([*parts, text[kept:]])


def note_links(text: str) -> list[tuple[str | None, bool]]:
    """Destination (null where a reference is undefined) and whether it is an image, in order."""
    text = without_code(text)
    if "[" not in text and "<" not in text:
        return []

    def name(label: str) -> str:
        return re.sub(r"\s+", " ", label.strip(" "), flags=re.A).lower()

    known: dict[str, str] = {}
    for label, pointed, plain in DEFINITION.findall(text):
        known.setdefault(name(label), pointed or plain)
    found: list[tuple[str | None, bool]] = []
    for link in LINK.finditer(DEFINITION.sub("", text)):
        if link["auto"] is not None:
            dest = link["auto"]
        elif link["inline"]:
            dest = (link[3] or "") + (link[4] or "")
        else:
            dest = known.get(name(link["ref"] or link[2]))
        found.append((dest, link["mark"] == "!"))
    return found


def _note_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (piece for whole in batches for piece in pieces(whole, "text")):
        rows = [note_links(text.as_py() or "") for text in batch.column("text")]
        flat = [link for links in rows for link in links]
        fields = {
            "pos": pa.array([pos for links in rows for pos in range(len(links))], type=pa.int32()),
            "dest": pa.array([dest for dest, _ in flat], type=pa.string()),
            "is_image": pa.array([image for _, image in flat], type=pa.bool_()),
        }
        keep = [n for n in batch.schema.names if n != "text"]
        links = _lists(rows, pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), links], names=[*keep, "links"])


def note_link_rows(notes: DataFrame) -> DataFrame:
    """Markdown links and images: ``(…, pos, dest, is_image)``.

    Inline links, full and short reference links and autolinks; code is skipped.
    Each note crosses to Python once, in Arrow batches.
    """
    kept = [f for f in notes.schema.fields if f.name != "text"]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    parsed = notes.select(*[f.name for f in kept], "text").mapInArrow(
        _note_batches, f"{ddl}, links array<struct<pos:int,dest:string,is_image:boolean>>"
    )
    return parsed.select(*[f.name for f in kept], F.inline("links")).filter(F.col("dest").isNotNull())
