"""Paths, names and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelake.constants import (
    DEFAULT_MEDIA_TYPE,
    MEDIA_TYPES,
    TEXT_EXTENSIONS,
    WHITE_SPACE,
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
HIDDEN_NAME = r"^(?:__MACOSX$|\.)"


def trim_ws(text: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def nfc(text: Column) -> Column:
    """Canonical composition. Pure ASCII values never reach the normalizer."""
    composed = F.reflect(
        F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False)
    )
    return F.when(text.isNull() | text.rlike(r"^\p{ASCII}*$"), text).otherwise(composed)


def fold_key(path: Column) -> Column:
    """Key under which two names are the same file: NFC, then ASCII lower case.

    Put it in a column of its own before joining or grouping on it: the
    normalizer call counts as non-deterministic for the optimizer.
    """
    return ascii_lower(nfc(path))


def percent_decode(text: Column) -> Column:
    """Decode %XX, leaving stray percent signs and plus signs as they are."""
    escaped = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.try_url_decode(F.replace(escaped, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(text, F.lit("%")), decoded).otherwise(text)


def percent_encode(text: Column) -> Column:
    """Encode everything but letters, digits and ``-_.~``."""
    return F.replace(
        F.replace(
            F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")),
            F.lit("*"),
            F.lit("%2A"),
        ),
        F.lit("%7E"),
        F.lit("~"),
    )


def percent_encode_path(path: Column) -> Column:
    return F.array_join(F.transform(F.split(path, "/"), percent_encode), "/")


def query_param(query: Column, key: str) -> Column:
    """First value of ``key`` in a query string, decoded; null when absent."""
    pairs = F.filter(
        F.split(query, "&"),
        lambda pair: percent_decode(F.substring_index(pair, "=", 1)) == F.lit(key),
    )
    first = F.try_element_at(pairs, F.lit(1))
    value = F.when(F.contains(first, F.lit("=")), F.regexp_extract(first, "(?s)^[^=]*=(.*)$", 1))
    return F.when(
        first.isNotNull(),
        percent_decode(F.replace(F.coalesce(value, F.lit("")), F.lit("+"), F.lit(" "))),
    )


def cut_query(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^[^?#]*", 0)


def bare_uri(uri: Column) -> Column:
    """An archive's target URI without blanks and angle brackets."""
    return F.btrim(trim_ws(uri), F.lit("<>"))


def is_http(uri: Column) -> Column:
    return bare_uri(uri).rlike(r"(?is)^https?://")


def origin_of(uri: Column) -> Column:
    """``scheme://host`` with a lower-case scheme; null unless http(s)."""
    bare = bare_uri(uri)
    scheme = F.lower(F.regexp_extract(bare, r"(?i)^(https?)://", 1))
    host = F.regexp_extract(bare, r"(?is)^https?://([^/]*)", 1)
    return F.when(
        bare.rlike(r"(?is)^https?://[^/]"), F.concat(scheme, F.lit("://"), host)
    )


def url_to_rel(uri: Column, as_html: Column, decode: bool = False) -> Column:
    """Site path of an archived URL; null when the URL climbs with ``..``."""
    bare = bare_uri(uri)
    after_scheme = F.regexp_extract(bare, r"(?s)^.*?://[^/]*/?(.*)$", 1)
    full = F.when(F.contains(bare, F.lit("://")), after_scheme).otherwise(
        F.ltrim(bare, F.lit("/"))
    )
    path = cut_query(full)
    if decode:
        path = percent_decode(path)
    parts = F.filter(F.split(path, "/"), lambda part: part != "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    joined = F.array_join(parts, "/")
    in_figures = F.lower(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))) == "figures"
    folder = path.endswith("/") | (as_html & ~F.contains(last, F.lit(".")))
    return (
        F.when(path == "", F.lit("index.html"))
        .when(F.array_contains(parts, ".."), F.lit(None).cast("string"))
        .when(in_figures, F.concat(F.lit("figures/"), last))
        .when(folder, F.concat(joined, F.lit("/index.html")))
        .otherwise(joined)
    )


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_of(path: Column) -> Column:
    """Folder of a path, empty at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case extension, empty when the name has no dot."""
    return ascii_lower(F.regexp_extract(file_name(path), r"(?s)\.([^.]*)\z", 1))


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is no extension."""
    return F.regexp_replace(file_name(path), r"(?s)(?<=.)\.[^.]*\z", "")


def doc_kind(path: Column) -> Column:
    """``html`` or ``css`` for files whose links are followed, else null."""
    ext = extension(path)
    return F.when(ext.isin("html", "htm", "xhtml", "shtml"), F.lit("html")).when(
        ext == "css", F.lit("css")
    )


def is_rewritable(path: Column) -> Column:
    return extension(path).isin("html", "htm", "css")


def is_markdown(name: Column) -> Column:
    return name.rlike(r"(?is)[^/]\.md$")


def is_hidden(name: Column) -> Column:
    return name.rlike(HIDDEN_NAME)


def is_visible_path(path: Column) -> Column:
    """No segment of the path is hidden."""
    return ~path.rlike(r"(?:^|/)(?:__MACOSX(?:/|$)|\.)")


def normalize_member(name: Column) -> Column:
    """Clean archive member name; null when it is unsafe or empty."""
    clean = F.btrim(F.translate(name, "\\", "/"), F.lit("/"))
    bad = (
        F.contains(name, F.lit("\x00"))
        | (clean == "")
        | clean.rlike(r"(?:^|/)(?:\.{0,2})(?:/|\z)")
    )
    return F.when(~bad, clean)


def is_dir_member(name: Column) -> Column:
    return name.rlike(r"[/\\]$")


def safe_request_path(url: Column) -> Column:
    """Decoded path of a request; null when it is refused."""
    rel = F.btrim(percent_decode(cut_query(url)), F.lit("/"))
    bad = F.contains(rel, F.lit("\\")) | rel.rlike(r"(?:^|/)(?:\.{0,2})(?:/|\z)")
    return F.when((rel == "") | ~bad, rel)


def is_html_type(content_type: Column) -> Column:
    return F.coalesce(content_type, F.lit("")).rlike(r"(?i)text/html|application/xhtml")


def content_type(path: Column) -> Column:
    """Media type by extension, with a charset for text."""
    table = F.create_map(*[F.lit(v) for pair in MEDIA_TYPES.items() for v in pair])
    ext = extension(path)
    essence = F.coalesce(F.try_element_at(table, ext), F.lit(DEFAULT_MEDIA_TYPE))
    textual = (
        essence.startswith("text/")
        | essence.isin("application/javascript", "application/json", "application/xml")
        | essence.endswith("+xml")
        | ext.isin(*TEXT_EXTENSIONS)
    )
    return F.when(textual, F.concat(essence, F.lit("; charset=utf-8"))).otherwise(essence)


def note_link_allowed(dest: Column) -> Column:
    """Targets a rendered note may keep: relative ones and http(s)."""
    bare = trim_ws(dest)
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    return (bare == "") | bare.startswith("#") | (
        ~bare.startswith("//") & scheme.isin("", "http", "https")
    )


def answer_link(dest: Column) -> Column:
    """Targets a model answer may keep: plain http(s) URLs; others become ``#``."""
    bare = trim_ws(dest)
    good = bare.rlike(r"(?i)^https?://") & ~bare.rlike(r"[\p{IsWhite_Space}\p{Cc}]")
    return F.when(good, bare).otherwise(F.lit("#"))
