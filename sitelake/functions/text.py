"""Document text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelake.constants import DEFAULT_QUESTION, DOC_CHARS
from sitelake.functions.paths import file_name, stem, trim_ws

SCRIPT_OR_STYLE = (
    r"(?is)<(script|style)(?=[ \t\n\f\r>/]|\z).*?(?:</\1>|\z)"
)
FIGURE_URL = r"""https?://[^"' )<>?#]*?/Figures/([^"' )<>?#]*)"""


def clean_html(text: Column) -> Column:
    """Drop script and style elements, keep all other markup."""
    return F.regexp_replace(text, SCRIPT_OR_STYLE, "")


def note_title(text: Column, rel: Column) -> Column:
    """The first non-blank line when it is a level-one heading, else the stem."""
    first_line = trim_ws(
        F.regexp_extract(text, r"\A(?:[\p{IsWhite_Space}\x{FEFF}]*\n)?([^\n]*)", 1)
    )
    heading = trim_ws(F.regexp_extract(first_line, r"(?s)^\x{FEFF}*# (.*)$", 1))
    return F.coalesce(F.nullif(heading, F.lit("")), F.nullif(stem(rel), F.lit("")), file_name(rel))


def rewrite_origins(text: Column, origins: Column) -> Column:
    """Remove every ``scheme://host`` and ``//host`` of the site, longest first."""
    ordered = F.array_sort(
        origins,
        lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, F.lit(-1))
        .when(a > b, F.lit(1))
        .otherwise(F.lit(0)),
    )

    def without(acc: Column, origin: Column) -> Column:
        host = F.concat(F.lit("//"), F.regexp_extract(origin, r"(?s)://(.*)$", 1))
        return F.replace(F.replace(acc, origin, F.lit("")), host, F.lit(""))

    return F.aggregate(ordered, text, without)


def rewrite_figures(text: Column) -> Column:
    """Point remote figure URLs at the site's own figure folder."""
    return F.regexp_replace(text, FIGURE_URL, "figures/$1")


def cap_text(text: Column, limit: int = DOC_CHARS) -> Column:
    """First ``limit`` characters."""
    return F.left(text, F.lit(limit))


def is_cut(text: Column, limit: int = DOC_CHARS) -> Column:
    return F.char_length(text) > limit


def default_question(question: Column) -> Column:
    return F.coalesce(F.nullif(trim_ws(question), F.lit("")), F.lit(DEFAULT_QUESTION))
