"""Slugs of notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelake.functions.paths import ascii_lower


def normalize_slug(text: Column) -> Column:
    """Lower case, every run of other characters one hyphen, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def article_slug(name: Column) -> Column:
    """Slug of a note's file name, without its source suffix."""
    return normalize_slug(
        F.regexp_replace(F.lower(name), r"(?:_grokipedia|_wikipedia)?\.md$", "")
    )


def source_rank(name: Column) -> Column:
    """2 and 1 for the two known sources, best first; 0 for any other note."""
    low = ascii_lower(name)
    return (
        F.when(low.endswith("_grokipedia.md"), F.lit(2))
        .when(low.endswith("_wikipedia.md"), F.lit(1))
        .otherwise(F.lit(0))
    )
