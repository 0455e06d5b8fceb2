"""Words as the operators of this package count them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whatever lies between spaces, tabs, line ends and form feeds.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def word_count(text: Column) -> Column:
    """Number of words; 0 where the text is null or empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)
