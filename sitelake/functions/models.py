"""Model cards: how many tokens a model's context window holds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CARD = "struct<parameters:string,model_info:map<string,string>>"


def whole_number(text: Column) -> Column:
    """A JSON number as a whole count; null for fractions and other values."""
    value = text.try_cast("double")
    return F.when(
        text.rlike(r"^[0-9.eE+\-]+$") & (value > 0) & (value == F.floor(value)),
        F.coalesce(text.try_cast("bigint"), value.try_cast("bigint")),
    )


def context_window(card: Column) -> Column:
    """A positive ``num_ctx`` parameter, else the first positive context length."""
    parsed = F.from_json(card, CARD)
    pairs = F.regexp_extract_all(
        parsed["parameters"],
        F.lit(r"(?m)(?<!\S)num_ctx[ \t]+\+?([0-9]+)(?!\S)"),
        F.lit(1),
    )
    declared = F.try_element_at(
        F.filter(
            F.transform(pairs, lambda n: n.try_cast("bigint")), lambda n: n > 0
        ),
        F.lit(1),
    )
    lengths = F.array_sort(
        F.filter(
            F.transform(
                F.map_entries(parsed["model_info"]),
                lambda e: F.struct(e["key"].alias("key"), whole_number(e["value"]).alias("n")),
            ),
            lambda e: e["key"].endswith(".context_length") & (e["n"] > 0),
        )
    )
    return F.coalesce(declared, F.try_element_at(lengths, F.lit(1))["n"])
