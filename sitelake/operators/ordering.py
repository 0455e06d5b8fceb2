"""Ranks over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.session import stage


def ranked(df: DataFrame, group: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    """1-based position of each row within its group.

    ``row_number() OVER (PARTITION BY group)`` sorts a whole group in one task;
    here a range shuffle over group and order spreads even a single huge group.
    Each sorted range then needs only the number of rows of its groups in the
    ranges before it, a table with one row per range and group. The order must
    be total for the ranks to be repeatable.
    """
    by_group = [F.col(g) for g in group]
    placed = (
        df.repartitionByRange(*by_group, *order)
        .sortWithinPartitions(*by_group, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_range", F.spark_partition_id())
    )
    placed = stage(placed, "ranked")
    sizes = placed.groupBy(*group, "_range").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        placed.join(offsets, [*group, "_range"])
        .withColumn(out, F.col("_id") - F.col("_first") + F.col("_before") + 1)
        .drop("_id", "_range", "_first", "_before")
    )


def natural_key(name: Column) -> list[Column]:
    """Sort columns for names by leading number, then text.

    Numbers of any length compare by value: first by their digits without
    leading zeros, then by those digits as text. Names without a leading number
    compare by text with all others, so they fall before or after the digits by
    their first character.
    """
    digits = F.regexp_extract(name, "^0*([0-9]*)", 1)
    place = F.when(name < "0", 0).when(name < ":", 1).otherwise(2)
    return [place, F.length(digits), digits, name]


def seed_pages(files: DataFrame, entry_names: list[str]) -> DataFrame:
    """Top-level pages of sites that have no entry page."""
    entries = files.filter(F.col("rel").isin(*entry_names)).select("site").distinct()
    pages = files.filter(~F.contains("rel", F.lit("/")) & F.col("rel").rlike(r"(?i)\.html\z"))
    return pages.join(entries, "site", "left_anti").select("site", "rel").distinct()
