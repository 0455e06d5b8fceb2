"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.session import new_folder


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node of ``a``-``b`` edges.

    Each step hangs the neighbours of a node on the smallest of them, so every
    component becomes a star after a logarithmic number of rounds. Minima are
    partial aggregates and edges stay single rows, so a hub of any degree is
    never gathered; each round starts from a written table. Edges with a null
    end or with equal ends link nothing and are dropped; no edges give no rows.
    """
    spark = edges.sparkSession
    folder = new_folder(spark, "components")
    a, b = F.col("a"), F.col("b")

    def written(frame: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        path = f"{folder}/{name}"
        frame.filter(a != b).distinct().write.parquet(path)
        back = spark.read.schema(edges.select("a", "b").schema).parquet(path)
        state = back.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return back, tuple(state)

    now, state = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "0")
    turn = 0
    while state[0]:
        both = now.select("a", "b").union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("_m")).withColumn("_m", F.least("a", "_m"))
        large = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("_m").alias("b")).filter(a != b).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("_m"))
        hung = large.join(root, "a").filter("b != _m").select(b.alias("a"), F.col("_m").alias("b"))
        turn += 1
        now, after = written(hung.union(root.select("a", F.col("_m").alias("b"))), str(turn))
        if after == state:
            break
        state = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(a.alias("node"), b.alias("component")).union(roots)
