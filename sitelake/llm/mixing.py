"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sitelake.llm.words import word_count
from sitelake.operators.ordering import ranked
from sitelake.session import stage

#: Sources in code-point order (null last) weigh these, over and over.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hexadecimal digits of a document's key that name its bucket.
BUCKET_DIGITS = 3


@dataclass
class Mix:
    """Documents with their sizes and keys, and one row per source with its share."""

    sized: DataFrame
    sources: DataFrame

    def copies(self) -> DataFrame:
        """``sized`` with ``_source_size``, ``_target`` and ``_copies``."""
        plan = self.sources.withColumnRenamed("_source", "_of")
        taken = F.col("_whole") + F.when(F.col("_key") <= F.col("_cut"), 1).otherwise(0)
        taken = F.when(F.col("_size") > 0, taken).otherwise(0)
        return (
            self.sized.join(plan, F.col("_source").eqNullSafe(F.col("_of")))
            .withColumn("_copies", taken.cast("long"))
            .drop("_of", "_whole", "_cut", "_weight", "_source")
        )


def fill(sources: DataFrame, max_epochs: int = MAX_EPOCHS) -> float:
    """The level at which targets of ``min(cap, level * weight)`` use all words.

    A source whose share exceeds its cap is clamped there, and what it leaves is
    shared by weight among the others, until none exceeds its cap. Each turn is
    one aggregate over the sources; the level only rises, so turns end.
    """
    cap = F.col("_source_size") * max_epochs
    total = sources.agg(F.sum("_source_size"), F.sum("_weight")).first()
    if not total[0]:
        return 0.0
    level, clamped = float(total[0]) / float(total[1]), -1
    while True:
        over = cap.cast("double") < F.lit(level) * F.col("_weight")
        row = sources.agg(
            F.count_if(over).alias("n"),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0)).alias("open"),
        ).first()
        if row.n == clamped or not row.open:
            return level
        level, clamped = float(total[0] - row.held) / float(row.open), row.n


def _cuts(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source the last key that gets one more copy.

    Keys are hashes, so "all keys up to a cut" is a seeded sample. Sums per bucket
    of keys find the bucket of the cut; only that bucket is read key by key. No
    task ever sorts a whole source.
    """
    bucket = F.substring("_key", 1, BUCKET_DIGITS)
    sums = sized.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("_size").alias("_words"))
    by_bucket = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    need = sources.select(
        F.col("_source").alias("_of"),
        (F.col("_target") - F.col("_whole") * F.col("_source_size")).alias("_need"),
    )
    edge = (
        sums.withColumn("_before", F.coalesce(F.sum("_words").over(by_bucket), F.lit(0)))
        .join(need, F.col("_source").eqNullSafe(F.col("_of")))
        .filter("_before <= _need AND _need < _before + _words")
        .select("_of", F.col("_bucket").alias("_at"), "_before", "_need")
    )
    within = Window.partitionBy("_of").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    keys = (
        sized.join(edge, F.col("_source").eqNullSafe(F.col("_of")) & (bucket == F.col("_at")))
        .groupBy("_of", "_at", "_before", "_need", "_key")
        .agg(F.sum("_size").alias("_words"))
        .withColumn("_start", F.col("_before") + F.coalesce(F.sum("_words").over(within), F.lit(0)))
        .filter("_start + _words / 2 <= _need")
    )
    last = keys.groupBy("_of").agg(F.max("_key").alias("_cut"))
    # Nothing of the bucket fits: the cut lies at its lower end.
    return edge.select(F.col("_of").alias("_s"), "_at").join(
        last, F.col("_s").eqNullSafe(F.col("_of")), "left"
    ).select("_s", F.coalesce("_cut", "_at").alias("_cut"))


def document_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A seeded hash of a document; only rows that repeat in full share it."""
    blank = F.lit("")
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), blank), F.lit(":"), F.coalesce(text, blank)))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
) -> Mix:
    """Decide how often each document enters a mix of its sources.

    Targets share the words of all documents by weight, none above ``max_epochs``
    times its source. Whole repetitions go to every document of a source, the
    rest to the documents with the smallest seeded keys, so that a source misses
    its target by half a document at most.

    Null and empty texts have size 0 and are taken with 0 words; a null source is
    a source of its own, the last; rows that repeat in full are taken alike; an
    empty table gives an empty mix; other columns do not matter.
    """
    sized = stage(
        docs.select(
            F.col(doc_id).alias("_id"),
            F.col(source).alias("_source"),
            word_count(F.col(text)).alias("_size"),
            document_key(F.col(doc_id), F.col(text), seed).alias("_key"),
        ),
        "mix-sizes",
    )
    sums = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    place = ranked(sums, [], [F.asc_nulls_last("_source")], "_place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    sources = stage(place.select("_source", "_source_size", weight.cast("long").alias("_weight")), "mix-sources")
    level = fill(sources, max_epochs)
    cap = (F.col("_source_size") * max_epochs).cast("double")
    share = F.lit(level) * F.col("_weight")
    sources = sources.withColumn("_target", F.when(cap < share, cap).otherwise(share)).withColumn(
        "_whole",
        F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0)),
    )
    cuts = _cuts(sized, sources)
    plan = sources.join(cuts, F.col("_source").eqNullSafe(F.col("_s")), "left").drop("_s")
    return Mix(sized, stage(plan, "mix-plan"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its columns.

    Documents of size 0 add no words and leave.
    """
    names = {k: options.get(k, k) for k in ("doc_id", "text", "source")}
    seed = options.get("seed", SEED)
    plan = mix(docs, **options).sources.select(
        F.col("_source").alias("_mix_source"), F.col("_whole").alias("_mix_whole"), F.col("_cut").alias("_mix_cut")
    )
    key = document_key(F.col(names["doc_id"]), F.col(names["text"]), seed)
    copies = F.col("_mix_whole") + F.when(key <= F.col("_mix_cut"), 1).otherwise(0)
    copies = F.when(F.length(F.regexp_replace(names["text"], r"[\x20\x09-\x0D]", "")) > 0, copies).otherwise(0)
    return (
        docs.join(plan, F.col(names["source"]).eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
        .select(*docs.columns)
    )
