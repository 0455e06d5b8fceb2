"""Document quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.words import SPACE, word_count
from sitelake.session import stage

#: About so many labelled documents of each label are learned from.
SAMPLE_PER_LABEL = 4000
#: Preferences drawn for each document of the rarer label.
PAIRS_PER_DOCUMENT = 10
#: The score that the chosen quantile gets.
CUT = 0.3
RIDGE = 1e-3
#: Steps of strength in which all labelled documents are counted.
BINS = 4096


def features(text: Column) -> list[Column]:
    """Numbers that describe a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.greatest(word_count(text), F.lit(1)).cast("double")
    different = F.size(F.array_distinct(F.split(F.trim(F.lower(text)), SPACE))).cast("double")
    lines = F.split(text, "\n")

    def share(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / size

    upper, symbols, digits = share(r"\p{Lu}"), share(r"[^\p{L}\p{N}\s.,]"), share(r"[0-9]")
    variety = F.least(different / words, F.lit(1.0))
    return [
        upper,
        F.log(upper + 0.003),
        symbols,
        F.log(symbols + 0.003),
        digits,
        variety,
        F.log(variety + 0.03),
        F.size(F.array_distinct(lines)) / F.size(lines),
        F.least(size / words, F.lit(40.0)),
        F.log(words),
    ]


@dataclass
class Ranker:
    """Weights of the features, and the score below which documents are rejected."""

    weights: list[float]
    shift: float

    def strength(self, text: Column) -> Column:
        total = F.lit(self.shift)
        for weight, feature in zip(self.weights, features(text), strict=True):
            total = total + F.lit(weight) * feature
        return total

    def score(self, text: Column) -> Column:
        return 1.0 / (1.0 + F.exp(-self.strength(text))) if self.weights else F.lit(0.5)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit_pairs(good: np.ndarray, bad: np.ndarray, pairs: int = PAIRS_PER_DOCUMENT, seed: int = 7) -> np.ndarray:
    """Bradley-Terry strengths, linear in the features.

    The chance that one document is preferred to another is the logistic of the
    difference of their strengths; Newton steps on the logistic loss of feature
    differences, with a small ridge.
    """
    draw = np.random.default_rng(seed)
    rare, other = (bad, good) if len(bad) <= len(good) else (good, bad)
    first = np.repeat(np.arange(len(rare)), pairs)
    second = draw.integers(0, len(other), len(first))
    difference = other[second] - rare[first] if rare is bad else rare[first] - other[second]
    weights = np.zeros(difference.shape[1])
    for _ in range(40):
        chance = _sigmoid(difference @ weights)
        slope = difference.T @ (1 - chance) / len(difference) - RIDGE * weights
        curve = (difference * (chance * (1 - chance))[:, None]).T @ difference / len(difference)
        step = np.linalg.solve(curve + RIDGE * np.eye(len(weights)), slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def best_cut(good: np.ndarray, bad: np.ndarray) -> int:
    """The bin from which documents are taken, so that the fewest are on the wrong side.

    ``good`` and ``bad`` count documents by bin of their strength; of a run of equally
    good bins the middle one is taken.
    """
    lost = np.concatenate([[0], np.cumsum(good)])
    kept = bad.sum() - np.concatenate([[0], np.cumsum(bad)])
    best = np.flatnonzero(lost + kept == (lost + kept).min())
    return int(best[len(best) // 2])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    per_label: int = SAMPLE_PER_LABEL,
) -> Ranker:
    """Learn from the labelled documents for which ``learn`` (over ``_id``) holds.

    The weights are learned from a sample: ids are drawn by their hash, so that about
    ``per_label`` of each label remain whatever the size of the table, and where drawn
    ids name more than twice as many documents, these are drawn by the hash of their
    text. Copies under one id teach once. The quantile where documents are parted is
    that of all labelled documents, counted by strength in ``BINS`` equal steps.
    Labels other than 0 and 1, null ids and documents without a label teach nothing; an
    id with both labels counts as both. Where one label is missing nothing can be
    ranked: all score 0.5.
    """
    marked = labels.select(F.col(doc_id).alias("_id"), F.col(quality).cast("int").alias("_label")).filter(
        F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & learn
    )
    marked = stage(marked.distinct(), "quality-labels")
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))

    def counts(frame: DataFrame) -> dict[int, int]:
        return {r["_label"]: r["count"] for r in frame.groupBy("_label").count().collect()}

    def share(count: dict[int, int], wanted: int) -> Column:
        return F.when(F.col("_label") == 1, min(1.0, wanted / count[1])).otherwise(min(1.0, wanted / count[0]))

    def place(*of: str) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / F.lit(float(1 << 30))

    ids = counts(marked)
    if len(ids) < 2:
        return Ranker([], 0.0)
    drawn = stage(marked.filter(place("_id") < share(ids, per_label)), "quality-drawn")
    found = counts(texts.select("_id").join(drawn, "_id"))
    if len(found) < 2:
        return Ranker([], 0.0)
    rows = (
        texts.join(drawn, "_id")
        .filter(place("_id", "_text") < share(found, 2 * per_label))
        .select("_id", "_label", *[f.alias(f"_{i}") for i, f in enumerate(features(F.col("_text")))])
        .distinct()
        .drop("_id")
        .toPandas()
    )
    label, x = rows["_label"].to_numpy(), rows.drop(columns="_label").to_numpy(float)
    if not (label == 1).any() or not (label == 0).any():
        return Ranker([], 0.0)
    scale = np.maximum(x.std(axis=0), 1e-9)
    weights = fit_pairs(x[label == 1] / scale, x[label == 0] / scale) / scale
    ranker = Ranker([float(w) for w in weights], 0.0)
    # Strengths outside the sample's range fall into the outer bins.
    strengths = x @ weights
    low = float(strengths.min())
    step = max(float(strengths.max()) - low, 1e-9) / BINS
    at = F.floor((ranker.strength(F.col("_text")) - low) / step)
    bins = texts.select("_id", F.least(F.greatest(at, F.lit(0)), F.lit(BINS - 1)).cast("int").alias("_bin"))
    counted = bins.join(marked, "_id").groupBy("_label", "_bin").count().toPandas()
    good, bad = (
        np.bincount(side["_bin"], weights=side["count"], minlength=BINS).astype(np.int64)
        for side in (counted[counted["_label"] == 1], counted[counted["_label"] == 0])
    )
    cut = low + best_cut(good, bad) * step
    return Ranker(ranker.weights, float(np.log(CUT / (1 - CUT)) - cut))


def scored(docs: DataFrame, ranker: Ranker, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row, from its whole text.

    Scores lie between 0 and 1; ``predicted`` is 1 from ``CUT`` on. Null and empty
    texts are scored as empty ones; repeated rows alike; an empty table gives no
    rows; other columns are not carried.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), ranker.score(F.col(text)).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))


def keep_good(docs: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """The documents that the ranker does not reject, with all their columns."""
    return docs.filter(ranker.score(F.col(text)) >= CUT)
