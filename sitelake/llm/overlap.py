"""Texts that share most of their shingles: SimHash groups first, then an exact search by rare shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.llm import simhash
from sitelake.llm.components import components
from sitelake.session import stage

SHINGLE = 5
#: Jaccard similarity of the shingle sets from which texts are linked.
SIMILARITY = 0.8
#: Of two texts with similarity s a band agrees with chance s**ROWS; at 0.8 all
#: bands differ for 7 pairs in a million.
BANDS, ROWS = 30, 5
#: Shingles that are hashed at once.
BLOCK = 256

_draw = np.random.default_rng(17)
_MASK = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_ODD = _draw.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# --- sets -------------------------------------------------------------------


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, shingle))


def set_key(hashes: np.ndarray, seed: int = 0) -> int:
    """One number for a set, as a signed long; the empty set has zero."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), seed)).view(np.int64)) if len(hashes) else 0


def band_keys(hashes: np.ndarray) -> list[int]:
    """The bands of a set's min-hashes as signed longs; the empty set has none."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), BLOCK):
        np.minimum(least, ((hashes[at : at + BLOCK] ^ _MASK) * _ODD).min(axis=1), out=least)
    raw, size = least.tobytes(), ROWS * 8
    keys = [xxhash.xxh64_intdigest(raw[i * size : (i + 1) * size], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _signed(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``row, at, key, other, fp, bands``: the set of every row's text, known by two hashes."""

    def sign(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            hashes = simhash.shingle_hashes(t, shingle)
            own = np.unique(hashes)
            print_ = int(np.uint64(simhash.fingerprint(hashes)).view(np.int64))
            out.append((set_key(own), set_key(own, 1), print_, band_keys(own)))
        return pd.DataFrame(out, columns=["key", "other", "fp", "bands"])

    signed = F.pandas_udf(sign, "key long, other long, fp long, bands array<long>")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.monotonically_increasing_id().alias("at"), signed(F.col(f"`{text}`")).alias("sign"))
    return rows.select("row", "at", "sign.*")


def _shingles(texts: DataFrame, shingle: int) -> DataFrame:
    """``set, n, hashes`` of ``set, text``; hashes are sorted 64-bit numbers in a row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = [shingle_set(t, shingle) for t in frame["text"]]
            yield pd.DataFrame(
                {"set": frame["set"], "n": [len(s) for s in sets], "hashes": [s.tobytes() for s in sets]}
            )

    return texts.mapInPandas(run, "set long, n int, hashes binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``a, b`` pairs of sets that are similar enough."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = [
                jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= similarity
                for x, y in zip(frame["left"], frame["right"], strict=True)
            ]
            yield frame.loc[good, ["a", "b"]]

    left = sets.select(F.col("set").alias("a"), F.col("hashes").alias("left"))
    right = sets.select(F.col("set").alias("b"), F.col("hashes").alias("right"))
    return pairs.join(left, "a").join(right, "b").mapInPandas(run, "a long, b long")


# --- the searches -----------------------------------------------------------


def _print_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """Every set with the representative of its SimHash group: as many pairs as sets at most.

    Groups are what links of fingerprints within ``radius`` bits reach, found by
    vantage-point trees.
    """
    prints = stage(sets.select("fp").distinct(), "overlap-prints")
    groups = components(simhash.linked_pairs(prints, radius))
    placed = sets.join(groups, F.col("fp") == F.col("node"), "left").select("set", F.coalesce("component", "fp").alias("_g"))
    placed = stage(placed, "overlap-placed")
    least = placed.groupBy("_g").agg(F.min("set").alias("a"))
    return placed.join(least, "_g").filter("a != set").select("a", F.col("set").alias("b"))


def _in_component(frame: DataFrame, links: DataFrame) -> DataFrame:
    """``frame`` with the component of its ``set``, the set itself where nothing links it."""
    groups = components(links)
    found = frame.join(groups, F.col("set") == F.col("node"), "left")
    return found.withColumn("comp", F.coalesce("component", "set")).drop("node", "component")


def _needed(n: Column, m: Column, similarity: float) -> Column:
    """Shingles that sets of these sizes have in common, at least, if they are similar."""
    return F.lit(similarity / (1 + similarity)) * (n + m) - 1e-6


def _prefixes(tokens: DataFrame, similarity: float) -> DataFrame:
    """``token, set, n, comp, pos``: the rarest shingles of every set, one of which it
    must share with each similar set.

    Shingles are in order of their number of sets. Of those at place ``pos`` and
    after, two similar sets share as many as they need in common, so the first one
    shared comes early. Shingles of one set only come first and lead nowhere.
    """
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = tokens.join(counts, "token")
    order = Window.partitionBy("set").orderBy("df", "token")
    every = Window.partitionBy("set")
    placed = shared.withColumn("_at", F.row_number().over(order)).withColumn("_shared", F.count(F.lit(1)).over(every))
    placed = placed.withColumn("pos", F.col("n") - F.col("_shared") + F.col("_at") - 1)
    last = F.col("n") - F.lit(similarity) * F.col("n") + 1e-6
    return placed.filter(F.col("pos") <= last).select("token", "set", "n", "comp", "pos")


def _mixed(rare: DataFrame) -> DataFrame:
    """Rows of shingles that stand in prefixes of more than one component."""
    spread = rare.groupBy("token").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo != _hi")
    return rare.join(spread.select("token"), "token")


def _may_match(x: dict[str, Column], y: dict[str, Column], similarity: float) -> Column:
    """Whether two sets that first share this shingle can be similar and still need to be compared."""
    least = _needed(x["n"], y["n"], similarity)
    return (x["comp"] != y["comp"]) & (x["n"] - x["pos"] >= least) & (y["n"] - y["pos"] >= least)


def _rare_pairs(sets: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """More links: of all similar sets in different components, exactly.

    First every set meets the one in which a rare shingle comes earliest, which is
    linear and unites large groups of near copies; only sets that are then still in
    different components meet each other.
    """

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for own, n, hashes, comp in frame.itertuples(index=False):
                yield pd.DataFrame({"token": np.frombuffer(hashes, np.int64), "set": own, "n": n, "comp": comp})

    with_comp = _in_component(sets, links).select("set", "n", "hashes", "comp")
    tokens = with_comp.mapInPandas(listed, "token long, set long, n int, comp long")
    rare = stage(_mixed(stage(_prefixes(tokens, similarity), "overlap-prefixes")), "overlap-rare")
    columns = ("set", "n", "comp", "pos")
    hubs = rare.groupBy("token").agg(F.min(F.struct("pos", "n", "set", "comp")).alias("hub"))
    x = {c: F.col(f"hub.{c}") for c in columns}
    y = {c: F.col(c) for c in columns}
    met = rare.join(hubs, "token").filter(_may_match(x, y, similarity))
    first = stage(met.select(F.least("hub.set", "set").alias("a"), F.greatest("hub.set", "set").alias("b")).distinct(), "overlap-hubs")
    more = stage(_confirmed(first, sets, similarity), "overlap-united")
    rare = stage(_in_component(rare.drop("comp"), links.union(more)), "overlap-apart")
    rare = stage(_mixed(rare), "overlap-mixed")
    one, two = (rare.select("token", F.struct(*columns).alias(name)) for name in ("x", "y"))
    x, y = ({c: F.col(f"{name}.{c}") for c in columns} for name in ("x", "y"))
    ordered = F.struct("x.n", "x.set") < F.struct("y.n", "y.set")
    rest = one.join(two, [one["token"] == two["token"], ordered, _may_match(x, y, similarity)])
    rest = rest.select(F.least("x.set", "y.set").alias("a"), F.greatest("x.set", "y.set").alias("b")).distinct()
    rest = stage(rest.join(first, ["a", "b"], "left_anti"), "overlap-rest")
    return more.union(_confirmed(rest, sets, similarity))


def _links(sets: DataFrame, texts: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """``a``-``b`` edges that join all similar sets which agree in a band."""
    bands = sets.select("set", F.explode("bands").alias("band"))
    hubs = bands.groupBy("band").agg(F.min("set").alias("hub"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = stage(bands.join(hubs, "band").select("band", "set", "hub"), "overlap-bands")
    banded = shared.filter("set != hub").select(F.col("hub").alias("a"), F.col("set").alias("b"))
    first = stage(_print_pairs(sets, radius).union(banded).distinct(), "overlap-pairs")
    # Written out: by its true size it goes to the texts, or texts and ids are shuffled.
    ends = stage(first.select("a").union(first.select("b")).distinct().withColumnRenamed("a", "set"), "overlap-ends")
    held = stage(_shingles(texts.join(ends, "set"), shingle), "overlap-sets")
    found = stage(_confirmed(first, held, similarity), "overlap-links")
    # Only sets that share a band with another component are searched further.
    apart = stage(_in_component(shared.select("band", "set"), found), "overlap-groups")
    mixed = apart.groupBy("band").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).filter("_lo != _hi")
    open_ = apart.join(mixed.select("band"), "band").select("set").distinct()
    open_sets = stage(held.join(open_, "set"), "overlap-open")
    return found.union(_rare_pairs(open_sets, found, similarity))


def drop_near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: float = SIMILARITY,
    radius: int = simhash.RADIUS,
) -> DataFrame:
    """One row of each group of near duplicates, with all its columns.

    Texts are linked whose sets of ``shingle``-word runs (A-Z in lower case) have at
    least ``similarity`` in common; groups are what links reach. Fingerprints within
    ``radius`` bits, found by vantage-point trees, and min-hash bands propose pairs of
    each set with one other; sets in mixed bands then meet by their rare shingles.
    Every link is confirmed on the sets.

    Null texts and texts without words have the empty set and are one group; texts of
    any length are read whole; copies and other repeated rows share a set and are
    searched once; a set is known by 128 bits. The row with the smallest id stays, ids
    before nulls, then by hashes of its text. Rows are told apart by place, so ids may
    repeat or be null. Columns of any name are carried; an empty table gives no rows.
    """
    rows = stage(_signed(docs, text, shingle), "overlap")
    sets = rows.groupBy("key", "other").agg(F.min("at").alias("set"), F.first("bands").alias("bands"), F.first("fp").alias("fp"))
    sets = stage(sets, "overlap-keys")
    words = F.col("row").getField(text)
    texts = rows.select(F.col("at").alias("set"), words.alias("text"))
    links = stage(_links(sets, texts, shingle, similarity, radius), "overlap-all")
    groups = stage(_in_component(sets.select("key", "other", "set"), links), "overlap-components")
    own = F.col("row").getField(doc_id)
    order = F.struct(own.isNull(), own, "key", F.xxhash64(words), "at").alias("order")
    placed = stage(rows.select("key", "other", order).join(groups, ["key", "other"]).select("comp", "order"), "overlap-order")
    kept = placed.groupBy("comp").agg(F.min("order").getField("at").alias("at"))
    # The rows that go are fewer than those that stay.
    gone = stage(placed.select("order.at").join(kept, "at", "left_anti"), "overlap-gone")
    return rows.join(gone, "at", "left_anti").select("row.*")
