"""SimHash near-duplicates: exact pairs within a Hamming radius by vantage-point trees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.llm.batches import by_size
from sitelake.llm.components import components
from sitelake.session import stage

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
#: Fingerprints that a shard of the tree holds, about.
SHARD = 4000
#: Fingerprints that the vantage points of the upper tree are chosen from.
SAMPLE = 4000
#: Below this many, fingerprints are compared directly.
LEAF = 256


# --- fingerprints -----------------------------------------------------------


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``shingle`` words, A-Z in lower case, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([hashed(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    view = memoryview(joined)
    runs = zip(starts, ends[shingle - 1 :].tolist(), strict=False)
    return np.fromiter((hashed(view[a:b], seed) for a, b in runs), np.uint64, len(words) - shingle + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Each bit that more than half of the hashes have; none give zero."""
    if not len(hashes):
        return 0
    total = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 65536 + 1):
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    chosen = np.flatnonzero(2 * total > len(hashes))
    return int(sum(1 << int(i) for i in chosen))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row; ``fp`` is the fingerprint as a signed long."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in by_size(frames, "_text"):
            prints = np.array([fingerprint(shingle_hashes(t, shingle)) for t in part["_text"]], np.uint64)
            yield pd.DataFrame({"doc_id": part["_id"], "fp": prints.view(np.int64)})

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).mapInPandas(run, f"doc_id {kind}, fp long")


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# --- the tree ---------------------------------------------------------------


def distance(points: np.ndarray, vantage: int | np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(vantage))


@dataclass
class Node:
    """Points within ``radius`` of ``vantage`` are inside, all others outside."""

    vantage: int
    radius: int
    inside: "Node | int"
    outside: "Node | int"


def split_point(points: np.ndarray, draw: np.random.Generator) -> tuple[int, int] | None:
    """The vantage point, of a few, whose median shell leaves the fewest near the border."""
    best = None
    for vantage in draw.choice(points, min(8, len(points)), replace=False):
        far = distance(points, vantage)
        radius = int(np.median(far))
        inner = int((far <= radius).sum())
        if not 0 < inner < len(points):
            radius -= 1
            inner = int((far <= radius).sum())
            if not 0 < inner < len(points):
                continue
        near = int((np.abs(far.astype(int) - radius) <= RADIUS).sum())
        cost = near + abs(2 * inner - len(points))
        if best is None or cost < best[0]:
            best = (cost, int(vantage), radius)
    return best and best[1:]


def grow(sample: np.ndarray, shards: int, seed: int = 1) -> tuple[Node | int, int]:
    """An upper tree of about ``shards`` leaves, numbered from 0, from a sample."""
    draw = np.random.default_rng(seed)
    leaves = 0

    def build(points: np.ndarray, want: int) -> Node | int:
        nonlocal leaves
        at = split_point(points, draw) if want > 1 and len(points) > 1 else None
        if at is None:
            leaves += 1
            return leaves - 1
        inner = distance(points, at[0]) <= at[1]
        share = max(1, min(want - 1, round(want * inner.mean())))
        return Node(at[0], at[1], build(points[inner], share), build(points[~inner], want - share))

    return build(sample, shards), leaves


def place(tree: Node | int, points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where points go: (index, leaf, home), home being the leaf that owns the point.

    A point visits both sides of a border that it is within ``radius`` of: by the
    triangle inequality every neighbour lies in a leaf that it visits. Of a pair
    that a border parts, the inner point never has to cross it, as the outer one
    comes to it.
    """
    index, leaf, home = [], [], []

    def go(node: Node | int, at: np.ndarray, own: np.ndarray) -> None:
        if not len(at):
            return
        if isinstance(node, int):
            index.append(at)
            leaf.append(np.full(len(at), node))
            home.append(own)
            return
        far = distance(points[at], node.vantage).astype(int)
        inner = far <= node.radius
        enters = far <= node.radius + radius
        go(node.inside, at[enters], own[enters] & inner[enters])
        # Visitors keep both ways open; owners go out only from the outside.
        leaves = ~inner | (~own & (far > node.radius - radius))
        go(node.outside, at[leaves], own[leaves] & ~inner[leaves])

    go(tree, np.arange(len(points)), np.ones(len(points), bool))
    none = np.zeros(0, np.int64)
    return (
        np.concatenate([none, *index]),
        np.concatenate([none, *leaf]),
        np.concatenate([none.astype(bool), *home]),
    )


class Links:
    """Union-find over the points of one shard."""

    def __init__(self, size: int):
        self.parent = np.arange(size)

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            a, b = self.root(a), self.root(b)
            if a != b:
                self.parent[max(a, b)] = min(a, b)


def link(points: np.ndarray, owned: np.ndarray, radius: int, links: Links, seed: int = 2) -> None:
    """Join every owned point with all points of the shard within ``radius``.

    A vantage-point tree again, down to small leaves that are compared directly.
    """
    draw = np.random.default_rng(seed)
    todo = [(np.flatnonzero(owned), np.arange(len(points)))]
    while todo:
        mine, seen = todo.pop()
        if not len(mine):
            continue
        at = split_point(points[mine], draw) if len(mine) > LEAF else None
        if at is None:
            for block in np.array_split(mine, len(mine) * len(seen) // 4_000_000 + 1):
                near = np.bitwise_count(points[block][:, None] ^ points[seen][None, :]) <= radius
                i, j = np.nonzero(near)
                left, right = block[i], seen[j]
                apart = links.roots()
                new = apart[left] != apart[right]
                links.join(left[new], right[new])
            continue
        my, far = (distance(points[x], at[0]).astype(int) for x in (mine, seen))
        todo.append((mine[my <= at[1]], seen[far <= at[1] + radius]))
        todo.append((mine[my > at[1]], seen[far > at[1] - radius]))


# --- the operator -----------------------------------------------------------


def linked_pairs(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """``a``-``b`` edges that join all fingerprints linked within ``radius``.

    ``prints`` holds distinct longs in ``fp``. The upper tree, from a sample of
    fixed size, names a home shard for each of them and the shards that border on
    it within the radius; shards above twice the wanted size are searched by
    several tasks, each for its own part of the owned points. A shard gives back a
    spanning forest of its links: as many edges as points, however dense it is.
    """
    spark = prints.sparkSession
    size = prints.count()
    sample = prints.orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree, _ = grow(sample, max(1, -(-size // shard)))
    shared = spark.sparkContext.broadcast(tree)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            points = frame["fp"].to_numpy(np.int64)
            index, leaf, home = place(shared.value, points.view(np.uint64), radius)
            yield pd.DataFrame({"fp": points[index], "leaf": leaf, "own": home})

    visits = stage(prints.mapInPandas(visit, "fp long, leaf long, own boolean"), "simhash-visits")
    owners = visits.filter("own").groupBy("leaf").count()
    parts = owners.select(F.col("leaf").alias("_leaf"), F.ceil(F.col("count") / (2 * shard)).cast("int").alias("_parts"))
    spread = (
        visits.join(parts, F.col("leaf") == F.col("_leaf"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("own", F.col("own") & (F.pmod(F.xxhash64("fp"), F.col("_parts")) == F.col("part")))
        .select("fp", "leaf", "part", "own")
    )

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        # Sorted, so that the smaller of two fingerprints has the smaller place.
        frame = frame.sort_values("fp")
        points = frame["fp"].to_numpy(np.int64)
        links = Links(len(points))
        link(points.view(np.uint64), frame["own"].to_numpy(bool), radius, links)
        roots = links.roots()
        moved = roots != np.arange(len(points))
        return pd.DataFrame({"a": points[moved], "b": points[roots[moved]]})

    return spread.groupBy("leaf", "part").applyInPandas(search, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """``doc_id, fp, component_id`` of every row.

    Documents whose fingerprints differ in at most ``radius`` bits are linked, and
    ``component_id`` is the smallest id that links reach. Copies share a
    fingerprint and are searched once. Null texts and texts without words have the
    fingerprint zero, linked like any other; fewer words than a shingle are hashed
    as they are; repeated rows each come back; null ids never name a component
    unless all its ids are null; an empty table gives no rows; other columns are
    not carried.
    """
    rows = stage(fingerprints(docs, doc_id, text, shingle), "simhash")
    prints = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("_least")), "simhash-prints")
    groups = components(linked_pairs(prints.select("fp"), radius))
    of = prints.join(groups, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("_fp"), "_least", F.coalesce("component", "fp").alias("_group")
    )
    of = stage(of, "simhash-groups")
    least = of.groupBy("_group").agg(F.min("_least").alias("component_id"))
    named = of.join(least, "_group").select("_fp", "component_id")
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with all its columns.

    The row with the smallest id stays, ids before nulls, then by fingerprint and
    text hash. Rows are told apart by place, so ids may repeat or be null.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = stage(docs.select(row, F.monotonically_increasing_id().alias("at")), "simhash-rows")
    own, words = F.col("row").getField(doc_id), F.col("row").getField(text)
    groups = near_duplicates(rows.select("at", words.alias("text")), "at", "text")
    order = F.struct(own.isNull(), own, "fp", F.xxhash64(words), "at").alias("order")
    placed = rows.join(groups, F.col("at") == F.col("doc_id"))
    kept = placed.select("component_id", order).groupBy("component_id").agg(F.min("order").getField("at").alias("at"))
    return rows.join(kept.select("at"), "at", "left_semi").select("row.*")
