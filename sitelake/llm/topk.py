"""Exact top-k inner products by a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.llm.vectors import best_rows, distinct_vectors, matrix
from sitelake.session import stage

PIVOTS = 24
#: Vectors that pivots are chosen from.
SAMPLE = 2000
#: Vectors of an annulus, and queries that are answered together.
BLOCK = 2048
QUERIES = 512


@dataclass
class Space:
    """Vectors lifted so that the largest inner product is the smallest distance.

    Each vector gets one more component that brings it to the length of the
    longest; queries get a zero. Then distance² = |q|² + longest² - 2 q·x, and the
    triangle inequality holds between all lifted vectors.
    """

    width: int
    longest: float
    pivots: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest - (x * x).sum(axis=1), 0))
        return np.hstack([x, rest[:, None]])

    def to_pivots(self, lifted: np.ndarray) -> np.ndarray:
        square = (lifted * lifted).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def slack(self) -> float:
        """More than rounding can move a distance by."""
        return 1e-6 * (1 + np.sqrt(self.longest))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Far-apart vectors: each new pivot is the one farthest from those before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def make_space(vectors: DataFrame, pivots: int = PIVOTS) -> Space | None:
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    row = vectors.agg(F.max(F.size("v")).alias("width"), F.max(square).alias("longest")).first()
    if row.width is None:
        return None
    drawn = vectors.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).toPandas()["v"]
    space = Space(row.width, row.longest, np.zeros((0, row.width + 1)))
    space.pivots = choose_pivots(space.lift(matrix(drawn, row.width)), pivots)
    return space


def _blocks(rows: DataFrame, shared, size: int, count: int, query: bool) -> DataFrame:
    """Rows in order of pivot and distance, packed into blocks of one pivot each.

    Query blocks may hold several pivots and keep every query's distances.
    """

    def key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = shared.value
        for frame in frames:
            lifted = space.lift(matrix(frame["v"], space.width))
            far = space.to_pivots(lifted)
            pivot = far.argmin(axis=1)
            packed = [x.tobytes() for x in np.ascontiguousarray(lifted[:, :-1])]
            yield pd.DataFrame(
                {"vec_id": frame["vec_id"], "pivot": pivot, "far": far[np.arange(len(far)), pivot], "x": packed}
            )

    keyed = rows.mapInPandas(key, "vec_id long, pivot int, far double, x binary")
    order = ["pivot", "far", "vec_id"]
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).coalesce(max(1, -(-count // size)))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            while len(rest) > size:
                yield pack(rest.iloc[:size])
                rest = rest.iloc[size:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield pack(rest)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        groups = [(-1, frame)] if query else frame.groupby("pivot")
        return pd.DataFrame(
            [
                (int(p), g["far"].min(), g["far"].max(), g["vec_id"].to_numpy(np.int64).tobytes(), b"".join(g["x"]))
                for p, g in groups
            ],
            columns=["pivot", "near", "far", "ids", "vectors"],
        )

    schema = "pivot int, near double, far double, ids binary, vectors binary"
    return placed.mapInPandas(cut, schema).withColumn("block", F.monotonically_increasing_id())


def _unpack(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.frombuffer(ids, np.int64)
    return numbers, np.frombuffer(vectors).reshape(len(numbers), -1)


def _answers(pairs: DataFrame, queries: DataFrame, blocks: DataFrame, shared, k: int) -> DataFrame:
    """The best ``k`` of each block for each query of a query block, pair by pair."""
    joined = (
        pairs.join(queries.select("query_block", "query_ids", "query_vectors"), "query_block")
        .join(blocks.select("block", "pivot", "near", "far", "ids", "vectors"), "block")
    )

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        row, space = frame.iloc[0], shared.value
        query_ids, queries = _unpack(row["query_ids"], row["query_vectors"])
        ids, vectors = _unpack(row["ids"], row["vectors"])
        if row["floors"] is not None:
            # Only queries that the triangle inequality cannot keep off this annulus.
            floors = np.frombuffer(row["floors"])
            to = space.to_pivots(np.hstack([queries, np.zeros((len(queries), 1))]))[:, row["pivot"]]
            reach = _reach(space, queries, floors)
            open_ = (row["near"] <= to + reach) & (row["far"] >= to - reach)
            query_ids, queries, floors = query_ids[open_], queries[open_], floors[open_]
        scores = queries @ vectors.T
        scores[query_ids[:, None] == ids[None, :]] = -np.inf
        if row["floors"] is not None:
            scores[scores < floors[:, None]] = -np.inf
        at, column = best_rows(scores, ids, k)
        return pd.DataFrame({"query_id": query_ids[at], "vec_id": ids[column], "score": scores[at, column]})

    return joined.groupBy("query_block", "block").applyInPandas(search, "query_id long, vec_id long, score double")


def _reach(space: Space, queries: np.ndarray, floors: np.ndarray) -> np.ndarray:
    """The distance within which a query's k best must lie, given its k-th so far."""
    square = (queries * queries).sum(axis=1) + space.longest - 2 * floors
    return np.where(np.isfinite(floors), np.sqrt(np.maximum(square, 0)) + space.slack(), np.inf)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    pivots: int = PIVOTS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest inner products, exactly.

    Vectors are keyed by their nearest pivot and the distance to it, and cut into
    annuli of at most ``BLOCK`` vectors, so that a crowded pivot is many blocks.
    Queries first search the annuli around their own place; their k-th score then
    bounds by the triangle inequality which other annuli can hold something
    better, and only those are searched. ``is_query`` is a condition on ``vec_id``.

    Ties go to smaller ids. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id; rows that repeat an id
    count once; shorter vectors end in zeros; fewer candidates than ``k`` are all
    returned; an empty table gives no rows; other columns do not matter. Scores
    are exact while they stay below 2**53.
    """
    spark = df.sparkSession
    vectors = stage(distinct_vectors(df, vec_id, embedding), "topk-vectors")
    space = make_space(vectors, pivots)
    schema = "query_id long, rank int, vec_id long, score double"
    if space is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(space)
    asked = vectors.filter(is_query)
    blocks = stage(_blocks(vectors, shared, BLOCK, vectors.count(), False), "topk-blocks")
    queries = stage(
        _blocks(asked, shared, QUERIES, asked.count(), True).select(
            F.col("block").alias("query_block"), F.col("ids").alias("query_ids"), F.col("vectors").alias("query_vectors")
        ),
        "topk-queries",
    )

    rings = blocks.select("block", "pivot", "near", "far")
    fits = (F.col("of") == F.col("pivot")) & (F.col("near") <= F.col("high")) & (F.col("far") >= F.col("low"))

    home = queries.mapInPandas(_home_spans(shared), SPANS)
    first = stage(home.join(rings, fits).select("query_block", "block", "floors"), "topk-home")
    near = stage(_answers(first, queries, blocks, shared, k), "topk-near")

    floor = _top(near, k).groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("floor"))
    placed = queries.mapInPandas(_positions, "query_block long, query_id long, place int").join(floor, "query_id", "left")
    floors = placed.groupBy("query_block").applyInPandas(_pack_floors, "query_block long, floors binary")
    wide = queries.join(floors, "query_block").mapInPandas(_wide_spans(shared), SPANS)
    rest = wide.join(rings, fits).select("query_block", "block", "floors")
    rest = stage(rest.join(first, ["query_block", "block"], "left_anti"), "topk-rest")
    found = near.union(_answers(rest, queries, blocks, shared, k))
    return _top(found, k).select("query_id", "rank", "vec_id", "score")


SPANS = "of int, low double, high double, query_block long, floors binary"


def _home_spans(shared):
    """For each pivot, where the queries of a block lie that are nearest to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = shared.value
        for row in (row for frame in frames for row in frame.itertuples()):
            _, x = _unpack(row.query_ids, row.query_vectors)
            far = space.to_pivots(space.lift(x))  # as vectors, lifted like all vectors
            home = far.argmin(axis=1)
            own = far[np.arange(len(far)), home]
            spans = [(p, own[home == p].min(), own[home == p].max()) for p in np.unique(home)]
            yield pd.DataFrame(spans, columns=["of", "low", "high"]).assign(query_block=row.query_block, floors=None)

    return run


def _wide_spans(shared):
    """For each pivot, the distances at which a block's queries may find something better."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        space = shared.value
        for row in (row for frame in frames for row in frame.itertuples()):
            _, x = _unpack(row.query_ids, row.query_vectors)
            far = space.to_pivots(np.hstack([x, np.zeros((len(x), 1))]))
            reach = _reach(space, x, np.frombuffer(row.floors))[:, None]
            spans = {"low": (far - reach).min(axis=0), "high": (far + reach).max(axis=0)}
            yield pd.DataFrame({"of": range(far.shape[1]), **spans, "query_block": row.query_block, "floors": row.floors})

    return run


def _positions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for row in (row for frame in frames for row in frame.itertuples()):
        ids = np.frombuffer(row.query_ids, np.int64)
        yield pd.DataFrame({"query_block": row.query_block, "query_id": ids, "place": range(len(ids))})


def _pack_floors(frame: pd.DataFrame) -> pd.DataFrame:
    """A block's k-th scores so far, in its order; minus infinity where fewer are found."""
    floors = frame.sort_values("place")["floor"].fillna(-np.inf).to_numpy(float)
    return pd.DataFrame({"query_block": frame["query_block"].iloc[:1], "floors": [floors.tobytes()]})
