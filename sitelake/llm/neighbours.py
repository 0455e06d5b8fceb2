"""Approximate nearest neighbours: NN-descent by joins, then greedy graph search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.llm.vectors import best_rows, distinct_vectors, matrix
from sitelake.session import stage

#: Neighbours of a node, and nodes that may count it among theirs.
DEGREE = 28
#: Orders of the vectors that the first graph is read from, the runs cut from them,
#: and the neighbours that each order but the first contributes.
ORDERS = 16
RUN = 2048
PER_ORDER = 12
#: Descent ends with the round that replaces at most this share of the neighbours.
SETTLED = 0.001
#: Partners that a node names to each of its neighbours in a round.
PARTNERS = 8
#: Search: nodes expanded in a hop, and the best found that are kept.
EXPAND = 24
BEAM = 96
#: Vectors that the cuts of the orders are set by.
SAMPLE = 2000
CODE_BITS = 48

RECORD = np.dtype([("id", "<i8"), ("score", "<f4")])


# --- compact vectors --------------------------------------------------------


def compact(vectors: DataFrame, width: int) -> DataFrame:
    """``id, q, scale``: components as whole numbers from -127 to 127 times a scale.

    Graph and search steps compare these; answers are scored on the originals.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = matrix(frame["v"], width)
            scale = np.abs(x).max(axis=1) / 127
            q = np.rint(x / scale[:, None]).astype(np.int8)
            yield pd.DataFrame({"id": frame["vec_id"], "q": [r.tobytes() for r in q], "scale": scale.astype(np.float32)})

    return vectors.mapInPandas(run, "id long, q binary, scale float")


def _loose(q: pd.Series, scale: pd.Series) -> np.ndarray:
    if not len(q):
        return np.zeros((0, 0), np.float32)
    x = np.frombuffer(b"".join(q), np.int8).reshape(len(q), -1).astype(np.float32)
    return x * scale.to_numpy(np.float32)[:, None]


# --- lists of records in Arrow columns --------------------------------------


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Records of a list of packed binaries, and the row that each belongs to."""
    parts = column.flatten().to_pylist()
    sizes = np.array([len(x) for x in parts], np.int64)
    records = np.frombuffer(b"".join(parts), RECORD)
    rows = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return records, np.repeat(rows, sizes // RECORD.itemsize)


def _packed(records: np.ndarray, rows: np.ndarray, count: int) -> list[bytes]:
    """Records of consecutive rows, one binary for each of ``count`` rows."""
    raw, cuts = records.tobytes(), np.searchsorted(rows, np.arange(count + 1)) * RECORD.itemsize
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def best_records(records: np.ndarray, rows: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's ``keep`` best different ids."""
    order = np.lexsort((-records["score"], records["id"], rows))
    records, rows = records[order], rows[order]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (records["id"][1:] != records["id"][:-1])
    records, rows = records[fresh], rows[fresh]
    order = np.lexsort((records["id"], -records["score"], rows))
    records, rows = records[order], rows[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < keep
    return records[kept], rows[kept]


def _merged(lists: DataFrame, keep: int) -> DataFrame:
    """``id, near`` from rows of ``id, near``: the best records of each id."""
    gathered = lists.groupBy("id").agg(F.collect_list("near").alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                column = pa.array(part.column(1).to_pylist(), pa.list_(pa.binary()))
                records, rows = best_records(*_flat(column), keep)
                near = pa.array(_packed(records, rows, part.num_rows), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), near], ["id", "near"])

    return gathered.mapInArrow(run, "id long, near binary")


# --- the graph --------------------------------------------------------------


def first_graph(small: DataFrame, degree: int, orders: int = ORDERS, run_length: int = RUN) -> DataFrame:
    """A first graph: the best neighbours within runs of similarly coded vectors.

    A code says on which side of random planes through the middle of a sample a
    vector lies. Vectors sorted by code are cut into runs of fixed length, so that
    any number of equal vectors is many runs.
    """
    sample = small.orderBy(F.xxhash64("id")).limit(SAMPLE).toPandas()
    x = _loose(sample["q"], sample["scale"])
    planes = np.random.default_rng(11).normal(size=(orders, x.shape[1], CODE_BITS)).astype(np.float32)
    middles = np.stack([np.median(x @ p, axis=0) for p in planes])
    shared = small.sparkSession.sparkContext.broadcast((planes, middles))
    weights = (1 << np.arange(CODE_BITS, dtype=np.int64))[::-1]

    def code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes, middles = shared.value
        for frame in frames:
            x = _loose(frame["q"], frame["scale"])
            for i, (plane, middle) in enumerate(zip(planes, middles, strict=True)):
                yield frame.assign(turn=i, code=((x @ plane > middle) * weights).sum(axis=1))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            rest = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            while len(rest) >= 2 * run_length:
                yield from runs(rest.iloc[:run_length])
                rest = rest.iloc[run_length:].reset_index(drop=True)
        if rest is not None:
            half = -(-len(rest) // 2) if len(rest) > run_length else len(rest)
            for at in range(0, len(rest), max(half, 1)):
                yield from runs(rest.iloc[at : at + half])

    def runs(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for turn, part in frame.groupby("turn"):
            ids, x = part["id"].to_numpy(np.int64), _loose(part["q"], part["scale"])
            scores = x @ x.T
            np.fill_diagonal(scores, -np.inf)
            row, column = best_rows(scores, ids, degree if turn == 0 else min(degree, PER_ORDER))
            records = np.empty(len(row), RECORD)
            records["id"], records["score"] = ids[column], scores[row, column]
            yield pd.DataFrame({"id": ids, "near": _packed(records, row, len(ids))})

    order = ["turn", "code", "id"]
    coded = small.mapInPandas(code, "id long, q binary, scale float, turn int, code long")
    lists = coded.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(search, "id long, near binary")
    return _merged(lists, degree)


def edges(graph: DataFrame) -> DataFrame:
    """``id, to, score``: the records of a graph as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = batch.column(1).to_pylist()
            records = np.frombuffer(b"".join(near), RECORD)
            ids = np.repeat(batch.column(0).to_numpy(), [len(x) // RECORD.itemsize for x in near])
            columns = [ids, np.ascontiguousarray(records["id"]), np.ascontiguousarray(records["score"])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["id", "to", "score"])

    return graph.select("id", "near").mapInArrow(run, "id long, to long, score float")


def mutual(graph: DataFrame, degree: int) -> DataFrame:
    """The edges that both ends keep.

    Of the nodes that count a node among their neighbours its best ``degree``
    remain, so that no hub gathers an unbounded list.
    """
    best = Window.partitionBy("to").orderBy(F.desc("score"), "id")
    return edges(graph).withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= degree)


def both_ways(kept: DataFrame, forward: DataFrame) -> DataFrame:
    """``center, member``: the nodes of ``kept`` edges back to front, and of ``forward`` as they are."""
    return kept.select(F.col("to").alias("center"), F.col("id").alias("member")).union(forward.select("id", "to"))


def descend(graph: DataFrame, small: DataFrame, degree: int, partners: int = PARTNERS) -> DataFrame:
    """One round of NN-descent: neighbours of a node are introduced to each other.

    Every node joins its neighbours, both ways, with their vectors; each of them
    hears of the partners among the others that lie nearest to it.
    """
    kept = mutual(graph, degree)
    lists = (
        both_ways(kept, kept)
        .join(small, F.col("member") == F.col("id"))
        .groupBy("center")
        .agg(F.collect_list(F.struct("member", "q", "scale")).alias("all"))
        .select("all")
    )

    def introduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                column = batch.column(0).slice(at, 500)
                flat = column.flatten()
                sizes = np.diff(column.offsets.to_numpy())
                ids = flat.field("member").to_numpy()
                q = np.frombuffer(b"".join(flat.field("q").to_pylist()), np.int8).reshape(len(ids), -1)
                x = q.astype(np.float32) * flat.field("scale").to_numpy()[:, None]
                out_ids, out = _introductions(ids, x, sizes, partners)
                yield pa.RecordBatch.from_arrays([pa.array(out_ids), pa.array(out, pa.binary())], ["id", "near"])

    heard = lists.mapInArrow(introduce, "id long, near binary")
    return _merged(heard.union(graph.select("id", "near")), degree)


def _introductions(ids: np.ndarray, x: np.ndarray, sizes: np.ndarray, partners: int) -> tuple[np.ndarray, list[bytes]]:
    """For every member of every list its best partners in that list."""
    most = int(sizes.max())
    spot = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    who = np.full((len(sizes), most), -1, np.int64)
    there = np.zeros((len(sizes), most), bool)
    who[row, spot], there[row, spot] = ids, True
    grid = np.zeros((len(sizes), most, x.shape[1]), np.float32)
    grid[row, spot] = x
    scores = grid @ grid.transpose(0, 2, 1)
    scores[~there[:, None, :].repeat(most, 1) | (who[:, :, None] == who[:, None, :])] = -np.inf
    keep = min(partners, most)
    column = np.argpartition(-scores, keep - 1, axis=2)[:, :, :keep]
    value = np.take_along_axis(scores, column, 2)
    records = np.empty(value.shape, RECORD)
    records["id"], records["score"] = np.take_along_axis(who, column.reshape(len(sizes), -1), 1).reshape(value.shape), value
    out = records[row, spot]
    good = out["score"] > -np.inf
    lists = _packed(out[good], np.nonzero(good)[0], len(ids))
    return ids, lists


def replaced(before: DataFrame, after: DataFrame) -> float:
    """The share of the records of ``after`` that ``before`` lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = size = 0
            for old, now in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(now, RECORD)["id"].tolist()
                new += len(set(ids).difference(np.frombuffer(old or b"", RECORD)["id"].tolist()))
                size += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([new]), pa.array([size])], ["new", "size"])

    pairs = after.withColumnRenamed("near", "_now").join(before, "id", "left").select("near", "_now")
    new, size = pairs.mapInArrow(run, "new long, size long").agg(F.sum("new"), F.sum("size")).first()
    return new / size if size else 0.0


def build_graph(small: DataFrame, degree: int = DEGREE, settled: float = SETTLED) -> DataFrame:
    """``id, near`` of every node; each round is written before the next begins.

    Lists only ever improve, so rounds come to an end.
    """
    graph, share, turn = stage(first_graph(small, degree), "neighbours-0"), 1.0, 0
    while share > settled:
        turn += 1
        before, graph = graph, stage(descend(graph, small, degree), f"neighbours-{turn}")
        share = replaced(before, graph)
    return graph


# --- search -----------------------------------------------------------------

STATE = np.dtype([("id", "<i8"), ("score", "<f4"), ("open", "?")])


def _advance(beam: int):
    """Merge what a query's open nodes lead to into the best it has found."""

    def run(key: tuple, state: pd.DataFrame, reached: pd.DataFrame) -> pd.DataFrame:
        row = state.iloc[0]
        own, query = key[0], np.frombuffer(row["query"], np.float32)
        found = np.frombuffer(row["found"], STATE).copy()
        # What was to be expanded has been by now.
        found["open"][np.isin(found["id"], np.frombuffer(row["next"], np.int64))] = False
        nodes = reached["node"].to_numpy(np.int64)
        new = reached[~np.isin(nodes, found["id"]) & (nodes != own)]
        if len(new):
            more = np.empty(len(new), STATE)
            more["id"], more["open"] = new["node"].to_numpy(), True
            more["score"] = _loose(new["q"], new["scale"]) @ query
            found = np.concatenate([found, more])
        found = found[np.lexsort((found["id"], -found["score"]))][:beam]
        return pd.DataFrame(
            {"query_id": [own], "query": [row["query"]], "found": [found.tobytes()], "next": [_next(found)]}
        )

    return run


def _next(found: np.ndarray, expand: int = EXPAND) -> bytes:
    """The best nodes that have not been expanded yet."""
    return np.ascontiguousarray(found["id"][found["open"]][:expand]).tobytes()


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    degree: int = DEGREE,
    settled: float = SETTLED,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: about the ``k`` largest inner products.

    NN-descent builds a graph over all vectors, in rounds until one replaces no more
    than a share ``settled`` of the neighbours. Queries, rows that ``is_query`` (a
    condition on ``vec_id``) holds for, start at their own node and move greedily:
    in each hop the best nodes found but not yet expanded name their neighbours,
    and the best of all found are kept. Queries hop together, as joins, each until
    all that it keeps have been expanded. The best found are scored anew in double
    precision on the original vectors.

    Ties go to smaller ids. Vectors that are null, zero or hold null or non-finite
    components take no part, nor do rows without an id; rows that repeat an id
    count once; shorter vectors end in zeros; up to ``degree`` other vectors are
    found whole; an empty table gives no rows; other columns do not matter.
    """
    spark = df.sparkSession
    vectors = distinct_vectors(df, vec_id, embedding).filter(F.exists("v", lambda x: x != 0))
    vectors = stage(vectors, "nearest-vectors")
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    small = stage(compact(vectors, width), "nearest-compact")
    graph = build_graph(small, degree, settled)
    # A node always leads to all its neighbours, even where a hub does not know it.
    links = stage(both_ways(mutual(graph, degree), edges(graph)).distinct(), "nearest-links")

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = matrix(frame["v"], width).astype(np.float32)
            own = [np.int64(i).tobytes() for i in frame["vec_id"]]
            yield pd.DataFrame({"query_id": frame["vec_id"], "query": [r.tobytes() for r in x], "found": b"", "next": own})

    schema = "query_id long, query binary, found binary, next binary"
    state = vectors.filter(is_query).mapInPandas(begin, schema)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            nodes = [np.frombuffer(x, np.int64) for x in frame["next"]]
            yield pd.DataFrame(
                {
                    "query_id": np.repeat(frame["query_id"].to_numpy(), [len(x) for x in nodes]),
                    "center": np.concatenate([np.zeros(0, np.int64), *nodes]),
                }
            )

    ended, hop = spark.createDataFrame([], schema), 0
    while not state.isEmpty():
        reached = (
            state.select("query_id", "next")
            .mapInPandas(spread, "query_id long, center long")
            .join(links, "center")
            .select("query_id", F.col("member").alias("node"))
            .distinct()
            .join(small, F.col("node") == F.col("id"))
            .select("query_id", "node", "q", "scale")
        )
        moved = state.groupBy("query_id").cogroup(reached.groupBy("query_id"))
        moved = stage(moved.applyInPandas(_advance(BEAM), schema), f"nearest-hop-{hop}")
        at_end = F.octet_length("next") == 0
        ended, state, hop = ended.union(moved.filter(at_end)), moved.filter(~at_end), hop + 1

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [np.frombuffer(x, STATE)[: 2 * k] for x in frame["found"]]
            yield pd.DataFrame(
                {
                    "query_id": np.repeat(frame["query_id"].to_numpy(), [len(x) for x in found]),
                    "vec_id": np.concatenate([np.zeros(0, np.int64), *[x["id"] for x in found]]),
                }
            )

    pairs = ended.select("query_id", "found").mapInPandas(best, "query_id long, vec_id long")
    asked = vectors.select(F.col("vec_id").alias("query_id"), F.col("v").alias("_q"))
    product = F.aggregate(
        F.zip_with("_q", "v", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda t, x: t + x
    )
    scored = pairs.join(vectors, "vec_id").join(asked, "query_id").select("query_id", "vec_id", product.alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
