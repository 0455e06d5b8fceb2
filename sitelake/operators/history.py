"""Logs of navigation and work: what is current, what is newest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.constants import BATCH_MAX


def is_own_origin(url: Column, port: Column) -> Column:
    """The URL is one of the reader's own pages: http on this host and port."""
    return (
        (F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "http")
        & (F.try_parse_url(url, F.lit("HOST")) == "127.0.0.1")
        & (
            F.coalesce(F.regexp_extract(url, r"^[a-zA-Z]+://[^/:?#]*:(\d+)", 1).try_cast("int"), F.lit(80))
            == port
        )
    )


def looks_like_document(path: Column) -> Column:
    """The path names something else than a home page."""
    return ~F.btrim(path, F.lit("/")).isin("", "index.html", "index.htm")


def current_page(visits: DataFrame) -> DataFrame:
    """Last visited page per pack that resolved to a file (``rel`` not null)."""
    return (
        visits.filter("rel is not null")
        .groupBy("pack")
        .agg(F.max_by("rel", F.struct("ts", "seq")).alias("rel"), F.max("ts").alias("ts"))
    )


def latest_generation(results: DataFrame) -> DataFrame:
    """Results of the newest run that has begun for each key; older ones go.

    ``results(key, gen, …)``. One partial aggregate finds the newest run; the
    results join it, so a busy key is never sorted as a whole.
    """
    newest = results.groupBy("key").agg(F.max("gen").alias("gen"))
    return results.join(newest, ["key", "gen"], "left_semi")


def first_mentions(picks: DataFrame) -> DataFrame:
    return picks.groupBy("question_id", "rel").agg(F.min("pos").alias("pos"))


def batch_slots(picks: DataFrame, limit: int = BATCH_MAX) -> DataFrame:
    """Documents sent with each question: distinct, in order of first mention.

    ``picks(question_id, pos, rel)`` → ``(question_id, rel, pos, slot)``, with
    ``slot`` from 1 to the limit, which holds before the shuffle too.
    """
    order = Window.partitionBy("question_id").orderBy("pos", "rel")
    return first_mentions(picks).withColumn("slot", F.row_number().over(order)).filter(F.col("slot") <= limit)


def doc_batches(picks: DataFrame, limit: int = BATCH_MAX) -> DataFrame:
    """As ``batch_slots``, with the documents that found no room, slot null."""
    kept = batch_slots(picks, limit).select("question_id", "rel", "slot")
    return first_mentions(picks).join(kept, ["question_id", "rel"], "left")


def pages_to_send(questions: DataFrame, batches: DataFrame) -> DataFrame:
    """The batch of a question, else its current page, else an error row.

    ``questions(question_id, current)``, ``batches`` as from ``batch_slots`` →
    ``(question_id, slot, rel, error)``.
    """
    batch = batches.select("question_id", "slot", "rel")
    joined = questions.select("question_id", F.nullif(F.trim("current"), F.lit("")).alias("current")).join(
        batch, "question_id", "left"
    )
    rel = F.coalesce("rel", "current")
    return joined.select(
        "question_id",
        F.when(rel.isNotNull(), F.coalesce("slot", F.lit(1))).alias("slot"),
        rel.alias("rel"),
        F.when(rel.isNull(), F.lit("no page")).alias("error"),
    )


class Batch:
    """An ordered set of at most ``limit`` documents."""

    def __init__(self, docs: list[str] | None = None, limit: int = BATCH_MAX):
        self.docs, self.limit = list(docs or []), limit

    def apply(self, action: str, rel: str) -> None:
        if action == "remove":
            self.docs = [d for d in self.docs if d != rel]
        elif rel not in self.docs and len(self.docs) < self.limit:
            self.docs.append(rel)


class Span:
    """Adds since the last removal that counts, and documents known to be away.

    Whatever a batch held before, the first ``limit`` different adds of a span fill
    it, so later ones change nothing; nor does the removal of a document that is
    away. What is forgotten beyond ``remembered`` names only leaves more to replay.
    """

    def __init__(self, limit: int, remembered: int = 100_000):
        self.limit, self.remembered = limit, remembered
        self.added: set[str] = set()
        self.away: dict[str, None] = {}

    def counts(self, action: str, rel: str) -> bool:
        """Whether the next action may change a batch."""
        if action == "remove":
            if rel in self.away:
                return False
            self.away[rel] = None
            if len(self.away) > self.remembered:
                del self.away[next(iter(self.away))]
            self.added.clear()
            return True
        if rel in self.added or len(self.added) >= self.limit:
            return False
        self.added.add(rel)
        self.away.pop(rel, None)
        return True


def edits_that_count(events: DataFrame, limit: int = BATCH_MAX) -> DataFrame:
    """``events(pack, seq, action, rel)`` without those that cannot change a batch.

    Events are dealt by ranges of pack and number, so a busy pack is spread over
    many tasks. Each part is read in order; a part begins with nothing known, as
    if a span began there, so the cuts do not matter to what a replay finds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, span = None, Span(limit)
        for batch in batches:
            kept = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("pack", "action", "rel")))
            for key, action, rel in rows:
                if key != pack:
                    pack, span = key, Span(limit)
                kept.append(span.counts(action, rel))
            yield batch.filter(pa.array(kept, pa.bool_()))

    columns = events.select("pack", "seq", "action", "rel")
    ordered = columns.repartitionByRange("pack", "seq").sortWithinPartitions("pack", "seq", "action", "rel")
    return ordered.mapInArrow(run, columns.schema)


def replay_batches(events: DataFrame, limit: int = BATCH_MAX) -> DataFrame:
    """Final batch of each pack after its ordered add and remove actions.

    ``events(pack, seq, action, rel)`` → ``(pack, slot, rel)``. The limit makes
    the outcome depend on the whole order. Of a pack's events only those that
    ``edits_that_count`` leaves are replayed: of each span between removals at
    most ``limit`` adds. They are sorted by Spark and streamed through a state of
    one batch. Actions with the same number go by action and name; a null pack is a
    pack of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple | None = None

        def done() -> pa.RecordBatch:
            docs = state[1].docs
            columns = [
                pa.array([state[0]] * len(docs), pack_type),
                pa.array(range(1, len(docs) + 1), pa.int32()),
                pa.array(docs, pa.string()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["pack", "slot", "rel"])

        for batch in batches:
            pack_type = batch.schema.field("pack").type
            for key, action, rel in zip(*(batch.column(c).to_pylist() for c in ("pack", "action", "rel"))):
                if state is None or key != state[0]:
                    if state is not None:
                        yield done()
                    state = key, Batch(limit=limit)
                state[1].apply(action, rel)
        if state is not None:
            yield done()

    kind = events.schema["pack"].dataType.simpleString()
    return (
        edits_that_count(events, limit)
        .repartition("pack")
        .sortWithinPartitions("pack", "seq", "action", "rel")
        .select("pack", "action", "rel")
        .mapInArrow(run, f"pack {kind}, slot int, rel string")
    )
