"""The operators over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sitelake.constants import CHAT_SILENCE_SECONDS
from sitelake.functions.paths import safe_request_path
from sitelake.operators.archives import latest_rows
from sitelake.operators.audit import locate_links, page_links, stored_pages
from sitelake.operators.catalog import Lookup
from sitelake.operators.history import Batch
from sitelake.operators.parse import parse_docs
from sitelake.session import stage


def latest_docs(log: DataFrame, *order: str) -> DataFrame:
    """Newest version of each document in a log of documents."""
    return latest_rows(log, *order)


def batch_links(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Resolved and located links of the documents of one micro-batch.

    Meant for ``write_log(…, each=…)``: within a batch all batch operators work,
    and every document is parsed once, in the batch that brings it.
    """
    parsed = parse_docs(docs.select("site", "rel", "kind", "truncated", "readable", "text"))
    resolved = stage(page_links(stored_pages(parsed)), "resolved")
    return locate_links(resolved, catalog)


def current_pages(visits: DataFrame) -> DataFrame:
    """Running current page of each pack, for update mode."""
    return (
        visits.filter("rel is not null")
        .groupBy("pack")
        .agg(F.max(F.struct("ts", "seq", "rel")).alias("_last"))
        .select("pack", F.col("_last.rel").alias("rel"), F.col("_last.ts").alias("ts"))
    )


def route_stream(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Answer requests as they come: ``status`` and ``rel``.

    The catalog is static, so each request passes four joins with it and no
    state is kept.
    """
    lookup = Lookup(catalog)
    index = F.when(F.col("_path") == "", F.lit("index.html")).otherwise(
        F.concat("_path", F.lit("/index.html"))
    )
    asked = requests.withColumn("_path", safe_request_path(F.col("url"))).withColumn("_index", index)
    found = lookup.find(lookup.find(asked, "_path", "_file"), "_index", "_in_folder")
    return (
        found.withColumn("rel", F.coalesce("_file", "_in_folder"))
        .withColumn(
            "status",
            F.when(F.col("_path").isNull(), 403).when(F.col("rel").isNotNull(), 200).otherwise(404),
        )
        .drop("_path", "_index", "_file", "_in_folder")
    )


def status_counts(routed: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests per minute and status, for update mode."""
    return (
        routed.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 minute").alias("w"), "status")
        .agg(F.count(F.lit(1)).alias("requests"))
        .select(F.col("w.start").alias("minute"), "status", "requests")
    )


ANSWER = "request_id bigint, status string, answer string, tokens bigint, error string"


def _chunk(row) -> tuple:
    """A chunk with plain Python values; pandas holds missing counts as NaN."""
    tokens = None if pd.isna(row.tokens) else int(row.tokens)
    error = None if pd.isna(row.error) else row.error
    return int(row.ord), row.content, tokens, bool(row.done), error


def _silent_at(millis: int) -> int:
    """The first event time at which more than the allowed silence has passed.

    Timers run out when the watermark reaches them, not only when it passes them.
    """
    return millis + CHAT_SILENCE_SECONDS * 1000 + 1


class ChatAnswers(StatefulProcessor):
    """Collects the chunks of a response until it is complete or falls silent.

    Chunks are kept by number: one that comes twice counts once. A response that
    has been answered leaves a mark for as long as it might have been silent, so
    that late repeats do not answer it again.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", "ord bigint", "content string, tokens bigint, done boolean, error string")
        # How many chunks there are, the last one's number, and whether one ends
        # the response. The chunks themselves are read only once, at the end.
        self.progress = handle.getValueState("progress", "n bigint, top bigint, ended boolean")
        self.finished = handle.getValueState("finished", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        latest = int(frame["ts"].max().timestamp() * 1000)
        if self.finished.exists():
            return
        new = frame.drop_duplicates("ord")[["ord", "content", "tokens", "done", "error"]]
        before = self.progress.get()
        n, top, ended = before or (0, -1, False)
        ended = bool(ended or new["done"].any() or new["error"].notna().any())
        top = max(top, int(new["ord"].max()))
        chunks = [_chunk(row) for row in new.itertuples(index=False)]
        if before is None and ended and len(chunks) == top + 1:
            yield self._finish(key, chunks, latest)
            return
        for number, *value in chunks:
            if before is None or not self.chunks.containsKey((number,)):
                self.chunks.updateValue((number,), tuple(value))
                n += 1
        if ended and n == top + 1:
            yield self._finish(key, self._kept(), latest)
            return
        self.progress.update((n, top, ended))
        self._forget_timers()
        self.handle.registerTimer(_silent_at(latest))

    def _kept(self) -> list[tuple]:
        return [(number, *value) for (number,), value in self.chunks.iterator()]

    def _forget_timers(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.finished.exists():
            self.finished.clear()
        elif self.progress.exists():
            yield self._finish(key, self._kept(), expiredTimerInfo.getExpiryTimeInMs())

    def _finish(self, key, parts: list[tuple], at: int) -> pd.DataFrame:
        """The answer; ``at`` is the event time from which repeats are remembered."""
        if self.progress.exists():
            self.chunks.clear()
            self.progress.clear()
            self._forget_timers()
        self.finished.update((True,))
        self.handle.registerTimer(_silent_at(at))
        parts = sorted(parts, key=lambda p: p[0])
        errors = [p[4] for p in parts if p[4] is not None]
        answer = "".join(p[1] for p in parts)
        if errors:
            status = "unreadable" if errors[0] == "unreadable" else "error"
        elif not any(p[3] for p in parts):
            status = "unfinished"
        else:
            status = "ok" if answer else "empty"
        tokens = [p[2] for p in parts if p[2] is not None]
        ok = status == "ok"
        return pd.DataFrame(
            {
                "request_id": pd.Series([key[0]], dtype="int64"),
                "status": [status],
                "answer": pd.Series([answer if ok else None], dtype="object"),
                "tokens": pd.Series([tokens[-1] if ok and tokens else None], dtype="Int64"),
                "error": pd.Series([errors[0] if status == "error" else None], dtype="object"),
            }
        )


def chat_answers(chunks: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Answers of streamed responses, emitted when they end.

    ``chunks(request_id, ord, ts, content, tokens, done, error)``. A response
    that is silent for ten minutes of event time is given up as unfinished.
    """
    return (
        chunks.withWatermark("ts", delay)
        .groupBy("request_id")
        .transformWithStateInPandas(
            statefulProcessor=ChatAnswers(), outputStructType=ANSWER, outputMode="Append", timeMode="EventTime"
        )
    )


class RunningBatch(StatefulProcessor):
    """Keeps the document batch of a pack."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.docs = handle.getListState("docs", "rel string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values("seq")
        batch = Batch([rel for (rel,) in self.docs.get()])
        for action, rel in zip(events["action"], events["rel"]):
            batch.apply(action, rel)
        if batch.docs:
            self.docs.put([(rel,) for rel in batch.docs])
        else:
            self.docs.clear()
        yield pd.DataFrame(
            {
                "pack": pd.Series([key[0]], dtype="int64"),
                "seq": pd.Series([events["seq"].iloc[-1]], dtype="int64"),
                "docs": [batch.docs],
            }
        )


def running_batches(events: DataFrame) -> DataFrame:
    """Batch of each pack after every micro-batch of its add and remove actions."""
    return events.groupBy("pack").transformWithStateInPandas(
        statefulProcessor=RunningBatch(),
        outputStructType="pack bigint, seq bigint, docs array<string>",
        outputMode="Update",
        timeMode="None",
    )
