"""Streaming jobs over several batches."""

import os

import pytest
from pyspark.sql import functions as F

from sitelake.operators import history, prompts
from sitelake.plans import streams as stream_plans
from sitelake.session import new_folder
from sitelake.streaming import jobs
from sitelake.streaming.folders import MERGE, FolderStreamReader, Listings
from sitelake.streaming.logs import drain, read_log, rocksdb, stream_folder, stream_table, write_log
from tests.test_notes_prompts import ANSWERS, CHAT


class Feed:
    """A folder that grows by one file per ``add`` and a log that follows it."""

    def __init__(self, spark, schema):
        self.spark, self.schema = spark, schema
        self.source, self.log, self.offsets = (new_folder(spark, x) for x in ("feed", "log", "offsets"))

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)

    def stream(self):
        return stream_table(self.spark, self.source, self.spark.createDataFrame([], self.schema).schema)

    def run(self, job, mode="append", **options):
        out = job(self.stream())
        write_log(out, self.log, self.offsets, mode=mode, **options).awaitTermination()
        return read_log(self.spark, self.log, out.schema)


def test_versions_of_documents(spark):
    feed = Feed(spark, "site string, rel string, saved int, text string")
    feed.add([("s", "a.md", 1, "one"), ("s", "b.md", 1, "b")])
    feed.run(lambda s: s)
    feed.add([("s", "a.md", 3, "three"), ("s", "a.md", 2, "two")])
    log = feed.run(lambda s: s)
    newest = jobs.latest_docs(log.drop("batch"), "saved")
    assert {r["rel"]: r["text"] for r in newest.collect()} == {"a.md": "three", "b.md": "b"}


def put(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


class FolderFeed:
    """A folder tree and the log of a stream over it, started anew by every ``run``."""

    def __init__(self, spark, root, **options):
        self.spark, self.root, self.options = spark, root, options
        self.log, self.offsets, self.listing = (new_folder(spark, x) for x in ("log", "offsets", "listing"))

    def run(self):
        stream = stream_folder(self.spark, str(self.root), self.listing, **self.options)
        stream = stream.select("rel", "size", F.col("content").cast("string").alias("text"))
        write_log(stream, self.log, self.offsets).awaitTermination()
        rows = read_log(self.spark, self.log, stream.schema).collect()
        return sorted((r["batch"], r["rel"], r["size"], r["text"]) for r in rows)


def test_folder_stream_reads_every_name_and_what_is_rewritten(spark, tmp_path):
    root = tmp_path / "tree"
    put(root, {"a.md": "# A", "_static/s.css": "x{}", ".well-known/k.txt": "k", "deep/_n.html": "<p>", "empty.md": ""})
    feed = FolderFeed(spark, root)
    first = [(0, ".well-known/k.txt", 1, "k"), (0, "_static/s.css", 3, "x{}"), (0, "a.md", 3, "# A")]
    first += [(0, "deep/_n.html", 3, "<p>"), (0, "empty.md", 0, "")]
    assert feed.run() == first
    assert feed.run() == first
    put(root, {"a.md": "# A, longer", "new.md": "n"})
    second = first + [(1, "a.md", 11, "# A, longer"), (1, "new.md", 1, "n")]
    assert feed.run() == second
    # The same size, another time.
    put(root, {"new.md": "m"})
    os.utime(root / "new.md", (2_000_000_000, 2_000_000_000))
    assert feed.run() == second + [(2, "new.md", 1, "m")]


def test_folder_stream_leaves_out_what_it_is_told_to(spark, tmp_path):
    put(tmp_path / "tree", {"a.md": "a", ".git/x": "x", "notes/.hidden.md": "h", "_b.md": "b"})
    feed = FolderFeed(spark, tmp_path / "tree", skip=r"(?:^|/)\.")
    assert feed.run() == [(0, "_b.md", 1, "b"), (0, "a.md", 1, "a")]


def test_folder_stream_without_contents_or_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert FolderFeed(spark, tmp_path / "none").run() == []
    put(tmp_path / "tree", {"a.md": "abc"})
    assert FolderFeed(spark, tmp_path / "tree", content=False).run() == [(0, "a.md", 3, None)]


def test_listings_are_merged_and_found_again(tmp_path):
    listings = Listings(str(tmp_path / "listing"))
    for i in range(2 * MERGE + 3):
        assert listings.add([(f"f{i % 5}", i, i)]) == i + 1
    again = Listings(str(tmp_path / "listing"))
    assert again.known == listings.known and again.last == 2 * MERGE + 3
    assert again.files(0, 3) == ["f0", "f1", "f2"]
    assert again.files(2 * MERGE + 2, 2 * MERGE + 3) == [f"f{(2 * MERGE + 2) % 5}"]


def test_folder_stream_takes_a_few_files_at_a_time(tmp_path):
    put(tmp_path / "tree", {f"f{i}": "x" for i in range(5)})
    reader = FolderStreamReader({"path": str(tmp_path / "tree"), "listing": str(tmp_path / "l"), "pertrigger": "2"})
    offsets = [reader.initialOffset()] + [reader.latestOffset() for _ in range(4)]
    assert [o["listing"] for o in offsets] == [0, 1, 2, 3, 3]
    parts = [reader.partitions(a, b) for a, b in zip(offsets, offsets[1:])]
    assert [sum(len(p.files) for p in x) for x in parts] == [2, 2, 1, 0]


def test_current_page_moves_on(spark):
    feed = Feed(spark, "pack string, ts timestamp, seq int, rel string")
    first = spark.sql("SELECT timestamp'2024-01-01 00:00:00'").first()[0]
    later = spark.sql("SELECT timestamp'2024-01-01 00:01:00'").first()[0]
    feed.add([("p", first, 1, "a"), ("q", first, 2, "x")])
    feed.run(jobs.current_pages, "update")
    feed.add([("p", later, 3, "b"), ("p", later, 4, None)])
    log = feed.run(jobs.current_pages, "update")
    newest = log.groupBy("pack").agg(F.max_by("rel", "batch").alias("rel"))
    assert {r["pack"]: r["rel"] for r in newest.collect()} == {"p": "b", "q": "x"}


def test_older_runs_never_return(spark):
    feed = Feed(spark, "key string, gen int, value string")
    feed.add([("k", 2, "new"), ("k", 1, "old")])
    feed.run(lambda s: s, each=history.latest_generation)
    feed.add([("k", 1, "late"), ("k", 2, "new too")])
    log = feed.run(lambda s: s, each=history.latest_generation)
    assert {r["value"] for r in history.latest_generation(log).collect()} == {"new", "new too"}


def test_chat_answers(spark):
    at = "timestamp'2024-01-01 00:00:00'"
    lines = [(r, i, line) for r, body in CHAT.items() for i, line in enumerate(l for l in body if l)]
    frame = spark.createDataFrame(lines, "request_id long, ord long, line string")
    chunks = prompts.parse_chunks(frame).withColumn("ts", F.expr(f"{at} + make_interval(0, 0, 0, 0, 0, 0, ord)"))
    source = new_folder(spark, "feed")
    chunks.filter("ord = 0").coalesce(1).write.parquet(source)
    offsets, log = new_folder(spark, "offsets"), new_folder(spark, "log")

    def run():
        stream = stream_table(spark, source, chunks.schema)
        with rocksdb(spark):
            out = jobs.chat_answers(stream)
            write_log(out, log, offsets).awaitTermination()
        found = read_log(spark, log, out.schema).collect()
        return {r["request_id"]: (r["status"], r["answer"], r["tokens"], r["error"]) for r in found}

    # Requests that end with their first line are answered at once.
    assert run() == {r: ANSWERS[r] for r in (3, 6)} | {5: ("ok", "x", None, None)}
    chunks.filter("ord > 0 AND request_id <> 5").coalesce(1).write.mode("append").parquet(source)
    assert run() == {r: ANSWERS[r] for r in (1, 2, 3, 6)} | {5: ("ok", "x", None, None)}
    # Half an hour later the silent one is given up.
    late = chunks.filter("request_id = 3").withColumns(
        {"request_id": F.lit(9).cast("long"), "ts": F.expr(f"{at} + interval 30 minutes")}
    )
    late.coalesce(1).write.mode("append").parquet(source)
    assert run()[4] == ANSWERS[4]


def test_repeated_and_late_chunks_answer_once(spark):
    schema = "request_id long, ord long, ts timestamp, content string, tokens long, done boolean, error string"
    at = spark.sql("SELECT timestamp'2024-01-01 00:00:00'").first()[0]
    feed = Feed(spark, schema)

    def run(*chunks):
        feed.add([(1, n, at, text, None, text == "b", None) for n, text in chunks])
        with rocksdb(spark):
            found = feed.run(jobs.chat_answers).collect()
        return [(r["status"], r["answer"]) for r in found]

    assert run((0, "a"), (0, "a")) == []
    assert run((0, "a")) == []
    assert run((1, "b")) == [("ok", "ab")]
    assert run((1, "b"), (0, "a")) == [("ok", "ab")]


def test_running_batches(spark):
    feed = Feed(spark, "pack long, seq long, action string, rel string")

    def run():
        with rocksdb(spark):
            log = feed.run(jobs.running_batches, "update")
        return log.groupBy("pack").agg(F.max_by("docs", "seq").alias("docs")).first()["docs"]

    feed.add([(1, i, "add", f"d{i}") for i in range(9)])
    assert run() == [f"d{i}" for i in range(8)]
    feed.add([(1, 10, "remove", "d0"), (1, 11, "add", "d8"), (1, 12, "add", "d9")])
    assert run() == [f"d{i}" for i in range(1, 9)]


@pytest.mark.parametrize("url, status", [("/", 200), ("/DOCS", 200), ("/x", 404), ("/../x", 403)])
def test_routing(spark, url, status):
    files = spark.createDataFrame([("s", "index.html"), ("s", "docs/index.html")], "site string, rel string")
    asked = spark.createDataFrame([("s", url)], "site string, url string")
    assert jobs.route_stream(asked, files).first()["status"] == status


def test_given_tables_are_streamed_from_one_file_or_a_folder_of_files(spark, tmp_path):
    schema = "page_id long, url string, html string"
    pages = [(1, "https://h.example/a.html", "1"), (2, "https://h.example/b/", "2"), (3, "https://i.example/a.html", "3")]
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    spark.createDataFrame(pages, schema).coalesce(1).write.parquet(str(tmp_path / "one"))
    whole.mkdir()
    next((tmp_path / "one").glob("part-*")).rename(whole / "pages.parquet")
    # A table whose name ends alike is another one.
    spark.createDataFrame([(9, "https://x.example/", "9")], schema).write.parquet(str(parts / "old_pages.parquet"))
    spark.createDataFrame(pages, schema).repartition(2, "page_id").write.parquet(str(parts / "pages.parquet"))
    for folder in (whole, parts):
        rows = stream_plans.stream_pages(spark, str(folder)).collect()
        assert sorted((r["page_id"], r["site"], r["rel"]) for r in rows) == [
            (1, "h.example", "a.html"), (2, "h.example", "b/index.html"), (3, "i.example", "a.html")
        ]
        newest = stream_plans.stream_latest(spark, str(folder)).collect()
        assert sorted((r["rel"], r["page_id"]) for r in newest) == [("a.html", 3), ("b/index.html", 2)]


def test_a_response_silent_for_just_ten_minutes_is_not_given_up(spark, tmp_path):
    # Of the newest response 13 the watermark stands at 12; 2 never ends and is silent until then.
    turns = [(i, t, "user", "x") for i in range(14) for t in range(2)]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["request_id"]: r["status"] for r in stream_plans.stream_chat(spark, str(tmp_path)).collect()}
    assert sorted(found) == [i for i in range(14) if i not in (2, 7, 12)]
    # One more minute and it is.
    later = tmp_path / "later"
    more = spark.createDataFrame([(14, t, "user", "x") for t in range(2)], table.schema)
    table.unionByName(more).write.parquet(str(later / "conversations.parquet"))
    found = {r["request_id"]: r["status"] for r in stream_plans.stream_chat(spark, str(later)).collect()}
    assert found[2] == "unfinished" and sorted(found) == [i for i in range(15) if i not in (7, 12)]
