"""Streaming forms of the queries, run over whole tables until nothing is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions.paths import doc_kind, url_to_rel
from sitelake.operators import history
from sitelake.operators.archives import latest_rows
from sitelake.operators.ordering import ranked
from sitelake.operators.prompts import parse_chunks
from sitelake.plans import prompts as prompt_plans
from sitelake.plans.archives import write_files
from sitelake.plans.register import Plan
from sitelake.plans.tables import SQL_FILES, SQL_REL, SQL_WORD_LINKS, as_docs, site_files, table, word_site
from sitelake.session import new_folder, stage
from sitelake.streaming import jobs
from sitelake.streaming.logs import drain, rocksdb, stream_folder, stream_table

plan = Plan()
QUERIES, ORACLE, query = plan.queries, plan.oracle, plan.query


def stream_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream, be it one file or a folder of files.

    The path is a pattern that only the table fits: Spark's file streams take no
    path of a single file as it is.
    """
    return stream_table(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema, "*")


def restream(df: DataFrame) -> DataFrame:
    """A derived table as a stream, in as many files as it has partitions."""
    spark = df.sparkSession
    folder = new_folder(spark, "source")
    df.write.parquet(folder)
    return stream_table(spark, folder, df.schema, "part-*.parquet")


def paged(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id",
        "url",
        F.md5("html").alias("digest"),
        F.regexp_extract("url", r"^[^:]*://([^/]*)", 1).alias("site"),
        url_to_rel(F.col("url"), F.lit(True)).alias("rel"),
    )


@query(f"WITH {SQL_FILES} SELECT page_id, url, site, rel, md5(html) AS digest FROM paged")
def stream_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(paged(stream_of(spark, sf_dir, "pages"))).drop("batch")


@query(
    f"""
WITH {SQL_FILES}
SELECT site || '/' || rel AS rel, CAST(octet_length(encode(html)) AS BIGINT) AS size, md5(html) AS digest FROM files
"""
)
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site files as they appear in a folder tree."""
    folder = write_files(site_files(spark, sf_dir))
    files = stream_folder(spark, folder).select("rel", "size", F.md5("content").alias("digest"))
    return drain(files).drop("batch")


@query(f"SELECT {SQL_REL} AS rel, max(page_id) AS page_id, max_by(url, page_id) AS url FROM pages GROUP BY 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hosts as one site; the last version of a path stays."""
    stream = paged(stream_of(spark, sf_dir, "pages")).withColumn("site", F.lit("all")).select("site", "rel", "page_id", "url")
    log = drain(stream, each=lambda batch: latest_rows(batch, "page_id").select("site", "rel", "page_id", "url"))
    return jobs.latest_docs(log, "page_id").select("rel", "page_id", "url")


@query(f"WITH {SQL_WORD_LINKS} SELECT site, url, CAST(pos AS BIGINT) AS pos, href, cls, found FROM links")
def stream_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as a stream, their links located in the static catalog."""
    files = word_site(spark, sf_dir)
    docs = as_docs(files).withColumn("kind", doc_kind(F.col("rel")))
    catalog = stage(files.select("site", "rel"), "catalog")

    def resolved(batch: DataFrame) -> DataFrame:
        found = jobs.batch_links(batch, catalog)
        return found.select("site", "url", F.col("pos").cast("bigint").alias("pos"), "href", "cls", "found")

    schema = spark.createDataFrame([], "site string, url string, pos bigint, href string, cls string, found string").schema
    return drain(restream(docs), schema, resolved).drop("batch")


@query(prompt_plans.ORACLE["current_page"])
def stream_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = prompt_plans.visits(stream_of(spark, sf_dir, "events"))
    log = drain(jobs.current_pages(stream), mode="update")
    return log.groupBy("pack").agg(F.max_by("rel", "batch").alias("rel"))


SQL_LATE = prompt_plans.SQL_CHAT + """,
clock AS (SELECT max(conv_id) AS newest FROM conversations)
SELECT a.* FROM answers a, clock WHERE status <> 'unfinished' OR request_id + 10 < newest - 1"""


@query("WITH " + SQL_LATE)
def stream_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One response starts per minute; silent ones are given up ten minutes on."""
    lines = prompt_plans.chat_lines(spark, sf_dir)
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("request_id") * 60)
    chunks = parse_chunks(lines).withColumn("ts", start)
    with rocksdb(spark):
        found = drain(jobs.chat_answers(restream(chunks)))
    return prompt_plans.answers(found)


@query(
    f"""
WITH {SQL_FILES},
paths AS (SELECT site || '/' || rel AS rel, row_number() OVER (ORDER BY site, rel) - 1 AS n, count(*) OVER () AS total FROM files),
requests AS (SELECT e.ts, CASE e.event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 404 ELSE 200 END AS status FROM events e)
SELECT date_trunc('minute', ts) AS minute, status, count(*) AS requests FROM requests GROUP BY ALL
"""
)
def stream_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests for pages, counted per minute and status.

    Each event asks for one of all pages, taken in turn.
    """
    files = site_files(spark, sf_dir).select(F.lit("all").alias("site"), F.concat("site", F.lit("/"), "rel").alias("rel"))
    files = stage(files, "files")
    total = files.count()
    known = ranked(files, ["site"], [F.col("rel")], "_n").select((F.col("_n") - 1).alias("_n"), F.col("rel").alias("_known"))
    known = stage(known, "known")
    url = (
        F.when(F.col("event_type") == "error", F.lit("/a/../b"))
        .when(F.col("event_type") == "signup", F.concat(F.lit("/none/"), "event_id"))
        .otherwise(F.concat(F.lit("/"), F.upper("_known"), F.lit("?x")))
    )
    events = stream_of(spark, sf_dir, "events").withColumn("_n", F.col("event_id") % total).join(known, "_n", "left")
    events = events.select(F.lit("all").alias("site"), url.alias("url"), F.col("ts").cast("timestamp").alias("ts"))
    routed = jobs.route_stream(events, files)
    log = drain(jobs.status_counts(routed), mode="update")
    newest = log.groupBy("minute", "status").agg(F.max_by("requests", "batch").alias("requests"))
    return newest.withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query(prompt_plans.ORACLE["latest_generation"])
def stream_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as a stream; only those of each key's newest run stay."""
    results = stream_of(spark, sf_dir, "events").selectExpr("user_id AS key", "event_id div 500 AS gen", "event_id", "value")
    log = drain(results, each=lambda batch: history.latest_generation(batch).select("key", "gen", "event_id", "value"))
    return history.latest_generation(log.drop("batch"))


@query(prompt_plans.ORACLE["replay_batches"])
def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running batch of each pack, kept as state."""
    with rocksdb(spark):
        log = drain(jobs.running_batches(restream(prompt_plans.batch_actions(spark, sf_dir))), mode="update")
    newest = log.groupBy("pack").agg(F.max_by("docs", "seq").alias("docs"))
    return newest.select("pack", F.posexplode("docs").alias("slot", "rel")).select(
        "pack", (F.col("slot") + 1).cast("bigint").alias("slot"), "rel"
    )
