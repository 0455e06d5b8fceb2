"""Queries about archives: records, members, sites on disk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.constants import ENTRY_NAMES
from sitelake.functions.paths import url_to_rel as to_rel
from sitelake.operators import archives, catalog, ordering
from sitelake.plans.register import Plan
from sitelake.plans.tables import (
    SQL_FILES,
    SQL_MEMBERS,
    SQL_REL,
    SQL_WORD_SITE,
    members,
    paged,
    site_files,
    table,
    word_site,
)
from sitelake.session import new_folder
from sitelake.sources.folders import read_folder, to_docs
from sitelake.sources.sites import read_site, write_site
from sitelake.sources.warc import read_warc
from sitelake.sources.zips import read_zip_catalog, read_zip_members

plan = Plan()
QUERIES, ORACLE, query = plan.queries, plan.oracle, plan.query


# --- WARC records made of pages -------------------------------------------------
# Every seventh is a failed response, every fifth a resource, every eleventh a
# record that is no web page, every thirteenth plain text.

SQL_RECORDS = """
records AS (
  SELECT page_id, url, html, page_id % 5 = 0 AS resource,
         CASE WHEN page_id % 7 = 3 THEN 404 ELSE 200 END AS status,
         CASE WHEN page_id % 13 = 2 THEN 'text/plain' ELSE 'text/html; charset=utf-8' END AS ctype,
         page_id % 11 = 4 AS odd FROM pages),
kept AS (SELECT * FROM records WHERE NOT odd AND (resource OR status = 200))"""


def warc_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        F.col("page_id"),
        "html",
        F.when(F.col("page_id") % 5 == 0, "resource").otherwise("response").alias("warc_type"),
        F.when(F.col("page_id") % 11 == 4, F.concat(F.lit("urn:pageinfo:"), "url")).otherwise(F.col("url")).alias("target_uri"),
        F.when(F.col("page_id") % 7 == 3, "404 Not Found").otherwise("200 OK").alias("status_line"),
        F.when(F.col("page_id") % 13 == 2, "text/plain").otherwise("text/html; charset=utf-8").alias("ctype"),
    )


def http_body(fields: DataFrame) -> DataFrame:
    response = F.concat(
        F.lit("HTTP/1.1 "), "status_line", F.lit("\r\nServer: café é ü\r\nContent-Type: "), "ctype", F.lit("\r\n\r\n"), "html"
    )
    return fields.withColumn(
        "body", F.when(F.col("warc_type") == "resource", F.col("html")).otherwise(response)
    )


def record_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records as rows, without files."""
    return http_body(warc_fields(spark, sf_dir)).select(
        "page_id",
        "warc_type",
        "target_uri",
        F.create_map(F.lit("content-type"), "ctype").alias("headers"),
        F.col("body").cast("binary").alias("body"),
    )


def write_warcs(spark: SparkSession, sf_dir: str) -> str:
    """Write the records as gzipped WARC files with Spark's text writer."""
    rows = http_body(warc_fields(spark, sf_dir))
    record = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), "warc_type", F.lit("\r\nWARC-Target-URI: <"), "target_uri",
        F.lit(">\r\nWARC-Record-ID: "), "page_id", F.lit("\r\nContent-Type: "),
        F.when(F.col("warc_type") == "resource", F.col("ctype")).otherwise(F.lit("application/http;msgtype=response")),
        F.lit("\r\nContent-Length: "), F.octet_length("body").cast("string"), F.lit("\r\n\r\n"), "body", F.lit("\r\n"),
    )
    folder = new_folder(spark, "warcs")
    (
        rows.repartition(F.col("page_id"))
        .select(record.alias("value"))
        .write.option("lineSep", "\r\n")
        .option("compression", "gzip")
        .text(folder)
    )
    return folder


KEPT_COLUMNS = ["url", "warc_type", "status", "content_type", "as_html", "rel", "bytes", "digest"]


def kept_summary(kept: DataFrame) -> DataFrame:
    return kept.select(
        F.btrim("target_uri", F.lit("<>")).alias("url"),
        "warc_type",
        "status",
        "content_type",
        "as_html",
        "rel",
        F.length("payload").cast("bigint").alias("bytes"),
        F.md5("payload").alias("digest"),
    )


SQL_KEPT = f"""
WITH {SQL_RECORDS}
SELECT url, CASE WHEN resource THEN 'resource' ELSE 'response' END AS warc_type,
  CASE WHEN NOT resource THEN status END AS status, ctype AS content_type, ctype LIKE 'text/html%' AS as_html,
  CASE WHEN ctype LIKE 'text/html%' THEN {SQL_REL}
       ELSE CASE WHEN regexp_extract(url, '^[^:]*://[^/]*/?([^?#]*)', 1) LIKE '%/' THEN {SQL_REL}
            ELSE regexp_extract(url, '^[^:]*://[^/]*/?([^?#]*)', 1) END END AS rel,
  CAST(octet_length(encode(html)) AS BIGINT) AS bytes, md5(html) AS digest
FROM kept
"""


@query(SQL_KEPT)
def keep_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_summary(archives.keep_responses(record_rows(spark, sf_dir)))


@query(SQL_KEPT)
def warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC files by Spark and read back as records."""
    records = read_warc(spark, write_warcs(spark, sf_dir) + "/part-*", types=("response", "resource"))
    return kept_summary(archives.keep_responses(records))


@query(
    f"""
SELECT url, {SQL_REL} AS as_page, CASE WHEN regexp_extract(url, '^[^:]*://[^/]*/?([^?#]*)', 1) LIKE '%/' THEN {SQL_REL}
  ELSE regexp_extract(url, '^[^:]*://[^/]*/?([^?#]*)', 1) END AS as_file FROM pages
"""
)
def url_to_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "url", to_rel(url, F.lit(True)).alias("as_page"), to_rel(url, F.lit(False)).alias("as_file")
    )


@query("SELECT DISTINCT regexp_extract(url, '([a-z]+)(/|$)', 1) AS site, regexp_extract(url, '^[a-z]+://[^/]*') AS origin FROM (SELECT regexp_extract(url, '^[a-z]+://[^/]*') AS url FROM pages)")
def origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct origins per site, a site being all hosts of a top-level domain."""
    pages = table(spark, sf_dir, "pages").select(
        F.regexp_extract(F.regexp_extract("url", "^[a-z]+://[^/]*", 0), "([a-z]+)$", 1).alias("site"),
        F.upper(F.regexp_extract("url", "^[a-z]+", 0)).alias("scheme"),
        F.regexp_extract("url", "^[a-z]+(.*)$", 1).alias("rest"),
        F.lit(True).alias("as_html"),
    )
    return archives.site_origins(pages.withColumn("target_uri", F.concat(F.lit("<"), "scheme", "rest", F.lit(">"))))


@query(
    f"""
SELECT {SQL_REL} AS rel, max(page_id) AS page_id, max_by(url, page_id) AS url, max_by(length(html), page_id) AS chars
FROM pages GROUP BY 1
"""
)
def latest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hosts as one site: the last page stored under each path wins."""
    pages = paged(spark, sf_dir).withColumn("site", F.lit("all")).withColumn("chars", F.length("html").cast("bigint"))
    return archives.latest_rows(pages.select("site", "rel", "page_id", "url", "chars"), "page_id").drop("site")


@query(
    """
WITH records AS (SELECT page_id AS seq, rtrim(regexp_extract(url, '^[^:]*://[^/]*/([^?#]*)', 1), '/')
    || CASE page_id % 4 WHEN 1 THEN '/part' WHEN 2 THEN '/part/a.html' ELSE '' END AS rel FROM pages),
firsts AS (SELECT rel, min(seq) AS first FROM records GROUP BY rel),
below AS (SELECT a.rel, a.first, min(b.first) AS below FROM firsts a JOIN firsts b ON starts_with(b.rel, a.rel || '/') GROUP BY ALL),
owners AS (SELECT rel FROM below WHERE below >= first),
dropped AS (SELECT rel FROM below WHERE below < first
            UNION SELECT f.rel FROM firsts f JOIN owners o ON starts_with(f.rel, o.rel || '/'))
SELECT seq, rel FROM records WHERE rel NOT IN (SELECT rel FROM dropped)
"""
)
def path_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and folders that claim the same path: the first one stays."""
    rel = F.concat(
        F.rtrim(F.regexp_extract("url", "^[^:]*://[^/]*/([^?#]*)", 1), F.lit("/")),
        F.expr("CASE page_id % 4 WHEN 1 THEN '/part' WHEN 2 THEN '/part/a.html' ELSE '' END"),
    )
    records = table(spark, sf_dir, "pages").select(F.lit("all").alias("site"), rel.alias("rel"), F.col("page_id").alias("seq"))
    return archives.drop_path_clashes(records).select("seq", "rel")


@query(
    """
WITH sites AS (SELECT regexp_extract(url, '^[^:]*://([^/]*)', 1) AS site, page_id, url, html FROM pages),
origins AS (SELECT DISTINCT site, regexp_extract(url, '^[a-z]+://[^/]*') AS origin FROM sites),
lists AS (SELECT site, list(origin ORDER BY length(origin) DESC, origin) AS origins FROM origins GROUP BY site),
texts AS (SELECT page_id, site, replace(html, '<body>', '<body><a href="' || url || '">me</a><img src="//' || site
    || '/x/Figures/f' || page_id || '.png"><img src="https://cdn.example/a/Figures/g.png?w=1">') AS text FROM sites)
SELECT page_id, md5(regexp_replace(list_reduce(list_prepend(text, origins),
    lambda acc, o: replace(replace(acc, o, ''), '//' || split_part(o, '://', 2), '')),
  'https?://[^"'' )<>?#]*?/Figures/([^"'' )<>?#]*)', 'figures/\\1', 'g')) AS digest
FROM texts JOIN lists USING (site)
"""
)
def rewrite_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that name their own site and remote figures, made relative."""
    sites = table(spark, sf_dir, "pages").select(
        "page_id", "url", "html", F.regexp_extract("url", "^[^:]*://([^/]*)", 1).alias("site")
    )
    found = archives.site_origins(sites.select("site", F.col("url").alias("target_uri"), F.lit(True).alias("as_html")))
    head = F.concat(
        F.lit('<body><a href="'), "url", F.lit('">me</a><img src="//'), "site", F.lit("/x/Figures/f"), "page_id",
        F.lit('.png"><img src="https://cdn.example/a/Figures/g.png?w=1">'),
    )
    texts = sites.select("page_id", "site", F.lit("x.html").alias("rel"), F.replace("html", F.lit("<body>"), head).alias("text"))
    return archives.rewrite_site(texts, found).select("page_id", F.md5("text").alias("digest"))


@query(
    f"""
WITH {SQL_WORD_SITE}
SELECT DISTINCT site, rel FROM docs d WHERE rel <> 'index.html' AND site <> 'site0' AND NOT contains(rel, '/')
"""
)
def seed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites 1 and 2 lose their entry page; site 0 keeps it and has no seeds."""
    files = word_site(spark, sf_dir).filter("site = 'site0' OR rel <> 'index.html'")
    return ordering.seed_pages(files, ENTRY_NAMES)


@query(
    """
WITH names AS (SELECT DISTINCT regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1) AS name FROM pages
  UNION SELECT regexp_extract(url, '^[^:]*://([^/.]*)', 1) || '-' || regexp_extract(url, '([^/?#]*)/?(?:[?#].*)?$', 1) FROM pages),
keyed AS (SELECT name, TRY_CAST(regexp_extract(name, '^[0-9]+') AS BIGINT) AS n FROM names)
SELECT name, row_number() OVER (ORDER BY CASE WHEN n IS NOT NULL THEN 1 WHEN name < '0' THEN 0 ELSE 2 END, n, name) AS pos FROM keyed
"""
)
def natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1)
    pages = table(spark, sf_dir, "pages")
    names = pages.select(last.alias("name")).union(
        pages.select(F.concat(F.regexp_extract("url", "^[^:]*://([^/.]*)", 1), F.lit("-"), last))
    )
    rows = names.distinct().withColumn("all", F.lit(1))
    return ordering.ranked(rows, ["all"], ordering.natural_key(F.col("name")), "pos").select("name", "pos")


# --- members -------------------------------------------------------------------------


@query(
    """
WITH raw AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_brand || '\\' || p_name || '.html' WHEN 1 THEN '/' || p_type || '/' || p_name || '/'
    WHEN 2 THEN p_type || '/../' || p_name WHEN 3 THEN p_type || '//' || p_name WHEN 4 THEN './' || p_name ELSE p_name END AS name FROM part),
clean AS (SELECT *, trim(replace(name, '\\', '/'), '/') AS rel FROM raw)
SELECT p_partkey, rel, name LIKE '%/' AS is_dir FROM clean
WHERE rel <> '' AND len(list_filter(string_split(rel, '/'), lambda s: s IN ('', '.', '..'))) = 0
"""
)
def normalize_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").selectExpr(
        "p_partkey",
        r"""CASE p_partkey % 6 WHEN 0 THEN concat(p_brand, '\\', p_name, '.html') WHEN 1 THEN concat('/', p_type, '/', p_name, '/')
        WHEN 2 THEN concat(p_type, '/../', p_name) WHEN 3 THEN concat(p_type, '//', p_name)
        WHEN 4 THEN concat('./', p_name) ELSE p_name END AS name""",
    )
    return archives.normalize_members(raw).select("p_partkey", "rel", "is_dir")


SQL_CLASSIFY = f"""
WITH {SQL_MEMBERS},
segs AS (SELECT archive, rel, is_dir, string_split(rel, '/') AS s FROM members),
cut AS (SELECT archive, rel, is_dir, s, unnest(range(len(s))) AS d FROM segs),
seen AS (
  SELECT archive, d, array_to_string(s[1:d], '/') AS prefix, s[d + 1] AS child, is_dir OR d + 1 < len(s) AS nested, is_dir,
         s[len(s)] AS name, len(list_filter(s[d + 1:], lambda x: x = '__MACOSX' OR starts_with(x, '.'))) = 0 AS clear
  FROM cut WHERE len(list_filter(s[1:d], lambda x: x = '__MACOSX' OR starts_with(x, '.'))) = 0),
folders AS (
  SELECT archive, d, prefix,
    min(CASE lower(child) WHEN 'ouvrir.html' THEN 0 WHEN 'index.html' THEN 1 END) FILTER (WHERE NOT nested) AS rank,
    min(child) FILTER (WHERE NOT nested AND lower(child) = 'ouvrir.html') AS first_entry,
    min(child) FILTER (WHERE NOT nested AND lower(child) = 'index.html') AS second_entry,
    count(*) FILTER (WHERE NOT nested AND child <> '__MACOSX' AND NOT starts_with(child, '.')) AS n_files,
    count(DISTINCT child) FILTER (WHERE nested AND child <> '__MACOSX' AND NOT starts_with(child, '.')) AS n_dirs,
    coalesce(bool_or(clear AND NOT is_dir AND lower(name) LIKE '%_.md'), false) AS notes
  FROM seen GROUP BY ALL),
ends AS (SELECT archive, min_by(prefix, d) AS root,
    min_by(CASE WHEN rank IS NOT NULL THEN 'site' WHEN notes THEN 'notes' ELSE 'none' END, d) AS kind,
    min_by(coalesce(first_entry, second_entry, ''), d) AS entry
  FROM folders WHERE rank IS NOT NULL OR n_files > 0 OR n_dirs <> 1 GROUP BY archive),
roots AS (
  SELECT archive, CASE WHEN coalesce(kind, 'none') <> 'none' THEN root END AS root, coalesce(kind, 'none') AS kind,
         CASE WHEN kind = 'site' THEN entry END AS entry
  FROM (SELECT DISTINCT archive FROM members) LEFT JOIN ends USING (archive))"""


@query(SQL_CLASSIFY + " SELECT archive, root, kind, entry FROM roots")
def classify_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.classify_archives(archives.normalize_members(members(spark, sf_dir)))


@query(
    SQL_CLASSIFY
    + """
SELECT archive, CASE WHEN root = '' THEN rel ELSE substr(rel, length(root) + 2) END AS rel, is_dir
FROM members JOIN roots USING (archive) WHERE root IS NOT NULL AND (root = '' OR starts_with(rel, root || '/'))
"""
)
def rebase_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archives.normalize_members(members(spark, sf_dir))
    return archives.rebase(rows, archives.classify_archives(rows)).select("archive", "rel", "is_dir")


@query(
    f"""
WITH {SQL_MEMBERS},
above AS (SELECT archive, string_split(rel, '/') AS s FROM members)
SELECT archive AS site, rel AS dir FROM members WHERE is_dir
UNION SELECT archive, array_to_string(s[1:i], '/') FROM (SELECT archive, s, unnest(range(1, len(s))) AS i FROM above)
"""
)
def dir_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archives.normalize_members(members(spark, sf_dir))
    return catalog.dir_table(rows.withColumnRenamed("archive", "site"))


LISTING = (
    "CASE page_id % 9 WHEN 0 THEN concat({host}, '.wacz') WHEN 1 THEN 'x.WACZ' WHEN 2 THEN 'archive/y.warc.gz' WHEN 3 THEN 'z.warc'"
    " WHEN 4 THEN 'w.zip' WHEN 5 THEN 'deep/n.md' WHEN 6 THEN 'photo.png' WHEN 7 THEN 'a.wacz' ELSE 'index.html' END"
)
SQL_HOST = "regexp_extract(url, '^[^:]*://([^/]*)', 1)"


@query(
    f"""
WITH listing AS (SELECT {SQL_HOST} AS host, {SQL_HOST} || '/' || (page_id % 4) AS folder, {LISTING.format(host="CAST(page_id % 4 AS VARCHAR)")} AS path FROM pages),
best AS (SELECT folder, min(CASE WHEN path = 'index.html' THEN [0::VARCHAR, ''] WHEN path = split_part(folder, '/', 2) || '.wacz' THEN ['1', path]
   WHEN lower(path) LIKE '%.wacz' THEN ['2', path] WHEN path LIKE 'archive/%' THEN ['3', path] WHEN path LIKE '%.warc' THEN ['4', path]
   WHEN path LIKE '%.zip' THEN ['5', path] WHEN path LIKE '%.md' THEN ['6', ''] END) AS b FROM listing GROUP BY folder)
SELECT folder, b[2] AS chosen, CASE WHEN b[2] = '' THEN split_part(folder, '/', 2)
  WHEN b IS NOT NULL THEN regexp_replace(regexp_extract(b[2], '[^/]*$'), '\\.[^.]*$', '') END AS site FROM best
"""
)
def select_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collection folder per host and shelf, listing what its pages became."""
    listing = table(spark, sf_dir, "pages").selectExpr(
        f"concat({SQL_HOST}, '/', page_id % 4) AS folder",
        LISTING.format(host="CAST(page_id % 4 AS STRING)") + " AS path",
        "true AS is_file",
    )
    return archives.select_archive(listing)


# --- files on disk ---------------------------------------------------------------------


def write_zips(spark: SparkSession, sf_dir: str) -> str:
    """Each task packs its pages into zip files of at most one Arrow batch."""
    folder = new_folder(spark, "zips")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        from sitelake.sources.files import file_system

        for frame in frames:
            if frame.empty:
                continue
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("pages/", "")
                for page_id, html in zip(frame["page_id"], frame["html"]):
                    archive.writestr(f"pages/p{page_id}.html", html)
            system, path = file_system(f"{folder}/pages-{min(frame['page_id'])}.zip")
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as out:
                out.write(data.getvalue())
            yield frame[["page_id"]]

    table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(pack, "page_id long").write.format(
        "noop"
    ).mode("overwrite").save()
    return folder


@query(
    """
SELECT 'pages/p' || page_id || '.html' AS name, CAST(octet_length(encode(html)) AS BIGINT) AS size, false AS is_dir FROM pages
UNION ALL SELECT DISTINCT 'pages/', CAST(0 AS BIGINT), true FROM pages
"""
)
def zip_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of zip files of pages, from their central directories alone."""
    return read_zip_catalog(spark, write_zips(spark, sf_dir)).select("name", "size", "is_dir").distinct()


@query(
    """
SELECT 'pages/p' || page_id || '.html' AS name, CAST(octet_length(encode(html)) AS BIGINT) AS size, md5(html) AS digest, false AS truncated FROM pages
"""
)
def zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_zip_members(spark, write_zips(spark, sf_dir))
    return found.select("name", "size", F.md5("content").alias("digest"), "truncated")


def write_files(site_files: DataFrame) -> str:
    """Files ``(site, rel, html)`` written one by one below a folder for each site."""
    spark = site_files.sparkSession
    folder = new_folder(spark, "folder")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sitelake.sources.files import file_system

        system, top = file_system(folder)
        for batch in batches:
            # Row by row out of the batch, so that no second copy of it is held.
            for site, rel, html in zip(batch.column("site"), batch.column("rel"), batch.column("html")):
                path = f"{top}/{site}/{rel}"
                system.create_dir(path.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(path) as out:
                    out.write(html.as_buffer())
            yield batch.select(["site"])

    site_files.select("site", "rel", "html").mapInArrow(save, "site string").write.format("noop").mode("overwrite").save()
    return folder


@query(
    f"""
WITH {SQL_FILES}
SELECT CASE length(rel) % 3 WHEN 0 THEN '_static/' WHEN 1 THEN '.well-known/' ELSE '' END || site || '/' || rel AS rel,
       CAST(octet_length(encode(html)) AS BIGINT) AS size, md5(html) AS digest, 'html' AS kind, false AS truncated FROM files
"""
)
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site files written one by one, listed and read back as documents."""
    top = F.element_at(F.array(F.lit("_static/"), F.lit(".well-known/"), F.lit("")), F.length("rel") % 3 + 1)
    folder = write_files(site_files(spark, sf_dir).withColumn("site", F.concat(top, "site")))
    files = read_folder(spark, folder, "folder")
    docs = to_docs(files)
    return docs.select(
        "rel",
        F.octet_length("text").cast("bigint").alias("size"),
        F.md5("text").alias("digest"),
        "kind",
        "truncated",
    )


@query(
    f"""
WITH {SQL_FILES}
SELECT site, rel, url, CAST(octet_length(encode(html)) AS BIGINT) AS size, md5(html) AS digest FROM files
"""
)
def site_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assembled site files written as tables and read back with payloads."""
    folder = new_folder(spark, "sites")
    files = site_files(spark, sf_dir).select("site", "rel", "url", F.col("html").cast("binary").alias("payload"))
    write_site(files, folder, by_site=False)
    return read_site(spark, folder, payload=True).select("site", "rel", "url", "size", F.md5("payload").alias("digest"))
