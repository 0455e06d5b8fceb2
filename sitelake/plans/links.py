"""Queries about links: extraction, resolution, lookup, crawls, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions.paths import (
    answer_link,
    content_type,
    doc_kind,
    note_link_allowed,
    percent_decode,
    percent_encode,
    percent_encode_path,
)
from sitelake.operators import audit, catalog, crawl as crawling, ingest, ordering
from sitelake.operators.parse import anchor_rows, link_rows, parse_docs
from sitelake.operators.resolve import resolve_links as resolve, with_page_base
from sitelake.plans.archives import write_files
from sitelake.plans.register import Plan
from sitelake.plans.tables import (
    SQL_FILES,
    SQL_FOLD,
    SQL_WORD_LINKS,
    SQL_WORD_SITE,
    as_docs,
    site_files,
    table,
    word_entries,
    word_site,
)
from sitelake.sources.folders import read_folder, read_named, to_docs

plan = Plan()
QUERIES, ORACLE, query = plan.queries, plan.oracle, plan.query


def html_docs(files: DataFrame) -> DataFrame:
    return files.select("site", "rel", F.lit("html").alias("kind"), F.col("html").alias("text"))


@query(
    """
WITH found AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM pages)
SELECT page_id, 'a' AS tag, 'href' AS attr, CAST(unnest(range(len(hrefs))) AS BIGINT) AS pos, unnest(hrefs) AS href FROM found
"""
)
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "pages").select(
        "page_id", F.lit("html").alias("kind"), F.col("html").alias("text")
    )
    return link_rows(parse_docs(docs)).select(
        "page_id", "tag", "attr", F.col("pos").cast("bigint").alias("pos"), "href"
    )


@query(
    f"""
WITH {SQL_WORD_SITE},
ids AS (SELECT site, rel, unnest(regexp_extract_all(html, ' id="([^"]+)"', 1)) AS fragment FROM docs)
SELECT DISTINCT site, rel, fragment FROM ids
"""
)
def extract_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchor_rows(parse_docs(html_docs(word_site(spark, sf_dir))), "site", "rel", F.col("rel").alias("page")).select(
        "site", "rel", "fragment"
    )


@query(
    """
WITH sheets AS (
  SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS words FROM pages),
rows AS (SELECT page_id, len(words) AS n, unnest(range(len(words))) AS i, unnest(words) AS word FROM sheets)
SELECT page_id, CAST(i AS BIGINT) AS pos,
       CASE WHEN i % 3 = 0 THEN word || '.css' WHEN i % 3 = 1 THEN 'img/' || word || '.png' ELSE word || ' x.woff' END AS href
FROM rows
"""
)
def css_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Style sheets made of each page's words: imports, raw and quoted URLs."""
    words = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))
    rule = F.transform(
        words,
        lambda word, i: F.when(i % 3 == 0, F.concat(F.lit('@import "'), word, F.lit('.css";\n')))
        .when(i % 3 == 1, F.concat(F.lit(".a{background:URL( img/"), word, F.lit('.png )} /* url(no) */\n')))
        .otherwise(F.concat(F.lit("@font-face{src:url('"), word, F.lit(" x.woff')} p::before{content:\"url(no)\"}\n"))),
    )
    sheets = table(spark, sf_dir, "pages").select(
        "page_id", F.lit("css").alias("kind"), F.array_join(rule, "").alias("text")
    )
    return link_rows(parse_docs(sheets)).select("page_id", F.col("pos").cast("bigint").alias("pos"), "href")


SQL_RESOLVE = f"""
WITH {SQL_FILES},
found AS (SELECT site, rel, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS words FROM files),
links AS (SELECT site, rel, unnest(range(len(words))) AS pos, unnest(words) AS word FROM found),
forms AS (
  SELECT *, CASE pos % 8 WHEN 0 THEN '/' || word WHEN 1 THEN '../' || word || '/' WHEN 2 THEN word || '?q=1#a%20b'
       WHEN 3 THEN 'https://h.example/' || word || '#x' WHEN 4 THEN 'mailto:' || word WHEN 5 THEN '../../../../' || word
       WHEN 6 THEN 'https:' || word ELSE '.\\x\\..\\' || word END AS href,
       array_to_string(list_slice(string_split(rel, '/'), 1, len(string_split(rel, '/')) - 1), '/') AS folder
  FROM links),
parts AS (SELECT *, string_split(folder, '/') AS f FROM forms)
SELECT site, rel, CAST(pos AS BIGINT) AS pos, href,
  CASE pos % 8 WHEN 3 THEN 'external' WHEN 4 THEN 'skip' WHEN 5 THEN 'escape' WHEN 6 THEN 'external' ELSE 'local' END AS cls,
  CASE pos % 8 WHEN 3 THEN 'https://h.example/' || word WHEN 6 THEN 'https://' || word || '/' END AS external,
  CASE pos % 8 WHEN 0 THEN word
    WHEN 1 THEN ltrim(array_to_string(list_slice(f, 1, len(f) - 1), '/') || '/' || word, '/')
    WHEN 2 THEN folder || '/' || word
    WHEN 5 THEN repeat('../', CAST(4 - len(f) AS INTEGER)) || word
    WHEN 7 THEN folder || '/' || word END AS path,
  CASE pos % 8 WHEN 2 THEN 'a b' END AS fragment
FROM parts
"""


@query(SQL_RESOLVE)
def resolve_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of many forms made of each page's words, resolved on their page."""
    words = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))
    pos, word = F.col("pos"), F.col("word")
    rows = site_files(spark, sf_dir).select("site", "rel", F.posexplode(words).alias("pos", "word"))
    href = F.expr(
        r"""CASE pos % 8 WHEN 0 THEN concat('/', word) WHEN 1 THEN concat('../', word, '/')
        WHEN 2 THEN concat(word, '?q=1#a%20b') WHEN 3 THEN concat('https://h.example/', word, '#x')
        WHEN 4 THEN concat('mailto:', word) WHEN 5 THEN concat('../../../../', word)
        WHEN 6 THEN concat('https:', word) ELSE concat('.\\x\\..\\', word) END"""
    )
    links = with_page_base(
        rows.select("site", "rel", "pos", href.alias("href"), F.lit(None).cast("string").alias("base_href")), "rel"
    )
    t = F.col("target")
    return resolve(links).select(
        "site",
        "rel",
        pos.cast("bigint").alias("pos"),
        "href",
        t["cls"].alias("cls"),
        t["url"].alias("external"),
        t["path"].alias("path"),
        t["fragment"].alias("fragment"),
    )


@query(
    """
WITH raw AS (SELECT doc_id, text AS name FROM documents)
SELECT doc_id, url_encode(name) AS encoded, name || '%zz 100%' AS decoded FROM raw
"""
)
def percent_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts encoded, and decoded again with stray percent signs behind."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("name"))
    encoded = docs.withColumn("encoded", percent_encode(F.col("name")))
    return encoded.select(
        "doc_id", "encoded", percent_decode(F.concat("encoded", F.lit("%zz 100%"))).alias("decoded")
    )


@query(
    """
WITH found AS (SELECT page_id, regexp_extract_all(html, '<a href="/([^"]*)"', 1) AS words FROM pages),
links AS (SELECT page_id, unnest(range(len(words))) AS pos, unnest(words) AS word FROM found)
SELECT page_id, CAST(pos AS BIGINT) AS pos, pos % 6 NOT IN (2, 3) AS in_note,
  CASE pos % 6 WHEN 0 THEN 'https://h.example/' || word ELSE '#' END AS in_answer FROM links
"""
)
def link_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))
    links = table(spark, sf_dir, "pages").select("page_id", F.posexplode(words).alias("pos", "word"))
    dest = F.expr(
        """CASE pos % 6 WHEN 0 THEN concat(' https://h.example/', word) WHEN 1 THEN concat('sub/', word)
        WHEN 2 THEN concat('//h.example/', word) WHEN 3 THEN concat('javascript:', word)
        WHEN 4 THEN concat('#', word) ELSE concat('HTTP://h.example/', word, ' x') END"""
    )
    return links.select(
        "page_id",
        F.col("pos").cast("bigint").alias("pos"),
        note_link_allowed(dest).alias("in_note"),
        answer_link(dest).alias("in_answer"),
    )


EXTENSIONS = ["html", "CSS", "Md", "svg", "js", "png", "xhtml", "bin", "csv", "woff2"]
EXTENSION_CASE = "CASE page_id % 10 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(EXTENSIONS)) + " END"
SQL_STEMS = "regexp_extract(url, '^[^:]*://[^/]*/([^?#/]*/[^?#/.]*)', 1)"


@query(
    f"""
WITH named AS (SELECT page_id, {SQL_STEMS} || '.' || {EXTENSION_CASE} AS rel FROM pages)
SELECT page_id, rel, CASE WHEN lower(rel) LIKE '%.html' OR lower(rel) LIKE '%.xhtml' THEN 'html' WHEN lower(rel) LIKE '%.css' THEN 'css' END AS kind
FROM named
"""
)
def doc_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "pages").selectExpr("page_id", f"concat({SQL_STEMS}, '.', {EXTENSION_CASE}) AS rel")
    return named.withColumn("kind", doc_kind(F.col("rel")))


@query(
    f"""
SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN 'text/css; charset=utf-8'
  WHEN 2 THEN 'text/markdown; charset=utf-8' WHEN 3 THEN 'image/svg+xml; charset=utf-8' WHEN 4 THEN 'text/javascript; charset=utf-8'
  WHEN 5 THEN 'image/png' WHEN 6 THEN 'application/xhtml+xml; charset=utf-8' WHEN 7 THEN 'application/octet-stream'
  WHEN 8 THEN 'text/csv; charset=utf-8' ELSE 'font/woff2' END AS content_type FROM pages
"""
)
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "pages").selectExpr("page_id", f"concat({SQL_STEMS}, '.', {EXTENSION_CASE}) AS rel")
    return named.select("page_id", content_type(F.col("rel")).alias("content_type"))


# --- lookups -------------------------------------------------------------------


@query(
    f"""
WITH {SQL_WORD_LINKS}
SELECT site, url, CAST(pos AS BIGINT) AS pos, path, found FROM links WHERE cls = 'local'
"""
)
def fold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = word_site(spark, sf_dir)
    hrefs = link_rows(parse_docs(html_docs(files))).filter(
        ~F.col("href").startswith("https:") & ~F.col("href").startswith("../")
    )
    targets = hrefs.select(
        "site",
        F.col("rel").alias("url"),
        F.col("pos").cast("bigint").alias("pos"),
        F.ltrim(F.substring_index("href", "#", 1), F.lit("/")).alias("path"),
    )
    return catalog.folded_lookup(targets, files)


SQL_LOCATE = f"""
WITH {SQL_FILES},
targets AS (
  SELECT site, upper(rel) AS path FROM files
  UNION SELECT site, regexp_extract(rel, '^(.*)/index.html$', 1) FROM files
  UNION SELECT site, upper(regexp_extract(rel, '^([^/]*)/', 1)) FROM files
  UNION SELECT site, rel || '/x' FROM files),
folded AS (SELECT site, rel, lower(rel) AS k FROM files),
chosen AS (SELECT site, k, coalesce(min(rel) FILTER (WHERE rel = k), min(rel)) AS rel FROM folded GROUP BY site, k),
dirs AS (SELECT DISTINCT site, lower(list_slice(string_split(rel, '/'), 1, i).array_to_string('/')) AS k
         FROM (SELECT site, rel, unnest(range(1, len(string_split(rel, '/')))) AS i FROM files)),
hits AS (
  SELECT t.site, t.path, CASE WHEN t.path = '' THEN 'index.html' ELSE t.path || '/index.html' END AS idx,
         coalesce(f.rel, c.rel) AS file
  FROM targets t LEFT JOIN files f ON f.site = t.site AND f.rel = t.path
  LEFT JOIN chosen c ON c.site = t.site AND c.k = lower(t.path))
SELECT h.site, h.path, coalesce(h.file, f.rel, c.rel) AS found,
  CASE WHEN coalesce(h.file, f.rel, c.rel) IS NULL THEN CASE WHEN h.path = '' OR d.k IS NOT NULL THEN idx ELSE h.path END END AS missing
FROM hits h LEFT JOIN files f ON f.site = h.site AND f.rel = h.idx
LEFT JOIN chosen c ON c.site = h.site AND c.k = lower(h.idx)
LEFT JOIN dirs d ON d.site = h.site AND d.k = lower(h.path)
"""


@query(SQL_LOCATE)
def locate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = site_files(spark, sf_dir).select("site", "rel")
    forms = F.array(
        F.upper("rel"),
        F.regexp_extract("rel", "^(.*)/index.html$", 1),
        F.upper(F.regexp_extract("rel", "^([^/]*)/", 1)),
        F.concat("rel", F.lit("/x")),
    )
    targets = files.select("site", F.explode(forms).alias("path")).distinct()
    return catalog.locate(targets, files)


@query(
    f"""
WITH {SQL_FILES},
requests AS (
  SELECT site, '/' || upper(rel) || '?v=1' AS url, rel AS hit, 200 AS status FROM files
  UNION ALL SELECT site, '/x/../' || rel, NULL, 403 FROM files
  UNION ALL SELECT site, '/' || replace(rel, '/', '%2F') || '#top', rel, 200 FROM files
  UNION ALL SELECT site, '/nope/' || rel, NULL, 404 FROM files)
SELECT site, url, status, hit AS rel,
  CASE WHEN hit IS NOT NULL THEN 'text/html; charset=utf-8' END AS content_type FROM requests
"""
)
def route_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = site_files(spark, sf_dir).select("site", "rel")
    forms = F.array(
        F.concat(F.lit("/"), F.upper("rel"), F.lit("?v=1")),
        F.concat(F.lit("/x/../"), "rel"),
        F.concat(F.lit("/"), F.replace("rel", F.lit("/"), F.lit("%2F")), F.lit("#top")),
        F.concat(F.lit("/nope/"), "rel"),
    )
    requests = files.select("site", F.explode(forms).alias("url"))
    return catalog.route_requests(requests, files).select(
        "site", "url", "status", "rel", F.when(F.col("rel").isNotNull(), content_type(F.col("rel"))).alias("content_type")
    )


# --- audits --------------------------------------------------------------------

SQL_BROKEN = f"""
WITH {SQL_WORD_LINKS},
broken AS (
  SELECT site, url, pos, href, CASE cls WHEN 'escape' THEN '../../' || regexp_extract(href, '[^/]*$') ELSE path END AS label,
         CASE cls WHEN 'escape' THEN 'escape' ELSE 'missing' END AS reason, '' AS fragment
  FROM links WHERE cls = 'escape' OR (cls = 'local' AND found IS NULL)
  UNION ALL
  SELECT site, url, pos, href, found, 'anchor', fragment FROM links WHERE found IS NOT NULL AND fragment = 'nope'),
keyed AS (SELECT *, CASE reason WHEN 'escape' THEN label ELSE {SQL_FOLD.format("label")} END AS k FROM broken)"""


def audited(spark: SparkSession, sf_dir: str) -> crawling.Crawl:
    files = word_site(spark, sf_dir)
    return crawling.audit_all(as_docs(files), files)


@query(
    SQL_BROKEN
    + """
SELECT site, k AS "key", reason, fragment, count(*) AS source_count,
       CASE reason WHEN 'anchor' THEN min_by(label, (url, pos)) || '#' || fragment ELSE min_by(label, (pos, url, href)) END AS path
FROM keyed GROUP BY site, k, reason, fragment
"""
)
def broken_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.broken_groups(audited(spark, sf_dir).broken()).drop("first")


@query(
    SQL_BROKEN
    + """
SELECT site, k AS "key", reason, fragment, url AS page, href,
       CAST(row_number() OVER (PARTITION BY site, k, reason, fragment ORDER BY pos, url, href) AS BIGINT) AS rank
FROM keyed QUALIFY rank <= 20
"""
)
def broken_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = audit.group_sources(audited(spark, sf_dir).broken())
    return sources.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    f"WITH {SQL_WORD_LINKS} SELECT site, url, found, fragment, href FROM links WHERE found IS NOT NULL AND fragment = 'nope'"
)
def missing_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = audited(spark, sf_dir)
    return audit.missing_anchors(done.links, done.parsed).select("site", "url", "found", "fragment", "href")


@query(
    f"WITH {SQL_WORD_LINKS} SELECT site, count(DISTINCT href) AS external FROM links WHERE cls = 'external' GROUP BY site"
)
def external_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.external_count(audited(spark, sf_dir).links)


@query(
    f"""
WITH {SQL_WORD_LINKS}
SELECT site, found, url AS page, href, count(*) AS links FROM links WHERE found IS NOT NULL GROUP BY ALL
"""
)
def referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.referrers(audited(spark, sf_dir).links)


@query(
    f"""
WITH {SQL_FILES},
found AS (SELECT site, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS path FROM files),
broken AS (SELECT site, {SQL_FOLD.format("path")} AS k, count(*) AS n FROM found f
           WHERE NOT EXISTS (SELECT 1 FROM files x WHERE x.site = f.site AND {SQL_FOLD.format("x.rel")} = {SQL_FOLD.format("f.path")})
           GROUP BY ALL),
damage AS (SELECT site, count(*) AS broken_groups, CAST(sum(n) AS BIGINT) AS broken_links FROM broken GROUP BY site)
SELECT site, count(*) AS pages, CAST(0 AS BIGINT) AS stylesheets, CAST(0 AS BIGINT) AS reached, count(*) AS files,
  CAST(0 AS BIGINT) AS external, coalesce(any_value(broken_groups), 0) AS broken_groups,
  coalesce(any_value(broken_links), 0) AS broken_links, CAST(0 AS BIGINT) AS truncated,
  CASE WHEN coalesce(any_value(broken_links), 0) > 0 THEN 'broken' ELSE 'clean' END AS verdict
FROM files LEFT JOIN damage USING (site) GROUP BY site
"""
)
def audit_all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = site_files(spark, sf_dir).select("site", "rel", "html")
    return crawling.audit_all(as_docs(files), files).report()


# --- crawls --------------------------------------------------------------------

SQL_CRAWL = SQL_WORD_LINKS + """,
edges AS (SELECT site, url, found, min(pos) AS pos FROM links WHERE found IS NOT NULL GROUP BY site, url, found),
walk AS (
  SELECT 'site0' AS site, 'index.html' AS url, 0 AS lvl, [0] AS trail
  UNION ALL SELECT 'site1', 'index.html', 0, [0] UNION ALL SELECT 'site2', 'index.html', 0, [0]),
reach AS (
  SELECT site, url FROM walk
  UNION SELECT e.site, e.found FROM reach r JOIN edges e ON e.site = r.site AND e.url = r.url)"""


def crawled(spark: SparkSession, sf_dir: str) -> crawling.Crawl:
    files = word_site(spark, sf_dir)
    return crawling.crawl(as_docs(files), files, word_entries(files))


# Steps are bounded by the 40 levels no test table comes near.
SQL_LEVELS = (
    "WITH RECURSIVE "
    + SQL_CRAWL
    + """,
steps AS (
  SELECT site, url, 0 AS lvl FROM walk
  UNION SELECT e.site, e.found, s.lvl + 1 FROM steps s JOIN edges e ON e.site = s.site AND e.url = s.url WHERE s.lvl < 40),
levels AS (SELECT site, url, min(lvl) AS lvl FROM steps GROUP BY site, url),
trails AS (
  SELECT site, url, lvl, [CAST(0 AS BIGINT)] AS trail FROM levels WHERE lvl = 0
  UNION ALL
  SELECT site, url, lvl, min(trail) FROM (
    SELECT e.site, e.found AS url, l.lvl, list_append(t.trail, e.pos) AS trail
    FROM trails t JOIN edges e ON e.site = t.site AND e.url = t.url
    JOIN levels l ON l.site = e.site AND l.url = e.found AND l.lvl = t.lvl + 1) GROUP BY site, url, lvl)"""
)


@query(SQL_LEVELS + " SELECT site, url, url AS file, CAST(lvl AS BIGINT) AS lvl FROM levels")
def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawled(spark, sf_dir).visits.select("site", "url", "file", F.col("lvl").cast("bigint").alias("lvl"))


@query(SQL_LEVELS + " SELECT site, url, url AS file, CAST(lvl AS BIGINT) AS lvl FROM levels")
def crawl_lazy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl of site files in a folder, of which only those reached are opened."""
    folder = write_files(word_site(spark, sf_dir))
    top, rest = F.substring_index("rel", "/", 1), F.regexp_extract("rel", "(?s)^[^/]*/(.*)", 1)
    files = read_folder(spark, folder, content=False).select(top.alias("site"), rest.alias("rel"))
    done = crawling.crawl_lazily(lambda wanted: to_docs(read_named(wanted, folder, by_site=True)), files, word_entries(files))
    read = done.parsed.filter("readable").select("site", F.col("rel").alias("file"))
    return done.visits.join(read, ["site", "file"]).select("site", "url", "file", F.col("lvl").cast("bigint").alias("lvl"))


@query(
    SQL_LEVELS
    + " SELECT site, url, CAST(row_number() OVER (PARTITION BY site ORDER BY lvl, trail) AS BIGINT) AS rank FROM trails"
)
def crawl_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = crawled(spark, sf_dir).visits
    return ordering.ranked(visits, ["site"], [F.col("ord")]).select("site", "url", "rank")


@query(
    "WITH RECURSIVE "
    + SQL_CRAWL
    + """
SELECT d.site, d.rel FROM docs d WHERE d.rel <> 'index.html'
  AND NOT EXISTS (SELECT 1 FROM reach r JOIN links l ON l.site = r.site AND l.url = r.url WHERE l.site = d.site AND l.found = d.rel)
"""
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = crawled(spark, sf_dir)
    return audit.orphans(done.catalog, audit.reached_files(done.links, done.entries))


SQL_REPORT = (
    "WITH RECURSIVE "
    + SQL_CRAWL
    + f""",
followed AS (SELECT l.* FROM links l JOIN reach r ON r.site = l.site AND r.url = l.url),
broken AS (
  SELECT site, CASE cls WHEN 'escape' THEN href ELSE {SQL_FOLD.format("path")} END AS k, cls AS reason, '' AS fragment
  FROM followed WHERE cls = 'escape' OR (cls = 'local' AND found IS NULL)
  UNION ALL SELECT site, {SQL_FOLD.format("found")}, 'anchor', fragment FROM followed WHERE found IS NOT NULL AND fragment = 'nope'),
groups AS (SELECT site, k, reason, fragment, count(*) AS n FROM broken GROUP BY ALL)
SELECT s.site,
  (SELECT count(*) FROM reach r WHERE r.site = s.site) AS pages, CAST(0 AS BIGINT) AS stylesheets,
  (SELECT count(*) FROM (SELECT found FROM followed f WHERE f.site = s.site AND found IS NOT NULL UNION SELECT 'index.html')) AS reached,
  (SELECT count(*) FROM docs d WHERE d.site = s.site) AS files,
  (SELECT count(DISTINCT href) FROM followed f WHERE f.site = s.site AND cls = 'external') AS external,
  (SELECT count(*) FROM groups g WHERE g.site = s.site) AS broken_groups,
  (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM groups g WHERE g.site = s.site) AS broken_links,
  CAST(0 AS BIGINT) AS truncated, 'broken' AS verdict
FROM walk s
"""
)


@query(SQL_REPORT)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawled(spark, sf_dir).report()


@query(
    f"""
SELECT site, grouping(site) = 1 AS total, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(stylesheets) AS BIGINT) AS stylesheets,
  CAST(sum(reached) AS BIGINT) AS reached, CAST(sum(files) AS BIGINT) AS files, CAST(sum(external) AS BIGINT) AS external,
  CAST(sum(broken_groups) AS BIGINT) AS broken_groups, CAST(sum(broken_links) AS BIGINT) AS broken_links,
  CAST(sum(truncated) AS BIGINT) AS truncated, min(verdict) AS verdict
FROM ({SQL_REPORT}) GROUP BY ROLLUP (site)
"""
)
def audit_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.with_total(crawled(spark, sf_dir).report())


SUMMARY = ["site", "pages", "reached", "files", "external", "broken_groups", "broken_links", "verdict"]


def summary(found: ingest.Assembly) -> DataFrame:
    """The report of each site with the number of rows that were rejected."""
    counts = found.rejected.groupBy("site").agg(F.count(F.lit(1)).alias("rejected"))
    report = found.audit().report().select(*SUMMARY)
    return report.join(counts, "site", "full").select(*SUMMARY, F.coalesce("rejected", F.lit(0)).alias("rejected"))


@query(f"SELECT {', '.join(SUMMARY)}, CAST(2 AS BIGINT) AS rejected FROM ({SQL_REPORT})")
def audit_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites from archived responses to the audit, in one go.

    Every file has an older version; each site has a response that climbs above
    it and one below a path that is a file.
    """
    files = word_site(spark, sf_dir)
    host = F.concat(F.lit("http://"), "site")
    newest = files.select(
        "site", F.lit(1).alias("seq"), F.concat(host, F.lit("/"), percent_encode_path(F.col("rel"))).alias("target_uri"), "html"
    )
    older = newest.withColumn("seq", F.lit(0)).withColumn("html", F.lit("<a href=old.html>"))
    odd = files.filter("rel = 'index.html'").select(
        "site", F.lit(9).alias("seq"), F.explode(F.array(F.concat(host, F.lit("/a/../../x.html")), F.concat(host, F.lit("/index.html/y.html")))).alias("target_uri"), F.lit("x").alias("html")
    )
    head = F.lit("HTTP/1.1 200 OK\r\nServer: é\r\nContent-Type: text/html\r\n\r\n")
    records = newest.union(older).union(odd).select(
        "site", F.lit("w.warc").alias("file"), "seq", F.lit("response").alias("warc_type"), "target_uri",
        F.create_map(F.lit("content-type"), F.lit("application/http")).alias("headers"),
        F.concat(head, "html").cast("binary").alias("body"),
    )
    return summary(ingest.assemble_records(records, decode_paths=True))


@query(
    f"""
SELECT site || '.zip' AS site, {', '.join(SUMMARY[1:])}, CAST(1 AS BIGINT) AS rejected FROM ({SQL_REPORT})
UNION ALL SELECT 'notes.zip', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1
"""
)
def audit_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of archives to the audit: wrapped sites, unsafe names, and notes that are refused."""
    files = word_site(spark, sf_dir)
    archive = F.concat("site", F.lit(".zip"))
    members = files.select(archive.alias("archive"), F.concat(F.lit("wrap/"), "rel").alias("name"), F.col("html").cast("binary").alias("content"))
    first = files.filter("rel = 'index.html'")
    odd = first.select(archive, F.explode(F.array(F.lit("../up.html"), F.lit("__MACOSX/._x.html"))), F.lit(b"x"))
    notes = table(spark, sf_dir, "pages").select(F.lit("notes.zip"), F.concat(F.lit("n/p"), "page_id", F.lit(".md")), F.col("html").cast("binary"))
    members = members.union(odd).union(notes)
    return summary(ingest.assemble_members(members, members))


@query(
    SQL_LEVELS
    + f""",
ranks AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY lvl, trail) AS n FROM trails),
followed AS (SELECT l.*, r.n FROM links l JOIN ranks r ON r.site = l.site AND r.url = l.url),
broken AS (
  SELECT site, CASE cls WHEN 'escape' THEN href ELSE path END AS label,
         CASE cls WHEN 'escape' THEN href ELSE {SQL_FOLD.format("path")} END AS k, CASE cls WHEN 'escape' THEN 'escape' ELSE 'missing' END AS reason,
         '' AS fragment, n, pos
  FROM followed WHERE cls = 'escape' OR (cls = 'local' AND found IS NULL)
  UNION ALL SELECT site, found || '#nope', {SQL_FOLD.format("found")}, 'anchor', fragment, n, pos FROM followed WHERE found IS NOT NULL AND fragment = 'nope'),
groups AS (SELECT site, k, reason, fragment, min_by(label, (n, pos)) AS path, count(*) AS source_count, min((n, pos)) AS first FROM broken GROUP BY ALL)
SELECT site, CAST(row_number() OVER (PARTITION BY site ORDER BY reason = 'anchor', first) AS BIGINT) AS rank, path, reason, source_count,
  least(source_count, 20) AS shown, count(*) OVER (PARTITION BY site) AS total
FROM groups QUALIFY rank <= 300
"""
)
def broken_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken targets in crawl order, as a report shows them."""
    found = audit.broken_report(crawled(spark, sf_dir).broken())
    return found.select(
        "site",
        F.col("rank").cast("bigint").alias("rank"),
        "path",
        "reason",
        "source_count",
        F.size("sources").cast("bigint").alias("shown"),
        "total",
    )


@query(
    SQL_LEVELS
    + """
SELECT site, url AS file, CAST(row_number() OVER (PARTITION BY site ORDER BY lvl, trail) AS BIGINT) AS pos,
       count(*) OVER (PARTITION BY site) AS total
FROM trails QUALIFY pos <= 400
"""
)
def report_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read, in crawl order, as a report lists them."""
    return crawled(spark, sf_dir).pages().withColumn("pos", F.col("pos").cast("bigint"))


@query(
    """
WITH RECURSIVE edges AS (
  SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst FROM lineitem
  UNION SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem),
reach AS (SELECT 'o' || min(l_orderkey) AS node FROM lineitem
  UNION SELECT e.dst FROM reach r JOIN edges e ON e.src = r.node)
SELECT node FROM reach
"""
)
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything connected to the first order through shared parts."""
    items = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("o"), F.concat(F.lit("p"), "l_partkey").alias("p")
    )
    edges = items.select(F.col("o").alias("src"), F.col("p").alias("dst")).union(
        items.select(F.col("p").alias("src"), F.col("o").alias("dst"))
    )
    seeds = table(spark, sf_dir, "lineitem").agg(F.concat(F.lit("o"), F.min("l_orderkey")).alias("node"))
    return crawling.reachable(edges, seeds).select("node")
