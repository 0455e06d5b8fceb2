"""Tables the queries start from, each derived from the given Parquet files.

Every derivation exists twice: as DataFrame code here and as SQL text in the
checks, so both sides see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions.paths import url_to_rel
from sitelake.operators.archives import latest_payload

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- site files of the crawled pages ---------------------------------------

SQL_REL = """
CASE WHEN regexp_extract(url, '^[^:]*://[^/]*/?([^?#]*)', 1) = '' THEN 'index.html'
     WHEN regexp_extract(url, '^[^:]*://[^/]*/?([^?#]*)', 1) LIKE '%/'
       OR regexp_extract(url, '^[^:]*://[^/]*/?(?:[^?#]*/)?([^/?#]*)', 1) NOT LIKE '%.%'
     THEN rtrim(regexp_extract(url, '^[^:]*://[^/]*/?([^?#]*)', 1), '/') || '/index.html'
     ELSE regexp_extract(url, '^[^:]*://[^/]*/?([^?#]*)', 1) END"""

SQL_FILES = f"""
paged AS (SELECT page_id, url, html, regexp_extract(url, '^[^:]*://([^/]*)', 1) AS site, {SQL_REL} AS rel FROM pages),
files AS (SELECT site, rel, max(page_id) AS page_id, max_by(url, page_id) AS url, max_by(html, page_id) AS html
          FROM paged GROUP BY site, rel)"""


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the site and path they are stored under."""
    return table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        "html",
        F.regexp_extract("url", r"^[^:]*://([^/]*)", 1).alias("site"),
        url_to_rel(F.col("url"), F.lit(True)).alias("rel"),
    )


def site_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per site and path, the newest page winning."""
    return latest_payload(paged(spark, sf_dir), "page_id")


def as_docs(files: DataFrame, text: str = "html") -> DataFrame:
    return files.select(
        "site",
        "rel",
        F.col(text).alias("text"),
        F.lit(False).alias("truncated"),
        F.lit(True).alias("readable"),
    )


# --- sites whose links lead somewhere ---------------------------------------
# The pages of a site form a tree by number, below `index.html`; each page is
# also stored under the first word it links to. Word links are respelled so that
# they hit files, case variants, anchors, other hosts and the outside.

SQL_WORD_SITE = r"""
worded AS (
  SELECT page_id, 'site' || (page_id % 3) AS site, page_id // 3 AS k,
         replace(replace(regexp_extract(html, 'href="/([^"]*)"', 1), '.', ''), ',', '') || '.html' AS word,
         replace(replace(
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
           'href="/(de|la|in)"', 'href="../../\1.html"', 'g'),
           'href="/([^",]*),"', 'href="https://ext.example.org/\1"', 'g'),
           'href="/([^".]*)\."', 'href="/\1.html#nope"', 'g'),
           'href="/([A-Z][^".]*)"', 'href="/\1.html#main"', 'g'),
           'href="/([^"./]*)"', 'href="/\1.html"', 'g'),
           '<style>p{margin:0}', '<style>p{background:url(bg.png)}'),
           '<article>', '<article id="main"><a href="/p' || (page_id // 3 * 2 + 1) || '.html#main">1</a>'
             || '<a href="/P' || (page_id // 3 * 2 + 2) || '.HTML#nope">2</a>') AS html
  FROM pages),
named AS (SELECT site, word AS rel, max_by(html, page_id) AS html FROM worded GROUP BY site, word),
docs AS (SELECT site, rel, html FROM named
         UNION ALL SELECT site, CASE k WHEN 0 THEN 'index.html' ELSE 'p' || k || '.html' END, html FROM worded)"""

SQL_FOLD = "translate(nfc_normalize({}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL_WORD_LINKS = SQL_WORD_SITE + r""",
tokens AS (SELECT site, rel AS url, regexp_extract_all(html, 'href="[^"]*"|url\([^)]*\)') AS found FROM docs),
hrefs AS (SELECT site, url, unnest(range(len(found))) AS pos,
                 regexp_replace(regexp_replace(unnest(found), '^(href="|url\()', ''), '["\)]$', '') AS href FROM tokens),
folded AS (SELECT site, rel, {FOLD_REL} AS k FROM docs),
chosen AS (SELECT site, k, coalesce(min(rel) FILTER (WHERE rel = k), min(rel)) AS rel FROM folded GROUP BY site, k),
split AS (
  SELECT site, url, pos, href,
    CASE WHEN href LIKE 'https:%' THEN 'external' WHEN href LIKE '../../%' THEN 'escape' ELSE 'local' END AS cls,
    split_part(ltrim(href, '/'), '#', 1) AS path,
    CASE WHEN contains(href, '#') THEN split_part(href, '#', 2) END AS fragment
  FROM hrefs),
links AS (
  SELECT s.site, s.url, s.pos, s.href, s.cls, s.path, s.fragment,
         CASE WHEN s.cls = 'local' THEN coalesce(d.rel, c.rel) END AS found
  FROM split s
  LEFT JOIN docs d ON s.cls = 'local' AND d.site = s.site AND d.rel = s.path
  LEFT JOIN chosen c ON s.cls = 'local' AND c.site = s.site AND c.k = {FOLD_PATH})""".replace(
    "{FOLD_REL}", SQL_FOLD.format("rel")
).replace("{FOLD_PATH}", SQL_FOLD.format("s.path"))


def word_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(site, rel, html)`` of three sites whose pages link to each other."""
    html = F.col("html")
    for pattern, link in (
        ('href="/(de|la|in)"', 'href="../../$1.html"'),
        ('href="/([^",]*),"', 'href="https://ext.example.org/$1"'),
        (r'href="/([^".]*)\."', 'href="/$1.html#nope"'),
        ('href="/([A-Z][^".]*)"', 'href="/$1.html#main"'),
        ('href="/([^"./]*)"', 'href="/$1.html"'),
    ):
        html = F.regexp_replace(html, pattern, link)
    html = F.replace(html, F.lit("<style>p{margin:0}"), F.lit("<style>p{background:url(bg.png)}"))
    k = F.expr("page_id div 3")
    tree = F.format_string(
        '<article id="main"><a href="/p%d.html#main">1</a><a href="/P%d.HTML#nope">2</a>', k * 2 + 1, k * 2 + 2
    )
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.concat(F.lit("site"), F.col("page_id") % 3).alias("site"),
        F.concat(F.translate(F.regexp_extract("html", 'href="/([^"]*)"', 1), ".,", ""), F.lit(".html")).alias("word"),
        F.when(k == 0, F.lit("index.html")).otherwise(F.concat(F.lit("p"), k, F.lit(".html"))).alias("rel"),
        F.replace(html, F.lit("<article>"), tree).alias("html"),
    )
    named = latest_payload(pages.select("page_id", "site", F.col("word").alias("rel"), "html"), "page_id")
    return named.select("site", "rel", "html").unionByName(pages.select("site", "rel", "html"))


def word_entries(files: DataFrame) -> DataFrame:
    return files.filter("rel = 'index.html'").select("site", F.col("rel").alias("entry"))


# --- archive members from parts ----------------------------------------------

MEMBER_FORMS = {
    "ECONOMY": "concat('site/pages/', p_name, '.html')",
    "SMALL": "'site/Index.HTML'",
    "MEDIUM": "concat('__MACOSX/._', p_name)",
    "LARGE": "concat('site/notes/', p_name, '.md')",
    "PROMO": "'OUVRIR.html'",
}
MEMBER_NAME = (
    "CASE p_type "
    + " ".join(f"WHEN '{kind}' THEN {form}" for kind, form in MEMBER_FORMS.items())
    + " ELSE concat('site/', p_name, '/') END"
)
SQL_MEMBERS = f"""
members AS (SELECT DISTINCT concat(p_brand, '-', p_size) AS archive, rtrim({MEMBER_NAME}, '/') AS rel,
                   ({MEMBER_NAME}) LIKE '%/' AS is_dir FROM part)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of many small archives: wrappers, entries, notes, junk, folders."""
    return (
        table(spark, sf_dir, "part")
        .selectExpr("concat(p_brand, '-', p_size) AS archive", f"{MEMBER_NAME} AS name")
        .distinct()
    )


# --- notes from documents ------------------------------------------------------

NOTE_REL = (
    "concat(source, '/', CASE WHEN doc_id % 5 = 0 THEN 'deep/' ELSE '' END, {slug},"
    " CASE doc_id % 3 WHEN 0 THEN '_grokipedia' WHEN 1 THEN '_wikipedia' ELSE '' END,"
    " CASE WHEN doc_id % 11 = 0 THEN '.MD' WHEN doc_id % 13 = 0 THEN '.png' ELSE '.md' END)"
)
SQL_NOTES = (
    "notes AS (SELECT doc_id, 'notes' AS site, text, "
    + NOTE_REL.format(slug="replace(regexp_extract(text, '[A-Za-z]+ [A-Za-z]+'), '/', ' ')")
    + " AS rel FROM documents)"
)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as notes named after their first two words."""
    slug = "replace(regexp_extract(text, '[A-Za-z]+ [A-Za-z]+', 0), '/', ' ')"
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "'notes' AS site", "text", NOTE_REL.format(slug=slug) + " AS rel"
    )
