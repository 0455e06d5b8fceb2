"""Queries about collections of Markdown notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions.slugs import normalize_slug
from sitelake.functions.text import clean_html, note_title
from sitelake.operators import catalog
from sitelake.operators import notes as ops
from sitelake.operators.parse import note_link_rows
from sitelake.plans.register import Plan
from sitelake.plans.tables import SQL_NOTES, notes, table

plan = Plan()
QUERIES, ORACLE, query = plan.queries, plan.oracle, plan.query

SQL_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
SQL_INDEX = SQL_NOTES + """,
files AS (SELECT DISTINCT rel, regexp_extract(rel, '[^/]*$') AS name FROM notes),
idx AS (SELECT rel, name, lower(name) AS name_lower FROM files WHERE lower(name) LIKE '%_.md')"""
SQL_CANONICAL = SQL_INDEX + f""",
ranked AS (SELECT rel, {SQL_SLUG.format("regexp_replace(lower(name), '(_grokipedia|_wikipedia)?[.]md$', '')")} AS slug,
  CASE WHEN name_lower LIKE '%\\_grokipedia.md' ESCAPE '\\' THEN 2 WHEN name_lower LIKE '%\\_wikipedia.md' ESCAPE '\\' THEN 1 ELSE 0 END AS rank,
  length(rel) - length(replace(rel, '/', '')) AS depth FROM idx),
canonical AS (SELECT slug, count(*) AS copies, first(rank ORDER BY rank DESC, depth, rel) AS rank,
  first(rel ORDER BY rank DESC, depth, rel) AS rel FROM ranked GROUP BY slug)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(spark, sf_dir).select("site", "rel").distinct()


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.note_index(files(spark, sf_dir))


@query(f"WITH {SQL_INDEX} SELECT rel, name, name_lower FROM idx")
def note_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir).drop("site").orderBy("name_lower", "rel")


@query(f"SELECT doc_id, {SQL_SLUG.format('text')} AS slug FROM documents")
def note_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", normalize_slug(F.col("text")).alias("slug")
    )


@query(f"WITH {SQL_CANONICAL} SELECT slug, rank, rel, copies FROM canonical")
def canonical_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.canonical_notes(index(spark, sf_dir)).drop("site")


@query(f"WITH {SQL_INDEX} SELECT name_lower, count(*) AS copies FROM idx GROUP BY name_lower HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.duplicate_names(index(spark, sf_dir)).drop("site")


@query(
    f"""
WITH {SQL_INDEX}
SELECT rel, CASE WHEN count(*) OVER (PARTITION BY name_lower) > 1 THEN rel ELSE name END AS label FROM idx
"""
)
def note_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.note_labels(index(spark, sf_dir)).select("rel", "label")


@query(
    f"""
WITH {SQL_INDEX}
SELECT DISTINCT split_part(rel, '/', 1) AS folder FROM idx WHERE contains(rel, '/')
UNION SELECT DISTINCT split_part(rel, '/', 1) FROM files WHERE contains(rel, '/')
"""
)
def top_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.top_folders(files(spark, sf_dir)).select("folder")


@query(
    f"""
WITH {SQL_INDEX}
SELECT rel, CAST(row_number() OVER (ORDER BY name_lower, rel) AS BIGINT) AS pos, count(*) OVER () AS total
FROM idx WHERE contains(name_lower, 'the') QUALIFY pos <= 40
"""
)
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ops.name_search(index(spark, sf_dir), " THE ")
    return found.select("rel", F.col("pos").cast("bigint").alias("pos"), "total")


@query(
    f"""
WITH {SQL_INDEX}, needles AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS needle FROM part
  UNION SELECT lang FROM documents UNION SELECT regexp_extract(lower(text), '[a-z]+') FROM documents)
SELECT needle, count(*) AS total FROM needles JOIN idx ON contains(name_lower, needle)
WHERE length(needle) >= 2 GROUP BY needle
"""
)
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many searches at once: how many names each needle would find."""
    docs = table(spark, sf_dir, "documents")
    needles = (
        table(spark, sf_dir, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("needle"))
        .union(docs.select("lang"))
        .union(docs.select(F.regexp_extract(F.lower("text"), "[a-z]+", 0)))
    )
    return ops.search_counts(index(spark, sf_dir), needles).select("needle", "total")


@query(
    f"""
WITH {SQL_INDEX},
dirs AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS path FROM (SELECT s, unnest(range(1, len(s))) AS i
  FROM (SELECT string_split(rel, '/') AS s FROM files)) WHERE i >= 1),
listed AS (SELECT CASE WHEN contains(rel, '/') THEN regexp_extract(rel, '^(.*)/[^/]*$', 1) ELSE '' END AS parent, name,
  row_number() OVER (PARTITION BY regexp_extract(rel, '^(.*)/[^/]*$', 1) ORDER BY name) AS pos,
  count(*) OVER (PARTITION BY regexp_extract(rel, '^(.*)/[^/]*$', 1)) AS n FROM idx)
SELECT parent, false AS is_dir, CAST(pos AS BIGINT) AS pos, name, greatest(n - 400, 0) AS more FROM listed WHERE pos <= 400
UNION ALL SELECT regexp_extract(path, '^(.*)/[^/]*$', 1), true, NULL, regexp_extract(path, '[^/]*$'), 0 FROM dirs
"""
)
def folder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = catalog.folder_pages(files(spark, sf_dir))
    return listed.select("parent", "is_dir", F.col("pos").cast("bigint").alias("pos"), "name", "more")


@query(
    """
WITH texts AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '# ' || text WHEN 1 THEN chr(10) || '  ' || chr(10) || ' #  ' || text ELSE text END AS text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) AND trim(split_part(t.text, chr(10), CASE doc_id % 4 WHEN 0 THEN 1 ELSE 3 END), ' #') <> ''
  THEN regexp_replace(split_part(t.text, chr(10), CASE doc_id % 4 WHEN 0 THEN 1 ELSE 3 END), '^ ?# *| *$', '', 'g') ELSE 'n.o' || doc_id END AS title FROM texts t
"""
)
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE doc_id % 4 WHEN 0 THEN concat('# ', text) WHEN 1 THEN concat('\\n  \\n #  ', text) ELSE text END AS text",
    )
    rel = F.concat(F.lit("a/n.o"), "doc_id", F.lit(".md"))
    return docs.select("doc_id", note_title(F.col("text"), rel).alias("title"))


@query(
    """
SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?is)<script[ \\t\\n\\f\\r>/].*?</script>', '', 'g'),
  '(?is)<style[ \\t\\n\\f\\r>/].*?</style>', '', 'g')) AS digest FROM pages
"""
)
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(clean_html(F.col("html"))).alias("digest"))


SQL_NOTE_LINKS = SQL_CANONICAL + """,
named AS (SELECT doc_id, rel, regexp_replace(regexp_extract(rel, '[^/]*$'), '(_grokipedia|_wikipedia)?[.][A-Za-z]*$', '') AS stem FROM notes),
links AS (
  SELECT doc_id, 0 AS pos, '/page/' || replace(stem, ' ', '_') || '#sec' AS dest, false AS is_image FROM named
  UNION ALL SELECT doc_id, 1, '/page/Nope_' || replace(stem, ' ', '%20'), false FROM named
  UNION ALL SELECT doc_id, 2, 'javascript:alert', false FROM named
  UNION ALL SELECT doc_id, 3, 'img/' || doc_id || '.png', true FROM named
  UNION ALL SELECT doc_id, 4, 'https://h.example/' || doc_id, false FROM named
  UNION ALL SELECT doc_id, 5, '/page/___', false FROM named)"""


@query(
    f"""
WITH {SQL_NOTE_LINKS},
slugged AS (SELECT l.*, {SQL_SLUG.format("replace(regexp_extract(split_part(dest, '#', 1), '^/page/(.*)$', 1), '%20', ' ')")} AS slug FROM links l)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, dest, is_image,
  CASE WHEN pos IN (3, 4) OR split_part(dest, '#', 1) = '/page/' THEN dest WHEN pos = 2 THEN '#'
    WHEN c.rel IS NOT NULL THEN '/' || array_to_string(list_transform(string_split(c.rel, '/'), lambda p: url_encode(p)), '/') || CASE pos WHEN 0 THEN '#sec' ELSE '' END
    WHEN s.slug = '' THEN '#' ELSE '/?q=' || s.slug END AS url
FROM slugged s LEFT JOIN canonical c ON c.slug = s.slug AND pos NOT IN (2, 3, 4)
"""
)
def note_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links put into every note, found again in its text and resolved."""
    all_notes = notes(spark, sf_dir)
    name = F.regexp_replace(F.substring_index("rel", "/", -1), "(_grokipedia|_wikipedia)?[.][A-Za-z]*$", "")
    text = F.concat(
        F.lit("# Note\n\nSee [one](/page/"), F.replace(name, F.lit(" "), F.lit("_")), F.lit('#sec "title") and [`two`](</page/Nope_'),
        F.replace(name, F.lit(" "), F.lit("%20")), F.lit(">).\n```\n[code](/page/no)\n```\nNot `[code](x)`, but [js](javascript:alert) ![i](img/"),
        "doc_id", F.lit(".png) <https://h.example/"), "doc_id", F.lit("> and [last][ref].\n\n[ref]: /page/___\n\n"),
        F.coalesce("text", F.lit("")),
    )
    links = note_link_rows(all_notes.select("doc_id", "site", text.alias("text")))
    slugs = ops.canonical_notes(ops.note_index(all_notes.select("site", "rel").distinct()))
    return ops.resolve_note_links(links, slugs).select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "dest", "is_image", "url"
    )


@query(
    f"""
WITH {SQL_CANONICAL},
requests AS (
  SELECT '/' AS url, 200 AS status, 'home' AS answer, NULL AS rel UNION ALL SELECT '/../x', 403, 'refused', NULL
  UNION ALL SELECT DISTINCT '/' || upper(regexp_extract(rel, '^(.*)/[^/]*$', 1)) || '/', 200, 'folder', NULL FROM files
  UNION ALL SELECT '/page/' || slug, 200, 'note', rel FROM canonical WHERE slug <> ''
  UNION ALL SELECT '/page/none-' || slug, 404, 'absent', NULL FROM canonical WHERE slug <> ''
  UNION ALL SELECT '/' || url_encode(rel) || '?x=1', 200, CASE WHEN lower(regexp_extract(rel, '[^/]*$')) LIKE '%_.md' THEN 'note' ELSE 'file' END, rel FROM files)
SELECT url, status, answer, rel FROM requests
"""
)
def route_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests to a site of notes: home, pages by slug, folders, files."""
    all_files = files(spark, sf_dir)
    slugs = ops.canonical_notes(ops.note_index(all_files)).filter("slug <> ''")
    urls = (
        all_files.select(F.concat(F.lit("/"), F.upper(F.regexp_extract("rel", "^(.*)/[^/]*$", 1)), F.lit("/")).alias("url"))
        .distinct()
        .union(slugs.select(F.explode(F.array(F.concat(F.lit("/page/"), "slug"), F.concat(F.lit("/page/none-"), "slug")))))
        .union(all_files.select(F.concat(F.lit("/"), F.replace(F.url_encode("rel"), F.lit("+"), F.lit("%20")), F.lit("?x=1"))))
        .union(all_files.agg(F.count(F.lit(1))).select(F.explode(F.array(F.lit("/"), F.lit("/../x")))))
    )
    return ops.route_note_requests(urls.withColumn("site", F.lit("notes")), all_files).select(
        "url", "status", "answer", "rel"
    )
