"""Link audit: resolve every link, report what is missing and where from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.constants import BROKEN_SHOWN, ENTRY_SOURCE, SOURCES_SHOWN
from sitelake.functions.paths import doc_kind, fold_key
from sitelake.operators.catalog import locate
from sitelake.operators.parse import anchor_rows
from sitelake.operators.resolve import DOCUMENT_BASE, resolve_links, with_page_base
from sitelake.session import stage

ESCAPED_BASE = -1


def visit_url(path: Column, is_dir: Column, found: Column) -> Column:
    """URL a browser shows for a request that was answered with ``found``.

    The file itself when both name the same place, else the path as asked for:
    a folder asked for without its slash resolves links from its parent.
    """
    folder = F.regexp_extract(found, r"(?s)^(.*)/[^/]*\z", 1)
    name = F.substring_index(found, "/", -1)
    same = F.when(is_dir, name.rlike(r"(?i)^index\.html\z") & (fold_key(folder) == fold_key(path))).otherwise(
        (path == found) | (fold_key(path) == fold_key(found))
    )
    asked = F.when(is_dir & (path == ""), F.lit("/")).when(is_dir, F.concat(path, F.lit("/"))).otherwise(path)
    return F.when(same, found).otherwise(asked)


def stored_pages(parsed: DataFrame) -> DataFrame:
    """Readable documents as pages visited under their own path."""
    return parsed.filter("readable").select(
        "site", F.col("rel").alias("url"), F.col("rel").alias("file"), "links", "base_href"
    )


def visited_pages(visits: DataFrame, parsed: DataFrame) -> DataFrame:
    """What the markup of visited files ``(site, url, file, …)`` holds."""
    docs = parsed.filter("readable").select("site", F.col("rel").alias("file"), "links", "base_href")
    return visits.join(docs, ["site", "file"])


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of the pages ``(site, url, file, links, base_href, …)``, resolved.

    A ``<base>`` that leaves the archive is a link of its own, before the rest.
    """
    keep = [c for c in pages.columns if c not in ("links", "base_href")]
    pages = with_page_base(pages)
    own = F.struct(
        F.lit(ESCAPED_BASE).alias("pos"),
        F.lit("base").alias("tag"),
        F.lit("href").alias("attr"),
        F.col("base_href").alias("href"),
    )
    links = F.when(
        F.col("base_target.cls") == "escape", F.concat(F.array(own), "links")
    ).otherwise(F.col("links"))
    rows = pages.select(*keep, "base", F.inline(links)).withColumn(
        "base",
        F.when(F.col("pos") == ESCAPED_BASE, F.expr(DOCUMENT_BASE.format(url="url"))).otherwise(F.col("base")),
    )
    target = F.col("target")
    return resolve_links(rows).select(
        *keep,
        "pos",
        "href",
        target["cls"].alias("cls"),
        target["url"].alias("external"),
        target["path"].alias("path"),
        target["is_dir"].alias("is_dir"),
        target["fragment"].alias("fragment"),
    )


def locate_links(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Add to each local link the file that answers it, or the name missing."""
    local = F.when(F.col("cls") == "local", F.col("path"))
    return locate(links.withColumn("_local", local), catalog, "_local").drop("_local")


def missing_anchors(links: DataFrame, parsed: DataFrame) -> DataFrame:
    """Links to a fragment that a fully read page does not have."""
    pages = parsed.filter("readable and not truncated").select("site", F.col("rel").alias("found"))
    anchors = anchor_rows(parsed, "site", F.col("rel").alias("found"))
    return (
        links.filter(F.col("fragment").isNotNull() & (doc_kind(F.col("found")) == "html"))
        .join(pages, ["site", "found"], "left_semi")
        .join(anchors, ["site", "found", "fragment"], "left_anti")
    )


def broken_links(links: DataFrame, parsed: DataFrame) -> DataFrame:
    """One row per broken link: ``(site, path, reason, fragment, page, href, ord, pos)``."""
    source = ["site", F.col("url").alias("page"), "href", "ord", "pos"]
    direct = links.filter(
        (F.col("cls") == "escape") | F.col("missing").isNotNull()
    ).select(
        F.coalesce(F.col("missing"), F.col("path")).alias("path"),
        F.when(F.col("cls") == "escape", "escape").otherwise("missing").alias("reason"),
        F.lit("").alias("fragment"),
        *source,
    )
    failed = parsed.filter("not readable").select("site", F.col("rel").alias("found"))
    unreadable = (
        links.filter(doc_kind(F.col("found")).isNotNull())
        .join(failed, ["site", "found"], "left_semi")
        .select(
            F.col("found").alias("path"),
            F.lit("unreadable").alias("reason"),
            F.lit("").alias("fragment"),
            *source,
        )
    )
    absent = missing_anchors(links, parsed).select(
        F.col("found").alias("path"), F.lit("anchor").alias("reason"), "fragment", *source
    )
    return direct.unionByName(unreadable).unionByName(absent)


def with_group_key(broken: DataFrame) -> DataFrame:
    """Add ``key``: spellings of one path are one target, but not outside the archive."""
    return broken.withColumn(
        "key", F.when(F.col("reason") == "escape", F.col("path")).otherwise(fold_key(F.col("path")))
    )


def broken_groups(broken: DataFrame) -> DataFrame:
    """Broken targets: ``(site, path, reason, source_count, first)`` and the key.

    The label is the first spelling met. Everything is a partial aggregate, so a
    target half the corpus links to costs one row per task.
    """
    keyed = with_group_key(broken)
    first = F.struct("ord", "pos", "page", "href")
    label = F.when(
        F.col("reason") == "anchor", F.concat("path", F.lit("#"), "fragment")
    ).otherwise(F.col("path"))
    return (
        keyed.withColumn("label", label)
        .groupBy("site", "key", "reason", "fragment")
        .agg(
            F.min_by("label", first).alias("path"),
            F.count(F.lit(1)).alias("source_count"),
            F.min(first).alias("first"),
        )
    )


def group_sources(broken: DataFrame, shown: int = SOURCES_SHOWN) -> DataFrame:
    """First ``shown`` sources of each broken target, in crawl order.

    The limit per target applies before the shuffle as well as after it.
    """
    keyed = with_group_key(broken)
    order = Window.partitionBy("site", "key", "reason", "fragment").orderBy("ord", "pos", "page", "href")
    return keyed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= shown).select(
        "site", "key", "reason", "fragment", "rank", "page", "href"
    )


def broken_report(broken: DataFrame, shown: int = BROKEN_SHOWN) -> DataFrame:
    """The first ``shown`` broken targets of each site, with ``total`` and sources.

    Targets come in the order the crawl met them, absent anchors last.
    """
    broken = stage(broken, "broken")  # read for the groups, their totals and their sources
    groups = stage(broken_groups(broken), "groups")
    order = Window.partitionBy("site").orderBy(F.col("reason") == "anchor", "first", "key", "reason", "fragment")
    top = groups.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= shown)
    totals = groups.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    sources = (
        group_sources(broken)
        .groupBy("site", "key", "reason", "fragment")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "page", "href"))).alias("sources"))
    )
    return (
        top.join(sources, ["site", "key", "reason", "fragment"], "left")
        .join(totals, "site")
        .drop("key", "first")
    )


def referrers(links: DataFrame) -> DataFrame:
    """Who links to each file: ``(site, found, page, href, links)``."""
    return (
        links.filter("found is not null")
        .groupBy("site", "found", F.col("url").alias("page"), "href")
        .agg(F.count(F.lit(1)).alias("links"))
    )


def external_count(links: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct external URLs per site; roughly, in one shuffle, if asked."""
    urls = links.filter("external is not null").select("site", "external")
    if approximate:
        return urls.groupBy("site").agg(F.approx_count_distinct("external").alias("external"))
    return urls.distinct().groupBy("site").agg(F.count(F.lit(1)).alias("external"))


def reached_files(links: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct files that any visited page links to, and the entries."""
    return (
        links.filter("found is not null")
        .select("site", F.col("found").alias("rel"))
        .union(entries.select("site", F.col("entry").alias("rel")))
        .distinct()
    )


def orphans(catalog: DataFrame, reached: DataFrame) -> DataFrame:
    """Files no visited page links to."""
    return catalog.select("site", "rel").join(reached, ["site", "rel"], "left_anti")


def unreadable_entries(entries: DataFrame, parsed: DataFrame) -> DataFrame:
    """Entry pages that could not be read: broken, with the entry as source."""
    failed = parsed.filter("not readable").select("site", F.col("rel").alias("entry"))
    return entries.join(failed, ["site", "entry"], "left_semi").select(
        F.col("entry").alias("path"),
        F.lit("unreadable").alias("reason"),
        F.lit("").alias("fragment"),
        "site",
        F.lit(ENTRY_SOURCE).alias("page"),
        F.col("entry").alias("href"),
    )


def audit_report(
    visits: DataFrame,
    links: DataFrame,
    parsed: DataFrame,
    catalog: DataFrame,
    entries: DataFrame,
    broken: DataFrame,
) -> DataFrame:
    """One row of totals per site.

    Each count is of distinct things, so all of them go into one table of
    ``(site, what, name)``, made distinct in one shuffle on all three columns
    and then added up: no site is ever gathered in one task.
    """
    read = (
        visits.join(parsed.filter("readable").select("site", F.col("rel").alias("file"), "kind", "truncated"), ["site", "file"])
        .select("site", F.inline(
            F.when(
                F.col("truncated"),
                F.array(F.struct(F.col("kind").alias("what"), F.col("file").alias("name")),
                        F.struct(F.lit("truncated").alias("what"), F.col("file").alias("name"))),
            ).otherwise(F.array(F.struct(F.col("kind").alias("what"), F.col("file").alias("name"))))
        ))
    )
    targets = links.filter("found is not null or external is not null").select(
        "site",
        F.when(F.col("found").isNotNull(), "reached").otherwise("external").alias("what"),
        F.coalesce("found", "external").alias("name"),
    )
    seeds = entries.join(
        catalog.select("site", F.col("rel").alias("entry")), ["site", "entry"], "left_semi"
    ).select("site", F.lit("reached").alias("what"), F.col("entry").alias("name"))
    things = read.union(targets).union(seeds).distinct()

    def count(what: str) -> Column:
        return F.count_if(F.col("what") == what)

    totals = things.groupBy("site").agg(
        count("html").alias("pages"),
        count("css").alias("stylesheets"),
        count("reached").alias("reached"),
        count("external").alias("external"),
        count("truncated").alias("truncated"),
    )
    files = catalog.groupBy("site").agg(F.count(F.lit(1)).alias("files"))
    damage = (
        broken_groups(broken)
        .groupBy("site")
        .agg(
            F.count(F.lit(1)).alias("broken_groups"),
            F.sum("source_count").alias("broken_links"),
        )
    )
    zero = F.lit(0).cast("bigint")
    report = (
        files.join(totals, "site", "left")
        .join(damage, "site", "left")
        .na.fill(0)
    )
    verdict = (
        F.when(F.col("broken_links") > zero, "broken")
        .when(F.col("truncated") > zero, "incomplete")
        .otherwise("clean")
    )
    return report.select(
        "site", "pages", "stylesheets", "reached", "files", "external",
        "broken_groups", "broken_links", "truncated", verdict.alias("verdict"),
    )


def with_total(report: DataFrame) -> DataFrame:
    """The rows of a report and one of all sites together, where ``total`` is true and ``site`` null.

    The worst verdict stands for all; no sites have no total.
    """
    sums = [c for c in report.columns if c not in ("site", "verdict")]

    def some(verdict: str) -> Column:
        return F.bool_or(F.col("verdict") == verdict)

    worst = F.when(some("broken"), "broken").when(some("incomplete"), "incomplete").otherwise("clean")
    rows = report.rollup("site").agg(
        (F.grouping("site") == 1).alias("total"), *[F.sum(c).alias(c) for c in sums], worst.alias("verdict")
    )
    return rows.filter(F.col(sums[0]).isNotNull())  # nothing to add up in an empty report
