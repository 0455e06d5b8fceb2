"""Breadth-first crawls over link tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.constants import PATHS_SHOWN
from sitelake.functions.paths import doc_kind
from sitelake.operators.audit import (
    audit_report,
    broken_links,
    locate_links,
    page_links,
    stored_pages,
    unreadable_entries,
    visit_url,
    visited_pages,
)
from sitelake.operators.catalog import Places
from sitelake.operators.ordering import natural_key
from sitelake.operators.parse import PARSED_DDL, parse_docs
from sitelake.session import Steps, stage


READ_DDL = "site string, rel string, kind string, truncated boolean, readable boolean"
LINKS_DDL = (
    "site string, url string, file string, pos int, href string, cls string, external string,"
    " path string, is_dir boolean, fragment string, found string, missing string"
)


def keep_partitioned(edges: DataFrame, *keys: str) -> DataFrame:
    """Edges kept in the partitioning every step joins on.

    The steps then shuffle their frontier only. Blocks that are lost with an
    executor are read again from the staged table underneath.
    """
    return edges.repartition(*keys).persist(StorageLevel.MEMORY_AND_DISK)


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """All nodes reachable from the seeds: ``(node, lvl)``.

    ``edges(src, dst)``, ``seeds(node)``. Each step joins only the newest nodes
    with the edges and writes what it found to the shared folder, so plans stay
    short and a lost executor costs one step. Spark broadcasts a small frontier
    and shuffles a large one.
    """
    node_type = seeds.schema["node"].dataType.simpleString()
    steps = Steps(edges.sparkSession, "reachable", f"node {node_type}, lvl int")
    steps.write(seeds.select("node").distinct().withColumn("lvl", F.lit(0)))
    kept = keep_partitioned(stage(edges.select("src", "dst").distinct(), "edges"), "src")
    while not steps.newest().isEmpty():
        frontier = steps.newest().select(F.col("node").alias("src"))
        seen = steps.everything().select(F.col("node").alias("dst"))
        found = kept.join(frontier, "src").select("dst").distinct().join(seen, "dst", "left_anti")
        steps.write(found.select(F.col("dst").alias("node"), F.lit(steps.count).alias("lvl")))
    kept.unpersist()
    return steps.everything()


@dataclass
class Crawl:
    """What a crawl leaves behind."""

    visits: DataFrame  # site, url, file, lvl, ord
    links: DataFrame  # located links of the visited pages
    parsed: DataFrame  # the documents read
    entries: DataFrame
    catalog: DataFrame

    def broken(self) -> DataFrame:
        entry = unreadable_entries(self.entries, self.parsed).withColumns(
            {"ord": F.struct(F.lit(-1).alias("lvl"), F.lit(0).cast("bigint").alias("n")), "pos": F.lit(0)}
        )
        return broken_links(self.links, self.parsed).unionByName(entry)

    def pages(self, kind: str = "html", shown: int = PATHS_SHOWN) -> DataFrame:
        """The first ``shown`` files read of each site, with ``total``."""
        read = self.parsed.filter(F.col("readable") & (F.col("kind") == kind))
        first = (
            self.visits.join(read.select("site", F.col("rel").alias("file")), ["site", "file"], "left_semi")
            .groupBy("site", "file")
            .agg(F.min("ord").alias("ord"))
        )
        order = Window.partitionBy("site").orderBy("ord")
        listed = first.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= shown)
        totals = first.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
        return listed.join(totals, "site").select("site", "pos", "file", "total")

    def report(self) -> DataFrame:
        return audit_report(
            self.visits, self.links, self.parsed, self.catalog, self.entries, self.broken()
        )


def parse_site(docs: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Parse the HTML and CSS of sites once, for every later step.

    An entry page counts as HTML whatever its name. The result is written to
    the shared folder: links, ids and bases each read only their own columns.
    """
    columns = ["site", "rel", "kind", "truncated", "readable", "text"]
    docs = docs.withColumn("kind", doc_kind(F.col("rel")))
    chosen = docs.filter("kind is not null").select(columns)
    if entries is not None:
        # Only entries of other kinds need a join; there are few, if any.
        odd = stage(
            entries.select("site", F.col("entry").alias("rel"))
            .filter(doc_kind(F.col("rel")).isNull())
            .distinct(),
            "entries",
        )
        others = docs.filter("kind is null").join(odd, ["site", "rel"], "left_semi")
        chosen = chosen.unionByName(others.withColumn("kind", F.lit("html")).select(columns))
    return stage(parse_docs(chosen), "parsed")


def located(pages: DataFrame, catalog: DataFrame | Places) -> DataFrame:
    """Links of pages, resolved and looked up.

    Both results are written out: the lookup reads the resolved links twice, for
    the distinct targets and for the answers, and later steps read the located
    links column by column.
    """
    return stage(located_links(pages, catalog), "links")


def located_links(pages: DataFrame, catalog: DataFrame | Places) -> DataFrame:
    """The links of ``located``, not yet written out."""
    return locate_links(stage(page_links(pages), "resolved"), catalog)


def link_graph(links: DataFrame) -> DataFrame:
    """Edges to documents that a crawl follows, parallel links merged."""
    return (
        links.filter(doc_kind(F.col("found")).isNotNull())
        .withColumn("to_url", visit_url(F.col("path"), F.col("is_dir"), F.col("found")))
        .groupBy("site", "url", "to_url")
        .agg(F.min(F.struct("pos", "found")).alias("_first"))
        .select("site", "url", "to_url", F.col("_first.found").alias("to_file"), F.col("_first.pos").alias("pos"))
    )


def _visit_steps(entries: DataFrame) -> Steps:
    """The visits of a crawl, one table per level; the first holds the entries."""
    steps = Steps(entries.sparkSession, "crawl", "site string, url string, file string, lvl int, ord bigint")
    start = entries.select("site", F.col("entry").alias("url"), F.col("entry").alias("file")).distinct()
    _number(steps, start, "site", *natural_key(F.col("url")))
    return steps


def _number(steps: Steps, found: DataFrame, *order: str | Column) -> None:
    """Write a level; ids grow along the sorted ranges, so they carry the order to the next one."""
    steps.write(
        found.orderBy(*order).select(
            "site", "url", "file", F.lit(steps.count).alias("lvl"), F.monotonically_increasing_id().alias("ord")
        )
    )


def _visit_new(steps: Steps, followed: DataFrame) -> None:
    """Write the next level: what the links followed lead to and no level has."""
    new = (
        followed.groupBy("site", F.col("to_url").alias("url"))
        .agg(F.min(F.struct("ord", "pos", "to_file")).alias("_first"))
        .join(steps.everything().select("site", "url"), ["site", "url"], "left_anti")
        .select(
            "site",
            "url",
            F.col("_first.to_file").alias("file"),
            F.col("_first.ord").alias("_parent"),
            F.col("_first.pos").alias("_pos"),
        )
    )
    _number(steps, new, "_parent", "_pos", "site", "url")


def _ordered_visits(steps: Steps) -> DataFrame:
    return steps.everything().withColumn("ord", F.struct("lvl", F.col("ord").alias("n")))


def crawl(docs: DataFrame, catalog: DataFrame, entries: DataFrame) -> Crawl:
    """Visit each site from its entry page, breadth first.

    A site without one may be given several (``ordering.seed_pages``); they are
    then visited in natural order.

    All documents are parsed, resolved and located once, in parallel, as
    visited under their own path; the loop then only walks the edge table. A
    page shown under another URL (a folder without its slash) resolves its
    links anew; only such visits are resolved inside the loop.
    """
    catalog = stage(catalog.select("site", "rel").distinct(), "catalog")
    places = Places(catalog).staged()
    parsed = parse_site(docs, entries)
    stored_links = located(stored_pages(parsed), places)
    edges = keep_partitioned(stage(link_graph(stored_links), "graph"), "site", "url")
    steps = _visit_steps(entries)
    alias_links = Steps(docs.sparkSession, "alias-links", stored_links.schema)
    while True:
        frontier = steps.newest()
        size, alias_count = frontier.agg(F.count(F.lit(1)), F.count_if(F.col("url") != F.col("file"))).first()
        if size == 0:
            break
        followed = edges.join(frontier.filter("url = file").select("site", "url", "ord"), ["site", "url"])
        if alias_count > 0:
            aliases = frontier.filter("url <> file")
            alias_links.write(locate_links(page_links(visited_pages(aliases.select("site", "url", "file"), parsed)), places))
            found = alias_links.newest()
            followed = followed.unionByName(
                link_graph(found).join(aliases.select("site", "url", "ord"), ["site", "url"])
            )
        _visit_new(steps, followed)
    edges.unpersist()
    visits = _ordered_visits(steps)
    links = stored_links
    if alias_links.count:
        links = links.unionByName(alias_links.everything())
    followed = links.join(visits.select("site", "url", "ord"), ["site", "url"])
    return Crawl(visits, followed, parsed, entries, catalog)


def among(docs: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Documents of a table, for ``crawl_lazily``."""
    return lambda wanted: docs.join(wanted, ["site", "rel"], "left_semi")


def crawl_lazily(read: Callable[[DataFrame], DataFrame], catalog: DataFrame, entries: DataFrame) -> Crawl:
    """The crawl of ``crawl``, which reads a document only when a link has led to it.

    ``read`` gets files wanted, ``(site, rel)``, each of them once, and gives their
    documents ``(site, rel, text, truncated, readable)``: ``folders.read_named`` opens
    just those files, ``among`` looks them up in a table. What nothing links to is
    neither read nor parsed; in return, each level parses, resolves and locates its own
    pages, so a crawl of few, large levels is faster read whole.
    """
    spark = catalog.sparkSession
    catalog = stage(catalog.select("site", "rel").distinct(), "catalog")
    places = Places(catalog).staged()
    steps = _visit_steps(entries)
    parsed = Steps(spark, "lazy-parsed", f"{READ_DDL}, {PARSED_DDL}")
    links = Steps(spark, "lazy-links", LINKS_DDL)
    while size := (frontier := steps.newest()).count():
        wanted = frontier.select("site", F.col("file").alias("rel")).distinct()
        if parsed.count:
            wanted = wanted.join(parsed.everything().select("site", "rel"), ["site", "rel"], "left_anti")
        wanted = stage(wanted, "wanted")
        kind = F.coalesce(doc_kind(F.col("rel")), F.lit("html"))
        docs = read(wanted).withColumn("kind", kind)
        parsed.write(parse_docs(docs.select("site", "rel", "kind", "truncated", "readable", "text")))
        # A page under a second URL was parsed on an earlier level.
        known = parsed.newest() if wanted.count() == size else parsed.everything()
        links.write(located_links(visited_pages(frontier.select("site", "url", "file"), known), places))
        _visit_new(steps, link_graph(links.newest()).join(frontier.select("site", "url", "ord"), ["site", "url"]))
    if not links.count:
        parsed.write(spark.createDataFrame([], parsed.schema))
        links.write(spark.createDataFrame([], links.schema))
    visits = _ordered_visits(steps)
    followed = links.everything().join(visits.select("site", "url", "ord"), ["site", "url"])
    return Crawl(visits, followed, parsed.everything(), entries, catalog)


def audit_all(docs: DataFrame, catalog: DataFrame) -> Crawl:
    """Audit with every page as a seed, for sites without an entry: no loop."""
    catalog = catalog.select("site", "rel").distinct()
    parsed = parse_site(docs)
    start = F.struct(F.lit(0).alias("lvl"), F.lit(0).cast("bigint").alias("n"))
    visits = parsed.select(
        "site", F.col("rel").alias("url"), F.col("rel").alias("file"), F.lit(0).alias("lvl"), start.alias("ord")
    )
    links = located(stored_pages(parsed), catalog).withColumn("ord", start)
    no_entries = visits.filter("false").select("site", F.col("file").alias("entry"))
    return Crawl(visits, links, parsed, no_entries, catalog)
