"""Markdown note collections: index, canonical copies, links, search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.constants import LISTING_SHOWN, SEARCH_SHOWN
from sitelake.functions.paths import (
    file_name,
    fold_key,
    is_hidden,
    is_markdown,
    is_visible_path,
    note_link_allowed,
    percent_decode,
    percent_encode,
    percent_encode_path,
    query_param,
    safe_request_path,
)
from sitelake.functions.slugs import article_slug, normalize_slug, source_rank
from sitelake.operators.catalog import Lookup, dir_table, nowhere, with_folded
from sitelake.operators.ordering import ranked
from sitelake.session import stage


def note_index(files: DataFrame) -> DataFrame:
    """Visible Markdown files: ``(site, rel, name, name_lower)``."""
    name = file_name(F.col("rel"))
    return files.filter(is_visible_path(F.col("rel")) & is_markdown(name)).select(
        "site", "rel", name.alias("name"), F.lower(name).alias("name_lower")
    )


def canonical_notes(notes: DataFrame) -> DataFrame:
    """One file per slug: best source, then fewest folders, then smallest path."""
    rank = source_rank(F.col("name"))
    depth = F.length("rel") - F.length(F.replace("rel", F.lit("/"), F.lit("")))
    best = F.min(F.struct((-rank).alias("order"), depth.alias("depth"), "rel"))
    return (
        notes.groupBy("site", article_slug(F.col("name")).alias("slug"))
        .agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
        .select("site", "slug", (-F.col("best.order")).alias("rank"), F.col("best.rel").alias("rel"), "copies")
    )


def duplicate_names(notes: DataFrame) -> DataFrame:
    """Lower-cased names that more than one note of a site has."""
    return (
        notes.groupBy("site", "name_lower")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
    )


def note_labels(notes: DataFrame) -> DataFrame:
    """Add ``label``: the file name, or the whole path where names repeat."""
    repeated = duplicate_names(notes).select("site", "name_lower", F.lit(True).alias("_twice"))
    return (
        notes.join(repeated, ["site", "name_lower"], "left")
        .withColumn("label", F.when(F.col("_twice"), F.col("rel")).otherwise(F.col("name")))
        .drop("_twice")
    )


def top_folders(catalog: DataFrame) -> DataFrame:
    """First-level folders: those of notes, and visible ones without notes."""
    first = F.substring_index("rel", "/", 1)
    of_notes = note_index(catalog).filter(F.contains("rel", F.lit("/"))).select("site", first.alias("folder"))
    others = dir_table(catalog).filter(~F.contains("dir", F.lit("/"))).select("site", F.col("dir").alias("folder"))
    return of_notes.union(others.filter(~is_hidden(F.col("folder")))).distinct()


def name_search(
    notes: DataFrame, query: str, shown: int | None = SEARCH_SHOWN, listed: int | None = LISTING_SHOWN
) -> DataFrame:
    """First ``shown`` notes of each site whose name contains ``query``.

    Adds ``total``, the number of all hits. An empty query lists the first
    ``listed`` notes; ``None`` lifts either limit. A single letter finds nothing.
    The ranking is cut before the shuffle.
    """
    wanted = query.strip()
    if wanted and len(wanted) < 2:
        return notes.withColumns(
            {"pos": F.lit(0), "total": F.lit(0).cast("bigint")}
        ).filter("false")
    hits = notes.filter(F.contains("name_lower", F.lower(F.lit(wanted)))) if wanted else notes
    totals = hits.groupBy("site").agg(F.count(F.lit(1)).alias("total"))
    cap = shown if wanted else listed
    if cap is None:
        return ranked(hits, ["site"], [F.col("name_lower"), F.col("rel")], "pos").join(totals, "site")
    order = Window.partitionBy("site").orderBy("name_lower", "rel")
    first = hits.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= cap)
    return first.join(totals, "site")


def _grams(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    found = F.transform(starts, lambda at: F.substr(text, at, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def search_matches(notes: DataFrame, needles: DataFrame) -> DataFrame:
    """The notes whose name contains a needle ``(needle)``, once per needle.

    Substring search for many needles at once without comparing all pairs: each
    needle stands for the rarest of its three-letter pieces (a needle of two
    letters for itself), names meet the pieces they hold, and the few pairs left
    are compared in full. Needles may have any length from two letters.
    """
    clean = needles.select(F.lower(F.trim("needle")).alias("needle")).distinct().filter(F.length("needle") >= 2)
    name = F.col("name_lower")
    pieces = F.explode(F.array_union(_grams(name, 2), _grams(name, 3))).alias("_gram")
    held = notes.select("*", pieces)
    common = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    word = F.col("needle")
    parts = clean.select("needle", F.explode(F.when(F.length(word) == 2, F.array(word)).otherwise(_grams(word, 3))).alias("_gram"))
    # A needle with a piece that no name holds is in no name.
    rarest = (
        parts.join(common, "_gram", "left")
        .groupBy("needle")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_best"))
        .filter("_best.n > 0")
        .select("needle", F.col("_best._gram").alias("_gram"))
    )
    return held.join(stage(rarest, "needles"), "_gram").filter(F.contains(name, word)).drop("_gram")


def search_counts(notes: DataFrame, needles: DataFrame) -> DataFrame:
    """How many names of each site contain each needle ``(needle)``."""
    return search_matches(notes, needles).groupBy("site", "needle").agg(F.count(F.lit(1)).alias("total"))


def search_hits(notes: DataFrame, needles: DataFrame, shown: int = SEARCH_SHOWN) -> DataFrame:
    """The first ``shown`` hits of each needle in each site, with ``pos`` and ``total``."""
    hits = stage(search_matches(notes, needles), "hits")
    totals = hits.groupBy("site", "needle").agg(F.count(F.lit(1)).alias("total"))
    order = Window.partitionBy("site", "needle").orderBy("name_lower", "rel")
    first = hits.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= shown)
    return first.join(totals, ["site", "needle"])


def resolve_note_links(links: DataFrame, slugs: DataFrame) -> DataFrame:
    """Add ``url``: where a note's link leads once rendered.

    ``/page/Slug`` goes to the canonical file, or to a search for the slug when
    there is none; other targets stay if allowed and become ``#`` otherwise.
    """
    path = F.substring_index("dest", "#", 1)
    asked = percent_decode(F.regexp_extract(path, r"(?s)^/page/(.+)$", 1))
    is_page = path.rlike(r"(?s)^/page/.")
    fragment = F.when(
        F.contains("dest", F.lit("#")), F.regexp_extract("dest", r"(?s)(#.*)$", 1)
    ).otherwise(F.lit(""))
    files = slugs.select("site", F.col("slug").alias("_key"), F.col("rel").alias("_file"))
    slug = F.col("_slug")
    # A note may be called "___.md": an empty slug is looked up like any other.
    return (
        links.withColumn("_slug", F.when(is_page, normalize_slug(asked)))
        .withColumn("_key", F.coalesce("_slug", nowhere(links)))
        .join(files, ["site", "_key"], "left")
        .withColumn(
            "url",
            F.when(
                F.col("_file").isNotNull(),
                F.concat(F.lit("/"), percent_encode_path(F.col("_file")), fragment),
            )
            .when(slug == "", F.lit("#"))
            .when(slug.isNotNull(), F.concat(F.lit("/?q="), percent_encode(slug)))
            .when(note_link_allowed(F.col("dest")), F.col("dest"))
            .otherwise(F.lit("#")),
        )
        .drop("_slug", "_key", "_file")
    )


def route_note_requests(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Answer requests to a site of notes: ``status``, ``rel``, ``answer``.

    In order: refused paths, the home page, ``page/slug``, folders, files. The
    home page searches for what its ``q`` asks, if anything: the answer is then
    "search", and ``query`` holds the words.
    """
    files = catalog.filter("not is_dir") if "is_dir" in catalog.columns else catalog
    slugs = canonical_notes(note_index(files)).select("site", F.col("slug").alias("_key"), F.col("rel").alias("_page"))
    path, away = F.col("_path"), nowhere(requests)
    asked = requests.withColumn("_path", safe_request_path(F.col("url"))).withColumn(
        "_slug",
        F.when(path.startswith("page/"), normalize_slug(F.regexp_extract(path, r"(?s)^page/(.*)$", 1))),
    )
    dirs = (
        with_folded(dir_table(catalog), "dir", "_dir").select("site", "_dir").distinct().withColumn("_is_dir", F.lit(True))
    )
    routed = (
        Lookup(files)
        .find(asked.withColumn("_key", F.coalesce("_slug", away)).join(slugs, ["site", "_key"], "left"), "_path", "_file")
        .withColumn("_dir", F.coalesce(fold_key(path), away))
        .join(dirs, ["site", "_dir"], "left")
    )
    home = path.isin("", "index.html")
    words = F.trim(query_param(F.regexp_extract("url", r"(?s)^[^?#]*\?([^#]*)", 1), "q"))
    answer = (
        F.when(path.isNull(), "refused")
        .when(home & (words != ""), "search")
        .when(home, "home")
        .when(F.col("_slug").isNotNull(), F.when(F.col("_page").isNotNull(), "note").otherwise("absent"))
        .when(F.col("_is_dir"), "folder")
        .when(F.col("_file").isNotNull(), F.when(is_markdown(F.col("_file")), "note").otherwise("file"))
        .otherwise("absent")
    )
    routed = routed.withColumn("answer", answer)
    a = F.col("answer")
    return (
        routed.withColumn("status", F.when(a == "refused", 403).when(a == "absent", 404).otherwise(200))
        .withColumn(
            "rel",
            F.when(a == "note", F.coalesce("_page", "_file")).when(a == "file", F.col("_file")),
        )
        .withColumn("query", F.when(a == "search", words))
        .drop("_path", "_slug", "_key", "_page", "_file", "_dir", "_is_dir")
    )
