"""Assembling sites from archive records and archive member lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.constants import ENTRY_NAMES, WRAPPER_DEPTH
from sitelake.functions.paths import (
    ascii_lower,
    is_dir_member,
    is_html_type,
    is_http,
    is_markdown,
    is_rewritable,
    normalize_member,
    origin_of,
    stem,
    url_to_rel,
)
from sitelake.functions.text import rewrite_figures, rewrite_origins
from sitelake.operators.catalog import parents
from sitelake.session import stage


def split_http(body: Column) -> tuple[Column, Column, Column]:
    """Status, content type and payload of an HTTP response held in a record."""
    # Offsets count bytes: heads and payloads need not be text.
    raw = F.substring_index(body.cast("string"), "\r\n\r\n", 1)
    size = F.octet_length(raw)
    head = F.try_validate_utf8(raw)
    status = F.regexp_extract(
        F.regexp_extract(head, r"\A[^\n]*", 0), r"^\s*\S+\s+\+?(\d+)(?!\S)", 1
    ).try_cast("int")
    ctype = F.regexp_extract(head, r"(?im)^content-type:[ \t]*([^\r\n]*?)[ \t\r]*$", 1)
    payload = F.substring(body, size + 5, F.octet_length(body))
    good = (size < F.octet_length(body)) & (status <= 65535)
    return (
        F.when(good, status),
        F.when(good, ctype),
        F.when(good, payload),
    )


def keep_responses(records: DataFrame, decode_paths: bool = False) -> DataFrame:
    """WARC records that become files of a site, with their paths.

    Adds ``status, content_type, payload, as_html, rel``; a URL that climbs
    with ``..`` has a null ``rel``.
    """
    status, ctype, payload = split_http(F.col("body"))
    resource = F.col("warc_type") == "resource"
    kept = records.filter(
        F.col("warc_type").isin("response", "resource") & is_http(F.col("target_uri"))
    )
    kept = kept.withColumn("status", F.when(~resource, status)).filter(
        resource | F.col("status").between(200, 299)
    )
    return (
        kept.withColumn(
            "content_type",
            F.when(
                resource, F.coalesce(F.try_element_at("headers", F.lit("content-type")), F.lit(""))
            ).otherwise(ctype),
        )
        .withColumn("payload", F.when(resource, F.col("body")).otherwise(payload))
        .withColumn("as_html", is_html_type(F.col("content_type")))
        .withColumn("rel", url_to_rel(F.col("target_uri"), F.col("as_html"), decode_paths))
        .drop("body")
    )


def latest_rows(records: DataFrame, *order: str) -> DataFrame:
    """One row per ``(site, rel)``, the last one written; for narrow rows."""
    rest = [c for c in records.columns if c not in ("site", "rel")]
    return (
        records.groupBy("site", "rel")
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last"))
        .select("site", "rel", "_last.*")
    )


def latest_payload(records: DataFrame, *order: str) -> DataFrame:
    """One row per ``(site, rel)``, the last one written; for rows with payloads.

    ``order`` must tell the rows of a path apart. Only keys are aggregated and
    shuffled. The rows that lost are written out first, so that their true size
    decides the last join: as a rule they are few, Spark broadcasts them, and no
    payload moves at all. ``records`` is read twice, once for its keys, and
    should be a stored table.
    """
    keys = records.select("site", "rel", F.struct(*order).alias("_order"))
    newest = (
        keys.groupBy("site", "rel")
        .agg(F.max("_order").alias("_newest"), F.count(F.lit(1)).alias("_copies"))
        .filter("_copies > 1")
    )
    older = stage(
        keys.join(newest, ["site", "rel"]).filter("_order < _newest").select("site", "rel", "_order"), "older"
    )
    return (
        records.withColumn("_order", F.struct(*order))
        .join(older, ["site", "rel", "_order"], "left_anti")
        .select(*records.columns)
    )


def drop_path_clashes(records: DataFrame, order: str = "seq") -> DataFrame:
    """A path is a file or a folder; whichever came first stays.

    ``order`` is any comparable column. Both sides are aggregated before they
    meet, one row per path, so no site or folder becomes a single large group.
    The paths to drop are written out, and broadcast when they are few.
    """
    files = records.groupBy("site", "rel").agg(F.min(order).alias("_first"))
    below = (
        files.filter(F.contains("rel", F.lit("/")))
        .select("site", F.explode(parents(F.col("rel"))).alias("rel"), "_first")
        .groupBy("site", "rel")
        .agg(F.min("_first").alias("_below"))
    )
    clashes = files.join(below, ["site", "rel"])
    folders = clashes.filter(F.col("_below") < F.col("_first")).select("site", "rel")
    owners = clashes.filter(F.col("_below") >= F.col("_first")).select(
        "site", F.col("rel").alias("_parent")
    )
    shadowed = (
        files.filter(F.contains("rel", F.lit("/")))
        .select("site", "rel", F.explode(parents(F.col("rel"))).alias("_parent"))
        .join(owners, ["site", "_parent"], "left_semi")
        .select("site", "rel")
    )
    dropped = stage(folders.union(shadowed).distinct(), "clashes")
    return records.join(dropped, ["site", "rel"], "left_anti")


def site_origins(pages: DataFrame, uri: str = "target_uri") -> DataFrame:
    """Distinct origins of each site's HTML records."""
    return (
        pages.filter("as_html")
        .select("site", origin_of(F.col(uri)).alias("origin"))
        .filter("origin is not null")
        .distinct()
    )


def attach_origins(files: DataFrame, origins: DataFrame) -> DataFrame:
    """Add ``origins``, the list to remove from a site's pages.

    The list has one entry per distinct origin of one archive. All lists are
    written out first: by their true size Spark either broadcasts them, and the
    pages stay where they are, or joins on the site and splits large sites.
    """
    lists = stage(origins.groupBy("site").agg(F.collect_set("origin").alias("origins")), "origins")
    return files.join(lists, "site", "left")


def rewrite_site(files: DataFrame, origins: DataFrame) -> DataFrame:
    """Make absolute links to the site's own origins and figures relative."""
    rewritten = rewrite_figures(
        rewrite_origins(
            F.col("text"), F.coalesce("origins", F.array().cast("array<string>"))
        )
    )
    return (
        attach_origins(files, origins)
        .withColumn("text", F.when(is_rewritable(F.col("rel")), rewritten).otherwise(F.col("text")))
        .drop("origins")
    )


def normalize_members(members: DataFrame) -> DataFrame:
    """Safe member names ``(archive, rel, is_dir)``; unsafe ones are left out."""
    return (
        members.withColumn("rel", normalize_member(F.col("name")))
        .withColumn("is_dir", is_dir_member(F.col("name")))
        .filter("rel is not null")
    )


def classify_archives(members: DataFrame) -> DataFrame:
    """Per archive the folder served, its kind and its entry page.

    ``members(archive, rel, is_dir)`` → ``(archive, root, kind, entry)``.
    Wrapper folders are looked through: each member speaks for every folder
    above it, one aggregation decides each folder, and the shallowest folder
    that ends the descent is the root. Nothing loops and the partial
    aggregation leaves one row per folder to shuffle.
    """
    parts = F.split("rel", "/")
    n = F.size(parts)
    hidden_at = F.transform(
        parts, lambda p: p.rlike(r"^(?:__MACOSX\z|\.)")
    )
    last = F.element_at(parts, -1)
    seen = (
        members.withColumn("_parts", parts)
        .withColumn("_hidden", hidden_at)
        # Folders below a hidden one are never looked at.
        .withColumn(
            "_depths",
            F.least(
                n,
                F.lit(WRAPPER_DEPTH),
                F.coalesce(F.nullif(F.array_position("_hidden", True), F.lit(0)), n).cast("int"),
            ),
        )
        .select(
            "archive",
            "rel",
            "is_dir",
            "_parts",
            last.alias("_name"),
            (F.lit(0) - F.size("_parts")).alias("_minus_n"),
            F.explode(F.sequence(F.lit(0), F.col("_depths") - 1)).alias("depth"),
            "_hidden",
        )
    )
    child = F.element_at("_parts", F.col("depth") + 1)
    nested = (F.col("depth") + 1 < F.size("_parts")) | F.col("is_dir")
    visible = ~F.element_at("_hidden", F.col("depth") + 1)
    all_visible = ~F.exists(
        F.slice("_hidden", F.col("depth") + 1, F.size("_hidden")), lambda h: h
    )
    name, folded = F.col("_name"), F.col("_name_folded")
    rank = (
        F.when(folded == "ouvrir.html", 0).when(folded == "index.html", 1).when(folded == "index.htm", 2)
    )
    entry = F.when(
        ~nested & rank.isNotNull(),
        F.struct(
            rank.alias("rank"),
            (name != ENTRY_NAMES[0]).alias("other"),
            (name != folded).alias("spelled"),
            name.alias("name"),
        ),
    )
    folders = (
        seen.withColumn("_name_folded", ascii_lower(F.col("_name")))
        .withColumn("prefix", F.array_join(F.slice("_parts", F.lit(1), F.col("depth")), "/"))
        .groupBy("archive", "depth", "prefix")
        .agg(
            F.min(entry)["name"].alias("entry"),
            F.bool_or(~nested & visible).alias("files"),
            F.min(F.when(nested & visible, child)).alias("dir_a"),
            F.max(F.when(nested & visible, child)).alias("dir_b"),
            F.bool_or(~F.col("is_dir") & all_visible & is_markdown(F.col("_name"))).alias("notes"),
        )
    )
    wrapper = (
        F.col("entry").isNull() & ~F.col("files") & F.coalesce(F.col("dir_a") == F.col("dir_b"), F.lit(False))
    )
    kind = F.when(F.col("entry").isNotNull(), "site").when(F.col("notes"), "notes").otherwise("none")
    ends = (
        folders.filter(~wrapper)
        .groupBy("archive")
        .agg(
            F.min(
                F.struct("depth", "prefix", kind.alias("kind"), "entry")
            ).alias("end")
        )
    )
    archives = members.select("archive").distinct()
    end = F.col("end")
    found = F.coalesce(end["kind"], F.lit("none"))
    return archives.join(ends, "archive", "left").select(
        "archive",
        F.when(found != "none", end["prefix"]).alias("root"),
        found.alias("kind"),
        F.when(found == "site", end["entry"]).alias("entry"),
    )


def rebase(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members below their archive's root, with the root taken off."""
    root = F.col("root")
    under = (root == "") | F.startswith("rel", F.concat(root, F.lit("/")))
    cut = F.when(root == "", F.col("rel")).otherwise(
        F.substr("rel", F.length(root) + F.lit(2))
    )
    return (
        members.join(roots.select("archive", "root").filter("root is not null"), "archive")
        .filter(under & (F.col("rel") != root))
        .withColumn("rel", cut)
        .drop("root")
    )


def select_archive(listing: DataFrame) -> DataFrame:
    """What to open in each collection folder.

    ``listing(folder, path, is_file)`` holds paths below the folder. The best
    candidate has the lowest priority, then the smallest path; folders with
    nothing to open come back with a null ``chosen``. A folder that is a site
    (or notes) is chosen itself, as the empty path.
    """
    path, low = F.col("path"), ascii_lower(F.col("path"))
    top = ~F.contains("path", F.lit("/"))
    warc = low.rlike(r"\.warc(?:\.gz)?\z")
    in_archive = path.rlike(r"^archive/[^/]+\z")
    own_name = F.concat(F.substring_index("folder", "/", -1), F.lit(".wacz"))
    sites = (
        classify_archives(
            listing.select(F.col("folder").alias("archive"), F.col("path").alias("rel"), (~F.col("is_file")).alias("is_dir"))
        )
        .filter("kind = 'site'")
        .select(F.col("archive").alias("folder"), F.lit(0).alias("priority"), F.lit("").alias("path"))
    )
    shown = ~path.rlike(r"(?:^|/)(?:__MACOSX(?:/|\z)|\.)")
    priority = (
        F.when(top & (path == own_name), 1)
        .when(top & low.endswith(".wacz"), 2)
        .when(in_archive & warc, 3)
        .when(top & warc, 4)
        .when(top & low.endswith(".zip"), 5)
        .when(shown & is_markdown(path), 6)
    )
    files = listing.filter("is_file").select(
        "folder", priority.alias("priority"), "path"
    ).filter("priority is not null")
    files = files.withColumn("path", F.when(F.col("priority") == 6, F.lit("")).otherwise(F.col("path")))
    best = (
        files.union(sites)
        .groupBy("folder")
        .agg(F.min(F.struct("priority", "path")).alias("best"))
    )
    chosen = F.col("best.path")
    return (
        listing.select("folder")
        .distinct()
        .join(best, "folder", "left")
        .select(
            "folder",
            chosen.alias("chosen"),
            F.when(chosen == "", F.substring_index("folder", "/", -1))
            .when(chosen.isNotNull(), stem(chosen))
            .alias("site"),
        )
    )
