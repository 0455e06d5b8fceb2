"""From archives to audits: records or members become sites, sites are crawled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.constants import ENTRY_NAMES
from sitelake.functions.paths import doc_kind, is_dir_member, normalize_member
from sitelake.operators import archives
from sitelake.operators.crawl import Crawl, crawl
from sitelake.operators.ordering import seed_pages
from sitelake.session import stage


@dataclass
class Assembly:
    """The files of sites, where each is entered, and what did not become a file."""

    files: DataFrame  # site, rel, text (null unless a document)
    entries: DataFrame  # site, entry
    rejected: DataFrame  # site, name, reason

    def audit(self) -> Crawl:
        docs = self.files.withColumns({"truncated": F.lit(False), "readable": F.col("text").isNotNull()})
        return crawl(docs, self.files.select("site", "rel"), self.entries)


def site_entries(files: DataFrame) -> DataFrame:
    """The best entry page of each site, or all its top-level pages where there is none."""
    names = F.array(*map(F.lit, ENTRY_NAMES))
    rank = F.array_position(names, F.col("rel"))
    best = files.filter(rank > 0).groupBy("site").agg(F.min_by("rel", rank).alias("entry"))
    return best.union(seed_pages(files, ENTRY_NAMES))


def assemble_records(records: DataFrame, decode_paths: bool = False) -> Assembly:
    """Sites of archived responses: kept, free of path clashes, newest, rewritten.

    ``records`` as from ``read_warc``, with rows of ``(site, file, seq)`` in order.
    Responses whose URL climbs above its site, and files that are folders of
    earlier ones or lie below one, come back as rejected; so do malformed records.
    """
    failed = records.filter("_error IS NOT NULL") if "_error" in records.columns else records.filter("false").withColumn("_error", F.lit(""))
    kept = stage(archives.keep_responses(records, decode_paths).withColumn("order", F.struct("file", "seq")), "kept")
    good = kept.filter("rel IS NOT NULL")
    clear = archives.drop_path_clashes(good, "order")
    clashing = good.select("site", "rel", "target_uri").join(clear.select("site", "rel").distinct(), ["site", "rel"], "left_anti")
    text = F.when(doc_kind(F.col("rel")).isNotNull(), F.make_valid_utf8(F.col("payload").cast("string")))
    newest = archives.latest_payload(clear, "order").select("site", "rel", text.alias("text"))
    files = stage(archives.rewrite_site(newest, archives.site_origins(clear)), "files")
    rejected = (
        kept.filter("rel IS NULL")
        .select("site", F.col("target_uri").alias("name"), F.lit("climbs above its site").alias("reason"))
        .union(clashing.select("site", "target_uri", F.lit("path is taken")))
        .union(failed.select("site", "file", "_error"))
    )
    return Assembly(files, stage(site_entries(files), "entries"), rejected)


def assemble_members(members: DataFrame, contents: DataFrame) -> Assembly:
    """Sites of archive members; archives that are no sites are refused.

    ``members(archive, name)``, ``contents(archive, name, content)``. Wrapper
    folders are taken off. Only documents meet their contents. Unsafe names and
    archives of notes, or of nothing to show, come back as rejected.
    """
    named = members.withColumn("rel", normalize_member(F.col("name"))).withColumn("is_dir", is_dir_member(F.col("name")))
    unsafe = named.filter("rel IS NULL").select(F.col("archive").alias("site"), "name", F.lit("unsafe name").alias("reason"))
    safe = named.filter("rel IS NOT NULL")
    kinds = stage(archives.classify_archives(safe.select("archive", "rel", "is_dir")), "kinds")
    sites = kinds.filter("kind = 'site'")
    files = archives.rebase(safe.filter("not is_dir"), sites).select("archive", "name", "rel")
    documents = files.filter(doc_kind(F.col("rel")).isNotNull())
    texts = documents.join(contents.select("archive", "name", "content"), ["archive", "name"], "left").select(
        "archive", "rel", F.make_valid_utf8(F.col("content").cast("string")).alias("text")
    )
    others = files.filter(doc_kind(F.col("rel")).isNull()).select("archive", "rel", F.lit(None).cast("string"))
    refused = kinds.filter("kind <> 'site'").select("archive", "archive", F.concat(F.lit("archive of kind "), "kind"))
    return Assembly(
        stage(texts.union(others).withColumnRenamed("archive", "site"), "files"),
        sites.select(F.col("archive").alias("site"), "entry"),
        unsafe.union(refused),
    )
