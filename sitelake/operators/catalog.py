"""Site catalogs: path lookup, directories, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelake.constants import LISTING_SHOWN
from sitelake.functions.paths import (
    fold_key,
    is_hidden,
    is_markdown,
    safe_request_path,
)
from sitelake.session import stage


def with_folded(catalog: DataFrame, path: str = "rel", out: str = "folded") -> DataFrame:
    return catalog.withColumn(out, fold_key(F.col(path)))


def choose_folded(catalog: DataFrame) -> DataFrame:
    """Per folded key the one stored name that answers for it.

    The name equal to its own key wins, else the smallest. ``variants`` tells
    how many names share the key. Partial aggregation does the work before the
    shuffle, and the key spreads evenly whatever the size of a site.
    """
    folded = catalog if "folded" in catalog.columns else with_folded(catalog)
    return (
        folded.groupBy("site", "folded")
        .agg(
            F.min(F.struct(F.col("rel") != F.col("folded"), F.col("rel"))).alias("best"),
            F.count(F.lit(1)).alias("variants"),
        )
        .select("site", "folded", F.col("best.rel").alias("chosen"), "variants")
    )


def nowhere(rows: DataFrame) -> Column:
    """A made-up key for rows without one: it matches nothing and spreads them over tasks."""
    return F.concat(F.lit("\x00"), F.xxhash64(*rows.columns).cast("string"))


class Lookup:
    """A catalog prepared for lookups of exact names first, folded names next.

    An exact hit always shares the folded key, so one shuffle on
    ``(site, folded)`` answers nearly everything. Only names that lost the
    choice of their key (case or Unicode collisions) need the second join, and
    that table is small enough for the optimizer to see at run time.
    """

    def __init__(self, catalog: DataFrame):
        folded = with_folded(catalog.select("site", "rel"))
        self.chosen = choose_folded(folded)
        collided = self.chosen.filter("variants > 1")
        self.losers = (
            folded.join(collided, ["site", "folded"])
            .filter(F.col("rel") != F.col("chosen"))
            .select("site", F.col("rel").alias("_exact"))
        )

    def staged(self) -> Lookup:
        """Written out, for many lookups in the same catalog."""
        self.chosen = stage(self.chosen, "chosen")
        self.losers = stage(self.losers, "losers")
        return self

    def find(self, targets: DataFrame, path: str, out: str) -> DataFrame:
        """Add ``out``: the stored name for ``path``, or null."""
        chosen = self.chosen.select(
            "site", F.col("folded").alias("_probe_folded"), F.col("chosen").alias("_chosen")
        )
        losers = self.losers.withColumn("_probe_path", F.col("_exact"))
        return (
            targets.withColumn("_probe_path", F.coalesce(F.col(path), nowhere(targets)))
            .withColumn("_probe_folded", F.coalesce(fold_key(F.col(path)), F.col("_probe_path")))
            .join(chosen, ["site", "_probe_folded"], "left")
            .join(losers, ["site", "_probe_path"], "left")
            .withColumn(out, F.coalesce("_exact", "_chosen"))
            .drop("_probe_path", "_probe_folded", "_chosen", "_exact")
        )


def folded_lookup(targets: DataFrame, catalog: DataFrame, path: str = "path", out: str = "found") -> DataFrame:
    return Lookup(catalog).find(targets, path, out)


def parents(path: Column) -> Column:
    """Every folder above a path, nearest last."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def implied_dirs(files: DataFrame) -> DataFrame:
    return (
        files.filter(F.contains("rel", F.lit("/")))
        .select("site", F.explode(parents(F.col("rel"))).alias("dir"))
        .distinct()
    )


def dir_table(catalog: DataFrame) -> DataFrame:
    """All directories ``(site, dir)``: explicit ones and those paths imply.

    ``catalog`` holds ``(site, rel)`` and, when it lists directories, ``is_dir``.
    """
    if "is_dir" not in catalog.columns:
        return implied_dirs(catalog)
    explicit = catalog.filter("is_dir").select("site", F.col("rel").alias("dir"))
    return implied_dirs(catalog).union(explicit).distinct()


def children(catalog: DataFrame) -> DataFrame:
    """``(site, parent, name, is_dir)``: what each directory holds directly."""
    files = catalog.filter("not is_dir") if "is_dir" in catalog.columns else catalog
    both = files.select("site", F.col("rel").alias("path"), F.lit(False).alias("is_dir")).union(
        dir_table(catalog).select("site", F.col("dir").alias("path"), F.lit(True).alias("is_dir"))
    )
    return both.select(
        "site",
        F.regexp_extract("path", r"(?s)^(.*)/[^/]*\z", 1).alias("parent"),
        F.substring_index("path", "/", -1).alias("name"),
        "is_dir",
    )


def folder_pages(catalog: DataFrame, shown: int = LISTING_SHOWN) -> DataFrame:
    """Listing of each folder: all folders, then the first ``shown`` notes.

    ``(site, parent, is_dir, pos, name, more)`` with ``more`` the number of
    notes beyond the listing. The cap bounds each group before its shuffle.
    """
    kids = children(catalog).filter(~is_hidden(F.col("name")))
    notes = kids.filter(~F.col("is_dir") & is_markdown(F.col("name")))
    by_name = Window.partitionBy("site", "parent").orderBy("name")
    first = notes.withColumn("pos", F.row_number().over(by_name)).filter(F.col("pos") <= shown)
    counts = notes.groupBy("site", "parent").agg(F.count(F.lit(1)).alias("_n"))
    listed = first.join(counts, ["site", "parent"]).withColumn(
        "more", F.greatest(F.col("_n") - shown, F.lit(0))
    )
    folders = kids.filter("is_dir").withColumn("pos", F.lit(None).cast("int"))
    return listed.select("site", "parent", "is_dir", "pos", "name", "more").union(
        folders.select(
            "site", "parent", "is_dir", "pos", "name", F.lit(0).cast("bigint").alias("more")
        )
    )


class Places:
    """A catalog prepared once for ``locate``: its names and its folders."""

    def __init__(self, catalog: DataFrame):
        self.lookup = Lookup(catalog)
        folded = with_folded(dir_table(catalog), "dir", "_dir").select("site", "_dir").distinct()
        self.dirs = folded.withColumn("_is_dir", F.lit(True))

    def staged(self) -> Places:
        self.lookup.staged()
        self.dirs = stage(self.dirs, "dirs")
        return self


def locate(targets: DataFrame, catalog: DataFrame | Places, path: str = "path") -> DataFrame:
    """Add ``found`` (stored file or null) and ``missing`` (what to report).

    A path answers with its file, else with the ``index.html`` inside it. Both
    candidates go through one join: each target probes with two rows.
    """
    index = F.when(F.col(path) == "", F.lit("index.html")).otherwise(
        F.concat(F.col(path), F.lit("/index.html"))
    )
    keys = targets.select("site", F.col(path).alias("_target")).dropna().distinct()
    probes = keys.select(
        "site",
        "_target",
        F.explode(
            F.when(F.col("_target") == "", F.array(F.lit("index.html"))).otherwise(
                F.array(F.col("_target"), F.concat(F.col("_target"), F.lit("/index.html")))
            )
        ).alias("_probe"),
    )
    places = catalog if isinstance(catalog, Places) else Places(catalog)
    hits = (
        places.lookup.find(probes, "_probe", "_hit")
        .groupBy("site", "_target")
        .agg(
            F.max(F.when(F.col("_probe") == F.col("_target"), F.col("_hit"))).alias("_file"),
            F.max(F.when(F.col("_probe") != F.col("_target"), F.col("_hit"))).alias("_index"),
        )
        .select("site", "_target", F.coalesce("_file", "_index").alias("found"))
    )
    known = (
        hits.withColumn("_dir", fold_key(F.col("_target")))
        .join(places.dirs, ["site", "_dir"], "left")
        .withColumn("_missing_dir", F.col("found").isNull() & F.col("_is_dir").isNotNull())
        .select("site", "_target", "found", "_missing_dir")
    )
    return (
        targets.withColumn("_target", F.coalesce(F.col(path), nowhere(targets)))
        .join(known, ["site", "_target"], "left")
        .withColumn(
            "missing",
            F.when(
                F.col("found").isNull() & F.col(path).isNotNull(),
                F.when((F.col(path) == "") | F.col("_missing_dir"), index).otherwise(F.col(path)),
            ),
        )
        .drop("_target", "_missing_dir")
    )


def route_requests(
    requests: DataFrame, catalog: DataFrame, content_type: Column | None = None
) -> DataFrame:
    """Answer a log of site requests: ``status``, stored ``rel``.

    403 for refused paths, 200 for a file or the index of a folder, else 404.
    """
    paths = requests.withColumn("_path", safe_request_path(F.col("url")))
    return (
        locate(paths, catalog, "_path")
        .withColumn(
            "status",
            F.when(F.col("_path").isNull(), 403).when(F.col("found").isNotNull(), 200).otherwise(404),
        )
        .withColumnRenamed("found", "rel")
        .drop("_path", "missing")
    )
