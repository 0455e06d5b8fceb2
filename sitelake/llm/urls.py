"""URL filters that follow redirects and canonical links."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.constants import WHITE_SPACE
from sitelake.llm.batches import by_size
from sitelake.llm.components import components
from sitelake.llm.words import ascii_lower
from sitelake.operators.catalog import nowhere
from sitelake.operators.parse import CLOSING, MARKUP, NAME, tag_attributes
from sitelake.session import stage

#: (verdict, host, path): the rules of the query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
HOST_AND_PATH = re.compile(r"[^:/?#]*://([^/?#]*)(/(?!/).*)", re.S)
#: Seconds, then the target of a refresh, with or without ``url=`` and quotes.
REFRESH = re.compile(
    r"""\s*[0-9.]+\s*(?:[;,]\s*|(?<=\s))(?:url\s*=\s*)?(?:"(?P<dq>[^"]*)|'(?P<sq>[^']*)|(?P<raw>.+))""", re.I | re.S
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?`` or ``#``; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def page_key(url: Column) -> Column:
    """One name for a page: host, path and query, without scheme and fragment."""
    key = F.concat(host_of(url), path_of(url), F.regexp_extract(url, _PARTS, 3))
    return F.when(F.contains(url, F.lit("://")), key)


def _join(base: str, target: str) -> str | None:
    """A link against the URL of its page; null for an empty link and one that is no URL."""
    target = target.strip(WHITE_SPACE)
    if not target or target.startswith("#"):
        return None
    try:
        # Joined as http whatever the scheme, which is no part of a page's key.
        whole = urljoin("http://" + base.partition("://")[2], target)
        # A whole URL keeps its dots when it is joined; its path alone does not.
        parts = HOST_AND_PATH.fullmatch(whole)
        return urljoin(f"http://{parts[1]}/", parts[2]) if parts else whole
    except ValueError:
        return None


def page_links(url: str, html: str) -> list[str]:
    """Canonical and refresh targets of a page as whole URLs, by its ``<base>`` if it has one."""
    found, base, at = [], None, 0
    while (token := MARKUP.match(html, at)) and token["tag"] is not None:
        tag, at = token["tag"], token.end()
        end = NAME.match(tag).end()
        name = tag[:end].lower()
        if name in ("base", "link", "meta"):
            values: dict[str, str] = {}
            for key, value in tag_attributes(tag, end):
                values.setdefault(key, value)
            if name == "base":
                base = base or values.get("href", "").strip(WHITE_SPACE) or None
            elif name == "link" and "canonical" in values.get("rel", "").lower().split():
                found.append(values.get("href", ""))
            elif name == "meta" and values.get("http-equiv", "").strip(WHITE_SPACE).lower() == "refresh":
                refresh = REFRESH.match(values.get("content", ""))
                found += [refresh[refresh.lastgroup]] if refresh else []
        if name in CLOSING:
            close = CLOSING[name].search(html, at)
            if close is None:
                break
            at = close.end()
    start = (_join(url, base) if base else None) or url
    return [whole for target in found if (whole := _join(start, target))]


def declared_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a``-``b`` edges from pages to their canonical and refresh targets.

    Markup is read as tags (comments and script bodies hold none), entities are
    decoded, and ``.`` and ``..`` are followed. Only pages that can have such a tag
    go to Python.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in by_size(frames, "html"):
            found = [(u, to) for u, text in zip(frame["url"], frame["html"], strict=True) for to in page_links(u, text)]
            yield pd.DataFrame(found, columns=["url", "to"])

    # A name may be written in entities, too.
    some = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    some = some.filter(F.contains("url", F.lit("://")) & F.col("html").rlike(r"(?i)canonical|refresh|&#"))
    found = some.mapInPandas(run, "url string, to string")
    return found.select(page_key(F.col("url")).alias("a"), page_key(F.col("to")).alias("b"))


def rules_frame(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def _host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """``host`` with all rules of it and the domains above it, the longest first."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    given = rules.select(
        ascii_lower(F.col("host")).alias("_domain"),
        F.struct(
            (F.length("host") + F.length("path")).alias("n"),
            (F.col("verdict") == "allow").alias("allow"),
            "path",
            "verdict",
            F.concat(ascii_lower(F.col("host")), "path").alias("rule"),
        ).alias("_rule"),
    )
    return (
        hosts.select("host", F.explode(above).alias("_domain"))
        .join(given, "_domain")
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("_rule"), asc=False).alias("_rules"))
    )


def _judged(frame: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``_own``, the verdict of the longest rule that fits.

    Rules meet the distinct hosts only. The domains above a host and the rules of
    a domain bound the list that a host carries. These lists are written out:
    by their true size Spark broadcasts them, and a crowded host stays where it
    is, or joins on the host and splits it.
    """
    of = stage(_host_rules(frame.select("host").distinct(), rules), "url-hosts").withColumnRenamed("host", "_host")
    fits = F.filter("_rules", lambda r: F.startswith(F.col("path"), r.path))
    best = F.get(fits, 0)
    return (
        frame.join(of, F.col("host") == F.col("_host"), "left")
        .withColumn("rule", best.rule)
        .withColumn("_own", best.verdict)
        .drop("_host", "_rules")
    )


def judge(
    pages: DataFrame,
    rules: DataFrame | None = None,
    redirects: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str | None = "html",
) -> DataFrame:
    """``page_id, url, host, path, rule, verdict, linked`` for every row of ``pages``.

    Pages linked by redirects (``src, dst`` URLs), canonical links or refreshes,
    over any number of hops, are one thing: if a rule blocks one of their URLs,
    those that no rule names are blocked too. A page's own rule, allow or block,
    always comes first; a page that no rule and no link reaches is allowed.
    Links are relative to the page or its ``<base>``; a link that is empty, only a
    fragment or no URL links nothing. URLs of pages are compared as they are written.

    A null URL, or one without ``://``, has an empty host and path and is allowed;
    equal rows are judged alike; of rules of equal length, allow wins; an empty
    table gives no rows; other columns are not carried.
    """
    spark = pages.sparkSession
    rules = rules_frame(spark) if rules is None else rules
    edges = spark.createDataFrame([], "a string, b string")
    if html is not None:
        edges = edges.union(declared_links(pages, url, html))
    if redirects is not None:
        edges = edges.union(redirects.select(page_key(F.col("src")), page_key(F.col("dst"))))
    edges = stage(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b"), "url-links")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).select(
        "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), page_key(F.col("url")).alias("_key")
    )
    own = _judged(rows, rules)
    if edges.isEmpty():
        blocked, linked = F.lit(False), F.lit(False)
    else:
        nodes = components(edges).withColumn("_node_url", F.concat(F.lit("http://"), "node"))
        nodes = nodes.select("node", "component", host_of(F.col("_node_url")).alias("host"), path_of(F.col("_node_url")).alias("path"))
        nodes = stage(_judged(nodes, rules).select("node", "component", "_own"), "url-nodes")
        bad = nodes.groupBy("component").agg(F.bool_or(F.coalesce(F.col("_own") == "block", F.lit(False))).alias("_bad"))
        reach = nodes.join(bad, "component").select(F.col("node").alias("_node"), "_bad")
        own = own.withColumn("_key", F.coalesce("_key", nowhere(own)))
        own = own.join(reach, F.col("_key") == F.col("_node"), "left")
        blocked, linked = F.coalesce("_bad", F.lit(False)), F.col("_node").isNotNull()
    verdict = F.coalesce("_own", F.when(blocked, "block").otherwise("allow"))
    return own.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), linked.alias("linked"))
