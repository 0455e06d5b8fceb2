"""Link resolution: what an href on a page points at.

The logic runs in stages, each one projection, so every intermediate value is
computed once. All of it is SQL expressions; only links that climb with ``..``
pay for the walk over their segments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelake.functions.paths import percent_decode, trim_ws

BASE = "struct<origin:string,segs:array<string>,is_dir:boolean,above:int>"

# Base of a page without a <base>: its own URL inside the archive.
DOCUMENT_BASE = """named_struct(
  'origin', CAST(NULL AS STRING), 'segs', filter(split({url}, '/'), s -> s <> ''),
  'is_dir', endswith({url}, '/'), 'above', 0)"""

# Base given by an absolute or scheme-relative URL.
EXTERNAL_BASE = r"""named_struct(
  'origin', CASE WHEN {url} RLIKE '^(?:https?:)?//' THEN regexp_extract({url}, '(?s)^((?:https?:)?//[^/]*)', 1) ELSE {url} END,
  'segs', CASE WHEN {url} RLIKE '^(?:https?:)?//' THEN filter(split({path}, '/'), s -> s <> '') ELSE CAST(array() AS ARRAY<STRING>) END,
  'is_dir', NOT {url} RLIKE '^(?:https?:)?//' OR {raw_path} = '' OR endswith({raw_path}, '/'),
  'above', 0)"""

MODE = """CASE
  WHEN _raw IS NULL OR _raw = '' THEN 'skip'
  WHEN _scheme IN ('', 'http', 'https') AND startswith(_rest, '//') THEN 'absolute'
  WHEN _scheme IN ('http', 'https') AND _scheme <> CASE WHEN startswith({base}.origin, 'https://') THEN 'https' ELSE 'http' END THEN 'foreign'
  WHEN _scheme NOT IN ('', 'http', 'https') OR _rest = '' THEN 'skip'
  ELSE 'path' END"""

# `https:host/x` on an http page names another host; without a host it is no link.
FOREIGN_URL = """CASE WHEN substring_index(_bare, '?', 1) <> '' THEN concat(
  _scheme, '://', substring_index(_bare, '?', 1),
  CASE WHEN contains(substring_index(_bare, '?', 1), '/') THEN '' ELSE '/' END,
  substr(_bare, length(substring_index(_bare, '?', 1)) + 1)) END"""

# Folder a path starts from, and how far above the top that folder already is.
START = """named_struct(
  'above', CASE WHEN startswith(_path, '/') OR {base}.origin IS NOT NULL THEN 0 ELSE {base}.above END,
  'segs', CASE WHEN startswith(_path, '/') THEN CAST(array() AS ARRAY<STRING>)
               WHEN {base}.is_dir THEN {base}.segs
               ELSE slice({base}.segs, 1, greatest(size({base}.segs) - 1, 0)) END)"""

# `..` past the top counts in `above`; on another host it has no effect.
WALK = """CASE
  WHEN _mode <> 'path' THEN NULL
  WHEN _path = '' THEN named_struct(
    'above', CASE WHEN {base}.origin IS NULL THEN {base}.above ELSE 0 END, 'segs', {base}.segs)
  WHEN NOT array_contains(_pieces, '..') THEN named_struct('above', _start.above, 'segs', concat(_start.segs, _pieces))
  ELSE aggregate(_pieces, _start, (acc, piece) -> CASE
    WHEN piece <> '..' THEN named_struct('above', acc.above, 'segs', concat(acc.segs, array(piece)))
    WHEN size(acc.segs) > 0 THEN named_struct('above', acc.above, 'segs', slice(acc.segs, 1, size(acc.segs) - 1))
    WHEN {base}.origin IS NULL THEN named_struct('above', acc.above + 1, 'segs', acc.segs)
    ELSE acc END) END"""

CLASS = """CASE
  WHEN _mode <> 'path' THEN CASE WHEN _url IS NOT NULL THEN 'external' ELSE 'skip' END
  WHEN contains(_path, '\\u0000') THEN 'local'
  WHEN _walk.above > 0 THEN 'escape'
  WHEN {base}.origin IS NOT NULL THEN 'external'
  ELSE 'local' END"""

# Shown for links that leave the archive: `../` per level, then the rest.
ESCAPE_LABEL = """CASE WHEN size(_walk.segs) = 0 THEN rtrim('/', repeat('../', _walk.above))
  ELSE concat(repeat('../', _walk.above), array_join(_walk.segs, '/'), CASE WHEN _is_dir THEN '/' ELSE '' END) END"""

REMOTE_URL = """concat({base}.origin, '/', array_join(_walk.segs, '/'),
  CASE WHEN _is_dir AND size(_walk.segs) > 0 THEN '/' ELSE '' END)"""

TARGET = f"""named_struct(
  'cls', _cls,
  'url', CASE WHEN _cls = 'external' THEN coalesce(_url, {REMOTE_URL}) END,
  'path', CASE WHEN _cls = 'escape' THEN {ESCAPE_LABEL}
               WHEN _cls = 'local' AND contains(_path, '\\u0000') THEN _path
               WHEN _cls = 'local' THEN array_join(_walk.segs, '/') END,
  'is_dir', CASE WHEN _cls IN ('local', 'escape') THEN _is_dir AND NOT contains(_path, '\\u0000') END,
  'fragment', CASE WHEN _cls = 'local' THEN _fragment END,
  'above', _walk.above,
  'segs', _walk.segs)"""


def resolve_links(
    df: DataFrame, href: str = "href", base: str = "base", out: str = "target"
) -> DataFrame:
    """Add ``out``: what ``href`` means on a page whose base is ``base``.

    ``out`` is ``struct<cls, url, path, is_dir, fragment, above, segs>`` with
    ``cls`` one of ``skip``, ``external`` (``url`` set), ``escape`` (``path`` is
    the label) and ``local`` (``path`` inside the archive).
    """

    def sql(text: str):
        return F.expr(text.replace("{base}", base))

    scheme = r"lower(regexp_extract(_raw, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1))"
    staged = (
        df.withColumn("_raw", F.translate(trim_ws(F.col(href)), "\\", "/"))
        .withColumn("_scheme", sql(scheme))
        .withColumn("_rest", sql("CASE WHEN _scheme <> '' THEN substr(_raw, length(_scheme) + 2) ELSE _raw END"))
        .withColumn("_mode", sql(MODE))
        .withColumns(
            {
                "_fragment": F.when(
                    sql("_mode = 'path' AND contains(_rest, '#')"),
                    F.nullif(trim_ws(percent_decode(sql("regexp_extract(_rest, '(?s)#(.*)$', 1)"))), F.lit("")),
                ),
                "_path": F.when(
                    sql("_mode = 'path'"),
                    percent_decode(sql("substring_index(substring_index(_rest, '#', 1), '?', 1)")),
                ),
                "_bare": sql("CASE WHEN _mode = 'foreign' THEN substring_index(ltrim('/', _rest), '#', 1) END"),
            }
        )
        .withColumns(
            {
                "_url": sql(
                    f"CASE _mode WHEN 'absolute' THEN substring_index(_raw, '#', 1) WHEN 'foreign' THEN {FOREIGN_URL} END"
                ),
                "_pieces": sql("filter(split(_path, '/'), p -> p NOT IN ('', '.'))"),
                "_start": sql(START),
                "_is_dir": sql(
                    "CASE WHEN _path = '' THEN {base}.is_dir ELSE _path RLIKE '(?:^|/)\\\\.{0,2}\\\\z' END"
                ),
            }
        )
        .withColumn("_walk", sql(WALK))
        .withColumn("_cls", sql(CLASS))
    )
    keep = [c for c in df.columns if c != out]
    return staged.select(*keep, sql(TARGET).alias(out))


def with_page_base(
    df: DataFrame, url: str = "url", base_href: str = "base_href", out: str = "base"
) -> DataFrame:
    """Add ``out``, the base of each page, and ``base_target``, where its
    ``<base>`` itself points (an escaping one is a broken link of its own)."""
    df = df.withColumn("_doc", F.expr(DOCUMENT_BASE.format(url=f"`{url}`")))
    df = resolve_links(df, base_href, "_doc", "base_target")
    raw_path = r"regexp_extract(base_target.url, '(?s)^(?:https?:)?//[^/]*/?([^?#]*)', 1)"
    df = df.withColumn("_base_path", percent_decode(F.expr(raw_path)))
    external = EXTERNAL_BASE.format(url="base_target.url", path="_base_path", raw_path=raw_path)
    chosen = f"""CASE base_target.cls
      WHEN 'external' THEN {external}
      WHEN 'local' THEN named_struct('origin', CAST(NULL AS STRING),
        'segs', filter(split(base_target.path, '/'), s -> s <> ''), 'is_dir', base_target.is_dir, 'above', 0)
      WHEN 'escape' THEN named_struct('origin', CAST(NULL AS STRING),
        'segs', base_target.segs, 'is_dir', base_target.is_dir, 'above', base_target.above)
      ELSE _doc END"""
    return df.withColumn(out, F.expr(chosen)).drop("_doc", "_base_path")
