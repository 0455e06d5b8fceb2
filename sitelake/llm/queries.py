"""One query per operator, over the whole of its table, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm import alignment, bpe, langid, mixing, neighbours, ngrams, phrases, pii, quality, secretscan, simhash
from sitelake.llm import topk, urls
from sitelake.llm.vectors import usable
from sitelake.plans.register import Plan
from sitelake.plans.tables import table

plan = Plan()

TOKENIZER = "word_bpe_49k.json"
TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def _id_learns(by: int, held: int) -> Column:
    """Rows that may be learned from; a row without id never is."""
    return remainder(F.col("_id"), by) != held


def _held_out(by: int, held: int) -> Column:
    return F.coalesce(remainder(F.col("doc_id"), by) == held, F.lit(True))


@plan.query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs, _id_learns(3, 1))
    return langid.identify(docs, model).withColumn("held_out", _held_out(3, 1))


@plan.query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@plan.query()
def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(table(spark, sf_dir, "documents"))


@plan.query()
def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


SQL_MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM d GROUP BY source),
p AS (
  SELECT *, sum(3 * source_size) OVER o AS held, sum(weight) OVER o AS w, sum(source_size) OVER () AS total,
         sum(weight) OVER () AS weights
  FROM s WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
level AS (
  SELECT greatest(max(total::DOUBLE / weights::DOUBLE),
                  max(CASE WHEN weights > w THEN (total - held)::DOUBLE / (weights - w)::DOUBLE END)) AS level FROM p),
t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM s, level),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
k AS (
  SELECT source, key, sum(size) AS words FROM d GROUP BY source, key),
c AS (
  SELECT source, key, words,
         coalesce(sum(words) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM k)
SELECT d.doc_id, d.size, u.source_size, u.target,
       (d.size * (u.whole + CASE WHEN c.start + c.words / 2 <= u.target - u.whole * u.source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.key = c.key"""


@plan.query(SQL_MIX)
def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents")).copies()
    return rows.select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


SQL_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.v, v.v)::BIGINT AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


@plan.query(SQL_TOP_K)
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").filter(usable(F.col("embedding"))).withColumn("embedding", whole)
    found = topk.top_k(rows, F.col("vec_id") % 50 == 0, 5)
    return found.withColumn("score", F.col("score").cast("long"))


# The given pages declare no canonical links and no refreshes, so the rules alone
# decide; linked pages are tested on small tables.
SQL_URLS = r"""
WITH p AS (
  SELECT page_id, url,
         translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
b AS (
  SELECT p.page_id, p.url, p.host, p.path, max(length(r.host || r.path)) AS n
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY ALL)
SELECT b.page_id, b.url, coalesce(b.host, '') AS host, coalesce(b.path, '') AS path, r.host || r.path AS rule,
       coalesce(r.verdict, 'allow') AS verdict, false AS linked
FROM b LEFT JOIN r ON (b.host = r.host OR ends_with(b.host, '.' || r.host)) AND starts_with(b.path, r.path)
  AND length(r.host || r.path) = b.n"""


@plan.query(SQL_URLS)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@plan.query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = bpe.encode(docs, public_tokenizers.path(TOKENIZER), decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@plan.query()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ranker = quality.fit(docs, table(spark, sf_dir, "labels"), _id_learns(5, 0))
    return quality.scored(docs, ranker).withColumn("held_out", _held_out(5, 0))


def _listed(spans: Column) -> Column:
    shown = F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    return F.array_join(shown, ",")


@plan.query()
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id",
        *[number(kind) for kind in pii.BASE],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


@plan.query()
def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secretscan.detect(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return rows.select(
        "doc_id",
        *[number(kind) for kind in secretscan.KINDS],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


SQL_PHRASES = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (
  SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM p, (VALUES (1), (2), (3)) s(k) WHERE len(w) >= k),
f AS (
  SELECT lang, k, phrase, count(*)::BIGINT AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
c AS (
  SELECT lang, k, phrase, f AS a, w, cut, array_to_string(w[:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y
  FROM f, (VALUES (1), (2)) s(cut) WHERE k > 1 AND cut < k),
m AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r,
         ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.phrase = c.y),
b AS (
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (
  SELECT lang, phrase, max(f) AS f FROM (
    SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM f WHERE k = 3)
  GROUP BY lang, phrase),
kept AS (
  SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND b.k = 2
  WHERE o.f IS NULL OR 100 * o.f < 50 * b.a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n.n, score
FROM kept JOIN n ON n.lang = kept.lang
QUALIFY row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) <= 2000"""


@plan.query(SQL_PHRASES)
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@plan.query()
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = [public_tokenizers.path(name) for name in (TOKENIZER_A, TOKENIZER_B)]
    rows = alignment.align(table(spark, sf_dir, "documents"), *paths, digest=True)
    return rows.withColumnRenamed("groups", "groups_sha256")


QUERIES, ORACLE = plan.queries, plan.oracle
