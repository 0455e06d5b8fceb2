"""Queries about prompts, answers, model windows and reading history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.functions.models import context_window as window_of
from sitelake.operators import history
from sitelake.operators import prompts as ops
from sitelake.plans.register import Plan
from sitelake.plans.tables import table

plan = Plan()
QUERIES, ORACLE, query = plan.queries, plan.oracle, plan.query

SYSTEM = "Answer from the documents given, and name the files used."
MODEL = "notes-model"

# --- questions --------------------------------------------------------------------
# Every user turn is a question. It mentions one document per word, by the length
# of the words before it, so questions mention few or many, some of them twice.

SQL_DOCS = "(SELECT count(*) FROM documents)"
SQL_PICKS = f"""
questions AS (SELECT conv_id * 1000 + turn AS question_id, CASE WHEN turn % 4 = 2 THEN ' ' ELSE text END AS question,
                     string_split(text, ' ') AS words FROM conversations WHERE role = 'user'),
picks AS (SELECT question_id, i AS pos, (question_id * 7 + length(words[i + 1]) * 13) % {SQL_DOCS} AS doc_id
          FROM (SELECT question_id, words, unnest(range(len(words))) AS i FROM questions)),
first AS (SELECT question_id, doc_id, min(pos) AS pos FROM picks GROUP BY ALL),
slots AS (SELECT *, CASE WHEN row_number() OVER w <= 8 THEN row_number() OVER w END AS slot FROM first
          WINDOW w AS (PARTITION BY question_id ORDER BY pos))"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "conversations")
        .filter("role = 'user'")
        .selectExpr(
            "conv_id * 1000 + turn AS question_id",
            "CASE WHEN turn % 4 = 2 THEN ' ' ELSE text END AS question",
            "split(text, ' ') AS words",
        )
    )


def rel_of(doc_id) -> F.Column:
    return F.concat(F.lit("d"), doc_id, F.lit(".html"))


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = table(spark, sf_dir, "documents").count()
    asked = questions(spark, sf_dir).select("question_id", F.posexplode("words").alias("pos", "word"))
    doc_id = (F.col("question_id") * 7 + F.length("word") * 13) % F.lit(count)
    return asked.select("question_id", "pos", rel_of(doc_id).alias("rel"))


@query(
    f"""
WITH {SQL_PICKS}
SELECT question_id, CAST(pos AS BIGINT) AS pos, CAST(slot AS BIGINT) AS slot, 'd' || doc_id || '.html' AS rel FROM slots
"""
)
def doc_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.doc_batches(picks(spark, sf_dir))
    return found.select(
        "question_id", F.col("pos").cast("bigint").alias("pos"), F.col("slot").cast("bigint").alias("slot"), "rel"
    )


@query(
    f"""
WITH {SQL_PICKS}
SELECT q.question_id, CAST(CASE WHEN len(words) > 12 THEN s.slot WHEN length(words[1]) > 3 THEN 1 END AS BIGINT) AS slot,
  CASE WHEN len(words) > 12 THEN 'd' || s.doc_id || '.html' WHEN length(words[1]) > 3 THEN 'now.html' END AS rel,
  CASE WHEN len(words) <= 12 AND length(words[1]) <= 3 THEN 'no page' END AS error
FROM questions q LEFT JOIN slots s ON s.question_id = q.question_id AND s.slot IS NOT NULL AND len(words) > 12
"""
)
def pages_to_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short questions send the current page, or are refused without one."""
    asked = questions(spark, sf_dir).withColumn(
        "current", F.when(F.length(F.col("words")[0]) > 3, F.lit("now.html")).otherwise(F.lit(" "))
    )
    wordy = asked.filter(F.size("words") > 12).select("question_id")
    batches = history.batch_slots(picks(spark, sf_dir).join(wordy, "question_id", "left_semi"))
    return history.pages_to_send(asked, batches).withColumn("slot", F.col("slot").cast("bigint"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as small HTML pages."""
    html = F.concat(F.lit("<p><script>x()</script>"), "text", F.lit("<STYLE>p{}</style></p>"))
    return table(spark, sf_dir, "documents").select(rel_of(F.col("doc_id")).alias("rel"), html.alias("text"), F.lit(True).alias("is_html"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    batches = history.batch_slots(picks(spark, sf_dir))
    return ops.build_prompts(asked.select("question_id", "question"), batches, documents(spark, sf_dir))


SQL_PROMPTS = f"""
WITH {SQL_PICKS},
blocks AS (SELECT doc_id, chr(10) || '## fichier: d' || doc_id || '.html' || chr(10) || chr(10) || left('<p>' || text || '</p>', 12000)
  || CASE WHEN length(text) + 7 > 12000 THEN CASE WHEN left('<p>' || text || '</p>', 12000) LIKE '%' || chr(10) THEN '' ELSE chr(10) END
     || '[Document tronqué à 12 000 caractères.]' ELSE '' END || chr(10) AS block FROM documents),
bodies AS (SELECT question_id, string_agg(block, '' ORDER BY slot) AS body, count(*) AS n FROM slots JOIN blocks USING (doc_id)
  WHERE slot IS NOT NULL GROUP BY question_id),
prompts AS (SELECT question_id, n AS documents, 'Documents :' || chr(10) || body || chr(10) || 'Question : '
  || CASE WHEN trim(question) = '' THEN 'Résume.' ELSE trim(question) END AS prompt FROM questions JOIN bodies USING (question_id))"""


@query(SQL_PROMPTS + " SELECT question_id, documents, md5(prompt) AS digest FROM prompts")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts(spark, sf_dir).select(
        "question_id", F.col("documents").cast("bigint").alias("documents"), F.md5("prompt").alias("digest")
    )


@query(
    SQL_PROMPTS
    + f"""
SELECT question_id, '{SYSTEM}' AS system, md5(prompt) AS digest, '{MODEL}' AS model, true AS stream FROM prompts
"""
)
def chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request bodies, read back to compare what they carry."""
    made = ops.chat_requests(prompts(spark, sf_dir), MODEL, SYSTEM)
    body = F.from_json(
        "request", "model string, stream boolean, think boolean, messages array<struct<role:string,content:string>>"
    )
    parsed = made.select("question_id", body.alias("b"))
    return parsed.select(
        "question_id",
        F.col("b.messages")[0]["content"].alias("system"),
        F.md5(F.col("b.messages")[1]["content"]).alias("digest"),
        F.col("b.model").alias("model"),
        F.col("b.stream").alias("stream"),
    )


# --- answers ------------------------------------------------------------------------
# A conversation is one response, its turns the chunks. Some never finish, some
# carry an error, a broken line, or no text.

SQL_CHAT = """
chunks AS (SELECT conv_id AS request_id, turn AS ord, CASE WHEN conv_id % 9 = 4 THEN '' ELSE text END AS content,
   turn = max(turn) OVER (PARTITION BY conv_id) AND conv_id % 5 <> 2 AS done, conv_id % 7 = 3 AND turn = 1 AS failed,
   conv_id % 11 = 6 AND turn = 0 AS torn, CASE WHEN turn % 2 = 1 THEN length(text) END AS tokens FROM conversations),
folded AS (SELECT request_id, string_agg(content, '' ORDER BY ord) AS answer, max_by(tokens, ord) FILTER (WHERE tokens > 0) AS tokens,
   bool_or(done) AS done, bool_or(failed) AS failed, bool_or(torn) AS torn FROM chunks GROUP BY request_id),
judged AS (SELECT *, CASE WHEN torn THEN 'unreadable' WHEN failed THEN 'error' WHEN NOT done THEN 'unfinished'
   WHEN answer = '' THEN 'empty' ELSE 'ok' END AS status FROM folded),
answers AS (SELECT request_id, status, CASE status WHEN 'ok' THEN md5(answer) END AS answer, CASE status WHEN 'ok' THEN tokens END AS tokens,
  CASE status WHEN 'error' THEN 'out of memory' END AS error FROM judged)"""


def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    line = F.to_json(
        F.struct(
            F.struct(F.when(F.expr("conv_id % 9 = 4"), F.lit("")).otherwise(F.col("text")).alias("content")).alias("message"),
            F.expr("turn = last AND conv_id % 5 <> 2").alias("done"),
            F.when(F.expr("conv_id % 7 = 3 AND turn = 1"), F.lit(" out of memory ")).alias("error"),
            F.when(F.expr("turn % 2 = 1"), F.length("text")).alias("prompt_eval_count"),
        )
    )
    torn = F.when(F.expr("conv_id % 11 = 6 AND turn = 0"), F.concat(F.lit("{"), line)).otherwise(line)
    return turns.join(last, "conv_id").select(
        F.col("conv_id").alias("request_id"), F.col("turn").alias("ord"), F.concat(F.lit("  "), torn, F.lit("\r")).alias("line")
    )


def answers(folded: DataFrame) -> DataFrame:
    return folded.select("request_id", "status", F.md5("answer").alias("answer"), "tokens", "error")


@query(f"WITH {SQL_CHAT} SELECT * FROM answers")
def fold_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(ops.fold_chat(ops.parse_chunks(chat_lines(spark, sf_dir))))


# --- models -------------------------------------------------------------------------


SQL_CARDS = """
cards AS (SELECT p_partkey, p_name || '-' || p_partkey AS model,
  CASE p_partkey % 5 WHEN 0 THEN 1024 * (1 + p_size) WHEN 1 THEN 2048 + p_size WHEN 2 THEN 4096 WHEN 3 THEN 512 + p_size END AS win FROM part)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = F.expr(
        """CASE p_partkey % 5
      WHEN 0 THEN concat('{"parameters":"stop x\\\\n  num_ctx   ', 1024 * (1 + p_size), '\\\\ntemperature 1","model_info":{"a.context_length":7}}')
      WHEN 1 THEN concat('{"parameters":"num_ctx 0","model_info":{"a.b":1,"z.context_length":5,"q.context_length":', 2048 + p_size, '}}')
      WHEN 2 THEN '{"model_info":{"a.context_length":4096.0,"b.context_length":1.5}}'
      WHEN 3 THEN concat('{"model_info":{"a.context_length":-3,"c.context_length":', 512 + p_size, '}}')
      ELSE '{"parameters":"top_num_ctx 5","model_info":{"a.context_length":0.5}}' END"""
    )
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.concat("p_name", F.lit("-"), "p_partkey").alias("model"), card.alias("card")
    )


@query(f'WITH {SQL_CARDS} SELECT p_partkey, CAST(win AS BIGINT) AS "window" FROM cards')
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards(spark, sf_dir).select("p_partkey", window_of(F.col("card")).alias("window"))


@query(
    f"""
WITH {SQL_CARDS}, runs AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity * 100 AS BIGINT) AS used,
    CASE WHEN l_linenumber % 3 = 0 THEN 3000 END AS loaded FROM lineitem)
SELECT l_orderkey, l_linenumber, used, CAST(coalesce(loaded, win) AS BIGINT) AS "window",
  CASE WHEN coalesce(loaded, win) > 0 THEN round(least(100.0, used * 100.0 / coalesce(loaded, win)), 4) END AS percent,
  coalesce(used >= coalesce(loaded, win), false) AS "full"
FROM runs LEFT JOIN cards ON p_partkey = l_partkey
"""
)
def context_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as runs of the model their part stands for."""
    known = cards(spark, sf_dir).select("p_partkey", "model", window_of(F.col("card")).alias("window"))
    lines = table(spark, sf_dir, "lineitem").join(
        known.select(F.col("p_partkey").alias("l_partkey"), "model"), "l_partkey", "left"
    )
    runs = lines.select(
        F.struct("l_orderkey", "l_linenumber").alias("run_id"),
        "model",
        (F.col("l_quantity") * 100).cast("bigint").alias("used"),
        F.when(F.col("l_linenumber") % 3 == 0, F.lit(3000).cast("bigint")).alias("loaded_window"),
    )
    return ops.context_usage(runs, known).select(
        "run_id.*", "used", "window", F.round("percent", 4).alias("percent"), "full"
    )


# --- history ------------------------------------------------------------------------
# A user is a pack; an event a navigation, its type the page asked for.

SQL_VISITS = """
visits AS (SELECT user_id AS pack, event_id, ts, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 'index.html'
  ELSE event_type || '/' || (event_id % 7) || '.html' END AS rel FROM events WHERE event_type <> 'purchase')"""


def visits(events: DataFrame) -> DataFrame:
    """Navigations within the reader's own pages, resolved to files.

    Purchases leave for another host and errors resolve to nothing.
    """
    url = F.expr(
        """CASE event_type WHEN 'purchase' THEN 'https://shop.example:8080/x'
        WHEN 'signup' THEN 'http://127.0.0.1:8080/' ELSE concat('HTTP://127.0.0.1:8080/', event_type, '/', event_id % 7, '.html') END"""
    )
    seen = events.withColumn("url", url).filter(history.is_own_origin(F.col("url"), F.lit(8080)))
    path = F.regexp_extract("url", "^[A-Za-z]+://[^/]*(/.*)$", 1)
    rel = (
        F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
        .when(~history.looks_like_document(path), F.lit("index.html"))
        .otherwise(F.ltrim(path, F.lit("/")))
    )
    return seen.select(
        F.col("user_id").alias("pack"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), rel.alias("rel")
    )


@query(f"WITH {SQL_VISITS} SELECT pack, max_by(rel, (ts, event_id)) AS rel FROM visits WHERE rel IS NOT NULL GROUP BY pack")
def current_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.current_page(visits(table(spark, sf_dir, "events"))).select("pack", "rel")


@query(
    """
SELECT user_id AS key, event_id // 500 AS gen, event_id, value FROM events
QUALIFY event_id // 500 = max(event_id // 500) OVER (PARTITION BY user_id)
"""
)
def latest_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "events").selectExpr("user_id AS key", "event_id div 500 AS gen", "event_id", "value")
    return history.latest_generation(results)


def batch_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS pack",
        "event_id AS seq",
        "CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'remove' ELSE 'add' END AS action",
        "concat('p', event_id % 17, '.html') AS rel",
    )


@query(
    """
WITH RECURSIVE log AS (
  SELECT user_id AS pack, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
         event_type IN ('error', 'signup') AS removes, 'p' || (event_id % 17) || '.html' AS rel FROM events),
states AS (
  SELECT DISTINCT pack, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS docs FROM log
  UNION ALL
  SELECT s.pack, l.n, CASE WHEN removes THEN list_filter(docs, lambda d: d <> l.rel)
    WHEN list_contains(docs, l.rel) OR len(docs) >= 8 THEN docs ELSE list_append(docs, l.rel) END
  FROM states s JOIN log l ON l.pack = s.pack AND l.n = s.n + 1),
ends AS (SELECT pack, max_by(docs, n) AS docs FROM states GROUP BY pack)
SELECT pack, CAST(unnest(range(1, len(docs) + 1)) AS BIGINT) AS slot, unnest(docs) AS rel FROM ends
"""
)
def replay_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.replay_batches(batch_actions(spark, sf_dir))
    return found.withColumn("slot", F.col("slot").cast("bigint"))
