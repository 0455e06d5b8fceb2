"""Prompts from documents, and answers from streamed chat responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelake.constants import (
    CUT_NOTICE,
    DOCUMENTS_HEADING,
    FILE_HEADING,
    QUESTION_HEADING,
)
from sitelake.functions.models import whole_number
from sitelake.functions.text import cap_text, clean_html, default_question, is_cut
from sitelake.session import stage

CHUNK = "struct<message:struct<content:string>,done:boolean,error:string,prompt_eval_count:string>"

# Chunks of one response folded together before they meet.
FOLD_BLOCK = 4096


def document_block(rel: Column, text: Column) -> Column:
    """A document as it stands in a prompt, capped and marked when cut."""
    head = cap_text(text)
    notice = F.when(
        is_cut(text),
        F.concat(
            F.when(head.endswith("\n"), F.lit("")).otherwise(F.lit("\n")), F.lit(CUT_NOTICE)
        ),
    ).otherwise(F.lit(""))
    return F.concat(F.lit(f"\n{FILE_HEADING}"), rel, F.lit("\n\n"), head, notice, F.lit("\n"))


def build_prompts(questions: DataFrame, pages: DataFrame, docs: DataFrame) -> DataFrame:
    """User message of each question.

    ``questions(question_id, question)``, ``pages(question_id, slot, rel)`` with
    at most eight rows per question, ``docs(rel, text, is_html)``. Only the
    documents asked for are read (their names are written out and broadcast when
    few); each is cleaned and capped once, before the join copies it to its
    questions.
    """
    pages = stage(pages.filter("rel is not null").select("question_id", "slot", "rel"), "pages")
    wanted = stage(pages.select("rel").distinct(), "wanted")
    text = F.when(F.col("is_html"), clean_html(F.col("text"))).otherwise(F.col("text"))
    blocks = (
        docs.join(wanted, "rel", "left_semi")
        .withColumn("text", text)
        .select("rel", document_block(F.col("rel"), F.col("text")).alias("block"))
    )
    bodies = (
        pages.join(blocks, "rel")
        .groupBy("question_id")
        .agg(F.array_sort(F.collect_list(F.struct("slot", "block"))).alias("blocks"))
    )
    message = F.concat(
        F.lit(f"{DOCUMENTS_HEADING}\n"),
        F.array_join(F.transform("blocks", lambda b: b["block"]), ""),
        F.lit(f"\n{QUESTION_HEADING}"),
        default_question(F.col("question")),
    )
    return questions.join(bodies, "question_id").select(
        "question_id", F.size("blocks").alias("documents"), message.alias("prompt")
    )


def chat_requests(prompts: DataFrame, model: str, system: str) -> DataFrame:
    """JSON request body of each prompt."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    body = F.struct(
        F.array(message("system", F.lit(system)), message("user", F.col("prompt"))).alias("messages"),
        F.lit(model).alias("model"),
        F.lit(True).alias("stream"),
        F.lit(False).alias("think"),
    )
    return prompts.select("question_id", F.to_json(body).alias("request"))


def parse_chunks(lines: DataFrame) -> DataFrame:
    """Streamed response lines ``(request_id, ord, line)`` as typed columns."""
    line = F.trim(F.regexp_replace("line", r"[\r\n]+", " "))
    value = F.from_json(line, CHUNK)
    parsed = lines.filter(line != "").withColumn("_v", value)
    v = F.col("_v")
    bad = v.isNull() | ~F.coalesce(F.try_parse_json(line).isNotNull(), F.lit(False))
    tokens = whole_number(v["prompt_eval_count"])
    return parsed.select(
        "request_id",
        "ord",
        F.coalesce(v["message"]["content"], F.lit("")).alias("content"),
        F.when(tokens > 0, tokens).alias("tokens"),
        F.coalesce(v["done"], F.lit(False)).alias("done"),
        F.when(bad, F.lit("unreadable")).otherwise(F.nullif(F.trim(v["error"]), F.lit(""))).alias("error"),
    )


def answer_status(error: Column, done: Column, answer: Column) -> Column:
    return (
        F.when(error == "unreadable", "unreadable")
        .when(error.isNotNull(), "error")
        .when(~done, "unfinished")
        .when(answer == "", "empty")
        .otherwise("ok")
    )


def fold_chat(chunks: DataFrame) -> DataFrame:
    """One answer per request from its ordered chunks.

    ``(request_id, status, answer, tokens, error)``. The first bad line or
    error decides; the answer is kept only when the response was finished. Long
    responses are joined block by block, so no task sorts a whole response.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "content")))
    blocks = chunks.groupBy("request_id", F.floor(F.col("ord") / FOLD_BLOCK).alias("block")).agg(
        F.array_join(F.transform(ordered, lambda c: c["content"]), "").alias("content"),
        F.max(F.when(F.col("tokens").isNotNull(), F.struct("ord", "tokens"))).alias("tokens"),
        F.bool_or("done").alias("done"),
        F.min(F.when(F.col("error").isNotNull(), F.struct("ord", "error"))).alias("error"),
    )
    whole = F.array_sort(F.collect_list(F.struct("block", "content")))
    folded = blocks.groupBy("request_id").agg(
        F.array_join(F.transform(whole, lambda b: b["content"]), "").alias("answer"),
        F.max("tokens")["tokens"].alias("tokens"),
        F.bool_or("done").alias("done"),
        F.min("error")["error"].alias("error"),
    )
    status = answer_status(F.col("error"), F.col("done"), F.col("answer"))
    return folded.withColumn("status", status).select(
        "request_id",
        "status",
        F.when(F.col("status") == "ok", F.col("answer")).alias("answer"),
        F.when(F.col("status") == "ok", F.col("tokens")).alias("tokens"),
        F.when(F.col("status") == "error", F.col("error")).alias("error"),
    )


def context_usage(runs: DataFrame, models: DataFrame) -> DataFrame:
    """How full each run's context window is.

    ``runs(run_id, model, used, loaded_window)``, ``models(model, window)``. The
    window a model was loaded with beats the one its card declares.
    """
    window = F.coalesce("loaded_window", "window")
    known = F.col("used").isNotNull() & (window > 0)
    return runs.join(models.select("model", "window"), "model", "left").select(
        "run_id",
        "model",
        "used",
        F.when(window > 0, window).alias("window"),
        F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("used") / window * 100))).alias("percent"),
        F.when(known, F.col("used") >= window).otherwise(F.lit(False)).alias("full"),
    )
