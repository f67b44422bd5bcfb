"""Retrieved context, prompts and batch answers.

Layouts follow the reference: each context block is ``CONTEXT NUMBER: i``,
``DOCUMENT ID: i`` (the counter), the docno on its own line, a blank line,
the best passage text and a blank line.  Prompt layout 1 sends the context
as a ``tool`` message; layout 2 puts ``context + "\\n\\n" + question`` in the
user message.  Answer generation calls a caller-supplied function in Arrow
batches; no network client lives here.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.models import in_batches

CONTEXT_DOCS = 3
BATCH_SIZE = 16

# The two system prompts of the reference's answer layouts.
SYSTEM_PROMPT_TOOL = "You are a helpful assistant. Answer reading the context ONLY if it is relevant.IF THE TOPIC OF DISCUSSION IS NOT IN THE CONTEXT REPLY 'I DO NOT KNOW' OTHERWISE MENTION THE RELEVANT THINGS IN THE CONTEXT"  # noqa: E501
SYSTEM_PROMPT_USER = "You are a helpful assistant. Answer reading the context ONLY if it is relevant.IF THE TOPIC OF DISCUSSION IS NOT IN THE CONTEXT REPLY 'I DO NOT KNOW' OTHERWISE MENTION THE RELEVANT THINGS IN THE CONTEXT."  # noqa: E501
MESSAGE = "array<struct<role:string,content:string>>"


def context(run: DataFrame, n: int = CONTEXT_DOCS) -> DataFrame:
    """E7 + D17 + I2: ``(qid, context)`` from the top ``n`` rows of a run
    carrying ``text``; fewer than ``n`` results give fewer blocks."""
    # The labels of a context block.
    top = run.filter(F.col("rank") <= n)
    blocks = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "docno", "text"))),
        lambda s, i: F.concat(F.lit("CONTEXT NUMBER: "), (i + 1).cast("string"), F.lit("\n"),
                              F.lit("DOCUMENT ID: "), (i + 1).cast("string"), F.lit("\n"),
                              s["docno"].cast("string"), F.lit("\n\n"),
                              F.coalesce(s["text"], F.lit("")), F.lit("\n\n")))
    return top.groupBy("qid").agg(F.array_join(blocks, "").alias("context"))


def prompts_tool(questions: DataFrame, contexts: DataFrame, query: str = "query") -> DataFrame:
    """System / tool(context) / user(question) messages."""
    msg = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT_TOOL).alias("content")),
        F.struct(F.lit("tool").alias("role"), F.coalesce("context", F.lit("")).alias("content")),
        F.struct(F.lit("user").alias("role"), F.col(query).alias("content")))
    return questions.join(contexts, "qid", "left").select(
        "qid", msg.alias("messages"), F.coalesce("context", F.lit("")).alias("context"))


def prompts_user(questions: DataFrame, contexts: DataFrame, query: str = "query") -> DataFrame:
    """I4: system / user(context + blank line + question) messages."""
    user = F.concat(F.coalesce("context", F.lit("")), F.lit("\n\n"), F.col(query))
    msg = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT_USER).alias("content")),
        F.struct(F.lit("user").alias("role"), user.alias("content")))
    return questions.join(contexts, "qid", "left").select(
        "qid", msg.alias("messages"), F.coalesce("context", F.lit("")).alias("context"))


def first_passage() -> Column:
    """Stand-in answer (no model): the text of the first context block, from
    the ``tool`` message where there is one, else from the user's."""
    said = lambda role: F.get(F.filter("messages", lambda m: m["role"] == role), 0)["content"]      # noqa: E731
    has_tool = F.exists("messages", lambda m: m["role"] == "tool")
    parts = F.split(F.when(has_tool, said("tool")).otherwise(F.coalesce(said("user"), F.lit(""))), "\n\n", -1)
    return F.when(F.size(parts) > 2, F.get(parts, 1)).otherwise("")


def generate(prompts: DataFrame, answer_fn: Callable[[list[list[dict]]], list[str]] | None = None,
             temperature: float = 0.7, max_tokens: int = 256, batch_size: int = BATCH_SIZE) -> DataFrame:
    """``(qid, answer[, context])`` of every prompt.

    ``answer_fn`` gets a list of prompts (each a list of messages), at most
    ``batch_size`` at a time, and returns as many answers; it runs in Arrow
    batches (``mapInPandas``).  Take its model from ``models.worker_model``, so
    that each Python worker makes it once.  Without a function the stand-in
    answers, in Spark's own expressions.  A ``context`` column of the prompts is
    passed through.  ``temperature`` and ``max_tokens`` are passed on when the
    function accepts them."""
    keep = ["context"] if "context" in prompts.columns else []
    if answer_fn is None:
        return prompts.select("qid", first_passage().alias("answer"), *keep)
    params = inspect.signature(answer_fn).parameters
    extra = {k: v for k, v in (("temperature", temperature), ("max_tokens", max_tokens)) if k in params}
    qid_type = prompts.schema["qid"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            asked = [[dict(m) for m in msgs] for msgs in pdf["messages"]]
            answers = [a for part in in_batches(asked, batch_size) for a in answer_fn(part, **extra)]
            out = pd.DataFrame({"qid": pdf["qid"].values, "answer": answers})
            for c in keep:
                out[c] = pdf[c].values
            yield out

    schema = f"qid {qid_type}, answer string" + "".join(f", {c} string" for c in keep)
    return prompts.select("qid", "messages", *keep).mapInPandas(run, schema)


def final_answers(answers: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """``answer + blank line + context``; the context comes from the
    answers' own ``context`` column when present (no second join)."""
    if contexts is None or "context" in answers.columns:
        src = answers
    else:
        src = answers.join(contexts, "qid", "left")
    return src.select(
        "qid", F.concat(F.col("answer"), F.lit("\n\n"), F.coalesce("context", F.lit(""))).alias("answer"))
