"""Answers: context, messages, the extractive stub, citations, confidence and the decision to decline."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import confidence_tokens, gap_tokens, sentences

INTRO = "The numbered blocks below are the reference context. Cite a block by its number in brackets."
# Fixed value: what stands for an empty context.
NO_CONTEXT = "(No context provided.)"
SYSTEM = "Answer from the context only, and say so where it does not hold the answer."
FORMAT = "Cite the blocks that support each statement, as in [1]."
# Fixed value: the phrase by which a declined answer is known.
DECLINE = "I don't have enough information in the context to answer this question."
WEIGHTS = {"retrieval": 0.4, "citation": 0.3, "completeness": 0.3}


def context_block(rank: str, content: str, source: str, heading: str) -> Column:
    head = F.concat(F.lit("[Source: "), F.coalesce(F.col(source), F.lit("unknown")), F.lit("]"), F.when(F.length(heading) > 0, F.concat(F.lit(" | heading: "), F.col(heading))).otherwise(""))
    return F.concat(F.lit('<context id="'), F.col(rank), F.lit('">\nReference '), F.col(rank), F.lit(". ("), head, F.lit(")\n"), F.trim(F.coalesce(F.col(content), F.lit(""))), F.lit("\n</context>"))


def messages(ranked: DataFrame, queries: DataFrame, query_key: str, query: str, content: str, source: str, heading: str) -> DataFrame:
    """(query_key, context, messages): numbered context blocks and the two messages for a chat model; a query without chunks gets an empty context.

    The chunks of a query are gathered into one row: ``ranked`` holds its best few.
    """
    blocks = ranked.select(query_key, "rank", context_block("rank", content, source, heading).alias("block"))
    joined = blocks.groupBy(query_key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n").alias("blocks"))
    context = F.when(F.col("blocks").isNull(), F.lit(f"{INTRO}\n\n{NO_CONTEXT}")).otherwise(F.concat(F.lit(f"{INTRO}\n\n"), F.col("blocks")))
    user = F.concat("context", F.lit(f"\n\n{FORMAT}\n\nQuestion: "), F.col(query))
    both = F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
    return queries.select(query_key, query).join(joined, query_key, "left").withColumn("context", context).select(query_key, "context", both.alias("messages"))


def generate(rows: DataFrame, messages_column: str, respond: Callable[[list[dict]], str] | None) -> DataFrame:
    """Adds ``answer``, ``error`` and ``latency_ms``: what ``respond`` makes of the messages and how long it took; an exception becomes the row's error."""
    if respond is None:
        raise RuntimeError("no generator configured")

    @F.pandas_udf("answer string, error string, latency_ms double")
    def run(m: pd.Series) -> pd.DataFrame:
        out = []
        for x in m:
            began = time.perf_counter()
            try:
                got, error = respond([dict(role=y["role"], content=y["content"]) for y in x]), None
            except Exception as e:
                got, error = None, f"{type(e).__name__}: {e}"
            out.append((got, error, (time.perf_counter() - began) * 1000))
        return pd.DataFrame(out, columns=["answer", "error", "latency_ms"])

    r = rows.withColumn("r__", run(messages_column))
    return r.withColumns({c: F.col(f"r__.{c}") for c in ("answer", "error", "latency_ms")}).drop("r__")


def extractive(ranked: DataFrame, queries: DataFrame, query_key: str, content: str, most: int = 120) -> DataFrame:
    """(query_key, answer): the first ``most`` characters of the best chunk, without tags and line ends, cited as [1]; declines without one."""
    text = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(F.col(content), F.lit("")), "<[^>]+>", "")), "\n", " ")
    top = ranked.where(F.col("rank") == 1).select(query_key, F.concat(F.substring(text, 1, most), F.lit(" [1]")).alias("a"))
    return queries.select(query_key).join(top, query_key, "left").select(query_key, F.coalesce("a", F.lit(DECLINE)).alias("answer"))


def citations(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, sentence_pos, cite_pos, number, claim): every [n] with the sentence it stands in, both positions from 0."""
    s = answers.select(key, F.posexplode(sentences(answer)).alias("sentence_pos", "claim"))
    return s.select(key, "sentence_pos", "claim", F.posexplode(F.regexp_extract_all("claim", F.lit(r"\[(\d+)\]"), 1)).alias("cite_pos", "n")).select(key, "sentence_pos", "cite_pos", F.col("n").try_cast("int").alias("number"), "claim")


def verify(cited: DataFrame, ranked: DataFrame, key: str, content: str, judge: Callable[[str, str], str] | None = None, legacy_substring: bool = False) -> DataFrame:
    """Adds ``supported`` and ``reason``: false for a number that no block has; NULL without a judge; else the judge's verdict.

    The verdict must be the one word SUPPORTED; with ``legacy_substring`` it is enough that the reply holds it.
    """
    src = ranked.select(key, F.col("rank").cast("int").alias("number"), F.col(content).alias("source__"), F.lit(True).alias("there__"))
    rows = cited.join(src, [key, "number"], "left")
    missing = F.col("there__").isNull()
    gone = "the cited block was not provided"
    if judge is None:
        return rows.withColumn("supported", F.when(missing, F.lit(False))).withColumn("reason", F.when(missing, F.lit(gone)).otherwise("judge not configured")).drop("source__", "there__")

    @F.pandas_udf("string")
    def ask(c: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else judge(x, y) for x, y in zip(c, s)], dtype=object)

    reply = F.upper(F.trim(F.coalesce(F.col("reply__"), F.lit(""))))
    verdict = reply.contains("SUPPORTED") if legacy_substring else F.regexp_replace(reply, r"[^A-Z]", "") == "SUPPORTED"
    rows = rows.withColumn("reply__", ask("claim", "source__"))
    return rows.withColumn("supported", F.when(missing, F.lit(False)).otherwise(verdict)).withColumn("reason", F.when(missing, F.lit(gone)).otherwise(F.col("reply__"))).drop("source__", "there__", "reply__")


def citation_report(verified: DataFrame, key: str) -> DataFrame:
    """(key, total, supported, unsupported, accuracy); a NULL verdict counts in the total only."""
    good, bad = F.count_if("supported"), F.count_if(~F.col("supported"))
    return verified.groupBy(key).agg(F.count("*").alias("total"), good.alias("supported"), bad.alias("unsupported"), F.round(good / F.count("*"), 4).alias("accuracy"))


def coverage(answer: str) -> Column:
    """Share of the answer's sentences that cite something; 0 without sentences."""
    s = sentences(answer)
    return F.when(F.size(s) > 0, F.size(F.filter(s, lambda x: F.regexp_like(x, F.lit(r"\[\d+\]")))) / F.size(s)).otherwise(0.0)


def completeness(question: str, answer: str) -> Column:
    """Share of the question's tokens that the answer holds; 0 for a blank answer, 0.1 for one that declines, 1 where the question has no tokens."""
    q, a = confidence_tokens(question), confidence_tokens(answer)
    low = F.lower(F.col(answer))
    gave_up = low.contains("i don't have enough information") | low.contains("i don't know")
    share = F.size(F.filter(q, lambda t: F.array_contains(a, t))) / F.size(q)
    return F.when(F.coalesce(F.trim(answer), F.lit("")) == "", 0.0).when(gave_up, 0.1).when(F.size(q) <= 0, 1.0).otherwise(share)


def completeness_judged(question: str, answer: str, judge: Callable[[str], str]) -> Column:
    """A judge's score for how completely the answer deals with the question: the ``score`` of the JSON object in its reply, between 0 and 1; 0 where there is none or the judge fails."""
    prompt = F.concat(F.lit("Does the answer deal with every part of the question? Reply with a JSON object with a score from 0.0 to 1.0 and a short reason.\n\nQuestion: "), F.coalesce(question, F.lit("")), F.lit("\n\nAnswer: "), F.coalesce(answer, F.lit("")))

    @F.pandas_udf("double")
    def run(p: pd.Series) -> pd.Series:
        out = []
        for x in p:
            try:
                m = re.search(r"\{.*\}", judge(x) or "", re.S)
                out.append(min(1.0, max(0.0, float(json.loads(m[0]).get("score", 0.0)))) if m else 0.0)
            except Exception:
                out.append(0.0)
        return pd.Series(out, dtype=float)

    return run(prompt)


def chunk_score() -> Column:
    """The score that counts for confidence: rerank, else fused, else dense; the sparse one never."""
    return F.coalesce("rerank_score", "rrf_score", "dense_score")


def retrieval_confidence(score: Column) -> Column:
    """Aggregate: the mean score between 0 and 1, 0 without any."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.avg(score), F.lit(0.0))))


def composite(retrieval: str | Column, citation: str | Column, complete: str | Column, weights: dict[str, float] | None = None) -> Column:
    w = {**WEIGHTS, **(weights or {})}
    total = sum(w.values())
    if total <= 0:
        raise ValueError("the weights must have a positive sum")
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return (col(retrieval) * w["retrieval"] + col(citation) * w["citation"] + col(complete) * w["completeness"]) / total


def can_answer(confidence: str, threshold: float = 0.5) -> Column:
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie between 0 and 1")
    return F.col(confidence) >= threshold


def snippet(content: str | Column, most: int = 120) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit("")), r"\s+", " "))
    return F.concat(F.substring(t, 1, most), F.when(F.length(t) > most, "...").otherwise(""))


def findings(ranked: DataFrame, key: str, content: str, source: str, most: int = 4) -> DataFrame:
    """(key, found): snippets of the best chunks, with their file."""
    item = F.concat(snippet(content), F.when(F.length(source) > 0, F.concat(F.lit(" (from "), F.col(source), F.lit(")"))).otherwise(""))
    few = ranked.where(F.col("rank") <= most).select(key, F.struct("rank", item.alias("item")).alias("x"))
    return few.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["item"]).alias("found"))


def gaps(question: str, answer: str, found: str) -> Column:
    """Tokens of the question that are no token of the answer and don't stand in what was found."""
    text = F.lower(F.array_join(F.coalesce(F.col(found), F.array().cast("array<string>")), " "))
    a = gap_tokens(F.coalesce(F.col(answer), F.lit("")))
    return F.filter(confidence_tokens(question), lambda t: ~F.array_contains(a, t) & ~text.contains(t))


def candidate_documents(ranked: DataFrame, key: str, doc: str, source: str, most: int = 3) -> DataFrame:
    """(key, doc_id, title, score, place): the documents of the chunks by their best score, ties as first seen."""
    name = F.coalesce(F.nullif(F.col(doc).cast("string"), F.lit("")), F.nullif(F.col(source), F.lit("")), F.lit("unknown"))
    d = ranked.select(key, "rank", name.alias("doc_id"), F.coalesce(F.nullif(F.col(source), F.lit("")), name).alias("title"), F.coalesce(chunk_score(), F.lit(0.0)).alias("s"))
    d = d.groupBy(key, "doc_id").agg(F.min_by("title", "rank").alias("title"), F.max("s").alias("score"), F.min("rank").alias("seen"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "seen")
    return d.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("seen")


def summary(found: str, gap: str) -> Column:
    """The text of a declined answer."""
    n = F.coalesce(F.size(found), F.lit(0))
    first = F.when(n > 0, F.concat(F.lit("Passages found that bear on the question: "), n.cast("string"), F.lit(". They do not suffice for a sure answer."))).otherwise("No passage was found that bears on the question.")
    named = F.when(F.size(gap) > 0, F.concat(F.lit(" Not confirmed: "), F.array_join(F.transform(gap, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("."))).otherwise("")
    return F.concat(first, named, F.lit(" See the listed documents."))
