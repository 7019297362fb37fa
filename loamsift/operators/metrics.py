"""Deterministic answer metrics, their summaries, and the comparison of strategies."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import declines, eval_tokens, sentences

METRICS = ["correctness", "faithfulness", "retrieval_relevance", "citation_accuracy"]
CATEGORIES = ["lookup", "multi_hop", "no_answer", "ambiguous"]
GROUNDED = 0.4


def correctness(category: str, golden: str, answer: str) -> Column:
    """Jaccard of the two token sets; a no_answer question wants a decline and gives at most a half without."""
    g, a = eval_tokens(F.coalesce(F.col(golden), F.lit(""))), eval_tokens(F.coalesce(F.col(answer), F.lit("")))
    j = F.size(F.array_intersect(g, a)) / F.size(F.array_union(g, a))
    other = F.when(declines(answer), 1.0).otherwise(F.least(j + 0.2, F.lit(0.5)))
    return F.when(F.size(g) == 0, 1.0).when(F.size(a) == 0, 0.0).when(F.col(category) == "no_answer", other).otherwise(j)


def faithfulness(answer: str, context: str) -> Column:
    """Share of the answer's sentences of whose tokens at least 0.4 stand, as substrings, in the context; 1 without sentences."""
    c = F.lower(F.coalesce(F.col(context), F.lit("")))

    def grounded(s: Column) -> Column:
        t = eval_tokens(s)
        return (F.size(t) == 0) | (F.size(F.filter(t, lambda x: c.contains(x))) / F.size(t) >= GROUNDED)

    s = sentences(F.coalesce(F.col(answer), F.lit("")))
    return F.when(F.size(s) == 0, 1.0).otherwise(F.size(F.filter(s, grounded)) / F.size(s))


def retrieval_relevance(golden: str, sections: str, context: str, meta: str | None = None) -> Column:
    """Half the share of the listed sections named in the context or its metadata, half that of the golden tokens in the context; 0 without context."""
    c = F.lower(F.coalesce(F.col(context), F.lit("")))
    everything = F.concat(c, F.lit(" "), F.lower(F.coalesce(F.col(meta), F.lit("")))) if meta else c
    named = F.when(F.coalesce(F.size(sections), F.lit(0)) <= 0, 1.0).otherwise(F.size(F.filter(sections, lambda s: everything.contains(F.lower(s)))) / F.size(sections))
    g = eval_tokens(F.coalesce(F.col(golden), F.lit("")))
    found = F.when(F.size(g) == 0, 1.0).otherwise(F.size(F.filter(g, lambda t: c.contains(t))) / F.size(g))
    return F.when(F.coalesce(F.col(context), F.lit("")) == "", 0.0).otherwise(0.5 * named + 0.5 * found)


def citation_accuracy(category: str, answer: str, total: Column | None = None, accuracy: Column | None = None) -> Column:
    """For no_answer questions 1 without citations, else 0; for others the report's accuracy, 0.5 where nothing is verified; ambiguous ones may do without."""
    n = F.regexp_count(F.coalesce(F.col(answer), F.lit("")), F.lit(r"\[\d+\]"))
    none = F.when(F.col(category) == "ambiguous", 1.0).otherwise(0.5)
    with_report = F.lit(0.5) if total is None else F.when(F.coalesce(total, F.lit(0)) > 0, accuracy).otherwise(0.5)
    return F.when(F.col(category) == "no_answer", F.when(n == 0, 1.0).otherwise(0.0)).when(n == 0, none).otherwise(with_report)


def parse_judge(raw: str | None, claims: int | None = None, default: float = 0.0) -> float:
    """A judge's reply as a score: a JSON list ``grounded`` (padded to the claims), else a JSON ``score``, else the first number, else the default; between 0 and 1."""
    text = raw or ""
    m = re.search(r"\{.*\}", text, re.S)
    if m:
        try:
            d = json.loads(m[0])
            if isinstance(d.get("grounded"), list):
                g = [bool(x) for x in d["grounded"]]
                n = claims or len(g)
                return sum(g[:n]) / n if n else 1.0
            if "score" in d:
                return min(1.0, max(0.0, float(d["score"])))
        except (ValueError, TypeError):
            pass
    m = re.search(r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)", text)
    return min(1.0, max(0.0, float(m[0]))) if m else default


def judged(prompt: Column, judge: Callable[[str], str], default: float, claims: Column | None = None) -> Column:
    """The judge's score for a prompt; ``claims`` is the number of claims that its reply may list. A judge that fails gives the default."""

    @F.pandas_udf("double")
    def run(p: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for x, k in zip(p, n):
            try:
                reply = judge(x)
            except Exception:
                reply = None
            out.append(parse_judge(reply, None if pd.isna(k) else int(k), default))
        return pd.Series(out, dtype=float)

    return run(prompt, claims if claims is not None else F.lit(None).cast("int"))


_ONLY = "Reply with a number between 0.0 and 1.0 and nothing else."


def _prompt(task: str, **parts: Column | str) -> Column:
    """A prompt of a task, named parts and the form of the reply."""
    text = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.concat(F.lit(task), *(x for name, c in parts.items() for x in (F.lit(f"\n\n{name}:\n"), text(c))), F.lit(f"\n\n{_ONLY}"))


def judge_scores(question: str, golden: str, answer: str, context: str, judge: Callable[[str], str]) -> dict[str, Column]:
    """The three metrics that a judge can give; ``context`` holds the first five chunks. Replies that can't be read count a half, for faithfulness nothing; an answer
    without a sentence is faithful, and no context is not relevant."""
    claims = F.size(sentences(F.coalesce(F.col(answer), F.lit(""))))
    right = _prompt("Grade how well an answer agrees with the expected answer: 1.0 if it is right and complete, 0.0 if it is wrong.", Question=question, Expected=golden, Answer=answer)
    faithful = _prompt("Grade how far the context supports the statements of an answer: 1.0 if it supports all of them, 0.0 if none.", Context=context, Answer=answer)
    relevant = _prompt("Grade how far passages bear on a question: 1.0 if all of them do, 0.0 if none.", Question=question, Passages=context)
    return {
        "correctness": judged(right, judge, 0.5),
        "faithfulness": F.when(claims == 0, 1.0).otherwise(judged(faithful, judge, 0.0, claims)),
        "retrieval_relevance": F.when(F.coalesce(F.col(context), F.lit("")) == "", 0.0).otherwise(judged(relevant, judge, 0.5)),
    }


def long_scores(results: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, score): a row per result and metric."""
    return results.select(*keys, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in METRICS))).alias("m")).select(*keys, "m.metric", "m.score")


def report(results: DataFrame, digits: int = 4) -> DataFrame:
    """(strategy, category, metric, mean, median, min, max, n), to four digits, category NULL over all: NULL scores don't count; a metric without scores has zeros and n = 0."""
    long = long_scores(results, ["strategy", "category"]).withColumn("category", F.coalesce("category", F.lit("unknown")))
    # A mean of many scores is known to some ten digits only. What lies half-way as far as these tell is rounded up, whatever the order of summation and the
    # binary form of the number.
    stats = lambda c: F.round(F.round(F.coalesce(c, F.lit(0.0)), 10) + 1e-11, digits)
    g = long.groupingSets([["strategy", "metric"], ["strategy", "category", "metric"]], "strategy", "category", "metric")
    return g.agg(stats(F.avg("score")).alias("mean"), stats(F.median("score")).alias("median"), stats(F.min("score")).alias("min"), stats(F.max("score")).alias("max"), F.count("score").alias("n"))


def strategy_means(results: DataFrame) -> DataFrame:
    """(strategy, metric, mean): means to four digits, as the comparison uses them."""
    return report(results).where(F.col("category").isNull()).select("strategy", "metric", "mean")


def winners(means: DataFrame, margin: float = 0.01) -> DataFrame:
    """(metric, best, winner): all strategies within the margin of the best mean, best first, joined by +."""
    best = means.withColumn("best", F.max("mean").over(Window.partitionBy("metric"))).where(F.abs(F.col("mean") - F.col("best")) <= margin + 1e-9)
    names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("mean"), "strategy"))), lambda x: x["strategy"]), "+")
    return best.groupBy("metric").agg(F.max("best").alias("best"), names.alias("winner"))


def overall(means: DataFrame) -> DataFrame:
    """(strategy, average, place): the mean of the four metric means, a missing one as 0."""
    s = means.groupBy("strategy").agg((F.sum(F.coalesce("mean", F.lit(0.0))) / len(METRICS)).alias("raw"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.desc("raw"), "strategy"))).select("strategy", F.round("raw", 6).alias("average"), "place")


def category_winners(rep: DataFrame) -> DataFrame:
    """(category, metric, winner, mean): the best strategy of each category, ties to the first name."""
    w = Window.partitionBy("category", "metric").orderBy(F.desc("mean"), "strategy")
    return rep.where(F.col("category").isNotNull()).withColumn("r", F.row_number().over(w)).where("r = 1").select("category", "metric", F.col("strategy").alias("winner"), "mean")


def gains(means: DataFrame) -> DataFrame:
    """(metric, winner, runner_up, gain_percent): by how much the best is ahead of the second, NULL where that is 0."""
    w = Window.partitionBy("metric").orderBy(F.desc("mean"), "strategy")
    r = means.withColumn("r", F.row_number().over(w))
    one, two = r.where("r = 1").select("metric", F.col("strategy").alias("winner"), F.col("mean").alias("m1")), r.where("r = 2").select("metric", F.col("strategy").alias("runner_up"), F.col("mean").alias("m2"))
    return one.join(two, "metric", "left").select("metric", "winner", "runner_up", F.round((F.col("m1") - F.col("m2")) / F.nullif(F.col("m2"), F.lit(0.0)) * 100, 1).alias("gain_percent"))


def errors(results: DataFrame) -> DataFrame:
    """(strategy, questions, errors)."""
    return results.groupBy("strategy").agg(F.count("*").alias("questions"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def report_json(rep: DataFrame) -> DataFrame:
    """One JSON document per strategy with its rows of the report."""
    row = F.struct("category", "metric", "mean", "median", "min", "max", "n")
    return rep.groupBy("strategy").agg(F.to_json(F.struct("strategy", F.sort_array(F.collect_list(row)).alias("scores"))).alias("json"))


def comparison(means: DataFrame) -> DataFrame:
    """(winner, winner_average, runner_up, runner_up_average, summary): the best strategy over all metrics, the second, and in words by how much it leads in correctness and faithfulness.

    A lead is relative; over 0 it is the winner's own score. A single strategy is its own runner-up.
    """
    place = overall(means)
    one = place.where("place = 1").select(F.col("strategy").alias("winner"), F.col("average").alias("winner_average"))
    two = place.where("place = 2").select(F.col("strategy").alias("runner_up"), F.col("average").alias("runner_up_average"))
    top = one.join(two, F.lit(True), "left").withColumn("runner_up_average", F.coalesce("runner_up_average", "winner_average")).withColumn("runner_up", F.coalesce("runner_up", "winner"))
    score = means.where(F.col("metric").isin("correctness", "faithfulness"))
    of = lambda who: score.select(F.col("strategy").alias(who), "metric", F.col("mean").alias(f"{who}_mean"))
    each = top.join(of("winner"), "winner").join(of("runner_up"), ["runner_up", "metric"]).where("winner_mean > runner_up_mean")
    lead = F.when(F.col("runner_up_mean") > 0, (F.col("winner_mean") - F.col("runner_up_mean")) / F.col("runner_up_mean")).otherwise(F.col("winner_mean")) * 100
    # format_number puts commas into large numbers; leads are small.
    gains = each.groupBy("winner").agg(F.array_join(F.sort_array(F.collect_list(F.concat("metric", F.lit(" by "), F.format_number(lead, 1), F.lit(" %")))), " and ").alias("gains"))
    two_digits = lambda c: F.format_number(c, 2)
    text = F.concat("winner", F.when(F.col("gains").isNotNull(), F.concat(F.lit(" leads "), "runner_up", F.lit(" in "), "gains")).otherwise(F.concat(F.lit(" leads "), "runner_up", F.lit(" on average"))), F.lit(": "), two_digits("winner_average"), F.lit(" to "), two_digits("runner_up_average"))
    return top.join(gains, "winner", "left").select("winner", "winner_average", "runner_up", "runner_up_average", text.alias("summary"))


def comparison_json(rep: DataFrame) -> DataFrame:
    """One JSON document with every strategy's rows of the report, the winner and the text."""
    row = F.struct("strategy", F.coalesce("category", F.lit("all")).alias("category"), "metric", "mean", "median", "min", "max", "n")
    rows = rep.agg(F.sort_array(F.collect_list(row)).alias("scores"))
    top = comparison(rep.where(F.col("category").isNull()).select("strategy", "metric", "mean"))
    return top.join(rows, F.lit(True)).select(F.to_json(F.struct("winner", "summary", "scores")).alias("json"))
