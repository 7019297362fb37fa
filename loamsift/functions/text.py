"""Token and sentence expressions. Each tokenizer has its own rules and stop words; they are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the reranker.
RERANK_STOPWORDS = "the a an and or of to in on for is are with how what whats do does i you it this that at by be can not".split()
# Stop words of the completeness score.
CONFIDENCE_STOPWORDS = "the a an and of to in on for is are what how do does i you it this".split()
# Stop words of the evaluation metrics.
EVAL_STOPWORDS = "the a an and of to in on for is are was were been be have has had it its that this with you i do does did".split()
# What an answer holds that declines.
DECLINES = [
    "i don't have enough information",
    "i don't have sufficient",
    "i do not have enough",
    "not enough information",
    "insufficient information",
    "cannot answer",
    "can't answer",
    "no information",
    "don't have information",
]


def _words(text: Column) -> Column:
    spaced = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " ")
    return F.filter(F.split(spaced, r"\s+"), lambda t: t != "")


def tokens(text: Column | str) -> Column:
    """Words of the sparse index: lower case, everything but a-z, 0-9 and blanks separates; no stop words."""
    return _words(F.col(text) if isinstance(text, str) else text)


def tokens_without(text: Column | str, stopwords: list[str]) -> Column:
    stop = F.array(*map(F.lit, stopwords))
    return F.filter(tokens(text), lambda t: ~F.array_contains(stop, t))


def rerank_tokens(text: Column | str) -> Column:
    return tokens_without(text, RERANK_STOPWORDS)


def confidence_tokens(text: Column | str) -> Column:
    return tokens_without(text, CONFIDENCE_STOPWORDS)


def eval_tokens(text: Column | str) -> Column:
    """A set of words."""
    return F.array_distinct(tokens_without(text, EVAL_STOPWORDS))


def gap_tokens(text: Column | str) -> Column:
    """The set of maximal runs of a-z and 0-9."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    return F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9]+"), 0))


def sentences(text: Column | str) -> Column:
    """Sentences of an answer: split after an end mark before a capital, digit, quote or bracket, then at line ends; trimmed, none empty."""
    c = F.col(text) if isinstance(text, str) else text
    parts = F.split(c, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])")
    lines = F.flatten(F.transform(parts, lambda s: F.split(s, "\n")))
    return F.filter(F.transform(lines, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def declines(text: Column | str) -> Column:
    """Whether an answer says that it doesn't know."""
    c = F.lower(F.col(text) if isinstance(text, str) else text)
    out = F.lit(False)
    for p in DECLINES:
        out = out | c.contains(p)
    return F.coalesce(out, F.lit(False))

