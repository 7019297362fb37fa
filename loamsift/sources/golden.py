"""Golden questions: reading, filtering, counting, validating."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import CATEGORIES

SCHEMA = "id string, category string, question string, answer string, source_documents array<string>, source_sections array<string>, notes string"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file: an object with ``questions``, or a list of them."""
    inner = ", ".join(":".join(x.split(" ", 1)) for x in SCHEMA.split(", "))
    df = spark.read.schema(f"questions array<struct<{inner}>>").option("multiLine", True).json(path)
    whole = df.where(F.col("questions").isNotNull()).select(F.explode("questions").alias("q")).select("q.*")
    flat = spark.read.schema(SCHEMA).option("multiLine", True).json(path).where(F.col("id").isNotNull() | F.col("question").isNotNull())
    return whole.unionByName(flat)


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Questions from dicts of either naming: type, golden_answer, source_docs, section as well as category, answer, source_documents, source_sections."""
    out = []
    for r in rows:
        section = r.get("source_sections", r.get("section"))
        out.append((r.get("id"), r.get("category", r.get("type")), r.get("question"), r.get("answer", r.get("golden_answer")), list(r.get("source_documents", r.get("source_docs")) or []), [section] if isinstance(section, str) and section else list(section or []), r.get("notes")))
    return spark.createDataFrame(out, SCHEMA)


def counts(df: DataFrame) -> DataFrame:
    """(category, n): the four categories, with 0 where there are none, and the total."""
    spark = df.sparkSession
    each = spark.createDataFrame([(c,) for c in CATEGORIES], "category string").join(df.groupBy("category").agg(F.count("*").alias("n")), "category", "left")
    return each.select("category", F.coalesce("n", F.lit(0)).alias("n")).unionByName(df.agg(F.lit("total").alias("category"), F.count("*").alias("n")))


def select(df: DataFrame, category: str | None = None) -> DataFrame:
    """The questions of a category; all of them without one."""
    return df if category is None else df.where(F.col("category") == category)


def flags(df: DataFrame) -> DataFrame:
    """The questions with a flag for each category."""
    return df.withColumns({f"is_{c}": F.coalesce(F.col("category") == c, F.lit(False)) for c in CATEGORIES})


def summary(df: DataFrame, name: str = "", version: str = "") -> str:
    """The set in words: its counts and the documents it covers."""
    n = {r[0]: r[1] for r in counts(df).collect()}
    covered = sorted(r[0] for r in df.select(F.explode("source_documents").alias("d")).distinct().collect())
    return "\n".join([f"{name} {version}".strip() or "Golden questions", f"questions: {n['total']}", *(f"{c}: {n[c]}" for c in CATEGORIES), f"documents: {', '.join(covered)}"])


def validate(df: DataFrame, least: int = 50) -> DataFrame:
    """(id, issue): what is wrong with the set; id is NULL for what concerns the whole."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    sourced = F.col("category").isin("lookup", "multi_hop")
    rules: list[tuple[str, Column]] = [
        ("empty id", blank("id")),
        ("bad category", ~F.coalesce(F.col("category").isin(CATEGORIES), F.lit(False))),
        ("empty question", blank("question")),
        ("empty answer", blank("answer")),
        ("missing source documents", sourced & none("source_documents")),
        ("missing source sections", sourced & none("source_sections")),
        ("unexpected source documents", (F.col("category") == "no_answer") & ~none("source_documents")),
    ]
    issues = F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules)), lambda x: x.isNotNull())
    rows = df.select("id", F.explode(issues).alias("issue"))
    twice = df.where(~blank("id")).groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate id").alias("issue"))
    few = df.agg(F.count("*").alias("n")).where(F.col("n") < least).select(F.lit(None).cast("string").alias("id"), F.lit("too few questions").alias("issue"))
    lacking = counts(df).where((F.col("n") == 0) & (F.col("category") != "total")).select(F.lit(None).cast("string").alias("id"), F.concat(F.lit("no questions of category "), "category").alias("issue"))
    return reduce(DataFrame.unionByName, [rows, twice, few, lacking])
