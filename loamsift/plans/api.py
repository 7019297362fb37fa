"""The service surface as functions over DataFrames: ingest, retrieve, ask, evaluate, compare strategies."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.vectors import Embedder
from ..operators import answers as A
from ..operators import bm25, dedup, dense, fusion, index, metrics, rerank
from ..operators.chunking import ChunkingConfig, chunk
from ..sources.golden import select as select_questions

MODES = ("hybrid", "dense", "sparse")


def mode_of(mode: str | None) -> str:
    """An unknown mode means hybrid."""
    return mode if mode in MODES else "hybrid"


def index_documents(docs: DataFrame, config: ChunkingConfig, embedder: Embedder) -> DataFrame:
    """Chunks with their embeddings."""
    docs = docs.withColumn("text__", F.coalesce(F.nullif(F.col("clean_text"), F.lit("")), F.nullif(F.col("raw_content"), F.lit("")), F.array_join(F.transform("sections", lambda s: s["content"]), "\n")))
    return chunk(docs, "doc_id", "text__", config, embedder.embed, ("source_file",)).withColumn("embedding", embedder.column("content"))


def ingest(new: DataFrame, store: DataFrame, dims: int, threshold: float = 0.95, deduplicate: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows to add, duplicates) of new chunks in the order of doc_id and chunk number.

    A chunk whose id is stored is skipped and counts as no duplicate. Of the others one is a duplicate if a stored chunk, or one added before it, is more similar than the threshold.
    """
    fresh = written(index.insert_if_absent(new, store, "chunk_id"))
    if not deduplicate:
        return fresh, fresh.limit(0).select("chunk_id", F.lit(None).cast("string").alias("duplicate_of"), F.lit(None).cast("double").alias("duplicate_similarity"))
    old = written(dedup.filter_duplicates(fresh, store, "chunk_id", "embedding", dims, threshold))
    rest = fresh.join(old, "chunk_id", "left_anti").withColumn("ord__", F.struct("doc_id", F.element_at(F.split("chunk_id", "::"), -1).cast("int")))
    own = dedup.greedy_duplicates(rest, "chunk_id", "ord__", "embedding", dims, threshold).where(~F.col("kept")).select("chunk_id", "duplicate_of", "duplicate_similarity")
    dups = written(old.unionByName(own))
    return fresh.join(dups, "chunk_id", "left_anti"), dups


def retrieve(chunks: DataFrame, queries: DataFrame, mode: str = "hybrid", top_k: int = 10, candidate_k: int = 20, reranker: Callable | None = rerank.lexical, where: dict | None = None) -> DataFrame:
    """(query_id, chunk_id, rank and scores, content, source_file, section_heading, doc_id) of queries (query_id, question, vector)."""
    mode = mode_of(mode)
    depth = max(top_k, candidate_k)
    none = F.lit(None).cast("double")
    if mode != "sparse":
        d = dense.topk(chunks, "chunk_id", "embedding", queries, "query_id", "vector", depth, where)
    if mode != "dense":
        s = bm25.topk(chunks, "chunk_id", "content", queries, "query_id", "question", depth)
    if mode == "hybrid":
        found = fusion.rrf(d.where(F.col("rank") <= candidate_k), s.where(F.col("rank") <= candidate_k), "query_id", "chunk_id").where(F.col("rank") <= candidate_k)
    elif mode == "dense":
        found = d.select("query_id", "chunk_id", F.col("score").alias("dense_score"), none.alias("sparse_score"), none.alias("rrf_score"), "rank")
    else:
        found = s.select("query_id", "chunk_id", none.alias("dense_score"), F.col("score").alias("sparse_score"), none.alias("rrf_score"), "rank")
    meta = chunks.select("chunk_id", "doc_id", "content", "source_file", "section_heading")
    found = found.join(meta, "chunk_id").join(queries.select("query_id", "question"), "query_id")
    if reranker is None:
        found = found.withColumn("rerank_score", none)
    else:
        found = reranker(found, "query_id", "question", "content")
    return found.where(F.col("rank") <= top_k)


def ask(chunks: DataFrame, queries: DataFrame, mode: str = "hybrid", top_k: int = 10, threshold: float = 0.5, respond: Callable | None = None, judge: Callable | None = None, **options) -> DataFrame:
    """A row per query: answer or what is known instead, with the confidence it was decided by. Without ``respond`` the answer is extractive.

    (query_id, question, mode, can_answer, answer, confidence, retrieval, citation, completeness, found, gaps, candidates, summary, error)
    """
    ranked = written(retrieve(chunks, queries, mode, top_k, **options))
    if respond is None:
        a = A.extractive(ranked, queries, "query_id", "content").withColumn("error", F.lit(None).cast("string"))
    else:
        m = A.messages(ranked, queries, "query_id", "question", "content", "source_file", "section_heading")
        a = written(A.generate(m, "messages", respond).select("query_id", "answer", "error"))
    cited = A.verify(A.citations(a, "query_id", "answer"), ranked, "query_id", "content", judge)
    rep = A.citation_report(cited, "query_id").select("query_id", F.col("total"), F.col("accuracy"))
    conf = ranked.groupBy("query_id").agg(A.retrieval_confidence(A.chunk_score()).alias("retrieval"))
    few = ranked.where(F.col("rank") <= 20)
    cand = A.candidate_documents(ranked, "query_id", "doc_id", "source_file").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "doc_id", "title", "score"))), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["title"].alias("title"), x["score"].alias("score"))).alias("candidates"))
    row = queries.select("query_id", "question").join(a, "query_id", "left").join(rep, "query_id", "left").join(conf, "query_id", "left").join(A.findings(few, "query_id", "content", "source_file"), "query_id", "left").join(cand, "query_id", "left")
    row = row.withColumn("retrieval", F.coalesce("retrieval", F.lit(0.0))).withColumn("citation", F.when(F.col("total") > 0, F.col("accuracy")).otherwise(A.coverage("answer"))).withColumn("completeness", A.completeness("question", "answer"))
    row = row.withColumn("confidence", F.round(A.composite("retrieval", "citation", "completeness"), 4)).withColumn("can_answer", A.can_answer("confidence", threshold)).withColumn("gaps", A.gaps("question", "answer", "found"))
    return row.select("query_id", "question", F.lit(mode).alias("mode"), "can_answer", F.when(F.col("can_answer"), F.col("answer")).alias("answer"), "confidence", "retrieval", "citation", "completeness", "found", "gaps", "candidates", F.when(~F.col("can_answer"), A.summary("found", "gaps")).alias("summary"), "error")


def evaluate(chunks: DataFrame, golden: DataFrame, embedder: Embedder, strategy: str, top_k: int = 5, respond: Callable | None = None, judge: Callable[[str], str] | None = None, citation_judge: Callable[[str, str], str] | None = None, category: str | None = None) -> DataFrame:
    """A row per golden question, of one category if asked for, with its answer, the four metrics, and how long the answer took.

    With a ``judge`` it gives the first three metrics; without one they are lexical. Citations are verified where there is a ``citation_judge``. A question that failed has its error and no scores.
    """
    q = select_questions(golden, category).select(F.col("id").alias("query_id"), "question", "category", F.col("answer").alias("golden_answer"), "source_sections").dropDuplicates(["query_id"]).withColumn("vector", embedder.column("question"))
    q = written(q)
    ranked = written(retrieve(chunks, q, "hybrid", top_k))
    if respond is None:
        a = A.extractive(ranked, q, "query_id", "content").withColumn("error", F.lit(None).cast("string")).withColumn("latency_ms", F.lit(0.0))
    else:
        a = A.generate(A.messages(ranked, q, "query_id", "question", "content", "source_file", "section_heading"), "messages", respond).select("query_id", "answer", "error", "latency_ms")
    a = written(a)
    in_order = lambda c, most=10**9: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", F.coalesce(F.col(c), F.lit("")).alias("x"))))), lambda y: y["x"]), " ")
    ctx = ranked.groupBy("query_id").agg(in_order("content").alias("context"), in_order("content", 5).alias("first_five"), F.concat_ws(" ", in_order("source_file"), in_order("section_heading")).alias("meta"))
    r = q.join(a, "query_id").join(ctx, "query_id", "left")
    total = accuracy = None
    if citation_judge is not None:
        cited = A.verify(A.citations(a, "query_id", "answer"), ranked, "query_id", "content", citation_judge)
        r = r.join(A.citation_report(cited, "query_id").select("query_id", "total", "accuracy"), "query_id", "left")
        total, accuracy = F.col("total"), F.col("accuracy")
    scored = {"correctness": metrics.correctness("category", "golden_answer", "answer"), "faithfulness": metrics.faithfulness("answer", "context"), "retrieval_relevance": metrics.retrieval_relevance("golden_answer", "source_sections", "context", "meta")}
    if judge is not None:
        scored = metrics.judge_scores("question", "golden_answer", "answer", "first_five", judge)
    scored["citation_accuracy"] = metrics.citation_accuracy("category", "answer", total, accuracy)
    failed = F.col("error").isNotNull()
    return r.select(F.lit(strategy).alias("strategy"), F.col("query_id").alias("question_id"), "category", "question", "golden_answer", F.col("answer").alias("generated_answer"), *(F.when(~failed, c).alias(n) for n, c in scored.items()), "latency_ms", "error")


def compare(docs: DataFrame, golden: DataFrame, embedder: Embedder, configs: list[ChunkingConfig], top_k: int = 5) -> dict[str, DataFrame]:
    """Evaluates each chunking strategy on an index of its own: results, report, winners, ranking, category winners."""
    results = reduce(DataFrame.unionByName, (evaluate(written(index_documents(docs, c, embedder)), golden, embedder, c.strategy, top_k) for c in configs))
    results = written(results)
    rep = metrics.report(results)
    means = metrics.strategy_means(results)
    return {"results": results, "report": rep, "winners": metrics.winners(means), "ranking": metrics.overall(means), "category_winners": metrics.category_winners(rep), "comparison": metrics.comparison(means), "json": metrics.comparison_json(rep)}


def found_in_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of the first result with a flag whether the second holds the chunk for the query, too."""
    other = b.select("query_id", "chunk_id", F.lit(True).alias("in_both")).distinct()
    return a.join(other, ["query_id", "chunk_id"], "left").withColumn("in_both", F.coalesce("in_both", F.lit(False)))


def resolve_eval_mode(env: dict[str, str], force_real: bool = False, force_mock: bool = False) -> str:
    """real or mock; real needs a key."""
    key = bool(env.get("OPENROUTER_API_KEY") or env.get("OPENAI_API_KEY"))
    if force_real and not key:
        raise RuntimeError("a real evaluation needs an API key")
    return "mock" if force_mock or not key else "real"


def source_rows(ranked: DataFrame) -> DataFrame:
    """What a caller sees of a source: content cut to 500 characters, scores to four digits."""
    r = lambda c: F.round(c, 4).alias(c)
    return ranked.select("query_id", "rank", "chunk_id", "doc_id", "source_file", "section_heading", F.substring("content", 1, 500).alias("content"), r("dense_score"), r("sparse_score"), r("rrf_score"), r("rerank_score"))


def queries_of(spark: SparkSession, questions: list[str], embedder: Embedder) -> DataFrame:
    """(query_id, question, vector) of a few questions; a blank one is refused."""
    if any(not q or not q.strip() for q in questions):
        raise ValueError("a question must not be blank")
    return spark.createDataFrame(list(enumerate(questions)), "query_id long, question string").withColumn("vector", embedder.column("question"))
