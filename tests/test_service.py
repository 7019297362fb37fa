import pytest

from loamsift.functions.vectors import Embedder, hash_embedding
from loamsift.operators.chunking import ChunkingConfig
from loamsift.operators.index import ChunkStore
from loamsift.plans import api
from loamsift.sources import golden
from loamsift.streaming.ingest import ingest_batch, ingest_stream

E = Embedder("mock", lambda texts: [hash_embedding(t, 32) for t in texts], 32)
SCHEMA = "doc_id string, source_file string, clean_text string, raw_content string, sections array<struct<content:string>>"
TEXT = "# Auth\n\nThe gateway asks for a bearer token from the console.\n\n# Limits\n\nEach account may send a hundred requests a minute."
C = ChunkingConfig(120, 20, "recursive", min_chunk_chars=10)


def docs(spark, *rows):
    return spark.createDataFrame([(i, f, t, None, []) for i, f, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def indexed(spark):
    d = docs(spark, ("a", "guide.md", TEXT), ("b", "faq.md", "Backups run nightly at two in the morning."))
    return api.written(api.index_documents(d, C, E))


def test_retrieval_modes(spark, indexed):
    q = api.queries_of(spark, ["bearer token of the gateway"], E)
    for mode in ("hybrid", "dense", "sparse", "other"):
        rows = api.retrieve(indexed, q, mode, 2).orderBy("rank").collect()
        assert len(rows) == 2 and rows[0].source_file == "guide.md" and rows[0].rerank_score >= rows[1].rerank_score
    assert api.source_rows(api.retrieve(indexed, q, "sparse", 1)).count() == 1
    both = api.found_in_both(api.retrieve(indexed, q, "dense", 3), api.retrieve(indexed, q, "sparse", 3)).collect()
    assert all(r.in_both for r in both)
    with pytest.raises(ValueError):
        api.queries_of(spark, [" "], E)


def test_asking_answers_or_declines(spark, indexed):
    q = api.queries_of(spark, ["bearer token of the gateway", "color of zebras"], E)
    rows = {r.query_id: r for r in api.ask(indexed, q, top_k=2, threshold=0.55).collect()}
    assert rows[0].can_answer and rows[0].answer.endswith("[1]") and rows[0].summary is None
    assert not rows[1].can_answer and rows[1].answer is None and "zebras" in rows[1].gaps and rows[1].summary and rows[1].candidates


def test_ingestion_is_idempotent_and_drops_copies(spark, tmp_path):
    from pyspark.sql import types as T

    first = api.index_documents(docs(spark, ("a", "guide.md", TEXT)), C, E)
    s = ChunkStore(spark, str(tmp_path), T.StructType(first.schema.fields))
    n = ingest_batch(docs(spark, ("a", "guide.md", TEXT)), s, C, E)
    assert n == first.count() > 1
    assert ingest_batch(docs(spark, ("a", "guide.md", TEXT)), s, C, E) == 0
    assert ingest_batch(docs(spark, ("z", "copy.md", TEXT), ("n", "new.md", "Something quite different stands in this file.")), s, C, E) == 1
    rows, dups = api.ingest(api.index_documents(docs(spark, ("z", "copy.md", TEXT)), C, E).select(*s.schema.names), s.read(), 32)
    assert rows.count() == 0 and dups.count() == n
    rows, _ = api.ingest(api.index_documents(docs(spark, ("z", "copy.md", TEXT)), C, E).select(*s.schema.names), s.read(), 32, deduplicate=False)
    assert rows.count() == n


def test_streaming_ingestion(spark, tmp_path):
    from pyspark.sql import types as T

    docs(spark, ("a", "guide.md", TEXT)).write.parquet(str(tmp_path / "in"))
    first = api.index_documents(docs(spark, ("a", "guide.md", TEXT)), C, E)
    s = ChunkStore(spark, str(tmp_path), T.StructType(first.schema.fields))
    for _ in range(2):
        ingest_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), s, C, E, str(tmp_path / "ck")).awaitTermination(120)
    assert s.read().count() == first.count()


def test_strategies_are_compared_on_their_own_indexes(spark):
    d = docs(spark, ("a", "guide.md", TEXT))
    g = golden.from_rows(spark, [{"id": "g1", "category": "lookup", "question": "what does the gateway ask for", "answer": "a bearer token", "source_documents": ["guide.md"], "source_sections": ["Auth"]}, {"id": "g2", "category": "no_answer", "question": "zebra", "answer": "unknown"}])
    out = api.compare(d, g, E, [ChunkingConfig(120, 20, min_chunk_chars=10), C], 2)
    assert out["results"].count() == 4 and {r.strategy for r in out["ranking"].collect()} == {"fixed", "recursive"}
    assert out["comparison"].first().winner and out["json"].count() == 1
    judged = api.evaluate(api.index_documents(d, C, E), g, E, "recursive", 2, lambda m: "A bearer token is required [1].", lambda p: "0.5", lambda c, s: "SUPPORTED", "lookup").collect()
    assert [(r.question_id, r.correctness, r.citation_accuracy) for r in judged] == [("g1", 0.5, 1.0)] and judged[0].latency_ms >= 0
    assert api.resolve_eval_mode({}) == "mock" and api.resolve_eval_mode({"OPENAI_API_KEY": "k"}) == "real"
    with pytest.raises(RuntimeError):
        api.resolve_eval_mode({}, force_real=True)
