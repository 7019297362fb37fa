import pytest
from pyspark.sql import functions as F

from loamsift.operators import answers as A


def test_citations(spark):
    df = spark.createDataFrame([(1, "Keys are rotated every week [1]. Old keys stay valid for a day [2]."), (2, "Storage is counted by the month [1], and idle volumes cost half [2], [3]."), (3, None)], "id int, a string")
    got = [(r.id, r.number, r.claim[:3]) for r in A.citations(df, "id", "a").orderBy("id", "sentence_pos", "cite_pos").collect()]
    assert got == [(1, 1, "Key"), (1, 2, "Old"), (2, 1, "Sto"), (2, 2, "Sto"), (2, 3, "Sto")]


def test_verdicts(spark):
    df = spark.createDataFrame([(1, "Volumes are encrypted [1]. Logs are not [9].")], "id int, a string")
    src = spark.createDataFrame([(1, 1, "source")], "id int, rank int, content string")
    cited = A.citations(df, "id", "a")
    rows = {r.number: r for r in A.verify(cited, src, "id", "content").collect()}
    assert rows[9].supported is False and "not provided" in rows[9].reason and rows[1].supported is None
    for reply, strict, loose in (("SUPPORTED", True, True), ("UNSUPPORTED", False, True), ("", False, False), ("supported.", True, True)):
        one = A.verify(cited, src, "id", "content", lambda c, s, reply=reply: reply).where("number = 1").first()
        old = A.verify(cited, src, "id", "content", lambda c, s, reply=reply: reply, legacy_substring=True).where("number = 1").first()
        assert (one.supported, old.supported) == (strict, loose)
    v = spark.createDataFrame([(1, True), (1, True), (1, False), (2, None)], "id int, supported boolean")
    rep = {r.id: r for r in A.citation_report(v, "id").collect()}
    assert rep[1].accuracy == 0.6667 and (rep[2].total, rep[2].supported, rep[2].unsupported) == (1, 0, 0)


def test_confidence(spark):
    df = spark.createDataFrame([("what is the refund policy", "One fact [1]. Two facts [2]. Plain sentence."), ("refund policy", "I don't have enough information"), ("refund", ""), ("how is the", "x")], "q string, a string")
    rows = df.select(F.round(A.coverage("a"), 4).alias("c"), A.completeness("q", "a").alias("k")).collect()
    assert rows[0].c == 0.6667 and [r.k for r in rows] == [0.0, 0.1, 0.0, 1.0]
    s = spark.createDataFrame([(1, 0.9), (1, 0.5), (1, 0.1), (2, None)], "id int, s double")
    assert {r.id: round(r.c, 6) for r in s.groupBy("id").agg(A.retrieval_confidence(F.col("s")).alias("c")).collect()} == {1: 0.5, 2: 0.0}
    one = spark.createDataFrame([(1.0, 0.5, 0.0)], "r double, c double, k double")
    assert abs(one.select(A.composite("r", "c", "k")).first()[0] - 0.55) < 1e-9
    with pytest.raises(ValueError):
        A.composite("r", "c", "k", {"retrieval": 0, "citation": 0, "completeness": 0})
    for t in (1.5, -0.1):
        with pytest.raises(ValueError):
            A.can_answer("r", t)


def test_declining(spark):
    r = spark.createDataFrame([(1, i + 1, f"text  {i}\n" + "y" * 200, f"f{i % 2}.md", f"d{i % 2}", s, None, None) for i, s in enumerate([0.2, 0.9, 0.5])], "id int, rank int, content string, source string, doc string, rerank_score double, rrf_score double, dense_score double")
    found = A.findings(r, "id", "content", "source").first().found
    assert len(found) == 3 and found[0].startswith("text 0 yyy") and found[0].endswith("... (from f0.md)")
    cand = A.candidate_documents(r, "id", "doc", "source").orderBy("place").collect()
    assert [(c.doc_id, c.score) for c in cand] == [("d1", 0.9), ("d0", 0.5)]
    g = spark.createDataFrame([("what is the cancellation refund", "A refund is due", ["see terms"])], "q string, a string, f array<string>")
    assert g.select(A.gaps("q", "a", "f").alias("g")).first().g == ["cancellation"]
    text = g.withColumn("gap", A.gaps("q", "a", "f")).select(A.summary("f", "gap").alias("s")).first().s
    assert "'cancellation'" in text and ": 1." in text


def test_messages_and_generation(spark):
    ranked = spark.createDataFrame([(1, 2, "second", "b.md", ""), (1, 1, " first ", "a.md", "Intro")], "id int, rank int, content string, source string, heading string")
    q = spark.createDataFrame([(1, "why"), (2, "how")], "id int, q string")
    m = A.messages(ranked, q, "id", "q", "content", "source", "heading")
    one = {r.id: r for r in m.collect()}
    assert one[1].context.index("Reference 1. ([Source: a.md] | heading: Intro)\nfirst\n") < one[1].context.index("Reference 2. ([Source: b.md])\nsecond")
    assert A.NO_CONTEXT in one[2].context and [x.role for x in one[1].messages] == ["system", "user"] and one[1].messages[1].content.endswith("Question: why")

    def respond(messages):
        if "how" in messages[1]["content"][-4:]:
            raise TimeoutError("30 s")
        return "yes [1]"

    rows = A.generate(m, "messages", respond).collect()
    assert all(r.latency_ms >= 0 for r in rows)
    out = {r.id: (r.answer, r.error) for r in rows}
    assert out == {1: ("yes [1]", None), 2: (None, "TimeoutError: 30 s")}
    with pytest.raises(RuntimeError):
        A.generate(m, "messages", None)
    ex = {r.id: r.answer for r in A.extractive(ranked, q, "id", "content").collect()}
    assert ex == {1: "first [1]", 2: A.DECLINE}


@pytest.mark.parametrize("reply, want", [('{"score": 0.7}', 0.7), ('so: {"score": 3}', 1.0), ("0.9", 0.0), ("{broken", 0.0), ("", 0.0), (None, 0.0), ("raise", 0.0)])
def test_completeness_by_a_judge(spark, reply, want):
    def judge(prompt):
        assert "why" in prompt and "because" in prompt
        if reply == "raise":
            raise TimeoutError
        return reply

    df = spark.createDataFrame([("why", "because")], "q string, a string")
    assert df.select(A.completeness_judged("q", "a", judge)).first()[0] == want
