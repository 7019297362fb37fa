import pytest
from pyspark.sql import functions as F

from loamsift.operators import metrics as M
from loamsift.sources import golden


def test_scores(spark):
    df = spark.createDataFrame([("lookup", "red blue", "red green"), ("no_answer", "none known", "I don't have enough information about that"), ("no_answer", "none known", "none known"), ("lookup", "", "x"), ("lookup", "x", None)], "c string, g string, a string")
    assert [round(r[0], 4) for r in df.select(M.correctness("c", "g", "a")).collect()] == [0.3333, 1.0, 0.5, 1.0, 0.0]
    f = spark.createDataFrame([("The sky is green.", "bananas"), ("Bananas are yellow. Nothing fits.", "yellow bananas grow"), (None, "x")], "a string, c string")
    assert [r[0] for r in f.select(M.faithfulness("a", "c")).collect()] == [0.0, 0.5, 1.0]
    r = spark.createDataFrame([("red blue", ["Intro", "End"], "red text", "intro"), ("red", [], "red", ""), ("red", ["x"], "", "")], "g string, s array<string>, c string, m string")
    assert [x[0] for x in r.select(M.retrieval_relevance("g", "s", "c", "m")).collect()] == [0.5, 1.0, 0.0]
    c = spark.createDataFrame([("no_answer", "none", 0, None), ("no_answer", "x [1]", 1, 1.0), ("lookup", "x", 0, None), ("ambiguous", "x", 0, None), ("lookup", "x [1]", 2, 0.5), ("lookup", "x [1]", 0, None)], "c string, a string, t int, k double")
    assert [x[0] for x in c.select(M.citation_accuracy("c", "a", F.col("t"), F.col("k"))).collect()] == [1.0, 0.0, 0.5, 1.0, 0.5, 0.5]


@pytest.mark.parametrize("raw, n, want", [('{"grounded": [true, false]}', 2, 0.5), ('{"grounded": [true]}', 2, 0.5), ('{"score": 3}', None, 1.0), ("about 0.4 I think", None, 0.4), ("-0.5", None, 0.0), (".8", None, 0.8), ("Score: .7", None, 0.7), ("+0.3", None, 0.3), ("", None, 0.25), (None, None, 0.25)])
def test_judge_replies(raw, n, want):
    assert M.parse_judge(raw, n, 0.25) == want


def results(spark, rows):
    return spark.createDataFrame([(s, c, q, *m, e) for s, c, q, m, e in rows], "strategy string, category string, question_id string, correctness double, faithfulness double, retrieval_relevance double, citation_accuracy double, error string")


def test_reports_and_winners(spark):
    r = results(spark, [("fixed", "lookup", "q", (0.8, 0.9, 0.7, 0.8), None), ("recursive", "lookup", "q", (0.805, 0.7, 0.5, 0.6), None), ("semantic", "lookup", "q", (0.1, 0.2, 0.0, None), "boom")])
    rep = {(x.strategy, x.metric): x for x in M.report(r).where("category IS NULL").collect()}
    assert (rep["semantic", "citation_accuracy"].n, rep["semantic", "citation_accuracy"].mean) == (0, 0.0)
    means = M.strategy_means(r)
    w = {x.metric: x.winner for x in M.winners(means).collect()}
    assert w["correctness"] == "recursive+fixed" and w["faithfulness"] == "fixed"
    assert [x.strategy for x in M.overall(means).orderBy("place").collect()] == ["fixed", "recursive", "semantic"]
    assert {x.winner for x in M.category_winners(M.report(r)).collect()} == {"fixed", "recursive"}
    assert {x.strategy: x.errors for x in M.errors(r).collect()} == {"fixed": 0, "recursive": 0, "semantic": 1}
    assert {x.metric: x.gain_percent for x in M.gains(means).collect()}["faithfulness"] == 28.6
    assert len(M.report_json(M.report(r)).collect()) == 3


def test_golden_sets(spark, tmp_path):
    bad = [{"id": "a", "type": "bogus", "question": "", "golden_answer": "", "source_docs": [], "section": ""}, {"id": "a", "category": "lookup", "question": "q", "answer": "x", "source_documents": [], "source_sections": []}, {"id": "b", "category": "no_answer", "question": "q", "answer": "x", "source_documents": ["d"]}]
    issues = {(r.id, r.issue) for r in golden.validate(golden.from_rows(spark, bad)).collect()}
    assert {("a", "bad category"), ("a", "empty question"), ("a", "duplicate id"), ("a", "missing source sections"), ("b", "unexpected source documents"), (None, "too few questions"), (None, "no questions of category multi_hop")} <= issues
    p = tmp_path / "g.json"
    p.write_text('{"questions": [{"id": "g1", "category": "lookup", "question": "q", "answer": "a", "source_documents": ["d"], "source_sections": ["s"], "notes": null}]}')
    assert golden.read_json(spark, str(p)).first().source_documents == ["d"]
    assert {r.category: r.n for r in golden.counts(golden.read_json(spark, str(p))).collect()} == {"lookup": 1, "multi_hop": 0, "no_answer": 0, "ambiguous": 0, "total": 1}


def test_means_half_way_are_rounded_up_on_both_sides(spark):
    r = results(spark, [("fixed", "lookup", str(i), (v, v, v, v), None) for i, v in enumerate([0.65905, 0.65905, 0.65905])])
    assert {x.mean for x in M.report(r).collect()} == {0.6591}


def test_a_judge_scores(spark):
    df = spark.createDataFrame([("q", "g", "One fact. Two facts.", "ctx"), ("q", "g", "", ""), ("q", "g", "fails", "ctx")], "q string, g string, a string, c string")

    def judge(prompt):
        if "fails" in prompt:
            raise TimeoutError
        return '{"grounded": [true]}' if "support" in prompt else "0.9"

    rows = df.select(*(c.alias(n) for n, c in M.judge_scores("q", "g", "a", "c", judge).items())).collect()
    assert [tuple(r) for r in rows] == [(0.9, 0.5, 0.9), (0.9, 1.0, 0.0), (0.5, 0.0, 0.9)]


def test_strategies_are_compared_in_words(spark):
    r = results(spark, [("fixed", "lookup", "q", (0.8, 0.5, 0.7, 0.8), None), ("semantic", "lookup", "q", (0.4, 0.6, 0.0, 0.1), None)])
    row = M.comparison(M.strategy_means(r)).first()
    assert (row.winner, row.runner_up) == ("fixed", "semantic") and row.summary == "fixed leads semantic in correctness by 100.0 %: 0.70 to 0.28"
    assert '"winner":"fixed"' in M.comparison_json(M.report(r)).first().json
    alone = M.comparison(M.strategy_means(r.where("strategy = 'fixed'"))).first()
    assert alone.runner_up == "fixed" and alone.summary.startswith("fixed leads fixed on average")


def test_golden_selection_flags_and_summary(spark):
    g = golden.from_rows(spark, [{"id": "a", "category": "lookup", "question": "q", "answer": "x", "source_documents": ["d.md"]}, {"id": "b", "category": "no_answer", "question": "q", "answer": "x"}])
    assert [r.id for r in golden.select(g, "lookup").collect()] == ["a"] and golden.select(g).count() == 2
    assert [(r.is_lookup, r.is_no_answer) for r in golden.flags(g).orderBy("id").collect()] == [(True, False), (False, True)]
    assert "questions: 2" in golden.summary(g, "Set", "v1") and "d.md" in golden.summary(g)
