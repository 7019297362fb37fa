import pytest

from loamsift.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(queries.SQL) <= set(queries.QUERIES)
    assert {f"p{n}_found" for n in range(1, 9)} <= set(queries.QUERIES)


COLUMNS = {
    "p1_found": ["doc_id", "config_id", "forced"],
    "p2_found": ["vec_a", "vec_b"],
    "p3_found": ["chunk_a", "chunk_b"],
    "p4_found": ["result_id", "defect"],
    "p5_found": ["chunk_a", "chunk_b"],
    "p6_found": ["capacity_id", "doc_id"],
    "p7_found": ["doc_id", "question_id"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    import os

    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name]
    rows = df.collect()
    assert rows and len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(n for n in COLUMNS if n in queries.SQL))
def test_rows_are_those_of_the_sql(spark, name):
    import os

    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    rel = con.sql(queries.SQL[name])
    df = queries.QUERIES[name](spark, SF)
    assert {tuple(r) for r in df.select(*rel.columns).collect()} == set(rel.fetchall())
