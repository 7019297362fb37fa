import os

import pytest

import __spark_entry__ as entry
from loamsift.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_optional_part():
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "loamsift")
    for d, _, files in os.walk(root):
        if os.path.basename(d) != "llm":
            for f in files:
                if f.endswith(".py"):
                    text = open(os.path.join(d, f)).read()
                    assert "from .llm" not in text and "from ..llm" not in text and "loamsift.llm" not in text


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_are_those_of_the_sql(spark, name):
    import duckdb

    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    rel = con.sql(SQL[name])
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(rel.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(*rel.columns).collect()), key=key) == sorted(rel.fetchall(), key=key)
