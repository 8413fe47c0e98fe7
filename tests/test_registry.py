import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"


def test_entry(spark):
    assert {r["scope"] for r in entry.entry(spark).collect()} >= {"ALL", "Article", "Tweet"}


def test_names():
    q, s = entry.queries(), entry.oracle_sql()
    assert len(q) > 60 and set(s) <= set(q)
