import __spark_entry__ as entry


def test_contract():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 38


def test_flagship(spark, sf_dir):
    assert [r.rank for r in entry.entry(spark).collect()] == list(range(1, 11))
