import __spark_entry__ as e


def test_contract(spark):
    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries)
    assert e.entry(spark).count() > 0
