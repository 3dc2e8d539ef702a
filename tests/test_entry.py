import __spark_entry__ as entry


def test_entry_and_registration(spark, sf):
    assert entry.entry(spark).count() == 8
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(oracle) > 60
