import __spark_entry__ as entry_module


def test_every_query_has_sql_and_a_fitting_name():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    assert len(queries) >= 150


def test_entry_runs(spark):
    d = entry_module.entry(spark)
    assert d.count() > 0 and "rating" in d.columns
