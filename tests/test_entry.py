import __spark_entry__ as entry


def test_queries_and_sql_agree_in_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p2_found", "p3_found", "p5_found", "p6_found"} <= set(queries)
