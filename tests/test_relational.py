import pytest

from quern.plans import relational


@pytest.mark.parametrize("name, given", [("arithmetic", "lineitem"), ("division", "orders"), ("cast_column", "orders")])
def test_expressions_run_over_the_table(spark, name, given):
    folder = "/root/testdata/sf0.001"
    assert relational.QUERIES[name](spark, folder).count() == spark.read.parquet(f"{folder}/{given}.parquet").count()


def test_cast_literals_meet_columns_of_the_table(spark):
    folder = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{folder}/orders.parquet").where("o_totalprice > 100000 AND o_orderdate > DATE '1996-01-01'")
    got = sorted(r[0] for r in relational.QUERIES["cast_literal"](spark, folder).collect())
    assert got == sorted(r["o_orderkey"] for r in orders.collect()) and max(got) >= 100
