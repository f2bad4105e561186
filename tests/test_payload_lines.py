"""Lines of some tables alone."""

from tabularium.sources import payloads


def test_lines_of_some_tables(spark, sf_dir):
    tables = spark.createDataFrame([(3,), (7,), (7,), (10_000_000,)], "table_id long")
    some = payloads.lines(spark, sf_dir, tables)
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, payloads.lines(spark, sf_dir).where("table_id in (3, 7)").collect()))
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("LeftSemi")  # tables are taken below the cut into lines
