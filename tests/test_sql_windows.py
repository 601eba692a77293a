"""The windows of a table of texts, by the SQL function that gives a list."""

from lodestar import workload
from lodestar.plans import registry


def test_texts_are_not_joined_with_themselves(spark, t):
    plan = workload.load()["n_token_windows"].run(spark, t.folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_window_list(spark):
    registry.register_sql_functions(spark)
    spark.createDataFrame([(1, "a b  c d e"), (2, " "), (3, None), (4, "x"), (4, "x")], "id long, text string").createOrReplaceTempView("texts_for_list")
    rows = spark.sql("SELECT id, w.* FROM (SELECT id, token_window_list(text, 3, 1) AS list FROM texts_for_list) LATERAL VIEW inline(list) w AS i, text, start, stop").collect()
    assert sorted(map(tuple, rows)) == [(1, 0, "a b c", 0, 3), (1, 1, "c d e", 2, 5), (1, 2, "e", 4, 5), (4, 0, "x", 0, 1), (4, 0, "x", 0, 1)]
