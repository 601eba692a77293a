"""Questions are dealt over tasks by their number, not by the bytes that they compress to."""

import check_oracles
import pytest
from conftest import SMALL
from lodestar import workload
from lodestar.operators import querylog as L


def test_a_task_has_a_bounded_number_of_questions(spark, t, monkeypatch):
    monkeypatch.setattr(L, "TASK_QUESTIONS", 10, raising=False)
    columns, relations = L.catalog_tables(spark, {"nation": t("nation"), "region": t("region")}, {"nation": ["n_nationkey"]}, [("nation", "n_regionkey", "region", "r_regionkey")])
    asked = [(i, "the same words about the nation and its region") for i in range(400)]
    questions = spark.createDataFrame(asked, "question_id long, text string")
    blocks = L.render_relations(L.rank_tables(questions, columns), relations)
    sizes = blocks.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 400 and max(sizes) <= 30 and len(sizes) == 40


@pytest.mark.parametrize("name", ["i01_rank_tables", "i03_schema_blocks", "i03_relation_blocks"])
def test_queries_over_several_tasks(spark, monkeypatch, name):
    monkeypatch.setattr(L, "TASK_QUESTIONS", 100, raising=False)
    entry = workload.load()[name]
    assert check_oracles.compare(entry.run(spark, SMALL), check_oracles.duck(SMALL), entry.sql) is None
