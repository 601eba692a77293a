"""The few terms of the queries are sent to the lists of a stored index; lists are not shuffled to them."""

from lodestar.operators import inverted_index as N


def test_lists_are_not_shuffled_to_few_terms(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 11} common text") for i in range(300)], "doc_id long, text string")
    N.build_index(docs, str(tmp_path), block_docs=16)
    index = N.TextIndex.open(spark, str(tmp_path))
    queries = spark.createDataFrame([(1, "word3 common"), (2, "word10")], "query_id long, text string")
    plans = []
    scored = N.TextIndex._scored

    def seen(self, pairs, terms, k):
        plans.extend([self.bounds(terms), scored(self, pairs, terms, k)])
        return plans[-1]

    N.TextIndex._scored = seen
    try:
        assert index.search(queries, 5).count() == 10
    finally:
        N.TextIndex._scored = scored
    shown = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert len(shown) == 4 and not any("SortMergeJoin" in p for p in shown)
