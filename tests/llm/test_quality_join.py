"""The labels of op7 meet the documents the same way at any size."""

from hirelake.llm import quality


def test_labels_are_not_broadcast(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (2, "b"), (None, "c")], "doc_id long, text string")
    labelled = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    joined = quality.with_quality(docs, labelled)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    rows = {(r.doc_id, r.text, r.quality) for r in joined.collect()}
    assert rows == {(1, "a", 1), (2, None, 0), (2, "b", 0), (None, "c", None)}
