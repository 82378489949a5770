"""Edges of distinct mentions without a shuffle, equal to those counted."""

from pyspark.sql import functions as F

from paperloom.operators import graph


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_distinct_mentions_are_edges_as_they_are(spark, data):
    rows = graph.mentions(spark, data)
    stored = spark.createDataFrame(rows.select("paper", "type", "node").union(rows.limit(0).select("paper", "type", "node")).collect() + [(None, "method", "method:x"), (None, "year", None), (1, "year", None)], "paper long, type string, node string")
    plain, short = graph.value_edges(stored), graph.value_edges(stored, distinct=True)
    assert plain.exceptAll(short).count() == 0 and short.exceptAll(plain).count() == 0
    assert exchanges(short) == 0 and exchanges(plain) == 1
    a, b = (graph.co_occurrence(stored, "method", "x", d) for d in (False, True))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0 and b.count() > 0


def test_values_of_papers_are_dealt_once(spark, data):
    plan = graph.mentions(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and plan.count("Exchange hashpartitioning(paper") == 1


def test_statistics_of_no_mentions(spark, data, tmp_path):
    for name in ("orders", "customer", "lineitem", "part"):
        spark.read.parquet(f"{data}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert tuple(graph.graph_stats(spark, str(tmp_path)).collect()[0]) == (0, None, 0, 0)
    s = graph.graph_stats(spark, data)
    assert s.columns == ["nodes", "mentions", "edges", "papers"]
    assert s.collect()[0].edges == graph.value_edges(graph.mentions(spark, data)).agg(F.count("*")).collect()[0][0]
