"""A benchmark in one part and in several gives the same verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.llm import op10_decontamination as op10
from paperloom.llm.common import table


def test_parts_of_a_benchmark_give_the_verdicts_of_one(spark, data):
    benchmark = table(spark, data, "benchmark")
    docs = table(spark, data, "documents").select("doc_id", "text", F.col("lang").alias("_number"), F.lit(1).alias("cosine"))
    # Documents that hold an item whole, one of two items, a null and an empty one.
    items = [r.text for r in benchmark.orderBy("item_id").limit(6).collect()]
    planted = [(10**9 + i, f"Before it. {t} And after it.", "en", 1) for i, t in enumerate(items)]
    planted += [(2 * 10**9, f"{items[0]} {items[3]}", "en", 1), (2 * 10**9 + 1, None, "en", 1), (2 * 10**9 + 2, "", None, 1)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    size = benchmark.agg(F.sum(F.octet_length("text") + 16)).first()[0]
    assert len(op10.parts_of(benchmark, -(-size // 4))) == 4
    runs = [op10.contaminated(docs, benchmark, most) for most in (size, -(-size // 4))]
    assert runs[0].columns == runs[1].columns and [f.dataType for f in runs[0].schema] == [f.dataType for f in runs[1].schema]
    one, many = ({r.doc_id: r for r in run.collect()} for run in runs)
    assert len(one) == len(many) == docs.count()
    assert {i: (r.contaminated, r.n_items) for i, r in one.items() if r.contaminated} == {i: (r.contaminated, r.n_items) for i, r in many.items() if r.contaminated}
    assert all(many[10**9 + i].contaminated for i in range(6)) and many[2 * 10**9].n_items >= 2
    assert {i: r.item_id for i, r in one.items() if r.contaminated} == {i: r.item_id for i, r in many.items() if r.contaminated}
    assert not many[2 * 10**9 + 1].contaminated and (many[2 * 10**9 + 2].n_items, many[2 * 10**9 + 2].cosine) == (0, 0.0)
    assert all(many[i]["_number"] == r["_number"] for i, r in one.items())


def test_ties_between_parts_take_the_least_item(spark):
    text = "the quick brown fox jumps over the lazy dog while eleven bright geese sing to an old green moon"
    benchmark = spark.createDataFrame([(i, text) for i in (9, 4, 7)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x y z {text} z y x"), (2, "nothing of the kind")], "doc_id long, text string")
    assert len(op10.parts_of(benchmark, 60)) > 1
    got = {r.doc_id: r for r in op10.contaminated(docs, benchmark, 60).collect()}
    assert (got[1].contaminated, got[1].item_id, got[2].contaminated) == (True, 4, False)
