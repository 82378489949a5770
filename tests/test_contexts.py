"""Contexts under a budget, cut wherever it ends."""

from paperloom.operators import contexts as c

PARTS = "paper int, pos long, text string"


def test_every_budget_cuts_where_a_plain_slice_does(spark):
    texts = ["first part", None, "é漢字", "", "x", "the last"]
    parts = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)] + [(2, 0, None)], PARTS).repartition(3)
    whole = "\n\n".join(t for t in texts if t)
    for budget in range(1, len(whole) + 3):
        (row,) = c.assembled(parts, budget).collect()
        assert row.text == whole[:budget], budget


def test_later_parts_are_dropped_before_they_are_joined(spark):
    rows = c.assembled(spark.createDataFrame([(1, i, "y" * 1000) for i in range(500)], PARTS), 2_500)
    assert rows.collect()[0].text == "\n\n".join(["y" * 1000] * 500)[:2_500]
    assert "begin" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_requests_number_their_papers(spark):
    parts = spark.createDataFrame([(7, 0, "seven"), (8, 0, "eight")], PARTS)
    asked = spark.createDataFrame([("r", 2, 7), ("r", 1, 8), ("r", 3, 9), ("s", 1, 7)], "request string, pos int, paper int")
    got = {r.request: (r.papers, r.text) for r in c.contexts(asked, parts, 4).collect()}
    assert got == {"r": (3, "【论文上下文 1 / 8】\neigh\n\n【论文上下文 2 / 7】\nseve\n\n【论文上下文 3 / 9】\n"), "s": (1, "【论文上下文 1 / 7】\nseve")}
