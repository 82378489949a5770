"""Outlines as Markdown, slides that stay, checks and capabilities."""

from paperloom.operators import outlines as o

SLIDES = f"plan long, slide long, type string, title string, subtitle string, bullets array<string>, steps array<string>, figures {o.FIGURE}, refs {o.REF}, footer string, notes string"


def slides(spark, *rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SLIDES)


def test_markdown(spark):
    s = slides(spark, ("cover", "A talk", "by B", [], None, None, None, "", ""), ("method", "How", None, ["one", "two"], None, [("Figure 1", 3, "method")], [(4, "Intro", "text")], "", "say it"))
    drafts = spark.createDataFrame([(1, "T", "S", "today"), (2, None, None, None)], "plan long, title string, subtitle string, created string")
    got = {r.plan: r.text for r in o.markdown(drafts, s).collect()}
    assert got[1] == "# T\n\n> S\n\n生成时间：today\n\n## 1. A talk\n\nby B\n\n## 2. How\n\n- one\n- two\n\n图表候选：\n- Figure 1（来源：p. 3；用途：method）\n\n来源：\n- p. 4 · Intro：text\n\n备注：say it\n"
    assert got[2] == "# \n\n> \n\n生成时间：\n"


def test_slides_stay_by_priority_in_order(spark):
    kinds = ["formula", "summary", "method", "unknown", "cover", "method", None]
    s = slides(spark, *[(k, "", None, [], None, None, None, "", "") for k in kinds])
    assert [r.slide for r in o.selected(s, 3).orderBy("slide").collect()] == [2, 4, 5]
    assert [r.slide for r in o.selected(s, 6).orderBy("slide").collect()] == [0, 1, 2, 3, 4, 5]
    assert o.selected(s, 99).count() == len(kinds)


def test_checks(spark):
    s = slides(
        spark,
        ("cover", "anything", None, [], ["论点"], None, None, "", ""),
        ("method", "方法框架", None, ["the weather"], None, None, None, "", ""),
        ("method", "Method", None, ["a policy network"], None, None, None, "", ""),
        ("summary", "总结", None, None, ["用策略"], None, None, "", ""),
    )
    assert {(r.slide, r.issue) for r in o.checks(s).collect()} == {(0, "placeholder_steps"), (1, "method_without_evidence"), (2, "title_of_other_type")}


def test_capabilities(spark):
    steps = ["observe", "encode", "plan", "act"]
    good = ("method", "", None, ["the challenge of control", "inputs are observations, connected to a policy", "training by loss", "evaluated by success"], steps, None, [(1, "s", "output action")], "", "")
    full = spark.createDataFrame([(1, 0, *good), (2, 0, *good[:4], None, *good[5:]), (3, 0, "results", *good[1:])], SLIDES)
    got = {r.plan: r.asDict() for r in o.capabilities(full).collect()}
    assert got[1] == {"plan": 1, "explains_method": True, **dict.fromkeys(o.FINDS, True), "method_stages": True, "repeated_keywords": False, "generic_template": False}
    assert not got[2]["method_stages"] and not got[2]["explains_method"] and got[2]["stage_inputs"]
    assert not any(got[3][k] for k in ("explains_method", "method_stages", *o.FINDS))
    twice = spark.createDataFrame([(1, 0, "summary", "", None, ["Same one（p. 2）", "same one"], ["论点"], None, None, "", "")], SLIDES)
    (r,) = o.capabilities(twice).collect()
    assert r.repeated_keywords and r.generic_template
