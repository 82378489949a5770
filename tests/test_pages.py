"""Outlines of positioned text, on small pages."""

from paperloom.operators import pages

RUN = "doc long, page long, n long, str string, x double, y double, width double, height double, page_width double, page_height double"
#: doc -> (page, runs of (text, x, y, width, height)).
PAGES = {
    1: (1, [("right column later", 330, 120), ("left column first", 60, 120), ("left column second", 60, 140), ("right column final", 330, 140)]),
    2: (2, [("I. INTRODUCTION", 180, 80, 160, 14), ("x_t = f(x, u) + epsilon", 80, 130, 180, 10), ("Fig. 1: Robot examples.", 80, 170, 180, 9), ("Foundation models work on the principle that generalist capabilities emerge.", 80, 220)]),
    3: (2, [("I. I NTRODUCTION", 180, 80, 160, 14), ("Foundation models work on the principle that generalist capabilities emerge.", 80, 130), ("II. R ELATED W ORK", 180, 180, 160, 14), ("Generalist robot manipulation policies are widely studied.", 80, 230)]),
    4: (
        1,
        [
            ("Abstract", 220, 80, 120, 14), ("We present a model that follows diverse language instructions.", 70, 120, 260, 10), ("I. INTRODUCTION", 220, 180, 160, 14),
            ("Foundation models emerge from large and diverse datasets.", 70, 220, 260, 10), ("A. Subgoal images", 70, 280, 150, 12), ("Subgoal images provide additional context for robot policies.", 70, 320, 260, 10),
        ],
    ),
    5: (3, [("Cross-embodiment generaliza-", 60, 100), ("tion is important for robot learning.", 60, 113)]),
    6: (2, [("The model", 60, 100, 55, 10), ("π", 120, 100, 5, 10), ("0", 127, 100, 4, 6), (".", 132, 100, 2, 6), ("7", 136, 100, 4, 6), ("can follow diverse language instructions.", 146, 100, 220, 10)]),
    7: (
        2,
        [
            ("I. INTRODUCTION", 220, 80, 160, 14), ("Foundation models work on the principle that generalist capabilities", 58.9, 120, 260, 10), ("emerge from training on large and diverse datasets.", 49, 134, 260, 10),
            ("In this paper, we present a new model with compositional generalization.", 58.9, 148, 260, 10), ("This model follows diverse instructions in unseen environments.", 49, 162, 260, 10),
        ],
    ),
    8: (1, [("  ", 10, 10)]),
}


def rows(doc, page, runs):
    return [(doc, page, n, text, *map(float, (x, y, *(size or (120, 10)))), None, None) for n, (text, x, y, *size) in enumerate(runs)]


def test_page_blocks(spark):
    df = spark.createDataFrame([r for doc, (page, runs) in PAGES.items() for r in rows(doc, page, runs)], RUN)
    lines = pages.kept_lines(pages.text_lines(df))
    found = {}
    for b in sorted(pages.page_blocks(lines).collect(), key=lambda b: (b.doc, b.page, b.pos)):
        found.setdefault(b.doc, []).append(b)
    texts = {doc: [b.original for b in bs] for doc, bs in found.items()}
    assert texts[1] == ["left column first left column second", "right column later right column final"]
    assert [b.kind for b in found[2]] == ["heading", "formula", "caption", "paragraph"]
    assert [b.section for b in found[3]] == ["I. INTRODUCTION", "I. INTRODUCTION", "II. RELATED WORK", "II. RELATED WORK"]
    assert texts[5] == ["Cross-embodiment generalization is important for robot learning."]
    assert texts[6] == ["The model π0.7 can follow diverse language instructions."]
    assert texts[7][1:] == ["Foundation models work on the principle that generalist capabilities emerge from training on large and diverse datasets.", "In this paper, we present a new model with compositional generalization. This model follows diverse instructions in unseen environments."]
    assert 8 not in found
    outline = [b for b in pages.document_blocks(pages.page_blocks(lines)).filter("doc = 4").orderBy("pos").collect()]
    assert [b.section for b in outline] == ["Abstract", "Abstract", "I. INTRODUCTION", "I. INTRODUCTION", "A. Subgoal images", "A. Subgoal images"]
    paragraphs = [b for b in outline if b.kind == "paragraph"]
    assert [(b.section_order, b.paragraph_order) for b in paragraphs] == [(1, 1), (2, 1), (3, 1)]
    assert len({b.section_id for b in paragraphs}) == 3


def test_paragraphs_go_on_over_pages(spark):
    runs = rows(1, 1, [("I. INTRODUCTION", 220, 80, 160, 14), ("The system then learns from many hours of play how it can", 60, 120, 260, 10)])
    runs += rows(1, 2, [("7", 300, 20, 8, 9), ("move many objects in a room.", 60, 120, 260, 10), ("It also opens doors in the house.", 60, 220, 260, 10), ("7", 300, 780, 8, 9)])
    got = pages.outline(spark.createDataFrame(runs, RUN)).orderBy("pos").collect()
    assert [(b.page, b.section, b.original) for b in got] == [
        (1, "I. INTRODUCTION", "I. INTRODUCTION"),
        (1, "I. INTRODUCTION", "The system then learns from many hours of play how it can move many objects in a room."),
        (2, "I. INTRODUCTION", "It also opens doors in the house."),
    ]
    assert pages.outline(spark.createDataFrame([], RUN)).count() == 0


def test_lines_and_blocks_need_no_frame_for_each_page(spark):
    runs = [(d, p, n, t, x, y, w, h, pw, None) for d in (1, None) for p in range(1, 120) for n, t, x, y, w, h, pw in ((0, " a ", 60.0, 100.0, 20.0, 10.0, None), (1, "b", 84.0, 101.0, 20.0, 10.0, 600.0), (2, None, 1.0, 1.0, 1.0, 1.0, None), (3, "far", 400.0, 100.0, 20.0, 10.0, None), (None, "low", 60.0, None, 20.0, 10.0, None))]
    found = pages.text_lines(spark.createDataFrame(runs, RUN))
    rows = found.collect()
    assert len(rows) == 2 * 119 * 3
    for d in (1, None):
        got = {(r.line, r.text, r.left, r.y, r.right, r.page_width) for r in rows if r.doc == d and r.page == 7}
        assert got == {(0, "a b", 60.0, 100.5, 104.0, 600.0), (1, "far", 400.0, 100.0, 420.0, None), (2, "low", 60.0, None, 80.0, None)}
    plan = pages.outline(spark.createDataFrame(runs, RUN))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan
