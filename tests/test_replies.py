"""Replies, settings and patches as VARIANT columns."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import replies


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(column(F.col("v"))).collect()]


def test_cells_of_a_reply(spark):
    texts = ['{"cellAddress": "A1", "value": "x"}', '[{"cellAddress": "A1", "value": 5}, null, 7, [], {"value": "y"}, {"cellAddress": "", "value": "z"}, {"cellAddress": "B1"}]', "[]", "{}", "text", "", None, '"A1"', '{"cellAddress": 5, "value": "x"}']
    got = [[tuple(c) for c in cells] for cells in one(spark, replies.cells_of, *texts)]
    assert got == [[("A1", "x")], [("A1", ""), ("B1", "")], [], [], [], [], [], [], []]


def test_answers_go_to_the_cells_that_were_asked(spark):
    fence = "  ```json\n%s\n```  "
    texts = {1: "plain words ", 2: fence % '{"cellAddress": "Z9", "value": "v"}', 3: '[{"cellAddress": "B1", "value": "b"}, {"cellAddress": "B1", "value": "late"}, {"cellAddress": "X1", "value": "x"}]', 4: "no json", 5: None}
    asked = [(1, 0, "A1"), (2, 0, "A1"), (3, 0, "A1"), (3, 1, "B1"), (4, 0, "A1"), (4, 1, "B1"), (5, 0, "A1"), (6, 0, "A1")]
    got = replies.answers(spark.createDataFrame(list(texts.items()), "id int, text string"), spark.createDataFrame(asked, "id int, pos int, cellAddress string"))
    assert {(r.id, r.cellAddress): r.value for r in got.collect()} == {(1, "A1"): "plain words", (2, "A1"): "v", (3, "A1"): "", (3, "B1"): "b", (4, "A1"): "", (4, "B1"): "", (5, "A1"): "", (6, "A1"): ""}


def test_payload_text(spark):
    texts = ['{"content": " a "}', '{"content": "", "text": 5}', '{"data": {"text": "c"}}', '{"other": 1}', "plain", None, '{"content": true, "data": [1]}']
    assert one(spark, replies.payload_text, *texts) == ["a", "5", "c", '{"other": 1}', "plain", None, '{"content": true, "data": [1]}']


def test_canonical_json(spark):
    assert one(spark, replies.canonical, '{ "a b" : [1, 2],\n"c": "x \\" y" }', '{"a b":[1,2],"c":"x \\" y"}', None) == ['{"a b":[1,2],"c":"x \\" y"}'] * 2 + [None]


def merged(raw):
    """The same rules, plainly."""
    out = {k: dict(v) for k, v in replies.DEFAULTS.items()}
    try:
        value = json.loads(raw)
    except (ValueError, TypeError):
        return out
    if not isinstance(value, dict):
        return out
    for k in out:
        own = value.get(k) if isinstance(value.get(k), dict) else {}
        out[k] |= own
        if k == "pdf" and own.get("referenceTranslationStrategy") not in replies.STRATEGIES:
            out[k]["referenceTranslationStrategy"] = "keep-original"
        if k == "layout":
            for name, (least, most, default) in replies.BOUNDS.items():
                x = own.get(name)
                out[k][name] = min(most, max(least, x)) if isinstance(x, int | float) and not isinstance(x, bool) else default
    return out


@pytest.mark.parametrize(
    "raw",
    [None, "", "{", "[]", "5", "{}", '{"general": {"language": "en-US", "new": {"x": [1]}}, "notes": 7}', '{"layout": {"aiAssistantMainRatio": 0.1, "graphLeftWidth": "300", "graphRightWidth": 1e9, "pdfRightPanelWidth": true, "more": null}}', '{"pdf": {"referenceTranslationStrategy": "skip"}, "layout": {"aiAssistantMainRatio": 0.6}}', '{"pdf": {"referenceTranslationStrategy": 1, "defaultScale": "big"}}'],
)
def test_settings(spark, raw):
    (found,) = spark.createDataFrame([(raw,)], "v string").select(F.to_json(replies.settings(F.col("v")))).collect()[0]
    assert json.loads(found) == merged(raw)


def test_patches_set_fields_one_by_one(spark):
    papers = spark.createDataFrame([(1, "J", "N", 5), (2, None, "N", 0), (3, "J", "N", None)], "id int, journal string, notes string, lastPage int")
    patches = [(1, 1, '{"journal": "K", "lastPage": -3}'), (1, 2, '{"notes": "", "unknown": 5}'), (1, 3, "{broken"), (2, 1, '{"journal": 7, "lastPage": 4}'), (9, 1, '{"journal": "x"}')]
    got = {tuple(r) for r in replies.patched(papers, spark.createDataFrame(patches, "id int, pos int, patch string")).collect()}
    assert got == {(1, "K", "", 1), (2, None, "N", 4), (3, "J", "N", 1)}
