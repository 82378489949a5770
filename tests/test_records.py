"""Workbooks, documents, decks and evidence on cases that the tables don't have."""

import json

import pytest
from pyspark.sql import functions as F

from paperloom.operators import decks, evidence, records, workbook
from paperloom.sources import formats


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


LISTED = {"columns": [{"label": "论文"}, {"label": "中文标题"}], "rows": [{"id": "header", "cells": [{"value": "论文"}]}, {"id": "row-1", "cells": [{"value": "a"}, {"value": "b"}, {"value": "cut"}]}, {"cells": []}]}
SPARSE = {"snapshot": {"sheetOrder": ["s"], "sheets": {"s": {"name": "S", "cellData": {"0": {"0": {"v": "论文"}}, "2": {"12": {"f": "=A1", "v": "x"}}, "5": {"0": {"v": " "}}}, "rowData": {"2": {"rowId": "mine"}}}}}}


def test_sheets(spark):
    books = spark.createDataFrame([(1, json.dumps(LISTED)), (2, json.dumps(SPARSE)), (3, "oops"), (4, None)], "book long, value string")
    got = {}
    for r in workbook.sheet_rows(books).orderBy("book", "pos").collect():
        got.setdefault(r.book, []).append((r.row_id, r.cells))
    assert got[1] == [("header", ["论文", ""]), ("row-1", ["a", "b"])]
    assert [r[0] for r in got[2]] == ["header", "row-1", "mine"] and len(got[2][2][1]) == 13 and got[2][2][1][12] == "=A1"
    assert got[3] == got[4] == [("header", list(workbook.LABELS))]


def test_rows_for_papers_and_old_cells(spark):
    rows = spark.createDataFrame([(1, 0, "header", list(workbook.LABELS)), (1, 1, "row-1", ["x"] + [""] * 10)], "book long, pos int, row_id string, cells array<string>")
    links = spark.createDataFrame([(1, "row-1", "p1"), (1, "gone", "p2")], "book long, row_id string, paper_id string")
    papers = spark.createDataFrame([(1, "p1", 0, "n1", "", "e1", ""), (1, "p2", 1, "", "c2", "e2", "note")], "book long, id string, pos long, pdfName string, chineseTitle string, englishTitle string, notes string")
    new, kept = workbook.ensured_rows(rows, links, papers)
    assert {(r.row_id, r.paper_id) for r in kept.collect()} == {("row-1", "p1"), ("row-2", "p2")}
    assert new.filter("row_id = 'row-2'").first().cells == ["e2", "c2", "e2"] + [""] * 7 + ["note"]
    legacy = spark.createDataFrame([(1, "row-1", "方法", "PPO"), (1, "row-1", "论文", "other")], "book long, row_id string, label string, value string")
    assert workbook.filled(rows, legacy).filter("pos = 1").first().cells == ["x", "", "", "", "", "PPO", "", "", "", "", ""]
    cells = workbook.cell_rows(rows)
    dense = workbook.dense_rows(cells, F.lit(11)).filter("pos = 1").first().cells
    assert dense == ["x"] + [""] * 10


def test_unique_names(spark):
    names = workbook.unique_names(F.array(F.lit("a"), F.lit("a (2)")), F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("b")))
    assert spark.range(1).select(names).first()[0] == ["a (3)", "b", "a (4)", "b (2)"]


def test_document_headers(spark):
    text = "Title: An x\r\n作者： Ann\nyear: 2001\nyear: 2002\n\n\nFirst\n\nauthor: no"
    r = spark.createDataFrame([(text,)], "t string").select(formats.headed(F.col("t")).alias("x")).first().x
    assert (r.metadata.englishTitle, r.metadata.authors, r.metadata.year, r.metadata.journal) == ("An x", "Ann", "2002", "")
    assert r.body == "First\n\nauthor: no"
    assert spark.createDataFrame([("No header\nhere",)], "t string").select(formats.headed(F.col("t"))["body"]).first()[0] == "No header\nhere"
    with pytest.raises(Exception, match="no reader"):
        formats.documents(spark.createDataFrame([("x.pdf", "")], "path string, value string")).collect()


@pytest.mark.parametrize(
    "f, text, expected",
    [
        (decks.topic, "The language instructions of π07（p. 3）", "pi0.7"),
        (decks.topic, "plain words", ""),
        (decks.bullet_key, "A, b。C（p. 12）", "a b c"),
        (decks.is_weak, "PPO SAC", True),
        (decks.is_weak, "PPO 用于训练", False),
        (evidence.evidence_tokens, "The MPC uses a 3.5 rate-limited planner, planner", ["mpc", "3.5", "rate-limited", "planner"]),
        (evidence.without_heading, "III. E XPERIMENTS The policy runs.", "The policy runs."),
        (evidence.without_heading, "A plain sentence. The next one.", "A plain sentence. The next one."),
        (evidence.clauses, "short", ["short"]),
        (records.search_queries, "英文标题: A Name\nA Latin Phrase of some length that goes on", ["A Name", "A Latin Phrase of some length that goes on"]),
        (records.epoch_ms, "1970-01-01T00:00:01Z", 1000),
        (records.epoch_ms, " ", 0),
        (formats.file_name, ' a/b:c*?.pdf. ', "a_b_c_.pdf"),
    ],
)
def test_columns(spark, f, text, expected):
    assert one(spark, f(F.col("t")), t=text) == expected


def test_long_sentences_are_packed(spark):
    text = "the first part of a long sentence goes on and on for a while, the second part of it does so too with many more words and the third part ends it after some further words that nobody needs"
    got = one(spark, evidence.clauses(F.col("t")), t=text)
    assert len(got) == 2 and all(len(x) <= 135 for x in got)


def test_terms(spark):
    x = one(spark, evidence.terms(F.col("t")), t="We train PILOT and a world model with RGB images on the Unitree G1; ppo is named in small letters.")
    assert (x.methods, x.observations, x.platforms, x.baselines) == (["PILOT", "World Model"], ["RGB observations"], ["Unitree G1"], [])


def test_decks(spark):
    plan = spark.createDataFrame([(1, 0, "method", "t", ["a b c d", "a b c d e", "a b c e d"], "p. 1", "n"), (1, 1, "results", "t", ["x"], "", "")], decks.PLAN)
    assert [r.slide for r in decks.similar_bullets_flag(plan).collect()] == [0]
    patches = spark.createDataFrame([(1, 1, 0, ["old"], "m"), (1, 1, 1, ["new"], "m2"), (9, 9, 0, ["z"], "m")], "plan long, slide long, pos int, bullets array<string>, notes string")
    assert {(r.slide, tuple(r.bullets), r.notes) for r in decks.patched(plan, patches).collect()} == {(0, ("a b c d", "a b c d e", "a b c e d"), "n"), (1, ("new",), "m2")}
    refs = spark.createDataFrame([(1, 0, "Method", "x"), (1, 0, "Results", "y"), (1, 1, "Results", "z")], "plan long, slide long, section string, text string")
    assert {r.text for r in decks.scoped(refs, "Method", "Results").collect()} == {"x", "z"}
    issues = {(r.slide, r.issue) for r in decks.issues(plan).collect()}
    assert {(None, "few_slides"), (1, "no_notes"), (1, "no_page_source"), (0, "few_native_bullets")} <= issues
