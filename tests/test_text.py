"""Text functions on cases that the tables don't have."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import graph, library, similarity
from paperloom.sources import formats


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize(
    "f, text, expected",
    [
        (T.is_reference, "[12] A. Author, Some Title, 2020.", True),
        (T.is_reference, "3. Smith, John", True),
        (T.is_bibliography, "A, B, C, D, arXiv preprint 2019", True),
        (T.is_bibliography, "one, two", False),
        (T.is_front_title, "Deep Learning For Robot Control", True),
        (T.is_figure_label, "World Model", True),
        (T.is_epigraph, "I have seen things", True),
        (T.is_author_list, "Ann Lee, Bob Ray, Cid Moe, Dan Poe, Eva Roe", True),
        (T.is_attribution, "Ann Lee, Bob, Cid", True),
        (T.is_contribution_list, "Robot hardware: A, B, C, D, E", True),
        (T.is_translatable, "This is a plain readable sentence.", True),
        (T.is_translatable, "bad � text with enough words here", False),
        (T.line_type, "Figure 1: A robot", "caption"),
        (T.line_type, "x = a + b", "paragraph"),
        (T.line_type, "x_t = f(x, u) + e", "formula"),
        (T.is_reference, "  [3] B. Author, Title", True),
        (T.line_type, "I. INTRODUCTION", "heading"),
        (T.line_type, "I. I N T R O D U C T I O N", "heading"),
        (T.line_type, "We propose a method that learns.", "paragraph"),
        (T.spaced_heading, "I. I N T R O D U C T I O N", "I. INTRODUCTION"),
        (T.fnv36, "hello", "m3bicr"),
        (T.poly36, "hello", "1n1e4y"),
        (T.readable, "what???? ??", ""),
        (T.readable, "a�b   c", "ab c"),
        (T.redacted, "key sk-abcdefgh12 end", "key [REDACTED_API_KEY] end"),
        (T.unfenced, "```json\n{}\n```", "{}"),
        (T.json_part, "so {\"a\": {}} it", "{\"a\": {}}"),
        (T.base_name, "C:\\x\\y.pdf", "y.pdf"),
        (T.values_of, "PPO; ppo，none / RL | a", ["PPO", "RL"]),
        (T.people_of, "Ann Lee et al.; Bob Ray", ["Ann Lee", "Bob Ray"]),
        (T.sentences, "One. Two! Three", ["One.", "Two!", "Three"]),
    ],
)
def test_text(spark, f, text, expected):
    assert one(spark, f(F.col("t")), t=text) == expected


def test_methods(spark):
    got = one(spark, T.methods_of(*map(F.col, "abcd")), a="CBF-PINN; Safe RL", b="", c="A* with MPC", d="")
    assert got == ["RL", "PINN", "CBF", "MPC", "A*", "CBF-PINN", "Safe RL"]


def test_fan_out_caps_and_first_labels(spark):
    e = spark.createDataFrame([("p1", 0, ["A b", "C"] * 6, ["x"])], "paper string, entry_pos int, keyword array<string>, author array<string>")
    rows = graph.fan_out(e)
    assert rows.filter("type = 'keyword'").count() == 10
    assert {r.node for r in rows.collect()} == {"keyword:a b", "keyword:c", "author:x"}


def test_co_occurrence_needs_two_papers_each(spark):
    rows = spark.createDataFrame([("p1", "m", "a"), ("p1", "m", "b"), ("p2", "m", "a"), ("p2", "m", "b"), ("p1", "m", "c")], "paper string, type string, node string")
    assert [tuple(r) for r in graph.co_occurrence(rows, "m", "L").collect()] == [("a", "b", "L", 1)]


def test_upsert_prefers_old_values_and_new_ids(spark):
    old = spark.createDataFrame([("p", "t", "", "id1"), ("q", "t", "2001", "id2")], "path string, translation string, year string, paper_id string")
    new = spark.createDataFrame([("p", "t", "1999", "id3")], old.schema)
    got = {tuple(r) for r in library.upsert(old, new, ["path", "translation"], ["year"], ["paper_id"]).collect()}
    assert got == {("p", "t", "1999", "id3", 0), ("q", "t", "2001", "id2", 1)}


def test_dice_join_equals_all_pairs(spark):
    texts = ["a b c d", "a b c e", "x y", "x y z", "", "a b c d"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {(r.a, r.b) for r in similarity.dice_join(df, "k", "t", 0.7).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(i, j) for i in range(6) for j in range(i + 1, 6) if sets[i] and sets[j] and 2 * len(sets[i] & sets[j]) / (len(sets[i]) + len(sets[j])) > 0.7}
    assert got == want


def test_formats(spark):
    df = spark.createDataFrame([('[{"id":"a","pdfPath":"/x"},{"id":"b"}]',), ("oops",), (None,)], "value string")
    assert [(r.id, r.pdfPath, r.notes, r.lastPage) for r in formats.papers(df).collect()] == [("a", "/x", "", 1)]
    with pytest.raises(Exception, match="JSON"):
        formats.items(spark.createDataFrame([("{}",)], "value string")).collect()
    feed = '<feed><entry><id>http://x/abs/2401.1v2</id><title> A  B </title><published>2024-01-02</published><author><name>Ann</name></author><author><name>Bob</name></author><category term="cs.RO"/></entry></feed>'
    r = formats.atom_entries(spark.createDataFrame([(feed,)], "value string")).first()
    assert (r.title, r.authors, r.pdf, r.stable_id, r.year, r.primary) == ("A B", ["Ann", "Bob"], "http://x/pdf/2401.1v2", "2401.1", "2024", "cs.RO")


def _fold36(text, seed, step):
    h = seed
    for c in text:
        h = step(h, ord(c)) & 0xFFFFFFFF
    out = ""
    while h or not out:
        h, d = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out


def test_every_line_is_hashed_and_cleaned_at_full_length(spark):
    from paperloom.operators import lines as L

    long = "the same words stand at the start of these lines, far past the first eighty signs of them, "
    texts = {1: f"{long}one\nsecond & <line> sk-abcdefgh12345", 2: f"{long}two\n\nthird; fourth / fifth é漢", 3: None}
    rows = L.lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).cache()
    want = {(d, p): t for d, text in texts.items() for p, t in enumerate((text or "").split("\n"))}
    kinds = {(r.doc_id, r.pos): (r.kind, r.section) for r in L.sectioned(rows.withColumn("kind", L.T.line_type(L.F.col("t")))).collect()}
    got = {(r.doc_id, r.pos): (r.block_id, r.paper_id) for r in L.block_rows(rows).collect()}
    assert got == {k: ("pdf-1-" + _fold36("|".join(["1", *kinds[k], t]), 2166136261, lambda h, c: (h ^ c) * 16777619), "paper-" + _fold36(t, 0, lambda h, c: h * 31 + c)) for k, t in want.items()}
    assert got[1, 0] != got[2, 0]
    cleaned = {(r.doc_id, r.pos): (r.short, r.escaped, r.safe) for r in L.cleaned_rows(rows).collect()}
    assert cleaned == {k: (t[:59].rstrip(" ") + "…" if len(t) > 60 else t, t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;"), t.replace("sk-abcdefgh12345", "[REDACTED_API_KEY]")) for k, t in want.items()}
