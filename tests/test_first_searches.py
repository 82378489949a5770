"""Searches that decide for many patterns at once miss nothing, and slides read the documents once."""

import itertools
import re

from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import bullets, evidence, lines

HEADINGS = ["I. INTRODUCTION", "II. R ELATED W ORK", "I I. R ELATED", "Methods", "R e sults", "A. Subgoal images", "3.2 Vision models", "1 . Ideas", "X Vast plans of it", "V. In a room", "I am here", "In the end it was so", "introduction", "related  work", "REFERENCESs", "Related - work", "1- Foo bar", "\tMethods", "", "-", "É. Xyz abc", "IV Ωmega one two", "12: for", "Discussions\r", "B.\tOther things"]


def variants():
    """A text for every alternative of every term: optional parts left out, blanks and classes as one sign."""
    for entries in evidence.TERMS.values():
        for label, pattern in entries:
            for a in T.alternatives(pattern.removeprefix("(-i)")):
                plain = re.sub(r"\(\?: [^)]*\)\?|\(\?:[^)]*\)\?", "", a.replace(r"\b", "")).replace(r"[-\s]?", "-").replace(r"\s*", " ").replace(r"\.?", ".")
                plain = re.sub(r"\((\w+)[^)]*\)", r"\1", plain).replace("?", "").replace("[-\\s]", "-")
                yield label, plain


def test_one_search_finds_every_text_that_names_a_term(spark):
    every = [t for _, x in variants() for t in (x, f"é{x} so", f"({x})", f"a_{x}", x.upper())] + list(lines.SAMPLES) + ["nothing of it", "", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(every)], "i int, t string").select("i", F.col("t").rlike(evidence.may_name()).alias("may"), evidence.terms(F.col("t")).alias("x")).collect()
    named = 0
    for r in rows:
        text = every[r.i] or ""
        want = {c: [label for label, p in es if re.search(p.removeprefix("(-i)"), text, re.ASCII | (0 if p.startswith("(-i)") else re.I))][: evidence.MOST_TERMS] for c, es in evidence.TERMS.items()}
        assert r.x.asDict() == want, text
        named += any(want.values())
        assert r.may or not any(want.values())
    assert named > 250


def test_roles_and_headings_by_one_search(spark):
    words = [a.replace(r"\s+", "  ").replace("?", "") for p in [evidence.FORMULA_SECTION, *evidence.SECTIONS.values()] for a in T.alternatives(p.removeprefix("(?i)"))]
    texts = [*words, *[f"xx{w.upper()}yy" for w in words], "nothing at all", "priory"]
    df = spark.createDataFrame([(s, t) for s, t in itertools.product(("Page 1", "Methods"), texts)], "s string, t string")
    guard = f"WHEN 'p' = 'formula' THEN 'formula' WHEN NOT {evidence._has('(s || ' + chr(39) + ' ' + chr(39) + ' || t)', evidence.any_role(), False)} THEN NULL"
    role = evidence.role_of("s", "t", "'p'")
    assert guard in role  # one search comes before those for each role
    assert df.filter(~F.expr(role).eqNullSafe(F.expr(role.replace(guard, "")))).count() == 0
    t = F.col("t")
    plain = F.trim(t)
    long_way = F.when(plain.rlike(T.CAPTION), "caption").when(T.is_formula(plain), "formula").when(plain.rlike(T.CAPITALS) | T.is_section_heading(T.spaced_heading(plain)), "heading").otherwise("paragraph")
    got = spark.createDataFrame([(x,) for x in [*HEADINGS, *lines.SAMPLES]], "t string").select("t", T.line_type(t).alias("a"), long_way.alias("b")).collect()
    assert [r.t for r in got if r.a != r.b] == [] and sum(r.a == "heading" for r in got) > 9


def test_edges_before_words_are_one_look_back(spark):
    cases = [r"\b(we|our paper)\b", r"\bfoo(?: bar)?\b", r"\b(?:ab)?c\b", r"\bab?c\b", r"\b[A-Z]\s+[A-Z]|\b[IVX]+\.", r"x\b(a|é)\b", r"\b(19|20)\d{2}\b"]
    texts = ["we", "éwe", "awe", "our paper.", "foo bar", "xfoo", "foo", "abc c", "ac", "b C D", "IV. x", "xé", "x a", "1999", "a1999", "2020é", "_we"]
    for p in cases:
        got = spark.createDataFrame([(x,) for x in texts], "t string").select(F.col("t").rlike(T.ascii_edges(p)).alias("a"), F.col("t").rlike(p.replace(r"\b", T.EDGE)).alias("b")).collect()
        assert all(r.a == r.b for r in got), p
    assert T.ascii_edges(r"\b(we|our)") == T.EDGE_BEFORE + "(we|our)"


def test_references_of_all_slides_read_the_documents_once(spark, data):
    plan = bullets._refs(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    found = evidence.bucketed(evidence.blocks_of(spark, data)).select("doc_id", "bucket", "text", "page", "score", "pos")
    one = evidence.picked(found, bullets.SLIDES["results"], 3).select("doc_id", "place", "page", "text")
    every = bullets._refs(spark, data).filter("type = 'results'").select("doc_id", "place", "page", "text")
    assert one.exceptAll(every).count() == 0 and every.exceptAll(one).count() == 0
