"""Mathematical segments against a plain scan, and loose formulas."""

import random
import re

from pyspark.sql import functions as F

from paperloom.functions import math as M

CASES = ["", None, "plain", "a $x$ b", "$$x$$", "a \\(y\\) \\[z\\] b", "$x", "a $$ b", "$$$", "$$$$", "$ $ and $y$", "\\[ \\] x", "a \\ b \\x", "$a$$b$", "$$a$b$$", "\\(a$b\\)c$", "x $$a$$$b$ \\[c", "two\nlines $x\ny$ end"]


def scan(text):
    out, at = [], 0
    text = text or ""
    while at < len(text):
        found = [(text.index(o, at), -len(o), o, c, d) for o, c, d in M.DELIMITERS if o in text[at:]]
        if not found:
            out.append(("text", text[at:], None))
            break
        start, _, opener, closer, display = min(found)
        if start > at:
            out.append(("text", text[at:start], None))
        end = text.find(closer, start + len(opener))
        if end < 0:
            out.append(("text", text[start:], None))
            break
        inner = text[start + len(opener) : end].strip()
        out.append(("math", inner, display) if inner else ("text", text[start : end + len(closer)], None))
        at = end + len(closer)
    return out


def joined(segments):
    """Neighbouring plain segments as one, as the order of tokens alone decides where they part."""
    out = []
    for kind, value, display in segments:
        if out and kind == "text" == out[-1][0]:
            out[-1] = ("text", out[-1][1] + value, None)
        else:
            out.append((kind, value, display))
    return out


def test_segments(spark):
    rng = random.Random(3)
    texts = CASES + ["".join(rng.choices(["$", "$$", "\\[", "\\]", "\\(", "\\)", "\\", "x", " ", "é", "\n"], k=rng.randint(1, 30))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", M.segments(F.col("t")).alias("s")).collect()
    for r in rows:
        assert joined(map(tuple, r.s)) == joined(scan(texts[r.i])), texts[r.i]
        assert len(r.s) >= len(joined(scan(texts[r.i])))
    assert [tuple(x) for x in rows[3].s] == [("text", "a ", None), ("math", "x", False), ("text", " b", None)]


def test_long_text(spark):
    text = "word \\ " * 60_000 + "$x$" + "y" * 300_000
    (n,) = spark.createDataFrame([(text,)], "t string").select(F.size(M.segments(F.col("t")))).collect()[0]
    assert n == 3


def test_loose_formulas(spark):
    lines = {"x_t = f(x, u) + e": ("", "x_t = f(x, u) + e"), "12: a_1 ≤ π": ("12:", "a_1 \\le  \\pi"), "for x_1 = y_2": None, "<b>x_1 = 2</b>": None, "Plain words only here": None, "": None, None: None, "(3) not = numbered_like": ("", "(3) not = numbered_like"), "many words here that make this line long a_b = cde": None}
    got = spark.createDataFrame([(i, k) for i, k in enumerate(lines)], "i int, t string").select("i", M.loose_formula(F.col("t")).alias("f")).collect()
    for r in got:
        want = list(lines.values())[r.i]
        assert (None if r.f is None else (r.f.prefix, re.sub(r"\s+$", "", r.f.formula))) == want, list(lines)[r.i]
