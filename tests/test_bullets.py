"""Bullets of slides, plan by plan against a plain version of the rules."""

import re

from pyspark.sql import functions as F

from paperloom.operators import bullets as b
from paperloom.operators import evidence as e

TEXTS = [
    "We propose PILOT, a world model that maps RGB images and a language instruction to whole-body actions of a humanoid robot.",
    "The success rate and the collision rate of PPO, SAC and MPC are measured in simulation, and the tracking error falls while the planner uses an elevation map, because the policy network was trained by imitation learning on demonstrations.",
    "It is a challenge to move in unstructured environments because sensors lack range. A second sentence follows here with several more words in it.",
    "The loss is L = a + b_1. The objective function holds the safety cost of every step in the plan.",
    "Nothing that has a term stands in this long enough sentence about the weather and the sea in winter.",
    "论文在无人机上做了很多实验说明方法有效 并且比较了不同的算法 和 数据 的 结果 以及 它们 的 差别 。",
    "too short", "", None,
    "Existing baselines need real-world data, and the method improves generalization; it was compared with blind baseline controllers on a quadruped robot for object transport.",
]


def search(pattern, text):
    return re.search(pattern, text, re.ASCII) is not None


def short(text, n):
    text = re.sub(r"\s+", " ", text).strip()
    return text if len(text) <= n else text[: n - 1].strip() + "…"


def terms(text):
    named = lambda p: search(p.removeprefix("(-i)"), text) if p.startswith("(-i)") else search("(?i)" + p, text)
    return {c: [label for label, p in entries if named(p)][: e.MOST_TERMS] for c, entries in e.TERMS.items()}


def joined(x, categories, most):
    out = []
    for t in (t for c in categories.split() for t in x[c]):
        if t.lower() not in [o.lower() for o in out]:
            out.append(t)
    return "、".join(out[:most])


def paged(text, page):
    return f"{short(text, 112)}（p. {page}）"


def by_rules(kind, x, formulas, page):
    out = [paged(b.FORMULA + f, page) for f in formulas[:2]] if kind == "formula" else []
    for template, places in b.RULES.get(b.SAME.get(kind, kind), ()):
        if template in b.NEEDS and not set(x["training"]) & set(b.NEEDS[template][1]):
            continue
        if kind == "limitations":
            two = [t for c in ("observations", "platforms", "metrics") for t in x[c]][:2]
            words = [joined({"t": two}, "t", 2)]
        else:
            words = [joined(x, c, n) for c, n in places]
        if all(words):
            out.append(paged(template.format(*words), page))
    return out + ([paged(b.FORMULA_PROOF + f, page) for f in formulas[:2]] if kind == "formula" else [])


def rewritten(kind, s, x, formulas, page):
    if kind == "formula" and formulas:
        return paged(b.FORMULA_GOAL + formulas[0], page)
    cases = [(search(p, s.lower()), *rest) for p, *rest in b.REWRITES] + [(len(re.findall("[A-Za-z]", s)) / len(s) > b.FOREIGN[0], *b.FOREIGN[1:])]
    for hit, label, categories, most, plain, n in cases:
        if hit:
            words = joined(x, categories, most)
            return paged(label + words if words else plain + short(s, n), page)
    return paged(s, page)


def compact(items):
    out, keys = [], set()
    for i in items:
        i = short(i, 150)
        key = re.sub(b.PAGE, "", i, count=1).lower()
        if i and not any(re.search(g, i) for g in b.GENERIC) and key not in keys:
            keys.add(key)
            out.append(i)
    return out[:5]


def slide(kind, refs):
    """refs: page, text, points, usable points."""
    every, sentences, raw = [], [], []
    for page, text, points, usable in refs:
        x, formulas = terms(text), [short(p, 92) for p in points if re.search(e.FORMULA_SIGNS, p)][:3]
        own = [] if kind not in ("info", "formula") and formulas else [rewritten(kind, s, x, formulas, page) for s in usable]
        every += by_rules(kind, x, formulas, page)
        if len(every) < 4:
            every += own
        sentences += own
        raw += [paged(short(p, 92), page) for p in usable]
    return compact(every), sentences, raw


def expected(spark, rows):
    """The plain version over rows (doc_id, type, place, page, text); points and detectors have tests of their own."""
    frame = spark.createDataFrame([(i, r[4] or "") for i, r in enumerate(rows)], "i int, text string").withColumn("points", e.short_bullets(F.col("text")))
    split = {r.i: r.points for r in frame.collect()}
    points = spark.createDataFrame([(i, j, p) for i, ps in split.items() for j, p in enumerate(ps)], "i int, j int, t string").selectExpr("i", "j", "t", f"{e.rules('t')['bullet']} AS good", f"{e.rules('t')['formula_text']} AS formula")
    good = {(r.i, r.j): (r.good, r.formula) for r in points.collect()}
    slides = {}
    for i, (doc, kind, place, page, text) in enumerate(rows):
        usable = [p for j, p in enumerate(split[i]) if good[i, j][0] or (kind == "formula" and good[i, j][1])]
        slides.setdefault((doc, kind), []).append((place, page, text or "", split[i], usable))
    return {k: slide(k[1], [r[1:] for r in sorted(v, key=lambda r: r[0])]) for k, v in slides.items()}


REFS = "doc_id long, type string, place long, page long, text string"
KINDS = [*b.RULES, *b.SAME, "info", "cover", "other"]


def test_every_type_against_the_rules(spark):
    rows = [(d, kind, p, p + 1, TEXTS[(d * 3 + p) % len(TEXTS)]) for d in range(len(TEXTS)) for kind in KINDS for p in range(3)]
    rows += [(99, kind, p, 7, t) for kind in KINDS for p, t in enumerate(TEXTS)]
    got = {(r.doc_id, r.type): (r.bullets, r.sentences, r.raw) for r in b.slide_bullets(spark.createDataFrame(rows, REFS).repartition(4), ["doc_id"]).collect()}
    want = expected(spark, rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == want[k], k
    assert sum(len(x[0]) for x in want.values()) > 150


def test_slides_are_filled_only_where_they_have_too_little(spark):
    rows = [(1, "method", 0, 3, TEXTS[0]), (1, "summary", 0, 3, TEXTS[1]), (1, "cover", 0, 1, TEXTS[0])]
    slides = [(1, "method", ["one"]), (1, "summary", ["one", "two"]), (1, "cover", []), (2, "method", ["alone"]), (1, "results", [])]
    got = {(r.doc_id, r.type): r.bullets for r in b.filled(spark.createDataFrame(slides, "doc_id long, type string, bullets array<string>"), spark.createDataFrame(rows, REFS), ["doc_id"]).collect()}
    made, sentences, raw = expected(spark, rows)[1, "method"]
    assert got == {(1, "method"): compact(["one", *made, *sentences, *raw]), (1, "summary"): ["one", "two"], (1, "cover"): [], (2, "method"): ["alone"], (1, "results"): []}


def test_documents_against_the_rules(spark, data):
    refs = b._refs(spark, data)
    rows = [tuple(r) for r in refs.select("doc_id", "type", "place", "page", "text").collect()]
    got = {(r.doc_id, r.type): r.bullets for r in b.slide_bullets(refs, ["doc_id"]).collect()}
    assert got == {k: v[0] for k, v in expected(spark, rows).items()} and len(got) > 50
