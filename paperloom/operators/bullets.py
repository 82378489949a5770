"""Bullets of slides from the passages they rest on, and slides filled up to a least number of bullets.

A reference (slide, place, page, text) names terms; rules of the slide's type turn them into
sentences, each an entry of a table: a template and the terms of its places.  All that a
reference can say is worked out in its own row, so references run side by side; a slide
then goes through its few references in order: sentences made of the reference's own text
come in only while there are fewer than four, and in the end equal bullets, empty ones and
those that could stand in any paper go, and five stay.

Defined cases: null texts are empty and say nothing; a type without rules has its sentences
alone; a slide without references keeps its bullets; repeated references repeat nothing, as
equal bullets are one; lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored
from .evidence import FORMULA_SIGNS, blocks_of, bucketed, inline, once, picked_by_type, rules, short_bullets, terms

# Sentences by type of slide (template, and for each place its categories and how many terms it takes), and bounds.
RULES = {
    "method": (
        ("{} 面向 {} 做统一控制", (("methods", 1), ("tasks", 1))),
        ("输入侧使用 {} 感知状态", (("observations", 2),)),
        ("{} 连接任务意图与全身控制", (("commands", 2),)),
        ("输出侧服务 {}", (("outputs", 2),)),
        ("训练信号来自 {}", (("training", 2),)),
    ),
    "formula": (
        ("目标项约束 {}", (("constraints", 2),)),
        ("训练目标关联 {}", (("training", 2),)),
    ),
    "experiments": (
        ("{} 用于真机/平台验证", (("platforms", 2),)),
        ("任务覆盖 {}", (("tasks", 2),)),
        ("对比对象包含 {}", (("baselines", 2),)),
        ("指标关注 {}", (("metrics", 3),)),
        ("验证覆盖 {} 场景", (("training", 2),)),
    ),
    "background": (
        ("问题场景是 {}", (("platforms tasks", 2),)),
        ("难点来自 {} 与环境状态", (("observations", 2),)),
        ("现有方法仍受 {} 约束", (("metrics", 2),)),
    ),
    "innovation": (
        ("{} 的差异点在 {}", (("methods", 1), ("observations", 2))),
        ("{} 是可验证贡献", (("commands", 2),)),
        ("贡献用 {} 支撑", (("metrics", 2),)),
    ),
    "limitations": (("边界需关注 {}", (("observations platforms metrics", 2),)),),
    "inspiration": (
        ("可复用 {} 作为 baseline", (("methods", 2),)),
        ("评价可借鉴 {}", (("metrics", 2),)),
        ("课题迁移到 {}", (("tasks", 2),)),
    ),
    "summary": (
        ("{} 的核心价值在 {}", (("methods", 1), ("tasks", 1))),
        ("是否复现看 {}", (("metrics", 2),)),
    ),
}
SAME = {"results": "experiments", "relatedWork": "background"}
#: The sentence that asks for one of these terms besides its own.
NEEDS = {"验证覆盖 {} 场景": ("training", ("simulation", "real-world data"))}
FORMULA, FORMULA_PROOF, FORMULA_GOAL = "核心公式：", "公式证据：", "公式/目标："
#: What a sentence of the text becomes: the first pattern in it, the terms named instead and how many, and what is said without any.
REWRITES = (
    (r"\bchallenge|lack|difficult|insufficient|unresolved|complex|unstructured\b", "核心瓶颈是 ", "platforms tasks observations", 2, "原文指出 ", 46),
    (r"\bpropose|present|introduce|incorporate|use|combine\b", "方法具体包含 ", "methods observations commands outputs", 3, "方法证据：", 44),
    (r"\bevaluate|experiment|validate|compare|result|baseline|metric\b", "实验验证 ", "platforms baselines metrics", 3, "实验信息：", 44),
)
FOREIGN = (0.55, "原文证据指向 ", "methods tasks metrics", 2, "原文要点：", 42)
GENERIC = ("框架串联感知、策略、执行", "任务指令转成机器人策略", "方法强调模型、控制和执行协同", "论文信息|研究对象|论点|方法线索|汇报目标", "增强泛化能力")
PAGE = r"（p\.\s*\d+）"
FORMULA_LENGTH, SENTENCE_LENGTH, BULLET_LENGTH, RAW_LENGTH = 92, 112, 150, 92
ENOUGH, MOST, LEAST, LEAST_IN_SUMMARY = 4, 5, 3, 2
TEXTS = "array<string>"


def _short(text: Column, n: int) -> Column:
    return T.let(T.collapse(text), lambda x: T.truncated(x, n))


def _paged(text: Column) -> Column:
    return F.concat(_short(text, SENTENCE_LENGTH), F.lit("（p. "), F.col("page").cast("string"), F.lit("）"))


def _named(categories: str, most: int) -> Column:
    """The first distinct terms of some categories, joined; null for none."""
    lists = [F.col(f"x.{c}") for c in categories.split()]
    every = F.concat(*lists)
    keys = F.transform(every, F.lower)
    first = F.slice(F.filter(every, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1), 1, most)
    return F.when(F.size(every) > 0, F.array_join(first, "、"))


def _first_two(categories: str) -> Column:
    """The first two terms of some categories, equal ones once."""
    two = F.slice(F.concat(*[F.col(f"x.{c}") for c in categories.split()]), 1, 2)
    one = F.lower(F.try_element_at(two, F.lit(1))) == F.lower(F.try_element_at(two, F.lit(2)))
    return F.when(F.size(two) > 0, F.array_join(F.when(F.coalesce(one, F.lit(False)), F.slice(two, 1, 1)).otherwise(two), "、"))


def _sentence(template: str, places: tuple) -> Column:
    parts, texts = [F.lit(template.split("{}")[0])], template.split("{}")[1:]
    for (categories, most), after in zip(places, texts, strict=True):
        # A slide of limitations takes two terms before it looks for equal ones.
        parts += [_first_two(categories) if categories == "observations platforms metrics" else _named(categories, most), F.lit(after)]
    made = F.concat(*parts)  # null if a place has no term
    if template in NEEDS:
        category, any_of = NEEDS[template]
        made = F.when(F.arrays_overlap(F.col(f"x.{category}"), F.array(*[F.lit(t) for t in any_of])), made)
    return _paged(made)


def _formulas(label: str) -> Column:
    return F.transform(F.slice("formulas", 1, 2), lambda f: _paged(F.concat(F.lit(label), f)))


def _by_rules() -> Column:
    """What the rules of the slide's type say of a reference."""
    said = F.when(F.lit(False), F.array().cast(TEXTS))
    for kind, entries in RULES.items():
        kinds = [kind, *[k for k, v in SAME.items() if v == kind]]
        made = F.filter(F.array(*[_sentence(*e) for e in entries]), lambda s: s.isNotNull())
        said = said.when(F.col("type").isin(*kinds), F.concat(_formulas(FORMULA), made) if kind == "formula" else made)
    said = said.otherwise(F.array().cast(TEXTS))
    return F.when(F.col("type") == "formula", F.concat(said, _formulas(FORMULA_PROOF))).otherwise(said)


def _rewritten(sentence: Column) -> Column:
    """A sentence of the text as a bullet."""

    def said(label: str, categories: str, most: int, plain: str, n: int) -> Column:
        return F.coalesce(F.concat(F.lit(label), _named(categories, most)), F.concat(F.lit(plain), _short(sentence, n)))

    found = F.when((F.col("type") == "formula") & (F.size("formulas") > 0), F.concat(F.lit(FORMULA_GOAL), F.element_at("formulas", 1)))
    for pattern, *rest in REWRITES:
        found = found.when(F.lower(sentence).rlike(T.ascii_edges(pattern)), said(*rest))
    found = found.when(T.ratio(sentence, "[A-Za-z]") > FOREIGN[0], said(*FOREIGN[1:])).otherwise(sentence)
    return _paged(found)


def said_by(refs: DataFrame) -> DataFrame:
    """``refs`` (slide columns, type, place, page, text) with what each says: by_rules, sentences, raw."""
    clean = refs.withColumn("text", F.coalesce("text", F.lit("")))
    read = clean.withColumns({"x": terms(F.col("text")), "points": short_bullets(F.col("text"))})
    formulas = F.slice(F.transform(F.filter("points", lambda p: p.rlike(FORMULA_SIGNS)), lambda p: _short(p, FORMULA_LENGTH)), 1, 3)
    useful = F.expr(f"filter(points, p -> {once(inline('p', 300, False), lambda v: rules(v)['bullet'], 'b')})")
    or_formula = F.expr(f"filter(points, p -> {once(inline('p', 300, False), lambda v: '(' + rules(v)['bullet'] + ' OR ' + rules(v)['formula_text'] + ')', 'b')})")
    usable = F.when(F.col("type") == "formula", or_formula).otherwise(useful)
    read = read.withColumns({"formulas": formulas, "usable": usable})
    none = F.array().cast(TEXTS)
    silent = ~F.col("type").isin("info", "formula") & (F.size("formulas") > 0)
    read = read.withColumns({"by_rules": _by_rules(), "sentences": F.when(silent, none).otherwise(F.transform("usable", _rewritten)), "raw": F.transform("usable", lambda p: _paged(_short(p, RAW_LENGTH)))})
    return read.drop("x", "points", "formulas", "usable")


def compact(items: Column, most: int = MOST) -> Column:
    """The first ``most`` bullets that say something: without equal ones (pages and case aside) and phrases of any paper."""

    def kept(good: Column) -> Column:
        keys = F.transform(good, lambda b: F.lower(F.regexp_replace(b, PAGE, "")))
        return T.let(keys, lambda ks: F.slice(F.filter(good, lambda b, i: F.array_position(ks, F.get(ks, i)) == i + 1), 1, most))

    generic = lambda b: F.exists(F.array(*[b.rlike(p) for p in GENERIC]), lambda x: x)
    return T.let(F.filter(F.transform(items, lambda b: _short(b, BULLET_LENGTH)), lambda b: (b != "") & ~generic(b)), kept)


def slide_bullets(refs: DataFrame, by: list[str]) -> DataFrame:
    """(``by``, type, bullets, sentences, raw): the bullets of slides from their references in order of place.

    A slide rests on a few chosen references, so they are one row.
    """
    parts = said_by(refs).groupBy(*by, "type").agg(F.array_sort(F.collect_list(F.struct("place", "by_rules", "sentences", "raw"))).alias("refs"))

    def step(done: Column, ref: Column) -> Column:
        return T.let(F.concat(done, ref["by_rules"]), lambda d: F.when(F.size(d) < ENOUGH, F.concat(d, ref["sentences"])).otherwise(d))

    every = F.aggregate("refs", F.array().cast(TEXTS), step)
    return parts.select(*by, "type", compact(every).alias("bullets"), F.flatten(F.transform("refs", lambda r: r["sentences"])).alias("sentences"), F.flatten(F.transform("refs", lambda r: r["raw"])).alias("raw"))


def filled(slides: DataFrame, refs: DataFrame, by: list[str]) -> DataFrame:
    """``slides`` (``by``, type, bullets), those with too few bullets filled from their references.

    Covers and information slides stay, as does a slide without references.
    """
    made = slide_bullets(refs, by).withColumnRenamed("bullets", "_made")
    least = F.when(F.col("type") == "summary", LEAST_IN_SUMMARY).otherwise(LEAST)
    poor = ~F.col("type").isin("cover", "info") & F.col("_made").isNotNull() & (F.size("bullets") < least)
    more = F.filter(F.transform(compact(F.concat("bullets", "_made", "sentences", "raw")), F.trim), lambda b: b != "")
    return slides.join(made, [*by, "type"], "left").withColumn("bullets", F.when(poor, more).otherwise(F.col("bullets"))).select(*slides.columns)


#: Slides that documents have, and the buckets of evidence they rest on.
SLIDES = {"background": ["introduction", "abstract"], "relatedWork": ["related_work", "introduction"], "method": ["method", "abstract"], "formula": ["formula", "method"], "experiments": ["experiments", "results"], "results": ["results", "experiments"], "limitations": ["limitations", "conclusion"], "summary": ["conclusion", "abstract"]}


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best references of each slide of every document."""
    found = bucketed(blocks_of(spark, sf_dir)).select("doc_id", "bucket", "text", "page", "score", "pos")
    return picked_by_type(found, SLIDES, 3).select("doc_id", "type", "place", "page", "text")


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "type", F.size("bullets").cast("long").alias("n"), F.md5(F.array_join("bullets", "\n")).alias("digest"))


def evidence_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets of every slide of documents."""
    return _shown(slide_bullets(_refs(spark, sf_dir), ["doc_id"]))


def filled_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides that have one bullet each, filled from their references."""
    refs = stored(_refs(spark, sf_dir), "refs")  # read for the slides and for their bullets
    slides = refs.select("doc_id", "type").distinct().withColumn("bullets", F.array(F.concat(F.lit("Slide of "), "type")))
    return _shown(filled(slides, refs, ["doc_id"]))


QUERIES = {f.__name__: f for f in (evidence_bullets, filled_slides)}
#: The rules of many patterns and a fold over references: tests hold them against a plain version.
ORACLES: dict[str, str] = {}
