"""Outlines of talks: written as Markdown, cut to a number of slides, and what they let a reader find.

Slides are rows of a plan (``decks.PLAN``).  Which slides stay is decided by the priority of
their types, and what stays keeps its order, as rows carry their place.  What a plan lets a
reader find is looked for in the texts of its method and formula slides, which are joined
once for each plan.

Defined cases: null texts and lists are empty; a plan without slides has no row; types
without a priority come last, equal ones by place; a plan without method slides lets a
reader find nothing; dates are written as they are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .decks import _KEYED, _PLANS, _WEAK, bullets_of, is_weak, plans

# Priorities of types, marks of the written outline, titles of slides by type, labels that say nothing, and what is looked for.
PRIORITY = ("cover", "info", "background", "method", "experiments", "results", "limitations", "summary", "innovation", "inspiration", "relatedWork", "formula")
CREATED, FIGURES, SOURCES, NOTES = "生成时间：", "图表候选：", "来源：", "备注："
TITLES = {
    "info": "论文基本信息", "background": "研究背景", "relatedWork": "现有方法不足", "method": "方法框架", "formula": "关键模块或公式", "experiments": "实验设置", "results": "主要实验结果", "innovation": "创新点总结", "limitations": "局限性与讨论", "inspiration": "对我课题的启发",
    "summary": "总结",
}
PLACEHOLDERS = ("论文信息", "研究对象", "论点", "方法线索", "汇报目标", "结构图对应原文模块链路", "策略围绕任务与动作闭环", "方法强调模型、控制和执行协同", "增强泛化能力", "面向复杂场景")
METHOD_WORDS = r"(?i)PILOT|RL|VLA|VLM|Unitree|MoE|Mixture[-\s]?of[-\s]?Experts|encoder|joint target|perceptive|感知|控制|策略|模型|动作|训练|controller|policy|model|action|objective"
FINDS = {
    "core_problem": r"(?i)problem|challenge|lack|瓶颈|困难|不足|unstructured|loco[-\s]?manipulation",
    "stage_inputs": r"(?i)input|observation|LiDAR|elevation map|proprioceptive|language instruction|视觉|感知|输入",
    "stage_outputs": r"(?i)output|action|control command|whole[-\s]?body|动作|控制输出|输出",
    "stage_connections": r"(?i)connect|condition|representation|→|->|驱动|连接|交给|闭环",
    "training": r"(?i)training|reinforcement learning|objective|loss|optimization|训练|目标|实现",
    "evaluation": r"(?i)experiment|evaluate|baseline|metric|success|tracking|stability|Unitree|实验|指标|对比|结果",
}
UNEXPLAINED = r"(?i)does not explain input, process, output"
LEAST_STEPS, LEAST_BULLETS, WEAK_SHARE = 4, 4, 0.5

FIGURE = "array<struct<caption:string,page:long,reason:string>>"
REF = "array<struct<page:long,section:string,text:string>>"


def _lines(items: Column, line) -> Column:
    return F.coalesce(F.transform(items, line), F.array().cast("array<string>"))


def slide_markdown(number: Column) -> Column:
    """A slide (title, subtitle, bullets, figures, refs, notes) as the lines of an outline."""
    some = lambda head, items: F.when(F.size(items) > 0, F.concat(F.array(*[F.lit(x) for x in head]), items)).otherwise(F.array().cast("array<string>"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    page = lambda x: F.coalesce(x["page"].cast("string"), F.lit(""))
    title = F.array(F.concat(F.lit("## "), number.cast("string"), F.lit(". "), text("title")))
    subtitle = F.when(text("subtitle") != "", F.array(F.lit(""), F.col("subtitle"))).otherwise(F.array().cast("array<string>"))
    bullets = some([""], _lines(F.col("bullets"), lambda b: F.concat(F.lit("- "), b)))
    figures = some(["", FIGURES], _lines(F.col("figures"), lambda f: F.concat(F.lit("- "), f["caption"], F.lit("（来源：p. "), page(f), F.lit("；用途："), f["reason"], F.lit("）"))))
    refs = some(["", SOURCES], _lines(F.col("refs"), lambda r: F.concat(F.lit("- p. "), page(r), F.lit(" · "), r["section"], F.lit("："), r["text"])))
    notes = F.when(text("notes") != "", F.array(F.lit(""), F.concat(F.lit(NOTES), F.col("notes")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(title, subtitle, bullets, figures, refs, notes, F.array(F.lit(""))), "\n")


def markdown(drafts: DataFrame, slides: DataFrame) -> DataFrame:
    """(plan, text): outlines as Markdown.

    ``drafts``: plan, title, subtitle, created; ``slides``: plan, slide, title, subtitle,
    bullets, figures (``FIGURE``), refs (``REF``), notes.
    """
    number = F.row_number().over(W.partitionBy("plan").orderBy("slide"))
    written = slides.withColumn("_n", number).select("plan", "_n", slide_markdown(F.col("_n")).alias("t")).groupBy("plan").agg(F.array_sort(F.collect_list(F.struct("_n", "t"))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["t"]), "\n")
    head = F.concat(F.lit("# "), F.coalesce("title", F.lit("")), F.lit("\n\n> "), F.coalesce("subtitle", F.lit("")), F.lit(f"\n\n{CREATED}"), F.coalesce("created", F.lit("")), F.lit("\n\n"))
    return drafts.join(written, "plan", "left").select("plan", F.concat(F.regexp_replace(F.concat(head, F.coalesce(body, F.lit(""))), r"\s+$", ""), F.lit("\n")).alias("text"))


def selected(slides: DataFrame, most: int) -> DataFrame:
    """The ``most`` slides of every plan whose types matter most; rows keep their places."""
    rank = F.array_position(F.array(*[F.lit(t) for t in PRIORITY]), F.coalesce("type", F.lit("")))
    order = W.partitionBy("plan").orderBy(F.when(rank == 0, len(PRIORITY) + 1).otherwise(rank), "slide")
    return slides.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= most).drop("_r")


def checks(slides: DataFrame) -> DataFrame:
    """Slides whose title isn't their type's, whose steps are placeholders, or that show no method though they are about it.

    ``slides`` may have steps, the labels of a diagram.
    """
    steps = F.coalesce("steps", F.array().cast("array<string>")) if "steps" in slides.columns else F.array().cast("array<string>")
    titles = F.create_map(*[F.lit(x) for kv in TITLES.items() for x in kv])
    evidence = F.concat_ws(" ", F.array_join(F.coalesce("bullets", F.array().cast("array<string>")), " "), F.array_join(steps, " "))
    found = {
        "title_of_other_type": F.col("type").isin(*TITLES) & (F.coalesce("title", F.lit("")) != titles[F.col("type")]),
        "placeholder_steps": F.arrays_overlap(steps, F.array(*[F.lit(x) for x in PLACEHOLDERS])),
        "method_without_evidence": (F.col("type") == "method") & ~evidence.rlike(METHOD_WORDS),
    }
    every = F.array(*[F.struct(F.lit(k).alias("issue"), F.coalesce(c, F.lit(False)).alias("bad")) for k, c in found.items()])
    return slides.select("plan", "slide", F.explode(every).alias("c")).filter("c.bad").select("plan", "slide", "c.issue")


def capabilities(slides: DataFrame) -> DataFrame:
    """One row per plan: what its method slides let a reader find, and what spoils it.

    ``slides`` may have steps and refs.  The stages are found if a method slide has four
    steps and inputs, outputs and connections are.
    """
    columns = slides.columns
    steps = F.coalesce("steps", F.array().cast("array<string>")) if "steps" in columns else F.array().cast("array<string>")
    refs = F.coalesce(F.transform("refs", lambda r: r["text"]), F.array().cast("array<string>")) if "refs" in columns else F.array().cast("array<string>")
    bullets = F.coalesce("bullets", F.array().cast("array<string>"))
    about = F.col("type").isin("method", "formula")
    text = F.when(about, F.array_join(F.concat(bullets, steps, refs), " "))
    plan_text = F.array_join(F.concat(bullets, steps), " ")
    # A plan is one talk: its method slides are one text.
    joined = slides.select("plan", "slide", text.alias("t"), plan_text.alias("p"), ((F.col("type") == "method") & (F.size(steps) >= LEAST_STEPS)).alias("staged")).groupBy("plan").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("slide", "t")))), lambda x: x["t"]), " ").alias("t"), F.bool_or("staged").alias("staged"), F.bool_or(F.col("p").rlike("|".join(PLACEHOLDERS))).alias("generic_template")
    )
    found = joined.select("plan", "generic_template", "staged", *[F.col("t").rlike(p).alias(k) for k, p in FINDS.items()], F.col("t").rlike(UNEXPLAINED).alias("unexplained"))
    linked = F.col("stage_inputs") & F.col("stage_outputs") & F.col("stage_connections")
    stages = F.col("staged") & linked & ~F.col("unexplained")
    explains = F.col("core_problem") & stages & F.col("training") & F.col("evaluation")
    rows = bullets_of(slides).filter("key <> ''")
    again = rows.groupBy("plan", "key").agg(F.count("*").alias("n")).groupBy("plan").agg((F.max("n") > 1).alias("again"))
    weak = rows.groupBy("plan").agg((F.count("*") >= LEAST_BULLETS).alias("many"), (F.count_if(is_weak(F.col("bullet"))) / F.count("*") > WEAK_SHARE).alias("weak"))
    repeats = F.coalesce(F.col("again") | (F.col("many") & F.col("weak")), F.lit(False))
    return found.join(again, "plan", "left").join(weak, "plan", "left").select("plan", explains.alias("explains_method"), *FINDS, stages.alias("method_stages"), repeats.alias("repeated_keywords"), "generic_template")


def _slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as plans with steps (the first words of bullets), figures and references."""
    p = plans(spark, sf_dir)
    word = lambda b: F.substring_index(b, " ", 1)
    figure = F.transform(F.slice("bullets", 2, 1), lambda b: F.struct(b.alias("caption"), F.col("slide").alias("page"), F.col("type").alias("reason")))
    ref = F.transform(F.slice("bullets", 1, 1), lambda b: F.struct(F.col("slide").alias("page"), F.col("title").alias("section"), b.alias("text")))
    return p.withColumns({"steps": F.transform("bullets", word), "subtitle": F.when(F.col("slide") % 2 == 1, F.col("type")), "figures": F.when(F.col("slide") % 3 == 1, figure), "refs": F.when(F.col("slide") % 2 == 0, ref)})


def outline_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every plan as Markdown."""
    s = _slides(spark, sf_dir)
    drafts = s.groupBy("plan").agg(F.count("*").alias("n")).select("plan", F.concat(F.lit("Talk "), F.col("plan").cast("string")).alias("title"), F.concat("n", F.lit(" slides")).alias("subtitle"), F.lit("2024-01-01").alias("created"))
    return markdown(drafts, s).select("plan", F.length("text").cast("long").alias("signs"), F.md5("text").alias("digest"))


def selected_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four slides of every plan that matter most."""
    return selected(plans(spark, sf_dir), 4).select("plan", "slide", "type")


def deck_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides of every plan that fail a check of their kind."""
    return checks(_slides(spark, sf_dir))


def deck_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every plan lets a reader find."""
    return capabilities(_slides(spark, sf_dir))


_RANK = "coalesce(list_position([" + ", ".join(f"'{t}'" for t in PRIORITY) + f"], type), {len(PRIORITY) + 1})"
_STEPS = "list_transform(bullets, lambda b: string_split(b, ' ')[1])"
_TITLE = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items()) + " END"
_BAD = {
    "title_of_other_type": f"coalesce(title, '') <> {_TITLE}",
    "placeholder_steps": f"list_has_any({_STEPS}, [" + ", ".join(f"'{x}'" for x in PLACEHOLDERS) + "])",
    "method_without_evidence": f"type = 'method' AND NOT regexp_matches(array_to_string(bullets, ' ') || ' ' || array_to_string({_STEPS}, ' '), '{METHOD_WORDS}')",
}
_NL = "chr(10)"
_SLIDE = f"""'## ' || (slide + 1) || '. ' || title || {_NL} || CASE WHEN slide % 2 = 1 THEN {_NL} || type || {_NL} ELSE '' END || CASE WHEN len(bullets) > 0 THEN {_NL} || array_to_string(list_transform(bullets, lambda b: '- ' || b), {_NL}) || {_NL} ELSE '' END
    || CASE WHEN slide % 3 = 1 AND len(bullets) > 1 THEN {_NL} || '{FIGURES}' || {_NL} || '- ' || bullets[2] || '（来源：p. ' || slide || '；用途：' || type || '）' || {_NL} ELSE '' END || CASE WHEN slide % 2 = 0 AND len(bullets) > 0 THEN {_NL} || '{SOURCES}' || {_NL} || '- p. ' || slide || ' · ' || title || '：' || bullets[1] || {_NL} ELSE '' END || CASE WHEN notes <> '' THEN {_NL} || '{NOTES}' || notes || {_NL} ELSE '' END"""
_TEXT = f"coalesce(string_agg(array_to_string(bullets, ' ') || CASE WHEN len(bullets) > 0 THEN ' ' || array_to_string({_STEPS}, ' ') ELSE '' END || CASE WHEN slide % 2 = 0 AND len(bullets) > 0 THEN ' ' || bullets[1] ELSE '' END, ' ' ORDER BY slide) FILTER (WHERE type IN ('method', 'formula')), '')"
QUERIES = {f.__name__: f for f in (outline_files, selected_slides, deck_checks, deck_capabilities)}
ORACLES = {
    "outline_files": f"WITH {_PLANS}, t AS (SELECT plan, '# Talk ' || plan || {_NL} || {_NL} || '> ' || count(*) || ' slides' || {_NL} || {_NL} || '{CREATED}2024-01-01' || {_NL} || {_NL} || string_agg({_SLIDE}, {_NL} ORDER BY slide) AS t FROM p GROUP BY plan), u AS (SELECT plan, regexp_replace(t, '\\s+$', '') || {_NL} AS t FROM t) SELECT plan, length(t)::BIGINT AS signs, md5(t) AS digest FROM u",
    "selected_slides": f"WITH {_PLANS} SELECT plan, slide, type FROM p QUALIFY row_number() OVER (PARTITION BY plan ORDER BY {_RANK}, slide) <= 4",
    "deck_checks": f"WITH {_PLANS} " + " UNION ALL ".join(f"SELECT plan, slide, '{k}' AS issue FROM p WHERE {c}" for k, c in _BAD.items()),
    "deck_capabilities": f"""WITH {_KEYED}, m AS (SELECT plan, {_TEXT} AS t, bool_or(type = 'method' AND len(bullets) >= {LEAST_STEPS}) AS staged, bool_or(regexp_matches(array_to_string(bullets, ' ') || ' ' || array_to_string({_STEPS}, ' '), '{"|".join(PLACEHOLDERS)}')) AS generic_template FROM p GROUP BY plan),
        k AS (SELECT plan, {", ".join(f"regexp_matches(t, '{p}') AS {k}" for k, p in FINDS.items())}, staged AND NOT regexp_matches(t, '{UNEXPLAINED}') AS ok, generic_template FROM m),
        a AS (SELECT plan, max(n) > 1 AS again FROM (SELECT plan, key, count(*) AS n FROM b WHERE key <> '' GROUP BY ALL) GROUP BY plan),
        w AS (SELECT plan, count(*) >= {LEAST_BULLETS} AND count(*) FILTER (WHERE {_WEAK}) / count(*) > {WEAK_SHARE} AS weak FROM b WHERE key <> '' GROUP BY plan),
        x AS (SELECT k.*, ok AND stage_inputs AND stage_outputs AND stage_connections AS method_stages, coalesce(again OR weak, false) AS repeated_keywords FROM k LEFT JOIN a USING (plan) LEFT JOIN w USING (plan))
        SELECT plan, core_problem AND method_stages AND training AND evaluation AS explains_method, {", ".join(FINDS)}, method_stages, repeated_keywords, generic_template FROM x""",
}
