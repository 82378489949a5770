"""Slide plans: checks of bullets and slides, duplicates, patches, and what they rest on.

A plan is rows plan, slide (0, 1...), type, title, bullets (array), footer, notes.  Each
check is a predicate over a slide; bullets repeat within a plan by their key, which is one
shuffle by (plan, key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table

# Patterns and bounds of the checks are given by the results to match.
LEAST_SLIDES, MOST_BULLETS, MOST_SIGNS, ASCII_SHARE, WEAK_SHARE, WEAK_WORDS, LEAST_NATIVE, LEAST_CATEGORIES = 8, 5, 30, 0.7, 0.5, 6, 2, 2
PAGE_MARKS = r"(?i)（p\.\s*\d+）|\(p\.\s*\d+\)"
PUNCTUATION = r"[，。；;:：,.!?！？、\s]+"
NATIVE = r"[\x{4e00}-\x{9fff}]"
EXPLAINS = (
    "是|来自|检查|需要|要求|缺少|破坏|依赖|仍有|难以|补足|接入|解决|输入|输出|连接|驱动|训练|验证|比较|提升|降低|说明|产生|用于|作为|映射|约束|完成|执行|支撑|关注|覆盖|检验|调节|描述|面向|聚焦|包含|体现|衡量|融合|协调"
    "|evaluate|compare|output|input|train|connect|improve|reduce"
)
TEMPLATE = r"^本页[^：:?]{0,36}[：:?]"
RESULTS_IN_BACKGROUND = r"(?i)result|experiment|real[-\s]?world|真机|实验|结果"
CATEGORIES = (r"(?i)baseline|benchmark|comparison|对比|本文方法", r"(?i)metric|success|tracking|stability|rate|指标|成功率|稳定性", r"(?i)result|performance|ablation|generalization|robustness|结果|性能|消融|泛化|鲁棒")
CHAIN = (
    r"(?i)input|observation|LiDAR|elevation map|proprioceptive|perceptive|terrain[-\s]?aware|task command|language instruction|视觉|感知|输入",
    r"(?i)policy|controller|model|encoder|Mixture[-\s]?of[-\s]?Experts|MoE|VLA|VLM|RL|condition|representation|process|策略|模型|控制器|训练|表示",
    r"(?i)output|action|command|control|joint target|whole[-\s]?body|动作|命令|输出",
    r"(?i)connect|condition|representation|→|->|驱动|连接|交给|闭环",
)
#: Topics of bullets, the first that is named.
TOPICS = (
    ("pi0.7", r"(?i)π0\.?7|pi0\.?7"), ("language-instruction", r"(?i)\blanguage (instruction|instructions|command|commands|goal|goals)\b"), ("subgoal-images", r"\bsubgoal images?\b|子目标"), ("episode-metadata", r"\bepisode metadata\b|元数据"),
    ("context-conditioning", r"\bcontext conditioning\b|上下文"), ("long-horizon", r"\blong[-\s]?horizon\b|长程"), ("vla-vlm", r"(?i)\bVLA\b|\bVLM\b|vision[-\s]?language[-\s]?action"), ("lidar-elevation", r"(?i)\bLiDAR\b|elevation map|地形图"),
    ("hybrid-command", r"\bhybrid internal command\b|混合内部"), ("whole-body-action", r"\bwhole[-\s]?body actions?\b|全身动作"), ("unitree-g1", r"(?i)\bUnitree\s*G1\b"), ("baseline-comparison", r"\bbaseline|benchmark|comparison\b|基线|对比"),
    ("metrics", r"\btracking|stability|success rate|metric|rate\b|指标|稳定"), ("rl-training", r"\breinforcement learning\b|\bRL\b|训练"), ("terrain-scene", r"\bterrain|unstructured|scene|environment\b|非结构|地形"),
)
PLAN = "plan long, slide long, type string, title string, bullets array<string>, footer string, notes string"


def bullet_key(text: Column) -> Column:
    """A bullet without its page, punctuation and case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(T.collapse(text), PAGE_MARKS, ""), PUNCTUATION, " ")))


def topic(text: Column) -> Column:
    """The first topic that a bullet names, '' for none."""

    def first(key: Column) -> Column:
        found = None
        for name, pattern in TOPICS:
            hit = key.rlike(T.ascii_edges(pattern))
            found = F.when(hit, name) if found is None else found.when(hit, name)
        return found.otherwise("")

    return T.let(bullet_key(text), first)


def is_weak(text: Column) -> Column:
    """A bullet of a few terms that explains nothing."""
    return T.let(bullet_key(text), lambda k: (k != "") & (T.count(k, r"[A-Za-z0-9π.-]+|[\x{4e00}-\x{9fff}]{2,}") <= WEAK_WORDS) & ~k.rlike(f"(?i){EXPLAINS}"))


def ascii_share(text: Column) -> Column:
    return F.when(F.length(text) > 0, T.count(text, "[A-Za-z]") / F.length(text)).otherwise(0.0)


def evidence_text() -> Column:
    return F.concat_ws(" ", F.col("title"), F.array_join("bullets", " "), F.col("footer"))


def categories(text: Column) -> Column:
    """How many kinds of experimental evidence a text names."""
    return sum((text.rlike(p).cast("int") for p in CATEGORIES[1:]), text.rlike(CATEGORIES[0]).cast("int"))


def slide_checks() -> dict[str, Column]:
    """Checks of one slide, by name: true where it fails."""
    body = ~F.col("type").isin("cover", "info")
    every = F.col("type") != "cover"
    count = lambda f: F.size(F.filter("bullets", f))
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    n = F.size("bullets")
    return {
        "no_title": blank("title"),
        "no_page_source": every & ~F.contains(F.coalesce("footer", F.lit("")), F.lit("p.")),
        "results_in_background": (F.col("type") == "background") & F.coalesce("footer", F.lit("")).rlike(RESULTS_IN_BACKGROUND),
        "no_notes": blank("notes"),
        "weak_bullets": body & (n > 0) & (count(is_weak) > n * WEAK_SHARE),
        "method_without_chain": (F.col("type") == "method") & ~F.forall(F.array(*[evidence_text().rlike(p) for p in CHAIN]), lambda x: x),
        "few_categories": F.col("type").isin("experiments", "results") & (categories(evidence_text()) < LEAST_CATEGORIES),
        "few_native_bullets": body & (count(lambda b: b.rlike(NATIVE)) < LEAST_NATIVE),
        "many_bullets": n > MOST_BULLETS,
        "long_bullet": count(lambda b: F.length(b) > MOST_SIGNS) > 0,
        "foreign_bullet": count(lambda b: ascii_share(b) >= ASCII_SHARE) > 0,
        "template_prefix": count(lambda b: T.collapse(b).rlike(TEMPLATE)) > 0,
    }


def bullets_of(plan: DataFrame) -> DataFrame:
    return plan.select("plan", "slide", F.posexplode("bullets").alias("pos", "bullet")).withColumns({"key": bullet_key(F.col("bullet")), "topic": topic(F.col("bullet"))})


def issues(plan: DataFrame) -> DataFrame:
    """(plan, slide, issue, n): what fails of every plan; slide is null for the plan's own."""
    checks = F.array(*[F.struct(F.lit(k).alias("issue"), c.alias("bad")) for k, c in slide_checks().items()])
    slides = plan.select("plan", "slide", F.explode(checks).alias("c")).filter("c.bad").select("plan", "slide", "c.issue", F.lit(1).cast("long").alias("n"))
    none = F.lit(None).cast("long").alias("slide")
    few = plan.groupBy("plan").agg(F.count("*").alias("n")).filter(F.col("n") < LEAST_SLIDES).select("plan", none, F.lit("few_slides").alias("issue"), "n")
    rows = bullets_of(plan)
    again = rows.filter("key <> ''").groupBy("plan", "key").agg(F.count("*").alias("n")).filter("n > 1").groupBy("plan").agg(F.count("*").alias("n")).select("plan", none, F.lit("repeated_bullets").alias("issue"), "n")
    alike = rows.filter("topic <> ''").groupBy("plan", "slide", "topic").agg(F.count("*").alias("n")).filter("n > 1").groupBy("plan", "slide").agg(F.count("*").alias("n")).select("plan", "slide", F.lit("repeated_topics").alias("issue"), "n")
    return slides.unionByName(few).unionByName(again).unionByName(alike)


def unique_bullets(plan: DataFrame) -> DataFrame:
    """Bullets of a plan whose key no earlier bullet has: a minimum by key, combined before its shuffle."""
    rows = bullets_of(plan).filter("key <> ''")
    return rows.groupBy("plan", "key").agg(F.min(F.struct("slide", "pos", "bullet")).alias("f")).select("plan", "f.*")


def similar_bullets_flag(plan: DataFrame, least: float = 0.82) -> DataFrame:
    """Slides with a bullet that two others of the slide resemble."""

    def alike(words: Column) -> Column:
        a = F.transform(words, F.array_distinct)
        dice = lambda x, y: F.size(F.array_intersect(x, y)) * 2 > (F.size(x) + F.size(y)) * least
        near = lambda x, i: F.size(F.filter(a, lambda y, j: (i != j) & (F.size(x) > 0) & dice(x, y)))
        return F.exists(F.transform(a, near), lambda n: n >= 2)

    words = F.transform("bullets", lambda b: F.filter(F.split(bullet_key(b), " "), lambda w: w != ""))
    return plan.filter(alike(words)).select("plan", "slide")


def report(plan: DataFrame) -> DataFrame:
    """One row per plan: its issues, whether it has what a talk needs, and whether it passes."""
    found = issues(plan).groupBy("plan").agg(F.sum("n").alias("issues"), F.bool_or(F.col("issue") == "repeated_bullets").alias("repeats"), F.bool_or(F.col("issue").isin("weak_bullets", "template_prefix")).alias("generic"))
    able = plan.groupBy("plan").agg(F.count("*").alias("slides"), F.bool_or(F.col("type") == "method").alias("has_method"), F.bool_or(F.col("type").isin("experiments", "results")).alias("has_results"))
    joined = able.join(found, "plan", "left").fillna({"issues": 0, "repeats": False, "generic": False})
    return joined.withColumn("passed", (F.col("issues") == 0) & F.col("has_method") & F.col("has_results") & ~F.col("repeats") & ~F.col("generic"))


def patched(plan: DataFrame, patches: DataFrame) -> DataFrame:
    """``plan`` with the bullets and notes of ``patches`` (plan, slide, pos, bullets, notes): the last of a slide counts, others stay."""
    last = patches.groupBy("plan", "slide").agg(F.max_by(F.struct(F.col("bullets").alias("b"), F.col("notes").alias("n")), "pos").alias("p"))
    return plan.join(last, ["plan", "slide"], "left").withColumns({"bullets": F.coalesce("p.b", "bullets"), "notes": F.coalesce("p.n", "notes")}).drop("p")


def scoped(refs: DataFrame, allow: str, deny: str) -> DataFrame:
    """References (plan, slide, section, text) in scope; all of a slide's where none is."""
    both = F.concat_ws(" ", "section", "text")
    slide = W.partitionBy("plan", "slide")
    good = both.rlike(allow) & ~both.rlike(deny)
    return refs.withColumn("_good", good).withColumn("_any", F.max("_good").over(slide)).filter("_good OR NOT _any").drop("_good", "_any")


def plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as plans: a turn is a slide, its sentences bullets."""
    c = table(spark, sf_dir, "conversations")
    kinds = F.array(*[F.lit(x) for x in ("cover", "background", "method", "experiments", "results", "summary")])
    bullets = T.sentences(F.coalesce("text", F.lit("")))
    return c.select(
        F.col("conv_id").alias("plan"), F.col("turn").alias("slide"), F.element_at(kinds, (F.least(F.col("turn"), F.lit(5)) + 1).cast("int")).alias("type"), F.col("role").alias("title"), bullets.alias("bullets"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("p. "), F.col("turn").cast("string"))).otherwise("").alias("footer"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.col("role")).alias("notes"),
    )


def deck_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of every plan by name."""
    return issues(plans(spark, sf_dir)).groupBy("plan", "issue").agg(F.count("*").alias("slides"), F.sum("n").alias("n"))


def deck_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(plans(spark, sf_dir)).select("plan", "slides", "issues", "has_method", "has_results", "passed")


def deck_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First bullets of their key in every plan."""
    return unique_bullets(plans(spark, sf_dir)).groupBy("plan").agg(F.count("*").alias("n"), F.min(F.struct("slide", "pos"))["slide"].alias("first_slide"))


_PLANS = r"p AS (SELECT conv_id AS plan, turn AS slide, ['cover', 'background', 'method', 'experiments', 'results', 'summary'][least(turn, 5) + 1] AS type, role AS title, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') AS bullets, CASE WHEN turn % 2 = 0 THEN 'p. ' || turn ELSE '' END AS footer, CASE WHEN turn % 3 = 0 THEN '' ELSE role END AS notes FROM conversations)"


def _key_sql(x: str) -> str:
    return rf"lower(trim(regexp_replace(regexp_replace(trim(regexp_replace({x}, '{T.SPACE_RE2}', ' ', 'g'), ' '), '{PAGE_MARKS}', '', 'g'), '{PUNCTUATION}', ' ', 'g'), ' '))"


_KEYED = f"{_PLANS}, b0 AS (SELECT plan, slide, unnest(bullets) AS bullet, generate_subscripts(bullets, 1) - 1 AS pos FROM p), b AS (SELECT *, {_key_sql('bullet')} AS key FROM b0)"
_TOPIC = "CASE " + " ".join(f"WHEN regexp_matches(key, '{p}') THEN '{n}'" for n, p in TOPICS) + " ELSE '' END"
_TEXT = "(title || ' ' || array_to_string(bullets, ' ') || ' ' || footer)"
_WEAK = rf"(b.key <> '' AND len(regexp_extract_all(b.key, '[A-Za-z0-9π.-]+|[\x{{4e00}}-\x{{9fff}}]{{2,}}')) <= {WEAK_WORDS} AND NOT regexp_matches(b.key, '(?i){EXPLAINS}'))"
_COUNTS = f"n AS (SELECT p.plan, p.slide, any_value(p.type) AS type, any_value(p.title) AS title, any_value(p.footer) AS footer, any_value(p.notes) AS notes, any_value({_TEXT.replace('title', 'p.title').replace('bullets', 'p.bullets').replace('footer', 'p.footer')}) AS txt, count(b.bullet) AS n, count(*) FILTER (WHERE {_WEAK}) AS weak, count(*) FILTER (WHERE regexp_matches(b.bullet, '{NATIVE}')) AS native, count(*) FILTER (WHERE length(b.bullet) > {MOST_SIGNS}) AS long_, count(*) FILTER (WHERE length(b.bullet) > 0 AND len(regexp_extract_all(b.bullet, '[A-Za-z]')) / length(b.bullet) >= {ASCII_SHARE}) AS foreign_, count(*) FILTER (WHERE regexp_matches(trim(b.bullet), '{TEMPLATE}')) AS template FROM p LEFT JOIN b USING (plan, slide) GROUP BY p.plan, p.slide)"
_BODY, _CAT = "type NOT IN ('cover', 'info')", " + ".join(f"regexp_matches(txt, '{p}')::INT" for p in CATEGORIES)
_CHAIN = " AND ".join(f"regexp_matches(txt, '{p}')" for p in CHAIN)
_TESTS = {
    "no_title": "trim(title) = ''", "no_page_source": "type <> 'cover' AND NOT contains(footer, 'p.')", "results_in_background": f"type = 'background' AND regexp_matches(footer, '{RESULTS_IN_BACKGROUND}')", "no_notes": "trim(notes) = ''",
    "weak_bullets": f"{_BODY} AND n > 0 AND weak > n * {WEAK_SHARE}", "method_without_chain": f"type = 'method' AND NOT ({_CHAIN})", "few_categories": f"type IN ('experiments', 'results') AND {_CAT} < {LEAST_CATEGORIES}", "few_native_bullets": f"{_BODY} AND native < {LEAST_NATIVE}",
    "many_bullets": f"n > {MOST_BULLETS}", "long_bullet": "long_ > 0", "foreign_bullet": "foreign_ > 0", "template_prefix": "template > 0",
}
_ISSUES = f"{_KEYED}, {_COUNTS}, i AS (" + " UNION ALL ".join(f"SELECT plan, slide, '{k}' AS issue, 1 AS n FROM n WHERE {t}" for k, t in _TESTS.items()) + f" UNION ALL SELECT plan, NULL, 'few_slides', count(*) FROM p GROUP BY plan HAVING count(*) < {LEAST_SLIDES} UNION ALL SELECT plan, NULL, 'repeated_bullets', count(*) FROM (SELECT plan, key FROM b WHERE key <> '' GROUP BY plan, key HAVING count(*) > 1) GROUP BY plan UNION ALL SELECT plan, slide, 'repeated_topics', count(*) FROM (SELECT plan, slide, {_TOPIC} AS topic FROM b GROUP BY ALL HAVING count(*) > 1 AND topic <> '') GROUP BY plan, slide)"
QUERIES = {f.__name__: f for f in (deck_issues, deck_report, deck_bullets)}
ORACLES = {
    "deck_issues": f"WITH {_ISSUES} SELECT plan, issue, count(*) AS slides, sum(n)::BIGINT AS n FROM i GROUP BY plan, issue",
    "deck_report": f"WITH {_ISSUES}, f AS (SELECT plan, sum(n)::BIGINT AS issues, bool_or(issue = 'repeated_bullets') AS repeats, bool_or(issue IN ('weak_bullets', 'template_prefix')) AS generic FROM i GROUP BY plan), a AS (SELECT plan, count(*) AS slides, bool_or(type = 'method') AS has_method, bool_or(type IN ('experiments', 'results')) AS has_results FROM p GROUP BY plan) SELECT plan, slides, coalesce(issues, 0) AS issues, has_method, has_results, coalesce(issues, 0) = 0 AND has_method AND has_results AND NOT coalesce(repeats, false) AND NOT coalesce(generic, false) AS passed FROM a LEFT JOIN f USING (plan)",
    "deck_bullets": f"WITH {_KEYED}, u AS (SELECT plan, key, min({{'s': slide, 'p': pos}}) AS f FROM b WHERE key <> '' GROUP BY plan, key) SELECT plan, count(*) AS n, min(f).s AS first_slide FROM u GROUP BY plan",
}
