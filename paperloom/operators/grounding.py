"""Bullets that rest on their sources: set-overlap joins of tokens, and the test of one bullet.

``overlapping`` finds all pairs of sets that share at least k tokens.  Tokens are put in one
order, rarest first; two sets with k common tokens have the first of these among all but
the last k - 1 of both, so only those prefixes are joined, and the most frequent tokens of
every set stay out of the lists.  A pair is taken at its first common token alone, so none
comes twice and no pairs need to be told apart afterwards.

Defined cases: repeated tokens of a set count once; null and empty sets are in no pair; ids
may repeat (each row is a set); an empty bullet has no tokens; a slide without any text
grounds every bullet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .decks import plans
from .evidence import _STOPS, FORMULA_SIGNS, TERMS, TOKEN, evidence_tokens, short_bullets, terms
from .lines import lines

# What says that the source is silent, what is said of any paper, anchors, and the lengths of exact terms and of formulas.
SILENT = r"(?i)原文未明确|not specified|not clear|not reported|missing detail"
GENERIC = (
    r"(?i)\bconnects?\s+(perception|model|policy|planning).{0,32}(execution|control|behavior)\b",
    r"(?i)\b(improves?|enhances?|boosts?)\s+(generalization|robustness|performance|policy behavior)\b",
    r"(?i)\b(complex scenarios?|diverse scenarios?|better policy behavior|generic capabilities)\b",
    r"(?i)\b(the method|this paper|the architecture)\s+(supports?|emphasizes?|improves?|enhances?)\b",
    "论文信息|研究对象|论点|方法线索|汇报目标|模型.*控制.*执行|增强泛化能力|复杂场景",
)
ANCHORS = (
    "rgb", "rgb-d", "lidar", "pilot", "unitree g1", "vla", "vlm", "mpc", "cbf", "ppo", "sac", "pinn", "rl", "world model", "policy network", "observation encoder", "action head", "low-level robot action", "hybrid internal command", "whole-body action",
    "success rate", "collision rate", "tracking error", "terrain traversability",
)
LEAST_SHARED, LEAST_TERM, FORMULA_LENGTH = 2, 3, 92
NAMED = r"\b[A-Z][A-Za-z0-9.+-]{2,}\b|\b\d+(?:\.\d+)?\b"


def overlapping(left: DataFrame, right: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(left_id, right_id, shared) of all pairs of sets with at least ``least`` common tokens; both have id and tokens."""
    sides = {}
    both = left.select(F.array_distinct("tokens").alias("t")).unionByName(right.select(F.array_distinct("tokens").alias("t")))
    often = both.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("f"))
    for name, df in (("left", left), ("right", right)):
        rows = df.select("id", F.array_distinct("tokens").alias("t"), F.monotonically_increasing_id().alias("row")).select("row", "id", F.explode("t").alias("token"))
        # One row for each set again, its tokens rarest first.
        ordered = rows.join(often, "token").groupBy("row", "id").agg(F.transform(F.array_sort(F.collect_list(F.struct("f", "token"))), lambda x: x["token"]).alias("set"))
        prefix = F.slice("set", F.lit(1), F.greatest(F.lit(0), F.size("set") - (least - 1)))
        sides[name] = ordered.select(F.col("id").alias(f"{name}_id"), F.col("set").alias(f"{name}_set"), F.explode(prefix).alias("token"))
    met = sides["left"].join(sides["right"], "token").select("left_id", "right_id", "token", F.array_intersect("left_set", "right_set").alias("common"))
    return met.filter((F.size("common") >= least) & (F.element_at("common", 1) == F.col("token"))).select("left_id", "right_id", F.size("common").alias("shared"))


def sources(slides: DataFrame) -> DataFrame:
    """What slides (plan, slide, evidence) hold for the test of their bullets, worked out once for each: exact terms, tokens, text in lower case."""
    found = terms(F.col("evidence"))
    formulas = F.transform(F.filter(short_bullets(F.col("evidence")), lambda x: x.rlike(FORMULA_SIGNS)), lambda x: T.truncated(x, FORMULA_LENGTH))
    exact = F.transform(F.filter(F.concat(*[found[c] for c in TERMS], formulas), lambda x: F.length(x) >= LEAST_TERM), F.lower)
    return slides.select("plan", "slide", exact.alias("_exact"), evidence_tokens(F.col("evidence")).alias("_tokens"), F.lower("evidence").alias("_lower"))


def is_grounded(bullet: Column) -> Column:
    """Whether a bullet rests on its slide's ``sources``: the first rule that applies decides."""
    edges = T.ascii_edges
    has = lambda terms_: lambda lower: F.exists(terms_, lambda x: F.contains(lower, x))
    generic = F.exists(F.array(*[bullet.rlike(edges(p)) for p in GENERIC]), lambda x: x)
    anchored = T.let(F.lower(bullet), has(F.array(*[F.lit(a) for a in ANCHORS])))
    exact = T.let(F.lower(bullet), has(F.col("_exact")))

    def by_tokens(own: Column) -> Column:
        entity = bullet.rlike(edges(NAMED)) & F.exists(own, lambda t: F.contains(F.col("_lower"), t))
        return (F.size(F.array_intersect(own, "_tokens")) >= LEAST_SHARED) | entity

    empty = F.trim(F.coalesce("_lower", F.lit(""))) == ""
    return F.when(bullet.rlike(SILENT), True).when(generic, False).when(anchored | empty, True).otherwise(exact | T.let(evidence_tokens(bullet), by_tokens))


def grounded(bullets: DataFrame, slides: DataFrame) -> DataFrame:
    """``bullets`` (plan, slide, pos, bullet) that rest on their slide's text (plan, slide, evidence); without a slide, any does that isn't generic."""
    met = bullets.join(sources(slides), ["plan", "slide"], "left")
    return met.filter(is_grounded(F.col("bullet"))).select(*bullets.columns)


def item_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item and document, the lines that share two tokens with the item, and the most they share."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), evidence_tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    found = lines(table(spark, sf_dir, "documents")).select(F.struct("doc_id", "pos").alias("id"), evidence_tokens(F.col("t")).alias("tokens"))
    pairs = overlapping(items, found)
    return pairs.groupBy(F.col("left_id").alias("item_id"), F.col("right_id.doc_id").alias("doc_id")).agg(F.count("*").alias("lines"), F.max("shared").cast("long").alias("most"))


def grounded_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bullets of every slide that rest on the slide before it; the first slide of a plan has none before."""
    p = plans(spark, sf_dir)
    bullets = p.select("plan", "slide", F.posexplode("bullets").alias("pos", "bullet"))
    before = p.select("plan", (F.col("slide") + 1).alias("slide"), F.concat_ws(" ", "title", F.array_join("bullets", " "), "footer").alias("evidence"))
    return grounded(bullets, before).groupBy("plan", "slide").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


QUERIES = {f.__name__: f for f in (item_sources, grounded_bullets)}


def _tokens_sql(t: str) -> str:
    kept = f"list_filter(regexp_extract_all({t}, '{TOKEN}'), lambda x: length(x) >= 4 OR regexp_full_match(x, '[A-Z0-9.+-]{{2,}}'))"
    return f"list_distinct(list_filter(list_transform({kept}, lambda x: lower(x)), lambda x: x NOT IN ({_STOPS})))"


ORACLES = {
    "item_sources": f"""WITH l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS pos, s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
        a AS (SELECT item_id, unnest({_tokens_sql("coalesce(text, '')")}) AS token FROM benchmark),
        b AS (SELECT doc_id, pos, unnest({_tokens_sql("s[pos]")}) AS token FROM l),
        p AS (SELECT item_id, doc_id, pos, count(*) AS shared FROM a JOIN b USING (token) GROUP BY ALL HAVING count(*) >= {LEAST_SHARED})
        SELECT item_id, doc_id, count(*) AS lines, max(shared)::BIGINT AS most FROM p GROUP BY ALL""",
}
