"""Evidence in blocks of papers: detectors, terms, sections by role, scored references, figures.

Blocks are rows doc_id, pos, page, kind, section, t.  Every rule is an expression over one
text, written once for both engines (``sql`` chooses DuckDB's functions), so a scan decides
all of them; buckets, references and figures are windows over the blocks of a document.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .lines import LINES_AND_SAMPLES, TYPE_SQL, lines_and_samples, sectioned

# Word lists, patterns and numeric bounds below are given by the results to match.
WORDS = r"[\p{L}\p{N}]+"
CAPTION = r"(?i)^(fig\.?|figure|table|tab\.?)\s*\d+"
REFERENCES = r"(?i)^(references?|bibliography|参考文献)\b"
PSEUDO_CODE = (r"^\d+\s*:", r"(?i)\b(end\s+if|for\s+\w+\s*=|if\s+.+\s+then|async|timer elapsed|non-blocking|return\s+)", r"[▷▶]")
FRAGMENT_SIGNS = r"[=<>≤≥≈∼∑∏√^_{}\[\]|\\]"
FORMULA_SIGNS = r"[=+\-*/^_{}]"
LABEL = r"(?i)\b(prompt|metadata|subgoal|image|episode|expert|observation|memory|world)\b"
DIAGRAM = (
    r"(?i)\b(subtask|task instruction|prompt|metadata|action expert|world model|high-level policy|language instructions|subgoal images|observation memory|robot data|non-robot data|autonomous data"
    r"|egocentric human data|demonstration data|episode metadata|quality|actions|noise|current observation)\b"
)
CUE = r"(?i)\b(we|our|this paper|propose|present|introduce|evaluate|experiment|result|method|training|dataset|performance|generalization|capabilities|tasks|robotic foundation model)\b"
SCORED = (
    (4, r"\b(we|this paper|our|propose|present|introduce|evaluate|experiment|result|method|model|framework|baseline|improve|challenge)\b"),
    (2, r"\b(problem|limitation|existing|prior|generalization|performance|dataset|task|robot|policy|training)\b"),
)
#: Roles of sections, in the order in which a section's name, then its name and text, are tried.
FORMULA_SECTION = r"(?i)formula|equation|objective|loss|公式|损失|目标函数"
SECTIONS = {
    "abstract": r"(?i)abstract|摘要",
    "related_work": r"(?i)related\s+work|prior\s+work|literature|相关工作|现有工作",
    "method": r"(?i)method|approach|model|framework|algorithm|overview|architecture|training|implementation|方法|模型|算法|框架|结构|训练|实现",
    "experiments": r"(?i)experiment|evaluation|dataset|benchmark|setting|ablation|实验|评估|数据集|基准|消融",
    "results": r"(?i)result|quantitative|comparison|performance|结果|对比|性能",
    "conclusion": r"(?i)conclusion|discussion|future|总结|结论|讨论|未来",
    "limitations": r"(?i)limitation|failure|weakness|局限|不足|失败",
    "introduction": r"(?i)intro|background|motivation|problem|背景|动机|引言",
}
BY_NAME = ("abstract", "related_work", "method", "experiments", "results", "conclusion", "limitations", "introduction")
BY_TEXT = ("abstract", "related_work", "method", "results", "experiments", "conclusion", "limitations", "introduction")
EARLY_PAGES, EARLY_BLOCKS, BACKFILL = 2, 4, 3
#: Kinds of figures by their captions, the first that matches, and the slides they go to.
FIGURES = (
    ("result", "results", r"(?i)result|quantitative|comparison|performance|ablation|success\s*rate|tracking|stability|benchmark|evaluation|metric|score|accuracy|table"),
    ("method", "method", r"(?i)architecture|overview|framework|pipeline|method|model|algorithm|system|module|process|controller|policy"),
    ("formula", "formula", r"(?i)loss|equation|formula|objective|optimization|gradient"),
    ("setup", "experiments", r"(?i)robot|platform|task|environment|dataset|setup|illustration|example|demonstration|scene"),
    ("case", "limitations", r"(?i)failure|case|qualitative|visualization|example"),
)
#: A heading that ran into the sentence after it.
HEADED = r"^(.{8,120}?)(\b(?:We|In|The|This|Our|To|For|During|After|At|Although|Because|Experiments|Evaluation)\b.+)$"
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "method", "model", "paper", "approach", "system", "uses", "using", "based", "through", "between", "into", "output", "input")
TOKEN = r"[A-Za-z][A-Za-z0-9.+-]{2,}|[A-Za-z]+-[A-Za-z0-9-]+|\d+(?:\.\d+)?"
#: Terms by category: the pattern that names each (without case but where it begins with (-i)), in order.
TERMS = {
    "methods": (
        ("PILOT", r"(-i)\bPILOT\b"), ("robot foundation model", r"\brobot foundation model\b"), ("π0.7", r"π0\.?7|pi0\.?7"), ("VLA", r"\bVLA\b|\bvision[-\s]?language[-\s]?action\b"), ("VLM", r"\bVLM\b|\bvision[-\s]?language\b"),
        ("PINN", r"\bPINN\b|\bphysics[-\s]?informed\b"), ("CBF", r"\bCBF\b|\bcontrol barrier function\b"), ("MPC", r"\bMPC\b|\bmodel predictive control\b"), ("PPO", r"(-i)\bPPO\b"), ("SAC", r"(-i)\bSAC\b"), ("World Model", r"\bworld model\b"),
        ("cross-modal context encoder", r"\bcross[-\s]?modal context encoders?\b"), ("Mixture-of-Experts (MoE)", r"\bMixture[-\s]?of[-\s]?Experts\b|\bMoE\b"), ("MoE policy", r"\bMoE policies?\b"),
        ("prediction-based perceptive representation", r"\bprediction[-\s]?based perception\b|\bprediction[-\s]?based perceptive representations?\b"), ("perception encoder", r"\bperception encoders?\b"), ("latent dynamics", r"\blatent dynamics\b"),
        ("trajectory optimizer", r"\btrajectory optimizers?\b"), ("policy network", r"\bpolicy networks?\b"), ("low-level controller", r"\blow[-\s]?level controllers?\b"), ("planner", r"\bplanners?\b"),
    ),
    "observations": (
        ("RGB-D observations", r"\bRGB[-\s]?D observations?\b|\bRGB[-\s]?D inputs?\b"), ("LiDAR-based elevation map", r"\bLiDAR[-\s]?based elevation maps?\b"), ("elevation map", r"\belevation maps?\b"), ("occupancy map", r"\boccupancy maps?\b"),
        ("cost map", r"\bcost maps?\b"), ("terrain-aware perceptive features", r"\bterrain[-\s]?aware perceptive features?\b"), ("perceptive features", r"\bperceptive features?\b"), ("prediction-based perceptive representation", r"\bprediction[-\s]?based perceptive representations?\b"),
        ("proprioception", r"\bproprioceptive states?\b|\bproprioception\b"), ("RGB observations", r"\bRGB observations?\b|\bRGB images?\b"), ("visual observations", r"\bvisual observations?\b|\bvision observations?\b"),
        ("language instruction", r"\blanguage (instructions?|goals?|commands?)\b"), ("subgoal images", r"\bsubgoal images?\b"), ("episode metadata", r"\bepisode metadata\b"), ("task metadata", r"\btask metadata\b"), ("point cloud", r"\bpoint clouds?\b"),
    ),
    "commands": (
        ("hybrid internal command", r"\bhybrid internal command(?: representation)?\b"), ("internal command", r"\binternal command(?: representation)?\b"), ("high-level policy prompt", r"\bhigh[-\s]?level policy prompts?\b"), ("context conditioning", r"\bcontext conditioning\b"),
        ("subtask instruction", r"\bsubtask instructions?\b"), ("task command", r"\btask commands?\b"), ("waypoint", r"\bwaypoints?\b"), ("language goal", r"\blanguage goals?\b"),
    ),
    "outputs": (
        ("whole-body action", r"\bwhole[-\s]?body actions?\b"), ("whole-body control action", r"\bwhole[-\s]?body control actions?\b"), ("joint target", r"\bjoint targets?\b"), ("low-level action", r"\blow[-\s]?level robot actions?\b"), ("action output", r"\baction outputs?\b"),
        ("command tracking", r"\bcommand tracking\b"), ("trajectory", r"\btrajectory\b"), ("control command", r"\bcontrol commands?\b"), ("velocity command", r"\bvelocity commands?\b"), ("target pose", r"\btarget poses?\b"),
    ),
    "platforms": (
        ("Unitree G1", r"\bUnitree\s*G1\b"), ("humanoid robot", r"\bhumanoid robots?\b"), ("real robot", r"\bphysical robot\b|\breal[-\s]?world robot\b"), ("multiple robot platforms", r"\bmultiple robot platforms?\b"), ("mobile robot", r"\bmobile robots?\b"), ("quadruped robot", r"\bquadruped robots?\b"),
    ),
    "tasks": (
        ("loco-manipulation", r"\bloco[-\s]?manipulation\b"), ("whole-body control", r"\bwhole[-\s]?body control\b"), ("dexterous manipulation", r"\bdexterous manipulation\b"), ("unstructured scenes", r"\bunstructured scenes?\b|\bunstructured environments?\b"), ("terrain traversability", r"\bterrain traversability\b"),
        ("obstacle crossing", r"\bobstacle crossing\b"), ("slope traversal", r"\bslope traversal\b"), ("narrow passage", r"\bnarrow passage\b"), ("object transport", r"\bobject transport\b"), ("daily service tasks", r"\bdaily service tasks?\b"), ("navigation", r"\bnavigation\b"), ("path planning", r"\bpath planning\b"), ("long-horizon tasks", r"\blong[-\s]?horizon\b"),
    ),
    "training": (
        ("reinforcement learning", r"(-i)\breinforcement learning\b|\bRL\b"), ("imitation learning", r"\bimitation learning\b"), ("demonstrations", r"\bdemonstrations?\b"), ("autonomous data", r"\bautonomous data\b"), ("multimodal web data", r"\bmultimodal web data\b"), ("behavior cloning", r"\bbehavior cloning\b"),
        ("safety cost objective", r"\bsafety cost objective\b|\bsafety cost\b"), ("simulation", r"\bsimulation\b"), ("real-world data", r"\breal[-\s]?world\b"), ("pre-training", r"\bpre[-\s]?training\b"),
    ),
    "baselines": (
        ("blind baseline", r"\bblind baseline(?: controllers?)?\b"), ("existing baselines", r"\bexisting baselines?\b"), ("specialist policies", r"\bspecialist policies\b"), ("imitation learning baselines", r"\bimitation learning baselines?\b"), ("PPO", r"(-i)\bPPO\b"), ("SAC", r"(-i)\bSAC\b"), ("MPC", r"(-i)\bMPC\b"), ("CBF", r"(-i)\bCBF\b"),
    ),
    "metrics": (
        ("success rate", r"\bsuccess rate\b"), ("collision rate", r"\bcollision rate\b"), ("path efficiency", r"\bpath efficiency\b"), ("stability", r"\bstability\b"), ("fall rate", r"\bfall rate\b"), ("R_tracking", r"\bR_tracking\b"), ("R_stability", r"\bR_stability\b"), ("C_collision", r"\bC_collision\b"),
        ("command tracking precision", r"\bcommand tracking(?: precision)?\b"), ("terrain traversability", r"\bterrain traversability\b"), ("compositional generalization", r"\bcompositional generalization\b"), ("tracking error", r"\btracking error\b"), ("generalization", r"\bgeneralization\b"), ("robustness", r"\brobustness\b"),
    ),
    "constraints": (
        ("safety constraint", r"\bsafety constraints?\b"), ("physical constraint", r"\bphysical constraints?\b"), ("CBF safety constraint", r"(-i)\bcontrol barrier function\b|\bCBF\b"), ("safety cost objective", r"\bsafety cost objective\b|\bsafety cost\b"), ("loss objective", r"\bloss functions?\b|\bloss\b"), ("objective function", r"\bobjective function\b|\bobjective\b"),
    ),
}
MOST_TERMS = 6


def _has(t: str, pattern: str, sql: bool) -> str:
    return f"regexp_matches({t}, '{pattern}')" if sql else f"regexp_like({t}, r'{T.ascii_edges(pattern)}')"


def _number(t: str, pattern: str, sql: bool) -> str:
    return f"len(regexp_extract_all({t}, '{pattern}'))" if sql else f"regexp_count({t}, r'{T.ascii_edges(pattern)}')"


def inline(t: str, most: int, sql: bool) -> str:
    """White space collapsed, at most ``most`` signs, the last an ellipsis if any were cut."""
    x = f"trim(regexp_replace({t}, '\\s+', ' ', 'g'), ' ')" if sql else f"trim(regexp_replace({t}, r'\\s+', ' '))"
    return f"(CASE WHEN length({x}) > {most} THEN rtrim(substr({x}, 1, {most - 1})) || '…' ELSE {x} END)"


def once(value: str, f, name: str = "v") -> str:
    """``T.let`` of a Spark expression."""
    return f"transform(array({value}), {name} -> {f(name)})[0]"


def rules(t: str, sql: bool = False, n: str | None = None) -> dict[str, str]:
    """Detectors of noise in the text ``t``, as expressions of either engine; ``n``: the number of its words, where it is at hand."""
    n = n or _number(t, WORDS, sql)
    low = f"lower({inline(t, 500, sql)})"

    def diagram(low: str) -> str:
        labels, words = _number(low, DIAGRAM, sql), _number(low, WORDS, sql)
        if not sql:  # few words first, as counting them is the least work
            few = lambda w: f"({w} <= 34 AND {once(labels, lambda k: f'({k} >= 3 OR ({w} <= 16 AND {k} >= 1))', 'k')} AND NOT {_has(low, CUE, sql)})"
            return once(words, few, "w")
        return f"(NOT {_has(low, CUE, sql)} AND (({words} <= 16 AND {labels} >= 1) OR ({words} <= 34 AND {labels} >= 3)))"

    signs = _number(t, FRAGMENT_SIGNS, sql)
    found = {
        "pseudo_code": "(" + " OR ".join(_has(f"trim({t})", p, sql) for p in PSEUDO_CODE) + ")",
        "formula_fragment": f"({signs} >= 4 AND {signs} > {n} * 0.35)",
        "figure_label": f"({n} <= 14 AND {_has(t, LABEL, sql)})",
        "diagram_text": diagram(low) if sql else once(low, diagram, "y"),
    }
    found["noise"] = "(" + " OR ".join(found.values()) + ")"
    found["formula_text"] = f"(NOT {found['pseudo_code']} AND NOT {found['diagram_text']} AND {_has(t, FORMULA_SIGNS, sql)} AND {n} <= 28)"
    found["bullet"] = f"(length({t}) >= 24 AND {n} >= 7 AND NOT {found['noise']})"
    found["prose"] = f"(length({t}) >= 55 AND {n} >= 8 AND NOT {_has(t, CAPTION, sql)} AND NOT {found['noise']} AND ({_has(t, '[.!?。！？]', sql)} OR {n} >= 16))"
    return found


def _literal(pattern: str) -> str:
    """The letters and digits with which all that a pattern without bars matches begins."""
    plain = pattern.removeprefix(r"\b")
    found = re.match(r"[\wπ]*", plain).group()
    return found[:-1] if plain[len(found) : len(found) + 1] in ("?", "*", "{") else found


def _tree(words: list[str]) -> str:
    """A pattern of any of ``words``, divided letter by letter."""
    if "" in words:
        return ""
    heads = sorted({w[0] for w in words})
    parts = [h + _tree([w[1:] for w in words if w[0] == h]) for h in heads]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def any_role() -> str:
    """A pattern found in every text that one of ``SECTIONS`` or the formulas' is found in."""
    words = {_literal(a).lower() for p in [FORMULA_SECTION, *SECTIONS.values()] for a in T.alternatives(p.removeprefix("(?i)"))}
    assert all(len(w) > 1 for w in words)
    return f"(?i){_tree(sorted(words))}"


def role_of(section: str, text: str, kind: str, sql: bool = False) -> str:
    """The role of a block: formula, by its section's name, by name and text, or null."""
    both = f"({section} || ' ' || {text})"
    # Without SQL, texts with no word of any role are told by one search instead of one for each role.
    cases = [] if sql else [f"WHEN {kind} = 'formula' THEN 'formula' WHEN NOT {_has(both, any_role(), sql)} THEN NULL"]
    cases += [f"WHEN {kind} = 'formula' OR {_has(both, FORMULA_SECTION, sql)} THEN 'formula'"]
    cases += [f"WHEN {_has(section, SECTIONS[r], sql)} THEN '{r}'" for r in BY_NAME]
    cases += [f"WHEN {_has(both, SECTIONS[r], sql)} THEN '{r}'" for r in BY_TEXT]
    return f"CASE {' '.join(cases)} END"


def score_of(text: str, page: str, sql: bool = False) -> str:
    """How well a passage speaks for a paper."""
    parts = [f"(CASE WHEN {_has(f'lower({text})', p, sql)} THEN {k} ELSE 0 END)" for k, p in SCORED]
    parts += [f"(CASE WHEN length({text}) BETWEEN 90 AND 280 THEN 2 ELSE 0 END)", f"(CASE WHEN {rules(text, sql)['noise']} THEN -8 ELSE 0 END)", f"(CASE WHEN {page} <= 2 THEN 1 ELSE 0 END)"]
    return "(" + " + ".join(parts) + ")"


def figure_kind(text: str, place: int, sql: bool = False) -> str:
    """The kind (place 0) or the slide (place 1) of a figure by its caption."""
    default = ("unknown", "method")[place]
    return "CASE " + " ".join(f"WHEN {_has(text, f[2], sql)} THEN '{f[place]}'" for f in FIGURES) + f" ELSE '{default}' END"


def is_usable() -> Column:
    """Blocks that may speak at all: not of the references, and not too short."""
    size = F.length(F.expr(inline("t", 999, False)))
    return ~F.expr(_has("trim(section)", REFERENCES, False)) & F.when(F.col("kind") == "formula", size >= 4).otherwise(size >= 12)


def is_narrative() -> Column:
    """Blocks of prose, and useful formulas."""
    decide = lambda v, n: f"CASE WHEN kind = 'formula' THEN {rules(v, n=n)['formula_text']} ELSE {rules(v, n=n)['prose']} END"
    return F.expr(once(inline("t", 1200, False), lambda v: once(_number(v, WORDS, False), lambda n: decide(v, n), "n")))


def may_name() -> str:
    """A pattern found in every text that names a term, by the beginnings of all terms; in most others it isn't."""
    every = [a for entries in TERMS.values() for _, p in entries for a in T.alternatives(p.removeprefix("(-i)"))]
    words = {_literal(a).lower() for a in every if a.startswith(r"\b")}
    others = {_literal(a).lower() for a in every if not a.startswith(r"\b")}
    assert all(len(w) > 1 for w in words | others)
    return f"(?i){T.EDGE_BEFORE}{_tree(sorted(words))}|{_tree(sorted(others))}"


def terms(text: Column) -> Column:
    """The distinct terms of every category that the text names, at most six of each, as a struct.

    The text is searched once for the beginnings of all terms, and only where one is found for each term.
    """

    def named(label: str, pattern: str) -> Column:
        plain = T.ascii_edges(pattern.removeprefix("(-i)"))
        return F.when(text.rlike(plain if pattern.startswith("(-i)") else f"(?i){plain}"), label)

    lists = [F.slice(F.filter(F.array(*[named(*e) for e in entries]), lambda x: x.isNotNull()), 1, MOST_TERMS).alias(c) for c, entries in TERMS.items()]
    none = F.struct(*[F.array().cast("array<string>").alias(c) for c in TERMS])
    return F.when(text.rlike(may_name()), F.struct(*lists)).otherwise(none)


def evidence_tokens(text: Column) -> Column:
    """Distinct tokens that carry evidence: four signs or more or a code in capitals, no stop words, in lower case."""
    found = F.filter(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), 1), lambda x: (F.length(x) >= 4) | x.rlike(r"^[A-Z0-9.+-]{2,}$"))
    return F.array_distinct(F.filter(F.transform(found, F.lower), lambda x: ~x.isin(*STOP_WORDS)))


def clauses(sentence: Column) -> Column:
    """A sentence of over 145 signs in parts of up to 135, cut at commas and conjunctions; a shorter one whole."""
    parts = F.split(F.regexp_replace(sentence, r"(?i)(?<=,|;|；)\s+|\s+(?:and|but|while|whereas|because|including|without)\s+", "\u0001"), "\u0001")
    parts = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) >= 18)

    def pack(done: Column, part: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = F.coalesce(F.length(last) + 1 + F.length(part) <= 135, F.lit(False))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat(last, F.lit(" "), part)))).otherwise(F.concat(done, F.array(part)))

    packed = F.aggregate(parts, F.array().cast("array<string>"), pack)
    return F.when((F.length(sentence) <= 145) | (F.size(parts) <= 1), F.array(sentence)).otherwise(packed)


def short_bullets(text: Column) -> Column:
    """A text as up to two short points: its sentences, or the clauses of its one sentence."""
    one = lambda found, plain: T.let(F.coalesce(F.try_element_at(found, F.lit(1)), plain), clauses)
    chunks = lambda plain: T.let(T.sentences(plain), lambda found: F.when(F.size(found) > 1, found).otherwise(one(found, plain)))
    every = T.let(T.collapse(text), lambda x: T.let(T.truncated(x, 520), chunks))
    return F.transform(F.slice(every, 1, 2), lambda x: T.let(T.collapse(x), lambda y: T.truncated(y, 150)))


def without_heading(text: Column) -> Column:
    """A text without a spaced-out heading that ran into its first sentence."""
    pattern = T.ascii_edges(HEADED)
    noisy = lambda head: head.rlike(T.ascii_edges(r"(?:\b[A-Z]\s+[A-Z]|\b[A-Z]{2,}\b|\b[IVX]+\.)")) & (T.count(head, r"\p{L}") >= 5) & (T.count(head, r"\p{Lu}") >= T.count(head, r"\p{Ll}"))
    body = lambda plain: F.when(T.let(F.regexp_extract(plain, pattern, 1), noisy), F.trim(F.regexp_extract(plain, pattern, 2))).otherwise(plain)
    return T.let(T.collapse(text), lambda x: T.let(T.truncated(x, 1200), body))


def blocks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents (and sample lines) as blocks, 40 a page."""
    typed = lines_and_samples(spark, sf_dir).withColumn("kind", T.line_type(F.col("t")))
    return sectioned(typed).select("doc_id", "pos", (F.floor(F.col("pos") / 40) + 1).alias("page"), "kind", "section", "t")


def bucketed(blocks: DataFrame) -> DataFrame:
    """(doc_id, bucket, pos, page, section, text, score): usable blocks by role.

    Early blocks of no role fill the introduction while it has fewer than four; an empty
    introduction takes the abstract's first three, empty results those of the experiments,
    and the other way round.
    """
    some = blocks.filter(F.col("kind").isin("paragraph", "formula") & ~F.expr(_has("trim(section)", REFERENCES, False))).filter(is_narrative())
    rows = some.withColumn("role", F.expr(role_of("section", "t", "kind")))
    doc = W.partitionBy("doc_id")
    early = F.col("role").isNull() & (F.col("page") <= EARLY_PAGES)
    open_ = early | (F.col("role") == "introduction")
    before = F.sum(open_.cast("int")).over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("role", F.when(early & (before <= EARLY_BLOCKS), "introduction").otherwise(F.col("role"))).filter("role IS NOT NULL")
    sizes = {r: F.count_if(F.col("role") == r).over(doc) for r in ("introduction", "results", "experiments")}
    rows = rows.withColumns({f"n_{r}": c for r, c in sizes.items()} | {"place": F.row_number().over(W.partitionBy("doc_id", "role").orderBy("pos"))})
    lend = lambda role, to: F.when((F.col("role") == role) & (F.col("place") <= BACKFILL) & (F.col(f"n_{to}") == 0), to)
    every = F.filter(F.array(F.col("role"), lend("abstract", "introduction"), lend("experiments", "results"), lend("results", "experiments")), lambda x: x.isNotNull())
    text = T.let(without_heading(F.col("t")), lambda x: T.truncated(x, 360))
    return rows.select("doc_id", "pos", "page", "section", text.alias("text"), F.explode(every).alias("bucket")).withColumn("score", F.expr(once("text", lambda v: score_of(v, "page"))))


def picked(refs: DataFrame, order: list[str], most: int) -> DataFrame:
    """The best ``most`` references of each document: buckets in ``order``, best scores first, equal (text, page) once."""
    return picked_by_type(refs, {"": order}, most).drop("type")


def picked_by_type(refs: DataFrame, orders: dict[str, list[str]], most: int) -> DataFrame:
    """``picked`` for several orders of buckets, by their name as ``type``, in one pass over the references."""
    taken = lambda b: F.array(*[F.struct(F.lit(t).alias("type"), F.lit(o.index(b) + 1).alias("rank")) for t, o in orders.items() if b in o])
    by_bucket = F.lit(None).cast("array<struct<type:string,rank:int>>")
    for b in sorted({b for o in orders.values() for b in o}):
        by_bucket = F.when(F.col("bucket") == b, taken(b)).otherwise(by_bucket)
    some = refs.withColumn("_to", F.explode(by_bucket)).select(*refs.columns, "_to.type", "_to.rank")
    one = some.groupBy("doc_id", "type", F.xxhash64("text").alias("h"), "text", "page").agg(F.min(F.struct("rank", (-F.col("score")).alias("s"), "pos", "bucket")).alias("f")).select("doc_id", "type", "text", "page", "f.*")
    place = F.row_number().over(W.partitionBy("doc_id", "type").orderBy("rank", "s", "pos"))
    return one.withColumn("place", place.cast("long")).filter(F.col("place") <= most)


def figures(blocks: DataFrame) -> DataFrame:
    """Captions outside the references, numbered, with their kind and the slide they suit."""
    some = blocks.filter(((F.col("kind") == "caption") | F.expr(_has("trim(t)", CAPTION, False))) & ~F.expr(_has("trim(section)", REFERENCES, False)))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("pos")).cast("long")
    return some.withColumns({"number": number, "figure_kind": F.expr(figure_kind("t", 0)), "slide": F.expr(figure_kind("t", 1))}).withColumn("image_id", F.concat_ws("-", F.lit("fig"), F.col("page").cast("string"), F.col("number").cast("string")))


# -- queries --------------------------------------------------------------------------------


def evidence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every detector over every line."""
    found = rules("t")
    return lines_and_samples(spark, sf_dir).select("doc_id", "pos", *[F.expr(e).alias(k) for k, e in found.items()])


def evidence_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that may be shown, and those of prose."""
    return blocks_of(spark, sf_dir).filter(is_usable()).select("doc_id", "pos", is_narrative().alias("narrative"))


def evidence_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every role, with their pages."""
    found = bucketed(blocks_of(spark, sf_dir))
    return found.groupBy("doc_id", "bucket").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda x: x.cast("string")), ",").alias("pages"))


def evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six best references of each document for its method."""
    return picked(bucketed(blocks_of(spark, sf_dir)), ["method", "abstract", "introduction"], 6).select("doc_id", "place", "bucket", "page", (-F.col("s")).cast("long").alias("score"), "pos")


def evidence_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of documents, and the first two of each slide."""
    place = F.row_number().over(W.partitionBy("doc_id", "slide").orderBy("number"))
    return figures(blocks_of(spark, sf_dir)).select("doc_id", "pos", "image_id", "figure_kind", "slide", (place <= 2).alias("shown"))


def evidence_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of every line that names any, by category."""
    found = lines_and_samples(spark, sf_dir).filter(F.col("t").rlike(may_name())).withColumn("x", terms(F.col("t")))
    return found.select("doc_id", "pos", *[F.array_join(f"x.{c}", "; ").alias(c) for c in TERMS]).filter(" OR ".join(f"{c} <> ''" for c in TERMS))


def evidence_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence tokens of every line."""
    return lines_and_samples(spark, sf_dir).select("doc_id", "pos", F.array_join(evidence_tokens(F.col("t")), " ").alias("tokens"))


def short_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as short points."""
    return lines_and_samples(spark, sf_dir).select("doc_id", "pos", F.array_join(short_bullets(F.col("t")), "\n").alias("points"))


_SECTIONED = f"k AS (SELECT doc_id, pos, t, {TYPE_SQL} AS kind FROM {LINES_AND_SAMPLES}), b AS (SELECT doc_id, pos, pos // 40 + 1 AS page, kind, t, coalesce(last_value(CASE WHEN kind = 'heading' THEN trim(t) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Page 1') AS section FROM k)"
_LONG = inline("t", 1200, True)
_NARRATIVE = f"(CASE WHEN kind = 'formula' THEN {rules(_LONG, True)['formula_text']} ELSE {rules(_LONG, True)['prose']} END)"
_HEAD = f"regexp_extract({_LONG}, '{HEADED}', 1)"
_BODY = rf"(CASE WHEN regexp_matches({_HEAD}, '(?:\b[A-Z]\s+[A-Z]|\b[A-Z]{{2,}}\b|\b[IVX]+\.)') AND len(regexp_extract_all({_HEAD}, '\p{{L}}')) >= 5 AND len(regexp_extract_all({_HEAD}, '\p{{Lu}}')) >= len(regexp_extract_all({_HEAD}, '\p{{Ll}}')) THEN trim(regexp_extract({_LONG}, '{HEADED}', 2), ' ') ELSE {_LONG} END)"
_BUCKETS = f"""{_SECTIONED},
s AS (SELECT *, {role_of('section', 't', 'kind', True)} AS r0 FROM b WHERE kind IN ('paragraph', 'formula') AND NOT {_has('trim(section)', REFERENCES, True)} AND {_NARRATIVE}),
e AS (SELECT *, sum((r0 = 'introduction' OR (r0 IS NULL AND page <= 2))::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM s),
r AS (SELECT doc_id, pos, page, section, {_BODY} AS body, CASE WHEN r0 IS NULL AND page <= 2 AND upto <= 4 THEN 'introduction' ELSE r0 END AS role FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, role ORDER BY pos) AS place, count(*) FILTER (WHERE role = 'introduction') OVER (PARTITION BY doc_id) AS ni, count(*) FILTER (WHERE role = 'results') OVER (PARTITION BY doc_id) AS nr, count(*) FILTER (WHERE role = 'experiments') OVER (PARTITION BY doc_id) AS ne FROM r WHERE role IS NOT NULL),
u AS (SELECT *, role AS bucket FROM c UNION ALL SELECT *, 'introduction' FROM c WHERE role = 'abstract' AND place <= 3 AND ni = 0 UNION ALL SELECT *, 'results' FROM c WHERE role = 'experiments' AND place <= 3 AND nr = 0 UNION ALL SELECT *, 'experiments' FROM c WHERE role = 'results' AND place <= 3 AND ne = 0),
x AS (SELECT doc_id, pos, page, bucket, CASE WHEN length(body) > 360 THEN rtrim(substr(body, 1, 359)) || '…' ELSE body END AS text FROM u),
y AS (SELECT *, {score_of('text', 'page', True)} AS score FROM x)"""
_RULES = ", ".join(f"{e} AS {k}" for k, e in rules("t", True).items())
QUERIES = {f.__name__: f for f in (evidence_rules, evidence_usable, evidence_buckets, evidence_refs, evidence_figures, evidence_terms, evidence_token_lists, short_points)}


def _named(label: str, pattern: str) -> str:
    plain = pattern.removeprefix("(-i)")
    return f"CASE WHEN regexp_matches(t, '{plain if plain != pattern else '(?i)' + plain}') THEN '{label}' END"


_TERMS = ", ".join(f"array_to_string(list_slice(list_filter([{', '.join(_named(*e) for e in entries)}], lambda x: x IS NOT NULL), 1, 6), '; ') AS {c}" for c, entries in TERMS.items())
_STOPS = ", ".join(f"'{x}'" for x in STOP_WORDS)
ORACLES = {
    "evidence_rules": f"SELECT doc_id, pos, {_RULES} FROM {LINES_AND_SAMPLES}",
    "evidence_usable": f"WITH {_SECTIONED} SELECT doc_id, pos, {_NARRATIVE} AS narrative FROM b WHERE NOT {_has('trim(section)', REFERENCES, True)} AND length({inline('t', 999, True)}) >= CASE WHEN kind = 'formula' THEN 4 ELSE 12 END",
    "evidence_buckets": f"WITH {_BUCKETS} SELECT doc_id, bucket, count(*) AS n, min(pos) AS first_pos, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages FROM y GROUP BY doc_id, bucket",
    "evidence_refs": f"WITH {_BUCKETS}, p AS (SELECT *, CASE bucket WHEN 'method' THEN 1 WHEN 'abstract' THEN 2 ELSE 3 END AS rank FROM y WHERE bucket IN ('method', 'abstract', 'introduction')), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, page ORDER BY rank, -score, pos) AS first FROM p), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, -score, pos) AS place FROM o WHERE first = 1) SELECT doc_id, place::BIGINT AS place, bucket, page, score::BIGINT AS score, pos FROM q WHERE place <= 6",
    "evidence_figures": f"WITH {_SECTIONED}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS number, {figure_kind('t', 0, True)} AS figure_kind, {figure_kind('t', 1, True)} AS slide FROM b WHERE (kind = 'caption' OR {_has('trim(t)', CAPTION, True)}) AND NOT {_has('trim(section)', REFERENCES, True)}) SELECT doc_id, pos, 'fig-' || page || '-' || number AS image_id, figure_kind, slide, row_number() OVER (PARTITION BY doc_id, slide ORDER BY number) <= 2 AS shown FROM f",
    "evidence_terms": f"SELECT * FROM (SELECT doc_id, pos, {_TERMS} FROM {LINES_AND_SAMPLES}) WHERE {' OR '.join(f'{c} <> {chr(39) * 2}' for c in TERMS)}",
    "evidence_token_lists": f"WITH k AS (SELECT doc_id, pos, list_filter(list_transform(list_filter(regexp_extract_all(t, '{TOKEN}'), lambda x: length(x) >= 4 OR regexp_full_match(x, '[A-Z0-9.+-]{{2,}}')), lambda x: lower(x)), lambda x: x NOT IN ({_STOPS})) AS xs FROM {LINES_AND_SAMPLES}) SELECT doc_id, pos, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), ' ') AS tokens FROM k",
}
