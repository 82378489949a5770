"""JSON of uncertain shape, as VARIANT columns: replies to requests, settings, patches.

A reply is parsed once (``try_parse_json``) and read by typed getters that tell a text from
a number, so what has the wrong kind is absent instead of cast.  Settings lay a document
over defaults, section by section, and bring chosen values into their bounds.  Patches of a
record are split by field, so that the last of each field is a maximum and no record's
patches meet in one row.

Defined cases: null, blank and broken JSON is no JSON; an object that repeats a key is
broken; where only some items of a list can be read, those count; sections of settings that
aren't objects change nothing; a patch of a record that isn't there is dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table

# The default settings by section, the strategies that may be chosen, and the bounds of the layout's numbers (least, most, default).
DEFAULTS = {
    "general": {"themeMode": "system", "uiScale": 1, "defaultHome": "workspace", "language": "zh-CN", "autoSave": True, "autoSaveIntervalSeconds": 20},
    "pdf": {"defaultMode": "source", "defaultScale": 1, "pageTurnMode": "scroll", "rememberLastPage": True, "showPageNumber": True, "referenceTranslationStrategy": "keep-original", "pdfMathTranslatePath": ""},
    "ai": {"defaultThinkingMode": "auto", "defaultReasoningEffort": "auto"},
    "researchSheet": {"defaultSheetName": "论文研究表", "defaultFontSize": 12, "defaultRowHeight": 28, "formulaRenderEnabled": True, "formulaRenderMode": "blur-preview", "showFormulaHelp": True, "enableCellPreview": True, "rememberZoom": True},
    "notes": {"defaultNoteType": "核心结论", "autoLinkCurrentPaper": True, "autoLinkPdfPage": True, "markdownPreview": True, "formulaRender": True, "autoSaveIntervalSeconds": 10},
    "knowledgeGraph": {"defaultSource": "merged", "defaultGraphType": "paper-method", "defaultMaxNodes": 80, "labelStrategy": "core", "neuronLayout": True, "showAuthorNodes": False, "showYearNodes": True},
    "presentation": {"defaultStyle": "minimal-seminar", "defaultSlideCount": "10", "defaultLanguage": "zh-CN", "exportMarkdownOutline": True, "keepIntermediateJson": True, "extractOriginalFigures": True, "preferOriginalFigures": True, "extractKeyParagraphs": True, "defaultSpeakerName": "", "generateSpeakerNotes": True},
    "exportPaths": {"defaultExportPath": "", "pdfExportPath": "", "bilingualPdfExportPath": "", "translationJsonExportPath": "", "knowledgeGraphImageExportPath": "", "knowledgeGraphJsonExportPath": "", "notesExportPath": "", "researchSheetExportPath": "", "pptExportPath": "", "pptAssetCachePath": "", "askBeforeExport": True, "createFolderByPaperTitle": True, "createDateSubfolder": False},
    "layout": {"aiAssistantMainRatio": 0.68, "graphLeftWidth": 260, "graphRightWidth": 330, "pdfRightPanelWidth": 360},
}
STRATEGIES = ("keep-original", "translate-title", "skip")
BOUNDS = {"aiAssistantMainRatio": (0.56, 0.78, 0.68), "graphLeftWidth": (220, 340, 260), "graphRightWidth": (280, 440, 330), "pdfRightPanelWidth": (300, 520, 360)}
#: Fields of a record that a patch may set.
FIELDS = ("translationPath", "translationName", "chineseTitle", "englishTitle", "journal", "authors", "year", "notes", "lastOpenedAt")

CELLS = "array<struct<cellAddress:string,value:string>>"


def kind(v: Column, path: str = "$") -> Column:
    """The kind of what is at a path of a VARIANT, as Spark names it (STRING, BIGINT, OBJECT<...); null where nothing is."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text_at(v: Column, path: str) -> Column:
    """The text at a path; null for anything but a text."""
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def number_at(v: Column, path: str) -> Column:
    """The number at a path; null for anything but a number."""
    return F.when(kind(v, path).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|INT|SMALLINT|TINYINT)"), F.try_variant_get(v, path, "double"))


def canonical(text: Column) -> Column:
    """JSON without white space between its parts: two are one value, keys in one order, when these are equal."""
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|[ \t\r\n]+', "$1")


def cells_of(reply: Column) -> Column:
    """The cells of a reply, an object or a list of them: those with an address; values that are no texts are ''."""

    def cell(v: Column) -> Column:
        return F.struct(text_at(v, "$.cellAddress").alias("cellAddress"), F.coalesce(text_at(v, "$.value"), F.lit("")).alias("value"))

    def read(v: Column) -> Column:
        items = F.when(F.startswith(kind(v), F.lit("OBJECT")), F.array(v)).when(F.startswith(kind(v), F.lit("ARRAY")), F.try_variant_get(v, "$", "array<variant>"))
        named = F.filter(F.transform(items, cell), lambda c: T.nonempty(c["cellAddress"]).isNotNull())
        return F.coalesce(named, F.array().cast(CELLS))

    return T.let(F.try_parse_json(reply), read)


def unfenced(text: Column) -> Column:
    """A reply without white space around it and without the code fence around the whole of it."""
    return T.let(T.stripped(F.coalesce(text, F.lit(""))), lambda t: F.when(t.rlike(r"(?s)^```(?:json)?\s*.*?\s*```$"), T.stripped(F.regexp_extract(t, r"(?s)^```(?:json)?\s*(.*?)\s*```$", 1))).otherwise(t))


def answers(replies: DataFrame, cells: DataFrame) -> DataFrame:
    """(id, pos, cellAddress, value): what the reply to each request gives its cells.

    ``replies``: id, text; ``cells``: id, pos, cellAddress.  A request of one cell takes the
    first cell of the reply, or its whole text; of several, each takes the first cell with its
    address, or ''.
    """
    texts = replies.select("id", unfenced(F.col("text")).alias("text"))
    given = texts.select("id", F.posexplode(cells_of(F.col("text"))).alias("at", "c")).select("id", "at", "c.cellAddress", "c.value")
    by_address = given.groupBy("id", "cellAddress").agg(F.min_by("value", "at").alias("_own"))
    first = given.groupBy("id").agg(F.min_by("value", "at").alias("_first"))
    asked = cells.groupBy("id").agg(F.count("*").alias("_n"))
    rows = cells.join(asked, "id").join(texts, "id", "left").join(first, "id", "left").join(by_address, ["id", "cellAddress"], "left")
    one = F.coalesce("_first", "text", F.lit(""))
    return rows.select("id", "pos", "cellAddress", F.when(F.col("_n") == 1, one).otherwise(F.coalesce("_own", F.lit(""))).alias("value"))


def payload_text(payload: Column) -> Column:
    """The text in a provider's payload: its content or text, or those of its data; else the payload as it is."""

    def readable(v: Column, path: str) -> Column:
        number = F.when(kind(v, path).rlike("^(BIGINT|DOUBLE|DECIMAL|INT)"), F.try_variant_get(v, path, "string"))
        return F.coalesce(T.nonempty(T.stripped(text_at(v, path))), number)

    return T.let(F.try_parse_json(payload), lambda v: F.coalesce(*[readable(v, p) for p in ("$.content", "$.text", "$.data.content", "$.data.text")], payload))


def settings(raw: Column) -> Column:
    """Settings as a struct of maps (section to name to VARIANT): ``raw`` laid over ``DEFAULTS``.

    Names that the defaults don't have are kept.  The reference strategy must be one of
    ``STRATEGIES``; numbers of the layout are brought into their bounds, and what isn't a
    number there has its default.
    """

    def section(v: Column, name: str) -> Column:
        own = F.when(F.startswith(kind(v, f"$.{name}"), F.lit("OBJECT")), F.try_variant_get(v, f"$.{name}", "map<string,variant>"))
        own = F.coalesce(own, F.from_json(F.lit("{}"), "map<string,variant>"))
        plain = F.variant_get(F.parse_json(F.lit(json.dumps(DEFAULTS[name], ensure_ascii=False))), "$", "map<string,variant>")
        if name == "pdf":
            chosen = text_at(v, "$.pdf.referenceTranslationStrategy")
            strategy = F.when(chosen.isin(*STRATEGIES), chosen).otherwise(DEFAULTS["pdf"]["referenceTranslationStrategy"])
            own = over(own, F.create_map(F.lit("referenceTranslationStrategy"), F.to_variant_object(F.array(strategy))))
            own = F.transform_values(own, lambda k, x: F.when(k == "referenceTranslationStrategy", F.variant_get(x, "$[0]", "variant")).otherwise(x))
        if name == "layout":
            bounded = [F.when(number_at(v, f"$.layout.{k}").isNotNull(), F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), number_at(v, f"$.layout.{k}")))).otherwise(float(default)) for k, (least, most, default) in BOUNDS.items()]
            numbers = F.map_from_arrays(F.array(*[F.lit(k) for k in BOUNDS]), F.variant_get(F.to_variant_object(F.array(*bounded)), "$", "array<variant>"))
            own = over(own, numbers)
        return over(plain, own)

    def over(below: Column, above: Column) -> Column:
        return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(above, k)), above)

    return T.let(F.try_parse_json(raw), lambda v: F.struct(*[section(v, name).alias(name) for name in DEFAULTS]))


def setting(found: Column, section: str, name: str, kind_: str = "string") -> Column:
    """One of ``settings``, as a type; null where it can't be one."""
    return F.try_variant_get(F.try_element_at(found[section], F.lit(name)), "$", kind_)


def patched(papers: DataFrame, patches: DataFrame) -> DataFrame:
    """``papers`` (id, lastPage and any of ``FIELDS``) with ``patches`` (id, pos, patch as JSON) set field by field, the last by pos.

    A field that a patch doesn't name stays; lastPage is at least 1.
    """
    fields = [f for f in FIELDS if f in papers.columns]
    v = patches.withColumn("v", F.try_parse_json("patch")).filter(F.startswith(kind(F.col("v")), F.lit("OBJECT")))
    given = F.array(*[F.struct(F.lit(f).alias("k"), text_at(F.col("v"), f"$.{f}").alias("t"), F.lit(None).cast("double").alias("n")) for f in fields], F.struct(F.lit("lastPage").alias("k"), F.lit(None).cast("string").alias("t"), number_at(F.col("v"), "$.lastPage").alias("n")))
    rows = v.select("id", "pos", F.explode(given).alias("x")).select("id", "pos", "x.*").filter("t IS NOT NULL OR n IS NOT NULL")
    last = rows.groupBy("id", "k").agg(F.max_by(F.struct("t", "n"), "pos").alias("x"))
    wide = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("_p"))  # a row for each field at most
    of = lambda f: F.try_element_at("_p", F.lit(f))
    page = F.greatest(F.lit(1), F.coalesce(F.nullif(F.coalesce(of("lastPage")["n"].cast("int"), F.col("lastPage")), F.lit(0)), F.lit(1)))
    return papers.join(wide, "id", "left").withColumns({f: F.coalesce(of(f)["t"], f) for f in fields} | {"lastPage": page}).drop("_p")


def reply_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies about the lines of orders, in six states: a list, fenced, broken, of numbers, one object, with repeats."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("cellAddress"), F.col("l_returnflag").alias("value"), F.col("l_quantity").alias("q"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cellAddress", "value"))), lambda x: F.struct(x["cellAddress"].alias("cellAddress"), x["value"].alias("value")))
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("pos", "cellAddress", "q"))), lambda x: F.struct(x["cellAddress"].alias("cellAddress"), x["q"].alias("value")))
    g = rows.groupBy("id").agg(texts.alias("t"), numbers.alias("n")).select("id", F.to_json("t").alias("t"), F.to_json("n").alias("n"), F.to_json(F.element_at("t", 1)).alias("o"))
    k = F.col("id") % 6
    text = F.when(k == 0, F.col("t")).when(k == 1, F.concat(F.lit(" ```json\n"), "t", F.lit("\n```\n"))).when(k == 2, F.expr("substr(t, 1, length(t) - 1)")).when(k == 3, F.col("n")).when(k == 4, F.col("o")).otherwise(F.concat(F.lit("[null, 5, "), F.expr("substr(t, 2, length(t) - 2)"), F.lit(', {"cellAddress": "L1", "value": "again"}]')))
    return answers(g.select("id", text.alias("text")), rows.select("id", "pos", "cellAddress"))


def app_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of events: their props as a section, numbers in and out of bounds, wrong kinds, broken JSON."""
    e = table(spark, sf_dir, "events").select("event_id", F.coalesce("props", F.lit("{}")).alias("props"))
    n = F.col("event_id") % 100
    strategy = F.when(n % 3 == 0, '"skip"').when(n % 3 == 1, '"none"').otherwise("7")
    raw = F.concat(F.lit('{"general": '), "props", F.lit(', "notes": ['), n.cast("string"), F.lit('], "pdf": {"referenceTranslationStrategy": '), strategy, F.lit(', "defaultScale": 2}, "layout": {"graphLeftWidth": '), (n * 5).cast("string"), F.lit(', "graphRightWidth": "300", "other": null}'), F.when(n % 10 == 9, "").otherwise("}"))
    s = e.select("event_id", settings(raw).alias("s"))
    s_ = lambda *a: setting(F.col("s"), *a)
    return s.select(
        "event_id", s_("general", "k", "bigint").alias("k"), s_("general", "language").alias("language"), s_("notes", "autoSaveIntervalSeconds", "bigint").alias("seconds"), s_("pdf", "referenceTranslationStrategy").alias("strategy"), s_("pdf", "defaultScale", "bigint").alias("scale"),
        s_("layout", "graphLeftWidth", "bigint").alias("left_width"), s_("layout", "graphRightWidth", "bigint").alias("right_width"), F.size(F.col("s.layout")).alias("layout_names"), F.size(F.col("s.general")).alias("general_names"),
    )


def patched_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records, their lines as patches."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("journal"), F.col("o_orderstatus").alias("notes"), F.lit(0).alias("lastPage"))
    li = table(spark, sf_dir, "lineitem")
    n = F.col("l_linenumber")
    fields = F.struct(F.when(n % 2 == 1, F.col("l_returnflag")).alias("journal"), F.when(n % 3 == 0, n - 4).alias("lastPage"))
    return patched(o, li.select(F.col("l_orderkey").alias("id"), ((n.cast("long") * F.lit(10**9) + F.col("l_partkey")) * 128 + F.ascii("l_returnflag")).alias("pos"), F.when(n == 5, "{").otherwise(F.to_json(fields)).alias("patch"))).select("id", "journal", "notes", "lastPage")


QUERIES = {f.__name__: f for f in (reply_cells, app_settings, patched_papers)}
_BAD = "event_id % 10 = 9"
ORACLES = {
    "reply_cells": """WITH r AS (SELECT l_orderkey AS id, l_linenumber AS pos, 'L' || l_linenumber AS cellAddress, min(l_returnflag) OVER (PARTITION BY l_orderkey, l_linenumber) AS value, count(*) OVER (PARTITION BY l_orderkey) AS n, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first FROM lineitem)
        SELECT id, pos, cellAddress, CASE id % 6 WHEN 2 THEN CASE WHEN n = 1 THEN '[{"cellAddress":"' || cellAddress || '","value":"' || value || '"}' ELSE '' END WHEN 3 THEN '' WHEN 4 THEN CASE WHEN pos = first THEN value ELSE '' END ELSE value END AS value FROM r""",
    "app_settings": f"""SELECT event_id, CASE WHEN NOT {_BAD} THEN (coalesce(props, '{{}}')::JSON->>'$.k')::BIGINT END AS k, 'zh-CN' AS language, 10::BIGINT AS seconds, CASE WHEN NOT {_BAD} AND event_id % 100 % 3 = 0 THEN 'skip' ELSE 'keep-original' END AS strategy, CASE WHEN {_BAD} THEN 1 ELSE 2 END::BIGINT AS scale,
        CASE WHEN {_BAD} THEN 260 ELSE least(340, greatest(220, event_id % 100 * 5)) END::BIGINT AS left_width, 330::BIGINT AS right_width, CASE WHEN {_BAD} THEN 4 ELSE 5 END AS layout_names, 6 + CASE WHEN NOT {_BAD} THEN len(json_keys(coalesce(props, '{{}}'))) ELSE 0 END AS general_names FROM events""",
    "patched_papers": "WITH p AS (SELECT l_orderkey AS id, max_by(l_returnflag, (l_linenumber * 1000000000::BIGINT + l_partkey) * 128 + ascii(l_returnflag)) FILTER (WHERE l_linenumber % 2 = 1 AND l_linenumber <> 5) AS journal, max_by(l_linenumber - 4, l_linenumber) FILTER (WHERE l_linenumber % 3 = 0) AS page FROM lineitem GROUP BY l_orderkey) SELECT o_orderkey AS id, coalesce(p.journal, o_orderpriority) AS journal, o_orderstatus AS notes, greatest(1, coalesce(page, 0))::INT AS lastPage FROM orders LEFT JOIN p ON p.id = o_orderkey",
}
