"""Pages of positioned text: lines, reading order, paragraphs, and the outline of a document.

Input are runs of text with their places: doc, page, n (their order), str, x, y, width,
height, page_width, page_height.  Only two steps need state and run in Python, each over
one small group: lines are clustered per page, and paragraphs that go on are merged per
document.  All between is windows over (doc, page), which share one shuffle.

Defined cases: runs without visible text make no line; a page of no kept line has no
blocks; equal places are ordered by n; null page sizes stay null.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table

# Gaps and shares of a page by which runs, lines and paragraphs are told apart.
SAME_LINE, SAME_LINE_HEIGHTS = 4.0, 0.75
SEGMENT_GAP, COLUMN_GAP, COLUMN_WIDTH, NARROW_COLUMN, WIDE_RUN = 36.0, 8.0, 200.0, 120.0, 40.0
DRIFT, DRIFT_HEIGHTS = 2.0, 0.3
TWO_COLUMNS_FROM, EDGE, TALL = 220.0, 0.08, 4.0
GAP_MEDIANS, GAP_HEIGHTS, SHIFT, INDENT, DEFAULT_HEIGHT = 2.4, 1.75, 110.0, 6.0, 12.0
CHROME = r"(?i)^(doi:|https?://|www\.|[\w.-]+\.pdf$)"
SIDEBAR = r"\[[a-z-]+\.[A-Z]{2}\]"

#: Pages or documents that are worked on at once.
GROUPS_AT_ONCE = 64

LINE = "doc long, page long, line long, text string, x double, y double, height double, left double, top double, right double, bottom double, page_width double, page_height double"
BLOCK = "doc long, page long, pos long, kind string, section string, original string, left double, top double, right double, bottom double, page_width double, page_height double"


PART = BLOCK + ", ended boolean, lower boolean, head long, part long"
PART_COLUMNS = [c.split()[0] for c in PART.split(", ")][1:]


class Run(NamedTuple):
    x: float
    y: float
    width: float
    height: float
    n: int | None
    str: str
    page_width: float | None
    page_height: float | None


def same_line(y: float, first_y: float, first_height: float) -> bool:
    return abs(first_y - y) <= max(SAME_LINE, SAME_LINE_HEIGHTS * first_height)


def parted(before: Run, run: Run, start: float) -> bool:
    """Whether a run begins a new segment after the one before it; ``start`` is the segment's left."""
    end = before.x + before.width
    gap = run.x - end
    drifts = abs(before.y - run.y) > max(DRIFT, DRIFT_HEIGHTS * min(before.height, run.height))
    column = end - start > COLUMN_WIDTH or (end - start > NARROW_COLUMN and run.width > WIDE_RUN)
    return gap > SEGMENT_GAP or (gap > COLUMN_GAP and (drifts or column))


def _last_if_none(x: float | None) -> tuple[bool, float]:
    return (True, 0.0) if x is None or x != x else (False, x)


def clustered(page: dict) -> list[tuple]:
    """The lines of one page (doc, page, runs): runs of about one height, cut where gaps part columns."""
    runs = [Run(*[math.nan if r[c] is None else r[c] for c in ("x", "y", "width", "height")], r["n"], r["str"].strip(), r["page_width"], r["page_height"]) for r in page["runs"] if r["str"] and r["str"].strip()]
    groups: list[list[Run]] = []
    for run in sorted(runs, key=lambda r: (_last_if_none(r.y), _last_if_none(r.x), _last_if_none(r.n))):
        home = next((g for g in groups if same_line(run.y, g[0].y, g[0].height)), None)
        if home is None:
            groups.append([run])
        else:
            home.append(run)
    rows = []
    for group in groups:
        segments: list[list[Run]] = []
        for run in sorted(group, key=lambda r: r.x):
            if not segments or parted(segments[-1][-1], run, segments[-1][0].x):
                segments.append([run])
            else:
                segments[-1].append(run)
        for s in segments:
            size = next(((r.page_width, r.page_height) for r in s if r.page_width is not None), (None, None))
            places = (min(r.x for r in s), sum(r.y for r in s) / len(s), max(r.height for r in s), min(r.x for r in s), min(r.y for r in s), max(r.x + r.width for r in s), max(r.y + r.height for r in s))
            rows.append((page["doc"], page["page"], len(rows), " ".join(r.str for r in s), *[None if x != x else x for x in places], *size))
    return rows


def by_groups(groups: DataFrame, f, schema: str) -> DataFrame:
    """The rows that ``f`` gives for each row of ``groups``, some at a time; a frame for each group would cost more than its work."""
    fields = [c.split() for c in schema.split(", ")]
    types = {"long": "int64", "double": "float64", "string": "string", "boolean": "bool_"}

    def run(batches):
        out = pa.schema([(name, getattr(pa, types[kind])()) for name, kind in fields])
        for batch in batches:
            for at in range(0, batch.num_rows, GROUPS_AT_ONCE):
                rows = [r for g in batch.slice(at, GROUPS_AT_ONCE).to_pylist() for r in f(g)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    return groups.mapInArrow(run, schema)


def text_lines(runs: DataFrame) -> DataFrame:
    """The lines of every page, by ``clustered``; a row holds the runs of one page."""
    pages = runs.groupBy("doc", "page").agg(F.collect_list(F.struct("x", "y", "width", "height", "n", "str", "page_width", "page_height")).alias("runs"))
    return by_groups(pages, clustered, LINE).withColumn("text", T.extracted(F.col("text")))


def is_chrome() -> Column:
    """Page numbers and addresses at a page's edge, and marks at its side (``min_x`` ... stand in the row)."""
    band = EDGE * F.greatest(F.lit(1.0), F.col("max_y") - F.col("min_y"))
    edge = (F.col("y") <= F.col("min_y") + band) | (F.col("y") >= F.col("max_y") - band)
    side = F.col("x") <= F.col("min_x") + EDGE * F.greatest(F.lit(1.0), F.col("max_x") - F.col("min_x"))
    t = F.col("text")
    return (edge & (t.rlike(r"^\d{1,4}$") | t.rlike(CHROME))) | (side & ((F.col("height") >= TALL * F.col("median")) | t.rlike("(?i)^arxiv:") | t.rlike(SIDEBAR)))


def kept_lines(lines: DataFrame) -> DataFrame:
    """Lines that are content, in reading order (``pos``): left column first where a page has two."""
    page = W.partitionBy("doc", "page")
    named = lines.withColumns({"min_x": F.min("x").over(page), "max_x": F.max("right").over(page), "min_y": F.min("y").over(page), "max_y": F.max(F.col("y") + F.col("height")).over(page), "median": F.median("height").over(page)})
    some = named.filter((F.col("text") != "") & ~is_chrome())
    low, high = F.min("x").over(page), F.max("x").over(page)
    some = some.withColumns({"column": F.when((high - low >= TWO_COLUMNS_FROM) & (F.col("x") > (low + high) / 2), 1).otherwise(0), "median": F.median("height").over(page)})
    order = page.orderBy("column", "y", "x", "line")
    return some.withColumn("pos", F.row_number().over(order).cast("long")).drop("min_x", "max_x", "min_y", "max_y")


def page_blocks(lines: DataFrame) -> DataFrame:
    """Headings, captions, formulas and paragraphs of every page (``BLOCK``), from its kept lines.

    A paragraph ends before any other kind of line, a gap over the larger of 2.4 median
    heights and 1.75 of either line's, a shift over 110, or an indent after a sentence.
    """
    order = W.partitionBy("doc", "page").orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    t = F.col("text")
    skipped = T.is_epigraph(t) | T.is_attribution(t)
    kind = F.when((T.line_type(t) == "paragraph") & skipped, "skipped").otherwise(T.line_type(t))
    rows = lines.withColumn("kind", kind).withColumn("original", F.when(F.col("kind") == "heading", T.spaced_heading(t)).otherwise(T.stripped(t)))
    heading = (F.col("kind") == "heading") & T.is_included(F.col("kind"), F.col("original"))
    before = F.lag(F.struct("kind", "x", "y", "height", "text")).over(order)
    rows = rows.withColumns({
        "section": F.coalesce(F.last(F.when(heading, F.col("original")), ignorenulls=True).over(upto), F.concat(F.lit("Page "), F.col("page").cast("string"))),
        "abstract_y": F.first(F.when(F.lower(T.inline_section(t)) == "abstract", F.col("y")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)),
        "before": before,
    })
    gap = F.abs(F.col("y") - F.col("before.y")) > F.greatest(GAP_MEDIANS * F.col("median"), GAP_HEIGHTS * F.col("before.height"), GAP_HEIGHTS * F.col("height"))
    indent = (F.col("x") - F.col("before.x") > INDENT) & T.ends_sentence(F.col("before.text"))
    goes_on = (F.col("kind") == "paragraph") & (F.col("before.kind") == "paragraph") & ~gap & ~indent & (F.abs(F.col("x") - F.col("before.x")) <= SHIFT)
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(upto))
    box = [F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.first("page_width", ignorenulls=True).alias("page_width"), F.first("page_height", ignorenulls=True).alias("page_height")]
    text = T.joined_lines(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]))
    runs = rows.filter("kind <> 'skipped'").groupBy("doc", "page", "run", "kind", "section", "abstract_y").agg(F.min("pos").alias("pos"), text.alias("joined"), F.min("original").alias("line_text"), F.min("y").alias("first_y"), *box)
    named = T.inline_section(F.col("joined"))
    paragraph = F.col("kind") == "paragraph"
    early = (F.col("page") == 1) & named.isNull() & (F.col("section") == "Page 1") & F.coalesce(F.col("first_y") < F.col("abstract_y"), F.lit(False))
    blocks = runs.withColumns({
        "original": F.when(paragraph & named.isNotNull(), T.inline_body(F.col("joined"))).when(paragraph, F.col("joined")).otherwise(F.col("line_text")),
        "own": F.when(paragraph, F.coalesce(named, F.col("section"))).when(F.col("kind") == "heading", F.col("line_text")).otherwise(F.col("section")),
        "early": paragraph & early,
    })
    some = blocks.filter(T.is_included(F.col("kind"), F.col("original")) & ~F.col("early"))
    return some.select("doc", "page", "pos", "kind", F.col("own").alias("section"), "original", "left", "top", "right", "bottom", "page_width", "page_height")


def _goes_on(before: dict, block: dict) -> bool:
    """Whether a paragraph continues the one before it, in a section or from page to page."""
    if before["kind"] != "paragraph" or before["section"] != block["section"]:
        return False
    if before["page"] == block["page"] and not _is_default(before["section"]):
        return not before["ended"]
    return block["page"] == before["page"] + 1 and block["lower"]


def _is_default(section: str) -> bool:
    return section.startswith("Page ") and section[5:].strip().isdigit()


def merged(document: dict) -> list[tuple]:
    """One document's blocks: sections handed on over pages, and the head of each run of continued paragraphs.

    Adds ``section`` as handed on and ``head``, the number of the block that this one is part of.
    """
    section, last, out = None, None, []
    for i, b in enumerate(sorted(document["blocks"], key=lambda b: (b["page"], b["pos"]))):
        if b["kind"] == "heading":
            section = b["section"] or b["original"]
        if b["kind"] == "paragraph" and section and _is_default(b["section"]):
            b["section"] = section
        if b["kind"] == "paragraph" and last is not None and _goes_on(last, b):
            last["ended"] = b["ended"]  # it keeps its first page
            b["head"] = last["head"]
        else:
            last = {**b, "head": i}
            b["head"] = i
            if b["kind"] == "paragraph" and not _is_default(b["section"]):
                section = b["section"]
        b["part"] = i
        out.append((document["doc"], *[b[c] for c in PART_COLUMNS]))
    return out


def document_blocks(blocks: DataFrame) -> DataFrame:
    """The blocks of whole documents: continued paragraphs joined, sections numbered in order of appearance."""
    first_letter = F.regexp_extract("original", r"\p{L}", 0)
    ready = blocks.withColumns({"ended": T.ends_sentence(F.col("original")), "lower": (first_letter != "") & (first_letter == F.lower(first_letter)) & (first_letter != F.upper(first_letter))})
    documents = ready.groupBy("doc").agg(F.collect_list(F.struct(*PART_COLUMNS[:-2])).alias("blocks"))
    parts = by_groups(documents, merged, PART)
    first = F.min_by(F.struct("page", "kind", "section"), "part")
    lines = T.joined_lines(F.transform(F.array_sort(F.collect_list(F.struct("part", "original"))), lambda x: x["original"]))
    whole = parts.groupBy("doc", "head").agg(first.alias("b"), lines.alias("joined"), F.min("original").alias("one"), F.count("*").alias("n"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"))
    rows = whole.select("doc", "head", "b.*", F.when(F.col("n") > 1, F.col("joined")).otherwise(F.col("one")).alias("original"), "left", "top", F.greatest(F.lit(1.0), F.col("right") - F.col("left")).alias("width"), F.greatest(F.lit(1.0), F.col("bottom") - F.col("top")).alias("height"))
    doc = W.partitionBy("doc")
    key = F.coalesce(T.nonempty(T.stripped(F.coalesce(T.nonempty(F.col("section")), F.col("original")))), F.lit("Untitled"))
    rows = rows.withColumn("key", key).withColumn("_first", F.min("head").over(W.partitionBy("doc", "key")))
    rows = rows.withColumn("section_order", F.dense_rank().over(doc.orderBy("_first")).cast("long"))
    inside = W.partitionBy("doc", "key").orderBy("head").rowsBetween(W.unboundedPreceding, W.currentRow)
    paragraph = F.col("kind") == "paragraph"
    source = F.concat_ws("|", F.col("page").cast("string"), "kind", "section", "original")
    return rows.select(
        "doc", F.row_number().over(doc.orderBy("head")).cast("long").alias("pos"), "page", "kind", "section", "original", "left", "top", "width", "height",
        F.concat(F.lit("pdf-"), F.col("page").cast("string"), F.lit("-"), T.fnv36(source)).alias("id"),
        F.concat(F.lit("section-"), F.col("section_order").cast("string"), F.lit("-"), T.fnv36(F.col("key"))).alias("section_id"), "section_order",
        F.when(paragraph, F.sum(paragraph.cast("long")).over(inside)).alias("paragraph_order"),
    )


def outline(runs: DataFrame) -> DataFrame:
    """The blocks of every document of positioned runs."""
    return document_blocks(page_blocks(kept_lines(text_lines(runs))))


def document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents set in type: 40 lines a page in two columns, eight words a run, page numbers below."""
    from .lines import lines

    words = lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", F.posexplode(F.split(F.col("t"), " ")).alias("w", "word"))
    line = F.col("pos") * 1000 + F.floor(F.col("w") / 8)
    rows = words.withColumn("key", line).groupBy("doc_id", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("w", "word"))), lambda x: x["word"]), " ").alias("str"))
    k = F.row_number().over(W.partitionBy("doc_id").orderBy("key")) - 1
    placed = rows.withColumn("k", k).withColumns({"page": F.floor(F.col("k") / 40) + 1, "slot": F.col("k") % 40})
    run = placed.select(
        F.col("doc_id").alias("doc"), F.col("page").cast("long").alias("page"), F.col("slot").cast("long").alias("n"), "str", F.when(F.col("slot") < 20, 40.0).otherwise(320.0).alias("x"),
        (60.0 + 14.0 * (F.col("slot") % 20)).alias("y"), F.lit(230.0).alias("width"), F.lit(10.0).alias("height"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"),
    )
    foot = run.select("doc", "page").distinct().select("doc", "page", F.lit(99).cast("long").alias("n"), F.col("page").cast("string").alias("str"), F.lit(290.0).alias("x"), F.lit(780.0).alias("y"), F.lit(12.0).alias("width"), F.lit(9.0).alias("height"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    return run.unionByName(foot)


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept lines of documents set in type, in reading order."""
    return kept_lines(text_lines(document_runs(spark, sf_dir))).select("doc", "page", "pos", F.col("column").cast("long").alias("side"), "x", "y", F.length("text").cast("long").alias("n"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of every page by its runs in order, under its number, and of the document."""
    runs = document_runs(spark, sf_dir).filter("n < 99")
    page = runs.groupBy("doc", "page").agg(F.trim(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "str"))), lambda x: x["str"]), " "), r"\s+", " ")).alias("t"))
    named = page.filter("t <> ''").select("doc", "page", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit("\n"), F.col("t")).alias("t"))
    return named.groupBy("doc").agg(F.count("*").alias("pages"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\n\n")).alias("digest"))


def page_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outline of documents set in type."""
    return outline(document_runs(spark, sf_dir))


_RUNS = """w AS (SELECT doc_id, pos, g - 1 AS w, string_split(t, ' ')[g] AS word FROM {lines}, LATERAL (SELECT unnest(range(1, len(string_split(t, ' ')) + 1)) AS g)),
l AS (SELECT doc_id, pos * 1000 + w // 8 AS key, string_agg(word, ' ' ORDER BY w) AS str FROM w GROUP BY ALL),
k AS (SELECT doc_id AS doc, str, row_number() OVER (PARTITION BY doc_id ORDER BY key) - 1 AS k FROM l),
r AS (SELECT doc, k // 40 + 1 AS page, k % 40 AS n, str FROM k)"""


def _oracles() -> dict[str, str]:
    from .lines import LINES

    runs = _RUNS.format(lines=LINES)
    return {
        "page_text": rf"WITH {runs}, p AS (SELECT doc, page, trim(regexp_replace(string_agg(str, ' ' ORDER BY n), '\s+', ' ', 'g'), ' ') AS t FROM r GROUP BY ALL) SELECT doc, count(*) AS pages, md5(string_agg('Page ' || page || chr(10) || t, chr(10) || chr(10) ORDER BY page)) AS digest FROM p WHERE t <> '' GROUP BY doc",
        "page_lines": rf"WITH {runs}, s AS (SELECT doc, page, n, trim(regexp_replace(str, '\s+', ' ', 'g'), ' ') AS t FROM r), v AS (SELECT * FROM s WHERE t <> ''), m AS (SELECT *, n >= 20 AS right_, bool_and(n >= 20) OVER (PARTITION BY doc, page) AS only_right FROM v) SELECT doc, page, row_number() OVER (PARTITION BY doc, page ORDER BY n)::BIGINT AS pos, (CASE WHEN right_ AND NOT only_right THEN 1 ELSE 0 END)::BIGINT AS side, CASE WHEN right_ THEN 320.0 ELSE 40.0 END::DOUBLE AS x, (60 + 14 * (n % 20))::DOUBLE AS y, length(t)::BIGINT AS n FROM m",
    }


QUERIES = {f.__name__: f for f in (page_lines, page_text, page_outline)}
ORACLES = _oracles()
