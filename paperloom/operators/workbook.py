"""Research workbooks: sheets from JSON, rows as fields, rows and papers as entries of a graph.

A row of a sheet is (book, pos, row_id, cells), cells being an array as long as the sheet
has columns; row 0 is the header.  Fields are found by the default labels of their places,
whatever the header says.

Defined cases: no workbook, one that can't be read, or one without rows is a header of the
default labels; rows without an id go; short rows are filled with '' and long ones cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored, table
from . import graph
from .library import a1, first_by

#: The labels of the default columns, and those that fields go by, in order of preference.
LABELS = ("论文", "中文标题", "英文标题", "创新点", "局限点", "方法", "数据/任务", "指标/结果", "复现计划", "后续 idea", "备注")
ALIASES = {
    "chinese_title": ("中文标题", "题名", "标题", "Chinese Title"),
    "english_title": ("英文标题", "English Title", "Title"),
    "authors": ("作者", "Authors", "Author"),
    "year": ("年份", "Year"),
    "venue": ("期刊/会议", "期刊", "会议", "来源", "Journal", "Conference", "Venue"),
    "keywords": ("关键词", "关键字", "Keywords", "Keyword"),
    "methods": ("方法", "研究方法", "算法", "RL算法", "PINN融合方式", "Method", "Algorithm"),
    "scenes": ("研究场景", "场景", "环境类型", "任务", "应用场景", "Scenario", "Environment", "Task"),
    "metrics": ("评价指标", "指标/结果", "指标", "结果", "Metrics", "Result"),
    "limitations": ("局限点", "局限性", "未来方向", "疑问", "Limitations", "Future Work"),
}
PAPER_COLUMNS = ("id", "pdfName", "chineseTitle", "englishTitle", "journal", "authors", "year", "notes")
CELL = "struct<v:string,f:string,s:string>"
WORKBOOK = (
    "id string, sheetName string, columns array<struct<key:string,label:string>>, rows array<struct<id:string,cells:array<struct<value:string>>>>, "
    f"snapshot struct<name:string,sheetOrder:array<string>,sheets:map<string,struct<name:string,cellData:map<string,map<string,{CELL}>>,columnData:map<string,string>,rowData:map<string,struct<h:double,rowId:string>>>>>"
)


#: Nodes of a graph that is looked at as a whole.
WIDE_VIEW = 20_000


def _default_row() -> Column:
    return F.struct(F.lit("header").alias("id"), F.array(*[F.lit(x) for x in LABELS]).alias("cells"))


def _listed_rows(book: Column) -> Column:
    """Rows of a workbook stored as rows and columns, with their header."""
    named = F.filter(book["columns"], lambda c: F.coalesce(c["label"], F.lit("")) != "")
    default = F.array(*[F.lit(x) for x in LABELS])
    value = lambda c: F.coalesce(c["value"], F.lit(""))
    none = F.array().cast("array<struct<id:string,cells:array<string>>>")

    def whole(labels: Column) -> Column:
        n = F.size(labels)
        blanks = F.array_repeat(F.lit(""), n)
        padded = lambda r: F.slice(F.concat(F.coalesce(F.transform(r["cells"], value), F.array().cast("array<string>")), blanks), F.lit(1), n)
        rows = F.transform(F.filter(book["rows"], lambda r: F.coalesce(r["id"], F.lit("")) != ""), lambda r: F.struct(r["id"].alias("id"), padded(r).alias("cells")))
        header = F.array(F.struct(F.lit("header").alias("id"), labels.alias("cells")))
        return T.let(F.coalesce(rows, none), lambda some: F.when(F.coalesce(F.try_element_at(some, F.lit(1))["id"] == "header", F.lit(False)), some).otherwise(F.concat(header, some)))

    return T.let(F.when(F.size(named) > 0, F.transform(named, lambda c: c["label"])).otherwise(default), whole)


def _text(cell: Column) -> Column:
    """A cell's formula, else its value."""
    return F.coalesce(T.nonempty(cell["f"]), cell["v"], F.lit(""))


def _snapshot_rows(sheet: Column, row_id: str) -> Column:
    """Rows of a sheet stored sparsely, up to the last that has a text, a style, a height or an id."""
    grid = F.coalesce(sheet["cellData"], F.create_map().cast(f"map<string,map<string,{CELL}>>"))
    meta = F.coalesce(sheet["rowData"], F.create_map().cast(f"map<string,struct<h:double,`{row_id}`:string>>"))
    number = lambda keys: F.transform(F.filter(keys, lambda k: k.rlike(r"^\d{1,7}$")), lambda k: k.cast("int"))
    used = lambda c: (F.trim(_text(c)) != "") | c["s"].isNotNull()
    used_columns = F.flatten(F.transform(F.map_values(grid), lambda row: F.map_keys(F.map_filter(row, lambda _, c: used(c)))))
    widest = F.coalesce(F.array_max(F.concat(number(used_columns), number(F.coalesce(F.map_keys(sheet["columnData"]), F.array().cast("array<string>"))))), F.lit(-1))
    n = F.greatest(F.lit(len(LABELS)), widest + 1)
    used_rows = F.map_keys(F.map_filter(grid, lambda _, row: F.exists(F.map_values(row), used)))
    last = F.coalesce(F.array_max(F.concat(number(used_rows), number(F.map_keys(F.map_filter(meta, lambda _, m: m["h"].isNotNull() | (F.coalesce(m[row_id], F.lit("")) != "")))))), F.lit(0))

    def row(r: Column) -> Column:
        key = r.cast("string")
        name = F.coalesce(T.nonempty(F.try_element_at(meta, key)[row_id]), F.when(r == 0, "header").otherwise(F.concat(F.lit("row-"), key)))
        cells = F.transform(F.sequence(F.lit(0), n - 1), lambda c: _text(F.try_element_at(F.try_element_at(grid, key), c.cast("string"))))
        return F.struct(name.alias("id"), cells.alias("cells"))

    return F.transform(F.sequence(F.lit(0), last), row)


def sheet_rows(books: DataFrame, column: str = "value", snapshot: str = "snapshot", row_id: str = "rowId") -> DataFrame:
    """(book, pos, row_id, cells) of the first sheet of every workbook; ``books``: book and JSON text.

    ``snapshot`` and ``row_id`` are the names under which a sparse copy and its row ids are stored.
    """
    schema = WORKBOOK.replace("snapshot struct", f"`{snapshot}` struct").replace("rowId:", f"`{row_id}`:")
    parsed = books.select("book", F.from_json(F.col(column), schema).alias("w"))
    sheet = F.try_element_at(F.col(f"w.{snapshot}.sheets"), F.try_element_at(F.col(f"w.{snapshot}.sheetOrder"), F.lit(1)))
    rows = F.when(sheet.isNotNull(), _snapshot_rows(sheet, row_id)).when(F.col("w").isNotNull(), _listed_rows(F.col("w"))).otherwise(F.array(_default_row()))
    return parsed.select("book", F.posexplode(rows).alias("pos", "r")).select("book", "pos", F.col("r.id").alias("row_id"), "r.cells")


def cell_rows(rows: DataFrame) -> DataFrame:
    """The sparse form: one row for each cell with a text, with its address."""
    cells = rows.select("book", F.col("pos").alias("r"), F.posexplode("cells").alias("c", "value")).filter("value <> ''")
    return cells.withColumn("address", a1(F.col("r"), F.col("c")))


def dense_rows(cells: DataFrame, columns: Column) -> DataFrame:
    """The dense form of (book, r, c, value): arrays of ``columns`` cells for every used row."""
    by_column = F.map_from_entries(F.collect_list(F.struct("c", "value")))
    grouped = cells.groupBy("book", "r").agg(by_column.alias("m"))
    return grouped.select("book", F.col("r").alias("pos"), F.transform(F.sequence(F.lit(0), columns - 1), lambda c: F.coalesce(F.try_element_at("m", c.cast("int")), F.lit(""))).alias("cells"))


def is_filled(cells: Column) -> Column:
    return F.exists(cells, lambda v: F.trim(v) != "")


def cell(label: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("cells"), F.lit(LABELS.index(label) + 1)), F.lit(""))


def row_values() -> Column:
    """The row's cells by the default labels."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in LABELS]), F.transform(F.sequence(F.lit(1), F.lit(len(LABELS))), lambda i: F.coalesce(F.try_element_at(F.col("cells"), i), F.lit(""))))


def _key(label: str) -> str:
    return re.sub(r"[\s:：]+", "", label.lower())


def places(field: str) -> list[str]:
    """The labels under which a field is looked up, in order: by alias the equal one, then the first that contains it."""
    found = []
    for alias in map(_key, ALIASES[field]):
        found += [x for x in LABELS if _key(x) == alias][:1] + [x for x in LABELS if alias in _key(x)][:1]
    return list(dict.fromkeys(found))


def picked(field: str) -> Column:
    """A field of the row: the first of its places with a text.  Labels are fixed, so places are known beforehand."""
    return F.coalesce(*[T.nonempty(T.stripped(cell(x))) for x in places(field)], F.lit(""))


def entries(rows: DataFrame, links: DataFrame, papers: DataFrame, source: str = "merged") -> DataFrame:
    """Papers as the graph takes them: those of rows (with the paper linked to the row), then those of the library.

    ``links``: row_id, paper_id, pos (the first of a row counts); ``papers``: ``PAPER_COLUMNS`` and pos.
    ``source``: workbook, library or merged.
    """
    p = papers.select(*[F.coalesce(c, F.lit("")).alias(f"p_{c}") for c in PAPER_COLUMNS], F.col("pos").alias("p_pos"))
    one = first_by(links.select("row_id", "paper_id", "pos"), ["row_id"], ["pos"]).select("row_id", "paper_id")
    joined = rows.filter("pos > 0").join(one, "row_id", "left").join(p, F.col("paper_id") == F.col("p_id"), "left")
    first = F.coalesce(F.try_element_at("cells", F.lit(1)), F.lit(""))
    r = T.first_readable
    both = {"authors": "p_authors", "year": "p_year", "venue": "p_journal"}
    named = joined.select(
        F.coalesce("p_id", F.concat(F.lit("row:"), "row_id")).alias("paper"), "row_id", F.col("pos").cast("long").alias("entry_pos"),
        r(picked("chinese_title"), F.col("p_chineseTitle"), first).alias("chinese_title"), r(picked("english_title"), F.col("p_englishTitle")).alias("english_title"), F.col("p_pdfName").alias("pdf_name"), first.alias("first"),
        *[r(picked(c), *([F.col(both[c])] if c in both else [])).alias(c) for c in ("authors", "year", "venue", "keywords", "methods", "scenes", "metrics", "limitations")],
    )
    titled = named.withColumn("title", r(F.col("chinese_title"), F.col("english_title"), F.col("pdf_name"), F.col("first"))).filter("title <> ''").drop("pdf_name", "first")
    if source == "workbook":
        return titled
    # A paper of the library that no row stands for; notes give its methods and limitations.
    alone = p if source == "library" else p.join(titled.select(F.col("paper").alias("p_id")), "p_id", "left_anti")
    text = lambda c: r(F.col(c))
    library = alone.select(
        F.col("p_id").alias("paper"), F.lit("").alias("row_id"), (F.col("p_pos") + (1 << 40)).cast("long").alias("entry_pos"), text("p_chineseTitle").alias("chinese_title"), text("p_englishTitle").alias("english_title"),
        text("p_authors").alias("authors"), text("p_year").alias("year"), text("p_journal").alias("venue"), F.lit("").alias("keywords"), F.col("p_notes").alias("methods"), F.lit("").alias("scenes"), F.lit("").alias("metrics"), F.col("p_notes").alias("limitations"),
        r(F.col("p_chineseTitle"), F.col("p_englishTitle"), F.col("p_pdfName")).alias("title"),
    )
    return library if source == "library" else titled.unionByName(library)


def mentions(found: DataFrame) -> DataFrame:
    """The values of ``entries`` as rows of ``graph``: paper, entry_pos, row_id, type, ord, value, node; papers are values of themselves."""
    v = lambda c: T.values_of(F.col(c))
    lists = found.select(
        "paper", "entry_pos", "row_id", "title", T.people_of(F.col("authors")).alias("author"), v("year").alias("year"), v("venue").alias("venue"), v("keywords").alias("keyword"),
        T.methods_of(F.col("methods"), F.col("keywords"), F.col("english_title"), F.col("chinese_title")).alias("method"), v("scenes").alias("scene"), v("metrics").alias("metric"), v("limitations").alias("limitation"),
    )
    values = graph.fan_out(lists, ["row_id"])
    own = lists.select("paper", "entry_pos", "row_id", F.lit(-1).alias("type_pos"), F.lit("paper").alias("type"), F.lit(0).alias("ord"), F.col("title").alias("value"), F.concat(F.lit("paper:"), "paper").alias("node"))
    return own.unionByName(values.select(*own.columns))


def graph_of(found: DataFrame, most: int = 120) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, stats) of the graph of ``entries``, cut to its ``most`` first nodes.

    The cut comes before pairs are made: at most ``most`` nodes are broadcast, and only their
    mentions meet.  Every entry has one mention of itself, so papers are counted without their values.
    """
    rows = stored(mentions(found), "mentions")  # read by every part below
    first = F.min(F.struct("entry_pos", "type_pos", "ord", "value"))["value"]
    every = rows.groupBy("node", "type").agg(first.alias("label"), F.count("*").alias("count"), F.countDistinct("paper").alias("papers"))
    nodes = stored(graph.top_nodes(every, most), "nodes")  # read by five parts below
    some = rows.join(F.broadcast(nodes.select("node")), "node", "left_semi")
    held = some.filter("type = 'paper'").select("paper").distinct()
    edges = graph.value_edges(some.filter("type <> 'paper'").join(held, "paper", "left_semi"))
    edges = edges.unionByName(graph.co_occurrence(some, "method", graph.CO_METHOD)).unionByName(graph.co_occurrence(some, "keyword", graph.CO_KEYWORD))
    top = lambda kind: nodes.filter(F.col("type") == kind).orderBy(F.desc("count"), "label").limit(6).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "label"))), lambda x: x["label"]), "; ").alias(f"top_{kind}s"))
    counts = rows.filter("type = 'paper'").agg(F.count("*").alias("papers")).crossJoin(nodes.agg(F.count("*").alias("nodes"))).crossJoin(edges.agg(F.count("*").alias("edges")))
    return nodes, edges, counts.crossJoin(top("keyword")).crossJoin(top("method"))  # one row each


def related_papers(rows: DataFrame, papers: DataFrame) -> DataFrame:
    """The papers of every node, in order; papers that the library lacks go."""
    met = rows.filter("type <> 'paper'").groupBy("node", "paper").agg(F.min("entry_pos").alias("pos"))
    return met.join(papers.select(F.col("id").alias("paper"), "englishTitle"), "paper").select("node", "pos", "paper", "englishTitle")


def ensured_rows(rows: DataFrame, links: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, links) in which each of ``papers`` (of one book, with pos) has a row: its linked one, or a new one at the end.

    A link to a row that isn't there, or to the header, counts for nothing and is replaced.
    """
    from pyspark.sql import Window as W

    good = links.join(rows.filter("pos > 0").select("book", "row_id"), ["book", "row_id"], "left_semi")
    lacking = papers.join(good.select("book", F.col("paper_id").alias("id")).distinct(), ["book", "id"], "left_anti")
    size = rows.groupBy("book").agg((F.max("pos") + 1).alias("size"), F.max(F.size("cells")).alias("n"))
    at = F.greatest(F.lit(1), F.col("size")) + F.row_number().over(W.partitionBy("book").orderBy("pos", "id")) - 1
    placed = lacking.join(size, "book").withColumn("at", at)
    value = {"论文": F.coalesce(T.nonempty(F.col("pdfName")), F.col("englishTitle")), "中文标题": F.col("chineseTitle"), "英文标题": F.col("englishTitle"), "备注": F.col("notes")}
    own = F.array(*[F.coalesce(value.get(x, F.lit("")), F.lit("")) for x in LABELS])
    cells = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.coalesce(F.try_element_at(own, i), F.lit("")))
    new = placed.select("book", F.col("at").cast("int").alias("pos"), F.concat(F.lit("row-"), F.col("at").cast("string")).alias("row_id"), cells.alias("cells"), "id")
    kept = links.join(new.select("book", F.col("id").alias("paper_id")), ["book", "paper_id"], "left_anti").join(new.select("book", "row_id"), ["book", "row_id"], "left_anti")
    return rows.select("book", "pos", "row_id", "cells").unionByName(new.drop("id")), kept.select("book", "row_id", "paper_id").unionByName(new.select("book", "row_id", F.col("id").alias("paper_id")))


def filled(rows: DataFrame, legacy: DataFrame) -> DataFrame:
    """``rows`` with the cells of ``legacy`` (book, row_id, label, value) where they are blank."""
    known = legacy.filter(F.col("label").isin(*LABELS) & (F.coalesce("value", F.lit("")) != ""))
    maps = known.groupBy("book", "row_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "value"))).alias("m"))
    labels = F.array(*[F.lit(x) for x in LABELS])
    cells = F.transform("cells", lambda v, i: F.when(v == "", F.coalesce(F.try_element_at("m", F.try_element_at(labels, i + 1)), v)).otherwise(v))
    return rows.join(maps, ["book", "row_id"], "left").select("book", "pos", "row_id", F.when(F.col("m").isNotNull(), cells).otherwise(F.col("cells")).alias("cells"))


def unique_names(taken: Column, new: Column) -> Column:
    """``new`` names made distinct from ``taken`` and from each other: the first free of name, name (2), name (3)..."""

    def free(name: Column, used: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(2), F.size(used) + 2), lambda k: F.concat(name, F.lit(" ("), k.cast("string"), F.lit(")")))
        return F.when(F.array_contains(used, name), F.filter(tries, lambda x: ~F.array_contains(used, x))[0]).otherwise(name)

    every = F.aggregate(new, taken, lambda used, name: F.array_append(used, free(name, used)))
    return F.slice(every, F.size(taken) + 1, F.greatest(F.lit(1), F.size(new)))


def row_paper() -> Column:
    """A paper record made up from a row."""
    fallback = F.concat(F.lit("表格第 "), (F.col("pos") + 1).cast("string"), F.lit(" 行"))
    name = F.coalesce(T.nonempty(cell("论文")), fallback)
    return F.struct(F.concat(F.lit("sheet-row-"), F.col("pos").cast("string")).alias("id"), name.alias("pdfName"), cell("中文标题").alias("chineseTitle"), F.coalesce(T.nonempty(cell("英文标题")), name).alias("englishTitle"), cell("备注").alias("notes"), F.lit(1).alias("lastPage"))


def selected_cells(ranges: DataFrame) -> DataFrame:
    """Distinct cells of ``ranges`` (sheet, r1, c1, r2, c2), without the header row."""
    rows = ranges.select("sheet", "c1", "c2", F.explode(F.sequence("r1", "r2")).alias("r")).filter("r > 0")
    return rows.select("sheet", "r", F.explode(F.sequence("c1", "c2")).alias("c")).distinct()


# -- queries over stand-in tables ------------------------------------------------------------


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey").cast("string")
    return joined.select(key.alias("id"), F.concat(F.lit("p"), key).alias("pdfName"), F.lit("").alias("chineseTitle"), F.concat(F.lit("Paper "), key).alias("englishTitle"), F.col("o_orderpriority").alias("journal"), F.col("c_name").alias("authors"), F.year("o_orderdate").cast("string").alias("year"), F.lit("").alias("notes"), F.col("o_orderkey").alias("pos"))


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines as rows of workbooks of up to 1,000 rows, in JSON."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    items = l.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("part"), "p_type"))).alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda x: x[c]), "; ")
    key = F.col("l_orderkey").cast("string")
    texts = {0: F.concat(F.lit("name "), key), 2: F.concat(F.lit("Order "), key), 5: joined("part"), 6: joined("p_type")}
    row = F.struct(F.concat(F.lit("row-"), key).alias("id"), F.array(*[F.struct(texts.get(i, F.lit("")).alias("value")) for i in range(7)]).alias("cells"))
    rows = items.select(F.floor(F.col("l_orderkey") / 1000).alias("book"), F.struct(F.col("l_orderkey").alias("k"), row.alias("r")).alias("s"))
    return rows.groupBy("book").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["r"]).alias("rows"))).alias("value"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of orders that are done are linked to their papers."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return o.select(F.concat(F.lit("row-"), F.col("o_orderkey").cast("string")).alias("row_id"), F.col("o_orderkey").cast("string").alias("paper_id"), F.col("o_orderkey").alias("pos"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sheet_rows(_books(spark, sf_dir)).withColumn("pos", F.when(F.col("row_id") == "header", 0).otherwise(F.regexp_extract("row_id", r"\d+", 0).cast("long") + 1))
    return entries(rows, _links(spark, sf_dir), _papers(spark, sf_dir))


def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of workbooks read from JSON, padded to the default columns."""
    return sheet_rows(_books(spark, sf_dir)).select("book", F.col("pos").cast("long").alias("pos"), "row_id", F.size("cells").cast("long").alias("n_cells"), F.array_join("cells", "|").alias("cells"))


def workbook_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of rows by their aliases, and the row as a paper of its own."""
    rows = sheet_rows(_books(spark, sf_dir)).filter("pos > 0").filter(is_filled(F.col("cells")))
    return rows.select("row_id", picked("english_title").alias("english_title"), picked("methods").alias("methods"), picked("scenes").alias("scenes"), picked("authors").alias("authors"), F.size(row_values()).cast("long").alias("n_labels"), row_paper()["englishTitle"].alias("paper_title"))


def workbook_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with a text, with their addresses."""
    return cell_rows(sheet_rows(_books(spark, sf_dir))).select("book", "address", F.length("value").cast("long").alias("n"))


def workbook_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir).select("paper", "row_id", "title", "authors", "year", "venue", F.length("methods").cast("long").alias("n_methods"), F.length("scenes").cast("long").alias("n_scenes"))


def workbook_graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the graph of rows, links and library, without a cut."""
    rows = mentions(_entries(spark, sf_dir))
    return rows.groupBy("node", "type").agg(F.count("*").alias("count"), F.countDistinct("paper").alias("papers"))


def workbook_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from papers to their values."""
    return graph.value_edges(mentions(_entries(spark, sf_dir)).filter("type <> 'paper'"))


def workbook_graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and top labels of the graph cut to its 20,000 first nodes."""
    return graph_of(_entries(spark, sf_dir), WIDE_VIEW)[2]


def workbook_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of the library by node."""
    return related_papers(mentions(_entries(spark, sf_dir)), _papers(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("n"), F.min_by("paper", "pos").alias("first_paper"))


def selected_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as selections of a supplier's sheet: distinct cells, and cells with overlaps counted twice."""
    l = table(spark, sf_dir, "lineitem")
    r1, c1 = F.col("l_partkey") % 50, F.col("l_linenumber").cast("long")
    ranges = l.select(F.col("l_suppkey").alias("sheet"), r1.alias("r1"), c1.alias("c1"), (r1 + F.col("l_orderkey") % 3).alias("r2"), (c1 + F.col("l_orderkey") % 2).alias("c2"))
    counted = ranges.groupBy("sheet").agg(F.sum((F.col("r2") - F.col("r1") + 1) * (F.col("c2") - F.col("c1") + 1)).alias("counted"))
    return counted.join(selected_cells(ranges).groupBy("sheet").agg(F.count("*").alias("cells")), "sheet", "left").select("sheet", "counted", F.coalesce("cells", F.lit(0)).alias("cells"))


_BASE = """it AS (SELECT l_orderkey AS k, string_agg('part ' || p_partkey, '; ' ORDER BY l_linenumber, 'part ' || p_partkey, p_type) AS parts, string_agg(p_type, '; ' ORDER BY l_linenumber, 'part ' || p_partkey, p_type) AS types, list({'n': l_linenumber, 'part': 'part ' || p_partkey, 'type': p_type} ORDER BY l_linenumber, 'part ' || p_partkey, p_type) AS xs FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
pp AS (SELECT o_orderkey AS k, c_name AS authors, year(o_orderdate)::VARCHAR AS year, o_orderpriority AS venue, o_orderstatus = 'F' AS linked FROM orders JOIN customer ON o_custkey = c_custkey),
en AS (SELECT CASE WHEN pp.k IS NOT NULL THEN it.k::VARCHAR ELSE 'row:row-' || it.k END AS paper, 'row-' || it.k AS row_id, 'name ' || it.k AS title, coalesce(authors, '') AS authors, coalesce(year, '') AS year, coalesce(venue, '') AS venue, parts AS methods, types AS scenes, xs, it.k AS pos FROM it LEFT JOIN pp ON it.k = pp.k AND pp.linked
  UNION ALL SELECT pp.k::VARCHAR, '', 'Paper ' || pp.k, authors, year, venue, '', '', [], pp.k + 1099511627776 FROM pp WHERE NOT (pp.linked AND pp.k IN (SELECT k FROM it)))"""
_VALUES = """v0 AS (SELECT paper, pos, 'author' AS type, authors AS value, 0 AS n FROM en UNION ALL SELECT paper, pos, 'year', year, 0 FROM en UNION ALL SELECT paper, pos, 'venue', venue, 0 FROM en
  UNION ALL SELECT paper, pos, 'method', x.part, n FROM (SELECT paper, pos, unnest(xs) AS x, generate_subscripts(xs, 1) AS n FROM en) UNION ALL SELECT paper, pos, 'scene', x.type, n FROM (SELECT paper, pos, unnest(xs) AS x, generate_subscripts(xs, 1) AS n FROM en)),
v1 AS (SELECT paper, pos, type, type || ':' || lower(value) AS node, min(n) AS n FROM v0 WHERE length(value) >= 2 GROUP BY ALL),
v AS (SELECT paper, pos, type, node FROM v1 QUALIFY row_number() OVER (PARTITION BY paper, pos, type ORDER BY n) <= 10),
m AS (SELECT * FROM v UNION ALL SELECT paper, pos, 'paper', 'paper:' || paper FROM en)"""
_ROWS = f"WITH {_BASE}, h AS (SELECT DISTINCT k // 1000 AS book FROM it), r AS (SELECT k // 1000 AS book, row_number() OVER (PARTITION BY k // 1000 ORDER BY k)::BIGINT AS pos, 'row-' || k AS row_id, ['name ' || k, '', 'Order ' || k, '', '', parts, types, '', '', '', ''] AS cells FROM it UNION ALL SELECT book, 0, 'header', ['" + "', '".join(LABELS) + "'] FROM h)"
QUERIES = {f.__name__: f for f in (workbook_rows, workbook_fields, workbook_cells, workbook_entries, workbook_graph_nodes, workbook_graph_edges, workbook_graph_stats, workbook_related, selected_ranges)}
_EDGE_LABEL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in graph.EDGE_LABELS.items()) + " END"
ORACLES = {
    "workbook_rows": f"{_ROWS} SELECT book, pos, row_id, len(cells)::BIGINT AS n_cells, array_to_string(cells, '|') AS cells FROM r",
    "workbook_fields": f"{_ROWS} SELECT row_id, cells[3] AS english_title, cells[6] AS methods, cells[7] AS scenes, '' AS authors, 11::BIGINT AS n_labels, cells[3] AS paper_title FROM r WHERE pos > 0",
    "workbook_cells": f"{_ROWS}, c AS (SELECT book, pos, unnest(cells) AS value, unnest(range(11)) AS c FROM r) SELECT book, chr((65 + c)::INT) || (pos + 1) AS address, length(value)::BIGINT AS n FROM c WHERE value <> ''",
    "workbook_entries": f"WITH {_BASE} SELECT paper, row_id, title, authors, year, venue, length(methods)::BIGINT AS n_methods, length(scenes)::BIGINT AS n_scenes FROM en",
    "workbook_graph_nodes": f"WITH {_BASE}, {_VALUES} SELECT node, type, count(*) AS count, count(DISTINCT paper) AS papers FROM m GROUP BY node, type",
    "workbook_graph_edges": f"WITH {_BASE}, {_VALUES} SELECT 'paper:' || paper AS source, node AS target, {_EDGE_LABEL} AS label, count(*) AS weight FROM m WHERE type <> 'paper' GROUP BY ALL",
    "workbook_graph_stats": f"""WITH {_BASE}, {_VALUES},
        w AS (SELECT paper, pos, type, CASE type WHEN 'author' THEN 0 WHEN 'year' THEN 1 WHEN 'venue' THEN 2 WHEN 'keyword' THEN 3 WHEN 'method' THEN 4 ELSE 5 END AS tp, type || ':' || lower(value) AS node, n, value FROM v0),
        l AS (SELECT node, min({{'a': pos, 'b': tp, 'c': n, 'd': value}}).d AS label FROM w GROUP BY node UNION ALL SELECT 'paper:' || paper, arg_min(title, pos) FROM en GROUP BY paper),
        x AS (SELECT m.node, m.type, l.label, count(*) AS count FROM m JOIN l USING (node) GROUP BY ALL),
        t AS (SELECT * FROM x ORDER BY CASE WHEN type = 'paper' THEN 0 ELSE 1 END, count DESC, label, node LIMIT {WIDE_VIEW}),
        s AS (SELECT m.* FROM m WHERE node IN (SELECT node FROM t)),
        h AS (SELECT DISTINCT paper FROM s WHERE type = 'paper'),
        c0 AS (SELECT DISTINCT paper, node FROM s WHERE type = 'method'), c1 AS (SELECT * FROM c0 WHERE node IN (SELECT node FROM c0 GROUP BY node HAVING count(*) > 1)),
        e AS (SELECT DISTINCT 'paper:' || paper AS source, node AS target FROM s WHERE type <> 'paper' AND paper IN (SELECT paper FROM h) UNION ALL SELECT DISTINCT a.node, b.node FROM c1 a JOIN c1 b ON a.paper = b.paper AND a.node < b.node)
        SELECT (SELECT count(*) FROM en) AS papers, (SELECT count(*) FROM t) AS nodes, (SELECT count(*) FROM e) AS edges, '' AS top_keywords, (SELECT coalesce(string_agg(label, '; ' ORDER BY count DESC, label), '') FROM (SELECT label, count FROM t WHERE type = 'method' ORDER BY count DESC, label LIMIT 6)) AS top_methods""",
    "workbook_related": f"WITH {_BASE}, {_VALUES} SELECT node, count(*) AS n, arg_min(paper, pos) AS first_paper FROM (SELECT node, paper, min(pos) AS pos FROM m WHERE type <> 'paper' AND paper NOT LIKE 'row:%' GROUP BY ALL) GROUP BY node",
    "selected_ranges": "WITH g AS (SELECT l_suppkey AS sheet, l_partkey % 50 AS r1, l_linenumber AS c1, l_partkey % 50 + l_orderkey % 3 AS r2, l_linenumber + l_orderkey % 2 AS c2 FROM lineitem), x AS (SELECT DISTINCT sheet, r, unnest(range(c1, c2 + 1)) AS c FROM (SELECT sheet, c1, c2, unnest(range(r1, r2 + 1)) AS r FROM g) WHERE r > 0), n AS (SELECT sheet, count(*) AS cells FROM x GROUP BY sheet) SELECT g.sheet, sum((r2 - r1 + 1) * (c2 - c1 + 1))::BIGINT AS counted, coalesce(any_value(n.cells), 0)::BIGINT AS cells FROM g LEFT JOIN n USING (sheet) GROUP BY g.sheet",
}
