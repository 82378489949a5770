"""Readers and writers of the library's file formats, as columns over text.

A reader takes a text column, so the same code serves files of any store, tables and
streams.  Tolerant readers give defaults; strict ones raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import table

PAPER = "array<struct<id:string,pdfPath:string,pdfName:string,translationPath:string,translationName:string,chineseTitle:string,englishTitle:string,journal:string,authors:string,year:string,notes:string,lastOpenedAt:string,lastPage:int>>"
ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_title:string,_href:string>>"
LINK = "array<struct<rowId:string,paperId:string>>"
ITEM = "array<struct<section:string,original:string,translation:string,type:string,page:int,sectionId:string,sectionOrder:int,paragraphOrder:int,sourceHash:string>>"


def papers(json: DataFrame, column: str = "value") -> DataFrame:
    """Paper records of JSON arrays: bad JSON gives none, records without a pdfPath go, fields default to ''."""
    rows = json.select(F.posexplode(F.from_json(F.col(column), PAPER, {"mode": "PERMISSIVE"})).alias("pos", "p")).select("pos", "p.*").filter(T.nonempty(F.col("pdfPath")).isNotNull())
    texts = [c for c, k in rows.dtypes if k == "string"]
    page = F.greatest(F.lit(1), F.coalesce("lastPage", F.lit(1)))
    return rows.withColumns({c: F.coalesce(c, F.lit("")) for c in texts} | {"lastPage": page})


def links(json: DataFrame, column: str = "value") -> DataFrame:
    """Row-paper links with both ids."""
    rows = json.select(F.posexplode(F.from_json(F.col(column), LINK)).alias("pos", "l")).select("pos", "l.*")
    return rows.filter((F.coalesce("rowId", F.lit("")) != "") & (F.coalesce("paperId", F.lit("")) != ""))


def items(json: DataFrame, column: str = "value") -> DataFrame:
    """Translation items; a text that isn't a JSON array of objects is an error."""
    checked = F.when(F.rtrim(F.ltrim(column)).rlike(r"(?s)^\[.*\]$"), F.col(column)).otherwise(F.raise_error(F.lit("not a JSON array")))
    return json.select(F.posexplode(F.from_json(checked, ITEM, {"mode": "FAILFAST"})).alias("pos", "i")).select("pos", "i.*")


def markdown_blocks(text: Column) -> Column:
    """Trimmed, non-empty blocks between blank lines, line ends unified."""
    unified = F.regexp_replace(text, "\r\n?", "\n")
    return F.filter(F.transform(F.split(unified, r"\n[ \t]*\n+"), lambda b: F.trim(b)), lambda b: b != "")


#: Labels of a document's header and the fields they name, and the labels under which they are written.
HEADER = {
    "中文标题": "chineseTitle", "chinesetitle": "chineseTitle", "chinese_title": "chineseTitle", "英文标题": "englishTitle", "englishtitle": "englishTitle", "english_title": "englishTitle", "title": "englishTitle",
    "期刊": "journal", "journal": "journal", "venue": "journal", "作者": "authors", "authors": "authors", "author": "authors", "年份": "year", "year": "year",
}
WRITTEN = {"chineseTitle": "中文标题", "englishTitle": "英文标题", "journal": "期刊", "authors": "作者", "year": "年份"}
#: Lengths of titles taken from a document's first item.
CHINESE_SIGNS, ENGLISH_SIGNS = 40, 80


def headed(text: Column) -> Column:
    """A document as struct(metadata, body): leading ``label: value`` lines with known labels, and what follows them.

    The header ends at the first line that is blank or has no known label; the last of
    equal labels counts.
    """
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), "\n")
    label = lambda x: F.lower(F.trim(F.regexp_extract(F.trim(x), r"^([^:：]+)[:：]\s*(.*)$", 1)))
    value = lambda x: F.trim(F.regexp_extract(F.trim(x), r"^([^:：]+)[:：]\s*(.*)$", 2))
    known = F.create_map(*[F.lit(x) for kv in HEADER.items() for x in kv])

    def split(lines: Column) -> Column:
        stop = F.filter(F.transform(lines, lambda x, i: F.when(F.try_element_at(known, label(x)).isNull(), i)), lambda i: i.isNotNull())
        n = F.coalesce(F.try_element_at(stop, F.lit(1)), F.size(lines))

        def parts(n: Column) -> Column:
            head = F.slice(lines, F.lit(1), n)
            # Later labels first, so that the first of a field is its last.
            pairs = F.reverse(F.transform(head, lambda x: F.struct(known[label(x)].alias("k"), value(x).alias("v"))))
            field = lambda name: F.coalesce(F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(1))["v"], F.lit("")).alias(name)
            rest = F.slice(lines, n + 1, F.greatest(F.lit(1), F.size(lines)))
            body = F.when(n > 0, F.regexp_replace(F.array_join(rest, "\n"), r"^(?:[ \t]*\n)+", "")).otherwise(F.array_join(lines, "\n"))
            return F.struct(F.struct(*[field(x) for x in WRITTEN]).alias("metadata"), body.alias("body"))

        return T.let(n, parts)

    return T.let(lines, split)


def header_text(metadata: Column) -> Column:
    """The header of a document: its filled fields as lines, then a blank line; '' without any."""
    lines = [F.when(F.coalesce(metadata[k], F.lit("")) != "", F.concat(F.lit(f"{label}："), metadata[k])) for k, label in WRITTEN.items()]
    kept = F.filter(F.array(*lines), lambda x: x.isNotNull())
    return F.when(F.size(kept) > 0, F.concat(F.array_join(kept, "\n"), F.lit("\n\n"))).otherwise("")


def markdown_text(metadata: Column, paragraphs: Column) -> Column:
    """A document as Markdown: its header and its paragraphs, blank lines between."""
    return F.concat(header_text(metadata), F.array_join(F.filter(F.transform(paragraphs, lambda p: F.trim(F.coalesce(p, F.lit("")))), lambda p: p != ""), "\n\n"))


def inferred(items_: Column) -> Column:
    """Titles taken from the first of a document's items (struct of original and translation)."""
    first = F.try_element_at(items_, F.lit(1))
    cut = lambda c, n: F.substring(T.collapse(F.coalesce(c, F.lit(""))), 1, n)
    return F.struct(cut(first["translation"], CHINESE_SIGNS).alias("chineseTitle"), cut(first["original"], ENGLISH_SIGNS).alias("englishTitle"))


def documents(files: DataFrame) -> DataFrame:
    """(path, kind, metadata, paragraphs) of files (path, value) by their extension; any other is an error."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./\\\\]+)$", 1))
    named = files.withColumn("kind", F.when(kind == "json", "json").when(kind.isin("md", "markdown", "txt"), "markdown").otherwise(F.raise_error(F.concat(F.lit("no reader for "), F.col("path"))).cast("string")))
    records = F.from_json(F.when(F.col("kind") == "json", F.col("value")), ITEM)
    plain = headed(F.col("value"))
    fields = F.struct(*[F.col("x.metadata")[k].alias(k) for k in WRITTEN])
    titles = inferred(F.col("r"))
    own = F.struct(titles["chineseTitle"].alias("chineseTitle"), titles["englishTitle"].alias("englishTitle"), *[F.lit("").alias(k) for k in ("journal", "authors", "year")])
    rows = named.withColumns({"r": records, "x": plain})
    return rows.select("path", "kind", F.when(F.col("kind") == "json", own).otherwise(fields).alias("metadata"), F.when(F.col("kind") == "json", F.transform("r", lambda i: i["original"])).otherwise(markdown_blocks(F.col("x.body"))).alias("paragraphs"))


def search_key(category: Column, query: Column, start: Column, most: Column, sort: Column, order: Column) -> Column:
    """The canonical cache key of a search, as JSON in a fixed order."""
    term = F.concat(F.coalesce(T.nonempty(category), F.lit("all")), F.lit(":"), F.lower(T.collapse(query)))
    return F.to_json(F.struct(term.alias("search_query"), start.alias("start"), most.alias("max_results"), sort.alias("sortBy"), order.alias("sortOrder")))


def file_name(name: Column) -> Column:
    """A name without the signs that file systems refuse."""
    return F.trim(F.regexp_replace(T.collapse(F.regexp_replace(name, r"[\\/:*?\"<>|\x00-\x1f]+", "_")), r"[. ]+$", ""))


def paper_of_entry() -> Column:
    """A library record of an Atom entry (the columns of ``atom_entries``)."""
    journal = F.trim(F.concat(F.lit("arXiv "), F.coalesce("primary", F.lit(""))))
    notes = F.trim(F.concat(F.lit("arXiv: "), F.col("stable_id"), F.lit("\n"), F.col("summary")))
    return F.struct(F.col("title").alias("englishTitle"), journal.alias("journal"), F.array_join("authors", ", ").alias("authors"), F.col("year"), notes.alias("notes"), F.lit(1).alias("lastPage"))


def atom_entries(feed: DataFrame, column: str = "value") -> DataFrame:
    """Papers of Atom feeds: ids, titles, authors, categories; the pdf link falls back to the id's."""
    texts = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(r"(?s)(<entry[ >].*?</entry>)"), 1)
    x = feed.select(F.posexplode(texts).alias("pos", "t")).select("pos", F.from_xml("t", ENTRY).alias("e"))
    plain = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    titled = F.filter("e.link", lambda k: k["_title"] == "pdf")
    rows = x.select("pos", *[plain(F.col(f"e.{c}")).alias(c) for c in ("id", "title", "summary", "published")], F.transform("e.author", lambda a: plain(a["name"])).alias("authors"), F.transform("e.category", lambda c: c["_term"]).alias("categories"), F.coalesce(F.try_element_at(titled, F.lit(1))["_href"], F.lit("")).alias("pdf"))
    pdf = T.first_nonempty(F.col("pdf"), F.replace(F.col("id"), F.lit("/abs/"), F.lit("/pdf/")))
    return rows.withColumns({"pdf": pdf, "stable_id": F.regexp_replace(F.element_at(F.split("id", "/"), -1), r"v\d+$", ""), "year": F.substring("published", 1, 4), "primary": F.try_element_at("categories", F.lit(1))})


def pretty(value: Column) -> Column:
    return F.to_json(value, {"pretty": "true"})


def markdown_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of documents read as Markdown, with their section names."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.posexplode(markdown_blocks(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "\n\n"))).alias("pos", "block"))
    return rows.select("doc_id", "pos", F.concat(F.lit("Markdown "), (F.col("pos") + 1).cast("string")).alias("section"), F.length("block").cast("long").alias("n"))


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as paper records in JSON and read back."""
    o = table(spark, sf_dir, "orders")
    record = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("/p/"), F.col("o_orderkey").cast("string"))).alias("pdfPath"), F.col("o_orderpriority").alias("journal"), (F.col("o_orderkey") % 7).cast("int").alias("lastPage"))
    return papers(o.select(F.to_json(F.array(record)).alias("value"))).select("id", "pdfPath", "journal", F.col("lastPage").cast("long").alias("last_page"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base names and stems of page addresses."""
    p = table(spark, sf_dir, "pages")
    name = T.base_name(F.coalesce("url", F.lit("")))
    return p.select("page_id", name.alias("base_name"), T.without_extension(name).alias("stem"))


def header_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as Markdown with a header and read back, and JSON files with inferred titles."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    metadata = F.struct(F.lit("").alias("chineseTitle"), F.concat(F.lit("Order "), key).alias("englishTitle"), F.col("o_orderpriority").alias("journal"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("authors"), F.date_format("o_orderdate", "yyyy").alias("year"))
    text = markdown_text(metadata, F.array(F.concat(F.lit("First of "), key), F.lit(" "), F.lit("title: not in the header")))
    record = F.to_json(F.array(F.struct(F.concat(F.lit("Original "), key).alias("original"), F.concat(F.lit("Translated "), key).alias("translation"))))
    even = F.col("o_orderkey") % 2 == 0
    files = o.select(F.concat(key, F.when(even, ".md").otherwise(".json")).alias("path"), F.when(even, text).otherwise(record).alias("value"))
    return documents(files).select("path", "kind", *[F.col(f"metadata.{k}").alias(k) for k in WRITTEN], F.array_join("paragraphs", "|").alias("paragraphs"))


def search_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache keys of searches: benchmark items as queries."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.md5(search_key(F.when(F.col("item_id") % 2 == 0, "cs.RO").otherwise(""), F.coalesce("text", F.lit("")), F.col("item_id") * 10, F.lit(25), F.lit("relevance"), F.lit("descending"))).alias("digest"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as file names."""
    return table(spark, sf_dir, "pages").select("page_id", file_name(F.coalesce("url", F.lit(""))).alias("name"))


QUERIES = {f.__name__: f for f in (header_round_trip, search_keys, file_names, markdown_scan, json_round_trip, url_parts)}
ORACLES = {
    "header_round_trip": "SELECT o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.md' ELSE '.json' END AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'markdown' ELSE 'json' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Translated ' || o_orderkey END AS chineseTitle, CASE WHEN o_orderkey % 2 = 0 THEN 'Order ' ELSE 'Original ' END || o_orderkey AS englishTitle, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS journal, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN o_orderstatus ELSE '' END AS authors, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y') ELSE '' END AS year, CASE WHEN o_orderkey % 2 = 0 THEN 'First of ' || o_orderkey || '|title: not in the header' ELSE 'Original ' || o_orderkey END AS paragraphs FROM orders",
    "search_keys": rf"""SELECT item_id, md5('{{"search_query":' || to_json((CASE WHEN item_id % 2 = 0 THEN 'cs.RO' ELSE 'all' END) || ':' || lower(trim(regexp_replace(coalesce(text, ''), '{T.SPACE_RE2}', ' ', 'g'), ' ')))::VARCHAR || ',"start":' || (item_id * 10) || ',"max_results":25,"sortBy":"relevance","sortOrder":"descending"}}') AS digest FROM benchmark""",
    "file_names": r"""SELECT page_id, trim(regexp_replace(trim(regexp_replace(regexp_replace(coalesce(url, ''), '[\\/:*?"<>|\x00-\x1f]+', '_', 'g'), '\s+', ' ', 'g'), ' '), '[. ]+$', ''), ' ') AS name FROM pages""",
    "markdown_scan": r"WITH b AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(coalesce(text, ''), chr(10), chr(10) || chr(10), 'g'), '\r\n?', chr(10), 'g'), '\n[ \t]*\n+'), lambda x: trim(x, ' ')), lambda x: x <> '') AS bs FROM documents), r AS (SELECT doc_id, bs, unnest(range(len(bs))) AS i FROM b) SELECT doc_id, i::INT AS pos, 'Markdown ' || (i + 1) AS section, length(bs[i + 1])::BIGINT AS n FROM r",
    "json_round_trip": "SELECT o_orderkey::VARCHAR AS id, '/p/' || o_orderkey AS pdfPath, o_orderpriority AS journal, greatest(1, o_orderkey % 7)::BIGINT AS last_page FROM orders WHERE o_orderkey % 5 <> 0",
    "url_parts": r"SELECT page_id, string_split(replace(coalesce(url, ''), '\', '/'), '/')[-1] AS base_name, regexp_replace(string_split(replace(coalesce(url, ''), '\', '/'), '/')[-1], '\.[^.]+$', '') AS stem FROM pages",
}
