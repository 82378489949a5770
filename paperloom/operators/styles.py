"""Styles of books brought together: dictionaries merged by key, conflicts renamed, cells pointed at the new names.

An imported style whose key is new is taken as it is; one that is there with an equal value
is the same style; any other gets the first free name key-2, key-3...  Imported styles go in
order, and a name given to one is taken for all that follow, so the merge is a fold over the
imported styles of one book; books are merged side by side.  Cells meet the renames of their
book by a join on (book, style).

Defined cases: of several rows of a key the first counts (current ones by value, imported
ones by position); a null key is no style; values are compared as JSON without white space;
a cell whose style has no new name keeps it, as does a cell without a style.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .replies import canonical

STYLES = "map<string,string>"


def _merged(current: Column, imported: Column) -> Column:
    """struct(styles, renames) of a book's current styles and its imported ones in order (structs of key and value)."""

    def step(done: Column, s: Column) -> Column:
        styles, key = done["styles"], s["key"]
        there = F.try_element_at(styles, key)
        name = lambda i: F.concat(key, F.lit("-"), i.cast("string"))
        # One of as many names as there are styles, and one more, is free.
        free = F.element_at(F.filter(F.transform(F.sequence(F.lit(2), F.size(styles) + 2), name), lambda n: ~F.map_contains_key(styles, n)), 1)
        to = F.when(there.isNull(), key).otherwise(free)
        kept = F.coalesce(canonical(there) == canonical(s["value"]), F.lit(False))
        more = F.struct(F.map_concat(styles, F.create_map(to, s["value"])).alias("styles"), F.when(there.isNull(), done["renames"]).otherwise(F.map_concat(done["renames"], F.create_map(key, to))).alias("renames"))
        return F.when(kept, done).otherwise(more)

    none = F.from_json(F.lit("{}"), STYLES)
    return F.aggregate(imported, F.struct(current.alias("styles"), none.alias("renames")), step)


def merged(current: DataFrame, imported: DataFrame) -> DataFrame:
    """(book, styles, renames) of books with ``current`` (book, key, value) and ``imported`` (book, pos, key, value) styles."""
    held = current.filter("key IS NOT NULL").groupBy("book", "key").agg(F.min(F.coalesce("value", F.lit("null"))).alias("value"))
    own = held.groupBy("book").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("current"))
    new = imported.filter("key IS NOT NULL").groupBy("book", "key").agg(F.min(F.struct("pos", F.coalesce("value", F.lit("null")).alias("value"))).alias("f"))
    more = new.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("f.pos", "key", "f.value"))).alias("imported"))
    both = own.join(more, "book", "full")
    empty = F.array().cast("array<struct<pos:long,key:string,value:string>>")
    rows = both.select("book", F.coalesce("current", F.from_json(F.lit("{}"), STYLES)).alias("current"), F.coalesce(F.col("imported").cast("array<struct<pos:long,key:string,value:string>>"), empty).alias("imported"))
    return rows.select("book", _merged(F.col("current"), F.col("imported")).alias("m")).select("book", "m.styles", "m.renames")


def renamed(cells: DataFrame, books: DataFrame) -> DataFrame:
    """``cells`` (book, style and others) with the new names of ``merged``."""
    names = books.select("book", F.explode("renames").alias("style", "_new"))
    return cells.join(names, ["book", "style"], "left").withColumn("style", F.coalesce("_new", "style")).drop("_new")


def _dictionaries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Styles of brands as books: sizes are keys, types values; every third key of a book has a second name that is taken."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    value = F.to_json(F.struct(F.col("p_type").alias("font"), (size % 3).alias("bold")))
    key = F.concat(F.lit("s"), size.cast("string"))
    current = p.filter("p_partkey % 2 = 0").select(F.col("p_brand").alias("book"), key.alias("key"), value.alias("value"))
    taken = current.filter(F.col("key").isin(*[f"s{3 * i}" for i in range(20)])).select("book", F.concat("key", F.lit("-2")).alias("key"), F.lit("{}").alias("value"))
    imported = p.filter("p_partkey % 2 = 1").select(F.col("p_brand").alias("book"), (F.col("p_size") * 1000000 + F.col("p_partkey")).cast("long").alias("pos"), key.alias("key"), F.replace(value, F.lit(":"), F.lit(" : ")).alias("value"))
    return current.unionByName(taken), imported


def style_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of every book after the merge."""
    books = merged(*_dictionaries(spark, sf_dir))
    return books.select("book", F.explode("styles").alias("key", "value")).select("book", "key", F.md5(canonical(F.col("value"))).alias("digest"))


def style_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of imported books by style, under the names after the merge."""
    current, imported = _dictionaries(spark, sf_dir)
    p = table(spark, sf_dir, "part")
    cells = p.select(F.col("p_brand").alias("book"), F.when(F.col("p_size") % 10 != 0, F.concat(F.lit("s"), F.col("p_size").cast("string"))).alias("style"), "p_partkey")
    return renamed(cells, merged(current, imported)).groupBy("book", "style").agg(F.count("*").alias("cells"), F.max("p_partkey").alias("last"))


_DICTIONARIES = """v AS (SELECT p_brand AS book, 's' || p_size AS key, '{"font":"' || p_type || '","bold":' || (p_size % 3) || '}' AS value, p_partkey, p_size FROM part),
    c AS (SELECT book, key, min(value) AS value FROM v WHERE p_partkey % 2 = 0 GROUP BY ALL), t AS (SELECT book, key || '-2' AS key, '{}' AS value FROM c WHERE substr(key, 2)::INT % 3 = 0 AND substr(key, 2)::INT < 60),
    h AS (SELECT * FROM c UNION ALL SELECT * FROM t),
    i AS (SELECT book, key, arg_min(value, p_partkey) AS value FROM v WHERE p_partkey % 2 = 1 GROUP BY ALL),
    m AS (SELECT i.book, i.key, i.value, CASE WHEN h.key IS NULL THEN i.key WHEN h.value = i.value THEN NULL WHEN EXISTS (SELECT 1 FROM t WHERE t.book = i.book AND t.key = i.key || '-2') THEN i.key || '-3' ELSE i.key || '-2' END AS name, h.key IS NOT NULL AS there FROM i LEFT JOIN h ON h.book = i.book AND h.key = i.key)"""
QUERIES = {f.__name__: f for f in (style_merge, style_cells)}
ORACLES = {
    "style_merge": f"WITH {_DICTIONARIES} SELECT book, key, md5(value) AS digest FROM h UNION ALL SELECT book, name, md5(value) FROM m WHERE name IS NOT NULL",
    "style_cells": f"WITH {_DICTIONARIES}, x AS (SELECT p_brand AS book, CASE WHEN p_size % 10 <> 0 THEN 's' || p_size END AS style, p_partkey FROM part) SELECT x.book, coalesce(m.name, x.style) AS style, count(*) AS cells, max(p_partkey) AS last FROM x LEFT JOIN m ON m.book = x.book AND m.key = x.style AND m.there GROUP BY ALL",
}
