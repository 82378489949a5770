"""Paper libraries: merging, linking and keeping relations one to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``: a minimum over structs, combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ordered = [*order, *(c for c in rest if c not in order)]
    return df.groupBy(*keys).agg(F.min(F.struct(*ordered)).alias("_f")).select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest])


def upsert(library: DataFrame, incoming: DataFrame, keys: list[str], kept: list[str], taken: list[str]) -> DataFrame:
    """Full merge: ``kept`` columns prefer the library's non-empty value, ``taken`` the incoming one."""
    new = incoming.withColumnsRenamed({c: f"_{c}" for c in incoming.columns})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    joined = library.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), on, "full_outer")
    key = [F.coalesce(k, f"_{k}").alias(k) for k in keys]
    first = [F.coalesce(T.nonempty(F.col(c).cast("string")), F.col(f"_{c}").cast("string")).alias(c) for c in kept]
    second = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in taken]
    # Touched papers move to the front.
    return joined.select(*key, *first, *second, F.when(F.col("_new"), 0).otherwise(1).cast("long").alias("position"))


def library_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled orders as the library, open ones as incoming papers, by customer and priority."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("translation"), F.col("o_orderkey").alias("paper_id"), F.when(F.col("o_orderkey") % 3 != 0, F.date_format("o_orderdate", "yyyy")).otherwise("").alias("year"), "o_orderstatus")
    old = first_by(o.filter("o_orderstatus = 'F'").drop("o_orderstatus"), ["path", "translation"], ["paper_id"])
    new = first_by(o.filter("o_orderstatus = 'O'").drop("o_orderstatus"), ["path", "translation"], ["paper_id"])
    return upsert(old, new, ["path", "translation"], ["year"], ["paper_id"])


def row_link_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (rows) left-joined with the first label (link) and its order (paper); missing stay."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    links = first_by(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("q"), F.col("toxic").alias("x")), ["doc_id"], ["q", "x"])
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"))
    return rows.join(links, "doc_id", "left").join(papers, "doc_id", "left").select("doc_id", "source", F.col("q").isNotNull().alias("linked"), F.coalesce("status", F.lit("none")).alias("status"))


def linked_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have both a link and a paper."""
    return row_link_paper(spark, sf_dir).filter("linked AND status <> 'none'").select("doc_id", "status")


def library_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers that no row names, after the union with those that rows name."""
    papers = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return rows.withColumn("origin", F.lit("workbook")).unionByName(papers.join(rows, "id", "left_anti").withColumn("origin", F.lit("library")))


def one_to_one(links: DataFrame) -> DataFrame:
    """Links (row_id, paper_id, pos) in which a later link replaced earlier ones of its row or paper.

    A link stays just when it is the last of its row and the last of its paper.
    """
    last = lambda k: F.max("pos").over(W.partitionBy(k))
    return links.withColumns({"_r": last("row_id"), "_p": last("paper_id")}).filter((F.col("pos") == F.col("_r")) & (F.col("pos") == F.col("_p"))).drop("_r", "_p")


def link_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("row_id"), F.floor(F.col("value")).cast("long").alias("paper_id"))
    return one_to_one(e.filter("paper_id IS NOT NULL"))


def latest_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of every customer, and how many have a price above 100,000."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"].alias("latest"), F.count_if(F.col("o_totalprice") > 100000).alias("large"), F.count("*").alias("n"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 events of every user, one per type and hour (later replaces)."""
    e = table(spark, sf_dir, "events")
    one = first_by(e.select("user_id", "event_type", F.date_trunc("hour", "ts").alias("h"), (-F.col("event_id")).alias("k")), ["user_id", "event_type", "h"], ["k"])
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("h"), "k"))
    return one.withColumn("rank", rank).filter("rank <= 20").select("user_id", (-F.col("k")).alias("event_id"), F.col("rank").cast("long").alias("rank"))


def a1(row: Column, column: Column) -> Column:
    """The address of a cell by its numbers from 0: letters in bijective base 26 (up to ZZZ), then the row."""
    n = column.cast("long")
    letters = [F.char(F.lit(65) + F.floor(n / 1) % 26), F.char(F.lit(65) + F.floor((n - 26) / 26) % 26), F.char(F.lit(65) + F.floor((n - 702) / 676) % 26)]
    name = F.when(n < 26, letters[0]).when(n < 702, F.concat(letters[1], letters[0])).otherwise(F.concat(letters[2], letters[1], letters[0]))
    return F.concat(name, (row + 1).cast("string"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a sparse grid by sheet: the used range and the addresses of its corner and of the first cell."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sheet"), (F.col("l_partkey") % 1000).alias("r"), (F.col("l_linenumber") * 17 + F.col("l_orderkey") % 900).cast("long").alias("c"))
    used = l.groupBy("sheet").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"), F.min(F.struct("r", "c")).alias("f"))
    return used.select("sheet", "rows", "cols", a1(F.col("rows") - 1, F.col("cols") - 1).alias("last_address"), a1(F.col("f.r"), F.col("f.c")).alias("first_address"))


def cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of finite amounts by upper-case currency (the segment stands in)."""
    c = table(spark, sf_dir, "customer")
    return c.filter(~F.isnan("c_acctbal")).groupBy(F.upper("c_mktsegment").alias("currency")).agg(F.round(F.sum(F.col("c_acctbal").cast("decimal(18,4)")).cast("double"), 2).alias("total"))


def group_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by paper, in order."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), ",").alias("cells"))


def first_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first item of each order with a return flag R (null if none)."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy("l_orderkey").agg(F.min(F.when(F.col("l_returnflag") == "R", F.struct("l_linenumber", "l_partkey")))["l_partkey"].alias("part"))


_A1 = "CASE WHEN {c} < 26 THEN chr((65 + {c})::INT) WHEN {c} < 702 THEN chr((65 + ({c} - 26) // 26)::INT) || chr((65 + {c} % 26)::INT) ELSE chr((65 + ({c} - 702) // 676)::INT) || chr((65 + ({c} - 702) // 26 % 26)::INT) || chr((65 + {c} % 26)::INT) END"
_O = "o AS (SELECT o_custkey AS path, o_orderpriority AS translation, o_orderkey AS paper_id, CASE WHEN o_orderkey % 3 <> 0 THEN strftime(o_orderdate, '%Y') ELSE '' END AS year, o_orderstatus AS s FROM orders)"
_ONE = "SELECT path, translation, min({'paper_id': paper_id, 'year': year}) AS f FROM o WHERE s = '%s' GROUP BY ALL"
_RLP = "r AS (SELECT d.doc_id, d.source, l.doc_id IS NOT NULL AS linked, coalesce(o_orderstatus, 'none') AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id LEFT JOIN orders ON o_orderkey = d.doc_id)"
QUERIES = {f.__name__: f for f in (library_upsert, row_link_paper, linked_papers, library_only, link_relation, latest_opened, history, cells, cost_totals, group_targets, first_matches)}
ORACLES = {
    "library_upsert": f"WITH {_O}, a AS ({_ONE % 'F'}), b AS ({_ONE % 'O'}) SELECT coalesce(a.path, b.path) AS path, coalesce(a.translation, b.translation) AS translation, coalesce(nullif(a.f.year, ''), b.f.year) AS year, CASE WHEN b.path IS NOT NULL THEN b.f.paper_id ELSE a.f.paper_id END AS paper_id, (CASE WHEN b.path IS NOT NULL THEN 0 ELSE 1 END)::BIGINT AS position FROM a FULL JOIN b ON a.path = b.path AND a.translation = b.translation",
    "row_link_paper": f"WITH {_RLP} SELECT * FROM r",
    "linked_papers": f"WITH {_RLP} SELECT doc_id, status FROM r WHERE linked AND status <> 'none'",
    "library_only": "SELECT doc_id AS id, 'workbook' AS origin FROM labels UNION ALL SELECT o_orderkey, 'library' FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM labels)",
    "link_relation": "WITH e AS (SELECT event_id AS pos, user_id AS row_id, floor(value)::BIGINT AS paper_id FROM events WHERE value IS NOT NULL), m AS (SELECT *, max(pos) OVER (PARTITION BY row_id) AS r, max(pos) OVER (PARTITION BY paper_id) AS p FROM e) SELECT pos, row_id, paper_id FROM m WHERE pos = r AND pos = p",
    "latest_opened": "SELECT o_custkey, max({'d': o_orderdate, 'k': o_orderkey}).k AS latest, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) AS n FROM orders GROUP BY o_custkey",
    "history": "WITH o AS (SELECT user_id, event_type, date_trunc('hour', ts) AS h, max(event_id) AS event_id FROM events GROUP BY ALL), r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY h DESC, event_id DESC) AS rank FROM o) SELECT user_id, event_id, rank::BIGINT AS rank FROM r WHERE rank <= 20",
    "cells": f"WITH u AS (SELECT l_suppkey AS sheet, max(l_partkey % 1000) + 1 AS rows, (max(l_linenumber * 17 + l_orderkey % 900) + 1)::BIGINT AS cols, min({{'r': l_partkey % 1000, 'c': l_linenumber * 17 + l_orderkey % 900}}) AS f FROM lineitem GROUP BY 1) SELECT sheet, rows, cols, {_A1.format(c='(cols - 1)')} || rows AS last_address, {_A1.format(c='f.c')} || (f.r + 1) AS first_address FROM u",
    "cost_totals": "SELECT upper(c_mktsegment) AS currency, round(sum(c_acctbal::DECIMAL(18,4))::DOUBLE, 2) AS total FROM customer WHERE NOT isnan(c_acctbal) GROUP BY 1",
    "group_targets": "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS cells FROM lineitem GROUP BY 1",
    "first_matches": "SELECT l_orderkey, (min({'n': l_linenumber, 'p': l_partkey}) FILTER (WHERE l_returnflag = 'R')).p AS part FROM lineitem GROUP BY 1",
}
