"""Geometry of positioned text runs: page metrics, reading order, line gaps, boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table

# A page narrower than this is one column; gaps that end a paragraph.
TWO_COLUMNS_FROM = 220
GAP_MEDIANS, GAP_HEIGHTS, SHIFT = 2.4, 1.75, 110


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs: eight orders a page, so that pages stay small; price as x, quantity as y, size as height."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.floor(F.col("l_orderkey") / 8).alias("page"), F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), F.floor(F.col("l_extendedprice") / 100).alias("x"), (F.col("l_quantity") * 12).alias("y"), (8 + F.col("l_linenumber") % 3).cast("double").alias("height"))


def page_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extents (1 at least) and exact median height of every page."""
    r = runs(spark, sf_dir).groupBy("page")
    found = r.agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.median("height").alias("median_height"))
    return found.withColumns({"extent_x": F.greatest(F.lit(1.0), F.col("max_x") - F.col("min_x")), "extent_y": F.greatest(F.lit(1.0), F.col("max_y") - F.col("min_y"))})


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left column first where a page is wide enough for two, then down, then across."""
    page = W.partitionBy("page")
    wide = F.max("x").over(page) - F.min("x").over(page) >= TWO_COLUMNS_FROM
    middle = (F.max("x").over(page) + F.min("x").over(page)) / 2
    column = F.when(wide & (F.col("x") > middle), 1).otherwise(0)
    rows = runs(spark, sf_dir).withColumn("col", column)
    order = F.row_number().over(page.orderBy("col", "y", "x", "doc", "n"))
    return rows.select("page", "doc", "n", F.col("col").cast("long").alias("col"), order.cast("long").alias("position"))


def paragraph_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a page that follow without a gap, as paragraphs with their boxes.

    A paragraph ends before a gap over the larger of 2.4 median heights and 1.75 of
    either line's, or a shift of over 110.
    """
    w = W.partitionBy("page").orderBy("y", "x", "doc", "n")
    median = F.median("height").over(W.partitionBy("page"))
    before = F.lag(F.struct("x", "y", "height")).over(w)
    rows = runs(spark, sf_dir).withColumns({"median": median, "before": before})
    gap = F.col("y") - F.col("before.y") > F.greatest(GAP_MEDIANS * F.col("median"), GAP_HEIGHTS * F.col("before.height"), GAP_HEIGHTS * F.col("height"))
    new = F.col("before").isNull() | gap | (F.abs(F.col("x") - F.col("before.x")) > SHIFT)
    marked = rows.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("paragraph", F.sum("new").over(w))
    return marked.groupBy("page", "paragraph").agg(F.count("*").alias("lines"), F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"))


_R = "r AS (SELECT l_orderkey // 8 AS page, l_orderkey AS doc, l_linenumber AS n, floor(l_extendedprice / 100) AS x, l_quantity * 12 AS y, (8 + l_linenumber % 3)::DOUBLE AS height FROM lineitem)"
QUERIES = {f.__name__: f for f in (page_metrics, reading_order, paragraph_runs)}
ORACLES = {
    "page_metrics": f"WITH {_R} SELECT page, min(x)::BIGINT AS min_x, max(x)::BIGINT AS max_x, min(y) AS min_y, max(y) AS max_y, median(height) AS median_height, greatest(1.0, max(x) - min(x))::DOUBLE AS extent_x, greatest(1.0, max(y) - min(y))::DOUBLE AS extent_y FROM r GROUP BY page",
    "reading_order": f"WITH {_R}, c AS (SELECT *, CASE WHEN max(x) OVER p - min(x) OVER p >= 220 AND x > (max(x) OVER p + min(x) OVER p) / 2 THEN 1 ELSE 0 END AS col FROM r WINDOW p AS (PARTITION BY page)) SELECT page, doc, n, col::BIGINT AS col, row_number() OVER (PARTITION BY page ORDER BY col, y, x, doc, n)::BIGINT AS position FROM c",
    "paragraph_runs": f"WITH {_R}, b AS (SELECT *, median(height) OVER (PARTITION BY page) AS med, lag(x) OVER w AS bx, lag(y) OVER w AS by_, lag(height) OVER w AS bh FROM r WINDOW w AS (PARTITION BY page ORDER BY y, x, doc, n)), m AS (SELECT *, CASE WHEN bx IS NULL OR y - by_ > greatest(2.4 * med, 1.75 * bh, 1.75 * height) OR abs(x - bx) > 110 THEN 1 ELSE 0 END AS new FROM b), s AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY y, x, doc, n)::BIGINT AS paragraph FROM m) SELECT page, paragraph, count(*) AS lines, min(x)::BIGINT AS \"left\", min(y) AS top, max(x)::BIGINT AS \"right\", max(y + height) AS bottom FROM s GROUP BY page, paragraph",
}
