"""Highlights of pages: rectangles told apart by their places, and one underline for each line of text.

Rectangles are kept once for each place (to half a unit), cut to their page, and swept from
top to bottom: one joins the first line whose height it overlaps by 35 % of the lower of
both, and makes that line as high as both.  The sweep is a fold over the distinct
rectangles of a page, whose number is bounded by the page's area and not by the rows.

Defined cases: rectangles with a null side, outside the page or of 0.5 units or less are
dropped; repeated rows are one rectangle; pages without a rectangle have no row; equal tops
and lefts go by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

# The smallest side of a rectangle, the height of an underline, and the share of heights that makes a line.
LEAST_SIDE, UNDERLINE, SHARE = 0.5, 1.0, 0.35
SIDES = ("left", "top", "right", "bottom")


def distinct_rects(rects: DataFrame) -> DataFrame:
    """One row, the first by pos, for each place: page, pos, left, top, right, bottom (sides in units)."""
    key = [(F.floor(F.col(s) * 2 + 0.5) / 2).alias(f"_{s}") for s in SIDES]
    whole = rects.dropna(subset=[*SIDES]).select("page", *key, F.struct("pos", *SIDES).alias("r"))
    return whole.groupBy("page", *[f"_{s}" for s in SIDES]).agg(F.min("r").alias("r")).select("page", "r.*")


def clamped(rects: DataFrame, width: float, height: float) -> DataFrame:
    """``rects`` cut to a page of this size; those that are too small then go."""
    cut = lambda c, most: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.col(c).cast("double"))).alias(c)
    sides = rects.select("page", "pos", cut("left", width), cut("top", height), cut("right", width), cut("bottom", height))
    return sides.filter((F.col("right") - F.col("left") > LEAST_SIDE) & (F.col("bottom") - F.col("top") > LEAST_SIDE))


def _swept(rects: Column) -> Column:
    """Lines (top, bottom, left, right, bottoms) of rectangles in order."""

    def line(r: Column) -> Column:
        return F.struct(r["top"].alias("top"), r["bottom"].alias("bottom"), r["left"].alias("left"), r["right"].alias("right"), F.array(r["bottom"]).alias("bottoms"))

    def belongs(r: Column, g: Column) -> Column:
        overlap = F.least(r["bottom"], g["bottom"]) - F.greatest(r["top"], g["top"])
        lower = F.least(F.greatest(F.lit(LEAST_SIDE), r["bottom"] - r["top"]), F.greatest(F.lit(LEAST_SIDE), g["bottom"] - g["top"]))
        return (overlap > 0) & (overlap / lower >= SHARE)

    def grown(r: Column, g: Column) -> Column:
        return F.struct(F.least(g["top"], r["top"]).alias("top"), F.greatest(g["bottom"], r["bottom"]).alias("bottom"), F.least(g["left"], r["left"]).alias("left"), F.greatest(g["right"], r["right"]).alias("right"), F.concat(g["bottoms"], F.array(r["bottom"])).alias("bottoms"))

    def step(lines: Column, r: Column) -> Column:
        hits = F.transform(lines, lambda g: belongs(r, g))
        at = F.array_position(hits, F.lit(True))  # 1 for the first, 0 for none
        return F.when(at == 0, F.concat(lines, F.array(line(r)))).otherwise(F.transform(lines, lambda g, i: F.when(i + 1 == at, grown(r, g)).otherwise(g)))

    empty = F.array().cast("array<struct<top:double,bottom:double,left:double,right:double,bottoms:array<double>>>")
    return F.aggregate(rects, empty, step)


def underlines(rects: DataFrame, width: float, height: float) -> DataFrame:
    """(page, left, top, width, height) of the underline of every line; ``rects``: page, pos and sides."""
    held = clamped(distinct_rects(rects), width, height).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("top", "left", "pos", "right", "bottom"))).alias("rects"))
    rows = held.select("page", F.explode(_swept(F.col("rects"))).alias("g")).select("page", "g.*")
    n = F.size("bottoms")
    b = F.array_sort("bottoms")
    middle = (F.element_at(b, F.floor((n + 1) / 2).cast("int")) + F.element_at(b, F.floor(n / 2).cast("int") + 1)) / 2
    top = F.least(F.lit(height - UNDERLINE), F.greatest(F.lit(0.0), middle - UNDERLINE))
    return rows.select("page", "left", top.alias("top"), F.greatest(F.lit(0.0), F.col("right") - F.col("left")).alias("width"), F.lit(UNDERLINE).alias("height"))


WIDTH, HEIGHT = 480.0, 240.0


def page_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as rectangles, sixteen orders a page; some are outside it, some repeat."""
    li = table(spark, sf_dir, "lineitem")
    left, top = F.col("l_quantity") * 10.3 - 20, F.col("l_linenumber") * 31 + F.col("l_suppkey") % 25 - 14
    return li.select(F.floor(F.col("l_orderkey") / 16).alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), left.alias("left"), top.cast("double").alias("top"), (left + F.col("l_discount") * 900).alias("right"), (top + 4 + F.col("l_partkey") % 16).cast("double").alias("bottom"))


def highlight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Underlines of every page."""
    rows = underlines(page_rects(spark, sf_dir), WIDTH, HEIGHT)
    return rows.select("page", *[F.round(c, 6).alias(c) for c in ("left", "top", "width")])


def highlight_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rectangles of every page and how many of them are on it."""
    d = distinct_rects(page_rects(spark, sf_dir))
    on = clamped(d, WIDTH, HEIGHT).groupBy("page").agg(F.count("*").alias("shown"))
    return d.groupBy("page").agg(F.count("*").alias("places")).join(on, "page", "left").select("page", "places", F.coalesce("shown", F.lit(0)).alias("shown"))


_CUT = ", ".join(f"least({m}, greatest(0.0::DOUBLE, {c})) AS {a}" for c, a, m in (('"left"', "l", WIDTH), ("top", "t", HEIGHT), ('"right"', "r", WIDTH), ("bottom", "b", HEIGHT)))
_RECTS = f"""s AS (SELECT l_orderkey // 16 AS page, l_orderkey * 10 + l_linenumber AS pos, l_quantity * 10.3::DOUBLE - 20 AS "left", (l_linenumber * 31 + l_suppkey % 25 - 14)::DOUBLE AS top, l_quantity * 10.3::DOUBLE - 20 + l_discount * 900::DOUBLE AS "right", (l_linenumber * 31 + l_suppkey % 25 - 14 + 4 + l_partkey % 16)::DOUBLE AS bottom FROM lineitem),
    d AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY page, floor("left" * 2 + 0.5), floor(top * 2 + 0.5), floor("right" * 2 + 0.5), floor(bottom * 2 + 0.5) ORDER BY pos, "left", top, "right", bottom) = 1),
    c AS (SELECT * FROM (SELECT page, pos, {_CUT} FROM d) WHERE r - l > {LEAST_SIDE} AND b - t > {LEAST_SIDE})"""
_HIT = f"(least(x.b, g.b) - greatest(x.t, g.t) > 0 AND (least(x.b, g.b) - greatest(x.t, g.t)) / least(greatest({LEAST_SIDE}, x.b - x.t), greatest({LEAST_SIDE}, g.b - g.t)) >= {SHARE})"
QUERIES = {f.__name__: f for f in (highlight_lines, highlight_places)}
ORACLES = {
    "highlight_lines": f"""WITH RECURSIVE {_RECTS},
    o AS MATERIALIZED (SELECT page, {{'t': t, 'b': b, 'l': l, 'r': r}} AS x, row_number() OVER (PARTITION BY page ORDER BY t, l, pos, r, b) AS n FROM c),
    f AS (SELECT page, n, [{{'t': x.t, 'b': x.b, 'l': x.l, 'r': x.r, 'bs': [x.b]}}] AS gs FROM o WHERE n = 1
      UNION ALL SELECT page, n, CASE WHEN k IS NULL THEN list_append(gs, {{'t': x.t, 'b': x.b, 'l': x.l, 'r': x.r, 'bs': [x.b]}}) ELSE list_transform(gs, lambda g, i: CASE WHEN i = k THEN {{'t': least(g.t, x.t), 'b': greatest(g.b, x.b), 'l': least(g.l, x.l), 'r': greatest(g.r, x.r), 'bs': list_append(g.bs, x.b)}} ELSE g END) END
      FROM (SELECT f.page, o.n, o.x, f.gs, nullif(list_position(list_transform(f.gs, lambda g: {_HIT.replace("x.", "o.x.")}), true), 0) AS k FROM f JOIN o ON o.page = f.page AND o.n = f.n + 1)),
    z AS (SELECT page, unnest(max_by(gs, n)) AS g FROM f GROUP BY page)
    SELECT page, round(g.l, 6) AS "left", round(least({HEIGHT - UNDERLINE}, greatest(0, median_ - {UNDERLINE})), 6) AS top, round(greatest(0, g.r - g.l), 6) AS width FROM (SELECT page, g, (list_sort(g.bs)[(len(g.bs) + 1) // 2] + list_sort(g.bs)[len(g.bs) // 2 + 1]) / 2 AS median_ FROM z)""",
    "highlight_places": f"WITH {_RECTS} SELECT page, count(*) AS places, coalesce(any_value(k.n), 0) AS shown FROM d LEFT JOIN (SELECT page, count(*) AS n FROM c GROUP BY page) k USING (page) GROUP BY page",
}
