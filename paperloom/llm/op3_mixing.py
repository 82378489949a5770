"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a fixed 36-bit hash of its doc_id and text.  Token counts are summed by
source and by the hash's leading 12 bits; the running sum over those 4,096 buckets gives,
for each budget of a source, the last bucket that fits whole and the one at the boundary.
Only rows of boundary buckets are summed again by their next 12 bits, and once more
by the last 12.  Rows of the boundary's one hash (one row, or copies in id and text) are cut
alike by a hash of their place in a stored table.  A row is taken if its hashes are under the
thresholds: no rows are sorted, a larger budget keeps all that a smaller one takes (nested),
and reruns agree.

Defined cases: null or empty text has size 0 and is taken 0 words; a null source is a
source of its own, last in order; null and repeated doc_ids are told apart by their texts,
and rows that are equal in both are copies of which as many are taken as the budget asks
for; a source of no words has target 0; other columns don't matter and come through
``repeat`` whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, running, stored, table

LEVELS, BITS = 3, 12
#: How often a document may be taken at most.
REPEATS = 3
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Rows of the plan (one per source, about 100 bytes) that ``repeat`` broadcasts at most.
MOST_BROADCAST_SOURCES = 100_000


def hash36(*keys: Column) -> Column:
    """The first 36 bits of the keys' MD5: the same in any SQL engine."""
    text = F.concat_ws("\n", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 9), 16, 10).cast("long")


def place36() -> Column:
    """36 bits by a row's place; only fixed once it is stored."""
    return F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 36) - 1))


def water_fill(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target`` to one row per source with ``source_size``, ``rank`` and ``weight``.

    Shares of the total by weight, none above ``repeats`` times the source's size;
    what stands above goes to the others by weight until none is above.  That fixed
    point is min(weight * level, cap) with one level for all, found by ordering the
    sources by cap / weight: a source is full when even the level that would serve
    all sources from it on is above its own ratio, so the first that isn't sets it.
    """
    cap = F.lit(float(repeats)) * F.col("source_size")
    rows = sources.withColumns({"_cap": cap, "_ratio": cap / F.col("weight")})
    order = [F.col("_ratio"), F.col("rank")]
    summed = stored(running(rows, order, {"_full": F.col("_cap"), "_weights": F.col("weight")}), "mix-running")
    total = summed.agg(F.sum("source_size").cast("double").alias("_total"), F.sum("weight").alias("_all"))
    spent, rest = F.col("_full") - F.col("_cap"), F.col("_all") - F.col("_weights") + F.col("weight")
    level = (F.col("_total") - spent) / rest
    first = F.min(F.when(level <= F.col("_ratio"), F.struct("_ratio", "rank", level.alias("at"))))["at"]
    found = summed.crossJoin(total).agg(first.alias("_level"))  # one row on either side of both products
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("weight"))
    return summed.crossJoin(found).withColumn("target", target).drop("_cap", "_ratio", "_full", "_weights", "_level")


def ranked_sources(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, rank and weight: by code point, null last, weights repeating."""
    sums = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sums")
    given = F.array(*[F.lit(float(x)) for x in weights])
    numbered = running(sums, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)})
    return numbered.withColumn("weight", F.element_at(given, ((F.col("rank") - 1) % len(weights) + 1).cast("int")))


def boundary(sized: DataFrame, budgets: DataFrame, nearest: bool = False) -> DataFrame:
    """For each (source, budget): the hash at which the budget is reached, and the words under it.

    ``sized``: stored rows of source, size, hash (36 bits).  ``budgets``: source, budget, one
    row or more per source.  Returns source, budget, at and done: rows of hash < at have
    ``done`` words, not over the budget, and those of hash = at go over it; where all rows fit
    ``at`` is above every hash.  ``nearest`` moves it past the boundary's hash where that is
    nearer to the budget.
    """
    state = budgets.withColumns({"_low": F.lit(0).cast("long"), "_done": F.lit(0).cast("long")})
    over_all = 1 << (LEVELS * BITS)
    for depth in range(LEVELS):
        shift = BITS * (LEVELS - 1 - depth)
        histogram = sized.groupBy("source", F.shiftright("hash", shift).alias("_bucket")).agg(F.sum("size").alias("_sum"))
        if depth:  # only buckets inside a boundary bucket are looked at again
            edge = state.filter(F.col("_low") < over_all).select("source", F.shiftright("_low", BITS + shift).alias("_in")).distinct()
            histogram = histogram.join(edge.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_bucket", BITS) == F.col("_in"))).drop("_s", "_in")
        histogram = stored(histogram.withColumn("_parent", F.shiftright("_bucket", BITS)), f"mix-histogram-{depth}")
        by = W.partitionBy("source", "_parent").orderBy("_bucket")
        upto = histogram.withColumn("_upto", F.sum("_sum").over(by)).withColumnRenamed("source", "_s")
        joined = state.join(upto, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("_low", BITS + shift) == F.col("_parent")), "left")
        first = F.min(F.when(F.col("_done") + F.col("_upto") > F.col("budget"), F.struct("_bucket", (F.col("_upto") - F.col("_sum")).alias("before"), F.col("_upto").alias("upto")))).alias("_edge")
        got = joined.groupBy("source", "budget", "_low", "_done").agg(first, F.max("_upto").alias("_whole"))
        # No bucket over the budget can only be at the first level: all rows fit.
        low = F.when(F.col("_edge").isNotNull(), F.shiftleft("_edge._bucket", shift)).otherwise(F.lit(over_all))
        before = F.when(F.col("_edge").isNotNull(), F.col("_edge.before")).otherwise(F.when(F.col("_low") < over_all, F.coalesce("_whole", F.lit(0))).otherwise(0))
        if nearest and depth == LEVELS - 1:
            nearer = (F.col("_done") + F.col("_edge.upto") - F.col("budget")) < (F.col("budget") - F.col("_done") - F.col("_edge.before"))
            low = F.when(F.coalesce(nearer, F.lit(False)), low + 1).otherwise(low)
        state = stored(got.select("source", "budget", low.alias("_low"), (F.col("_done") + before).alias("_done")), f"mix-edge-{depth}")
    return state.select("source", "budget", F.col("_low").alias("at"), F.col("_done").alias("done"))


def size_of(column: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(column), F.lit("")), F.lit(WORD)).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): size, source_size, target and taken.

    A source whose target is q whole times its size and r words more takes every
    document q times, and those under the thresholds for r once more.
    """
    sized = stored(docs.select("doc_id", "source", size_of().alias("size"), hash36(F.col("doc_id"), F.col("text")).alias("hash"), place36().alias("place")), "mix-sized", lasting=True)
    plan = planned(sized, weights, repeats)
    cut = placed(sized.join(plan, _same_source()).filter(_at_edge()), plan)
    # The plan has a row per source; Spark broadcasts it if its files are small, else
    # joins by shuffle and splits a hot source (all columns here are narrow).
    joined = sized.join(cut, _same_source())
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("place"))).alias("taken"), "source")


def _same_source() -> Column:
    return F.col("source").eqNullSafe(F.col("_s"))


def _at_edge() -> Column:
    return (F.col("size") > 0) & (F.col("budget") > 0) & (F.col("hash") == F.col("at"))


def _times(place: Column) -> Column:
    """How often a document is taken, from its hashes and its source's plan."""
    under = (F.col("hash") < F.col("at")) | ((F.col("hash") == F.col("at")) & (place < F.col("place_at")))
    return F.col("whole") + F.when((F.col("budget") > 0) & under, 1).otherwise(0)


def repeat(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; texts are never shuffled by source.

    Rows without words take no part in the budgets and stay once.
    """
    hash_ = hash36(F.col("doc_id"), F.col("text"))
    sized = stored(docs.select("doc_id", "source", size_of().alias("size"), hash_.alias("hash")), "mix-sized")
    plan = planned(sized, weights, repeats)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source"), size_of().alias("size"), hash_.alias("hash"))
    # Rows at a boundary are one a source, or copies: written once, as their places must hold.
    joined = rows.join(_sized_broadcast(plan), _same_source())
    edge = stored(joined.filter(_at_edge()).select("_row", "source", "size", "hash", place36().alias("place")), "mix-edge-rows", lasting=True)
    cut = placed(edge, plan)
    ahead = joined.filter(~_at_edge()).select("_row", F.when(F.col("size") > 0, _times(F.lit(0))).otherwise(1).cast("int").alias("_times"))
    behind = edge.join(_sized_broadcast(cut), _same_source()).select("_row", _times(F.col("place")).cast("int").alias("_times"))
    return ahead.unionByName(behind).filter("_times > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")


def _sized_broadcast(plan: DataFrame) -> DataFrame:
    # Beyond this size Spark shuffles, and splits hot sources.
    return F.broadcast(plan) if plan.count() <= MOST_BROADCAST_SOURCES else plan


def planned(sized: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """One row per source: _s, source_size, target, whole, budget, at, done and place_at (0), stored."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = stored(water_fill(ranked_sources(sized, weights), repeats).withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "mix-sources")
    cut = boundary(sized, sources.select("source", "budget")).select(F.col("source").alias("_s"), "at", "done")
    return stored(sources.join(cut, _same_source()).select("_s", "source_size", "target", "whole", "budget", "at", "done", F.lit(0).cast("long").alias("place_at")), "mix-plan", lasting=True)


def placed(edge: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` with place_at: how far the rows at each boundary (source, size, place) are taken."""
    left = plan.filter("budget > 0").select(F.col("_s").alias("source"), (F.col("budget") - F.col("done")).alias("budget"))
    rows = stored(edge.select("source", "size", F.col("place").alias("hash")), "mix-places")
    cut = boundary(rows, left, nearest=True).select(F.col("source").alias("_p"), F.col("at").alias("place_at"))
    return stored(plan.drop("place_at").join(cut, F.col("_s").eqNullSafe(F.col("_p")), "left").drop("_p").withColumn("place_at", F.coalesce("place_at", F.lit(0))), "mix-cut", lasting=True)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def oracle() -> str:
    return r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 9))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rk
  FROM sized GROUP BY source),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM src),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
         sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
         (sum(source_size) OVER ())::DOUBLE AS total FROM r),
lv AS (SELECT *, (SELECT (total - spent) / rest FROM l WHERE (total - spent) / rest <= ratio ORDER BY ratio, rk LIMIT 1) AS level FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(level, 0) * weight) AS target FROM lv),
b AS (SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS whole FROM t),
c AS (SELECT *, target - whole * source_size AS budget FROM b),
u AS (SELECT doc_id, source, size, h, sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM sized)
SELECT u.doc_id, u.size, c.source_size, c.target, (u.size * (c.whole + CASE WHEN c.budget > 0 AND (u.upto <= c.budget OR (u.upto - u.size <= c.budget AND u.upto - c.budget < c.budget - (u.upto - u.size))) THEN 1 ELSE 0 END))::BIGINT AS taken, u.source
FROM u JOIN c ON u.source IS NOT DISTINCT FROM c.source
"""


QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLES = {"op3_mix_sources": oracle()}
