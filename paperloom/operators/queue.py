"""Translation queues: pending, cached and skipped items, by section, with cache lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table


def pending(kind: Column, original: Column, translation: Column, force: bool = False) -> Column:
    """Paragraphs (or items of no type) with an original and, unless forced, no translation yet."""
    is_paragraph = kind.isNull() | (kind == "paragraph")
    return is_paragraph & (F.trim(original) != "") & (F.lit(force) | (F.trim(F.coalesce(translation, F.lit(""))) == ""))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as items: one section each; users' turns await translation."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn", F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", None).otherwise("paragraph").alias("kind"), F.coalesce("text", F.lit("")).alias("original"), F.when(F.col("role") == "user", "").when(F.length("text") % 3 == 0, "").otherwise(F.col("text")).alias("translation")
    )


def stats(rows: DataFrame, *keys: str) -> DataFrame:
    """total, cached, pending and skipped (never below 0)."""
    waiting, cached = F.count_if(pending(F.col("kind"), F.col("original"), F.col("translation"))), F.count_if(F.trim("translation") != "")
    grouped = rows.groupBy(*keys) if keys else rows
    found = grouped.agg(F.count("*").alias("total"), cached.alias("cached"), waiting.alias("pending"))
    return found.withColumn("skipped", F.greatest(F.lit(0).cast("long"), F.col("total") - F.col("cached") - F.col("pending")))


def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(items(spark, sf_dir))


def queue_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats(items(spark, sf_dir), "conv_id")


def queue_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).filter(pending(F.col("kind"), F.col("original"), F.col("translation"))).select("conv_id", "turn")


def queue_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item's cached text: by source hash first, else by normalised original; the last of equal keys wins."""
    rows = items(spark, sf_dir).withColumns({"hash": F.md5("original"), "norm": T.key_of(F.col("original")), "pos": F.struct("conv_id", "turn")})
    cache = rows.filter("translation <> ''")
    by_hash = cache.groupBy("hash").agg(F.max(F.struct("pos", "translation"))["translation"].alias("t1"))
    by_norm = cache.groupBy("norm").agg(F.max(F.struct("pos", "translation"))["translation"].alias("t2"))
    found = rows.join(by_hash, "hash", "left").join(by_norm, "norm", "left")
    return found.select("conv_id", "turn", F.coalesce("t1", "t2").isNotNull().alias("hit"), F.length(F.coalesce("t1", "t2", F.lit(""))).cast("long").alias("cached_length"))


def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as bilingual Markdown, items in order."""
    block = F.concat_ws("\n", F.concat(F.lit("## "), F.col("turn").cast("string")), F.lit("**Original**"), F.col("original"), F.lit("**Translation**"), F.col("translation"))
    return items(spark, sf_dir).groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n\n")).alias("digest"))


def align_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests (user turns) with the first later answer of their conversation, '' where there is none."""
    # From the end on, the last answer seen is the first that follows: a running value, no frame is read twice.
    back = W.partitionBy("conv_id").orderBy(F.desc("turn"), "role", F.desc(F.length("text"))).rowsBetween(W.unboundedPreceding, -1)
    answer = F.last(F.when(F.col("role") == "assistant", F.struct(F.length("text").alias("n"))), ignorenulls=True).over(back)
    rows = table(spark, sf_dir, "conversations").withColumn("answer", answer)
    return rows.filter("role = 'user'").select("conv_id", "turn", F.coalesce("answer.n", F.lit(0)).cast("long").alias("answer_length"))


_I = "i AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'heading' WHEN role = 'user' THEN NULL ELSE 'paragraph' END AS kind, coalesce(text, '') AS original, CASE WHEN role = 'user' THEN '' WHEN length(text) % 3 = 0 THEN '' ELSE text END AS translation FROM conversations)"
_P = "((kind IS NULL OR kind = 'paragraph') AND trim(original, ' ') <> '' AND trim(coalesce(translation, ''), ' ') = '')"
_S = f"count(*) AS total, count(*) FILTER (WHERE trim(translation, ' ') <> '') AS cached, count(*) FILTER (WHERE {_P}) AS pending, greatest(0, count(*) - count(*) FILTER (WHERE trim(translation, ' ') <> '') - count(*) FILTER (WHERE {_P})) AS skipped"
_NORM = rf"trim(regexp_replace(lower(original), '{T.SPACE_RE2}', ' ', 'g'), ' ')"
QUERIES = {f.__name__: f for f in (queue_stats, queue_sections, queue_pending, queue_cache_lookup, export_markdown, align_responses)}
ORACLES = {
    "queue_stats": f"WITH {_I} SELECT {_S} FROM i",
    "queue_sections": f"WITH {_I} SELECT conv_id, {_S} FROM i GROUP BY conv_id",
    "queue_pending": f"WITH {_I} SELECT conv_id, turn FROM i WHERE {_P}",
    "queue_cache_lookup": f"WITH {_I}, k AS (SELECT *, md5(original) AS hash, {_NORM} AS norm FROM i), c AS (SELECT * FROM k WHERE translation <> ''), h AS (SELECT hash, arg_max(translation, {{'c': conv_id, 't': turn}}) AS t1 FROM c GROUP BY 1), n AS (SELECT norm, arg_max(translation, {{'c': conv_id, 't': turn}}) AS t2 FROM c GROUP BY 1) SELECT conv_id, turn, coalesce(t1, t2) IS NOT NULL AS hit, length(coalesce(t1, t2, ''))::BIGINT AS cached_length FROM k LEFT JOIN h USING (hash) LEFT JOIN n USING (norm)",
    "export_markdown": f"WITH {_I} SELECT conv_id, md5(string_agg('## ' || turn || chr(10) || '**Original**' || chr(10) || original || chr(10) || '**Translation**' || chr(10) || translation, chr(10) || chr(10) ORDER BY turn)) AS digest FROM i GROUP BY conv_id",
    "align_responses": "WITH r AS (SELECT *, last_value(CASE WHEN role = 'assistant' THEN coalesce(length(text), 0) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn DESC, role, length(text) DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM conversations) SELECT conv_id, turn, coalesce(n, 0)::BIGINT AS answer_length FROM r WHERE role = 'user'",
}
