"""Set similarity of short texts: Dice joins by shared tokens, overlaps and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

TOKEN = r"[\p{L}\p{N}]+"


def tokens(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, token) rows, distinct."""
    return df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(f"({TOKEN})"), 1))).alias("token"))


def dice_join(df: DataFrame, key: str, column: str, least: float) -> DataFrame:
    """(a, b, dice) of pairs of short texts with 2 |A and B| / (|A| + |B|) above ``least``.

    Pairs meet by a rare token: in an order by frequency, texts that similar share one
    among the first n - ceil(least / (2 - least) * n) + 1 of either, so common tokens
    pair nothing.
    """
    rows = tokens(df, key, column)
    frequency = rows.groupBy("token").agg(F.count("*").alias("f"))
    sets = rows.join(frequency, "token").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("s"))
    n = F.size("s")
    prefix = F.slice("s", F.lit(1), (n - F.ceil(n * (least / (2 - least))) + 1).cast("int"))
    probe = sets.select(key, F.explode(prefix).alias("p")).select(key, F.col("p.token").alias("token"))
    met = probe.withColumnRenamed(key, "a").join(probe.withColumnRenamed(key, "b"), "token").filter("a < b").select("a", "b").distinct()
    plain = sets.select(key, F.transform("s", lambda x: x["token"]).alias("t"))
    both = met.join(plain.withColumnsRenamed({key: "a", "t": "ta"}), "a").join(plain.withColumnsRenamed({key: "b", "t": "tb"}), "b")
    dice = 2 * F.size(F.array_intersect("ta", "tb")) / (F.size("ta") + F.size("tb"))
    return both.withColumn("dice", F.round(dice, 6)).filter(dice > least).select("a", "b", "dice")


def similar_bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with token sets more alike than 0.2 (0.82 leaves none in these tables)."""
    return dice_join(table(spark, sf_dir, "benchmark"), "item_id", "text", 0.2)


def turn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common tokens, with repeats, of each turn and the one before it."""
    c = table(spark, sf_dir, "conversations")
    words = c.select("conv_id", "turn", F.explode(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(f"({TOKEN})"), 1)).alias("token"))
    counts = words.groupBy("conv_id", "turn", "token").agg(F.count("*").alias("n"))
    after = counts.select("conv_id", (F.col("turn") - 1).alias("turn"), "token", F.col("n").alias("m"))
    return counts.join(after, ["conv_id", "turn", "token"]).groupBy("conv_id", "turn").agg(F.sum(F.least("n", "m")).alias("overlap"))


def shared_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by language: documents that have them; only those in two languages or more."""
    d = table(spark, sf_dir, "documents")
    return tokens(d.select(F.col("lang"), "text"), "lang", "text").groupBy("token").agg(F.count("*").alias("docs"), F.countDistinct("lang").alias("langs")).filter("langs >= 2")


_T = r"SELECT {k} AS k, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+'))) AS token FROM {t}"
QUERIES = {f.__name__: f for f in (similar_bullets, turn_overlap, shared_vocabulary)}
ORACLES = {
    "similar_bullets": f"WITH t AS ({_T.format(k='item_id', t='benchmark')}), n AS (SELECT k, count(*) AS n FROM t GROUP BY k), c AS (SELECT a.k AS a, b.k AS b, count(*) AS c FROM t a JOIN t b ON a.token = b.token AND a.k < b.k GROUP BY ALL) SELECT a, b, round(2.0 * c / (x.n + y.n), 6) AS dice FROM c JOIN n x ON a = x.k JOIN n y ON b = y.k WHERE 2.0 * c / (x.n + y.n) > 0.2",
    "turn_overlap": r"WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS token FROM conversations), c AS (SELECT conv_id, turn, token, count(*) AS n FROM w GROUP BY ALL) SELECT a.conv_id, a.turn, sum(least(a.n, b.n))::BIGINT AS overlap FROM c a JOIN c b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1 AND a.token = b.token GROUP BY ALL",
    "shared_vocabulary": f"WITH t AS ({_T.format(k='lang', t='documents')}) SELECT token, count(*) AS docs, count(DISTINCT k) AS langs FROM t GROUP BY token HAVING count(DISTINCT k) >= 2",
}
