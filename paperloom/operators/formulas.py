"""Segments and loose formulas of the lines of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import math as M
from .lines import LINES_AND_SAMPLES, lines_and_samples

#: Letters of lines that stand for delimiters and signs, so that each has many cases, closed and not.
STANDS_FOR = (("e", "$"), ("h", "\\("), ("r", "\\)"), ("c", "\\["), ("d", "\\]"), ("ww", "$$"))
SIGNS = (("a", "_"), ("u", "="), ("π", "pi"), ("the ", "θ ≤ "))


def _replaced(t, pairs):
    for a, b in pairs:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def math_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of every line: how many are plain, inline and displayed, and their values."""
    rows = lines_and_samples(spark, sf_dir).select("doc_id", "pos", M.segments(_replaced(F.col("t"), STANDS_FOR)).alias("s"))
    of = lambda c: F.filter("s", c)
    n = lambda c, name: F.size(of(c)).cast("long").alias(name)
    math = of(lambda x: x["kind"] == "math")
    return rows.select("doc_id", "pos", n(lambda x: x["kind"] == "text", "plain"), n(lambda x: x["display"] == F.lit(False), "inline"), n(lambda x: x["display"], "displayed"), F.md5(F.array_join(F.transform(math, lambda x: x["value"]), "|")).alias("digest"))


def loose_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are formulas without delimiters, as TeX; lines as they are, and with letters as signs."""
    rows = lines_and_samples(spark, sf_dir)
    both = rows.select("doc_id", "pos", F.lit("line").alias("form"), "t").unionByName(rows.select("doc_id", "pos", F.lit("signs").alias("form"), _replaced(F.col("t"), SIGNS).alias("t")))
    found = both.withColumn("f", M.loose_formula(F.col("t"))).filter("f IS NOT NULL")
    return found.select("doc_id", "pos", "form", "f.prefix", F.md5("f.formula").alias("digest"))


def _replaced_sql(t: str, pairs) -> str:
    for a, b in pairs:
        t = f"replace({t}, '{a}', '{b}')"
    return t


_TRIM = r"regexp_replace({}, '^[\s\x{{FEFF}}]+|[\s\x{{FEFF}}]+$', '', 'g')"
_INNER = _TRIM.format("CASE WHEN starts_with(x, '$') AND NOT starts_with(x, '$$') THEN x[2:-2] ELSE x[3:-3] END")
_CLOSED = r"((starts_with(x, '$$') AND ends_with(x, '$$') AND length(x) >= 4) OR (starts_with(x, '\[') AND ends_with(x, '\]') AND length(x) >= 4) OR (starts_with(x, '\(') AND ends_with(x, '\)') AND length(x) >= 4) OR (starts_with(x, '$') AND NOT starts_with(x, '$$') AND ends_with(x, '$') AND length(x) >= 2))"
_TEX = _replaced_sql("body", M.TEX)
_LOOSE = f"body <> '' AND NOT regexp_matches(body, '{M.TAG}') AND NOT regexp_matches(body, '{M.STATEMENT}') AND len(regexp_extract_all(body, '{M.MARKS}')) >= {M.LEAST_MARKS} AND (len(regexp_extract_all(body, '{M.LONG_WORD}')) <= {M.MOST_LONG_WORDS} OR len(regexp_extract_all(body, '{M.SIGN}')) > {M.SIGN_SHARE} * greatest(1, length(body)))"
QUERIES = {f.__name__: f for f in (math_segments, loose_formulas)}
ORACLES = {
    "math_segments": f"""WITH k AS (SELECT doc_id, pos, list_transform(regexp_extract_all({_replaced_sql("t", STANDS_FOR)}, '{M.TOKEN}'), lambda x: {{'x': x, 'closed': {_CLOSED}, 'math': {_CLOSED} AND {_INNER} <> '', 'v': {_INNER}, 'display': NOT starts_with(x, '\\(') AND (NOT starts_with(x, '$') OR starts_with(x, '$$'))}}) AS s FROM {LINES_AND_SAMPLES})
        SELECT doc_id, pos, len(list_filter(s, lambda x, i: NOT x.math AND (x.closed OR i = 1 OR s[i - 1].closed)))::BIGINT AS plain, len(list_filter(s, lambda x: x.math AND NOT x.display))::BIGINT AS inline, len(list_filter(s, lambda x: x.math AND x.display))::BIGINT AS displayed, md5(coalesce(array_to_string(list_transform(list_filter(s, lambda x: x.math), lambda x: x.v), '|'), '')) AS digest FROM k""",
    "loose_formulas": f"""WITH k AS (SELECT doc_id, pos, 'line' AS form, t FROM {LINES_AND_SAMPLES} UNION ALL SELECT doc_id, pos, 'signs', {_replaced_sql("t", SIGNS)} FROM {LINES_AND_SAMPLES}), t AS (SELECT doc_id, pos, form, {_TRIM.format("t")} AS t FROM k), b AS (SELECT *, trim(regexp_extract(t, '{M.NUMBERED}', 1), ' ') AS prefix, trim(regexp_extract(t, '{M.NUMBERED}', 2), ' ') AS body FROM t)
        SELECT doc_id, pos, form, prefix, md5({_TEX}) AS digest FROM b WHERE {_LOOSE}""",
}
