"""Contexts of papers for a request: parts put together under a budget of signs.

A paper's parts go in order with blank lines between, and the whole is cut at the budget.
Running sums of lengths say which part the cut falls into, so the parts after it are dropped
before anything is put together, and one row never holds more than a budget.  The contexts
of a request are numbered and joined in the order of its papers.

Defined cases: null and empty parts aren't there; a paper without any part has an empty
context, which is still headed; the budget counts code points; equal positions go by text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import table
from .lines import lines

# Signs of a paper's context, what stands between parts, and its heading.
BUDGET, BETWEEN = 18_000, "\n\n"
HEADING = ("【论文上下文 ", " / ", "】\n")
PAGE_LINES = 40


def assembled(parts: DataFrame, budget: int = BUDGET, between: str = BETWEEN) -> DataFrame:
    """(paper, text): the parts (paper, pos, text) of every paper joined in order and cut at ``budget``."""
    there = parts.filter("text <> ''").select("paper", "pos", "text")
    order = W.partitionBy("paper").orderBy("pos", "text")
    # Where a part begins in the whole, what stands before it counted.
    size = F.length("text") + len(between)
    begin = F.sum(size).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - size
    # The part that the budget ends in is cut, and later ones go; if it ends in what stands between two, the second is empty.
    used = there.withColumn("begin", begin).filter(F.col("begin") - len(between) < budget).withColumn("text", F.expr(f"substring(text, 1, CAST(greatest(0, {budget} - begin) AS INT))"))
    joined = used.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("begin", "text"))).alias("x"))
    return joined.select("paper", F.substring(F.array_join(F.transform("x", lambda x: x["text"]), between), 1, budget).alias("text"))


def contexts(requests: DataFrame, parts: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(request, papers, text): the headed contexts of the papers of every request (request, pos, paper).

    A request is a choice of papers by hand, so all of it fits in a row.
    """
    number = F.row_number().over(W.partitionBy("request").orderBy("pos", "paper"))
    placed = requests.select("request", "pos", "paper").withColumn("number", number).join(assembled(parts, budget), "paper", "left")
    text = F.concat(F.lit(HEADING[0]), F.col("number").cast("string"), F.lit(HEADING[1]), F.col("paper").cast("string"), F.lit(HEADING[2]), F.coalesce("text", F.lit("")))
    held = placed.groupBy("request").agg(F.count("*").alias("papers"), F.array_sort(F.collect_list(F.struct("number", text.alias("text")))).alias("x"))
    return held.select("request", "papers", F.array_join(F.transform("x", lambda x: x["text"]), BETWEEN).alias("text"))


def pages_of(docs: DataFrame, page_lines: int = PAGE_LINES) -> DataFrame:
    """(paper, pos, text): the non-empty lines of documents as pages headed by their numbers."""
    held = lines(docs).filter("t <> ''").groupBy("doc_id", F.floor(F.col("pos") / page_lines).alias("page")).agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("x"))
    text = F.concat(F.lit("Page "), (F.col("page") + 1).cast("string"), F.lit("\n"), F.array_join(F.transform("x", lambda x: x["t"]), "\n"))
    return held.select(F.col("doc_id").alias("paper"), F.col("page").alias("pos"), text.alias("text"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of documents, and what stands in for a paper's own notes after them."""
    d = table(spark, sf_dir, "documents")
    notes = d.select(F.col("doc_id").alias("paper"), F.lit(1 << 40).cast("long").alias("pos"), F.concat_ws(" ", "lang", "source").alias("text"))
    return pages_of(d).unionByName(notes)


def paper_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of every document."""
    rows = assembled(_parts(spark, sf_dir))
    return rows.select("paper", F.length("text").cast("long").alias("signs"), F.md5("text").alias("digest"))


def request_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of requests of five documents each, under a budget of 1,000 signs a paper."""
    d = table(spark, sf_dir, "documents")
    asked = d.select(F.floor(F.col("doc_id") / 5).alias("request"), (-F.col("doc_id")).alias("pos"), F.col("doc_id").alias("paper"))
    rows = contexts(asked, _parts(spark, sf_dir), 1_000)
    return rows.select("request", "papers", F.length("text").cast("long").alias("signs"), F.md5("text").alias("digest"))


_TEXTS = f"""l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) - 1 AS pos, s FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
    g AS (SELECT doc_id, pos // {PAGE_LINES} AS page, string_agg(s[pos + 1], chr(10) ORDER BY pos) AS t FROM l WHERE s[pos + 1] <> '' GROUP BY ALL),
    w AS (SELECT doc_id, string_agg('Page ' || (page + 1) || chr(10) || t, chr(10) || chr(10) ORDER BY page) AS t FROM g GROUP BY doc_id),
    n AS (SELECT doc_id, concat_ws(' ', lang, source) AS notes FROM documents),
    p AS (SELECT n.doc_id AS paper, concat_ws(chr(10) || chr(10), w.t, nullif(notes, '')) AS t FROM n LEFT JOIN w USING (doc_id))"""
QUERIES = {f.__name__: f for f in (paper_contexts, request_contexts)}
ORACLES = {
    "paper_contexts": f"WITH {_TEXTS} SELECT paper, length(substr(t, 1, {BUDGET}))::BIGINT AS signs, md5(substr(t, 1, {BUDGET})) AS digest FROM p WHERE t <> ''",
    "request_contexts": f"WITH {_TEXTS}, q AS (SELECT paper // 5 AS request, row_number() OVER (PARTITION BY paper // 5 ORDER BY paper DESC) AS number, paper, t FROM p), r AS (SELECT request, count(*) AS papers, string_agg('{HEADING[0]}' || number || '{HEADING[1]}' || paper || '{HEADING[2][:-1]}' || chr(10) || substr(t, 1, 1000), chr(10) || chr(10) ORDER BY number) AS text FROM q GROUP BY request) SELECT request, papers, length(text)::BIGINT AS signs, md5(text) AS digest FROM r",
}
