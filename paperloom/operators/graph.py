"""A typed graph of papers and their values: nodes, edges, co-occurrence, top-N, views.

Entries come as rows (paper, pos, type, value): aggregation is one shuffle by node id,
and every "first" is a minimum over the position, as rows have no order of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import stored, table

#: Edge labels by node type, in the order the types are fanned out.
EDGE_LABELS = {"author": "作者", "year": "年份", "venue": "期刊/会议", "keyword": "关键词", "method": "方法", "scene": "场景", "metric": "指标", "limitation": "局限"}
CO_METHOD, CO_KEYWORD = "共现方法", "共现关键词"
#: How many values of one entry become nodes.
CAPS = {"author": 8, "limitation": 3}
OTHER_CAP = 10


def fan_out(entries: DataFrame, more: list[str] | None = None) -> DataFrame:
    """(paper, entry_pos, type, ord, value) of entries with a list column per type, capped per type.

    ``more``: columns of ``entries`` that come along.
    """
    kept = ["paper", "entry_pos", *(more or [])]
    lists = F.array(*[F.struct(F.lit(t).alias("type"), F.slice(F.coalesce(F.col(t), F.array().cast("array<string>")), 1, CAPS.get(t, OTHER_CAP)).alias("vs")) for t in EDGE_LABELS if t in entries.columns])
    typed = entries.select(*kept, F.posexplode(lists).alias("type_pos", "x"))
    rows = typed.select(*kept, "type_pos", F.col("x.type").alias("type"), F.posexplode("x.vs").alias("ord", "raw"))
    return rows.withColumn("value", T.readable(F.col("raw"))).filter("value <> ''").withColumn("node", F.concat(F.col("type"), F.lit(":"), T.key_of(F.col("value"))))


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as papers: customer, year, priority, brands, parts and part types as values."""
    o, c, l, p = (table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "part"))
    header = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    one = header.select(
        F.col("o_orderkey").alias("paper"),
        F.explode(F.array(F.struct(F.lit("author").alias("type"), F.col("c_name").alias("value")), F.struct(F.lit("year").alias("type"), F.year("o_orderdate").cast("string").alias("value")), F.struct(F.lit("venue").alias("type"), F.col("o_orderpriority").alias("value")))).alias("x"),
    ).select("paper", F.lit(0).alias("ord"), "x.*")
    items = l.join(p, F.col("l_partkey") == F.col("p_partkey"))
    many = items.select(
        F.col("l_orderkey").alias("paper"),
        F.col("l_linenumber").alias("ord"),
        F.explode(F.array(F.struct(F.lit("keyword").alias("type"), F.col("p_brand").alias("value")), F.struct(F.lit("method").alias("type"), F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("value")), F.struct(F.lit("scene").alias("type"), F.col("p_type").alias("value")))).alias("x"),
    ).select("paper", "ord", "x.*")
    values = one.unionByName(many)
    # The values of one paper and type are distinct, first seen first, and capped.
    # Dealt by paper, so that grouping and ranking share the one shuffle.
    keyed = values.repartition("paper").withColumn("node", F.concat(F.col("type"), F.lit(":"), T.key_of(F.col("value"))))
    first = keyed.groupBy("paper", "type", "node").agg(F.min(F.struct("ord", "value")).alias("f")).select("paper", "type", "node", "f.*")
    rank = F.row_number().over(W.partitionBy("paper", "type").orderBy("ord", "node"))
    return first.withColumn("_r", rank).filter(F.col("_r") <= F.when(F.col("type") == "author", 8).otherwise(OTHER_CAP)).drop("_r")


def nodes_of(rows: DataFrame) -> DataFrame:
    """node, type, label (first seen), count of mentions and papers; ``rows`` are distinct by paper and node."""
    return rows.groupBy("node", "type").agg(F.min(F.struct("paper", "ord", "value")).alias("f"), F.count("*").alias("count"), F.count("paper").alias("papers")).select("node", "type", F.col("f.value").alias("label"), "count", "papers")


def value_edges(rows: DataFrame, distinct: bool = False) -> DataFrame:
    """source (the paper), target, label and weight of every paper-value edge.

    ``distinct``: no two rows have the same paper, type and node, so that each row is an edge of
    weight 1 and nothing is shuffled.
    """
    label = F.create_map(*[F.lit(x) for kv in EDGE_LABELS.items() for x in kv])
    if distinct:
        return rows.select(F.concat(F.lit("paper:"), F.col("paper").cast("string")).alias("source"), F.col("node").alias("target"), label[F.col("type")].alias("label"), F.lit(1).cast("long").alias("weight"))
    return rows.groupBy(F.concat(F.lit("paper:"), F.col("paper").cast("string")).alias("source"), F.col("node").alias("target"), label[F.col("type")].alias("label")).agg(F.count("*").alias("weight"))


def co_occurrence(rows: DataFrame, kind: str, label: str, distinct: bool = False) -> DataFrame:
    """Pairs of nodes of one type that share a paper, both in two papers or more; weight 1.

    The overlap of paper lists becomes an equality join on the paper: linear in the
    pairs that meet in papers, not in pairs of nodes.  ``distinct`` as in ``value_edges``.
    """
    of = rows.filter(F.col("type") == kind).select("paper", "node")
    of = of if distinct else of.distinct()
    often = of.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node")
    met = of.join(often, "node")
    other = met.select("paper", F.col("node").alias("target"))
    pairs = met.join(other, "paper").filter("node < target").select(F.col("node").alias("source"), "target").distinct()
    return pairs.select("source", "target", F.lit(label).alias("label"), F.lit(1).cast("long").alias("weight"))


def top_nodes(nodes: DataFrame, n: int = 120) -> DataFrame:
    """Papers first, then by count and label: an ordered limit, merged from each task's own."""
    return nodes.orderBy(F.when(F.col("type") == "paper", 0).otherwise(1), F.desc("count"), "label", "node").limit(n)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes``."""
    keys = nodes.select("node")
    return edges.join(keys.withColumnRenamed("node", "source"), "source", "left_semi").join(keys.withColumnRenamed("node", "target"), "target", "left_semi").select(*edges.columns)


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes_of(mentions(spark, sf_dir))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value edges and the co-occurrence of methods."""
    rows = stored(mentions(spark, sf_dir).select("paper", "type", "node"), "mentions")
    return value_edges(rows, distinct=True).unionByName(co_occurrence(rows, "method", CO_METHOD, distinct=True))


def graph_co_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return co_occurrence(mentions(spark, sf_dir), "keyword", CO_KEYWORD)


def graph_top_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_nodes(nodes_of(mentions(spark, sf_dir)))


def graph_induced_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Co-occurrence edges between the 180 top nodes."""
    rows = stored(mentions(spark, sf_dir), "mentions")
    # Rows of the top nodes only, before any pair is made: at most 180 nodes, so the semi join broadcasts them.
    some = rows.join(F.broadcast(top_nodes(nodes_of(rows), 180).select("node")), "node", "left_semi")
    return co_occurrence(some, "keyword", CO_KEYWORD).unionByName(co_occurrence(some, "method", CO_METHOD))


def graph_top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most mentioned labels of every type."""
    rank = F.row_number().over(W.partitionBy("type").orderBy(F.desc("count"), "label", "node"))
    ranked = nodes_of(mentions(spark, sf_dir)).withColumn("rank", rank).filter("rank <= 6")
    return ranked.groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]), "; ").alias("labels"))


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Mentions are distinct by paper, type and node, so each is an edge.
    nodes = mentions(spark, sf_dir).groupBy("node", "type").agg(F.count("*").alias("count"))
    n = nodes.agg(F.count("*").alias("nodes"), F.sum("count").alias("mentions"), F.coalesce(F.sum("count"), F.lit(0)).alias("edges"))
    papers = table(spark, sf_dir, "orders").agg(F.count("*").alias("papers"))
    return n.crossJoin(papers)  # one row each


def graph_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view: top 180, then types and a label search, then 80 of those, order kept."""
    top = top_nodes(nodes_of(mentions(spark, sf_dir)), 180)
    seen = top.filter(F.col("type").isin("keyword", "scene", "venue", "year") & ~F.col("node").isin("year:1992") & F.contains(F.lower("label"), F.lit("a")))
    return top_nodes(seen, 80)


def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degree and neighbours' weight of every keyword in the co-occurrence graph, both directions."""
    e = graph_co_keywords(spark, sf_dir)
    both = e.select("source", "target", "weight").unionByName(e.select(F.col("target").alias("source"), F.col("source").alias("target"), "weight"))
    return both.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("weight"))


def layout(nodes: DataFrame) -> DataFrame:
    """Positions by cluster (type) on rings of six: angle by rank, radius by ring."""
    rank = F.row_number().over(W.partitionBy("type").orderBy(F.desc("count"), "label", "node")) - 1
    ring = F.floor(rank / 6)
    angle = (rank % 6) * (3.141592653589793 / 3) + ring * 0.4
    radius = 60 + ring * 48
    r2 = lambda x: F.floor(x * 100 + 0.5) / 100
    return nodes.withColumn("x", r2(F.cos(angle) * radius)).withColumn("y", r2(F.sin(angle) * radius))


def graph_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = top_nodes(nodes_of(mentions(spark, sf_dir)), 120)
    return layout(top).select("node", "x", "y")


def value_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct capped values of every paper by type, in order, as one row."""
    rows = mentions(spark, sf_dir).filter("type = 'keyword'")
    return rows.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node", "value"))), lambda x: x["value"]), "|").alias("keywords"))




_MENTIONS = """m0 AS (
  SELECT o_orderkey AS paper, 0 AS ord, 'author' AS type, c_name AS value FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT o_orderkey, 0, 'year', year(o_orderdate)::VARCHAR FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT o_orderkey, 0, 'venue', o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT l_orderkey, l_linenumber, 'keyword', p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT l_orderkey, l_linenumber, 'method', 'part ' || p_partkey FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT l_orderkey, l_linenumber, 'scene', p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
m1 AS (SELECT paper, type, type || ':' || trim(regexp_replace(lower(value), '\\s+', ' ', 'g')) AS node, ord, value FROM m0),
m2 AS (SELECT paper, type, node, min({'ord': ord, 'value': value}) AS f FROM m1 GROUP BY ALL),
m3 AS (SELECT paper, type, node, f.ord AS ord, f.value AS value, row_number() OVER (PARTITION BY paper, type ORDER BY f.ord, node) AS r FROM m2),
m AS (SELECT paper, type, node, ord, value FROM m3 WHERE r <= CASE WHEN type = 'author' THEN 8 ELSE 10 END),
n AS (SELECT node, type, min({'paper': paper, 'ord': ord, 'value': value}).value AS label, count(*) AS count, count(DISTINCT paper) AS papers FROM m GROUP BY node, type)""".replace("\\\\s", "\\s")
_LABEL = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EDGE_LABELS.items()) + " END"
_EDGES = f"ve AS (SELECT 'paper:' || paper AS source, node AS target, {_LABEL} AS label, count(*) AS weight FROM m GROUP BY ALL)"


def _co(kind: str, label: str, name: str) -> str:
    return f"""{name}0 AS (SELECT DISTINCT paper, node FROM m WHERE type = '{kind}'),
{name}1 AS (SELECT * FROM {name}0 WHERE node IN (SELECT node FROM {name}0 GROUP BY node HAVING count(*) > 1)),
{name} AS (SELECT DISTINCT a.node AS source, b.node AS target, '{label}' AS label, 1::BIGINT AS weight FROM {name}1 a JOIN {name}1 b ON a.paper = b.paper AND a.node < b.node)"""


def _top(n: int, source: str = "n") -> str:
    return f"SELECT * FROM {source} ORDER BY count DESC, label, node LIMIT {n}"


QUERIES = {
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "graph_co_keywords": graph_co_keywords,
    "graph_top_nodes": graph_top_nodes,
    "graph_induced_edges": graph_induced_edges,
    "graph_top_labels": graph_top_labels,
    "graph_stats": graph_stats,
    "graph_view": graph_view,
    "graph_neighbours": graph_neighbours,
    "graph_layout": graph_layout,
    "graph_value_lists": value_lists,
}
ORACLES = {
    "graph_nodes": f"WITH {_MENTIONS} SELECT * FROM n",
    "graph_edges": f"WITH {_MENTIONS}, {_EDGES}, {_co('method', CO_METHOD, 'cm')} SELECT * FROM ve UNION ALL SELECT * FROM cm",
    "graph_co_keywords": f"WITH {_MENTIONS}, {_co('keyword', CO_KEYWORD, 'ck')} SELECT * FROM ck",
    "graph_top_nodes": f"WITH {_MENTIONS} {_top(120)}",
    "graph_induced_edges": f"WITH {_MENTIONS}, {_co('keyword', CO_KEYWORD, 'ck')}, {_co('method', CO_METHOD, 'cm')}, t AS ({_top(180)}) SELECT * FROM (SELECT * FROM ck UNION ALL SELECT * FROM cm) WHERE source IN (SELECT node FROM t) AND target IN (SELECT node FROM t)",
    "graph_top_labels": f"WITH {_MENTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY count DESC, label, node) AS rank FROM n) SELECT type, string_agg(label, '; ' ORDER BY rank) AS labels FROM r WHERE rank <= 6 GROUP BY type",
    "graph_stats": f"WITH {_MENTIONS}, {_EDGES} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT sum(count) FROM n)::BIGINT AS mentions, (SELECT count(*) FROM ve) AS edges, (SELECT count(*) FROM orders) AS papers",
    "graph_view": f"WITH {_MENTIONS}, t AS ({_top(180)}), s AS (SELECT * FROM t WHERE type IN ('keyword', 'scene', 'venue', 'year') AND node <> 'year:1992' AND contains(lower(label), 'a')) {_top(80, 's')}",
    "graph_neighbours": f"WITH {_MENTIONS}, {_co('keyword', CO_KEYWORD, 'ck')} SELECT node, count(*) AS degree, sum(weight)::BIGINT AS weight FROM (SELECT source AS node, weight FROM ck UNION ALL SELECT target, weight FROM ck) GROUP BY node",
    "graph_layout": f"WITH {_MENTIONS}, t AS ({_top(120)}), r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY count DESC, label, node) - 1 AS k FROM t) SELECT node, floor(cos((k % 6) * (3.141592653589793 / 3) + (k // 6) * 0.4) * (60 + (k // 6) * 48) * 100 + 0.5) / 100 AS x, floor(sin((k % 6) * (3.141592653589793 / 3) + (k // 6) * 0.4) * (60 + (k // 6) * 48) * 100 + 0.5) / 100 AS y FROM r",
    "graph_value_lists": f"WITH {_MENTIONS} SELECT paper, string_agg(value, '|' ORDER BY ord, node) AS keywords FROM m WHERE type = 'keyword' GROUP BY paper",
}
