"""Lines of documents: typed, filtered by detectors, ordered and grouped into sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos and t of every line; the position stands for the order that rows don't have."""
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "t"))


LINES = "(SELECT doc_id, (g - 1)::INT AS pos, string_split(coalesce(text, ''), chr(10))[g] AS t FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS g))"
#: Lines that the tables lack, so that every detector has a case.
SAMPLES = (
    "[12] A. Author, Some Title, 2020.",
    "3. Smith, John, A Book",
    "A, B, C, D, arXiv preprint 2019",
    "Robot hardware: A, B, C, D, E",
    "Deep Learning For Robot Control",
    "Ann Lee, Bob Ray, Cid Moe, Dan Poe, Eva Roe",
    "World Model",
    "I have seen things",
    "Ann Lee, Bob, Cid",
    "demonstration data and more",
    "open the door and pick the cup, then put it on the table and close",
    "data model prompt metadata of an episode",
    "I. INTRODUCTION",
    "II. R ELATED W ORK",
    "Methods",
    "Figure 1: Overview of the framework and its policy network",
    "Table 2. Results and success rate of the baselines",
    "Fig. 3: A failure case of the robot in an unstructured scene",
    "x_t = f(x, u) + e",
    "12: for i = 1 to n do",
    "a_1 = {b_2} ^ c_3 | [d]",
    "We propose a world model that maps RGB images and a language instruction to whole-body actions of a humanoid robot.",
    "Experiments",
    "The success rate and the collision rate of PPO, SAC and MPC are measured in simulation, and the tracking error falls while the planner uses an elevation map, because the policy network was trained by imitation learning on demonstrations.",
    "III. E XPERIMENTS The policy reaches a high success rate on long-horizon tasks with the safety constraint.",
    "References",
    "The last block of the references is not shown anywhere, although it is long enough to be prose.",
)


def samples(spark: SparkSession) -> DataFrame:
    """``SAMPLES`` as the lines of document -1."""
    return spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.posexplode(F.array(*[F.lit(x) for x in SAMPLES])).alias("pos", "t"))


def lines_and_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).unionByName(samples(spark))


_SAMPLED = ", ".join(f"(-1, {i}, '{x}')" for i, x in enumerate(SAMPLES))
LINES_AND_SAMPLES = f"(SELECT * FROM {LINES} UNION ALL SELECT * FROM (VALUES {_SAMPLED}) v(doc_id, pos, t))"
TYPE_SQL = f"CASE WHEN regexp_matches(trim(t), '{T.CAPTION}') THEN 'caption' WHEN {T.SQL['is_formula'].replace('(t', '(trim(t)')} THEN 'formula' WHEN regexp_matches(trim(t), '{T.CAPITALS}') OR {T.SQL['is_section_heading']} THEN 'heading' ELSE 'paragraph' END"


def _detector(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lines_and_samples(spark, sf_dir).filter(T.DETECTORS[name](F.col("t"))).select("doc_id", "pos")

    query.__doc__ = f"Lines that {name.replace('_', ' ')}."
    return query


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, letters, capitals, small letters and ASCII share of every line."""
    t = F.col("t")
    return lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "pos", T.count(t, T.ALNUM).cast("long").alias("words"), T.count(t, T.LETTER).cast("long").alias("letters"), T.count(t, r"\p{Lu}").cast("long").alias("upper"), T.count(t, r"\p{Ll}").cast("long").alias("lower"), F.round(T.ratio(t, r"[\x00-\x7F]"), 6).alias("ascii_ratio")
    )


def sectioned(typed: DataFrame) -> DataFrame:
    """Running section (last heading so far), its order of appearance, and paragraph order in it.

    ``typed``: doc_id, pos, t, kind.  All windows share the key, so there is one shuffle.
    """
    doc = W.partitionBy("doc_id").orderBy("pos")
    upto = doc.rowsBetween(W.unboundedPreceding, W.currentRow)
    section = F.coalesce(F.last(F.when(F.col("kind") == "heading", F.trim("t")), ignorenulls=True).over(upto), F.lit("Page 1"))
    rows = typed.withColumn("section", section)
    rows = rows.withColumn("_first", F.min("pos").over(W.partitionBy("doc_id", "section")))
    rows = rows.withColumn("section_order", F.dense_rank().over(W.partitionBy("doc_id").orderBy("_first")).cast("long"))
    inside = W.partitionBy("doc_id", "section").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    paragraph = F.col("kind") == "paragraph"
    return rows.withColumn("paragraph_order", F.when(paragraph, F.sum(paragraph.cast("long")).over(inside))).drop("_first")


def line_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(table(spark, sf_dir, "documents")).select("doc_id", "pos", T.line_type(F.col("t")).alias("kind"))


def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = lines(table(spark, sf_dir, "documents")).withColumn("kind", T.line_type(F.col("t")))
    return sectioned(typed).select("doc_id", "pos", "section_order", "paragraph_order", F.length("section").cast("long").alias("section_length"))


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.sentences(F.coalesce("text", F.lit("")))).cast("long").alias("sentences"), F.aggregate(T.sentences(F.coalesce("text", F.lit(""))), F.lit(0), lambda a, s: F.greatest(a, F.length(s))).cast("long").alias("longest"))


def block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the first line of each document, by both hash functions."""
    t = F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 80)
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("pdf-1-"), T.fnv36(t)).alias("block_id"), F.concat(F.lit("paper-"), T.poly36(t)).alias("paper_id"))


def line_block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every line as a block, over page, kind, section and the whole line, and its id as a paper."""
    return block_rows(lines(table(spark, sf_dir, "documents")))


def block_rows(rows: DataFrame) -> DataFrame:
    """``rows``: doc_id, pos, t."""
    t = F.col("t")
    source = F.concat_ws("|", F.lit("1"), "kind", "section", t)
    return sectioned(rows.withColumn("kind", T.line_type(t))).select("doc_id", "pos", F.concat(F.lit("pdf-1-"), T.fnv36(source)).alias("block_id"), F.concat(F.lit("paper-"), T.poly36(t)).alias("paper_id"))


def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines: a new one begins after a short line, or where a line starts in lower case after a long one."""
    w = W.partitionBy("doc_id").orderBy("pos")
    before = F.lag(F.length("t")).over(w)
    new = F.when(F.coalesce(before, F.lit(0)) < 40, 1).otherwise(0)
    runs = lines(table(spark, sf_dir, "documents")).withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("doc_id", "run").agg(F.count("*").alias("lines"), F.min("pos").alias("first_pos"), F.sum(F.length("t")).alias("chars"))


def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised lines that occur twice or more, with their documents."""
    keyed = lines(table(spark, sf_dir, "documents")).select("doc_id", F.md5(T.key_of(F.col("t"))).alias("line_key"), F.trim("t").alias("t")).filter("t <> ''")
    return keyed.groupBy("line_key").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")).filter("n >= 2")


def cleaned_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning functions over the first line of each document."""
    t = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    return table(spark, sf_dir, "documents").select("doc_id", T.readable(t).alias("clean"), T.truncated(t, 60).alias("short"), T.html_escaped(t).alias("escaped"), T.redacted(t).alias("safe"), F.size(T.values_of(t)).cast("long").alias("n_values"), F.array_join(T.values_of(t), "; ").alias("listed"))


def cleaned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning functions over every line of each document."""
    return cleaned_rows(lines(table(spark, sf_dir, "documents")))


def cleaned_rows(rows: DataFrame) -> DataFrame:
    """``rows``: doc_id, pos, t."""
    t = F.col("t")
    return rows.select("doc_id", "pos", T.readable(t).alias("clean"), T.truncated(t, 60).alias("short"), T.html_escaped(t).alias("escaped"), T.redacted(t).alias("safe"), F.size(T.values_of(t)).cast("long").alias("n_values"), F.array_join(T.values_of(t), "; ").alias("listed"))


QUERIES = {f"line_{name}": _detector(name) for name in T.SQL} | {
    "line_counts": line_counts,
    "line_types": line_types,
    "line_sections": line_sections,
    "sentence_split": sentence_rows,
    "block_ids": block_ids,
    "paragraph_breaks": paragraph_breaks,
    "duplicate_lines": duplicate_lines,
    "cleaned_first_lines": cleaned_first_lines,
    "line_block_ids": line_block_ids,
    "cleaned_lines": cleaned_lines,
}

_FOLD = "lower(to_base(list_reduce(list_prepend({seed}::UBIGINT, list_transform(string_split(t, ''), lambda c: unicode(c)::UBIGINT)), lambda h, c: {step})::BIGINT, 36))"
_KEY = rf"trim(regexp_replace(lower(t), '{T.SPACE_RE2}', ' ', 'g'), ' ')"
_CLEAN = rf"trim(regexp_replace(replace(t, chr(65533), ''), '{T.SPACE_RE2}', ' ', 'g'), ' ')"
ORACLES = {f"line_{name}": f"SELECT doc_id, pos FROM {LINES_AND_SAMPLES} WHERE {sql}" for name, sql in T.SQL.items()} | {
    "line_counts": rf"SELECT doc_id, pos, len(regexp_extract_all(t, '{T.ALNUM}'))::BIGINT AS words, len(regexp_extract_all(t, '\p{{L}}'))::BIGINT AS letters, len(regexp_extract_all(t, '\p{{Lu}}'))::BIGINT AS upper, len(regexp_extract_all(t, '\p{{Ll}}'))::BIGINT AS lower, round(CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '[\x00-\x7F]')) / length(t) ELSE 0 END, 6) AS ascii_ratio FROM {LINES}",
    "line_types": f"SELECT doc_id, pos, {TYPE_SQL} AS kind FROM {LINES}",
    "line_sections": f"""WITH k AS (SELECT doc_id, pos, t, {TYPE_SQL} AS kind FROM {LINES}),
s AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN trim(t) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Page 1') AS section FROM k),
f AS (SELECT *, min(pos) OVER (PARTITION BY doc_id, section) AS first FROM s)
SELECT doc_id, pos, dense_rank() OVER (PARTITION BY doc_id ORDER BY first)::BIGINT AS section_order,
  CASE WHEN kind = 'paragraph' THEN (sum((kind = 'paragraph')::INT) OVER (PARTITION BY doc_id, section ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT END AS paragraph_order, length(section)::BIGINT AS section_length FROM f""",
    "sentence_split": r"WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') AS xs FROM documents) SELECT doc_id, len(xs)::BIGINT AS sentences, coalesce(list_max(list_transform(xs, lambda x: length(x))), 0)::BIGINT AS longest FROM s",
    "block_ids": f"SELECT doc_id, 'pdf-1-' || {_FOLD.format(seed=2166136261, step='(xor(h, c) * 16777619) & 4294967295')} AS block_id, 'paper-' || {_FOLD.format(seed=0, step='(h * 31 + c) & 4294967295')} AS paper_id FROM (SELECT doc_id, substr(string_split(coalesce(text, ''), chr(10))[1], 1, 80) AS t FROM documents)",
    "paragraph_breaks": f"WITH b AS (SELECT *, CASE WHEN coalesce(lag(length(t)) OVER (PARTITION BY doc_id ORDER BY pos), 0) < 40 THEN 1 ELSE 0 END AS new FROM {LINES}), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS run FROM b) SELECT doc_id, run, count(*) AS lines, min(pos) AS first_pos, sum(length(t))::BIGINT AS chars FROM r GROUP BY doc_id, run",
    "duplicate_lines": f"SELECT md5({_KEY}) AS line_key, count(*) AS n, count(DISTINCT doc_id) AS docs FROM {LINES} WHERE trim(t, ' ') <> '' GROUP BY 1 HAVING count(*) >= 2",
    "cleaned_first_lines": rf"""WITH f AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS t FROM documents), c AS (SELECT *, {_CLEAN} AS k,
  list_filter(list_transform(regexp_split_to_array(t, '{T.SEPARATORS}'), lambda x: regexp_replace(x, '^[\s\v\x{{0085}}\p{{Z}}\x{{FEFF}}]+|[\s\v\x{{0085}}\p{{Z}}\x{{FEFF}}]+$', '', 'g')), lambda x: length(x) BETWEEN 2 AND 60 AND NOT regexp_matches(x, '{T.NOTHING}')) AS vs FROM f),
v AS (SELECT *, list_transform(vs, lambda x: trim(regexp_replace(lower(x), '{T.SPACE_RE2}', ' ', 'g'), ' ')) AS ks FROM c),
u AS (SELECT *, list_filter(vs, lambda x, i: list_position(ks, ks[i]) = i) AS us FROM v)
SELECT doc_id, CASE WHEN len(regexp_extract_all(k, '\?')) >= greatest(3, length(k) * 0.35) THEN '' ELSE k END AS clean,
  CASE WHEN length(t) > 60 THEN rtrim(substr(t, 1, 59), ' ') || '…' ELSE t END AS short, replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped,
  regexp_replace(t, 'sk-[A-Za-z0-9_-]{{8,}}', '[REDACTED_API_KEY]', 'g') AS safe, len(us)::BIGINT AS n_values, array_to_string(us, '; ') AS listed FROM u""",
}

# The same over every line.
_FIRST_LINES = "SELECT doc_id, string_split(coalesce(text, ''), chr(10))[1] AS t FROM documents"
ORACLES["cleaned_lines"] = ORACLES["cleaned_first_lines"].replace(_FIRST_LINES, f"SELECT * FROM {LINES}").replace("SELECT doc_id, CASE", "SELECT doc_id, pos, CASE")
_SECTIONS = f"""WITH k AS (SELECT doc_id, pos, t AS line, {TYPE_SQL} AS kind FROM {LINES}),
s AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'heading' THEN trim(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Page 1') AS section FROM k),
b AS (SELECT doc_id, pos, 'pdf-1-' || {_FOLD.format(seed=2166136261, step='(xor(h, c) * 16777619) & 4294967295')} AS block_id FROM (SELECT doc_id, pos, '1|' || kind || '|' || section || '|' || line AS t FROM s)),
p AS (SELECT doc_id, pos, 'paper-' || {_FOLD.format(seed=0, step='(h * 31 + c) & 4294967295')} AS paper_id FROM {LINES})"""
ORACLES["line_block_ids"] = f"{_SECTIONS} SELECT doc_id, pos, block_id, paper_id FROM b JOIN p USING (doc_id, pos)"
