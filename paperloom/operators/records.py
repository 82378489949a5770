"""Small lookups and picks over records: reusable results, cache documents, first-wins lists, Markdown blocks, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import table
from .library import first_by
from .lines import LINES, LINES_AND_SAMPLES, lines, lines_and_samples

# Bounds of lists, and the labels that are shown first.
REF_SIGNS, MOST_QUERIES, MOST_SHOWN, LOOK_BACK_DAYS = 48, 5, 8, 7
SHOWN_OF_PAPER = ("中文标题", "英文标题", "年份", "期刊", "期刊/会议", "作者", "研究场景", "研究方法", "RL 算法", "是否使用 PINN", "评价指标", "核心创新点", "局限性")
SHOWN_OF_VALUE = ("研究场景", "研究方法", "RL 算法", "关键词", "评价指标", "核心创新点", "局限性", "可借鉴点")


def reusable(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (hash, mode) with the path of the first record (hash, mode, path, pos) that has one, else null."""
    first = first_by(records.filter(F.coalesce("path", F.lit("")) != "").select("hash", "mode", "pos", "path"), ["hash", "mode"], ["pos"])
    return wanted.join(first.select("hash", "mode", "path"), ["hash", "mode"], "left")


def cache_document(blocks: DataFrame, cached: DataFrame) -> DataFrame:
    """Translatable ``blocks`` (id, original) with what ``cached`` (original, translation, pos) has for them, else ''.

    Found by the whole original, else by its normalised form; the last of equal keys counts.
    """
    some = blocks.filter(T.is_translatable(F.col("original"))).withColumns({"h": F.md5("original"), "k": F.md5(T.key_of(F.col("original")))})
    known = cached.filter(F.coalesce("translation", F.lit("")) != "").withColumns({"h": F.md5("original"), "k": F.md5(T.key_of(F.col("original")))})
    by_hash = known.groupBy("h").agg(F.max_by("translation", "pos").alias("t1"))
    by_key = known.groupBy("k").agg(F.max_by("translation", "pos").alias("t2"))
    return some.join(by_hash, "h", "left").join(by_key, "k", "left").select("id", "original", F.coalesce("t1", "t2", F.lit("")).alias("translation"))


def distinct_refs(refs: DataFrame, by: str, most: int) -> DataFrame:
    """References (``by``, pos, page, section, text), the first of each page, section and beginning of text, ``most`` of each ``by``."""
    key = F.concat_ws(":", F.col("page").cast("string"), "section", F.substring("text", 1, REF_SIGNS))
    one = first_by(refs.withColumn("_k", key), [by, "_k"], ["pos"]).drop("_k")
    # The filter is on the rank itself, so that every task keeps its own first rows before they meet.
    placed = one.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("pos"))).filter(F.col("place") <= most)
    return placed.withColumn("place", F.col("place").cast("long"))


def search_queries(prompt: Column) -> Column:
    """Titles and longer Latin phrases of a prompt, distinct, five at most."""
    trimmed = lambda xs: F.transform(xs, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    titles = F.filter(trimmed(F.regexp_extract_all(prompt, F.lit(r"英文标题[:：]\s*([^\n]+)"), 1)), lambda x: (x != "") & ~F.contains(x, F.lit("未填写")))
    phrases = F.filter(trimmed(F.regexp_extract_all(prompt, F.lit(r"([A-Z][A-Za-z0-9:,\- ]{24,120})"), 1)), lambda x: F.size(F.split(x, " ")) >= 4)
    return F.slice(F.array_distinct(F.concat(titles, phrases)), 1, MOST_QUERIES)


def shown_entries(values: Column, paper: Column) -> Column:
    """Up to eight entries of a map of labels: those whose labels are looked for first, then the others in order."""

    def pick(wanted: tuple[str, ...], entries: Column) -> Column:
        hit = lambda name: F.try_element_at(F.filter(entries, lambda e: F.contains(F.lower(e["key"]), F.lit(name.lower()))), F.lit(1))
        first = F.array_distinct(F.filter(F.array(*[hit(n) for n in wanted]), lambda e: e.isNotNull()))
        return F.slice(F.array_distinct(F.concat(first, F.slice(entries, 1, MOST_SHOWN))), 1, MOST_SHOWN)

    return T.let(F.map_entries(values), lambda e: F.when(paper, pick(SHOWN_OF_PAPER, e)).otherwise(pick(SHOWN_OF_VALUE, e)))


def markdown_kind(line: Column) -> Column:
    """The kind of a Markdown line: '' (blank), h, ul, ol, quote or p."""
    t = T.stripped(line)
    return F.when(t == "", "").when(t.rlike(r"^#{1,4}\s+.+$"), "h").when(t.rlike(r"^[-*]\s+.+$"), "ul").when(t.rlike(r"^\d+[.)]\s+.+$"), "ol").when(t.rlike(r"^>\s?.+$"), "quote").otherwise("p")


def markdown_runs(rows: DataFrame) -> DataFrame:
    """Blocks of Markdown lines (doc_id, pos, t): neighbours of one kind, headings alone; blank lines part them."""
    doc = W.partitionBy("doc_id").orderBy("pos")
    kinds = rows.withColumn("kind", markdown_kind(F.col("t")))
    new = (F.col("kind") == "h") | ~F.lag("kind").over(doc).eqNullSafe(F.col("kind"))
    marked = kinds.withColumn("run", F.sum(new.cast("long")).over(doc.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.filter("kind <> ''").groupBy("doc_id", "run", "kind").agg(F.min("pos").alias("first_pos"), F.count("*").alias("lines"))


def epoch_ms(text: Column) -> Column:
    """Milliseconds of an ISO time; 0 for a blank or unreadable one."""
    return F.coalesce(F.unix_millis(F.try_to_timestamp(T.nonempty(F.trim(text)))), F.lit(0)).cast("long")


def minutes_left(until_ms: Column, now_ms: Column) -> Column:
    """Whole minutes until a time, rounded up; 0 once it has passed."""
    return F.greatest(F.lit(0), F.ceil((until_ms - now_ms) / 60_000)).cast("long")


def is_recent(time_ms: Column, now_ms: Column, days: int = LOOK_BACK_DAYS) -> Column:
    return time_ms >= now_ms - days * 86_400_000


# -- queries --------------------------------------------------------------------------------


def reusable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records by user and type (paths where the value is high), looked up for every user and type."""
    e = table(spark, sf_dir, "events")
    records = e.select(F.col("user_id").alias("hash"), F.col("event_type").alias("mode"), F.when(F.col("value") > 40, F.concat(F.lit("/r/"), F.col("event_id").cast("string"))).alias("path"), F.col("event_id").alias("pos"))
    return reusable(records, records.select("hash", "mode").distinct())


def cached_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents of odd ids, with the translations that those of even ids have."""
    rows = lines(table(spark, sf_dir, "documents"))
    blocks = rows.filter("doc_id % 2 = 1").select(F.struct("doc_id", "pos").alias("id"), F.col("t").alias("original"))
    cached = rows.filter("doc_id % 2 = 0").select(F.col("t").alias("original"), F.concat(F.lit("t:"), F.col("doc_id").cast("string")).alias("translation"), F.struct("doc_id", "pos").alias("pos"))
    return cache_document(blocks, cached).select("id.doc_id", "id.pos", "translation")


def line_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as references, the first five distinct ones of each language."""
    rows = lines(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    refs = rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.struct("doc_id", "pos").alias("pos"), F.col("pos").alias("page"), F.lit("s").alias("section"), F.col("t").alias("text"))
    return distinct_refs(refs, "lang", 5).select("lang", "place", "pos.doc_id", F.col("pos.pos").alias("line"))


def line_search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search queries of every line."""
    rows = lines_and_samples(spark, sf_dir)
    return rows.select("doc_id", "pos", F.array_join(search_queries(F.col("t")), "|").alias("queries")).filter("queries <> ''")


def markdown_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and sample lines read as Markdown blocks."""
    return markdown_runs(lines_and_samples(spark, sf_dir))


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of events as ISO texts and back, minutes to the next hour's end, and whether they are of the last week."""
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, "").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"))
    ms = e.select("event_id", epoch_ms(F.col("iso")).alias("ms"))
    end = ms.agg(F.max("ms").alias("now"))
    return ms.crossJoin(end).select("event_id", "ms", minutes_left(F.col("ms") + 3_600_000, F.col("now")).alias("minutes"), is_recent(F.col("ms"), F.col("now")).alias("recent"))  # one row of ends


def shown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of workbook rows that are shown of papers and of values."""
    from .workbook import _books, row_values, sheet_rows

    rows = sheet_rows(_books(spark, sf_dir)).filter("pos > 0")
    joined = lambda x: F.array_join(F.transform(x, lambda e: e["key"]), "|")
    # Every row lacks other labels, by its number.
    number = F.regexp_extract("row_id", r"\d+", 0).cast("long")
    values = F.map_filter(row_values(), lambda k, _: F.pmod(number + F.length(k), F.lit(3)) != 0)
    return rows.select("row_id", joined(shown_entries(values, F.lit(True))).alias("of_paper"), joined(shown_entries(values, F.lit(False))).alias("of_value"))


QUERIES = {f.__name__: f for f in (reusable_records, cached_lines, line_refs, line_search_queries, markdown_structure, event_times, shown_rows)}
_KEY = rf"trim(regexp_replace(lower(t), '{T.SPACE_RE2}', ' ', 'g'), ' ')"
_T = rf"regexp_replace(t, '^{T.SPACE_RE2}|{T.SPACE_RE2}$', '', 'g')"
_LABELS = ", ".join(f"'{x}'" for x in ("论文", "中文标题", "英文标题", "创新点", "局限点", "方法", "数据/任务", "指标/结果", "复现计划", "后续 idea", "备注"))


def _shown_sql(wanted: tuple[str, ...]) -> str:
    hits = ", ".join(f"list_filter(e, lambda x: contains(lower(x), '{n.lower()}'))[1]" for n in wanted)
    every = f"list_concat(list_filter([{hits}], lambda x: x IS NOT NULL), e[1:{MOST_SHOWN}])"
    return f"array_to_string(list_filter({every}, lambda x, i: list_position({every}, x) = i)[1:{MOST_SHOWN}], '|')"


ORACLES = {
    "reusable_records": "WITH r AS (SELECT user_id AS hash, event_type AS mode, arg_min('/r/' || event_id, event_id) AS path FROM events WHERE value > 40 GROUP BY ALL) SELECT DISTINCT user_id AS hash, event_type AS mode, r.path FROM events LEFT JOIN r ON user_id = r.hash AND event_type = r.mode",
    "cached_lines": f"WITH l AS (SELECT *, {_KEY} AS k, {T.SQL['is_translatable']} AS ok FROM {LINES}), c AS (SELECT * FROM l WHERE doc_id % 2 = 0), h AS (SELECT t, arg_max('t:' || doc_id, {{'d': doc_id, 'p': pos}}) AS t1 FROM c GROUP BY t), n AS (SELECT k, arg_max('t:' || doc_id, {{'d': doc_id, 'p': pos}}) AS t2 FROM c GROUP BY k) SELECT l.doc_id, l.pos, coalesce(t1, t2, '') AS translation FROM l LEFT JOIN h ON l.t = h.t LEFT JOIN n ON l.k = n.k WHERE l.doc_id % 2 = 1 AND ok",
    "line_refs": f"WITH r AS (SELECT coalesce(d.lang, '') AS lang, l.doc_id, l.pos, l.t FROM {LINES} l JOIN documents d USING (doc_id)), o AS (SELECT *, row_number() OVER (PARTITION BY lang, pos, substr(t, 1, {REF_SIGNS}) ORDER BY doc_id, pos) AS k FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, pos) AS place FROM o WHERE k = 1) SELECT lang, place::BIGINT AS place, doc_id, pos AS line FROM p WHERE place <= 5",
    "line_search_queries": rf"WITH q AS (SELECT doc_id, pos, list_filter(list_transform(regexp_extract_all(t, '([A-Z][A-Za-z0-9:,\- ]{{24,120}})', 1), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'), ' ')), lambda x: len(string_split(x, ' ')) >= 4) AS xs FROM {LINES_AND_SAMPLES}) SELECT doc_id, pos, array_to_string(list_slice(list_filter(xs, lambda x, i: list_position(xs, x) = i), 1, 5), '|') AS queries FROM q WHERE len(xs) > 0",
    "markdown_structure": rf"WITH k AS (SELECT doc_id, pos, CASE WHEN {_T} = '' THEN '' WHEN regexp_matches({_T}, '^#{{1,4}}\s+.+$') THEN 'h' WHEN regexp_matches({_T}, '^[-*]\s+.+$') THEN 'ul' WHEN regexp_matches({_T}, '^\d+[.)]\s+.+$') THEN 'ol' WHEN regexp_matches({_T}, '^>\s?.+$') THEN 'quote' ELSE 'p' END AS kind FROM {LINES_AND_SAMPLES}), n AS (SELECT *, (kind = 'h' OR lag(kind) OVER w IS DISTINCT FROM kind)::INT AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS run FROM n) SELECT doc_id, run, kind, min(pos) AS first_pos, count(*) AS lines FROM r WHERE kind <> '' GROUP BY doc_id, run, kind",
    "event_times": "WITH m AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE epoch_ms(date_trunc('second', ts)) END AS ms FROM events), n AS (SELECT *, (SELECT max(ms) FROM m) AS now FROM m) SELECT event_id, ms::BIGINT AS ms, greatest(0, ceil((ms + 3600000 - now) / 60000))::BIGINT AS minutes, ms >= now - 7 * 86400000 AS recent FROM n",
    "shown_rows": f"WITH k AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), e AS (SELECT k, list_filter([{_LABELS}], lambda x: (k + length(x)) % 3 <> 0) AS e FROM k) SELECT 'row-' || k AS row_id, {_shown_sql(SHOWN_OF_PAPER)} AS of_paper, {_shown_sql(SHOWN_OF_VALUE)} AS of_value FROM e",
}
