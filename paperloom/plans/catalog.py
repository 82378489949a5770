"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _parts():
    from ..operators import bullets, contexts, decks, evidence, formulas, graph, grounding, highlights, layout, library, lines, matching, outlines, pages, queue, records, replies, requests, similarity, styles, workbook
    from ..sources import folders, formats
    from ..streaming import logs

    return [graph, lines, evidence, decks, matching, layout, pages, library, queue, records, requests, similarity, workbook, formats, folders, replies, formulas, grounding, highlights, styles, contexts, logs, bullets, outlines]


def queries() -> dict[str, Query]:
    return {k: f for part in _parts() for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _parts() for k, s in part.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["graph_edges"](spark, sf_dir)
