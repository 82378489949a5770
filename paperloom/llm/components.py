"""Connected components of an edge table, by joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): equal labels for connected nodes.

    Each round gives a node the least label among itself and its neighbours, then the
    label of that label (pointer jumping), so the rounds grow with the logarithm of the
    longest path.  Labels meet their neighbours' by a sum that combines before the
    shuffle, so a node with any number of edges costs no single task.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "component-edges")
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "component-labels")
    for _ in range(most_rounds):
        seen = both.join(state.withColumnsRenamed({"node": "b", "label": "other"}), "b").groupBy("a").agg(F.min("other").alias("least"))
        low = state.join(seen.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "least").alias("low"))
        jump = state.select(F.col("node").alias("low"), F.col("label").alias("further"))
        new = stored(low.join(jump, "low").select("node", F.least("low", "further").alias("next"), "label"), "component-labels")
        changed = not new.filter("next <> label").isEmpty()
        drop_stored(state)
        state = new.select("node", F.col("next").alias("label"))
        if not changed:
            return state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
