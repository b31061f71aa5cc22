"""Connected components of a link table by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbitspark.llm.common import Scratch, join_groups


def connected_components(links: DataFrame, name: str = "components", most: int = 60, scratch: Scratch | None = None) -> DataFrame:
    """``node`` and ``comp``, the smallest node of its component, for every node of links (a, b) of longs.

    Each round every node points at the smallest node it knows, first among larger neighbours, then
    among smaller ones; rounds are written to the shared folder and stop when no link changes. Hubs meet
    their neighbours by a broadcast row instead of in one task.
    """
    scratch = scratch or Scratch(links.sparkSession)
    edges = scratch.stash(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    total, before = 2 * edges.count(), None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
        large = join_groups(both, low, "a", "degree", total, inner=True).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        floor = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))
        small = join_groups(large, floor, "a", "degree", total, inner=True)
        # A node and all its smaller neighbours link to the smallest of them.
        nxt = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(floor.select("a", F.col("m").alias("b"))).distinct()
        nxt = scratch.stash(nxt, name)
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.discard(edges)
        edges, total = nxt, 2 * state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)
