"""Connected components of an edge table, wholly distributed.

Alternating large-star and small-star passes (Kiveris et al., "Connected
Components in MapReduce and Beyond"): every pass is a partial aggregation and
a join on node ids. A node with millions of neighbours is pre-aggregated
before the shuffle, its least neighbour is broadcast and its edges stay where they are, so they
are never gathered in one task or on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import Scratch, join_hot


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` to ``(node, component)``, component being the least node reachable.

    Only nodes that touch an edge between two different nodes are returned.
    Null ends, loops and repeated edges are ignored; an empty table gives an
    empty table. The passes repeat until the edge table is a fixed point.
    """
    e = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e, mark = _save(e, scratch)
    for _ in range(max_rounds):
        last, before = e, mark
        e, mark = _save(_passes(e, mark[0]), scratch)
        scratch.drop(last)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _save(e: DataFrame, scratch: Scratch) -> tuple[DataFrame, tuple]:
    e = scratch.save(e, "edges")
    return e, tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _passes(e: DataFrame, rows: int) -> DataFrame:
    """One large-star and one small-star pass over ``rows`` edges. Neither makes more edges than it takes."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    e = join_hot(both, least, ["u"], 2 * rows).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = join_hot(e, least, ["u"], rows).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
