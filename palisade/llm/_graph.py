"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm._spark import cut, discard

#: Steps are logarithmic in the longest path; this only guards against a bug.
MOST_STEPS = 64


def _print(e: DataFrame) -> tuple:
    row = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge, as a table of ``cut``; a component is its least node.

    ``edges`` has columns a and b of type long.  A node's neighbours are only
    ever pre-aggregated to their minimum and joined back, so a node with very
    many neighbours is split like any other skewed join key.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _print(e)
    if not before[0]:
        out = cut(e.select(F.col("a").alias("node"), F.col("b").alias("component")), "labels")
        discard(e)
        return out
    for _ in range(MOST_STEPS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discard(e)
        e, after = new, _print(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not settled after {MOST_STEPS} steps")
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = cut(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()), "labels")
    discard(e)
    return out
