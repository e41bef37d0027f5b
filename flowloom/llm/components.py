"""Connected components of a table of links, by alternating large and small stars.

Each round hangs every node's neighbours on the smallest one. Rounds end when
the table no longer changes; their number grows with the logarithm of the
longest path. Every round is written to the shared folder, so that lineage
stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.session import materialise


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``id, root`` for every node of ``links`` (``a, b``, numbers) but the roots; root is the smallest of the component.

    Links of a node to itself and repeated links change nothing; without links the result is empty.
    """
    edges = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "components")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(lowest, "u").filter("v > u").select(
            F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        edges = materialise(small.select("u", F.col("m").alias("v")).unionByName(
            small.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct(), "components")
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
