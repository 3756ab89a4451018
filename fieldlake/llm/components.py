"""Connected components of a graph of links, by rounds of contraction.

In each round every vertex moves to the least of itself and its neighbours, and
the links between vertices that moved to different places are the next graph.
Vertex numbers should be hashes: with random numbers a round shrinks even a long
chain by a constant factor.  Each round is a written table, so lineage stays short
and a lost executor repeats a task, not a round.  Both sides of every join grow with
the links, so they are merge joins by hint, however small the files are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.staging import stage


def components(links: DataFrame) -> DataFrame:
    """``vertex long, component long`` of every vertex in ``links`` (``a long, b long``, either direction, repeats allowed)."""
    graph = stage(_both_ways(links), "links")
    labels = None
    while not graph.isEmpty():
        moves = stage(graph.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")), "moves")
        if labels is None:
            labels = moves.select(F.col("a").alias("vertex"), F.col("to").alias("component"))
        else:
            step = moves.withColumnRenamed("a", "component")
            labels = stage(labels.hint("merge").join(step, "component", "left").select("vertex", F.coalesce("to", "component").alias("component")), "labels")
        begun = graph.where(F.col("a") < F.col("b")).hint("merge").join(moves.select("a", F.col("to").alias("x")), "a")
        ends = begun.hint("merge").join(moves.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        graph = stage(_both_ways(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), "links")
    if labels is None:
        return graph.select(F.col("a").alias("vertex"), F.col("b").alias("component"))
    return labels


def _both_ways(links: DataFrame) -> DataFrame:
    pair = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return links.where(F.col("a") != F.col("b")).select(pair.alias("p")).select("p.a", "p.b").distinct()
