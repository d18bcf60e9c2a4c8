"""Connected components of a link table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wfspark.llm.sources import discard, written


def _toward_least(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step over edges (u, v) with u > v. Larger: every neighbour above a vertex moves to the vertex's least
    neighbour; else a vertex and its neighbours below do."""
    if larger:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    else:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y"))
    least = both.groupBy(F.col("x").alias("of")).agg(F.min("y").alias("least"))
    least = least.select("of", F.least("of", "least").alias("least"))
    moved = both.join(least, F.col("x") == F.col("of"))
    if larger:
        moved = moved.where("y > x").select(F.col("y").alias("u"), F.col("least").alias("v"))
    else:
        moved = moved.select(F.col("y").alias("u"), F.col("least").alias("v")).union(least.select(F.col("of").alias("u"), F.col("least").alias("v")))
    return moved.where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and component (the least id it is linked with, however far) of every id in ``links`` (a, b).

    Alternating star contraction: every round is one table in the shared folder, until a round changes nothing. Edges never outnumber
    the links by more than the vertices, and a vertex with many neighbours is met by joins, not in one task."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links", light=True)
    state = None
    while True:
        before, edges = edges, written(_toward_least(_toward_least(edges, True), False), "stars", light=True)
        discard(before)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            out = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
            out._shared_path = edges._shared_path
            return out
        state = new
