"""Connected components by alternating large and small stars, as joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.llm.tables import discard, materialise


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """v, root (the smallest vertex that v reaches) for each vertex of links (columns a, b), roots included.

    A link of a vertex with itself, or with null, counts for nothing; repeated links
    count once; no links give no rows. Each round connects every vertex's larger neighbours, then its smaller ones,
    with its least neighbour; the edges end as stars around the roots.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "links", True)
    mark = _mark(edges)
    while mark[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("w")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("w > u").select(F.col("w").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, materialise(small.union(lower.select("a", "m")).distinct(), "links", True)
        discard(before)
        last, mark = mark, _mark(edges)
        if mark == last:
            break
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(edges.select("b", "b")).distinct()
