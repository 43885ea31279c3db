"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import cut, drop, joined


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Large star hangs each node's larger neighbours, small star its smaller ones, on the least node nearby. The second table
    is that of least nodes, a row for each node: its sums begin in the tasks, and as a written table it is sent or joined
    in exchanges of its own, so the rows of a node with very many neighbours need not lie in one task."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    near = joined(both, least, ["u"])
    if large:
        out = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b"), least


def _done(edges: DataFrame) -> bool:
    """Every node hangs on one other at most, and none on which others hang."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not sums.where("up > 1 or (up > 0 and down > 0)").head(1)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)`` but the components' least nodes themselves.

    Each round ends in a table in the shared folder, so the lineage stays short and a lost executor costs one round.
    Self-edges are ignored; an empty edge table gives an empty result.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _done(now):
        out, first = _star(now, True)
        out, second = _star(out, False)
        after = cut(out.distinct(), "edges")
        for done in (now, first, second):
            drop(done)
        now = after
    # a star forest: every a hangs on its root b
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
