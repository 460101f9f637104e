"""Connected components of an undirected graph, distributed.

Edges point from the larger to the smaller node. A round moves every node first to the least neighbour of its smaller
neighbour, then all smaller neighbours of a node to the least of them; both steps keep the components and shrink every one to
a star around its least node, in a number of rounds logarithmic in its diameter. Least neighbours are aggregates that combine
before the shuffle, and nodes with a large share of the edges (the stars' middles) are joined by ``skew.join_counted``, so no hub meets in
one task. Every round is written to the shared checkpoint folder: lineage stays short and a lost executor loses nothing.

Defined results: null ends are ignored; loops and repeated edges change nothing; nodes that occur in no edge come out only
when given in ``nodes``; an empty graph gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import join_counted

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)`` with the least node of each component as its name."""
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))
    star = cut(pairs.distinct())
    total, seen = _mark(star)
    for _ in range(MAX_ROUNDS):
        if not total:
            break
        around = star.groupBy(F.col("v")).agg(F.count(F.lit(1)).alias("n"))
        below = star.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("m"))  # neighbours above v never are the least
        least = around.join(below, "v", "left").select("v", "n", F.coalesce("m", "v").alias("m"))
        moved = join_counted(star, least, "v", total).select("u", F.col("m").alias("v")).distinct()
        ends = moved.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        met = join_counted(moved, ends, "u", total)
        star = cut(
            met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(ends.select("u", F.col("m").alias("v"))).distinct()
        )
        before, (total, seen) = (total, seen), _mark(star)
        if before == (total, seen):
            break
    else:
        raise RuntimeError("the components did not settle")
    labels = star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = labels.unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    if nodes is None:
        return labels
    alone = nodes.select(F.col(nodes.columns[0]).alias("node")).dropna().distinct().join(labels, "node", "left_anti")
    return labels.unionByName(alone.select("node", F.col("node").alias("component")))


def _mark(star: DataFrame) -> tuple[int, int | None]:
    """Number of edges and a sum of their hashes: equal when nothing moved."""
    row = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
