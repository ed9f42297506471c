"""Connected components of an edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutweave.functions.storage import discard, materialise, scratch


def components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> (id, component): the smallest id that edges reach, for every id on some edge.

    Large-star and small-star steps alternate, about log(n) rounds, each a few aggregations and joins
    over at most as many edges as there were.  They end when every larger end has one root and no
    root has a smaller one, which the steps' own joins tell exactly.  Each node's smallest
    neighbour is written out before the join, so that both sides of it are exchanges and the
    edges of a hub can be split.  Edges with a null end and loops are left out.
    """
    with scratch() as own:
        e = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "components")
        for _ in range(max_rounds):
            # Large star: each node's larger neighbours go to the smallest of it and its neighbours.
            least = materialise(e.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("k")), "components-least")
            large = e.join(least.select(F.col("b").alias("a"), "m"), "a", "left").select(F.coalesce("m", "a").alias("a"), "b", F.col("m").isNotNull().alias("moved"))
            large = materialise(large.groupBy("a", "b").agg(F.max("moved").alias("moved")), "components-large")
            if not least.where("k > 1").take(1) and not large.where("moved").take(1):
                break
            # Small star: each node's smaller neighbours and the node itself go to the smallest of them.
            least2 = materialise(large.groupBy("b").agg(F.min("a").alias("m")), "components-least")
            small = large.join(least2, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a < b")
            after = materialise(small.distinct(), "components")
            for old in (e, least, large, least2):
                discard(old)
            e = after
        else:
            raise RuntimeError(f"no fixed point within {max_rounds} rounds")
        own.keep(e)
    roots = e.select(F.col("a").alias("id")).distinct()
    return e.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(roots.select("id", F.col("id").alias("component")))
