"""Iterative frontier operators: breadth-first levels, residual reach and personalised PageRank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutweave.functions.storage import bucketed, discard, materialise, scratch

#: Levels that are tables of their own before they are merged into one.
MERGED = 16


def bfs_levels(arcs: DataFrame, seeds: DataFrame, *, max_rounds: int = 10_000) -> DataFrame:
    """(id, level): number of arcs from the nearest of ``seeds(id)``; only vertices that are reached.

    Each level is a table of its own; a round joins the arcs with the last level and takes out what was seen.  Levels
    are merged every MERGED rounds.  ``arcs`` should be a written table: every round reads it.
    """
    levels = [materialise(seeds.select("id", F.lit(0).alias("level")).distinct(), "bfs")]
    union = lambda xs: xs[0] if len(xs) == 1 else xs[0].unionAll(union(xs[1:]))
    whole: DataFrame | None = None
    for level in range(1, max_rounds):
        found = arcs.join(levels[-1].select(F.col("id").alias("u")), "u").select(F.col("v").alias("id")).distinct()
        seen = union(([whole] if whole is not None else []) + levels)
        new = materialise(found.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level")), "bfs")
        if not new.take(1):
            return seen
        levels.append(new)
        if len(levels) > MERGED:  # so that plans stay short: levels are merged now and then
            merged = materialise(union(([whole] if whole is not None else []) + levels[:-1]), "bfs")
            for old in ([whole] if whole is not None else []) + levels[:-1]:
                discard(old)
            whole, levels = merged, levels[-1:]
    raise RuntimeError(f"not ended after {max_rounds} rounds")


def residual_reach(flow_arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """Ids that ``flow_arcs(u, v, cap, flow)`` reach from ``sources(id)`` with residual capacity: a side of a minimum cut."""
    return bfs_levels(flow_arcs.where("cap - flow > 0").select("u", "v"), sources).select("id")


def distance_to_sinks(flow_arcs: DataFrame, sinks: DataFrame) -> DataFrame:
    """(id, level): residual distance to the nearest of ``sinks(id)``; unreached ids are left out."""
    return bfs_levels(flow_arcs.where("cap - flow > 0").select(F.col("v").alias("u"), F.col("u").alias("v")), sinks)


def personalised_pagerank(arcs: DataFrame, degrees: DataFrame, seeds: DataFrame, *, alpha: float = 0.1, eps: float = 1e-9, rounds: int | None = None, max_rounds: int = 5_000) -> DataFrame:
    """Synchronous push for every seed at once: (seed, id, p, r).

    A vertex with r >= eps * deg adds alpha * r to p, keeps (1 - alpha) r / 2 and spreads as much over
    its neighbours.  Ends when no vertex is active, or after ``rounds``; an error if neither is so after ``max_rounds``.
    ``seeds(seed)`` start with r = 1.  Arcs are bucketed by their tails once, so that rounds shuffle what is sent but not the arcs.
    """
    with scratch() as own:
        arcs = bucketed(arcs.select("u", "v"), "ppr-arcs", "u")
        return own.keep(_pushed(arcs, degrees, seeds, alpha, eps, rounds, max_rounds))


def _pushed(arcs: DataFrame, degrees: DataFrame, seeds: DataFrame, alpha: float, eps: float, rounds: int | None, max_rounds: int) -> DataFrame:
    state = materialise(seeds.select("seed", F.col("seed").alias("id"), F.lit(0.0).alias("p"), F.lit(1.0).alias("r")), "ppr")
    deg = degrees.select("id", "deg")
    for done in range(max_rounds):
        if done == rounds:
            return state
        s = state.join(deg, "id").withColumn("active", (F.col("deg") > 0) & (F.col("r") >= F.lit(eps) * F.col("deg")))
        if rounds is None and not s.where("active").take(1):
            return state
        own = s.select("seed", "id", F.when(F.col("active"), F.col("p") + alpha * F.col("r")).otherwise(F.col("p")).alias("p"), F.when(F.col("active"), (1 - alpha) * F.col("r") / 2).otherwise(F.col("r")).alias("r"))
        sent = s.where("active").select("seed", F.col("id").alias("u"), ((1 - alpha) * F.col("r") / 2 / F.col("deg")).alias("r")).join(arcs, "u").select("seed", F.col("v").alias("id"), F.lit(0.0).alias("p"), "r")
        after = materialise(own.unionAll(sent).groupBy("seed", "id").agg(F.sum("p").alias("p"), F.sum("r").alias("r")), "ppr")
        discard(state)
        state = after
    if max_rounds == rounds:
        return state
    raise RuntimeError(f"not ended after {max_rounds} rounds")
