"""Per-cluster numbers around the cut-matching game: parameters, trimming set-up, outcomes, congestion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutweave.operators.graph import capacity, certificate, convergence_limit, excess, flow_height, heuristic_goals, iterations, residual


def cut_parameters(clusters: DataFrame, phi: float) -> DataFrame:
    """``clusters(cluster, m, s, gvol)`` -> T, capacity, flow height, convergence limit, heuristic balance and goal."""
    t = iterations(F.col("m"))
    balance, goal = heuristic_goals(phi, F.col("gvol"))
    return clusters.select("cluster", t.alias("t"), capacity(phi, t).alias("capacity"), flow_height(phi, F.col("s")).alias("height"), convergence_limit(F.col("s")).alias("limit"), balance.alias("balance"), goal.alias("goal"))


def trim_setup(vertices: DataFrame, phi: float) -> DataFrame:
    """``vertices(cluster, id, gdeg, removed)`` -> source, sink and excess of each vertex at the start of trimming."""
    source = F.ceil(F.col("removed") * F.lit(2 / phi)).cast("long")
    return vertices.select("cluster", "id", source.alias("source"), F.col("gdeg").alias("sink"), excess(source, F.col("gdeg")).cast("long").alias("excess"))


def outcomes(clusters: DataFrame) -> DataFrame:
    """``clusters(cluster, kept, removed, removed_gvol, gvol, t, n_fake)`` -> kind of the outcome.

    balanced if both sides hold vertices and the removed volume is above gvol / 2 / 10 / t (whole
    divisions); expander if nothing, or everything, went and no edge is fake; fake edges otherwise
    come before a plain near expander.
    """
    lower = F.floor(F.floor(F.floor(F.col("gvol") / 2) / 10) / F.col("t"))
    kind = (
        F.when((F.col("kept") > 0) & (F.col("removed") > 0) & (F.col("removed_gvol") > lower), "balanced")
        .when(((F.col("removed") == 0) | (F.col("kept") == 0)) & (F.col("n_fake") == 0), "expander")
        .when(F.col("n_fake") > 0, "near_fake")
        .otherwise("near")
    )
    return clusters.select("cluster", kind.alias("kind"))


def congestion_certificates(arcs: DataFrame) -> DataFrame:
    """``arcs(cluster, flow, cap)`` -> congestion (at least 1), certificate, least residual."""
    c = arcs.groupBy("cluster").agg(F.greatest(F.lit(1), F.max(F.greatest(F.col("flow"), F.lit(0)))).alias("congestion"), F.min(residual(F.col("cap"), F.col("flow"))).alias("least_residual"))
    return c.select("cluster", F.col("congestion").cast("long").alias("congestion"), certificate(F.col("congestion")).alias("certificate"), F.col("least_residual").cast("long").alias("least_residual"))
