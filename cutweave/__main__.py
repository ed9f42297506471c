"""Command line: ``python -m cutweave GRAPH PHI [options]`` decomposes an edge list and prints edges cut and partitions."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cutweave.functions.storage import materialise, release
from cutweave.functions.timing import Phases
from cutweave.operators.cut_matching import Parameters
from cutweave.operators.decompose import decompose
from cutweave.operators.graph import certificate, edges_cut, partition_dump
from cutweave.sources import edge_lists, generators

FLAGS = {
    "balanced_cut_strategy": "both sides of a proposed cut get as many terminals", "use_cut_heuristics": "try sparse-cut heuristics before the game", "use_balanced_partitions": "try a balanced bisection first",
    "adaptive": "stop when the flow vectors are mixed", "stop_flow_at_fraction": "stop flows at a fraction, with fake matches for the rest", "warm_start": "start flows with blocking rounds",
    "trim_with_max_flow_first": "trim by one maximum flow", "krv_step_first": "median split until something is cut", "kahan_error": "sums without rounding error", "sample_potential": "log the potential (small clusters)",
    "break_at_empty_terminals": "end the game where no side has terminals",
}
NUMBERS = {"t_const": int, "t_factor": float, "min_iterations": int, "min_balance": float, "num_flow_vectors": int}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cutweave", description="Partition a graph into expanders with few edges between them.")
    default = Parameters()
    p.add_argument("graph", help="a path of any file system that Spark reads, or clique|clique-path|lattice|margulis with --n, --k, --r")
    p.add_argument("phi", type=float, nargs="?", default=0.001)
    p.add_argument("--format", choices=sorted(edge_lists.READERS), default="native")
    p.add_argument("--seed", type=int, default=555)
    p.add_argument("--base-config", action="store_true", help="the plain configuration; replaces all other parameters")
    for name, text in FLAGS.items():
        p.add_argument("--" + name.replace("_", "-"), action=argparse.BooleanOptionalAction, default=getattr(default, name), help=text)
    for name, kind in NUMBERS.items():
        p.add_argument("--" + name.replace("_", "-"), type=kind, default=getattr(default, name))
    for name, value in (("n", 100), ("k", 1), ("r", 0)):
        p.add_argument(f"--{name}", type=int, default=value, help="of a generated graph")
    p.add_argument("--partitions", metavar="FOLDER", help="write id, cluster, congestion and kind there as Parquet, and size and conductance of each part beside it")
    p.add_argument("--write-graph", metavar="PATH", help="write the graph as a native edge list")
    p.add_argument("--timings", action="store_true", help="print the seconds of each phase")
    p.add_argument("--log", action="store_true", help="log the rounds")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    if a.log:
        logging.basicConfig(level=logging.INFO)
    spark = spark or SparkSession.builder.appName("cutweave").getOrCreate()
    made = {"clique": lambda: generators.clique(spark, a.n, a.k, a.r, seed=a.seed), "clique-path": lambda: generators.clique_path(spark, a.n, a.k), "lattice": lambda: generators.lattice(spark, a.n), "margulis": lambda: generators.margulis(spark, a.n, a.k, a.r, seed=a.seed)}
    g = made[a.graph]() if a.graph in made else edge_lists.READERS[a.format](spark, a.graph)
    if a.write_graph:
        edge_lists.write_edge_list(g, a.write_graph)
    params = Parameters.base() if a.base_config else Parameters(**{n: getattr(a, n) for n in (*FLAGS, *NUMBERS)})
    phases = Phases()
    parts = decompose(g, a.phi, params, seed=a.seed, kinds=True, phases=phases)
    if a.partitions:
        parts.write.mode("overwrite").parquet(f"{a.partitions}/members")
        worst = parts.groupBy("cluster").agg(certificate(F.max("congestion")).alias("certificate"))
        partition_dump(g, parts.select("id", "cluster")).join(worst, "cluster").write.mode("overwrite").parquet(f"{a.partitions}/parts")
    if a.timings:
        for row in phases.report(spark).collect():
            print(f"{row['phase']}\t\t{row['seconds']:.3f}\t\t{row['share']:.3f}")
    found = edges_cut(g, materialise(parts.select("id", "cluster"), "cli-parts")).first()
    print(found["edges_cut"], found["n_partitions"])
    release(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
