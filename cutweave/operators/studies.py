"""Studies on planted graphs: every row of a parameter table is played in parallel.

A row (kind, n, k, r, phi, strategy, balance, seed) names a small graph, which the worker makes
itself, so the shuffle carries parameters only.  Results keep the parameters.
"""

from __future__ import annotations

import itertools
import math
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutweave.operators.cut_matching import Cluster, Parameters, play
from cutweave.operators.decompose import local_decompose
from cutweave.sources.generators import MARGULIS

PARAMETERS = "kind string, n int, k int, r int, phi double, strategy string, balance double, seed int"
CUT = PARAMETERS + ", edges long, iterations int, outcome string, volume_left long, volume_right long, edges_cut long, conductance double, cut_balance double, certificate double, potentials array<double>, seconds double"
PARTS = PARAMETERS + ", edges long, edges_cut long, partitions int, largest long, worst_certificate double, seconds double"


def local_graph(kind: str, n: int, k: int = 1, r: int = 0, seed: int = 0) -> Cluster:
    """clique, clique-path, lattice or margulis as arrays, with r random edges between different copies."""
    if kind in ("clique", "clique-path"):
        size = n
        i, j = np.triu_indices(n, 1)
        es = np.concatenate([np.stack([i + c * n, j + c * n], 1) for c in range(k)])
        if kind == "clique-path" and k > 1:
            es = np.concatenate([es, np.stack([np.arange(k - 1) * n, np.arange(1, k) * n], 1)])
    elif kind == "lattice":
        size, k = n * n, 1
        x, y = np.divmod(np.arange(n * n), n)
        es = np.concatenate([np.stack([(x * n + y)[ok], ((x + a) * n + y + b)[ok]], 1) for a, b in ((1, 0), (0, 1), (1, 1)) if (ok := (x + a < n) & (y + b < n)).any()])
    elif kind == "margulis":
        size = n * n
        x, y = np.divmod(np.arange(n * n), n)
        one = np.concatenate([np.stack([x * n + y, (a * x + b * y + c) % n * n + (d * x + e * y + f) % n], 1) for a, b, c, d, e, f in MARGULIS])
        es = np.concatenate([one + c * size for c in range(k)])
    else:
        raise ValueError(f"no such kind of graph: {kind}")
    if r and k > 1:
        if r > size * size * k * (k - 1) // 2:
            raise ValueError(f"{r} edges between {k} copies of {size} vertices: there are fewer pairs")
        rng, planted = np.random.default_rng(seed), set()
        while len(planted) < r:  # a pair that was drawn before is drawn anew
            p, q = rng.choice(k, 2, replace=False)
            planted.add(tuple(sorted((int(p * size + rng.integers(size)), int(q * size + rng.integers(size))))))
        es = np.concatenate([es, np.array(sorted(planted))])
    es = np.unique(np.sort(es[es[:, 0] != es[:, 1]], axis=1), axis=0)
    return Cluster(np.arange(size * k), np.bincount(es.ravel(), minlength=size * k), es[:, 0], es[:, 1])


def _options(strategy: str, balance: float) -> Parameters:
    return Parameters(balanced_cut_strategy=strategy != "default", min_balance=balance, sample_potential=True, num_flow_vectors=5)


def _cuts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for p in pdf.itertuples(index=False):
            began = time.time()
            c = local_graph(p.kind, p.n, p.k, p.r, p.seed)
            out = play(c, p.phi, _options(p.strategy, p.balance), np.random.default_rng(int(p.seed)))
            left = int(c.gdeg[out.removed].sum())
            right = int(c.gdeg.sum()) - left
            cut, low = int((out.removed[c.left] != out.removed[c.right]).sum()), min(left, right)
            rows.append((*p, len(c.left), out.iterations, out.kind, left, right, cut, cut / low if low else None, low / (left + right) if left + right else None, 1 / out.congestion, out.potentials, time.time() - began))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in CUT.split(", ")])


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for p in pdf.itertuples(index=False):
            began = time.time()
            c = local_graph(p.kind, p.n, p.k, p.r, p.seed)
            label, congestion, _ = local_decompose(c, p.phi, _options(p.strategy, p.balance), int(p.seed))
            worst = min(1 / x if x else 0.0 for x in congestion)
            rows.append((*p, len(c.left), int((label[c.left] != label[c.right]).sum()), len(congestion), int(np.bincount(label).max()), worst, time.time() - began))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARTS.split(", ")])


def _table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    df = spark.createDataFrame(rows, PARAMETERS)
    return df.repartition(min(len(rows), 4 * spark.sparkContext.defaultParallelism))


def play_table(params: DataFrame) -> DataFrame:
    """One cut-matching run per row of PARAMETERS."""
    return params.mapInPandas(_cuts, CUT)


def decompose_table(params: DataFrame) -> DataFrame:
    """One whole decomposition per row of PARAMETERS."""
    return params.mapInPandas(_parts, PARTS)


def certificate_study(spark: SparkSession, phis: list[float], repeats: int = 8) -> DataFrame:
    """Expanders: certificate and certificate / phi of runs that end in one part."""
    rows = [(kind, n, 1, 0, phi, s, 0.0, i) for (kind, n), phi, s, i in itertools.product((("clique", 20), ("margulis", 5)), phis, ("default", "balanced"), range(repeats))]
    runs = play_table(_table(spark, rows)).where("outcome = 'expander'")
    return runs.select("kind", "phi", "strategy", "seed", "certificate", (F.col("certificate") / F.col("phi")).alias("certificate_ratio"))


def balance_study(spark: SparkSession, ks: list[int], n: int = 20, phi: float = 0.001) -> DataFrame:
    """Clique paths: balance of the cut found for each wanted balance; both volumes make up all arcs."""
    rows = [("clique-path", n, k, 0, phi, s, b, 0) for k, s, b in itertools.product(ks, ("default", "balanced"), (0.0, 0.25, 0.45))]
    return play_table(_table(spark, rows)).select("k", "edges", "strategy", "balance", "iterations", "outcome", "volume_left", "volume_right", "cut_balance", "conductance")


def potential_study(spark: SparkSession, phi: float = 0.001, seeds: int = 3) -> DataFrame:
    """Potential after each iteration on expanders (k = 1) and on graphs with a planted cut (k = 2)."""
    rows = [(kind, n, k, k - 1, phi, s, 0.45, i) for (kind, n), k, s, i in itertools.product((("clique", 12), ("margulis", 5)), (1, 2), ("default", "balanced"), range(seeds))]
    return play_table(_table(spark, rows)).select("kind", "k", "strategy", "seed", F.posexplode("potentials").alias("iteration", "potential"))


def expected_cut_study(spark: SparkSession, ks: list[int], n: int = 7, phis: tuple[float, ...] = (0.01, 0.005)) -> DataFrame:
    """Margulis copies with r = 5 k planted edges: edges cut against r."""
    rows = [("margulis", n, k, 5 * k, phi, "balanced", 0.45, 1) for k, phi in itertools.product(ks, phis)]
    return decompose_table(_table(spark, rows)).select("k", "phi", F.col("r").alias("edges_expected"), "edges_cut", "partitions")


def iterations_study(spark: SparkSession, graphs: list[tuple[str, int]], phi: float = 0.001, seeds: int = 10) -> DataFrame:
    """Iterations after which the sampled potential of every seed is below 1 / (16 s^2), against log10(edges)^2.

    Null where a seed's run never gets there.  One whole game per seed is played and read off, instead of a game for
    each number of iterations.
    """
    rows = [(kind, n, 1, 0, phi, s, 0.45, i) for (kind, n), s, i in itertools.product(graphs, ("default", "balanced"), range(seeds))]
    t = play_table(_table(spark, rows)).select("kind", "n", "strategy", "seed", "edges", F.posexplode_outer("potentials").alias("t", "potential"))
    low = t.groupBy("kind", "n", "strategy", "seed", "edges").agg(F.min(F.when(F.col("potential") < 1 / (16 * F.col("edges") * F.col("edges")), F.col("t"))).alias("t"))
    all_ = low.groupBy("kind", "n", "strategy", "edges").agg(F.when(F.count("t") == F.count("*"), F.max("t")).alias("iterations"))
    return all_.withColumn("log10_squared_edges", F.pow(F.log10("edges"), 2))


def fewest_vectors(c: Cluster, phi: float, p: Parameters, *, most: int = 64, seed: int = 0) -> int | None:
    """The fewest flow vectors with which a run ends with its potential below 1 / (16 s^2); None if ``most`` don't do."""
    for k in range(1, most + 1):
        out = play(c, phi, Parameters(**(p.__dict__ | {"num_flow_vectors": k, "sample_potential": True})), np.random.default_rng(seed))
        if out.potentials and out.potentials[-1] < 1 / (16 * len(c.left) ** 2):
            return k
    return None
