"""Relational and statistical post-processing of experiment tables."""

from __future__ import annotations

import itertools
import json
import re
import subprocess
import sys
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutweave.operators.cut_matching import Cluster, Parameters
from cutweave.operators.decompose import local_decompose

#: Options of a configuration, in the order of the tables below.
OPTIONS = ("name", "base_config", "flow_vectors", "use_cut_heuristics", "use_balanced_partitions", "flow_fraction", "adaptive", "warm_start", "trim_with_max_flow_first")
#: The configurations that are compared; no configuration takes the potential exactly first, all use compensated sums.  Fixed values.
INCREMENTS = (
    ("Arv", True, 1, False, False, False, False, False, False),
    ("Arv-20", True, 20, False, False, False, False, False, False),
    ("+Ada", False, 20, False, False, False, True, False, True),
    ("+Cut", False, 20, True, True, False, False, False, True),
    ("+Cut+Ada", False, 20, True, True, False, True, False, True),
    ("+Cut+Ada+Frac", False, 20, True, True, True, True, False, True),
    ("+Ada+Frac", False, 20, False, False, True, True, False, True),
    ("+Cut+Frac", False, 20, True, True, True, False, False, True),
    ("+Cut+Ada+Frac+Warm", False, 20, True, True, True, True, True, True),
)
#: Those for large graphs, with one seed.  Fixed values.
LARGE = (
    ("+Cut+Ada", False, 20, True, True, False, True, False, True),
    ("+Cut+Ada+Frac", False, 20, True, True, True, True, False, True),
    ("+Cut+Ada+Warm", False, 20, True, True, False, True, True, True),
    ("+Cut+Ada+Frac+Warm", False, 20, True, True, True, True, True, True),
)


def parameters_of(options: dict) -> Parameters:
    """What a row of the matrix plays with; a base configuration replaces all other options by the plain ones."""
    if options["base_config"]:
        return Parameters.base()
    return Parameters(
        num_flow_vectors=options["flow_vectors"], use_cut_heuristics=options["use_cut_heuristics"], use_balanced_partitions=options["use_balanced_partitions"], stop_flow_at_fraction=options["flow_fraction"],
        adaptive=options["adaptive"], warm_start=options["warm_start"], trim_with_max_flow_first=options["trim_with_max_flow_first"], kahan_error=True,
    )


def configurations(spark: SparkSession, graphs: list[str], phis: list[float], seeds: int = 10, kind: str = "increments") -> DataFrame:
    """The experiment matrix: one row per graph, phi, configuration and seed, with the configuration's options."""
    rows = [(g, p, kind, i, *c) for (g, p), (i, c) in itertools.product(itertools.product(graphs, phis), enumerate(LARGE if kind == "large" else INCREMENTS))]
    columns = ", ".join(f"{n} {'string' if n == 'name' else 'int' if n == 'flow_vectors' else 'boolean'}" for n in OPTIONS)
    base = spark.createDataFrame(rows, f"graph string, phi double, kind string, step int, {columns}")
    return base.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))


def run_matrix(matrix: DataFrame, edges: dict[str, str], *, limit_s: float = 1800.0) -> DataFrame:
    """Every row of the matrix played: adds edges_cut, partitions, seconds and status (0, -1 timed out, -2 failed).

    ``edges`` names each graph's native edge list, a path that every worker can open; a worker decomposes one
    graph at a time in a process of its own, which is ended after ``limit_s`` seconds.  For graphs of a worker's size.
    """
    names = [f.name for f in matrix.schema]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                began = time.time()
                given = [sys.executable, "-m", "cutweave.operators.experiments", edges[row["graph"]], json.dumps({k: (v.item() if hasattr(v, "item") else v) for k, v in row.items()})]
                try:
                    done = subprocess.run(given, text=True, capture_output=True, timeout=limit_s, check=False)
                    found = re.search(r"^(\d+) (\d+)$", done.stdout, re.MULTILINE)
                    cut, parts, status = (int(found[1]), int(found[2]), 0) if found else (-2, -2, -2)
                except subprocess.TimeoutExpired:
                    cut, parts, status = -1, -1, -1
                rows.append((*[row[n] for n in names], cut, parts, time.time() - began, status))
            yield pd.DataFrame(rows, columns=[*names, "edges_cut", "partitions", "seconds", "status"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in matrix.schema)
    return matrix.mapInPandas(work, f"{schema}, edges_cut long, partitions long, seconds double, status int")


def play_file(path: str, options: dict) -> tuple[int, int]:
    """(edges cut, partitions) of the native edge list at ``path`` under a row of the matrix."""
    pairs = np.loadtxt(path, dtype=np.int64, skiprows=1, ndmin=2).reshape(-1, 2)
    with open(path, encoding="utf-8") as f:
        n = int(f.readline().split()[0])
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    c = Cluster(np.arange(n), np.bincount(pairs.ravel(), minlength=n), pairs[:, 0], pairs[:, 1])
    label, congestion, _ = local_decompose(c, options["phi"], parameters_of(options), int(options["seed"]))
    return int((label[c.left] != label[c.right]).sum()), len(congestion)


def aggregate_runs(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, geometric mean and greatest value per group; the geometric mean of positive values only."""
    v = F.col(value)
    return runs.groupBy(*keys).agg(F.avg(v).alias("mean"), F.median(v).alias("median"), F.exp(F.avg(F.when(v > 0, F.ln(v)))).alias("gmean"), F.max(v).alias("max"))


def speedups(runs: DataFrame, base: str, value: str = "time", by: str = "graph", most: float | None = None) -> DataFrame:
    """Each configuration's median against that of ``base`` on the same graph: base / own; optionally only where base <= most."""
    med = runs.groupBy(by, "name").agg(F.median(value).alias("own"))
    ref = med.where(F.col("name") == base).select(by, F.col("own").alias("base"))
    out = med.join(ref, by).select(by, "name", "own", "base", (F.col("base") / F.nullif(F.col("own"), F.lit(0))).alias("speedup"))
    return out if most is None else out.where(F.col("base") <= most)


def phase_shares(runs: DataFrame, phases: list[str], total: str = "total") -> DataFrame:
    """Each phase's share of the total, and ``other``, what is left."""
    shares = [(F.col(p) / F.nullif(F.col(total), F.lit(0))) for p in phases]
    rest = F.lit(1.0)
    for s in shares:
        rest = rest - s
    return runs.select(*[c for c in runs.columns if c not in (*phases, total)], *[s.alias(f"{p}_share") for p, s in zip(phases, shares)], rest.alias("other_share"))


def strategy_ratio(runs: DataFrame, keys: list[str], strategy: str, one: str, two: str, value: str) -> DataFrame:
    """sum(value) of strategy ``one`` over that of ``two`` per group, ordered labels by the ratio."""
    part = lambda s: F.sum(F.when(F.col(strategy) == s, F.col(value)))
    r = runs.groupBy(*keys).agg((part(one) / F.nullif(part(two), F.lit(0))).alias("ratio"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("ratio"), *keys))  # one row per graph: an experiment table
    return r.withColumn("place", place).withColumn("verdict", F.when(F.col("ratio") > 1, f"{two} lower").when(F.col("ratio") < 1, f"{one} lower").otherwise("equal"))


def regression(points: DataFrame, x: Column, y: Column, keys: list[str]) -> DataFrame:
    """Least squares per group: slope, intercept, r2 and the equation as text."""
    p = points.select(*keys, x.cast("double").alias("_x"), y.cast("double").alias("_y"))
    r = p.groupBy(*keys).agg(F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"), F.regr_r2("_y", "_x").alias("r2"))
    return r.withColumn("equation", F.format_string("y = %.3f + %.3f x", F.col("intercept"), F.col("slope")))


def certificate_check(runs: DataFrame) -> DataFrame:
    """Of runs with one part: certificate / phi, which must be 1 at least."""
    ratio = F.col("certificate") / F.col("phi")
    return runs.where("partitions = 1").select("graph", "phi", "certificate", ratio.alias("ratio"), F.when(ratio >= 1, "pass").otherwise("fail").alias("verdict"))


def fewest_iterations(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest t at which every seed passed: ``runs(keys..., t, seed, ok)``."""
    all_pass = runs.groupBy(*keys, "t").agg(F.bool_and("ok").alias("all_ok"))
    return all_pass.where("all_ok").groupBy(*keys).agg(F.min("t").alias("t"))


def parse_log(lines: DataFrame) -> DataFrame:
    """``lines(run, pos, line)`` of program output -> run, edges_cut, partitions, status: the last line of two numbers.

    Runs without such a line have status -2 (not understood); a line ``timeout`` gives -1.
    """
    two = r"^\s*(\d+)\s+(\d+)\s*$"
    last = F.max(F.when(F.col("line").rlike(two), F.struct("pos", "line")))
    r = lines.groupBy("run").agg(last.alias("m"), F.bool_or(F.trim("line") == "timeout").alias("late"))
    num = lambda i: F.when(F.col("m").isNotNull(), F.regexp_extract("m.line", two, i).cast("long"))
    return r.select("run", num(1).alias("edges_cut"), num(2).alias("partitions"), F.when(F.col("late"), -1).when(F.col("m").isNull(), -2).otherwise(0).alias("status"))


def traces(runs: DataFrame, column: str = "potentials") -> DataFrame:
    """(run, iteration, potential): an array of samples as rows."""
    return runs.select("run", F.posexplode(column).alias("iteration", "potential"))


def trace_medians(t: DataFrame, keys: list[str]) -> DataFrame:
    return t.groupBy(*keys, "iteration").agg(F.median("potential").alias("potential"))


if __name__ == "__main__":
    print(*play_file(sys.argv[1], json.loads(sys.argv[2])))
