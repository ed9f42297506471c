"""Synthetic graphs with known structure, as DataFrames made from ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutweave.operators.graph import Graph


def _hash(seed: int, *cols: Column) -> Column:
    """A number in [0, 2**31) from an md5 of the columns."""
    text = F.concat_ws("#", *[c.cast("string") for c in cols], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % (1 << 31)


def _clique_pairs(spark: SparkSession, n: int, k: int) -> DataFrame:
    """All pairs u < v in each of k blocks of n vertices: each vertex makes its own row of partners."""
    v = spark.range(k * n).select(F.col("id").alias("v"), (F.col("id") % n).alias("i"), (F.col("id") - F.col("id") % n).alias("base"))
    return v.where("i > 0").select("base", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("i") - 1)).alias("j")).select((F.col("base") + F.col("j")).alias("u"), "v")


def _cross(spark: SparkSession, n: int, k: int, r: int, seed: int) -> DataFrame:
    """r distinct edges between different blocks: the first r that hashes of growing numbers give, repeats left out."""
    if r > n * n * k * (k - 1) // 2:
        raise ValueError(f"{r} edges between {k} blocks of {n} vertices: there are fewer pairs")
    draws = 2 * r
    while True:
        e = spark.range(draws).select("id", (_hash(seed, F.col("id"), F.lit("a")) % k).alias("p"), (_hash(seed, F.col("id"), F.lit("b")) % (k - 1)).alias("q0"))
        e = e.withColumn("q", F.col("q0") + F.when(F.col("q0") >= F.col("p"), 1).otherwise(0))
        e = e.select("id", (F.col("p") * n + _hash(seed, F.col("id"), F.lit("c")) % n).alias("x"), (F.col("q") * n + _hash(seed, F.col("id"), F.lit("d")) % n).alias("y"))
        first = e.groupBy(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.min("id").alias("id"))
        if first.count() >= r:
            return first.orderBy("id").limit(r).select("u", "v")
        draws *= 2


def clique(spark: SparkSession, n: int = 100, k: int = 1, r: int = 0, p: int = 100, seed: int = 0) -> Graph:
    """k cliques of n vertices whose edges stay with p percent, and r edges between cliques."""
    pairs = _clique_pairs(spark, n, k)
    if p < 100:
        pairs = pairs.where(_hash(seed, F.col("u"), F.col("v")) % 100 < p)
    if r and k > 1:
        pairs = pairs.unionAll(_cross(spark, n, k, r, seed))
    return Graph.from_pairs(pairs, spark.range(n * k))


def clique_path(spark: SparkSession, n: int = 100, k: int = 10) -> Graph:
    """k cliques of n vertices; the first vertices of consecutive cliques are linked."""
    links = spark.range(max(0, k - 1)).select((F.col("id") * n).alias("u"), ((F.col("id") + 1) * n).alias("v"))
    return Graph.from_pairs(_clique_pairs(spark, n, k).unionAll(links), spark.range(n * k))


def lattice(spark: SparkSession, n: int = 100) -> Graph:
    """n x n grid with edges to the right, down and diagonally down right."""
    at = spark.range(n * n).select("id", (F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (0, 1), (1, 1))]))
    pairs = at.withColumn("s", step).where((F.col("x") + F.col("s.a") < n) & (F.col("y") + F.col("s.b") < n))
    return Graph.from_pairs(pairs.select(F.col("id").alias("u"), (F.col("id") + F.col("s.a") + F.col("s.b") * n).alias("v")), spark.range(n * n))


#: The neighbours of (x, y) in the Margulis graph on Z_n x Z_n, as (a, b, c, d, e, f): (a x + b y + c, d x + e y + f).  Fixed values.
MARGULIS = ((1, 0, 0, 1, 1, 0), (1, 0, 0, -1, 1, 0), (1, 0, 1, 0, 1, 0), (1, 0, -1, 0, 1, 0), (1, 1, 0, 0, 1, 0), (1, -1, 0, 0, 1, 0), (1, 0, 0, 0, 1, 1), (1, 0, 0, 0, 1, -1))


def margulis(spark: SparkSession, n: int = 100, k: int = 1, r: int = 0, seed: int = 0) -> Graph:
    """k Margulis expanders on n x n vertices, and r edges between them."""
    at = spark.range(k * n * n).select("id", F.floor(F.col("id") / (n * n)).alias("g"), (F.floor(F.col("id") / n) % n).alias("x"), (F.col("id") % n).alias("y"))
    x, y = F.col("x"), F.col("y")
    to = F.explode(F.array(*[F.struct(F.pmod(a * x + b * y + c, F.lit(n)).alias("x"), F.pmod(d * x + e * y + f, F.lit(n)).alias("y")) for a, b, c, d, e, f in MARGULIS]))
    pairs = at.withColumn("t", to).select(F.col("id").alias("u"), (F.col("g") * n * n + F.col("t.x") * n + F.col("t.y")).alias("v"))
    if r and k > 1:
        pairs = pairs.unionAll(_cross(spark, n * n, k, r, seed))
    return Graph.from_pairs(pairs, spark.range(k * n * n))
