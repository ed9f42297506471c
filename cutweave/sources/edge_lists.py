"""Readers and writers for edge-list text formats, and tables of experiments as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutweave.functions.storage import materialise
from cutweave.operators.graph import Graph
from cutweave.operators.sweeps import dealt, running

SPACE = r"[ \t\r]+"


def _number(parts: Column, i: int) -> Column:
    return F.try_element_at(parts, F.lit(i)).try_cast("long")


def _fields(lines: DataFrame) -> DataFrame:
    return lines.withColumn("_p", F.split(F.trim(F.regexp_replace("value", SPACE, " ")), " "))


def read_edge_list(spark: SparkSession, path: str) -> Graph:
    """``n m``, then ``u v`` per line, 0-based; isolated vertices come from n.

    The header is the line of the smallest offset, i.e. the first of the file.  Bad lines and ids
    out of range raise an error.
    """
    header = spark.read.text(path).limit(1).collect()
    if not header:
        raise ValueError(f"{path} is empty")
    try:
        n, m = (int(x) for x in header[0]["value"].split())
    except ValueError:
        raise ValueError(f"{path}: the first line must be 'n m'") from None
    lines = _fields(spark.read.text(path).where(F.trim("value") != ""))
    pairs = lines.select("value", _number(F.col("_p"), 1).alias("u"), _number(F.col("_p"), 2).alias("v"), F.size("_p").alias("k"))
    bad = F.col("u").isNull() | F.col("v").isNull() | (F.col("k") != 2) | (F.col("u") < 0) | (F.col("v") < 0)
    is_header = (F.col("u") == n) & (F.col("v") == m)
    out_of_range = (F.greatest("u", "v") >= n) & ~is_header
    pairs = pairs.withColumn("u", F.when(bad | out_of_range, F.raise_error(F.concat(F.lit("bad edge line: "), "value")).cast("long")).otherwise(F.col("u")))
    # The header looks like an edge; it is the one line equal to 'n m' where an end of that is no vertex.
    if max(n, m) >= n:
        if pairs.where(is_header).count() > 1:
            raise ValueError(f"{path}: an edge line 'n m' is out of range")
        pairs = pairs.where(~is_header)
    return Graph.from_pairs(pairs, spark.range(n))


def write_edge_list(g: Graph, path: str, *, one_indexed: bool = False) -> None:
    """``n m``, then ``u v`` per line, in one file sorted so that the header is first.

    A single file is the format, so one task sorts (with spill) and writes it.
    """
    shift = 1 if one_indexed else 0
    edges = materialise(g.edges, "edge-list")
    n = (g.vertices.agg(F.coalesce(F.max("id") + 1, F.lit(0))).first()[0])
    head = g.spark.createDataFrame([(-1, -1, f"{n} {edges.count()}")], "a long, b long, value string")
    body = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.concat_ws(" ", (F.col("src") + shift).cast("string"), (F.col("dst") + shift).cast("string")).alias("value"))
    head.unionAll(body).orderBy("a", "b").coalesce(1).select("value").write.mode("overwrite").text(path)


def read_snap(spark: SparkSession, path: str) -> Graph:
    """``i j`` per line with ``#`` comments; ids are remapped to 0..n-1 in the order of the ids."""
    lines = _fields(spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')"))
    pairs = lines.select(_number(F.col("_p"), 1).alias("u"), _number(F.col("_p"), 2).alias("v")).where("u is not null and v is not null")
    ids = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    one = dealt(ids.withColumn("cluster", F.lit(0)), ["cluster"], [F.col("id")])
    dense = materialise(running(one, ["cluster"], [F.col("id")], {}, "k").select("id", (F.col("k") - 1).alias("k")), "snap-ids")
    pairs = pairs.join(dense.select(F.col("id").alias("u"), F.col("k").alias("a")), "u").join(dense.select(F.col("id").alias("v"), F.col("k").alias("b")), "v")
    return Graph.from_pairs(pairs.select("a", "b"), dense.select(F.col("k").alias("id")), "a", "b")


def read_matrix_market(spark: SparkSession, path: str) -> Graph:
    """Square coordinate matrices: ``%`` comments, ``rows cols nnz``, then 1-based ``a b [w]``; loops and weights dropped."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '%')")
    size = lines.limit(1).collect()
    if not size:
        raise ValueError(f"{path} has no size line")
    rows, cols, nnz = (int(x) for x in size[0]["value"].split()[:3])
    if rows != cols:
        raise ValueError(f"{path} is not square: {rows} x {cols}")
    f = _fields(lines).select(_number(F.col("_p"), 1).alias("a"), _number(F.col("_p"), 2).alias("b"), _number(F.col("_p"), 3).alias("w"), F.size("_p").alias("k"))
    head = (F.col("k") == 3) & (F.col("a") == rows) & (F.col("b") == cols) & (F.col("w") == nnz)
    # An entry equal to the size line could only be the loop (rows, rows), which is dropped anyway.
    pairs = f.where(~head).select((F.col("a") - 1).alias("u"), (F.col("b") - 1).alias("v"))
    return Graph.from_pairs(pairs, spark.range(rows))


READERS = {"native": read_edge_list, "snap": read_snap, "mtx": read_matrix_market}


def convert_all(spark: SparkSession, inputs: dict[str, tuple[str, str]], folder: str) -> DataFrame:
    """Every graph of ``inputs`` {name: (kind, path)} into ``folder``/name as a native edge list; (name, vertices, edges) of all."""
    graphs = {}
    for name, (kind, path) in inputs.items():
        if kind not in READERS:
            raise ValueError(f"no reader for {kind}; there are {sorted(READERS)}")
        graphs[name] = READERS[kind](spark, path)
        write_edge_list(graphs[name], f"{folder}/{name}")
    return graph_catalogue(graphs)


def graph_catalogue(graphs: dict[str, Graph]) -> DataFrame:
    """(name, vertices, edges) of several graphs."""
    out = None
    for name, g in graphs.items():
        n, m = g.vertices.agg(F.count("*").alias("vertices")), g.edges.agg(F.count("*").alias("edges"))
        row = n.crossJoin(m).select(F.lit(name).alias("name"), "vertices", "edges")  # one row each
        out = row if out is None else out.unionAll(row)
    return out


def fit_for_study(catalogue: DataFrame, limit: int = 200_000) -> DataFrame:
    """Square matrices of ``catalogue(name, rows, cols, nnz)`` with at most ``limit`` entries."""
    return catalogue.where((F.col("rows") == F.col("cols")) & (F.col("nnz") <= limit))


def write_results(tables: list[DataFrame], path: str, missing: float | None = None) -> None:
    """One CSV with all columns of several result tables; what a table lacks is ``missing``."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    if missing is not None:
        out = out.fillna(missing)
    out.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(paths)
