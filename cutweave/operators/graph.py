"""Graphs as DataFrames: vertices(id, gdeg) and canonical edges(src, dst) with src < dst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutweave.functions.storage import materialise


def normalise_edges(pairs: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Canonical edges: unordered, distinct, without loops or null ends."""
    src, dst = F.least(F.col(u), F.col(v)).cast("long"), F.greatest(F.col(u), F.col(v)).cast("long")
    return pairs.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(src.alias("src"), dst.alias("dst")).where("src < dst").distinct()


def arcs_of(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: (u, v).  One pass over the edges, no union of two scans."""
    both = F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
    return edges.select(both.alias("_a")).select("_a.u", "_a.v")


def reversed_arcs(arcs: DataFrame) -> DataFrame:
    """The reverse of each of ``arcs(u, v)``."""
    return arcs.select(F.col("v").alias("u"), F.col("u").alias("v"))


def unreversed(arcs: DataFrame) -> DataFrame:
    """Those of ``arcs(u, v)`` whose reverse isn't among them."""
    return arcs.select("u", "v").join(reversed_arcs(arcs), ["u", "v"], "left_anti")


class Graph:
    """A simple undirected graph.  All operators return DataFrames; nothing is computed before it is asked for."""

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges = vertices, edges

    @classmethod
    def from_pairs(cls, pairs: DataFrame, vertices: DataFrame | None = None, u: str = "u", v: str = "v") -> "Graph":
        """From any table of vertex pairs; without ``vertices`` those are the ends of the pairs (loops too)."""
        edges = normalise_edges(pairs, u, v)
        if vertices is None:
            ends = pairs.select(F.explode(F.array(F.col(u).cast("long"), F.col(v).cast("long"))).alias("id"))
            vertices = ends.where("id is not null").distinct()
        return cls(vertices.select(F.col("id").cast("long").alias("id")), edges)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    def written(self) -> "Graph":
        """The same graph with its edges read from files: for uses that read them more than once."""
        return Graph(self.vertices, materialise(self.edges, "graph-edges"))

    def arcs(self) -> DataFrame:
        return arcs_of(self.edges)

    def degrees(self) -> DataFrame:
        """(id, deg) of all vertices; isolated ones have 0.

        Arc ends count 1 and vertices 0 in a single aggregation, so there is one exchange and no join.
        """
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"), F.lit(1).alias("n"))
        return ends.unionAll(self.vertices.select("id", F.lit(0).alias("n"))).groupBy("id").agg(F.sum("n").alias("deg"))

    def degree_histogram(self) -> DataFrame:
        return self.degrees().groupBy("deg").agg(F.count("*").alias("n_vertices"))

    def isolated(self) -> DataFrame:
        """Vertices without an edge: each is a cluster of its own."""
        return self.vertices.select("id").join(self.arcs().select(F.col("u").alias("id")), "id", "left_anti")

    def neighbours(self, ids: DataFrame | None = None) -> DataFrame:
        """(u, v) for every arc that leaves one of ``ids(id)``; all arcs without ``ids``."""
        return self.arcs() if ids is None else self.arcs().join(ids.select(F.col("id").alias("u")), "u", "left_semi")

    def adjacency(self) -> DataFrame:
        """(id, neighbours): sorted neighbours as text ``v1 v2 ...``, one row per vertex with an edge."""
        return self.arcs().groupBy(F.col("u").alias("id")).agg(F.array_join(F.sort_array(F.collect_list("v")), " ").alias("neighbours"))

    def induced(self, members: DataFrame) -> "Graph":
        """The subgraph on ``members(id)``."""
        ids = members.select("id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(self.vertices.join(ids, "id", "left_semi"), edges.select("src", "dst"))

    def without(self, removed: DataFrame) -> "Graph":
        """The graph after removing ``removed(id)``; the inverse is to go on with the graph before."""
        ids = removed.select("id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(self.vertices.join(ids, "id", "left_anti"), edges.select("src", "dst"))

    def removed_edges(self, removed: DataFrame) -> DataFrame:
        """(id, removed): for each vertex that stays the number of its arcs into ``removed(id)``."""
        ids = removed.select("id").distinct()
        lost = self.arcs().join(ids.withColumnRenamed("id", "v"), "v", "left_semi").groupBy(F.col("u").alias("id")).agg(F.count("*").alias("removed"))
        stay = self.vertices.select("id").join(ids, "id", "left_anti")
        return stay.join(lost, "id", "left").select("id", F.coalesce("removed", F.lit(0)).cast("long").alias("removed"))

    def closed_neighbourhood(self, ids: DataFrame) -> DataFrame:
        """``ids(id)`` and all their neighbours."""
        return ids.select("id").union(self.neighbours(ids).select(F.col("v").alias("id"))).distinct()

    def integrity(self, arcs: DataFrame | None = None) -> DataFrame:
        """(id): vertices for which an arc's reverse is missing in ``arcs(u, v)``; by default the graph's own arcs, which have all."""
        arcs = self.arcs() if arcs is None else arcs
        lone = unreversed(arcs)
        return lone.select(F.explode(F.array("u", "v")).alias("id")).distinct()

    def subdivision(self) -> "Graph":
        """Each edge u-v becomes u-m-v with midpoint m = -1 - (its number by (src, dst)).

        Midpoints carry negative ids, so they need no count of the vertices, and are a function of the
        ends, so no global order is made.  Vertex ids must be from 0 to 2**31 - 1; others raise an error.
        """
        mids = self.edges.select("src", "dst", midpoint(F.col("src"), F.col("dst")).alias("mid"))
        halves = F.explode(F.array(F.struct(F.col("mid").alias("a"), F.col("src").alias("b")), F.struct(F.col("mid").alias("a"), F.col("dst").alias("b"))))
        edges = mids.select(halves.alias("_h")).select(F.col("_h.a").alias("src"), F.col("_h.b").alias("dst"))
        return Graph(self.vertices.select("id").unionAll(mids.select(F.col("mid").alias("id"))), edges)

    def subdivision_degrees(self) -> DataFrame:
        """(id, deg) of :meth:`subdivision`: vertices keep their degrees and each midpoint has two, so midpoints are neither shuffled nor counted."""
        mids = self.edges.select(midpoint(F.col("src"), F.col("dst")).alias("id"), F.lit(2).cast("long").alias("deg"))
        return self.degrees().select("id", F.col("deg").cast("long").alias("deg")).unionAll(mids)


def midpoint(src: Column, dst: Column) -> Column:
    """A negative id for the midpoint of an edge, one-to-one: -1 - (src * 2**31 + dst); an error for ids beyond 31 bits."""
    fits = src.between(0, (1 << 31) - 1) & dst.between(0, (1 << 31) - 1)
    number = (F.lit(-1).cast("long") - (F.when(fits, src) * F.lit(1 << 31) + dst)).cast("long")
    return F.when(fits, number).otherwise(F.raise_error(F.lit("vertex ids of a subdivided graph must be from 0 to 2**31 - 1")).cast("long"))


# -- measures of an assignment(id, cluster) ------------------------------------------------------


def labelled_edges(g: Graph, assignment: DataFrame) -> DataFrame:
    """(src, dst, cs, cd): the clusters of both ends."""
    a = assignment.select("id", "cluster")
    e = g.edges.join(a.select(F.col("id").alias("src"), F.col("cluster").alias("cs")), "src")
    return e.join(a.select(F.col("id").alias("dst"), F.col("cluster").alias("cd")), "dst").select("src", "dst", "cs", "cd")


def edges_cut(g: Graph, assignment: DataFrame) -> DataFrame:
    """One row: edges_cut, n_partitions."""
    cut = labelled_edges(g, assignment).agg(F.count_if(F.col("cs") != F.col("cd")).alias("edges_cut"))
    parts = assignment.agg(F.count_distinct("cluster").alias("n_partitions"))
    return cut.crossJoin(parts)  # one row each


def partition_sizes(assignment: DataFrame) -> DataFrame:
    return assignment.groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("first_id"))


def partition_dump(g: Graph, assignment: DataFrame) -> DataFrame:
    """Per cluster: size, first_id, cut, gvolume and conductance; the members are ``assignment`` itself."""
    return partition_sizes(assignment).join(conductances(g, assignment), "cluster").select("cluster", "size", "first_id", "cut", "gvolume", "conductance")


def volumes(g: Graph, assignment: DataFrame) -> DataFrame:
    """Per cluster: size, edges inside, volume (inner degrees), gvolume (degrees in the whole graph), cut."""
    ends = labelled_edges(g, assignment)
    both = F.explode(F.array(F.struct(F.col("cs").alias("c"), F.col("cd").alias("o")), F.struct(F.col("cd").alias("c"), F.col("cs").alias("o"))))
    per = ends.select(both.alias("_b")).select("_b.c", "_b.o").groupBy(F.col("c").alias("cluster")).agg(F.count("*").alias("gvolume"), F.count_if(F.col("c") == F.col("o")).alias("volume"))
    sizes = assignment.groupBy("cluster").agg(F.count("*").alias("size"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return sizes.join(per, "cluster", "left").select("cluster", "size", (zero("volume") / 2).cast("long").alias("inner_edges"), zero("volume").alias("volume"), zero("gvolume").alias("gvolume"), (zero("gvolume") - zero("volume")).alias("cut"))


def conductances(g: Graph, assignment: DataFrame) -> DataFrame:
    """Per cluster: cut / min(gvolume, rest); null where that is 0; balance: min / total."""
    v = volumes(g, assignment)
    total = v.agg(F.sum("gvolume").alias("total"))
    v = v.crossJoin(total)  # one row
    low = F.least(F.col("gvolume"), F.col("total") - F.col("gvolume"))
    return v.select("cluster", "cut", "gvolume", F.when(low > 0, F.col("cut") / low).alias("conductance"), F.when(F.col("total") > 0, low / F.col("total")).alias("balance"))


def certificate(congestion: Column) -> Column:
    """1 / congestion; 0, no certificate, where it is 0."""
    return F.when(congestion > 0, 1.0 / congestion).otherwise(0.0)


# -- scalars -------------------------------------------------------------------------------------


def iterations(m: Column, const: int = 22, factor: float = 5.0) -> Column:
    """T = max(1, const + ceil(factor * log10(m)^2))."""
    return F.greatest(F.lit(1), F.lit(const) + F.ceil(F.lit(factor) * F.pow(F.log10(m), 2))).cast("long")


def capacity(phi: float, t: Column) -> Column:
    return F.ceil(F.lit(1 / phi) / t).cast("long")


def flow_height(phi: float, s: Column) -> Column:
    return F.ceil(F.lit(1 / phi) / F.log10(s)).cast("long")


def convergence_limit(s: Column) -> Column:
    """1 / (16 s^3), the potential under which a flow vector counts as mixed."""
    s = s.cast("double")
    return F.lit(1.0) / (F.lit(16.0) * s * s * s)


def heuristic_goals(phi: float, gvol: Column, const: int = 22, factor: float = 5.0) -> tuple[Column, Column]:
    """Balance and conductance that a heuristic cut must reach."""
    return gvol / 10 / iterations(gvol, const, factor), F.lit(1.7 * phi) * F.pow(F.log10(gvol), 2)


def excess(absorbed: Column, sink: Column) -> Column:
    return F.greatest(F.lit(0), absorbed - sink)


def residual(cap: Column, flow: Column) -> Column:
    return cap - flow


def nearly(x: Column, y: Column | float, eps: float = 1.5e-8) -> Column:
    return F.abs(x - (y if isinstance(y, Column) else F.lit(y))) < eps
