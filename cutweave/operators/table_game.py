"""The cut-matching game on clusters of any size: all of its state is in tables, all clusters play in the same jobs.

A round selects each cluster's vector of the greatest potential, splits the midpoints by it, routes units from one side to
the other, removes the smaller side of a level cut where units are left, pairs what was routed and averages the vectors over
the pairs.  A game is its tables, so it can go on from any round's end, in another session as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutweave.functions.storage import discard, materialise, scratch
from cutweave.operators import table_flow
from cutweave.operators.cut_matching import Parameters
from cutweave.operators.graph import capacity, convergence_limit, flow_height, iterations, midpoint
from cutweave.operators.sweeps import average_matched, krv_split, rst_split, select_vector, unit_vectors


@dataclass(frozen=True)
class Game:
    """alive(id, cluster, gdeg, mid), removed (the same), vectors(cluster, eid, k, x), congestion(u, v, n), clusters (one row each),
    matrix(cluster, eid, col, x) or None, potentials(cluster, round, potential) or None, and the flow's rows."""

    alive: DataFrame
    removed: DataFrame
    vectors: DataFrame
    congestion: DataFrame
    clusters: DataFrame
    flow: table_flow.Flow
    matrix: DataFrame | None = None
    potentials: DataFrame | None = None

    def running(self) -> bool:
        return bool(self.clusters.where("running").take(1))


def gaussian(*key: Column, seed: int = 0) -> Column:
    """A normally distributed number that is a function of the key."""
    u = [(F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *key), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1)) for k in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * F.pi() * u[1])


def begin(edges: DataFrame, members: DataFrame, phi: float, p: Parameters | None = None, *, seed: int = 0, block_arcs: int = table_flow.BLOCK_ARCS) -> Game:
    """A game on the clusters of ``members(id, cluster, gdeg)``; ``edges(src, dst)`` are all edges with an end among them.

    An edge's midpoint is a terminal; that of an edge which leaves the cluster hangs on its one end.  Clusters of one edge or
    none don't play.
    """
    p = p or Parameters()
    if p.stop_flow_at_fraction:
        raise ValueError("stop_flow_at_fraction ends a flow in the middle; the game over tables routes each flow to its end")
    with scratch() as own:
        at = members.select("id", "cluster")
        e = edges.join(at.select(F.col("id").alias("src"), F.col("cluster").alias("cs")), "src", "left").join(at.select(F.col("id").alias("dst"), F.col("cluster").alias("cd")), "dst", "left")
        both = F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("cs").alias("c"), F.col("cd").alias("o")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"), F.col("cd").alias("c"), F.col("cs").alias("o")))
        ends = e.select(F.explode(both).alias("x")).select("x.*").where("c is not null")
        inner = F.coalesce(F.col("c") == F.col("o"), F.lit(False))
        low, high = F.least("u", "v"), F.greatest("u", "v")
        # A midpoint inside is named by both ends in order; one that hangs by its end and the outer one, so each side has its own.
        mid = F.when(inner, midpoint(low, high)).otherwise(midpoint(F.col("u"), F.col("v")))
        halves = materialise(ends.select(F.col("c").alias("cluster"), mid.alias("mid"), F.col("u").alias("id"), inner.alias("inner")), "game-halves")
        per = halves.groupBy("cluster").agg(F.count_distinct("mid").alias("m"), (F.count_if("inner") / 2).cast("long").alias("inside"))
        size = members.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("gdeg").alias("gvol")).join(per, "cluster", "left").na.fill(0, ["m", "inside"])
        t = iterations(F.greatest(F.col("inside"), F.lit(1)), p.t_const, p.t_factor)
        size = size.withColumn("t", t).withColumn("volume", F.col("gvol") + 2 * F.col("m"))
        size = size.withColumn("lower", F.call_function("div", F.call_function("div", F.col("volume"), F.lit(20)), F.col("t")))
        height = F.least(F.greatest(F.lit(1), flow_height(phi, F.greatest(F.col("m"), F.lit(2)))), 2 * (F.col("n") + F.col("m")) + 1)
        clusters = size.select(
            "cluster", "m", "t", "lower", F.greatest("lower", F.floor(p.min_balance * F.col("volume"))).alias("target"), F.greatest(F.lit(1), capacity(phi, F.col("t"))).alias("cap"),
            height.cast("long").alias("bound"), F.lit(0).cast("long").alias("rounds"), F.lit(0).cast("long").alias("gone"), (F.col("m") > 1).alias("running"),
        )
        clusters = own.keep(materialise(clusters, "game-clusters"))
        mids = halves.select("cluster", "mid").distinct()
        alive = members.select("id", "cluster", F.col("gdeg").cast("long"), F.lit(False).alias("mid")).unionAll(mids.select(F.col("mid").alias("id"), "cluster", F.lit(2).cast("long").alias("gdeg"), F.lit(True).alias("mid")))
        alive = own.keep(materialise(alive, "game-alive"))
        each = mids.select("cluster", F.col("mid").alias("eid"), F.explode(F.array(*[F.lit(k) for k in range(p.num_flow_vectors)])).alias("k"))
        vectors = own.keep(materialise(unit_vectors(materialise(each.withColumn("x", gaussian(F.col("cluster"), F.col("eid"), F.col("k"), seed=seed)), "game-random")), "game-vectors"))
        nodes = alive.join(clusters.select("cluster", "bound"), "cluster").select("id", "cluster", F.lit(0).alias("absorbed"), F.lit(0).alias("sink"), "bound")
        arcs = halves.join(clusters.select("cluster", "cap"), "cluster").select(F.col("mid").alias("src"), F.col("id").alias("dst"), "cap")
        flow = table_flow.lay_out(arcs, nodes, block_arcs=block_arcs)
        for t in flow.tables():
            own.keep(t)
        none = own.keep(materialise(alive.limit(0), "game-removed"))
        congestion = own.keep(materialise(flow.arcs().limit(0).select("u", "v", F.col("flow").alias("n")), "game-congestion"))
        matrix = potentials = None
        if p.sample_potential:
            matrix = own.keep(materialise(mids.select("cluster", F.col("mid").alias("eid"), F.col("mid").alias("col"), F.lit(1.0).alias("x")), "game-matrix"))
            potentials = own.keep(materialise(clusters.limit(0).select("cluster", "rounds", F.lit(0.0).alias("potential")), "game-potentials"))
    return Game(alive, none, vectors, congestion, clusters, flow, matrix, potentials)


def average_rows(matrix: DataFrame, matching: DataFrame) -> DataFrame:
    """Both rows of each pair of ``matching(cluster, a, b)`` become their mean; ``matrix(cluster, eid, col, x)`` holds what isn't 0."""
    pairs = matching.select("cluster", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    ends = pairs.select("cluster", "a", "b", F.explode(F.array("a", "b")).alias("eid"))
    m = matrix.join(ends, ["cluster", "eid"], "left")
    alone = m.where("a is null").select("cluster", "eid", "col", "x")
    mean = m.where("a is not null").groupBy("cluster", "a", "b", "col").agg((F.sum("x") / 2).alias("x"))
    return alone.unionAll(mean.select("cluster", F.explode(F.array("a", "b")).alias("eid"), "col", "x"))


def matrix_potential(matrix: DataFrame, alive: DataFrame) -> DataFrame:
    """(cluster, s, potential): squared distances of the rows of ``alive(cluster, eid)`` from their mean, over the columns alive.

    Entries that aren't there are zeros: a column's s - n of them each add the square of its mean.
    """
    ids = alive.select("cluster", "eid")
    size = ids.groupBy("cluster").agg(F.count("*").alias("s"))
    m = matrix.join(ids, ["cluster", "eid"], "left_semi").join(ids.withColumnRenamed("eid", "col"), ["cluster", "col"], "left_semi").join(size, "cluster")
    mean = m.groupBy("cluster", "col").agg((F.sum("x") / F.max("s")).alias("mean"), F.count("*").alias("n"))
    d = F.col("x") - F.col("mean")
    per = m.join(mean, ["cluster", "col"]).groupBy("cluster", "col").agg(F.sum(d * d).alias("square"), F.max("mean").alias("mean"), F.max("n").alias("n"), F.max("s").alias("s"))
    found = per.groupBy("cluster").agg(F.sum(F.col("square") + (F.col("s") - F.col("n")) * F.col("mean") * F.col("mean")).alias("potential"))
    return size.join(found, "cluster", "left").select("cluster", "s", F.coalesce("potential", F.lit(0.0)).alias("potential"))


def cut_side(alive: DataFrame, flow: table_flow.Flow) -> DataFrame:
    """(id): of each cluster with excess the smaller side of its best level cut by volume, the low one if they are equal, and
    what is left without a neighbour."""
    over = flow.nodes().where("absorbed > sink").join(alive, "id").select("cluster").distinct()
    cuts = table_flow.level_cuts(flow, alive).join(over, "cluster", "left_semi")
    side = alive.join(flow.nodes().select("id", "height"), "id").join(cuts, "cluster")
    small = materialise(side.where((F.col("height") >= F.col("level")) == (F.col("volume") < F.col("total") - F.col("volume"))).select("id", "cluster"), "game-side")
    left = flow.arcs().join(small.select(F.col("id").alias("u")), "u", "left_anti").join(small.select(F.col("id").alias("v")), "v", "left_anti")
    lonely = alive.join(small.select("cluster").distinct(), "cluster", "left_semi").join(small.select("id"), "id", "left_anti").join(left.select(F.col("u").alias("id")), "id", "left_anti")
    return small.select("id").unionAll(lonely.select("id"))


def play_round(game: Game, p: Parameters) -> Game:
    """One round of all clusters that run; the tables of the game before are deleted once the new ones stand."""
    with scratch() as own:
        run = game.clusters.where("running")
        mids = game.alive.where("mid").join(run.select("cluster"), "cluster", "left_semi").select("cluster", F.col("id").alias("eid"))
        vectors = materialise(game.vectors.join(mids, ["cluster", "eid"], "left_semi"), "game-playing")
        potentials = game.potentials
        if game.matrix is not None:
            now = matrix_potential(game.matrix, mids).join(run.select("cluster", "rounds"), "cluster").select("cluster", "rounds", "potential")
            potentials = own.keep(materialise(potentials.unionAll(now), "game-potentials"))
        best = materialise(select_vector(vectors).join(mids.groupBy("cluster").agg(F.count("*").alias("s")), "cluster"), "game-best")
        playing = best.where("s > 1")
        if p.adaptive:
            playing = playing.where(F.col("potential") >= convergence_limit(F.col("s")))
        x = vectors.join(playing.select("cluster", "k"), ["cluster", "k"])
        first = run.where("gone = 0").select("cluster") if p.krv_step_first else run.limit(0).select("cluster")
        rst = rst_split(x.join(first, "cluster", "left_anti"), balanced=p.balanced_cut_strategy).select("cluster", "eid", "side")
        sides = rst.unionAll(krv_split(x.join(first, "cluster", "left_semi"))) if p.krv_step_first else rst
        sides = materialise(sides, "game-sides")
        both = sides.groupBy("cluster").agg(F.count_distinct("side").alias("n")).where("n = 2").select("cluster")
        sides = sides.join(both, "cluster", "left_semi")

        unit = lambda side: F.when(F.col("side") == side, 1).otherwise(0).cast("long")
        flow = table_flow.restart(game.flow, sides.select(F.col("eid").alias("id"), unit("L").alias("absorbed"), unit("R").alias("sink")))
        if p.warm_start:
            flow = table_flow.blocking_flow(flow)
        flow = table_flow.route(flow)
        carried = flow.arcs().where("flow > 0").select("u", "v", F.col("flow").alias("n"))
        congestion = own.keep(materialise(game.congestion.unionAll(carried).groupBy("u", "v").agg(F.sum("n").alias("n")), "game-congestion"))
        gone = materialise(game.alive.join(cut_side(game.alive, flow), "id", "left_semi"), "game-gone")
        flow = table_flow.without(flow, gone.select("id"))
        alive = own.keep(materialise(game.alive.join(gone.select("id"), "id", "left_anti"), "game-alive"))
        removed = own.keep(materialise(game.removed.unionAll(gone.select(*game.removed.columns)), "game-removed"))

        sources = sides.where("side = 'L'").select(F.col("eid").alias("id"), "cluster").join(alive.select("id"), "id", "left_semi")
        pairs = table_flow.matched(flow, sources.select("id")).join(sources.select(F.col("id").alias("source"), "cluster"), "source")
        pairs = materialise(pairs.select("cluster", F.col("source").alias("a"), F.col("sink").alias("b")), "game-pairs")
        stay = vectors.join(alive.select(F.col("id").alias("eid")), "eid", "left_semi").select(*vectors.columns)
        after = own.keep(materialise(average_matched(stay, pairs), "game-vectors"))
        matrix = None if game.matrix is None else own.keep(materialise(average_rows(game.matrix, pairs), "game-matrix"))

        lost = gone.groupBy("cluster").agg(F.sum("gdeg").alias("lost"))
        counted = playing.select("cluster", F.lit(1).cast("long").alias("counted"))
        moved = both.select("cluster", F.lit(True).alias("both"))
        c = game.clusters.join(lost, "cluster", "left").join(counted, "cluster", "left").join(moved, "cluster", "left")
        c = c.withColumn("rounds", F.col("rounds") + F.when(F.col("running"), F.coalesce("counted", F.lit(0))).otherwise(0)).withColumn("gone", F.col("gone") + F.coalesce("lost", F.lit(0)))
        on = F.col("running") & F.col("counted").isNotNull() & (F.col("rounds") < F.greatest(F.col("t"), F.lit(p.min_iterations))) & (F.col("gone") <= F.col("target"))
        if p.break_at_empty_terminals:
            on &= F.coalesce("both", F.lit(False))
        clusters = own.keep(materialise(c.withColumn("running", on).select(*game.clusters.columns), "game-clusters"))
        for t in flow.tables():
            own.keep(t)
    for old in (game.alive, game.removed, game.vectors, game.congestion, game.clusters, *game.flow.tables(), *(x for x in (game.matrix, game.potentials) if x is not None)):
        discard(old)
    return Game(alive, removed, after, congestion, clusters, flow, matrix, potentials)


def play(game: Game, p: Parameters | None = None, *, rounds: int | None = None) -> Game:
    """Rounds until no cluster runs, or so many of them."""
    p, done = p or Parameters(), 0
    while done != rounds and game.running():
        game, done = play_round(game, p), done + 1
    return game


def outcomes(game: Game) -> DataFrame:
    """(cluster, kind, rounds, gone, congestion): balanced, near or expander, as the game of one worker says."""
    inside = game.congestion.join(game.alive.select(F.col("id").alias("u"), "cluster"), "u").join(game.alive.select(F.col("id").alias("v")), "v", "left_semi")
    most = inside.groupBy("cluster").agg(F.max("n").alias("congestion"))
    kept, lost = (t.where("not mid").groupBy("cluster").agg(F.count("*").alias(n)) for t, n in ((game.alive, "kept"), (game.removed, "lost")))
    c = game.clusters.join(most, "cluster", "left").join(kept, "cluster", "left").join(lost, "cluster", "left")
    some = lambda n: F.col(n).isNotNull()
    kind = F.when(some("kept") & some("lost") & (F.col("gone") > F.col("lower")), "balanced").when(~some("lost") | ~some("kept"), "expander").otherwise("near")
    return c.select("cluster", kind.alias("kind"), "rounds", "gone", F.greatest(F.lit(1).cast("long"), F.coalesce("congestion", F.lit(1).cast("long"))).alias("congestion"))


def sides(game: Game) -> DataFrame:
    """(id, cluster, removed) of all vertices of the clusters."""
    return game.alive.where("not mid").select("id", "cluster", F.lit(False).alias("removed")).unionAll(game.removed.where("not mid").select("id", "cluster", F.lit(True).alias("removed")))
