"""Cuts read off an order of the vertices, splits of flow vectors, and gains of single moves.

Ranks and running sums over an order of all rows of a cluster are distributed: rows are dealt out by ranges of
(cluster, order), counted and summed inside each range, and only the ranges' sums are summed up in order.  So a cluster
that holds most rows is no task of its own.  Inputs without a cluster column are one cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutweave.functions.storage import apart, discard, materialise, scratch

UPTO = (Window.unboundedPreceding, Window.currentRow)


def dealt(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` with ``range``, the number of the range of (keys, order) that a row is in, written out."""
    ranges = df.repartitionByRange(*keys, *order).withColumn("range", F.spark_partition_id())
    return materialise(ranges, "sweep-ranges")


def running(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], rank: str | None = None) -> DataFrame:
    """Of ``rows`` dealt by the same keys and order: adds sums up to and with each row, and its rank from 1 on."""
    inside = Window.partitionBy(*keys, "range").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = dict(sums) | ({rank: F.lit(1)} if rank else {})
    whole = rows.groupBy(*keys, "range").agg(*[F.sum(c).alias(f"_{n}") for n, c in parts.items()])
    whole = whole.select(*keys, "range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in parts])
    here = rows.select("*", *[F.sum(c).over(inside.rowsBetween(*UPTO)).alias(f"__{n}") for n, c in sums.items()], *([F.row_number().over(inside).cast("long").alias(f"__{rank}")] if rank else []))
    kept = [F.col(c) for c in rows.columns if c not in parts]
    return here.join(whole, [*keys, "range"]).select(*kept, *[(F.col(f"__{n}") + F.col(f"_{n}")).cast("long").alias(n) for n in parts])


def sweep_cut(arcs: DataFrame, scores: DataFrame) -> DataFrame:
    """Prefix cuts of ``scores(cluster, id, score, gdeg)`` by descending score, then id.

    Returns cluster, rank, id, cut, volume, total.  An arc from rank i to a later rank adds 1 to the
    cut at i and takes 1 away at the later one, so cuts are running sums of one number per vertex.
    """
    order = [F.desc("score"), F.col("id")]
    with scratch() as own:
        rows = dealt(scores.select("cluster", "id", "score", "gdeg"), ["cluster"], order)
        ranked = own.keep(materialise(running(rows, ["cluster"], order, {"volume": F.col("gdeg")}, "rank"), "sweep-ranked"))
    r = apart(ranked.select("cluster", F.col("id").alias("u"), F.col("rank").alias("ru")))
    e = arcs.join(r, "u").join(r.select("cluster", F.col("u").alias("v"), F.col("ru").alias("rv")), ["cluster", "v"])
    delta = e.groupBy("cluster", F.col("u").alias("id")).agg(F.sum(F.when(F.col("rv") > F.col("ru"), 1).otherwise(-1)).alias("delta"))
    with scratch() as own:
        out = own.keep(materialise(ranked.join(apart(delta), ["cluster", "id"], "left").withColumn("delta", F.coalesce("delta", F.lit(0))), "sweep-deltas"))
    out = running(out, ["cluster"], [F.col("rank")], {"cut": F.col("delta")})
    total = ranked.groupBy("cluster").agg(F.sum("gdeg").cast("long").alias("total"))
    return out.join(total, "cluster").select("cluster", F.col("rank").cast("int").alias("rank"), "id", "cut", "volume", "total")


def best_sweep_cut(sweep: DataFrame) -> DataFrame:
    """Per cluster the first prefix of least conductance cut / min(volume, total - volume)."""
    low = F.least(F.col("volume"), F.col("total") - F.col("volume"))
    s = sweep.where(low > 0).withColumn("conductance", F.col("cut") / low)
    return s.groupBy("cluster").agg(F.min(F.struct("conductance", "rank", "cut", "volume")).alias("b")).select("cluster", F.col("b.rank").alias("rank"), F.col("b.cut").alias("cut"), F.col("b.volume").alias("volume"), F.col("b.conductance").alias("conductance"))


def sweep_sides(sweep: DataFrame, best: DataFrame) -> DataFrame:
    """(cluster, id, inside): both sides of the prefixes that ``best(cluster, rank)`` names; clusters without one have no rows."""
    last = best.select("cluster", F.col("rank").alias("last"))
    return sweep.join(last, "cluster").select("cluster", "id", (F.col("rank") <= F.col("last")).alias("inside"))


def level_cut(arcs: DataFrame, heights: DataFrame) -> DataFrame:
    """Threshold cuts on ``heights(id, height, gdeg)``: per height >= 1 the cut and volume of all vertices that high.

    Returns height, cut, volume, total, conductance; the best one is the highest level of least
    conductance below 1 with a positive cut.
    """
    h = heights.select(F.col("id").alias("u"), F.col("height").alias("hu"))
    e = arcs.join(h, "u").join(h.select(F.col("u").alias("v"), F.col("hu").alias("hv")), "v")
    delta = e.groupBy(F.col("hu").alias("height")).agg(F.sum(F.signum(F.col("hu") - F.col("hv"))).cast("long").alias("delta"))
    levels = heights.groupBy("height").agg(F.sum("gdeg").alias("gdeg")).join(delta, "height", "left")
    w = Window.orderBy(F.desc("height")).rowsBetween(*UPTO)  # one row per height, at most the height bound
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = levels.select("height", F.sum(F.coalesce("delta", F.lit(0))).over(w).cast("long").alias("cut"), F.sum("gdeg").over(w).cast("long").alias("volume"), F.sum("gdeg").over(total).cast("long").alias("total"))
    low = F.least(F.col("volume"), F.col("total") - F.col("volume"))
    return out.where("height >= 1").withColumn("conductance", F.when(low > 0, F.col("cut") / low))


def best_level(levels: DataFrame) -> DataFrame:
    """The level to cut at; no row if none has a positive cut and conductance below 1."""
    good = levels.where("cut > 0 and conductance < 1")
    return good.orderBy("conductance", F.desc("height")).limit(1)


# -- flow vectors(cluster, eid, k, x) ------------------------------------------------------------


def centred(vectors: DataFrame) -> DataFrame:
    """Adds avg and d = x - avg per cluster and vector.

    The averages are written: then their size is known, and few of them are sent to the vectors instead of these being dealt by cluster.
    """
    avg = materialise(vectors.groupBy("cluster", "k").agg(F.avg("x").alias("avg")), "sweep-averages")
    return vectors.join(avg, ["cluster", "k"]).withColumn("d", F.col("x") - F.col("avg"))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Centred and scaled to length 1 per cluster and vector."""
    c = centred(vectors)
    norm = materialise(c.groupBy("cluster", "k").agg(F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("norm")), "sweep-norms")
    return c.join(norm, ["cluster", "k"]).select("cluster", "eid", "k", F.when(F.col("norm") > 0, F.col("d") / F.col("norm")).otherwise(0.0).alias("x"))


def potentials(vectors: DataFrame) -> DataFrame:
    """Sum of squared deviations per cluster and vector, from centred values."""
    return centred(vectors).groupBy("cluster", "k").agg(F.sum(F.col("d") * F.col("d")).alias("potential"), F.count("*").alias("s"))


def select_vector(vectors: DataFrame) -> DataFrame:
    """Per cluster the vector of the greatest potential, the smallest k among equals."""
    p = potentials(vectors).groupBy("cluster").agg(F.max(F.struct("potential", -F.col("k"))).alias("m"))
    return p.select("cluster", (-F.col("m.col2")).alias("k"), F.col("m.potential").alias("potential"))


def krv_split(vector: DataFrame) -> DataFrame:
    """(cluster, eid, side): the lower half by (x, eid) is left; the odd one out is right."""
    order = [F.col("x"), F.col("eid")]
    with scratch() as own:
        rows = own.keep(dealt(vector.select("cluster", "eid", "x"), ["cluster"], order))
    half = rows.groupBy("cluster").agg(F.floor(F.count("*") / 2).alias("half"))
    ranked = running(rows, ["cluster"], order, {}, "rank").join(half, "cluster")
    return ranked.select("cluster", "eid", F.when(F.col("rank") <= F.col("half"), "L").otherwise("R").alias("side"))


def rst_split(vector: DataFrame, *, balanced: bool = True) -> DataFrame:
    """(cluster, eid, side, rank): terminals by the sign of x - avg, the most extreme ones first.

    The smaller side is left (R if they are equal in number and above).  If the left side has at most a
    twentieth of the potential, the sides are x <= avg + 4l/s and x >= avg + 6l/s, with l the left side's total
    deviation.  Balanced: both sides get as many as left has; else left stops at an eighth of all.
    """
    vector = materialise(vector.select("cluster", "eid", "x"), "sweep-vector")  # read for the averages, the sums and the ranges
    whole = materialise(vector.groupBy("cluster").agg(F.avg("x").alias("avg"), F.count("*").alias("s")), "sweep-averages")  # written, as in centred
    v = vector.join(whole, "cluster").select("cluster", "eid", "s", (F.col("x") - F.col("avg")).alias("d"))
    low, square = F.col("d") < 0, F.col("d") * F.col("d")
    of = lambda f: [F.sum(F.when(low, f).otherwise(0.0)), F.sum(F.when(low, 0.0).otherwise(f))]
    (sq_low, sq_high), (abs_low, abs_high) = of(square), of(F.abs("d"))
    sums = v.groupBy("cluster").agg(F.count_if(low).alias("nlow"), sq_low.alias("sq_low"), sq_high.alias("sq_high"), abs_low.alias("abs_low"), abs_high.alias("abs_high"))
    sums = materialise(sums, "sweep-sums")
    v = v.join(sums, "cluster")
    swap = F.col("nlow") > F.col("s") - F.col("nlow")
    potl, l = F.when(swap, F.col("sq_high")).otherwise(F.col("sq_low")), F.when(swap, F.col("abs_high")).otherwise(F.col("abs_low"))
    again = potl <= (F.col("sq_low") + F.col("sq_high")) / 20
    far = F.when(F.col("d") <= 4 * l / F.col("s"), "R").when(F.col("d") >= 6 * l / F.col("s"), "L")
    v = v.select("cluster", "eid", "s", "d", F.when(again, far).otherwise(F.when(low != swap, "L").otherwise("R")).alias("side")).where("side is not null")
    keys, order = ["cluster", "side"], [F.desc(F.abs("d")), F.col("eid")]
    with scratch() as own:
        rows = own.keep(dealt(v, keys, order))
    for t in (vector, whole, sums):
        discard(t)
    sizes = materialise(rows.groupBy("cluster").agg(F.count_if(F.col("side") == "L").alias("nl"), F.count_if(F.col("side") == "R").alias("nr")), "sweep-sizes")
    ranked = running(rows, keys, order, {}, "rank").join(sizes, "cluster")
    left = F.least("nl", "nr") if balanced else F.least(F.floor(F.col("s") / 8), F.col("nl"), F.col("nr"))
    right = F.least("nl", "nr") if balanced else F.col("nr")
    return ranked.where(F.when(F.col("side") == "L", F.col("rank") <= left).otherwise(F.col("rank") <= right)).select("cluster", "eid", "side", F.col("rank").cast("int").alias("rank"))


def average_matched(vectors: DataFrame, matching: DataFrame) -> DataFrame:
    """Both ends of each pair of ``matching(cluster, a, b)`` get their mean in every vector.

    Ids may stand for several rows: then each row meets each pair of its id and each row of the other end.  The vectors of an
    id are one row on the way, so they are shuffled twice.
    """
    known = vectors.where("cluster is not null and eid is not null")
    rows = known.groupBy("cluster", "eid").agg(F.collect_list(F.struct("k", "x")).alias("xs"))
    turn = F.explode(F.array(F.struct(F.col("a").alias("eid"), F.col("b").alias("p")), F.struct(F.col("b").alias("eid"), F.col("a").alias("p")))).alias("q")
    ends = matching.select("cluster", turn).select("cluster", "q.eid", "q.p")
    other = rows.select("cluster", F.col("eid").alias("p"), F.col("xs").alias("ys"))
    v = rows.join(ends, ["cluster", "eid"], "left").join(other, ["cluster", "p"], "left").select("cluster", "eid", F.explode("xs").alias("r"), "ys")
    of = F.filter(F.coalesce("ys", F.array()), lambda y: y["k"] == F.col("r.k"))
    means = F.transform(of, lambda y: (F.col("r.x") + y["x"]) / 2)
    v = v.select("cluster", "eid", F.col("r.k").alias("k"), F.explode(F.when(F.size(means) > 0, means).otherwise(F.array("r.x"))).alias("m"), F.col("r.x").alias("x"))
    alone = vectors.where("cluster is null or eid is null").select("cluster", "eid", "k", "x")
    return v.select("cluster", "eid", "k", F.coalesce("m", "x").alias("x")).unionAll(alone)


def fake_matching(terminals: DataFrame, matching: DataFrame, seed: int = 0) -> DataFrame:
    """Pairs up unmatched ``terminals(cluster, eid, side)`` of both sides in hashed order: (cluster, a, b)."""
    used = matching.select("cluster", F.explode(F.array("a", "b")).alias("eid"))
    left_over = terminals.join(used, ["cluster", "eid"], "left_anti")
    key = F.md5(F.concat(F.col("eid").cast("string"), F.lit(f"#{seed}")).cast("binary"))
    keys, order = ["cluster", "side"], [F.col("key"), F.col("eid")]
    with scratch() as own:
        rows = own.keep(dealt(left_over.select("cluster", "side", "eid", key.alias("key")), keys, order))
    ranked = running(rows, keys, order, {}, "r")
    one = ranked.where("side = 'L'").select("cluster", "r", F.col("eid").alias("a"))
    two = ranked.where("side = 'R'").select("cluster", "r", F.col("eid").alias("b"))
    return one.join(two, ["cluster", "r"]).select("cluster", "a", "b")


def vertex_gains(arcs: DataFrame, members: DataFrame) -> DataFrame:
    """For ``members(id, inside, gdeg)``: the conductance change if one vertex changes sides.

    Returns id, affinity (neighbours inside), new_cut, new_volume, gain (old minus new conductance;
    null where one of them has an empty side).
    """
    side = members.select("id", "inside")
    e = arcs.join(side.select(F.col("id").alias("v"), F.col("inside").alias("iv")), "v").groupBy(F.col("u").alias("id")).agg(F.count("*").alias("deg"), F.count_if("iv").alias("affinity"))
    m = members.join(e, "id", "left").select("id", "inside", "gdeg", F.coalesce("deg", F.lit(0)).alias("deg"), F.coalesce("affinity", F.lit(0)).alias("affinity"))
    total = m.agg(F.sum("gdeg").alias("total"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("gdeg"))), F.lit(0)).alias("vol"), F.coalesce(F.sum(F.when(F.col("inside"), F.col("deg") - F.col("affinity"))), F.lit(0)).alias("cut"))
    m = m.crossJoin(total)  # one row
    sign = F.when(F.col("inside"), -1).otherwise(1)
    m = m.withColumn("new_cut", F.col("cut") + sign * (F.col("deg") - 2 * F.col("affinity"))).withColumn("new_volume", F.col("vol") + sign * F.col("gdeg"))
    phi = lambda cut, vol: cut / F.nullif(F.least(vol, F.col("total") - vol), F.lit(0))
    return m.select("id", F.col("affinity").cast("long").alias("affinity"), F.col("new_cut").cast("long").alias("new_cut"), F.col("new_volume").cast("long").alias("new_volume"), (phi(F.col("cut"), F.col("vol")) - phi(F.col("new_cut"), F.col("new_volume"))).alias("gain"))
