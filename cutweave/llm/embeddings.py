"""Embedding near-dedup: all links of cosine 0.9 or more, by tiles of int8 products.

Each unit vector is rounded to int8 times a scale of its own, and the length of what rounding
took away is kept.  With u = u' + e and v = v' + f the true cosine lies within |e| |v'| + |f| of the
rounded one, so pairs whose upper bound is below the threshold are surely no links.

1. Equal vectors are one class, so a vector of a third of all rows is compared once.
2. Classes are quantised once; blocks of codes (one byte a component) meet pairwise in tiles.  Sums of int8
   products are whole numbers, which a float32 matrix product gives exactly.  A tile returns the vectors
   with any possible partner, never pairs.
3. Only for those the full vectors are fetched, and in each tile the pairs that may reach the
   threshold are computed again in double precision.  A tile returns numbers of links and stars.

Blocks grow with the square root of the machine's tasks up to a bound in bytes, so every vector is sent a
few times until blocks are full, and to one tile for each further full block after that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutweave.functions.columns import named
from cutweave.functions.storage import materialise, scratch
from cutweave.llm.kernels import bounded_batches, hand_back, smallest_reached
from cutweave.operators.components import components

THRESHOLD = 0.9
#: Vectors of a block at most, bytes of a block's codes at most, and vectors below which no block is cut.
BLOCK, BLOCK_BYTES, SMALL = 65_536, 8 << 20, 2_048
#: Rows and columns of a tile that are multiplied at once, and pairs that are computed again at once.
ROWS, COLUMNS, PAIRS = 512, 4_096, 50_000


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, lengths of the rounded vectors and lengths of the rounding errors, rounded up."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    up = 1 + 1e-9
    return codes, scale, np.linalg.norm(back, axis=1) * up, np.linalg.norm(unit - back, axis=1) * up + 1e-12


def possible(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...] | None, threshold: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of quantised vectors: (first row, first column, mask of the pairs that may reach ``threshold``), chunk by chunk.

    With ``y`` None the pairs i < j within x.
    """
    qx, sx, _, ex = x
    qy, sy, ly, ey = x if y is None else y
    # Sums of d products of two int8 numbers are whole; float32 holds them exactly up to 2**24.
    kind = np.float32 if qx.shape[1] * 127 * 127 < 1 << 24 else np.float64
    for b in range(0, len(qy), COLUMNS):
        ty = np.ascontiguousarray(qy[b : b + COLUMNS].T.astype(kind))
        scale, most_l, most_e = sy[b : b + COLUMNS].astype(kind), float(ly[b : b + COLUMNS].max()), float(ey[b : b + COLUMNS].max())
        for a in range(0, len(qx), ROWS):
            if y is None and a >= b + COLUMNS:
                break
            product = qx[a : a + ROWS].astype(kind) @ ty
            product *= scale
            # The slack covers the rounding of the scales; limits are lowered by it, so no pair is lost.
            limit = (threshold - ex[a : a + ROWS] * most_l - most_e - 1e-5) / sx[a : a + ROWS]
            mask = product >= limit.astype(kind)[:, None]
            if y is None and a + ROWS > b:
                mask &= np.arange(a, a + len(mask))[:, None] < np.arange(b, b + mask.shape[1])[None, :]
            yield a, b, mask


def tile_links(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in x, in y) of all pairs with cosine >= threshold, in bounded chunks; with y None, pairs i < j within x."""

    def unit(a: np.ndarray) -> np.ndarray:
        a = a / np.abs(a).max(axis=1)[:, None]  # squares of very great or small components are beyond doubles
        return a / np.linalg.norm(a, axis=1)[:, None]

    ux = unit(x)
    uy = ux if y is None else unit(y)
    for a, b, mask in possible(quantised(ux), None if y is None else quantised(uy), threshold):
        i, j = np.nonzero(mask)
        if len(i) > mask.size / 8:  # crowded: the pairs' cosines are read off one product in double precision
            exact = ux[a : a + ROWS] @ uy[b : b + COLUMNS].T
            ok = exact[i, j] >= threshold
            yield i[ok] + a, j[ok] + b
            continue
        for k in range(0, len(i), PAIRS):
            one, two = i[k : k + PAIRS] + a, j[k : k + PAIRS] + b
            ok = np.einsum("ij,ij->i", ux[one], uy[two]) >= threshold
            yield one[ok], two[ok]


def _matrix(column: pa.ChunkedArray, n: int, kind=float) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(n, -1)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    """Positions of a tile's two blocks; None as the second where a block meets itself."""
    if table.column("i")[0].as_py() == table.column("j")[0].as_py():
        return np.arange(table.num_rows), None
    side = table.column("side").to_numpy()
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1)


def _survivors(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.int8).reshape(table.num_rows, -1)
        parts = (codes, *(table.column(c).to_numpy() for c in ("scale", "length", "error")))
        one, two = _sides(table)
        found = np.zeros(table.num_rows, bool)
        if two is None or (len(one) and len(two)):
            cut = lambda at: tuple(p[at] for p in parts)
            for a, b, mask in possible(cut(one), None if two is None else cut(two), threshold):
                found[one[a : a + len(mask)]] |= mask.any(axis=1)
                other = one if two is None else two
                found[other[b : b + mask.shape[1]]] |= mask.any(axis=0)
        return table.select(["key", "d", "i", "j", "side"]).filter(pa.array(found))

    return run


def _verified(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        keys, copies = table.column("key").to_numpy(), table.column("copies").to_numpy()
        x = _matrix(table.column("x"), len(keys))
        one, two = _sides(table)
        links = np.zeros(len(keys), np.int64)
        stars: list[tuple[np.ndarray, np.ndarray]] = []
        if two is None or (len(one) and len(two)):
            for left, right in tile_links(x[one], None if two is None else x[two], threshold):
                left, right = one[left], (one if two is None else two)[right]
                links += np.bincount(left, copies[right], len(keys)).astype(np.int64) + np.bincount(right, copies[left], len(keys)).astype(np.int64)
                own, where = np.unique(np.concatenate([left, right]), return_inverse=True)
                reached = smallest_reached(own, where[: len(left)], where[len(left) :])
                stars.append((own[reached != own], reached[reached != own]))
        ends = [np.concatenate(s) for s in zip(*stars)] if stars else [np.zeros(0, np.int64)] * 2
        reached, some = smallest_reached(keys, ends[0], ends[1]), links > 0
        return pa.table({"key": keys[some], "links": links[some], "reached": reached[some]})

    return run


def _codes(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column(1).to_numpy()
            for size in np.unique(d):
                own = batch.filter(pa.array(d == size))
                x = _matrix(pa.chunked_array([own.column(2)]), own.num_rows)
                x /= np.abs(x).max(axis=1)[:, None]  # so that squares neither vanish nor overflow
                codes, scale, length, error = quantised(x / np.linalg.norm(x, axis=1)[:, None])
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array((own.column(0).to_numpy() % blocks).astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), *map(pa.array, (scale, length, error))],
                    ["key", "d", "block", "codes", "scale", "length", "error"],
                )
        hand_back()

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = THRESHOLD, block: int = BLOCK, small: int = SMALL, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id (smallest id reached), kept (its own smallest).

    Vectors that are null, empty, zero or hold null or non-finite numbers link with nothing, nor
    do those of different lengths with each other.  Every row is a vector of its own: rows that
    repeat an id, with the same vector or another one, each count and link, and equal vectors link with
    each other.  Rows without id link like others; their component is the smallest id reached,
    null if there is none, and they are kept only in that case.  Other columns are ignored; an
    empty table gives an empty result.
    """
    with scratch() as own:
        raw = vectors.select(named(id_col).cast("long").alias("id"), named(vector_col).alias("x"))
        finite = ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("x", lambda v: v != 0)
        raw = raw.withColumn("d", F.when(F.coalesce(finite, F.lit(False)), F.size("x")))
        # 128 bits of xxhash name a vector.
        raw = raw.select("id", "x", "d", *[F.when(F.col("d") > 0, F.xxhash64(F.lit(seed), "x")).alias(c) for seed, c in ((1, "a"), (2, "b"))])
        rows = own.keep(materialise(raw.select("id", "a", "b"), "vectors-rows"))
        classes = bounded_batches(raw).where("d > 0").groupBy("a", "b").agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("d").alias("d"), F.transform(F.first("x"), lambda v: v.cast("double")).alias("x"))
        classes = materialise(classes.withColumn("key", F.monotonically_increasing_id()), "vectors-classes")
        n, width = classes.agg(F.count("*"), F.max("d")).first()
        tasks = vectors.sparkSession.sparkContext.defaultParallelism
        blocks = max(1, math.ceil(n / max(1, min(block, BLOCK_BYTES // max(1, width or 1)))), min(math.ceil(2 * math.sqrt(tasks)), math.ceil(n / small)))
        codes = materialise(classes.select("key", "d", "x").mapInArrow(_codes(blocks), "key long, d int, block int, codes binary, scale double, length double, error double"), "vectors-codes")
        block_ = F.col("block")
        tiles = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda other: F.struct(F.least(other, block_).alias("i"), F.greatest(other, block_).alias("j"), F.when(block_ <= other, 0).otherwise(1).alias("side")))
        spread = codes.withColumn("t", F.explode(tiles)).select("key", "d", "codes", "scale", "length", "error", "t.i", "t.j", "t.side")
        survived = materialise(spread.groupBy("d", "i", "j").applyInArrow(_survivors(threshold), "key long, d int, i int, j int, side int"), "vectors-survivors")
        full = survived.join(classes.select("key", "copies", "x"), "key")
        found = materialise(full.groupBy("d", "i", "j").applyInArrow(_verified(threshold), "key long, links long, reached long"), "vectors-links")
        reach = components(found.select(F.col("reached").alias("a"), F.col("key").alias("b")))
        known = classes.select("a", "b", "key", "copies", "least").join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(reach.withColumnRenamed("id", "key"), "key", "left")
        known = materialise(known.select("a", "b", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "key").alias("root")), "vectors-known")
        smallest = known.groupBy("root").agg(F.min("least").alias("component"))
        known = own.keep(materialise(known.join(smallest, "root").select("a", "b", "links", "component"), "vectors-result"))
    # Rows of one vector may be a third of all: one row of each class on the right, so the left can be split.
    out = rows.join(known, ["a", "b"], "left")
    own_id = F.when(F.col("a").isNull(), F.col("id"))
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", own_id).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
