"""Structured Streaming over edges that arrive over time: exact degrees and windowed edge counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_degrees(pairs: DataFrame, *, watermark: str = "1 hour") -> DataFrame:
    """``pairs(u, v, ts)``, a stream, -> running (id, deg) over distinct edges.

    Edges are normalised and repeated ones dropped within the watermark, so the state for that is bounded by
    the edges of that time; the degrees keep a row for every id for good.  Write it in complete or update mode.
    """
    e = pairs.where("u is not null and v is not null and u <> v").withWatermark("ts", watermark)
    e = e.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), "ts").dropDuplicatesWithinWatermark(["src", "dst"])
    return e.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))


def stream_edge_windows(pairs: DataFrame, *, window: str = "10 minutes", watermark: str = "1 hour", exact: bool = False) -> DataFrame:
    """Arcs per window of event time; windows close when the watermark has passed them.

    ``n_edges`` is estimated from a sketch of bounded size, or, if ``exact``, counted, with a row of state for each edge of the
    open windows; write that one in append mode.
    """
    e = pairs.where("u is not null and v is not null and u <> v").withWatermark("ts", watermark)
    if exact:
        each = e.groupBy(F.window("ts", window), F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.count("*").alias("n"))
        return each.groupBy(F.window(F.window_time("window"), window)).agg(F.sum("n").alias("n_pairs"), F.count("*").alias("n_edges"))
    return e.groupBy(F.window("ts", window)).agg(F.count("*").alias("n_pairs"), F.approx_count_distinct(F.struct(F.least("u", "v"), F.greatest("u", "v"))).alias("n_edges"))
