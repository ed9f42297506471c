"""Line dedup: lines that stand on many distinct sites are boilerplate.

Lines seen as often as the threshold at least get a HyperLogLog sketch of the sites they were seen on; sketches merge by
aggregation, so a line of a third of all rows costs one sketch per task.  Lines whose estimate is
near the threshold get an exact distinct count.  The boilerplate is then removed across sites.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutweave.functions.columns import named
from cutweave.functions.storage import materialise, scratch

#: Sites on which a line must stand to be boilerplate.
SITES = 6
#: log2 of the sketch's size; its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 11
#: Estimates within this many standard errors of the threshold are counted exactly.
ERRORS = 6


def line_key(line: Column) -> Column:
    """128 bits of a hash of the line without white space at its ends; null for blank lines."""
    body = F.btrim(line, F.lit(" \t\n\v\f\r"))
    return F.when(body != "", F.struct(F.xxhash64(F.lit(1), body).alias("a"), F.xxhash64(F.lit(2), body).alias("b")))


def _lines(documents: DataFrame) -> DataFrame:
    """One row per line that is not blank: doc_id, version (hash of the text), site, pos, a, b."""
    text = named("text")
    lines = documents.select(named("doc_id").alias("doc_id"), F.xxhash64(text).alias("version"), named("source").alias("site"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    return lines.select("doc_id", "version", "site", "pos", line_key(F.col("line")).alias("key")).where("key is not null").select("doc_id", "version", "site", "pos", "key.a", "key.b")


def boilerplate(lines: DataFrame, sites: int = SITES, lg_k: int = LG_K) -> DataFrame:
    """Of ``lines(a, b, site, doc_id)``: a, b of lines on at least ``sites`` distinct sites, and the least doc_id each.

    A null site counts as a site of its own.
    """
    site = F.coalesce(F.concat(F.lit("="), F.col("site")), F.lit(""))
    often = materialise(lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where(F.col("n") >= sites).select("a", "b", "first_doc"), "line-often")
    # Each line is one row on the right, so a hot line can be split on the left.
    shown = lines.select("a", "b", site.alias("site")).join(often, ["a", "b"])
    seen = shown.groupBy("a", "b", "first_doc").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("estimate"))
    spread = ERRORS * 1.04 / math.sqrt(1 << lg_k)
    low, high = math.floor(sites / (1 + spread)) - 1, math.ceil(sites / max(1 - spread, 0.1)) + 1
    seen = materialise(seen.where(F.col("estimate") >= low), "line-spread")
    sure = seen.where(F.col("estimate") > high).select("a", "b", "first_doc")
    near = seen.where(F.col("estimate") <= high)
    # Pairs of line and site are combined before the shuffle: at most sites x lines rows.
    pairs = lines.select("a", "b", site.alias("site")).join(near.select("a", "b", "first_doc"), ["a", "b"]).groupBy("a", "b", "first_doc", "site").agg(F.lit(1).alias("one"))
    exact = pairs.groupBy("a", "b", "first_doc").agg(F.count("*").alias("n")).where(F.col("n") >= sites).select("a", "b", "first_doc")
    return sure.unionAll(exact)


def remove_boilerplate(documents: DataFrame, *, sites: int = SITES, lg_k: int = LG_K, keep_first: bool = True, removed: str = "lines_removed") -> DataFrame:
    """``documents`` with the text without boilerplate lines, and their number in the column ``removed``.

    With ``keep_first`` the document of the smallest id that holds a boilerplate line keeps it, so
    that no text vanishes from the corpus.  Null and empty texts stay as they are; blank lines are
    never boilerplate; a null source is a site of its own.  Rows are matched by doc_id and text, so
    rows that repeat an id are handled each, and equal rows alike; rows with a null id lose no line.  Very long texts
    cost time in proportion.  Other columns are carried along, whatever their names (``n_chars`` is counted anew
    where lines went; an existing column ``removed`` is replaced); an empty table gives an empty result.
    """
    with scratch() as own:
        lines = materialise(_lines(documents.where(named("doc_id").isNotNull())), "line-keys")
        bad = materialise(boilerplate(lines, sites, lg_k), "line-boilerplate")
        # Each boilerplate line is one row on the right, so a hot line can be split on the left.
        hit = lines.join(bad, ["a", "b"]).where(~(F.lit(keep_first) & (F.col("doc_id") == F.col("first_doc"))))
        drop = hit.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("drop"))
        drop = own.keep(materialise(drop, "line-removals"))
    # The caller's columns travel in one struct, so that none of them meets the names used here.
    df = documents.select(F.struct(*[named(c) for c in documents.columns]).alias("row"), named("doc_id").alias("doc_id"), F.xxhash64(named("text")).alias("version"))
    df = df.join(drop, ["doc_id", "version"], "left")
    # A row with removals has its text split once: the lambda's argument holds the lines and the places that stay.
    lines_ = F.split(F.col("row")["text"], "\n", -1)
    split = F.array(F.struct(lines_.alias("lines"), F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col("drop")).alias("stay")))
    joined = F.transform(split, lambda x: F.array_join(F.transform(x["stay"], lambda i: F.element_at(x["lines"], i + 1)), "\n"))[0]
    df = df.select("row", "drop", F.when(F.col("drop").isNull(), F.col("row")["text"]).otherwise(joined).alias("left"))
    out = []
    for c in documents.columns:
        old = F.col("row").getField(c)
        if c.lower() == "text":
            out.append(F.col("left").alias(c))
        elif c.lower() == "n_chars":
            out.append(F.when(F.col("drop").isNull(), old).otherwise(F.char_length("left")).cast("long").alias(c))
        elif c.lower() != removed.lower():
            out.append(old.alias(c))
    return df.select(*out, F.coalesce(F.size("drop"), F.lit(0)).alias(removed))
