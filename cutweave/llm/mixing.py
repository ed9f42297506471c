"""Mixing sources to target weights.

Every document gets a key that is a hash of its id; within a source the documents are taken in the
order of the keys until the source's budget of words is met, whole epochs first.  The positions
are distributed prefix sums: rows are dealt by ranges of (source, key, id, size), each range is sorted and summed on its own, and
only the ranges' sums are summed up in order.  So neither a source nor an id that holds a third of all rows is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutweave.functions.columns import named
from cutweave.functions.storage import materialise, scratch
from cutweave.operators.sweeps import dealt, running

WORD = r"[^\x20\x09-\x0D]+"
#: No source is taken more often than this.
EPOCHS = 3


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, seed: int) -> Column:
    """60 bits of a hash of the id, the same in every run and in every SQL engine that has md5."""
    salted = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"#{seed}"))
    return F.conv(F.substring(F.md5(salted.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], *, epochs: int = EPOCHS) -> DataFrame:
    """For ``sizes(source, source_size)``: adds ``target``, a double.

    Sources by code point, null last, get ``weights`` in turn.  The total is shared by weight; a
    target stops at ``epochs`` times its source and the excess is shared again by weight.  That
    is the level L at which sum(min(epochs * size, L * weight)) is the total: with the sources in
    order of epochs * size / weight, those capped are a prefix.  One row per source is handled, so
    the windows without a partition are over the number of sources, not of documents.
    """
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("long"))
    wide = lambda c: c.cast("decimal(24,0)")
    s = s.withColumn("_cap", (wide(F.col("source_size")) * epochs).cast("decimal(24,0)"))  # products of sizes and weights are beyond 64 bits
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_total", wide(F.sum(wide(F.col("source_size"))).over(all_rows)))
    s = s.withColumn("_left", wide(F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0))))
    s = s.withColumn("_weights", F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    # Capped while the level that would be left for this source and all after it reaches its cap.
    s = s.withColumn("_open", F.col("_cap") * F.col("_weights") > F.col("_left") * F.col("_w"))
    s = s.withColumn("_first", F.max(F.when(F.col("_open"), F.col("_weights"))).over(all_rows))
    s = s.withColumn("_l", F.max(F.when(F.col("_open") & (F.col("_weights") == F.col("_first")), F.col("_left"))).over(all_rows))
    target = F.when(F.col("_open"), (F.col("_l") * F.col("_w")).cast("double") / F.col("_first")).otherwise(F.col("_cap").cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def _taken(docs: DataFrame, weights: Sequence[int], epochs: int) -> DataFrame:
    """For written ``docs(doc_id, source, size, key, tie, ...)``: adds source_size, target and taken.  ``tie`` tells rows apart."""
    own = [c for c in docs.columns if c not in ("key", "tie")]
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = materialise(targets(sources, weights, epochs=epochs).withColumnRenamed("source", "s"), "mix-targets")
    # One row per source on the right; the documents of a hot source can be split on the left.
    order = [F.col("key"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("tie")]
    rows = dealt(docs.withColumn("own", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))).withColumn("upto", F.col("size")), ["own"], order)
    at = running(rows, ["own"], order, {"upto": F.col("size")})
    at = at.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    at = at.withColumn("whole", whole).withColumn("rest", budget - F.col("whole") * F.col("source_size"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("upto") - F.col("size"))))
    return at.select(*own, "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))


def mix(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), *, seed: int = 0, epochs: int = EPOCHS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    Null texts have size 0 and are taken 0 times; the null source is a source of its own, the last
    one; null ids come first in the random order of a source.  Rows with equal ids are ordered
    by size, so equal rows may change places, which changes nothing.  A source without
    words has target 0.  Very long texts are counted whole.  Other columns are ignored; an empty table gives an
    empty result.
    """
    with scratch() as own:
        docs = documents.select(named(id_col).alias("doc_id"), named(source_col).alias("source"), words_in(named(text_col)).alias("size"))
        docs = own.keep(materialise(docs.withColumn("key", random_key(F.col("doc_id"), seed)).withColumn("tie", F.monotonically_increasing_id()), "mix-sizes"))
        out = _taken(docs, weights, epochs)
        return _keep_all(own, out)


def _keep_all(own, df: DataFrame) -> DataFrame:
    """``df`` reads the block's tables when it is asked for, so they stay."""
    for t in list(own.tables):
        own.keep(t)
    return df


def mixed_documents(documents: DataFrame, weights: Sequence[int] = (5, 2, 1), *, seed: int = 0, epochs: int = EPOCHS) -> DataFrame:
    """The mix itself, with the columns of ``documents``, whatever their names.

    A document is repeated once per epoch that takes it.  Where a source's budget ends inside a
    document, its last copy holds only the words up to there, joined by spaces.  Documents without words (null and empty
    texts) are neither wanted nor in the way, and go; so do those that the budget leaves out.
    Every row has a budget of its own, so rows that repeat an id, or are equal, together take what the
    mix gives them; rows of one id and size are ordered by a hash of their text.  An empty table gives an empty result.
    """
    with scratch() as own:
        # The caller's columns travel in one struct; rows are numbered as they are written, and keep the number.
        text = F.col("row")["text"]
        docs = documents.select(F.struct(*[named(c) for c in documents.columns]).alias("row"))
        docs = docs.select("row", words_in(text).alias("size"), F.monotonically_increasing_id().alias("n"))
        docs = own.keep(materialise(docs, "mix-documents"))
        tie = F.struct(F.xxhash64(text), "n")
        sizes = docs.select(F.col("row")["doc_id"].alias("doc_id"), F.col("row")["source"].alias("source"), "size", "n", tie.alias("tie"))
        sizes = materialise(sizes.withColumn("key", random_key(F.col("doc_id"), seed)), "mix-sizes")
        taken = own.keep(materialise(_taken(sizes, weights, epochs).where("taken > 0").select("n", "taken"), "mix-taken"))
    docs = docs.join(taken, "n")
    docs = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    # Cut by words only where a copy is cut: at most one document of each source.
    head = F.concat_ws(" ", F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words.cast("int")))
    cut, out = words < F.col("size"), []
    for c in documents.columns:
        old = F.col("row").getField(c)
        if c.lower() == "text":
            old = F.when(cut, head).otherwise(old)
        elif c.lower() == "n_chars":
            old = F.when(cut, F.char_length(head)).otherwise(old).cast("long")
        out.append(old.alias(c))
    return docs.select(*out)
