"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again, each time some turns longer.  A rolling hash over
the turns names every prefix of every conversation.  Conversations whose whole hash is a proper
prefix of another one are taken out by an anti join, equal ones are reduced to the smallest id, and
what is left, the maximal conversations, is rendered.

The rolling hash of a prefix is the exclusive or of its turns' hashes, each mixed with the turn's place.  So
it is a prefix sum, and a conversation can be cut by turn numbers into chunks that are numbered and hashed in different
tasks; only a row for each chunk is summed up in order.  No conversation is ever gathered into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutweave.functions.columns import named
from cutweave.functions.storage import materialise, scratch

#: How a turn is rendered, and the role of a turn without one.
OPEN, MIDDLE, CLOSE, NO_ROLE = "<|", "|>\n", "\n", "unknown"
#: Turn numbers of a chunk; the rendered text of a longer conversation comes in parts.
CHUNK = 1024


def _content(seed: int) -> Column:
    """A hash of role and text, nulls told apart from empty ones."""
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def _placed(place: Column, seed: int) -> Column:
    """The hash of a turn at a place of its conversation."""
    return F.xxhash64(F.lit(seed), F.col(f"c{seed}"), place)


def _rendered() -> Column:
    """``<|role|>``, a line end, the text and a line end; null texts are empty."""
    return F.concat(F.lit(OPEN), F.coalesce("role", F.lit(NO_ROLE)), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))


def collapse(turns: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """The maximal conversations: conv_id, n_turns, n_equal, part, text.

    ``n_equal`` counts the conversations with the same turns, of which the smallest conv_id is
    kept.  A conversation goes if its turns are the first turns of a longer one.  Turns are ordered by turn,
    nulls first, then role and text; repeated rows are turns of their own.  Null texts are rendered as empty ones,
    but differ from them.  A turn without conv_id belongs to no known conversation and is one of a single turn.

    ``text`` is the whole conversation where its turn numbers span less than ``chunk``; a longer one
    has a row for each range of ``chunk`` numbers with turns, ``part`` 0, 1, ..., whose texts strung together are the whole.
    So rows stay bounded unless a single turn is long or a turn number repeats.  Further columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    with scratch() as own:
        t = turns.select(*[named(c).alias(c) for c in ("conv_id", "turn", "role", "text")])
        hashed = [_content(s).alias(f"c{s}") for s in (1, 2)]
        number = F.coalesce(F.floor(F.col("turn") / chunk).cast("long"), F.lit(-(1 << 60)))
        w = Window.partitionBy("conv_id", "chunk").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
        rows = t.where("conv_id is not null").withColumn("chunk", number).withColumn("rank", F.row_number().over(w))
        rows = own.keep(materialise(rows.select("conv_id", "chunk", "rank", *hashed, _rendered().alias("rendered")), "chat-turns"))

        # Places: counts of the chunks before.  Rows of these windows are chunks, not turns.
        by_chunk = Window.partitionBy("conv_id").orderBy("chunk")
        before, all_ = by_chunk.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")
        chunks = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("k"))
        chunks = chunks.select("conv_id", "chunk", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"), F.sum("k").over(all_).alias("n"), (F.row_number().over(by_chunk) - 1).alias("part"))
        chunks = own.keep(materialise(chunks, "chat-chunks"))
        place = F.col("before") + F.col("rank")
        at = rows.select("conv_id", "chunk", "rank", "c1", "c2").join(chunks, ["conv_id", "chunk"])
        at = materialise(at.select("conv_id", "chunk", "rank", place.alias("place"), "n", *[_placed(place, s).alias(f"p{s}") for s in (1, 2)]), "chat-places")

        # Prefix hashes: running exclusive ors inside a chunk, and those of the chunks before.
        zero = F.lit(0).cast("long")
        sums = at.groupBy("conv_id", "chunk").agg(*[F.bit_xor(f"p{s}").alias(f"s{s}") for s in (1, 2)])
        sums = sums.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(f"s{s}").over(before), zero).alias(f"b{s}") for s in (1, 2)])
        inside = Window.partitionBy("conv_id", "chunk").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        prefix = at.select("conv_id", "chunk", "place", "n", *[F.bit_xor(f"p{s}").over(inside).alias(f"r{s}") for s in (1, 2)]).join(sums, ["conv_id", "chunk"])
        prefix = materialise(prefix.select("conv_id", "place", "n", *[F.col(f"r{s}").bitwiseXOR(F.col(f"b{s}")).alias(f"h{s}") for s in (1, 2)]), "chat-prefixes")

        key = ["place", "h1", "h2"]
        # A common first turn or conversation is combined before the shuffle, so both sides have unique keys.
        whole = prefix.where("place = n").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"), F.lit(None).cast("string").alias("rendered"))
        one = F.lit(1).cast("long")
        lone = t.where("conv_id is null").select(one.alias("place"), *hashed, _rendered().alias("rendered"))
        lone = lone.select("place", *[_placed(one, s).alias(f"h{s}") for s in (1, 2)], "rendered").groupBy(*key).agg(F.count("*").alias("n_equal"), F.min("rendered").alias("rendered"))
        lone = lone.select(*key, F.lit(None).cast(t.schema["conv_id"].dataType).alias("conv_id"), "n_equal", "rendered")
        whole = whole.unionAll(lone).groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.sum("n_equal").alias("n_equal"), F.max("rendered").alias("rendered"))
        proper = prefix.where("place < n").groupBy(*key).agg(F.lit(1).alias("one"))
        kept = own.keep(materialise(whole.join(proper, key, "left_anti").select("conv_id", F.col("place").alias("n_turns"), "n_equal", "rendered"), "chat-kept"))
    some = kept.where("conv_id is not null").drop("rendered")
    # The rendered turns of a part: at most some ``chunk`` of them.
    texts = rows.select("conv_id", "chunk", "rank", "rendered").join(some.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("rank", "rendered"))).alias("turns"))
    texts = texts.join(chunks.select("conv_id", "chunk", "part"), ["conv_id", "chunk"]).select("conv_id", "part", F.array_join(F.transform("turns", lambda x: x["rendered"]), "").alias("text"))
    out = some.join(texts, "conv_id").select("conv_id", "n_turns", "n_equal", "part", "text")
    return out.unionAll(kept.where("conv_id is null").select("conv_id", "n_turns", "n_equal", F.lit(0).alias("part"), F.col("rendered").alias("text")))
