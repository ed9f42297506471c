"""Document fingerprints: a canonical exact digest.

Texts are brought to one form (Unicode normalisation, case folding, white space folding) and hashed
with 128 bits of xxhash.  Rows with equal hashes are a bucket; within each bucket of several rows
the canonical bytes are compared, and where they differ the fingerprints get told apart.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutweave.functions.columns import named, unused
from cutweave.functions.storage import materialise, scratch

#: Rows of repeated hashes that may be broadcast (some 16 bytes each); beyond, a shuffled join.
BROADCAST_ROWS = 500_000
#: Ranges of ids: about the square of this many.  Bounds are held as literals, in two levels.
LEVEL = 32
#: Rows of a chunk of ids, about, and chunks at most: beyond, chunks grow.  Each chunk's first row is broadcast.
CHUNK_ROWS, CHUNKS = 2_000, 500_000


def canonical(text: Column) -> Column:
    """Compatibility composition, full case folding, composition again, white space runs to one space, ends trimmed.

    Null is the empty text.
    """
    compose = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    folded = compose(fold(compose(F.coalesce(text, F.lit("")))))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\x85]+", " "))


def wide_hash(text: Column) -> Column:
    """128 bits of xxhash in hex: two passes with different seeds."""
    each = [F.lpad(F.hex(F.xxhash64(F.lit(seed), text)), 16, "0") for seed in (1, 2)]
    return F.lower(F.concat(*each))


def collided(hashed: DataFrame) -> DataFrame:
    """Of ``hashed(h, canon)``: the hashes whose buckets hold different bytes, as ``h``.

    Hashes of several rows are found by counting hashes alone.  Only rows in those buckets have
    their bytes compared: the least and the greatest of a bucket differ unless all are equal, and
    both are combined before the shuffle, so a bucket of a third of all rows is no burden.
    """
    repeated = materialise(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "fingerprint-repeated")
    small = repeated.count() <= BROADCAST_ROWS
    rows = hashed.join(F.broadcast(repeated) if small else repeated, "h", "left_semi")
    return different(rows)


def different(rows: DataFrame) -> DataFrame:
    """The hashes of ``rows(h, canon)`` under which the bytes differ."""
    return rows.groupBy("h").agg(F.min("canon").alias("least"), F.max("canon").alias("most")).where("least <> most").select("h")


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``fingerprint`` to the documents: equal exactly where the canonical texts are equal.

    Null texts count as empty and very long ones are read whole; nulls elsewhere, repeated rows and further columns,
    whatever their names, are carried along; an existing column ``fingerprint`` is replaced; an empty table gives an
    empty result.
    """
    keep = [named(c) for c in documents.columns if c.lower() != "fingerprint"]
    canon, h = unused(documents.columns, "canon", "h")
    df = documents.select(*keep, canonical(named(text_col)).alias(canon)).withColumn(h, wide_hash(F.col(canon)))
    with scratch() as own:
        bad = own.keep(materialise(collided(df.select(F.col(h).alias("h"), F.col(canon).alias("canon"))), "fingerprint-collided"))
    return told_apart(df, bad, h, canon).select(*keep, F.col(h).alias("fingerprint"))


def told_apart(df: DataFrame, bad: DataFrame, h: str, canon: str) -> DataFrame:
    """Appends a SHA-256 to the hashes ``h`` of rows in buckets ``bad``; commonly there are none."""
    if not bad.take(1):
        return df
    (mark,) = unused(df.columns, "bad")
    df = df.join(bad.select(F.col("h").alias(mark)), F.col(h) == F.col(mark), "left")
    return df.withColumn(h, F.when(F.col(mark).isNull(), F.col(h)).otherwise(F.concat(F.col(h), F.lit("-"), F.sha2(F.col(canon).cast("binary"), 256)))).drop(mark)


def range_number(value: Column, bounds: list[int]) -> Column:
    """How many of the bounds are below ``value``; -1 for null.  Two short searches instead of a long one."""
    below = lambda xs: F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in xs]), lambda b: b < value)) if xs else F.lit(0)
    blocks = [bounds[i : i + LEVEL] for i in range(0, len(bounds), LEVEL)]
    coarse = below([b[-1] for b in blocks])
    out = F.lit(len(bounds))
    if blocks:
        fine = F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in b]) for b in blocks]), F.least(coarse + 1, F.lit(len(blocks))))
        out = F.when(coarse >= len(blocks), len(bounds)).otherwise(coarse * LEVEL + F.size(F.filter(fine, lambda b: b < value)))
    return F.when(value.isNull(), -1).otherwise(out).cast("int")


def id_ranges(ids: DataFrame, order: str) -> tuple[Column, dict[int, tuple[int, int, int]]]:
    """The number of a row's range, and for each range its (rows, least id, greatest id).

    Ranges are cut evenly where they hold too much of the rows, and counted again, until all are about equal or hold a
    single id: twice for ids without gaps, some times more for others.  Only counts leave the workers: at most
    3 * LEVEL**2 of them.  Null ids are range -1.
    """
    value, bounds = named(order), []
    for left in range(8, -1, -1):
        number = range_number(value, bounds)
        found = {r["n"]: (r["k"], r["low"], r["high"]) for r in ids.select(number.alias("n"), value.alias("v")).groupBy("n").agg(F.count("*").alias("k"), F.min("v").alias("low"), F.max("v").alias("high")).collect()}
        share = max(1, math.ceil(sum(k for k, _, _ in found.values()) / LEVEL**2))
        if not left or not any(k > 4 * share and low < high for n, (k, low, high) in found.items() if n >= 0):
            return number, found
        ends, held = [], share
        for n in sorted(n for n in found if n >= 0):
            k, low, high = found[n]
            pieces = min(math.ceil(k / share), high - low + 1) if k > 2 * share else 1
            if pieces == 1 and held + k <= share:
                ends[-1], held = high, held + k
                continue
            ends += [low + (high - low) * i // pieces for i in range(1, pieces + 1)]
            held = k if pieces == 1 else share
        bounds = sorted(set(ends))[:-1]


def chunks(documents: DataFrame, order: str, tie: Column, rows: int = CHUNK_ROWS) -> tuple[Column, Column]:
    """(range, part): together a chunk of the rows in descending order of id, then ``tie``, of about ``rows`` rows.

    Bounds of ranges are held as literals.  Each range is cut into as many parts as its number of rows asks for: evenly
    between its ids, or, where it is a single id or the null ids, by ``tie``, a hash.  So chunks don't grow with the
    input, nor with an id that repeats.
    """
    value = named(order)
    number, found = id_ranges(documents, order)
    rows = max(rows, sum(k for k, _, _ in found.values()) // CHUNKS)
    table = {n: (math.ceil(k / rows), low or 0, high or 0) for n, (k, low, high) in found.items()}
    if max((p for p, _, _ in table.values()), default=1) <= 1:
        return number, F.lit(0).cast("int")
    at = lambda k: F.element_at(F.array(*[F.lit(table.get(n, (1, 0, 0))[k]).cast("long") for n in range(-1, max(table) + 1)]), number + 2)
    parts, low, high = at(0), at(1), at(2)
    # Parts count upwards with the id; a hash counts downwards, as greater hashes come later.
    even = F.floor((value - low) / (high - low + 1).cast("double") * parts)
    by_hash = parts - 1 - F.floor((tie.cast("double") / F.lit(2.0**64) + 0.5) * parts)
    share = F.when(value.isNull() | (low == high), by_hash).otherwise(even)
    return number, F.greatest(F.lit(0), F.least(parts - 1, share)).cast("int")


def with_next(documents: DataFrame, columns: list[str], order: str, *, rows: int = CHUNK_ROWS, between: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds ``next_<c>`` for each of ``columns``: that of the next row in descending ``order``.

    After the last row comes the first.  Null ids come last; equal ids are ordered by a hash of ``columns``.
    Rows are dealt out by chunks of ids; the first row of each chunk also goes to the chunk before it,
    and a window runs over each chunk: one shuffle of the rows, and no task sees more than some chunks.
    ``between`` adds columns to the dealt rows, and what it adds has a next one as well.
    """
    value, tie = named(order), F.xxhash64(*[named(c) for c in columns])
    number, part = chunks(documents, order, tie, rows)
    row, range_, part_, tie_, late, head, to = "row", "range", "part", "tie", "late", "head", "to"
    df = documents.select(F.struct(*[named(c) for c in documents.columns]).alias(row), value.alias("v"), number.alias(range_), part.alias(part_), tie.alias(tie_))
    # One row per chunk: a chunk's head is sent to the chunk before it, the first head to the last chunk.
    first = F.max(F.struct(F.col("v"), F.bitwise_not(F.col(tie_)).alias("back")))
    heads = materialise(df.groupBy(range_, part_).agg(first.alias(head)), "fingerprint-heads")
    down = Window.orderBy(F.desc(range_), F.desc(part_))  # at most CHUNKS rows and one for each range
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag(F.struct(range_, part_)).over(down), F.last(F.struct(range_, part_)).over(whole))
    sent = materialise(heads.select(F.col(head)["v"].alias("head_v"), F.bitwise_not(F.col(head)["back"]).alias("head_tie"), before.alias(to)), "fingerprint-sent")
    df = df.join(F.broadcast(sent), F.col("v").eqNullSafe(F.col("head_v")) & (F.col(tie_) == F.col("head_tie")), "left")
    places = F.array_compact(F.array(F.struct(F.col(range_), F.col(part_), F.lit(0).alias(late)), F.when(F.col(to).isNotNull(), F.struct(F.col(to)[range_].alias(range_), F.col(to)[part_].alias(part_), F.lit(1).alias(late)))))
    df = df.select(row, "v", tie_, F.explode(places).alias("place")).select(row, "v", tie_, f"place.{range_}", f"place.{part_}", f"place.{late}")
    dealt = df.repartition(range_, part_)
    own = ["v", tie_, range_, part_, late]
    # Work on the dealt rows comes after the exchange, which so carries each row as it was.
    after = between(dealt.select(f"{row}.*", *[F.col(c).alias(f"__{c}") for c in own]))
    added = [c for c in after.columns if c not in documents.columns and c not in {f"__{x}" for x in own}]
    w = Window.partitionBy(f"__{range_}", f"__{part_}").orderBy(f"__{late}", F.col("__v").desc_nulls_last(), f"__{tie_}")
    after = after.select("*", *[F.lead(named(c)).over(w).alias(f"next_{c}") for c in (*columns, *added)])
    return after.where(f"__{late} = 0").select(*[named(c) for c in (*documents.columns, *added)], *[named(f"next_{c}") for c in (*columns, *added)])


def compare_edited(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form and of the next document, with their likeness.

    The next document is that of descending id; after the last comes the first.  The edited text
    has the last floor(n/2) code points replaced by as many first ones of the next text (or all
    of it).  Likeness of an exact digest is 1 for equal canonical bytes and else 0.  Null texts
    count as empty, null ids come last, equal ids are ordered by their texts' hashes, so repeated rows follow each
    other; texts are taken whole, whatever their length; other columns are ignored; an
    empty table gives an empty result.

    Each text is brought to its canonical form once, after the only shuffle of texts, and so is each edited text.
    """
    with scratch() as own:
        docs = documents.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
        rows = with_next(docs, ["text"], "doc_id", between=lambda df: df.withColumn("canon", canonical(F.col("text"))))
        n = F.char_length("text")
        half = F.floor(n / 2).cast("int")
        edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
        rows = rows.withColumn("edited", edited).withColumn("edited_canon", canonical(F.col("edited")))
        one = lambda same: F.when(same, 1.0).otherwise(0.0)
        rows = rows.select(
            "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), wide_hash(F.col("canon")).alias("fingerprint"), wide_hash(F.col("edited_canon")).alias("edited_fingerprint"),
            one(F.col("edited_canon") == F.col("canon")).alias("near_edited"), one(F.col("next_canon") == F.col("canon")).alias("near_next"),
            "canon", "edited_canon",
        )
        out = own.keep(materialise(rows.drop("canon", "edited_canon"), "fingerprint-rows"))
        # Bytes are compared inside buckets of several rows: only the texts of those are fetched again.
        repeated = materialise(out.groupBy(F.col("fingerprint").alias("h")).agg(F.count("*").alias("k")).where("k > 1").select("h"), "fingerprint-repeated")
        ids = materialise(out.join(repeated, out["fingerprint"] == repeated["h"], "left_semi").select("doc_id").distinct(), "fingerprint-ids")
        small = ids.count() <= BROADCAST_ROWS
        again = docs.join((F.broadcast(ids) if small else ids).select(F.col("doc_id").alias("d")), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
        again = again.select(canonical(F.col("text")).alias("canon")).select(wide_hash(F.col("canon")).alias("h"), "canon").join(repeated, "h", "left_semi")
        bad = materialise(different(again), "fingerprint-collided")
        if bad.take(1):
            rows = told_apart(told_apart(rows, bad, "fingerprint", "canon"), bad, "edited_fingerprint", "edited_canon")
            out = own.keep(materialise(rows.drop("canon", "edited_canon"), "fingerprint-rows"))
    return out
