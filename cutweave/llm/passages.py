"""Substring dedup: removal of passages that stand in several places, by seeds and extension.

Every window of LENGTH words picks the least hash of its stretches of SEED words as its anchor, the leftmost of equal ones.
Windows of equal words pick the same stretch, so places that share a passage share an anchor.  A place of an anchor stands with
the consecutive windows that picked it, its segment: up to LENGTH - SEED words further to both sides.

1. Anchors are counted; those that occur twice are marked in a filter.
2. Segments of marked anchors meet by anchor and by a hash of the whole extension.  Equal ones repeat as a whole.
3. Where the segments of an anchor differ, they may repeat in part: there each way of extending the anchor to LENGTH words is compared,
   j words to the left and the rest to the right, by 128-bit hashes.  Of equal segments one stands for all.

Windows that repeat are joined to maximal passages.  Documents are known by a 128-bit hash of their text, so each pass may read
them anew: no row numbers are needed, and texts are shuffled once, to meet their passages.  No pairs of places are made.
The filters are of a fixed size; what they let through beyond the marked anchors costs time and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from cutweave.functions.columns import named, unused
from cutweave.functions.storage import materialise, scratch
from cutweave.llm.kernels import bounded_batches, hand_back, mixed
from cutweave.llm.language_model import hashes_of
from cutweave.llm.words import slices, split

#: Words of a passage at least, and of the stretches that anchors are chosen from.
LENGTH, SEED = 35, 8
#: Bits of a filter: 16 MB.
FILTER_BITS = 1 << 27
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SPANS = "array<struct<start:int,stop:int>>"


class Hashes:
    """Hashes of any stretch of a sequence of words: differences of running sums, modulo 2**64."""

    def __init__(self, words: np.ndarray, base: np.uint64):
        n = len(words)
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]), dtype=np.uint64)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers[:n], dtype=np.uint64)])
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(pow(int(base), -1, 1 << 64)))]), dtype=np.uint64)

    def of(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mixed((self.sums[start + length] - self.sums[start]) * self.back[start])


@dataclass
class Segments:
    """Anchors of some texts with the windows that picked them: text, first window's start in it and in all, further windows, hash."""

    text: np.ndarray
    start: np.ndarray
    at: np.ndarray
    more: np.ndarray
    lead: np.ndarray  # words from the first window's start to the anchor
    anchor: np.ndarray


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` values in a row the place of the least, the leftmost of equal ones."""
    place, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = place[:-step], place[step:]
        place = np.where(values[left] <= values[right], left, right)
        have += step
    return place


def segments(offsets: np.ndarray, hashes: Hashes, length: int = LENGTH, seed: int = SEED) -> Segments:
    n = int(offsets[-1])
    none = np.zeros(0, np.int64)
    if n < length:
        return Segments(none, none, none, none, none, none.astype(np.uint64))
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    grams = hashes.of(np.arange(n - seed + 1), seed)
    picked = leftmost_least(grams, length - seed + 1)
    windows = np.flatnonzero(own[: n - length + 1] == own[length - 1 :])  # those within one text
    picked = picked[windows]
    first = np.flatnonzero(np.concatenate([[True], picked[1:] != picked[:-1]])) if len(windows) else none
    at, anchor = windows[first], picked[first]
    more = np.diff(np.concatenate([first, [len(windows)]])) - 1
    return Segments(own[at], at - offsets[own[at]], at, more, anchor - at, grams[anchor])


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets, words, codes = split(texts)
    return offsets, hashes_of(words)[codes] if len(codes) else np.zeros(0, np.uint64)


def _through(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys a filter lets through."""
    at = (keys & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def filter_of(keys: DataFrame) -> np.ndarray:
    """A bit for each of ``keys(h)``, of FILTER_BITS: a filter of fixed size, however many keys there are."""
    place = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1
    pages = keys.select(F.bitmap_bucket_number(place).alias("page"), F.bitmap_bit_position(place).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in pages.collect():  # FILTER_BITS / 8 bytes at most
        part = np.frombuffer(row["bits"], np.uint8)
        at = (row["page"] - 1) * len(part)
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def _anchors(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in slices(batch.column(0)):
                offsets, words = _word_hashes(texts)
                yield pa.RecordBatch.from_arrays([pa.array(segments(offsets, Hashes(words, _BASES[0]), length, seed).anchor.view(np.int64))], ["h"])
        hand_back()

    return run


def _marked(shared, length: int, seed: int, windows: bool):
    """(k1, k2, text) -> segments (h, g, k1, k2, start, more, place) of marked anchors, or windows (w1, w2, k1, k2, start) of marked segments.

    h is of the anchor, g of the segment and how it lies about the anchor, place of g and where it stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in (0, 1)]
            for a, texts in slices(batch.column(2)):
                offsets, words = _word_hashes(texts)
                hashes, other = Hashes(words, _BASES[0]), Hashes(mixed(words ^ _BASES[1]), _BASES[1])
                s = segments(offsets, hashes, length, seed)
                lies = mixed(((s.lead << 32) + s.more).astype(np.uint64))
                kind = mixed(other.of(s.at, s.more + length) ^ lies)
                place = kind
                for part in (*(k[a + s.text].view(np.uint64) for k in keys), s.start.astype(np.uint64)):
                    place = mixed(place * _BASES[0] + part)
                some = np.flatnonzero(_through(bits, kind) | _through(bits, place) if windows else _through(bits, s.anchor))
                if not len(some):
                    continue
                text, start, at, more = s.text[some], s.start[some], s.at[some], s.more[some]
                if windows:
                    each = np.repeat(np.arange(len(some)), more + 1)
                    step = np.arange(len(each)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                    text, start, at = text[each], start[each] + step, at[each] + step
                    names, columns = ["w1", "w2"], [hashes.of(at, length), other.of(at, length)]
                else:
                    names, columns = ["h", "g"], [s.anchor[some], kind[some]]
                columns = [pa.array(c.view(np.int64)) for c in columns] + [pa.array(k[a + text]) for k in keys] + [pa.array(start.astype(np.int32))]
                if not windows:
                    columns += [pa.array(more.astype(np.int32)), pa.array(place[some].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, [*names, "k1", "k2", "start", *([] if windows else ["more", "place"])])
        hand_back()

    return run


def text_keys(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a text, from different seeds."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def repeated_spans(texts: DataFrame, *, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``texts(k1, k2, text)`` -> (k1, k2, spans): for each text with repeated windows what they cover, pieces in any order.

    A text that occurs twice repeats itself.
    """
    sc = texts.sparkSession.sparkContext
    counted = texts.select("text").mapInArrow(_anchors(length, seed), "h long").groupBy("h").agg(F.count("*").alias("n"))
    twice = filter_of(counted.where("n > 1"))
    found = texts.mapInArrow(_marked(sc.broadcast(twice), length, seed, False), "h long, g long, k1 long, k2 long, start int, more int, place long")
    found = materialise(found, "passage-segments")
    kinds = materialise(found.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("place").alias("place")), "passage-kinds")
    whole = found.join(kinds.where("n > 1").select("h", "g"), ["h", "g"]).select("k1", "k2", "start", (F.col("start") + F.col("more") + length).alias("stop")).distinct()
    several = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h")
    one = F.when(F.col("n") == 1, F.col("g")).otherwise(F.col("place"))
    differing = filter_of(kinds.join(several, "h", "left_semi").select(one.alias("h")))
    windows = texts.mapInArrow(_marked(sc.broadcast(differing), length, seed, True), "w1 long, w2 long, k1 long, k2 long, start int")
    windows = materialise(windows.distinct(), "passage-windows")
    same = windows.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    part = windows.join(same, ["w1", "w2"]).select("k1", "k2", "start", (F.col("start") + length).alias("stop"))
    return whole.unionAll(part).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def remove_repeats(documents: DataFrame, *, text_col: str = "text", length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """All rows and columns, with n_words, n_removed, ``repeats`` (start and stop of each maximal repeat, in words) and the ``kept`` text.

    Removed are all words of every ``length`` words in a row that stand anywhere else as well, in the same text or another,
    all places included; kept words are joined by one space.  Words are parted by ASCII white space and compared as they are.
    Null, empty and short texts keep all they have; a text of ``length`` words or more that two rows have goes as a whole; ids aren't
    looked at, so null and repeated ones make no difference; texts are read whole; further columns come through, where one has the
    name of a new column an error is raised; an empty table gives an empty result.
    """
    if not 1 <= seed <= length:
        raise ValueError("a seed has between one and ``length`` words")
    new = ["n_words", "n_removed", "repeats", "kept"]
    if unused(documents.columns, *new) != new:
        raise ValueError(f"one of {', '.join(new)} is a column already")
    k1, k2, spans = unused(documents.columns, "k1", "k2", "spans")
    text = F.coalesce(named(text_col), F.lit(""))
    names = documents.columns
    at, width = names.index(text_col), len(names)
    schema = StructType([*documents.schema, *DataType.fromDDL(f"n_words long, n_removed long, repeats {_SPANS}, kept string")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            n_words, removed, every, kept = [], [], [], []
            for value, found in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                words = (value or "").encode().split()
                gone = merged([(s["start"], s["stop"]) for s in found or ()])
                n_words.append(len(words))
                removed.append(sum(b - a for a, b in gone))
                every.append([{"start": a, "stop": b} for a, b in gone])
                edges = [0, *(x for span in gone for x in span), len(words)]
                kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]).decode())
            columns = [pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(every, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], [*names, *new])
        hand_back()

    with scratch() as own:
        keyed = bounded_batches(documents).select("*", *[k.alias(n) for k, n in zip(text_keys(text), (k1, k2))])
        found = repeated_spans(keyed.select(named(k1).alias("k1"), named(k2).alias("k2"), text.alias("text")), length=length, seed=seed)
        found = own.keep(materialise(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans)), "passages"))
    return keyed.join(found, [k1, k2], "left").drop(k1, k2).mapInArrow(cut, schema)
