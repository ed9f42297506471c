"""Periodic run detection: stretches of a text in which the same few words come again and again.

Each word gets a number, and each bit of the numbers is a big integer with one bit a word.  For a lag q the integers are
XORed with themselves shifted by q; where all differences are 0, words q apart are equal.  Stretches of sufficiently many
such places are isolated by ANDs with shifts that double.  A lag is given up as soon as the planes seen so far
leave no stretch.

Long texts would need time with the square of their length.  There a stretch of 2q equal places, which every run has, must
hold one of the blocks [jq, (j + 1)q) whole, so lags of which no block begins like the next are left out, and so
are blocks that a run of a period dividing q explains: what they belong to has that period, too.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from cutweave.functions.columns import named, unused
from cutweave.llm.kernels import bounded_batches, hand_back

#: A run has at least this many words, and its period this many times.
LEAST_WORDS, LEAST_REPEATS = 24, 3
#: Words of a text from which on lags are looked over block by block before their bits are.
LONG = 16_384
#: Words at the start of a block that are compared then.
HEAD = 8
WORD = r"[^\x20\x09-\x0D]+"
_RUNS = "array<struct<start:long,length:long,period:long>>"


def _planes(ids: np.ndarray) -> list[int]:
    """One integer for each bit of the numbers; word i's is bit i."""
    return [int.from_bytes(np.packbits((ids >> k) & 1, bitorder="little").tobytes(), "little") for k in range(int(ids.max(initial=0)).bit_length())]


def _ones(x: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(x.to_bytes(-(-x.bit_length() // 8), "little"), np.uint8), bitorder="little"))


def _long_ones(x: int, need: int) -> int:
    """Bits at which ``need`` ones of ``x`` in a row begin."""
    have = 1
    while have < need and x:
        step = min(have, need - have)
        x &= x >> step
        have += step
    return x


class _Known:
    """Runs found so far, by period, for lags that they explain."""

    def __init__(self) -> None:
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, list[int]] = {}

    def add(self, start: int, length: int, period: int) -> None:
        self.starts.setdefault(period, []).append(start)
        self.ends.setdefault(period, []).append(start + length)

    def explains(self, a: int, b: int, q: int) -> bool:
        """Whether a run of a period dividing ``q`` holds words a to b."""
        for period, starts in self.starts.items():
            if q % period == 0:
                k = bisect.bisect_right(starts, a) - 1  # runs of one period are in rising order of starts and ends
                if k >= 0 and self.ends[period][k] >= b:
                    return True
        return False


def runs(words: list, least_words: int = LEAST_WORDS, repeats: int = LEAST_REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start and period; ``repeats`` is 3 or more."""
    n, number = len(words), {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if n < least_words:
        return []
    planes, whole, known, seen, out = _planes(ids), (1 << n) - 1, _Known(), set(), []
    for q in range(1, n // repeats + 1):
        need = max(least_words - q, (repeats - 1) * q)
        if n >= LONG and q >= HEAD and not _some_block(ids, q, known):
            continue
        equal = whole >> q
        for k, plane in enumerate(planes):
            equal &= ~(plane ^ (plane >> q))
            if k in (0, 3, 7) and not _long_ones(equal, min(need, 24)):
                equal = 0
                break
        at = _long_ones(equal, need)
        if not at:
            continue
        bits = _ones(at)
        cut = np.flatnonzero(np.diff(bits) > 1)
        for start, last in zip(bits[np.concatenate([[0], cut + 1])].tolist(), bits[np.concatenate([cut, [len(bits) - 1]])].tolist()):
            length = last - start + need + q
            # The same stretch was found at a shorter lag, if its smallest period is shorter: that one divides q.
            if (start, length) not in seen:
                seen.add((start, length))
                known.add(start, length, q)
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def _some_block(ids: np.ndarray, q: int, known: _Known) -> bool:
    """Whether a block of ``q`` words begins like the next and no known run explains it."""
    rows = len(ids) // q
    heads = ids[: rows * q].reshape(rows, q)[:, :HEAD]
    for j in np.flatnonzero((heads[1:] == heads[:-1]).all(axis=1)).tolist():
        if not known.explains(j * q, (j + 2) * q, q):
            return True
    return False


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that stay: of each run the first ``period`` words, but for those that another run drops."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()] if found else words


def periodic_runs(documents: DataFrame, *, text_col: str = "text", least_words: int = LEAST_WORDS, repeats: int = LEAST_REPEATS, runs_col: str = "runs", collapsed_col: str = "collapsed") -> DataFrame:
    """All rows and columns, with ``runs`` (start, length, period of each, in words) and the ``collapsed`` text.

    A run is a stretch of consecutive words of smallest period q, of ``repeats`` periods and ``least_words`` words at least,
    that neither neighbour extends.  Words are parted by ASCII white space.  Null, empty and blank texts have no runs and collapse to
    an empty text; every row is worked on by itself, equal ones and null ids too; texts are read whole, whatever their length;
    where the names of the new columns are taken an error is raised; an empty table gives an empty result.
    """
    if repeats < 3:
        raise ValueError("runs of fewer than three periods aren't sought")
    names = documents.columns
    if unused(names, runs_col, collapsed_col) != [runs_col, collapsed_col]:
        raise ValueError(f"{runs_col} or {collapsed_col} is a column already")
    schema = StructType([*documents.schema, StructField(runs_col, DataType.fromDDL(_RUNS)), StructField(collapsed_col, StringType())])
    at = names.index(text_col)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            every, left = [], []
            for text in batch.column(at).to_pylist():
                words = (text or "").encode().split()
                every.append(own := runs(words, least_words, repeats))
                left.append(b" ".join(collapsed(words, own)).decode())
            lists = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in every], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(left, pa.string())], [*names, runs_col, collapsed_col])
        hand_back()

    return bounded_batches(documents).mapInArrow(found, schema)


def with_tandem(text: Column, doc_id: Column) -> Column:
    """``text`` whose end repeats itself, in the tenth of the documents that crc32 of the id picks; a null id counts as the empty text."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.call_function("div", n - a, 3 + F.pmod(g, F.lit(8)))
        source = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        return F.array_join(F.transform(words, lambda w, i: F.get(words, source(i.cast("long")).cast("int"))), " ")

    words = F.when((h % 10 == 0) & text.rlike(WORD), F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    # An array of one, so that the words are made once a row.
    made = F.transform(F.array(words), lambda w: F.when(w.isNotNull(), repeated(w)))
    return F.coalesce(made[0], text)


def digests(found: DataFrame) -> DataFrame:
    """``found(doc_id, runs, collapsed)`` -> the number of runs, the one with the most repeats, and digests of all and of the text that is left."""
    # Repeats are compared by cross products: whole numbers, exactly.
    more = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"])
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda best, r: F.when(more(r, best), r).otherwise(best))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.call_function("div", 1000 * F.col("best.length"), F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
