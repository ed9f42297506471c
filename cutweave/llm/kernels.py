"""Array kernels that pair operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of one Arrow batch between the JVM and Python, at most (one row may be larger).
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after setting its session's Arrow batches to BATCH_BYTES unless they are smaller already.

    Batches bounded by rows alone hold gigabytes where texts are long.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = str(conf.get(key, str(1 << 30))).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


def hand_back() -> None:
    """Give freed memory back to the system: Python workers wait for later tasks beside others' memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def smallest_reached(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``ids`` the smallest one that the links left[k]-right[k] (positions in ``ids``) reach."""
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    label = rank.copy()
    by_rank = np.argsort(rank)
    while len(left):
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        # The label's own node follows, then labels are shortened.
        np.minimum.at(new, by_rank[label[left]], low)
        np.minimum.at(new, by_rank[label[right]], low)
        while True:
            short = new[by_rank[new]]
            if np.array_equal(short, new):
                break
            new = short
        if np.array_equal(new, label):
            break
        label = new
    return ids[by_rank[label]]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], most: int = 200_000) -> Iterator[pa.Table]:
    """Tables of whole runs of equal ``keys`` from sorted batches; a run is never cut.

    Rows are held until the last run of a batch is known to be over; small runs are handed on
    together.  A run's size must be bounded by what made the keys.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) < min(most, 2_000):
            continue
        table = pa.concat_tables(held).combine_chunks()
        start = last_run(table, keys)
        if start:
            yield table.slice(0, start)
        held = [table.slice(start)]
    if held and (table := pa.concat_tables(held).combine_chunks()).num_rows:
        yield table


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Positions at which a run of equal keys begins."""
    change = np.zeros(table.num_rows, bool)
    change[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def last_run(table: pa.Table, keys: list[str]) -> int:
    return int(starts(table, keys)[-1]) if table.num_rows else 0


def in_slices(size: Callable[[int], int], n: int, limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of 0..n whose sizes add up to about ``limit``; a single item may be larger."""
    at = total = 0
    for i in range(n):
        if i > at and total + size(i) > limit:
            yield at, i
            at, total = i, 0
        total += size(i)
    if n > at:
        yield at, n
