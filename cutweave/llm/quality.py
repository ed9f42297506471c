"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are grown in numpy on the driver from a bounded sample of labelled documents and
flattened into arrays; scoring walks all trees of a batch of documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutweave.functions.columns import named
from cutweave.llm.kernels import bounded_batches, hand_back

#: Labelled documents that a model is fitted on, at most (those with the smallest hashes of their ids).
SAMPLE = 20_000
#: Quantile bins of a statistic.
BINS = 64
NAMES = (
    "characters", "words", "word length", "spread of word length", "long words", "short words", "distinct words", "distinct word pairs", "most frequent word",
    "lines", "line length", "distinct lines", "lower case", "upper case", "digits", "other ASCII", "beyond ASCII", "symbols", "exclamation marks", "bars", "commas and stops",
    "words ending in a symbol", "upper-case words", "bullet lines", "lines without a stop",
)
_SYMBOLS = b"#$%&*+<=>@[\\]^_`{}~/"


def _classes() -> np.ndarray:
    """A class for each byte: 0 white space, 1 lower, 2 upper, 3 digit, 4 other ASCII, 5 beyond, 6 symbols, 7 '!', 8 '|', 9 ',.;:?'."""
    out = np.full(256, 5, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = 0 if b <= 32 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 6 if b in _SYMBOLS else 7 if c == "!" else 8 if c == "|" else 9 if c in ",.;:?" else 4
    out[0x80:0xC0] = 10  # bytes that go on with a character
    return out


CLASSES = _classes()


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text, in the order of NAMES; zeros for null and empty texts."""
    if not text:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    c = np.bincount(CLASSES[raw], minlength=11)
    chars = max(1, int(len(raw) - c[10]))
    shown = max(1, chars - int(c[0]))
    words = text.split()
    n = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(1, len(lines))
    ends = sum(not w[-1].isalnum() and w[-1] not in ".,;:?!'\")" for w in words)
    return [
        np.log1p(chars), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), float((lengths > 12).mean()), float((lengths <= 3).mean()),
        len(distinct) / n, len(set(zip(words, words[1:]))) / max(1, len(words) - 1), max(distinct.values(), default=0) / n,
        np.log1p(len(lines)), np.log1p(chars / m), len(set(lines)) / m,
        c[1] / shown, c[2] / shown, c[3] / shown, c[4] / shown, c[5] / shown, c[6] / shown, c[7] / shown, c[8] / shown, c[9] / shown,
        ends / n, sum(w.isupper() and len(w) > 1 for w in words) / n,
        sum(x.lstrip()[:1] in "-*•·#>|" for x in lines) / m, sum(x.rstrip()[-1] not in ".!?" for x in lines) / m,
    ]


@dataclass
class Forest:
    """Complete binary trees of one depth as arrays: row t holds tree t, node i has sons 2i+1 and 2i+2."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray  # x <= limit goes left; +inf where a node isn't split
    value: np.ndarray  # trees x leaves

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All trees of all rows at once: ``depth`` gathers over a rows x trees array of node numbers."""
        if not len(self.value):
            return np.full(len(x), self.base)
        tree, row = np.arange(len(self.value))[None, :], np.arange(len(x))[:, None]
        at = np.zeros((len(x), len(self.value)), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.limit[tree, at])
        return self.base + self.value[tree, at - (2**self.depth - 1)].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.15, l2: float = 1.0, least: float = 3.0) -> Forest:
    """Boosting with logistic loss on histograms of quantile bins.

    Without rows, or with one label only, the forest is empty and scores the smoothed prior
    (0.5 without rows).
    """
    n, features = x.shape
    inner = 2**depth - 1
    prior = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(prior / (1 - prior)))
    if not n or y.min() == y.max():
        return Forest(base, depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin = np.full(n, base)
    feature, limit, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain, at, cut = np.full(width, 1e-9), np.zeros(width, np.int64), np.full(width, np.inf)
            where = np.full(width, BINS)
            for f in range(features):
                cell = (node - first) * BINS + binned[:, f]
                gs = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hs = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                won = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                won[(hs < least) | (ht - hs < least)] = -np.inf
                won[:, len(edges[f]) :] = -np.inf
                best = won.argmax(axis=1)
                better = won[np.arange(width), best] > gain
                gain[better], at[better], where[better] = won[np.arange(width), best][better], f, best[better]
                cut[better] = edges[f][best[better]]
            feature[t, first : first + width], limit[t, first : first + width] = at, cut
            own = node - first
            node = 2 * node + 1 + (binned[np.arange(n), at[own]] > where[own])
        leaf = node - inner
        value[t] = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin += value[t][leaf]
    return Forest(base, depth, feature, limit, value)


def _measure(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t if isinstance(t, str) else None) for t in texts], float).reshape(len(texts), len(NAMES))


def train(documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Fit on the labelled documents; at most ``sample`` of them, by the hashes of their ids.

    Labels that are null or not 0 or 1 are left out; of several labels of one id the mean, rounded,
    counts.  Documents with null text are learnt from as empty ones; of several documents of one id one is learnt from,
    that of the least statistics.  Other columns are ignored; without documents or labels the forest is empty.
    """
    some = labels.where(named(label_col).isin(0, 1) & named(id_col).isNotNull()).groupBy(named(id_col).alias("id")).agg(F.round(F.avg(named(label_col))).cast("int").alias("y"))
    some = some.orderBy(F.xxhash64("id"), "id").limit(sample)
    # At most ``sample`` rows of two numbers: a proven bound for a broadcast.
    rows = documents.select(named(id_col).alias("id"), named(text_col).alias("text")).join(F.broadcast(some), "id")
    names = [f"f{i}" for i in range(len(NAMES))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame(np.column_stack([pdf["y"].to_numpy(float), _measure(pdf["text"])]), columns=["y", *names])
            out.insert(0, "id", pdf["id"].to_numpy())
            yield out

    kind = rows.schema["id"].dataType.simpleString()
    measured = bounded_batches(rows).select("id", "y", "text").mapInPandas(run, f"id {kind}, y double, " + ", ".join(f"{c} double" for c in names))
    # One row an id, so at most ``sample`` rows come to the driver.
    got = measured.groupBy("id").agg(F.min(F.struct("y", *names)).alias("m")).select("m.*").toPandas().to_numpy(float)
    got = got[np.lexsort(got.T[::-1])]  # the same order whatever the partitions
    return fit(got[:, 1:], got[:, 0])


def score_documents(documents: DataFrame, forest: Forest, *, text_col: str = "text", out: str = "score") -> DataFrame:
    """Adds ``score``: the probability of label 1, for empty and null texts too.

    A map over the text column; all other columns, whatever their names, nulls and repeated rows are carried along,
    a column named ``out`` is replaced.  Very long texts are measured whole; an empty table gives an empty result.
    """

    def run(texts: pd.Series) -> pd.Series:
        out = pd.Series(forest.score(_measure(texts)), dtype=float)
        hand_back()
        return out

    return bounded_batches(documents).withColumn(out, F.pandas_udf(run, T.DoubleType())(named(text_col)))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
