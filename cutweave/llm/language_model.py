"""LM scoring: a gated recurrent language model with a class-factored output softmax.

The probability of a token is that of its class, by a softmax over the state of a gated recurrent
unit, times that of its member of the class, by a softmax over the same state.  Members are the end of a document, the
most frequent words, and buckets of the other words by their last letters, so that unseen words have a
member as well.  As words are without bound and members are not, a word's share of its bucket comes from smoothed
counts over the whole training corpus.

Training: word counts are a distributed aggregation over all training documents.  These are turned into members
(two bytes a token) and dealt by a hash of their rows into shards and rounds.  A starting unit is learnt on a
few documents; in every round each shard learns on its own documents by backpropagation through
windows of WINDOW tokens, in the order of the hashes, and the shards' weights are averaged, weighted by tokens.  All
documents are learnt from once, and as shards don't follow partitions, weights don't depend on the layout.  Scoring
carries the state from window to window through a whole document; its matrix products are exact sums, so that
a document's score doesn't depend on its neighbours.  Only the sums over rare words, made by Spark, may differ by the
rounding of doubles.
Words too rare for the broadcast table (whose size is bounded) get their counts by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutweave.functions.columns import named
from cutweave.functions.storage import materialise, scratch
from cutweave.llm.kernels import bounded_batches, hand_back, in_slices, mixed

#: Classes and members of each.  Member 0 is the end of a document; then come the most frequent words, then buckets by ending.
CLASSES, SIZE = 32, 64
MEMBERS = CLASSES * SIZE
END, BUCKETS, ENDING = 0, 512, 3
LISTED = MEMBERS - BUCKETS - 1
FIRST_BUCKET = MEMBERS - BUCKETS
HIDDEN, WINDOW, LANES = 16, 16, 512
#: Rows of class scores that are held at once, so that they stay in a core's cache, and states whose softmaxes are worked out together.
ROWS, STATES = 4_096, 32_768
#: Documents that are scored abreast: their states stay in a core's cache.
ABREAST = 1_024
#: Scoring rounds states and weights to multiples of these; weights are kept within 16.  See ``_product``.
STATE_UNIT, WEIGHT_UNIT = 2.0**-24, 2.0**-20
#: Training cuts documents into stretches of this many tokens, each from the zero state; all are learnt from.
STRETCH = 1024
#: Tokens that are learnt from together, and tokens of a shard until there are SHARDS of them; then shards grow.
GROUP, SHARD_TOKENS, SHARDS = 524_288, 1_500_000, 65_536
#: Shards whose weights are summed by one task before the sums are.
SUMMED = 256
#: Ranges of counts that are counted at once when the least count of the broadcast words is sought.
RANGES = 1_024
#: Times that the shards' weights are averaged.
ROUNDS = 3
#: Pieces in which weights are averaged.
PIECES = 32
#: Words with counts that are broadcast, at most: 12 bytes each.
HEAD = 1_000_000
#: Documents of which one stretch each is what the starting weights are learnt from.
START = 256
#: Bytes of text whose words are held at once, and tokens whose documents are scored side by side.
SLICE, SIDE_BY_SIDE = 4 << 20, 3_000_000
ASCII_SPACE = b" \t\n\v\f\r"


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Offsets of the texts' words, the distinct words, and each word's position among those.

    A-Z are lower-cased; words are runs of characters other than ASCII white space.
    """
    # Lower-cased as bytes, so only A-Z change; Arrow's own kernel gives wrong offsets for sliced arrays.
    texts = pa.array([(t or "").encode().lower().strip(ASCII_SPACE).decode() for t in texts.to_pylist()], pa.large_string())
    words = pc.ascii_split_whitespace(texts)
    offsets = words.offsets.to_numpy()
    coded = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, offsets = coded.indices.to_numpy(), offsets - offsets[0]
    blank = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
    if blank.any():  # an empty text is split into one empty word
        keep = np.ones(len(codes), bool)
        keep[offsets[:-1][blank]] = False
        codes = codes[keep]
        offsets = np.concatenate([[0], np.cumsum(np.where(blank, 0, np.diff(offsets)))])
    return offsets, coded.dictionary, codes


_TABLE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def hashes_of(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: a sum of a random number per byte times a power per place, mixed with the length."""
    words = words.cast(pa.large_string())
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    length = np.diff(offsets)
    starts = offsets[:-1] - offsets[0]
    place = np.arange(len(raw)) - np.repeat(starts, length)
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max(initial=0)), _BASE)]), dtype=np.uint64)
    out = np.zeros(len(words), np.uint64)
    some = length > 0
    if some.any():
        out[some] = np.add.reduceat(_TABLE[raw] * powers[place], starts[some])
    return mixed(out + length.astype(np.uint64) * _BASE)


def ending_buckets(words: pa.Array) -> np.ndarray:
    """The member by the last letters of each word."""
    if not len(words):
        return np.zeros(0, np.int64)
    ends = pc.utf8_slice_codeunits(words, -ENDING, 2**31 - 1).dictionary_encode()
    of = np.array([FIRST_BUCKET + xxhash.xxh32_intdigest(e) % BUCKETS for e in ends.dictionary.to_pylist()], np.int64)
    return of[ends.indices.to_numpy()]


@dataclass
class Lexicon:
    """What scoring needs of the corpus: totals, the buckets' totals and the frequent words' counts."""

    tokens: int  # with one end per training document
    types: int  # distinct tokens, the end among them
    ends: int  # training documents
    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    listed: np.ndarray  # sorted hashes of the words that are members
    members: np.ndarray  # their members
    member_tokens: np.ndarray
    member_types: np.ndarray
    cutoff: int  # words seen less often aren't in ``words``

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 where not in the table) and member of each word."""
        h = hashes_of(words)
        members = ending_buckets(words)
        if not len(self.words):
            return np.zeros(len(h), np.int64), members
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        counts = np.where(self.words[at] == h, self.counts[at], 0).astype(np.int64)
        at = np.minimum(np.searchsorted(self.listed, h), len(self.listed) - 1)
        return counts, np.where(self.listed[at] == h, self.members[at], members)

    def floors(self) -> np.ndarray:
        """log10 of what counts of each member's words are divided by; 0 for members of one word."""
        out = np.log10(self.member_tokens + self.member_types + 1.0)
        out[:FIRST_BUCKET] = 0.0
        return out

    def within(self, members: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of the probability of a word within its member; 0 for members of one word."""
        return np.where(members >= FIRST_BUCKET, np.log10(counts + 1.0), 0.0) - self.floors()[members]


def _by_class(y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(class, rows whose member is of it), for the classes that occur."""
    of = (y // SIZE).astype(np.uint8)
    order = np.argsort(of, kind="stable")
    edge = np.searchsorted(of[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        if edge[c] < edge[c + 1]:
            yield c, order[edge[c] : edge[c + 1]]


class Gru:
    """A gated recurrent unit over members: X input table, U recurrence, O, b the classes' and M, m the members' output."""

    SHAPES = (("X", (MEMBERS, 3 * HIDDEN)), ("U", (HIDDEN, 3 * HIDDEN)), ("O", (HIDDEN, CLASSES)), ("b", (CLASSES,)), ("M", (CLASSES, HIDDEN, SIZE)), ("m", (CLASSES, SIZE)))

    def __init__(self, flat: np.ndarray):
        self.flat = np.asarray(flat, np.float32).copy()
        self.view(self.flat)

    def view(self, flat: np.ndarray) -> "Gru":
        at = 0
        for name, shape in self.SHAPES:
            n = math.prod(shape)
            setattr(self, name, flat[at : at + n].reshape(shape))
            at += n
        return self

    @classmethod
    def fresh(cls, seed: int = 0, member_tokens: np.ndarray | None = None) -> "Gru":
        """Random weights; biases that give each class and member its share of the corpus."""
        rng = np.random.default_rng(seed)
        out = cls(np.concatenate([rng.standard_normal(math.prod(s)) * (0.0 if n in "bm" else 0.1 if n in "OM" else 0.25) for n, s in cls.SHAPES]))
        if member_tokens is not None:
            each = (member_tokens + 0.5).reshape(CLASSES, SIZE)
            out.b[:] = np.log(each.sum(axis=1)) - np.log(each.sum())
            out.m[:] = np.log(each) - np.log(each.sum(axis=1, keepdims=True))
        return out

    def fixed(self) -> "Gru":
        """The same unit for scoring: what it multiplies states by gives exact products."""
        out = Gru(self.flat)
        out.U, out.O, out.M = _fixed(out.U), _fixed(out.O), _fixed(out.M)
        return out

    def step(self, s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The state after member ``y``, with what backpropagation needs; as arrays of their own, since columns of wider ones are slow to work on."""
        a = _product(s, self.U)
        after, gates, n = self.onward(s, a, y)
        return after, gates[:, :HIDDEN].copy(), gates[:, HIDDEN:].copy(), n, a[:, 2 * HIDDEN :].copy()

    def onward(self, s: np.ndarray, a: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The state after member ``y``, the gates and the new part, with the product ``a`` of the state and U."""
        x = self.X[y]
        gates = a[:, : 2 * HIDDEN] + x[:, : 2 * HIDDEN]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.divide(1, gates, out=gates)
        n = gates[:, HIDDEN:] * a[:, 2 * HIDDEN :]
        n += x[:, 2 * HIDDEN :]
        np.tanh(n, out=n)
        after = s - n
        after *= gates[:, :HIDDEN]
        after += n
        return after, gates, n

    def log_probabilities(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the members' probabilities: class, then member within the class."""
        out, of = np.empty(len(y)), y // SIZE
        for a in range(0, len(y), ROWS):
            out[a : a + ROWS] = _log_softmax(states[a : a + ROWS], self.O, self.b, of[a : a + ROWS])
        for c, rows in _by_class(y):
            for a in range(0, len(rows), ROWS):
                some = rows[a : a + ROWS]
                out[some] += _log_softmax(states[some], self.M[c], self.m[c], y[some] % SIZE)
        return out

    def score(self, documents: list[np.ndarray]) -> np.ndarray:
        """log10 of the members' probability of each document, its state carried through all windows."""
        order = sorted(range(len(documents)), key=lambda i: -len(documents[i]))
        unit, out = self.fixed(), np.empty(len(order))
        for a in range(0, len(order), ABREAST):
            some = order[a : a + ABREAST]
            out[some] = unit.score_abreast([documents[i] for i in some])
        return out / math.log(10)

    def score_abreast(self, documents: list[np.ndarray]) -> np.ndarray:
        """Natural logs of documents' probabilities, a step of all of them at a time; the longest come first."""
        lengths = np.array([len(d) for d in documents], np.int64)
        total = np.zeros(len(documents))
        flat, base = np.concatenate(documents), np.concatenate([[0], np.cumsum(lengths)[:-1]])
        s = np.zeros((len(documents), HIDDEN), np.float32)
        states, tokens, rows = [], [], 0
        for t in range(int(lengths[0])):
            active = int(np.searchsorted(-lengths, -t))  # documents with a token at t
            s = s[:active]
            y = flat[base[:active] + t].astype(np.int64)
            exact = _rounded(s)  # once for all three products
            states.append(exact)
            tokens.append(y)
            rows += active
            if rows >= STATES or t + 1 == lengths[0]:
                logs, at = self.log_probabilities(np.concatenate(states), np.concatenate(tokens)), 0
                for y_ in tokens:
                    total[: len(y_)] += logs[at : at + len(y_)]
                    at += len(y_)
                states, tokens, rows = [], [], 0
            s = self.onward(s, _exact_product(exact, self.U), y)[0]
        return total


def _fixed(weights: np.ndarray) -> np.ndarray:
    """Weights as multiples of WEIGHT_UNIT within 16, for exact products."""
    return np.clip(np.rint(weights.astype(float) / WEIGHT_UNIT) * WEIGHT_UNIT, -16, 16)


def _product(states: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """``states @ weights``; with weights from ``_fixed`` the exact sums of states rounded to STATE_UNIT, as float32.

    A library rounds the sums of one row differently at another place or in a table of another size.  Here states are within 1
    and each sum has 16 addends, so all are multiples of 2**-44 below 2**9: double precision holds them exactly, in any order.
    """
    if weights.dtype == np.float32:
        return states @ weights
    return _exact_product(states if states.dtype == np.float64 else _rounded(states), weights)


def _rounded(states: np.ndarray) -> np.ndarray:
    """States as doubles, rounded to STATE_UNIT."""
    out = (states / np.float32(STATE_UNIT)).astype(float)
    np.rint(out, out=out)
    out *= STATE_UNIT
    return out


def _exact_product(rounded: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return (rounded @ weights).astype(np.float32)


def _scores(states: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Scores before the softmax; kept within 60, so that sums of their exponentials fit into float32."""
    e = _product(states, weights)
    e += bias
    return np.clip(e, -60, 60, out=e)


def _log_softmax(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, own: np.ndarray) -> np.ndarray:
    e = _scores(states, weights, bias)
    mine = e[np.arange(len(e)), own].astype(float)
    np.exp(e, out=e)
    return mine - np.log(e.sum(axis=1))


def _softmax_slope(states: np.ndarray, weights: np.ndarray, bias: np.ndarray, own: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Derivative of the weighted loss by the scores."""
    p = _scores(states, weights, bias)
    np.exp(p, out=p)
    p *= (weight / (p @ np.ones(p.shape[1], np.float32)))[:, None]
    p[np.arange(len(p)), own] -= weight
    return p


class Trainer:
    """Adam over windows of truncated backpropagation."""

    def __init__(self, gru: Gru, rate: float):
        self.gru, self.rate, self.n = gru, rate, 0
        self.m, self.v = np.zeros_like(gru.flat), np.zeros_like(gru.flat)
        self.tokens = 0

    def learn(self, documents: list[np.ndarray]) -> None:
        """Learn from all tokens of the documents once."""
        parts = [d[a : a + STRETCH] for d in documents for a in range(0, len(d), STRETCH)]
        parts.sort(key=len, reverse=True)
        for g in range(0, len(parts), LANES):
            lanes = parts[g : g + LANES]
            lengths = np.array([len(p) for p in lanes])
            if not len(lengths) or not lengths[0]:
                continue
            block = np.zeros((len(lanes), int(lengths[0])), np.int64)
            for i, p in enumerate(lanes):
                block[i, : len(p)] = p
            s = np.zeros((len(lanes), HIDDEN), np.float32)
            for a in range(0, block.shape[1], WINDOW):
                active = int(np.searchsorted(-lengths, -a))
                y = block[:active, a : a + WINDOW]
                s = self.window(s[:active], y, np.arange(a, a + y.shape[1])[None, :] < lengths[:active, None])

    def window(self, s: np.ndarray, y: np.ndarray, valid: np.ndarray) -> np.ndarray:
        g, steps = self.gru, y.shape[1]
        held, states = [], []
        for t in range(steps):
            states.append(s)
            s, *saved = g.step(s, y[:, t])
            held.append(saved)
        lanes = len(y)
        S = np.concatenate(states)
        Y, V = y.T.ravel(), valid.T.ravel()
        weight = (V / max(1, V.sum())).astype(np.float32)
        grad = np.zeros_like(g.flat)
        d = Gru.__new__(Gru).view(grad)
        dS, of = np.empty_like(S), Y // SIZE
        for a in range(0, len(Y), ROWS):
            part = slice(a, min(a + ROWS, len(Y)))
            p = _softmax_slope(S[part], g.O, g.b, of[part], weight[part])
            d.O += S[part].T @ p
            d.b += p.sum(axis=0)
            dS[part] = p @ g.O.T
        for c, rows in _by_class(Y):
            p = _softmax_slope(own := S[rows], g.M[c], g.m[c], Y[rows] % SIZE, weight[rows])
            d.M[c] += own.T @ p
            d.m[c] += p.sum(axis=0)
            dS[rows] += p @ g.M[c].T
        dS = dS.reshape(steps, lanes, HIDDEN)
        rows, carry = [], np.zeros((lanes, HIDDEN), np.float32)
        for t in range(steps - 2, -1, -1):
            z, r, n, hun = held[t]
            up = dS[t + 1]
            up += carry
            rest = 1 - z
            dn = n * n
            np.subtract(1, dn, out=dn)
            dn *= rest
            dn *= up
            dz = states[t] - n
            dz *= z
            dz *= rest
            dz *= up
            dr = 1 - r
            dr *= r
            dr *= hun
            dr *= dn
            da = np.concatenate([dz, dr, dn * r], axis=1)
            d.U += states[t].T @ da
            carry = da @ g.U.T
            up *= z
            carry += up
            rows.append(np.concatenate([dz, dr, dn], axis=1))
        if rows:
            dx, read = np.concatenate(rows), np.concatenate([y[:, t] for t in range(steps - 2, -1, -1)])
            order = np.argsort(read.astype(np.int16), kind="stable")
            read = read[order]
            first = np.flatnonzero(np.concatenate([[True], read[1:] != read[:-1]]))
            d.X[read[first]] += np.add.reduceat(dx[order], first, axis=0)
        self.apply(grad)
        self.tokens += int(V.sum())
        return s

    def apply(self, grad: np.ndarray) -> None:
        grad *= min(1.0, 1.0 / (float(np.sqrt(np.dot(grad, grad))) + 1e-12))
        self.n += 1
        self.m *= 0.9
        self.m += 0.1 * grad
        self.v *= 0.99
        grad *= grad
        grad *= 0.01
        self.v += grad
        step = self.rate * math.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
        np.sqrt(self.v, out=grad)
        grad += 1e-8
        np.divide(self.m, grad, out=grad)
        grad *= step
        self.gru.flat -= grad


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether crc32 of the id as text modulo ``folds`` is ``fold``; a null id counts as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds) == fold


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in _slices(batch.column(0)):
            _, words, codes = split_words(texts)
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(words)).astype(np.int64))], ["word", "n"])
    hand_back()


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in in_slices(lambda i: int(lengths[i]) + 8, len(lengths), SLICE):
        yield texts.slice(a, b - a)


def least_count(counts: DataFrame, most: int) -> int:
    """The least n such that at most ``most`` rows of ``counts(n)`` have n or more; counts of any size.

    Rows are counted by powers of two, then by ranges of the power in which the limit is passed, and so on: at most
    RANGES numbers at a time.
    """
    bits = F.length(F.bin("n")).cast("long")
    low, high, kept = 1, 1 << 62, 0
    classes = {r["c"]: r["k"] for r in counts.groupBy(bits.alias("c")).agg(F.count("*").alias("k")).collect()}
    for c in sorted(classes, reverse=True):
        if kept + classes[c] > most:
            low, high = 1 << (c - 1), 1 << c
            break
        kept += classes[c]
    else:
        return 1
    while high - low > 1:
        step = -(-(high - low) // RANGES)
        inside = counts.where((F.col("n") >= low) & (F.col("n") < high)).groupBy(F.expr(f"(n - {low}) div {step}").alias("c")).agg(F.count("*").alias("k"))
        for c, k in sorted(((r["c"], r["k"]) for r in inside.collect()), reverse=True):
            if kept + k > most:
                low, high = low + c * step, min(high, low + (c + 1) * step)
                break
            kept += k
    return high


def lexicon(training: DataFrame, *, head: int = HEAD) -> tuple[Lexicon, DataFrame]:
    """Counts over all of ``training(text)``; also the table (word, n) of the words left out of the broadcast."""
    counts = training.select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")
    counts = materialise(counts, "lm-counts")
    ends = training.count()
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    cutoff = least_count(counts, head)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(hashes_of(batch.column(0)).view(np.int64)), batch.column(1)], ["h", "n"])

    top = counts.where(F.col("n") >= cutoff).mapInArrow(hashed, "h long, n long").toArrow()  # at most ``head`` rows of two numbers
    words, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(words)
    words, n = words[order], n[order]
    first = np.lexsort((words, -n))[:LISTED]
    by_hash = np.argsort(words[first])
    listed, members = words[first][by_hash], by_hash.astype(np.int64) + 1

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = ending_buckets(batch.column(0).cast(pa.large_string())) - FIRST_BUCKET
            free = ~np.isin(hashes_of(batch.column(0)), listed)
            of, n = of[free], batch.column(1).to_numpy()[free]
            sums, number = np.bincount(of, n, BUCKETS), np.bincount(of, minlength=BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(sums.astype(np.int64)), pa.array(number.astype(np.int64))], ["bucket", "n", "k"])

    member_tokens, member_types = np.zeros(MEMBERS), np.zeros(MEMBERS)
    member_tokens[END], member_tokens[members] = ends, n[first][by_hash]
    for row in counts.mapInArrow(bucketed, "bucket long, n long, k long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).collect():
        member_tokens[FIRST_BUCKET + row["bucket"]], member_types[FIRST_BUCKET + row["bucket"]] = row["n"], row["k"]
    lex = Lexicon(tokens + ends, types + (ends > 0), ends, words, n.astype(np.uint32 if len(n) == 0 or n.max() < 1 << 32 else np.int64), listed, members, member_tokens, member_types, cutoff)
    return lex, counts.where(F.col("n") < cutoff)


def _documents(texts: pa.Array, lex: Lexicon) -> list[np.ndarray]:
    """The members of each text's tokens, its end last."""
    offsets, words, codes = split_words(texts)
    members = lex.look_up(words)[1][codes].astype(np.uint16) if len(codes) else np.zeros(0, np.uint16)
    return [np.append(members[a:b], np.uint16(END)) for a, b in zip(offsets[:-1], offsets[1:])]


def _coded(shared):
    """(h, text) -> (h, members as two bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                docs = _documents(texts, shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(docs)), pa.array([d.astype("<u2").tobytes() for d in docs], pa.binary())], ["h", "members"])
                at += len(docs)
        hand_back()

    return run


def _learn(start: np.ndarray, rate: float, passes: int):
    """Rows (shard, h, members), sorted -> for each shard its weights in pieces.

    Documents are learnt from in groups of GROUP tokens of the shard, wherever the batches between the
    JVM and Python end.
    """

    def pieces(shard: int, trainer: Trainer) -> pa.RecordBatch:
        parts = np.array_split(trainer.gru.flat, PIECES)
        return pa.RecordBatch.from_arrays([pa.array([shard] * PIECES, pa.int32()), pa.array(range(PIECES), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array([trainer.tokens] * PIECES, pa.int64())], ["shard", "piece", "w", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, trainer, held, size = None, None, [], 0

        def learn_held() -> None:
            for _ in range(passes):
                trainer.learn(held)

        for batch in batches:
            for own, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if own != shard:
                    if trainer is not None:
                        learn_held()
                        yield pieces(shard, trainer)
                    shard, trainer, held, size = own, Trainer(Gru(start), rate), [], 0
                held.append(np.frombuffer(raw.as_buffer(), "<u2"))
                size += len(held[-1])
                if size >= GROUP:
                    learn_held()
                    held, size = [], 0
        if trainer is not None:
            learn_held()
            yield pieces(shard, trainer)
        hand_back()

    return run


def _mean(kind: type):
    """The mean of one piece of the weights over rows (shard, piece, w, n), weighted by tokens; shards in their order."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("shard").to_numpy())
        w = np.stack([np.frombuffer(x, kind) for x in table.column("w").to_pylist()])[order].astype(float)
        n = table.column("n").to_numpy()[order].astype(float)
        mean = (w * n[:, None]).sum(axis=0) / n.sum()
        shard = table.column("shard").to_numpy().min() // SUMMED
        return pa.table({"shard": pa.array([shard], pa.int32()), "piece": table.column("piece")[:1], "w": pa.array([mean.tobytes()], pa.binary()), "n": pa.array([int(n.sum())], pa.int64())})

    return run


def _mean_of_shards(learnt: DataFrame) -> list:
    """(piece, w) as doubles: means of SUMMED shards each, then the means of those."""
    schema = "shard int, piece int, w binary, n long"
    some = learnt.groupBy("piece", F.expr(f"shard div {SUMMED}").alias("part")).applyInArrow(_mean(np.float32), schema)
    return some.groupBy("piece").applyInArrow(_mean(np.float64), schema).select("piece", "w").collect()


def train(training: DataFrame, lex: Lexicon, *, seed: int = 0, start_rate: float = 0.02, rate: float = 0.006, rounds: int = ROUNDS, start: int = START) -> np.ndarray:
    """The weights that ROUNDS of learning on all of ``training(h, text)`` leave; ``h`` is a hash of the row.

    A shard is a task.  A task reads 1,500,000 tokens until there are SHARDS of them, at 1e11 tokens; then tasks grow.
    """
    shared = training.sparkSession.sparkContext.broadcast(lex)
    weights = Gru.fresh(seed, lex.member_tokens).flat
    shards = min(SHARDS, math.ceil(lex.tokens / SHARD_TOKENS))
    if not shards:
        return weights
    with scratch():
        coded = training.select("h", "text").mapInArrow(_coded(shared), "h long, members binary")
        coded = coded.withColumn("round", F.pmod(F.shiftright("h", 40), F.lit(rounds)).cast("int")).withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
        coded = materialise(coded, "lm-members", by=("round",))
        # The starting documents are one shard: ``start`` rows at most, of each one stretch, by its hash.
        size = 2 * STRETCH
        stretch = F.expr(f"substring(members, cast(pmod(shiftright(h, 20), ceil(length(members) / {size})) * {size} + 1 as int), {size})")
        first = coded.select("h", stretch.alias("members")).orderBy("h", "members").limit(start).select(F.lit(0).alias("shard"), "h", "members")
        steps = [(first.coalesce(1).sortWithinPartitions("h", "members"), start_rate, 4)]
        steps += [(coded.where(F.col("round") == r).select("shard", "h", "members").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "members"), rate, 1) for r in range(rounds)]
        for rows, speed, passes in steps:
            learnt = rows.select("shard", "members").mapInArrow(_learn(weights, speed, passes), "shard int, piece int, w binary, n long")
            found = {r["piece"]: r["w"] for r in _mean_of_shards(learnt)}  # one set of weights
            if found:
                weights = np.concatenate([np.frombuffer(found[k], np.float64) for k in range(PIECES)]).astype(np.float32)
    return weights


def score(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, seed: int = 0, folds: int = 7, fold: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the documents that aren't held out and scores all.  Null texts are empty:
    one token, the end.  Null ids count as the empty text in the fold; repeated rows are scored
    each and all learnt from; very long texts are scored whole, with the state carried on; other columns are ignored; an
    empty table gives an empty result.  Without training documents all words are unknown and the weights random.
    """
    with scratch() as own:
        docs = bounded_batches(documents).select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
        docs = docs.withColumn("held", held_out(F.col("doc_id"), folds, fold))
        training = docs.where(~F.col("held")).select(F.xxhash64("doc_id", "text").alias("h"), "text")
        lex, rare = lexicon(training, head=head)
        weights = train(training, lex, seed=seed)
        return _keep_all(own, _scored(docs, lex, rare, weights))


def _keep_all(own, df: DataFrame) -> DataFrame:
    """``df`` reads the block's tables when it is asked for, so they stay."""
    for t in list(own.tables):
        own.keep(t)
    return df


def _scored(docs: DataFrame, lex: Lexicon, rare: DataFrame, weights: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def measured(batch: pa.RecordBatch, at: int, texts: pa.Array, lex: Lexicon) -> tuple[list[pa.Array], np.ndarray, list[np.ndarray]]:
        """Columns of a slice's rows, the words' part of their scores, and their members."""
        offsets, words, codes = split_words(texts)
        counts, members = lex.look_up(words)
        n = np.diff(offsets)
        tail = (counts == 0)[codes]
        own = np.repeat(np.arange(len(n)), n)
        log_count, log_within = np.log10(counts + 1.0), lex.within(members, counts)
        per = lambda x: np.bincount(own, x, len(n))
        base = per(np.where(tail, 0.0, log_count[codes])) + math.log10(lex.ends + 1)
        inner = per(np.where(tail, 0.0, log_within[codes]))
        of = members[codes].astype(np.uint16)
        # Rare words: distinct ones of each text, with their numbers and buckets.
        key, number = np.unique(own[tail].astype(np.int64) * max(1, len(words)) + codes[tail], return_counts=True)
        doc, word = key // max(1, len(words)), key % max(1, len(words))
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(n)))]).astype(np.int32))
        listed = pa.StructArray.from_arrays([words.take(pa.array(word)).cast(pa.string()), pa.array(number.astype(np.int64)), pa.array((members[word] - FIRST_BUCKET).astype(np.int32))], ["word", "n", "bucket"])
        known = per((~tail).astype(float)) + (lex.ends > 0)
        columns = [batch.column(0).slice(at, len(n)), batch.column(1).slice(at, len(n)), pa.array((n + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.ListArray.from_arrays(ends, listed)]
        return columns, inner, [np.append(of[a:b], np.uint16(END)) for a, b in zip(offsets[:-1], offsets[1:])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, gru = shared.value, Gru(weights)
        held: list[tuple] = []

        def scored() -> Iterator[pa.RecordBatch]:
            """Many documents side by side, so that a few long ones don't run alone for most of the time."""
            model, at = gru.score([d for h in held for d in h[2]]), 0
            for columns, inner, docs in held:
                score = pa.array(model[at : at + len(docs)] + inner)
                at += len(docs)
                yield pa.RecordBatch.from_arrays([*columns, score], ["doc_id", "held", "n", "known", "base", "rare", "score"])
            held.clear()

        tokens = 0
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(2)):
                held.append(measured(batch, at, texts, lex))
                at += len(texts)
                tokens += sum(map(len, held[-1][2]))
                if tokens >= SIDE_BY_SIDE:
                    yield from scored()
                    tokens = 0
        yield from scored()
        hand_back()

    schema = "doc_id long, held boolean, n long, known long, base double, rare array<struct<word:string,n:long,bucket:int>>, score double"
    # Rows are numbered as they are written: an id may repeat, a row's number doesn't.
    done = materialise(docs.select("doc_id", "held", "text").mapInArrow(run, schema).withColumn("uid", F.monotonically_increasing_id()), "lm-scores")
    each = done.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", "r.n", "r.bucket")
    each = each.join(rare.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    floors = F.element_at(F.array(*[F.lit(float(x)) for x in lex.floors()[FIRST_BUCKET:]]), F.col("bucket") + 1)
    late = each.groupBy("uid").agg(
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("late_base"),
        F.sum(F.col("n") * (F.log10(F.col("c") + 1.0) - floors)).alias("late_score"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("late_known"),
    )
    out = done.drop("rare").join(late, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    floor = math.log10(lex.tokens + lex.types + 1)
    return out.select(
        "doc_id", F.col("held").alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + zero("late_known")).cast("long").alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("late_base") - F.col("n") * floor).alias("base_score"), (F.col("score") + zero("late_score")).alias("score"),
    )
