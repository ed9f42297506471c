"""N-gram Jaccard join: documents whose sets of five-word shingles have similarity 0.8 or more.

MinHash banding proposes, full sets decide:

1. Each whole text becomes its set of shingle hashes; from it come a 128-bit name of the set, the
   band hashes and one byte of each minimum.  Documents with equal sets are one class.
2. Band hashes of the classes' representatives are shuffled.  Within a bucket the bytes of the
   minima are compared, which removes pairs that share a band by chance; what stays is written as
   stars and joined to candidate clusters.  Buckets of more than BLOCK members are cut into blocks
   that meet pairwise, so no task gets a whole large bucket, and no pair is ever written.
3. The texts of clusters of two or more are fetched once, cut into blocks in the same way, and all
   pairs of a tile are verified on their full sets.  A tile returns numbers of links and stars.

Blocks grow with the square root of their group up to GROWN times their least size, so a group of k rows is sent
about k ** 1.5 times until blocks are at their greatest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutweave.functions.columns import named, unused
from cutweave.functions.storage import materialise, scratch
from cutweave.llm.kernels import bounded_batches, hand_back, in_slices, mixed, runs, smallest_reached, starts
from cutweave.operators.components import components

SHINGLE, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.9999, 4
#: Representatives of a block of a bucket, and documents and shingles of a block of a cluster.
BLOCK, DOCS, SHINGLES = 256, 128, 1_000_000
#: Blocks of large groups are up to so many times as large.
GROWN = 8
#: Characters of text whose words are held as arrays at once.
SLICE = 2 << 20
_SEEDS = np.random.default_rng(20_240_229)
_ODD = _SEEDS.integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _SEEDS.integers(0, 1 << 63, 1024, dtype=np.uint64)


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """The fewest bands of ``rows`` minima for which pairs at the threshold share one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def agreement(threshold: float, minima: int) -> int:
    """Equal minima below which a pair is no candidate: over five standard deviations under the mean at the threshold.

    A pair at the threshold stays below with a probability under 1e-6, small beside that of sharing no band.
    """
    return max(1, math.floor(minima * threshold - 5.2 * math.sqrt(minima * threshold * (1 - threshold))))


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text.

    Words are runs of characters other than ASCII white space, in lower case.  A text of fewer
    words than ``size`` is one shingle; null texts and those without words have the empty set.
    """
    # Python's own lower and strip: Arrow's kernels give wrong offsets for sliced arrays.
    texts = pa.array([(t or "").lower().strip(" \t\n\v\f\r") for t in texts.to_pylist()], pa.large_string())
    words = pc.ascii_split_whitespace(texts)
    offsets = words.offsets.to_numpy()
    flat = words.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    flat = flat if isinstance(flat, pa.DictionaryArray) else flat.combine_chunks()
    names = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], np.uint64)
    h = names[flat.indices.to_numpy()] if len(names) else np.zeros(0, np.uint64)
    offsets = offsets - offsets[0]
    blank = (pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0)
    step = np.uint64(0x9E3779B97F4A7C15)
    n = len(h) - size + 1
    grams = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        grams = grams * step + h[k : k + n]
    grams = mixed(grams)
    out = []
    for i in range(len(texts)):
        a, b = offsets[i], offsets[i + 1]
        if blank[i]:
            out.append(np.zeros(0, np.uint64))
        elif b - a < size:
            value = np.full(1, b - a, np.uint64)
            for w in range(a, b):
                value = value * step + h[w]
            out.append(mixed(value))
        else:
            out.append(np.unique(grams[a : b - size + 1]))
    return out


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the sets (two words each), band hashes and the low bytes of the minima of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    name = np.stack([np.add.reduceat(mixed(flat + np.uint64(k)), at) for k in (1, 2)], axis=1)
    minima = np.empty((len(sets), bands * rows), np.uint64)
    for k in range(bands * rows):
        minima[:, k] = np.minimum.reduceat(flat * _ODD[k] + _ADD[k], at)
    minima = mixed(minima)
    hashes = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        value = np.full(len(sets), b + 1, np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            value = mixed(value * np.uint64(31) + minima[:, k])
        hashes[:, b] = value
    return name, hashes, (minima & np.uint64(255)).astype(np.uint8)


def _sign(bands: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hashes_ = batch.columns
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in in_slices(lambda i: int(lengths[i]), len(lengths), SLICE):
                sets = shingle_sets(texts.slice(a, b - a), size)
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                name, hashes, low = signatures([sets[i] for i in some], bands, rows)
                bandlist = pa.ListArray.from_arrays(pa.array(np.arange(0, hashes.size + 1, bands, dtype=np.int32)), pa.array(hashes.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(some)), hashes_.slice(a, b - a).take(pa.array(some)), pa.array(name[:, 0].view(np.int64)), pa.array(name[:, 1].view(np.int64)), pa.array([len(sets[i]) for i in some], pa.int64()), bandlist, pa.array([r.tobytes() for r in low], pa.binary())],
                    ["doc", "version", "key_a", "key_b", "n", "bands", "low"],
                )
        hand_back()

    return run


def _alike(least: int):
    """Within runs of (bucket, i, j): links of representatives that agree in ``least`` minima, as stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["bucket", "i", "j"]):
            ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
            low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(ids), -1)
            first = starts(table, ["bucket", "i", "j"])
            size = np.diff(np.append(first, len(ids)))
            end = np.repeat(first + size, size)
            across = np.repeat(table.column("i").to_numpy()[first] != table.column("j").to_numpy()[first], size)
            left, right, p, d = [], [], np.arange(len(ids)), 1
            while len(p := p[p + d < end[p]]):
                q = p[(~across[p] | (block[p] != block[p + d])) & (ids[p] != ids[p + d])]
                ok = (low[q] == low[q + d]).sum(axis=1) >= least
                left.append(q[ok])
                right.append(q[ok] + d)
                d += 1
            if not left or not sum(map(len, left)):
                continue
            yield _stars(ids, np.concatenate(left), np.concatenate(right))
        hand_back()

    return run


def _stars(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    own, where = np.unique(ids, return_inverse=True)
    reached = smallest_reached(own, where[left], where[right])
    linked = reached != own
    return pa.RecordBatch.from_arrays([pa.array(reached[linked]), pa.array(own[linked])], ["a", "b"])


def similar_pairs(sets: list[np.ndarray], group: np.ndarray, across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with Jaccard similarity >= threshold; with ``across`` only of different groups.

    Shingles of one set only are left aside; the others are columns of 0/1 matrices whose products
    are numbers of common shingles, some thousand columns at a time.
    """
    k, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    if k <= 8:
        common = np.zeros((k, k))
        for i in range(k):
            for j in range(i + 1, k):
                if min(sizes[i], sizes[j]) >= threshold * max(sizes[i], sizes[j]) - 1e-9:
                    common[i, j] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(k), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]])
        column = np.cumsum(new) - 1
        shared = np.bincount(column)[column] > 1
        owner, column = owner[shared], column[shared]
        column = np.unique(column, return_inverse=True)[1] if len(column) else column
        common, width = np.zeros((k, k), np.float32), 4096
        edge = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
        for a, b in zip(edge[:-1], edge[1:]):
            if b > a:
                dense = np.zeros((k, width), np.float32)
                dense[owner[a:b], column[a:b] % width] = 1
                common += dense @ dense.T
    i, j = np.triu_indices(k, 1)
    both = common[i, j].astype(float)
    ok = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
    ok &= both > 0
    if across:
        ok &= group[i] != group[j]
    return i[ok], j[ok]


def _verify(threshold: float, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["cluster", "i", "j"], most=1):
            ids = table.column("id").to_numpy()
            # Equal rows of one id bring their text several times; sorted by id, they stand side by side.
            twice = np.zeros(len(ids), bool)
            twice[1:] = ids[1:] == ids[:-1]
            for c in ("cluster", "i", "j"):
                v = table.column(c).to_numpy()
                twice[1:] &= v[1:] == v[:-1]
            table = table.filter(pa.array(~twice)) if twice.any() else table
            ids, block, copies = (table.column(c).to_numpy() for c in ("id", "block", "copies"))
            text = table.column("text").combine_chunks()
            text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
            i, j = table.column("i").to_numpy(), table.column("j").to_numpy()
            first = np.append(starts(table, ["cluster", "i", "j"]), len(ids))
            out = []
            for a, b in zip(first[:-1], first[1:]):
                sets: list[np.ndarray] = []
                lengths = pc.fill_null(pc.binary_length(text.slice(a, b - a)), 0).to_numpy(zero_copy_only=False)
                for s, e in in_slices(lambda x, n=lengths: int(n[x]), b - a, SLICE):
                    sets += shingle_sets(text.slice(a + s, e - s), size)
                left, right = similar_pairs(sets, block[a:b], i[a] != j[a], threshold)
                different = ids[a + left] != ids[a + right]
                left, right = left[different], right[different]
                if not len(left):
                    continue
                links = np.bincount(left, copies[a + right], b - a) + np.bincount(right, copies[a + left], b - a)
                reached = smallest_reached(ids[a:b], left, right)
                out.append((ids[a:b][links > 0], links[links > 0].astype(np.int64), reached[links > 0]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["id", "links", "reached"])
        hand_back()

    return run


def _tiles(df: DataFrame, blocks, keep: list[str]) -> DataFrame:
    """Each row once for every tile of its block: columns block, i, j."""
    df = df.withColumn("_n", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    return df.withColumn("_t", F.explode(pairs)).select(*keep, "block", "_t.i", "_t.j")


def _blocks(count, least: int):
    """Blocks of a group of ``count`` rows: of ``least`` rows at first, up to GROWN times as many in large groups."""
    side = F.greatest(F.lit(least), F.least(F.lit(GROWN * least), F.ceil(F.sqrt(count * least) / 2)))
    return F.ceil(count / side)


def near_duplicates(documents: DataFrame, *, threshold: float = THRESHOLD, size: int = SHINGLE, rows: int = ROWS, recall: float = RECALL, block: int = BLOCK, docs: int = DOCS, filtered: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, n_links, copy_of.

    ``copy_of`` is the smallest id with the same set of shingles, ``n_links`` the number of other
    documents with similarity >= ``threshold`` (copies counted, not written out), ``class_id`` the
    smallest id that links reach.  Null texts and texts without words link with nothing.  Rows
    with a null id have null class_id and copy_of and no links.  Every other row is a document of its own, also
    where an id repeats, with the same text or another.  Very long texts are read whole.  With ``filtered`` False every
    pair that shares a band is a candidate, however few of its minima agree.  Other columns are ignored; an empty table
    gives an empty result.
    """
    bands = bands_for(threshold, rows, recall)
    with scratch() as own:
        docs_in = bounded_batches(documents).select(named(id_col).cast("long").alias("doc"), named(text_col).alias("text")).withColumn("version", F.xxhash64("text"))
        with_id = docs_in.where("doc is not null")
        signed = with_id.mapInArrow(_sign(bands, rows, size), "doc long, version long, key_a long, key_b long, n long, bands array<long>, low binary")
        # Rows are numbered as they are written: an id may repeat, a row's number doesn't.
        signed = own.keep(materialise(signed.withColumn("id", F.monotonically_increasing_id()), "jaccard-signed"))
        key = ["key_a", "key_b"]
        classes = signed.groupBy(*key).agg(F.min(F.struct("doc", "id")).alias("rep"), F.count("*").alias("copies"))
        classes = materialise(classes.select(*key, F.col("rep.doc").alias("rep"), F.col("rep.id").alias("id"), "copies"), "jaccard-classes")
        reps = signed.join(classes.select("id", "copies"), "id").select("id", "doc", "version", "copies", "n", "bands", "low")
        reps = materialise(reps, "jaccard-reps")

        # Candidates: representatives that share a band and agree in enough minima.
        member = reps.select("id", F.explode("bands").alias("bucket"))
        shared = materialise(member.groupBy("bucket").agg(F.count("*").alias("k")).where("k > 1"), "jaccard-buckets")
        # Shuffled whatever the size, so that a plan seen on little data is that of much data.
        member = member.join(shared.hint("merge"), "bucket").join(reps.select("id", "low").hint("merge"), "id")
        tiles = _tiles(member, _blocks(F.col("k"), block), ["bucket", "id", "low"])
        tiles = tiles.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id")
        candidate = tiles.mapInArrow(_alike(agreement(threshold, bands * rows) if filtered else 0), "a long, b long")
        clusters = materialise(components(candidate), "jaccard-clusters").select("id", F.col("component").alias("cluster"))

        # Verification on whole sets: the texts of clusters, each fetched once.
        inside = clusters.join(reps.select("id", "doc", "version", "copies", "n"), "id")
        weight = inside.groupBy("cluster").agg(F.greatest(_blocks(F.count("*"), docs), F.ceil(F.sum("n") / SHINGLES)).alias("blocks"))
        inside = materialise(inside.join(materialise(weight, "jaccard-weights"), "cluster").select("id", "doc", "version", "cluster", "copies", "blocks"), "jaccard-inside")
        rows_ = with_id.join(inside.hint("merge"), ["doc", "version"])
        rows_ = _tiles(rows_, F.col("blocks"), ["cluster", "id", "copies", "text"])
        rows_ = rows_.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "id")
        found = materialise(rows_.mapInArrow(_verify(threshold, size), "id long, links long, reached long"), "jaccard-links")
        links = found.groupBy("id").agg(F.sum("links").alias("links"))
        reach = components(found.select(F.col("reached").alias("a"), F.col("id").alias("b")))

        known = classes.join(links, "id", "left").join(reach, "id", "left")
        known = known.select(*key, "rep", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("root"))
        known = materialise(known, "jaccard-known")
        smallest = known.groupBy("root").agg(F.min("rep").alias("component"))
        known = own.keep(materialise(known.join(smallest, "root").select(*key, "rep", "links", "component"), "jaccard-result"))
    # A set of a third of all rows is one row on the right, so the left can be split.
    out = signed.select("doc", *key).join(known, key).select(F.col("doc").alias("doc_id"), F.col("component").alias("class_id"), F.col("links").alias("n_links"), F.col("rep").alias("copy_of"))
    # Documents without a shingle have no row among the signed ones.
    bare = docs_in.where(F.col("doc").isNull() | ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(F.col("doc").alias("doc_id"), F.col("doc").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("copy_of"))
    return out.unionAll(bare)


def distinct_documents(documents: DataFrame, **options) -> DataFrame:
    """``documents`` without near duplicates: of each class the row with its smallest id stays.

    Rows that repeat the smallest id of their class all stay; an id that repeats in several classes goes if it goes in
    one of them.  Rows with a null id, and texts without words, stay.  Columns keep
    their names, whatever those are; an empty table gives an empty result.
    """
    with scratch() as own:
        found = near_duplicates(documents.select(named("doc_id").alias("doc_id"), named("text").alias("text")), **options)
        (mark,) = unused(documents.columns, "gone")
        gone = own.keep(materialise(found.where("doc_id <> class_id").select(F.col("doc_id").alias(mark)).distinct(), "jaccard-gone"))
    return documents.join(gone, named("doc_id") == F.col(mark), "left_anti")
