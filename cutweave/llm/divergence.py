"""Source divergence audit: how the use of terms in each source departs from other sources and from its whole language.

Terms of a language are known by the counts of the sources that have them.  Terms of equal counts in all sources are one
class; every formula is worked out once a class and counted as often as the class has terms.  A pair of sources needs only
the classes that both have: what a source's other terms add depends on the count in one source and on the other
source's zero, so it comes from histograms of counts.  All arithmetic is of whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutweave.functions.columns import named
from cutweave.functions.storage import materialise, scratch
from cutweave.llm.kernels import bounded_batches, hand_back, in_slices
from cutweave.llm.words import slices, split

#: Shares are of this many parts, plus one.
PARTS = 1_000_000_000
#: Terms seen in fewer documents of a language are left out, and ranks of terms beyond the last one.
LEAST_DOCUMENTS, LAST_RANK = 3, 200
#: Text whose terms are counted together, and pairs of sources that are worked out at once.
COUNTED, PAIRS = 16 << 20, 1 << 20
#: Letters stay (A-Z lower-cased) and so does all that isn't ASCII; the rest parts terms.
_LETTERS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), counted by slices of the input."""
    for batch in batches:
        langs, sources = (batch.column(k).dictionary_encode() for k in (0, 1))
        group = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
        for at, texts in slices(batch.column(2), COUNTED):
            offsets, terms, codes = split([t.translate(_LETTERS) for t in texts])
            width = max(1, len(terms))
            doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
            in_doc, n = np.unique(doc * width + codes, return_counts=True)
            key = group[at + in_doc // width] * width + in_doc % width
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            own, docs = key[first] // width, np.diff(np.concatenate([first, [len(key)]]))
            columns = [langs.dictionary.take(pa.array(own // max(1, len(sources.dictionary)))), sources.dictionary.take(pa.array(own % max(1, len(sources.dictionary)))), terms.take(pa.array(key[first] % width)).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.add.reduceat(n, first) if len(first) else n), pa.array(docs)], ["lang", "source", "term", "n", "docs"])
    hand_back()


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(PARTS * (n + 1) / (total + terms)), exactly; 1 where there are no terms."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.when(terms > 0, F.lit(1).cast("long") + F.call_function("div", F.lit(PARTS).cast("decimal(10,0)") * wide(n + 1), wide(total + terms))).otherwise(F.lit(1).cast("long"))


def departure(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most PARTS + 1, so squares fit into 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Classes (lang, times, sources, shares, empty shares) -> (lang, source, item, value): what classes that both sources have add beyond
    the histograms' part; summed within about PARTS pairs."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        lists = batch.column(2)
        starts = lists.offsets.to_numpy()
        size = np.diff(starts)
        names = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        who, starts = names.indices.to_numpy().astype(np.int64), starts - starts[0]
        own = np.repeat(np.arange(len(size)), size)
        # Values of list columns follow their own offsets.
        flat = [c.values.to_numpy(zero_copy_only=False)[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in (batch.column(3), batch.column(4))]
        p, p0 = flat
        times, lang = batch.column(1).to_numpy(), langs.indices.to_numpy().astype(np.int64)
        width = max(1, len(names.dictionary))
        for a, b in in_slices(lambda e: int(size[own[e]]), len(own), PAIRS):
            left = np.repeat(np.arange(a, b), size[own[a:b]])
            opens = np.cumsum(size[own[a:b]]) - size[own[a:b]]
            right = starts[own[left]] + np.arange(len(left)) - np.repeat(opens, size[own[a:b]])
            different = left != right
            left, right = left[different], right[different]
            if not len(left):
                continue
            more = _f(p[left], p[right]) - _f(p[left], p0[right]) - _f(p0[left], p[right]) + _f(p0[left], p0[right])
            key, place = np.unique((lang[own[left]] * width + who[left]) * width + who[right], return_inverse=True)
            value = np.zeros(len(key), np.int64)
            np.add.at(value, place, more * times[own[left]])
            columns = [langs.dictionary.take(pa.array(key // width**2)), names.dictionary.take(pa.array(key // width % width)), names.dictionary.take(pa.array(key % width)), pa.array(value)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])
    hand_back()


def audit(documents: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, last_rank: int = LAST_RANK) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``documents(text, lang, source)``.

    Terms are runs of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those in at least
    ``least_documents`` of its rows.  In part ``pair`` items are the other sources of the language, valued by the sum of
    ``departure`` over all kept terms; in part ``term`` the kept terms that the source uses more than the language, the first
    ``last_rank`` of them.  Null texts, languages and sources count as empty ones; every row is a document, equal rows too;
    ties go by the item's bytes; texts of any length are read whole; a source without kept terms has zero counts; further
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    with scratch() as own:
        text = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
        docs = bounded_batches(documents).select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text"))
        found = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        counts = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        vectors = counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vector"), F.sum("docs").alias("docs"))
        vectors = materialise(vectors.where(F.col("docs") >= least_documents).select("lang", "term", "vector"), "audit-vectors")
        classes = materialise(vectors.groupBy("lang", "vector").agg(F.count("*").alias("times"), F.min("term").alias("first")), "audit-classes")

        # Totals of groups and languages.
        each = classes.select("lang", "first", "times", F.explode("vector").alias("e")).select("lang", "first", "times", "e.source", "e.n")
        totals = each.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total"), F.sum("times").alias("present"))
        terms = classes.groupBy("lang").agg(F.sum("times").alias("terms"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(terms, "lang", "left")
        groups = groups.select("lang", "source", zero("total").alias("total"), zero("present").alias("present"), zero("terms").alias("terms"))
        groups = materialise(groups.withColumn("empty", share(F.lit(0), F.col("total"), F.col("terms"))), "audit-groups")
        langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))

        # Each class with the shares of its sources.
        shared = each.join(groups.select("lang", "source", "total", "terms", "empty"), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
        full = shared.groupBy("lang", "first").agg(F.first("times").alias("times"), F.sum("n").alias("n"), F.first("terms").alias("terms"), F.collect_list(F.struct("source", "n", "p", "empty")).alias("e"))
        full = materialise(full, "audit-shares")
        pairs = _pair_values(full, groups)
        by_value = lambda item: Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)
        pairs = pairs.withColumn("rank", F.row_number().over(by_value("item")))

        # Only the first classes of a group can hold its first terms, and of a class only its first terms.
        entries = full.join(langs, "lang").select("lang", "first", share(F.col("n"), F.col("lang_total"), F.col("terms")).alias("q"), F.explode("e").alias("e"))
        entries = entries.where(F.col("e.p") > F.col("q")).select("lang", "first", F.col("e.source").alias("source"), departure(F.col("e.p"), F.col("q")).alias("value"))
        best = entries.withColumn("rank", F.row_number().over(by_value("first"))).where(F.col("rank") <= last_rank)
        heads = vectors.withColumn("k", F.row_number().over(Window.partitionBy("lang", "vector").orderBy("term"))).where(F.col("k") <= last_rank)
        heads = heads.join(classes.select("lang", "vector", "first"), ["lang", "vector"]).select("lang", "first", "term")
        ranked = best.drop("rank").join(heads, ["lang", "first"]).select("lang", "source", F.col("term").alias("item"), "value")
        ranked = ranked.withColumn("rank", F.row_number().over(by_value("item"))).where(F.col("rank") <= last_rank)
        out = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionAll(ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
        return own.keep(materialise(out, "audit"))


def _pair_values(full: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for each ordered pair of sources of a language."""
    lists = full.select("lang", "times", F.col("e.source").alias("source"), F.col("e.p").alias("p"), F.col("e.empty").alias("empty"))
    both = lists.mapInArrow(_pairs, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Terms of one source against the other's zero: by the distinct shares of the source.
    steps = full.select("lang", "times", F.explode("e").alias("e")).groupBy("lang", F.col("e.source").alias("source"), F.col("e.p").alias("p")).agg(F.sum("times").alias("times"))
    steps = steps.join(groups.select("lang", F.col("source").alias("other"), F.col("empty").alias("zero")), "lang").where("source <> other")
    sums = steps.groupBy("lang", "source", "other").agg(F.sum(departure(F.col("p"), F.col("zero")) * F.col("times")).alias("as_p"), F.sum(departure(F.col("zero"), F.col("p")) * F.col("times")).alias("as_q"))
    every = groups.select("lang", "source", "present", "terms", "empty").join(groups.select("lang", F.col("source").alias("item"), F.col("present").alias("present2"), F.col("empty").alias("empty2")), "lang").where("source <> item")
    out = every.join(both, ["lang", "source", "item"], "left").join(sums.select("lang", "source", F.col("other").alias("item"), "as_p"), ["lang", "source", "item"], "left")
    out = out.join(sums.select("lang", F.col("other").alias("source"), F.col("source").alias("item"), "as_q"), ["lang", "source", "item"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    neither = (F.col("terms") - F.col("present") - F.col("present2")) * departure(F.col("empty"), F.col("empty2"))
    return out.select("lang", "source", "item", (zero("value") + zero("as_p") + zero("as_q") + neither).cast("long").alias("value"))
