"""A corpus pipeline of five stages: from raw documents to token ids of a mixed corpus.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; all but the last return
the columns of ``documents``.  Between stages the rows are written and read again; what a stage wrote for itself
is deleted when its rows stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutweave.functions.columns import named, unused
from cutweave.functions.storage import discard, materialise, scratch, table
from cutweave.llm import bpe, jaccard, line_dedup, mixing, quality
from cutweave.llm.queries import MIX_WEIGHTS, QUALITY_FOLDS, QUALITY_SCORE, vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is under the limit go.

    Null and empty texts are scored like others; equal rows share their fate; ties with the limit stay; further columns
    come through whatever their names; an empty table gives an empty one.
    """
    labels = table(spark, sf_dir, "labels")
    learnt = labels.where(quality.fold(F.col("doc_id"), QUALITY_FOLDS) != 0)
    (score,) = unused(docs.columns, "score")
    scored = quality.score_documents(docs, quality.train(docs, learnt), out=score)
    return scored.where(F.col(score) >= QUALITY_SCORE).select(*[named(c) for c in docs.columns])


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sites go, but for one document each; documents of which nothing is left go too.

    Texts that were null, empty or blank before stay; rows without an id lose no line; rows that repeat an id are
    handled each; further columns come through whatever their names; an empty table gives an empty one.
    """
    (removed,) = unused(docs.columns, "lines_removed")
    cut = line_dedup.remove_boilerplate(docs, removed=removed)
    emptied = (F.col(removed) > 0) & ~named("text").rlike(r"[^\x20\x09-\x0D]")
    return cut.where(~F.coalesce(emptied, F.lit(False))).select(*[named(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays.

    Texts without words (null, empty, blank) and rows without an id stay; rows that repeat the smallest id of a group
    all stay; very long texts are compared whole; an empty table gives an empty one.
    """
    return jaccard.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents are repeated for repeated epochs.

    Texts without words (null, empty, blank) go, as they add nothing to a budget of words; a null source is one of its
    own; every row, repeated ones and those without an id too, has its own share; an empty table gives an empty one.
    """
    return mixing.mixed_documents(docs, MIX_WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of every text; null and empty texts have none, equal rows stay."""
    return bpe.encode_documents(docs.select(*[named(c) for c in ("doc_id", "lang", "source", "text")]), vocabulary(), ids=True).drop("text")


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]
#: Classifier, MinHash and BPE are beyond SQL; tests/llm holds the stages and the whole run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as own:
            after = own.keep(materialise(stage(spark, docs, sf_dir), f"pipeline-{name}"))
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
