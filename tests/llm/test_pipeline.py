"""The pipeline's stages, each judged on its own input, and its whole run."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cutweave.functions.storage import materialise, table
from cutweave.llm import jaccard, line_dedup, mixing

SF = "/root/testdata/sf0.01"


def test_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {}
    for name, stage in pipeline.STAGES[:-1]:
        out = materialise(stage(spark, docs, SF), "test-stage")
        assert out.columns == columns, name
        rows[name] = (docs, out)
        docs = out
    before, good = rows["quality_classifier"]
    labels = table(spark, SF, "labels")
    kept = labels.join(good.select("doc_id"), "doc_id", "left_semi")
    assert kept.where("quality = 1").count() >= 0.98 * labels.where("quality = 1").count()
    assert kept.where("quality = 0").count() <= 0.1 * labels.where("quality = 0").count()

    before, cut = rows["line_dedup"]
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    for r in before.collect():
        if r["doc_id"] in texts and r["text"] is not None:
            assert set((texts[r["doc_id"]] or "").split("\n")) <= set(r["text"].split("\n"))

    before, single = rows["ngram_jaccard"]
    found = jaccard.near_duplicates(before)
    assert single.count() == found.where("doc_id = class_id").count() < before.count()

    before, mixed = rows["source_mixing"]
    assert mixed.select(F.sum(mixing.words_in(F.col("text")))).first()[0] == mixing.mix(before).agg(F.sum("taken")).first()[0]
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_names_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard", "source_mixing", "bpe_encoding"]


def test_run_equals_brute_force(spark, sf_dir):
    """Every stage by plain Python on the whole smallest table, and the ids by the library."""
    import hashlib
    import math
    import zlib
    from collections import Counter

    import numpy as np
    from tokenizers import Tokenizer

    from cutweave.llm import quality, queries
    from tests.llm.test_operators import brute_jaccard, water

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = [r.asDict() for r in docs.collect()]
    learnt = labels.where(F.col("doc_id").isin([r["doc_id"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5]))
    forest = quality.train(docs, learnt)
    rows = [r for r in rows if forest.score(np.array([quality.statistics(r["text"])]))[0] >= 0.3]
    strip = lambda x: x.strip(" \t\n\v\f\r")
    sites, first = {}, {}
    for r in rows:
        for line in map(strip, (r["text"] or "").split("\n")):
            if line:
                sites.setdefault(line, set()).add(r["source"])
                first[line] = min(r["doc_id"], first.get(line, r["doc_id"]))
    cut = []
    for r in rows:
        lines = (r["text"] or "").split("\n")
        kept = [x for x in lines if len(sites.get(strip(x), ())) < line_dedup.SITES or first[strip(x)] == r["doc_id"]]
        if len(kept) < len(lines):
            r = r | {"text": "\n".join(kept), "n_chars": len("\n".join(kept))}
            if not strip(r["text"]):
                continue
        cut.append(r)
    classes = brute_jaccard([(r["doc_id"], r["text"]) for r in cut])
    single = [r for r in cut if classes[r["doc_id"]][0] == r["doc_id"]]
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    sizes = Counter()
    for r in single:
        sizes[r["source"]] += len(words(r["text"]))
    library = Tokenizer.from_file(queries.vocabulary())
    library.no_truncation()
    library.no_padding()
    want = Counter()
    for source, target in water(sizes).items():
        budget = math.floor(target + 1e-9)
        own = sorted((int(hashlib.md5(f"{r['doc_id']}#0".encode()).hexdigest()[:15], 16), r["doc_id"], r) for r in single if r["source"] == source)
        while budget > 0:
            for _, i, r in own:
                w = words(r["text"])
                if budget and w:
                    text = r["text"] if budget >= len(w) else " ".join(w[:budget])
                    budget -= min(budget, len(w))
                    want[i, tuple(library.encode(text, add_special_tokens=False).ids)] += 1
    got = pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "token_ids"]
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in got.collect()) == want


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows, clashing columns and an empty table, through every stage."""
    good = [r["text"] for r in table(spark, sf_dir, "documents").orderBy("doc_id").limit(30).collect()]
    rows = [(i, t, "en", f"s{i % 8}", None) for i, t in enumerate(good)] + [(3, good[3], "en", "s3", 5)] * 2 + [(None, good[4], None, None, None), (None, None, None, None, None), (50, None, "x", "s1", 1), (51, "", "x", "s1", 0), (52, " \n", "x", None, 2), (53, "long words " * 30_000, "x", "s2", 1)]
    full = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "_score", "lines_removed", "gone", "row", "n", "size", "key", "id", "version"):
        full = full.withColumn(c, F.lit(c))
    for docs in (full, full.where("false")):
        for name, stage in pipeline.STAGES[:-1]:
            out = materialise(stage(spark, docs, sf_dir), "test-odd")
            assert out.columns == docs.columns, name
            assert all(r[c] == c for r in out.collect() for c in ("score", "lines_removed", "gone", "row", "version")), name
            if name != "quality_classifier":
                docs = out
        last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert last.count() == docs.count()
