"""Divergence audit, periodic runs and substring dedup against brute force, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cutweave.functions.storage import table
from cutweave.llm import divergence, embeddings, mixing, passages, periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"
ODD = [None, "", " \t\n", "a", "née Σίσυφος ΣΑΣ", "é é \x00 it's", " a b\x85c\x1cd", "日本語 テスト 😀😀"]


def make(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- 11: divergence ------------------------------------------------------------------------------


def brute_audit(rows, least=3, last=200):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    docs = [(lang or "", source or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, terms in own for t in set(terms))
        kept = [t for t, n in seen.items() if n >= least]
        count = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            count[s].update(t for t in terms if seen[t] >= least)
        total = sum(count.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in count.items()}, share(total)
        f = lambda a, b: (a - b) * (a - b) // b
        for s in count:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, last)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("least, last", [(3, 200), (1, 2), (2, 5)])
def test_audit_equals_brute_force(spark, monkeypatch, least, last):
    monkeypatch.setattr(divergence, "PAIRS", 7)  # pairs are worked out in many pieces
    rng = np.random.default_rng(least)
    vocabulary = ["the", "The", "of", "naïve", "Ünder", "x", "日本", "it", "é", "zz"] + [f"t{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(rng.choice(vocabulary, int(rng.integers(0, 30)))) + rng.choice(["", "!", " 12"]), rng.choice(["en", "fr", ""]), rng.choice(["a", "b", "é", "B"])) for _ in range(90)]
    rows += [(t, None, "odd") for t in ODD] + [(t, "en", None) for t in ODD] + [("lonely", "xx", "only"), ("", "yy", "a"), (None, "yy", "b")]
    rows += [rows[0], rows[0]]
    schema = "text string, lang string, source string, term int, n int, value int, vector int"
    df = make(spark, [(None if t is None else str(t), None if a is None else str(a), None if b is None else str(b), 1, 2, 3, 4) for t, a, b in rows], schema).repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(df, least_documents=least, last_rank=last).collect())
    assert got == brute_audit([(r[0], r[1], r[2]) for r in df.collect()], least, last)


def test_audit_of_nothing_and_of_one_hot_word(spark):
    assert divergence.audit(make(spark, [], DOCS)).count() == 0
    rows = [(k, "word " * (1 + k % 3) * 50, "en", "abc"[k % 3]) for k in range(60)] + [(99, "word " * 30_000, "en", "a")]
    got = sorted(tuple(r) for r in divergence.audit(make(spark, rows, DOCS)).collect())
    assert got == brute_audit([r[1:] for r in rows])


def test_audit_is_exact_for_great_counts(spark):
    n, total = 10**10, 9 * 10**18 // 10
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(7)).alias("p")).first()["p"]
    assert got == 1 + 10**9 * (n + 1) // (total + 7)


def test_audit_sql_on_documents(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    df = queries.op11_source_divergence(spark, sf_dir)
    found = con.execute(queries.OP11_SQL)
    at = [[c[0] for c in found.description].index(c) for c in df.columns]
    want = sorted(tuple(r[k] for k in at) for r in found.fetchall())
    assert want and sorted(tuple(r) for r in df.collect()) == want


# -- 12: periodic runs ---------------------------------------------------------------------------


def smallest_period(s):
    return next(q for q in range(1, len(s) + 1) if all(s[i] == s[i + q] for i in range(len(s) - q)))


def brute_runs(words, least=24, repeats=3):
    out = set()
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q) and smallest_period(words[i : j + q]) == q:
                out.add((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, words):
    """The row that op12 gives."""
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(kept))


@pytest.mark.parametrize("long", [1, 10**9])
def test_runs_equal_brute_force(monkeypatch, long):
    monkeypatch.setattr(periodic, "LONG", long)  # lags looked over by blocks first, or not
    rng = np.random.default_rng(long % 97)
    for _ in range(150):
        words = []
        for _ in range(int(rng.integers(1, 6))):
            base = rng.integers(0, rng.choice([2, 3, 30]), int(rng.integers(1, 14))).tolist()
            words += (base * int(rng.integers(1, 12)))[: int(rng.integers(1, 90))]
            words += rng.integers(0, rng.choice([2, 3, 30]), int(rng.integers(0, 20))).tolist()
        for least, repeats in ((24, 3), (6, 3), (9, 4)):
            assert periodic.runs(words, least, repeats) == brute_runs(words, least, repeats)


def test_runs_at_the_limits():
    w = [f"w{k}" for k in range(400)]
    assert periodic.runs([]) == periodic.runs(w) == periodic.runs(["a"] * 23) == []
    assert periodic.runs(["a"] * 24) == [(0, 24, 1)]
    assert periodic.runs(w[:9] * 3) == [(0, 27, 9)] and periodic.runs((w[:9] * 3)[:-1]) == []
    assert periodic.runs(w[100:130] + w[:8] * 3 + w[130:140]) == [(30, 24, 8)]
    inner = (["a"] * 30 + ["b"]) * 4  # runs inside runs
    assert periodic.runs(inner) == brute_runs(inner) and len(periodic.runs(inner)) == 5
    kept = periodic.collapsed(inner, periodic.runs(inner))
    assert kept == ["a", "b"]  # the inner runs drop all but their first word, the outer one all but its first period


def test_long_texts_take_time_in_proportion():
    rng = np.random.default_rng(3)
    some = [f"w{x}" for x in rng.integers(0, 3_000, 60_000)]
    assert periodic.runs(["a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic.runs(some[:20_000] * 5 + some[:77]) == [(0, 100_077, 20_000)]
    assert periodic.runs(some + some[:10] * 4_000) == brute_tail(some, 10, 4_000)


def brute_tail(some, q, times):
    start = len(some)
    tail = some[:q]
    while some[start - 1] == tail[(start - 1 - len(some)) % q]:
        start -= 1
    return [(start, len(some) - start + q * times, q)]


def test_op12_equals_brute_force_with_edges(spark, sf_dir, tmp_path):
    base = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    docs = [(i, t if t is None else " ".join(WORD.findall(t)[:700])) for i, t in base]
    docs += [(None, "no id " * 20), (None, None)] + [(5_000 + k, t) for k, t in enumerate(ODD)] + [(1, "a b " * 30), (1, "a b " * 30)]
    picked = [k for k in range(200_000) if zlib.crc32(str(k).encode()) % 10 == 0][: len(ODD) + 2]
    docs += list(zip(picked, [*ODD, "x y z " * 3, " ".join(f"q{k}" for k in range(300))]))
    make(spark, docs, "doc_id long, text string").withColumn("runs", F.lit("clash")).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.op12_periodic_runs(spark, str(tmp_path))
    assert df.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = [tuple(r) for r in df.collect()]
    want = [brute_digest(i, WORD.findall(t or "")) for i, t in docs]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] for r in got) > 5


def test_periodic_runs_keep_columns_and_refuse_clashes(spark):
    df = make(spark, [(1, "a " * 30, "e"), (None, None, None)], "doc_id long, text string, start string")
    got = periodic.periodic_runs(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(None, None, None, [], ""), (1, "a " * 30, "e", [(0, 30, 1)], "a")]
    assert df.columns == ["doc_id", "text", "start"] and len(df.schema) == 3
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(df.withColumn("Runs", F.lit(1)))


# -- 13: passages --------------------------------------------------------------------------------


def brute_removed(texts, length):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for k in range(i, i + length)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("length, seed, vocabulary", [(35, 8, 4_000), (9, 3, 400), (6, 6, 60), (5, 1, 9), (7, 2, 2)])
def test_passages_equal_brute_force(spark, monkeypatch, length, seed, vocabulary):
    rng = np.random.default_rng(length)
    fresh = lambda n: [f"w{x}" for x in rng.integers(0, vocabulary, n)]
    shared = [fresh(length + int(k)) for k in (0, 0, 1, 7, 60, -1)]
    texts = []
    for _ in range(60):
        text = fresh(int(rng.integers(0, 90)))
        for _ in range(int(rng.integers(0, 3))):
            text += shared[int(rng.integers(len(shared)))] + fresh(int(rng.integers(0, 40)))
        texts.append(" ".join(text))
    texts += ODD + [texts[0], texts[0], " ".join(fresh(3 * length) * 2), "one " * (length + 1), "two " * length, "two  two\n" * (length // 2), " ".join(shared[1][1:]), " ".join(shared[1][:-1])]
    edit = fresh(3 * length)
    texts += [" ".join(edit), " ".join([*edit[:length], "other", *edit[length + 1 :]]), " ".join(["x"] + edit[1:-1] + ["y"])]
    rows = [(k, t, 1, "e", 0) for k, t in enumerate(texts)]
    df = make(spark, rows, "doc_id long, text string, k1 int, spans string, start int").repartition(4)
    got = {r["doc_id"]: r for r in passages.remove_repeats(df, length=length, seed=seed).collect()}
    for k, want in enumerate(brute_removed(texts, length)):
        r = got[k]
        assert (r["n_words"], r["n_removed"], r["kept"]) == want, k
        assert (r["text"], r["k1"], r["spans"], r["start"]) == (texts[k], 1, "e", 0)
        assert sum(s["stop"] - s["start"] for s in r["repeats"]) == r["n_removed"] and all(s["stop"] - s["start"] >= length for s in r["repeats"])


def test_passages_with_a_full_filter_are_the_same(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    want = sorted(tuple(r) for r in passages.remove_repeats(docs).select("doc_id", "n_removed", "kept").collect())
    monkeypatch.setattr(passages, "filter_of", lambda keys: np.full(passages.FILTER_BITS // 8, 255, np.uint8))
    assert sorted(tuple(r) for r in passages.remove_repeats(docs).select("doc_id", "n_removed", "kept").collect()) == want


def test_op13_equals_brute_force_on_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = sorted((d["doc_id"], n, k, sha(kept)) for d, (n, k, kept) in zip(docs, brute_removed([d["text"] for d in docs], passages.LENGTH)))
    got = sorted(tuple(r) for r in queries.op13_substring_dedup(spark, sf_dir).collect())
    assert got == want and any(0 < k < n for _, n, k, _ in got)


def test_passages_edges(spark):
    assert passages.remove_repeats(make(spark, [], DOCS)).count() == 0
    one = passages.remove_repeats(make(spark, [(1, "w " * 20_000, "en", "s")], DOCS)).first()
    assert (one["n_words"], one["n_removed"], one["kept"], [tuple(s) for s in one["repeats"]]) == (20_000, 20_000, "", [(0, 20_000)])
    same = make(spark, [(None, " ".join(f"w{k}" for k in range(50)), None, None)] * 300, DOCS).repartition(5)
    assert {(r["n_words"], r["n_removed"], r["kept"]) for r in passages.remove_repeats(same).collect()} == {(50, 50, "")}
    with pytest.raises(ValueError):
        passages.remove_repeats(same.withColumn("Kept", F.lit(1)))
    with pytest.raises(ValueError):
        passages.remove_repeats(same, length=5, seed=6)


def test_least_values_and_hashes_by_brute_force():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 9, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 28, 200):
        want = [a + int(np.argmin(v[a : a + width])) for a in range(len(v) - width + 1)]
        assert passages.leftmost_least(v, width).tolist() == want
    w = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    h = passages.Hashes(np.concatenate([w, w[:20], w]), passages._BASES[0])
    assert np.array_equal(h.of(np.arange(10), 10), h.of(np.arange(10) + 70, 10)) and len(set(h.of(np.arange(40), 10).tolist())) == 40


# -- mends of 5 and 6 ------------------------------------------------------------------------------


def test_mix_of_one_id_is_dealt_over_ranges(spark):
    """20,000 rows without an id, and as many of one id, are summed in several ranges and still meet the budget in order of size."""
    rows = [(None, "n " * (1 + k % 7), "a") for k in range(20_000)] + [(7, "n " * (1 + k % 5), "a") for k in range(20_000)] + [(k, "m " * 30, "b") for k in range(9_000)]
    df = make(spark, rows, "doc_id long, text string, source string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        got = mixing.mix(df).toPandas()
        at = mixing.dealt(df.withColumn("n", F.monotonically_increasing_id()), ["source"], [mixing.random_key(F.col("doc_id"), 0), F.col("n")])
        per = [r["count"] for r in at.where("doc_id is null").groupBy("range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per) > 1 and max(per) < 20_000
    assert len(got) == len(rows) and got.groupby("source")["taken"].sum().round().tolist() == [math.floor(t) for t in got.groupby("source")["target"].first()]
    assert ((got["taken"] >= 0) & (got["taken"] <= 3 * got["size"])).all()


def test_mix_of_very_great_sources_is_exact(spark):
    sizes = [("a", 10**18), ("b", 10**18), ("c", 3)]
    got = {r["source"]: r["target"] for r in mixing.targets(make(spark, sizes, "source string, source_size long"), (5, 2, 1)).collect()}
    assert got["c"] == 9 and got["a"] == pytest.approx(10 / 7 * 10**18, rel=1e-9) and got["b"] == pytest.approx(4 / 7 * 10**18, rel=1e-9)


def test_links_of_very_great_and_small_doubles(spark):
    rows = []
    for k, unit in enumerate((1.0, 1e200, 1e-200, 1e300)):
        rows += [(10 * k + 1, [unit, 2 * unit]), (10 * k + 2, [1.001 * unit, 2 * unit])]
    rows += [(90, [-1e200, 1e-200]), (91, [0.0, 0.0]), (92, [float("inf"), 1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_duplicates(make(spark, rows, "vec_id long, vec array<double>").withColumnRenamed("vec", vector_column(spark))).collect()}
    assert {v: n for v, (n, _) in got.items()} == {**{10 * k + j: 7 for k in range(4) for j in (1, 2)}, 90: 0, 91: 0, 92: 0}
    assert {got[v][1] for v in (1, 2, 11, 12, 21, 22, 31, 32)} == {1}


def vector_column(spark):
    return [f.name for f in table(spark, "/root/testdata/sf0.001", "embeddings").schema if f.dataType.typeName() == "array"][0]
