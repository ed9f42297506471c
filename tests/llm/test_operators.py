"""The operators against brute force on small tables, and their edge cases."""

import hashlib
import math
import os
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutweave.functions.storage import table
from cutweave.llm import bpe, chat, embeddings, fingerprints, jaccard, kernels, language_model, line_dedup, mixing, quality, queries, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def doc(i, text, source="s"):
    return (i, text, "en", source, None if text is None else len(text))


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{x}" for x in rng.integers(0, 500, n)]


ODD = [None, "", " ", "\n\n", "a", "A b", "née Σίσυφος ΣΑΣ", "x" * 5000, "e\u0301 \u00e9 \ufb01 \u2460", "it's 12 o'clock!!! <|endoftext|> tail", "日本語 テスト 😀😀", "\u1680a\u2028b\x85c\x1cd"]


# -- columns whose names the operators use themselves --------------------------------------------

OWN_NAMES = ("row", "version", "drop", "key", "tie", "size", "n", "copy", "taken", "range", "before", "here", "whole", "rest", "canon", "h", "bad", "encoded", "gone", "id", "class_id", "late", "part", "_n", "_size", "_copy", "_h", "_canon", "_drop", "_text", "_id", "_version", "_encoded", "_score", "_gone", "Text_2", "a.b", "c`d")
TAKE_ALL = {
    "op3": lambda df: line_dedup.remove_boilerplate(df),
    "op4": lambda df: bpe.encode_documents(df, queries.vocabulary()),
    "op6": lambda df: mixing.mixed_documents(df),
    "op7": lambda df: fingerprints.fingerprints(df),
    "op2": lambda df: jaccard.distinct_documents(df),
    "op10": lambda df: quality.score_documents(df, quality.Forest(0.0, 1, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))),
}


@pytest.mark.parametrize("op", sorted(TAKE_ALL))
def test_columns_with_working_names_come_through(spark, op):
    rows = [doc(i, f"shared line\nown {i} words of this text", f"s{i % 8}") for i in range(16)]
    df = make(spark, rows)
    plain = TAKE_ALL[op](df).count()
    for k, name in enumerate(OWN_NAMES):
        df = df.withColumn(name, F.concat(F.lit(f"{k}#"), F.col("doc_id")))
    out = TAKE_ALL[op](df)
    assert out.columns[: len(df.columns)] == df.columns
    got = out.collect()
    assert len(got) == plain > 0
    for r in got:
        for k, name in enumerate(OWN_NAMES):
            assert r[name] == f"{k}#{r['doc_id']}", name


# -- 1: URL filters ------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.NET/en/x?q#f", "https://sub.example.com/de/1", "x://org/fr/", "http://org/de/", "no scheme", None, "http://net", "http://evilnet/", "a://b://c/d", "http://H/É\n/x#y"]
    df = make(spark, [(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    model = url_filter.train(make(spark, [], "url string, label int"))
    got = {r["page_id"]: r for r in url_filter.filter_urls(df, model, queries.URL_RULES).collect()}

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path

    for i, u in enumerate(urls):
        host, path = parts(u)
        assert (got[i]["host"], got[i]["path"]) == (host, path)
        fits = [(len(r), r, a) for r, a in queries.URL_RULES if (h := r[: r.index("/")]) and (host == h or host.endswith("." + h)) and path.startswith(r[r.index("/") :])]
        want = max(fits)[1:] if fits else (None, "allow")
        assert (got[i]["rule"], got[i]["verdict"]) == want


def test_url_model_learns(spark):
    bad = [(f"http://spam{i % 7}.farm.biz/{i}/{i * 7919}?a={i}&b={i}", 1) for i in range(150)]
    good = [(f"https://www.site{i % 9}.org/about/page-{chr(97 + i % 26)}", 0) for i in range(150)]
    model = url_filter.train(make(spark, bad + good + [(None, 1), ("x", None)], "url string, label int"), trees=3)
    test = make(spark, [(1, "http://spam3.farm.biz/5/99991?a=1&b=2"), (2, "https://www.site3.org/about/page-z"), (3, None)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(test, model).collect()}
    assert got[1] == "block" and got[2] == "allow"


def test_url_edges(spark):
    model = url_filter.train(make(spark, [("http://a.b.com/x", 1), ("http://a.b.com/x", 1), ("http://c.org/", 0)] * 5, "url string, label int"), trees=2)
    schema = "page_id long, url string, _url string, _x int, Host string"
    assert url_filter.filter_urls(make(spark, [], schema), model, queries.URL_RULES).count() == 0
    long = "http://www." + "sub." * 3_000 + "example.net/" + "en/" * 30_000 + "?" + "a=1&" * 10_000
    rows = [(1, long, "kept", 3, "gone"), (1, long, "kept", 3, "gone"), (2, "http://x.net/q", None, None, None), (None, None, None, None, None)]
    out = url_filter.filter_urls(make(spark, rows, schema), model, [*queries.URL_RULES, ("example.net/en/", "block"), ("net/q", "allow"), ("x.net", "block")])
    got = out.select("page_id", "_url", "_x", "rule", "verdict", (F.col("block_probability") >= 0.5).alias("likely")).collect()
    # Equally long rules: the first by text (rule, then action) wins.
    none = [r for r in got if r["page_id"] is None]
    assert len(none) == 1 and none[0]["rule"] is None and none[0]["verdict"] == ("block" if none[0]["likely"] else "allow")
    assert sorted(tuple(r)[:5] for r in got if r["page_id"]) == [(1, "kept", 3, "example.net/en/", "allow")] * 2 + [(2, None, None, "net/q", "allow")]


def test_url_model_equals_walking(spark):
    """Probabilities of the query's model by plain Python over the same trees, features and suffix counts."""
    rng = np.random.default_rng(4)
    urls = [f"http://{'ab'[i % 2]}{rng.integers(4)}.site{rng.integers(5)}.{['com', 'org'][int(rng.integers(2))]}/p{'/q' * int(rng.integers(4))}/{rng.integers(10**6)}?x={i}&y=%20-{i}" for i in range(240)]
    rows = [(u, int(".org" in u) if rng.random() < 0.9 else 1) for u in urls]
    model = url_filter.train(make(spark, rows, "url string, label int"), trees=3)
    test = [*urls[:60], "http://new.host.net/", "no scheme", "", None, "http://a0.site1.com:80/x#y", "https://Ünï.de/é?z"]
    got = {r["page_id"]: r["block_probability"] for r in url_filter.filter_urls(make(spark, list(enumerate(test)), "page_id long, url string"), model).collect()}
    cut = lambda x: int(max(0, min(15, math.floor(x))))

    def host_path(u):
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    suffix = lambda h, k: ".".join(h.split(".")[-k:])
    n, pos = Counter(), Counter()
    for u, y in rows:
        for k in (1, 2, 3):
            n[k, suffix(host_path(u)[0], k)] += 1
            pos[k, suffix(host_path(u)[0], k)] += y
    for i, u in enumerate(test):
        u = u or ""
        host, path = host_path(u)
        query = (re.search(r"\?([^#]*)", u) or ["", ""])[1]
        digits = lambda x: len(re.findall("[0-9]", x))
        entropy = -sum(c / len(u) * math.log2(c / len(u)) for c in Counter(u).values())
        x = [len(u) / 8, len(host) / 3, len(path) / 3, path.count("/"), 16 * digits(u) / max(len(u), 1), 16 * digits(host) / max(len(host), 1), 3 * entropy, 1 + query.count("&") if query else 0, len(host.split(".")) if host else 0, u.count("-")]
        for k in (1, 2, 3):
            c = n.get((k, suffix(host, k)))
            x += [math.log2(1 + c), 15.999 * (pos[k, suffix(host, k)] + 0.5) / (c + 1)] if c else [0, -1]
        x = [cut(v) for v in x]
        margin = model.base
        for node in model.trees:
            while node.left is not None:
                node = node.left if x[node.feature] <= node.bin else node.right
            margin += node.value
        assert got[i] == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-9), u


# -- 2: n-gram Jaccard ---------------------------------------------------------------------------


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_jaccard(rows):
    sets = {i: shingles(t) for i, t in rows}
    links, parent = Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (find(i), links[i]) for i in ids}


def near_rows():
    rows, base = [], words(120, 1)
    for i in range(30):  # a large group of near copies, all different
        w = list(base)
        w[3 + i % 5] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(6)]
    for i in range(40):
        w = words(60, 100 + i)
        rows.append((200 + 2 * i, " ".join(w)))
        w[30 + i % 7 :: 40] = ["changed"] * len(w[30 + i % 7 :: 40])
        rows.append((201 + 2 * i, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "one two"), (303, "One  two\n"), (304, " "), (305, "one two three"), (306, "long " * 30_000)]
    return rows


@pytest.mark.parametrize("block,docs", [(256, 128), (8, 4)])
def test_jaccard_equals_brute_force(spark, block, docs):
    rows = near_rows()
    df = make(spark, [doc(i, t) for i, t in rows]).repartition(5)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df, block=block, docs=docs).collect()}
    assert got == brute_jaccard(rows)


def test_jaccard_edges(spark):
    assert jaccard.near_duplicates(make(spark, [])).count() == 0
    rows = [doc(None, "a b c d e f g"), doc(1, "a b c d e f g"), doc(1, "a b c d e f g"), doc(2, "a b c d e f g")]
    got = sorted(tuple(r) for r in jaccard.near_duplicates(make(spark, rows)).select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("class_id", F.lit(-1))).collect())
    assert got == [(-1, -1), (1, 1), (1, 1), (2, 1)]
    assert jaccard.distinct_documents(make(spark, rows)).count() == 3


def test_repeated_ids_are_documents_of_their_own(spark):
    base = words(80, 9)
    near = [list(base) for _ in range(6)]
    for k, w in enumerate(near):
        w[10 + k] = f"c{k}"
    rows = [(1, " ".join(base)), (1, " ".join(base)), (2, " ".join(near[0])), (2, " ".join(near[1])), (3, "far " + " ".join(words(50, 10))), (3, " ".join(near[2])), (4, None), (4, " ".join(near[3])), (0, " ".join(near[3])), (5, "long " * 20_000 + " ".join(words(30_000, 3)))]
    df = make(spark, [doc(i, t) for i, t in rows]).withColumn("id", F.lit("clash")).withColumn("doc", F.lit("clash")).withColumn("version", F.lit(0)).repartition(3)
    sets = [shingles(t) for _, t in rows]
    alike = [[i != j and bool(a & b) and len(a & b) >= 0.8 * len(a | b) - 1e-9 for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    label = [i for i, _ in rows]
    for _ in rows:
        label = [min([label[i], *(label[j] for j in range(len(rows)) if alike[i][j])]) for i in range(len(rows))]
    want = sorted((i, label[k], sum(alike[k])) for k, (i, _) in enumerate(rows))
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df).collect()) == want


def test_no_link_of_the_documents_is_lost(spark):
    """Every pair of similarity 0.8 or more in the whole table, by exact comparison, is found."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute_jaccard(rows)
    for filtered in (True, False):
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(docs, filtered=filtered).collect()}
        assert got == want


def test_bands_reach_the_recall():
    b = jaccard.bands_for(0.8, 4, 0.9999)
    assert 1 - (1 - 0.8**4) ** b >= 0.9999 > 1 - (1 - 0.8**4) ** (b - 1)


def test_smallest_reached():
    ids = np.array([50, 7, 9, 3, 8, 4])
    assert kernels.smallest_reached(ids, np.array([0, 1, 3]), np.array([1, 2, 4])).tolist() == [7, 7, 7, 3, 3, 4]


# -- 3: line dedup -------------------------------------------------------------------------------


def test_lines_equal_brute_force(spark):
    rows = [doc(i, f"own {i}\n  boiler \n\nshared {i % 3}\nboiler", f"site{i % 8}") for i in range(40)]
    rows += [doc(90, None), doc(91, ""), doc(None, "boiler\nx", "site1"), doc(92, "boiler", None), doc(93, "few\nboiler\r")]
    got = {r["doc_id"]: (r["text"], r["lines_removed"], r["n_chars"]) for r in line_dedup.remove_boilerplate(make(spark, rows).withColumn("lines_removed", F.lit("clash"))).collect()}
    strip = lambda x: x.strip(" \t\n\v\f\r")
    sites, first = {}, {}
    for i, t, _, s, _ in rows:
        if i is not None and t is not None:
            for line in t.split("\n"):
                if strip(line):
                    sites.setdefault(strip(line), set()).add(s)
                    first[strip(line)] = min(i, first.get(strip(line), i))
    bad = {x for x, s in sites.items() if len(s) >= line_dedup.SITES}
    for i, t, _, _, n in rows:
        kept = None if t is None else [x for x in t.split("\n") if i is None or strip(x) not in bad or first[strip(x)] == i]
        gone = 0 if t is None else len(t.split("\n")) - len(kept)
        want = t if not gone else "\n".join(kept)
        assert got[i] == (want, gone, n if not gone else len(want))
    assert bad == {"boiler", "shared 0", "shared 1", "shared 2"}
    twice = line_dedup.remove_boilerplate(make(spark, rows + [doc(0, "new\nboiler\nlines"), doc(39, "new\nboiler")])).where("doc_id in (0, 39)").collect()
    assert {r["text"] for r in twice} == {got[0][0], got[39][0], "new\nboiler\nlines", "new"}
    assert line_dedup.remove_boilerplate(make(spark, [])).count() == 0


# -- 4: BPE --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(spark, sf_dir, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(1000 + r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    rng = np.random.default_rng(3)
    pool = [chr(c) for c in [*range(1, 0x250), *range(0x370, 0x500), 0x300, 0x301, 0x1E9E, 0x2028, 0x3000, 0x1F600, 0x200D, 0xFE0F, 0x0130, 0x180E]]
    rows += [(5000 + i, "".join(rng.choice(pool, 60))) for i in range(300)]
    df = make(spark, rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r["doc_id"]: r for r in bpe.encode_documents(df, queries.vocabulary(), digests=True).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert list(got[i]["token_ids"]) == ids, (i, text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_words_of_every_code_point_equal_the_library(library):
    own = bpe.load(queries.vocabulary())

    def split(x):
        x = library.normalizer.normalize_str(x)
        return [x[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(x)]

    for c in [*range(1, 0xD800), *range(0xE000, 0x32000), *range(0xE0000, 0xE0200), 0x10FFFD]:
        ch = chr(c)
        for x in (f"a{ch}b", f"{ch}{ch} 1{ch}", f"e{ch}\u0301", f"a\u0323{ch}", unicodedata.normalize("NFD", ch)):
            assert own.split(x) == split(x), (hex(c), x)


def test_ids_of_blocks_of_code_points_equal_the_library(library):
    own = bpe.load(queries.vocabulary())
    for low in range(0, 0x32000, 64):
        text = " ".join(f"a{chr(c)}{chr(c)}b" for c in range(max(1, low), low + 64) if not 0xD800 <= c < 0xE000)
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, hex(low)


def test_bpe_edges(spark, library):
    rows = [(1, "same  text 😀"), (1, "same  text 😀"), (None, "x"), (2, "word " * 300_000), (3, "n" * 20_000)]
    df = make(spark, rows, "doc_id long, text string").withColumn("encoded", F.lit("kept")).withColumn("N_TOKENS", F.lit(1)).withColumn("a`b.c", F.lit(2))
    out = bpe.encode_documents(df, queries.vocabulary(), digests=True)
    assert out.columns[:4] == ["doc_id", "text", "encoded", "a`b.c"] and out.where("encoded = 'kept'").count() == len(rows)
    for r in out.collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert list(r["token_ids"]) == ids
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_documents(make(spark, []), queries.vocabulary()).count() == 0
    own = bpe.load(queries.vocabulary())
    assert own.decode([0, 10**6, -1, 49407]) == " ".join([own.tokens[0], own.tokens[49407]])


def test_bpe_cuts_and_pieces(library):
    own = bpe.load(queries.vocabulary())
    assert len(own.cuts("qxzzxqj")) > 1
    for w in ("aaaaaaaaaaaaaaaa", "internationalization", "qxzzxqj", "zqzqzq"):
        assert own.word_ids(w) == library.encode(w, add_special_tokens=False).ids == list(own.merge(w, True))
    text = ("some words " * 120_000)[: bpe.PIECE + 5000]
    assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_decode_column(spark, library):
    df = bpe.encode_documents(make(spark, [(1, "hello world"), (2, None)], "doc_id long, text string"), queries.vocabulary())
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(df, queries.vocabulary()).collect()}
    assert got == {1: library.decode(library.encode("hello world", add_special_tokens=False).ids, skip_special_tokens=False), 2: ""}


# -- 5: embeddings -------------------------------------------------------------------------------


def brute_links(rows, threshold=0.9):
    """(id, n_links, component, kept) of every row, each row a vector of its own, in double precision."""
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        v = np.array(v, np.float32).astype(float)
        return v / np.linalg.norm(v)

    u = [unit(v) for _, v in rows]
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            link[i, j] = link[j, i] = u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= threshold
    big = 1 << 60
    label = np.array([big if i is None else i for i, _ in rows])
    for _ in range(n):
        label = np.minimum(label, np.where(link, label[None, :], big).min(axis=1, initial=big))
    label = [None if x == big else int(x) for x in label]
    return sorted(((i, int(k), c, i == c) for (i, _), k, c in zip(rows, link.sum(axis=1), label)), key=str)


@pytest.mark.parametrize("block,small", [(65_536, 2_048), (40, 2_048), (65_536, 20)])
def test_embeddings_equal_brute_force(spark, block, small):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((150, 16)).astype(np.float32)
    x[60:100] = x[0] + 0.25 * rng.standard_normal((40, 16))
    x[100:130] = x[30:60] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [None] + [1.0] * 15), (904, [float("nan")] * 16), (905, [float("inf")] * 16), (906, [1.0] * 3), (907, [1.0] * 3), (908, [1e-30] * 16), (909, [1e30] * 16)]
    # Repeated rows and ids: the same vector, another one, a broken one; rows without an id.
    rows += rows[:1] * 3 + [(1, x[20].tolist()), (2, None), (2, [None] + [1.0] * 15), (None, x[140].tolist()), (None, [-1.0] * 16), (None, None), (777, [1.0, 0.0]), (777, [0.0, 1.0]), (778, [0.0, 1.0]), (779, [1.0, 0.0])]
    df = make(spark, rows, "vec_id long, embedding array<float>").withColumn("kept", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("a", F.lit(1)).repartition(5)
    got = [tuple(r) for r in embeddings.near_duplicates(df, block=block, small=small).collect()]
    assert sorted(got, key=str) == brute_links(rows)
    assert embeddings.near_duplicates(make(spark, [], "vec_id long, embedding array<float>")).count() == 0


def test_crowded_tiles_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    x = 1 + 0.32 * rng.standard_normal((300, 8))  # many pairs on both sides of the threshold
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(300), x.astype(np.float32))]
    got = [tuple(r) for r in embeddings.near_duplicates(make(spark, rows, "vec_id long, embedding array<float>")).collect()]
    assert sorted(got, key=str) == brute_links(rows)


def test_quantisation_bound():
    rng = np.random.default_rng(0)
    u = rng.standard_normal((50, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    q, s, l, e = embeddings.quantised(u)
    approx = (q * s[:, None]) @ (q * s[:, None]).T
    assert (np.abs(u @ u.T - approx) <= e[:, None] * l[None, :] + e[None, :] + 1e-12).all()


# -- 6: mixing -----------------------------------------------------------------------------------


def water(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return {s: t.get(s, 3.0 * sizes[s]) for s in order}
        capped |= over


def mix_rows():
    rng = np.random.default_rng(2)
    rows = [doc(i, " ".join(["w"] * int(rng.integers(0, 40))), f"s{min(int(rng.exponential(2)), 6)}") for i in range(400)]
    return rows + [doc(900, None, "s1"), doc(901, "a b", None), doc(902, "", "empty"), doc(None, "x y z", "s0"), doc(903, "v " * 5000, "s5"), doc(4, "dup", "s0"), doc(4, "dup", "s0")]


def test_mix_targets_and_budgets(spark):
    rows = mix_rows()
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    got = mixing.mix(make(spark, rows).repartition(7)).toPandas()
    again = mixing.mix(make(spark, rows).repartition(2)).toPandas()
    key = ["source", "doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    for s, t in want.items():
        own = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert own["target"].iloc[0] == pytest.approx(t) and own["source_size"].iloc[0] == sizes[s]
        assert own["taken"].sum() == math.floor(t + 1e-9)
    assert mixing.mix(make(spark, [])).count() == 0


def test_mixed_documents_hold_the_budget(spark):
    rows = mix_rows()
    taken = mixing.mix(make(spark, rows)).toPandas()
    out = mixing.mixed_documents(make(spark, rows)).toPandas()
    assert list(out.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    n = out["text"].map(lambda t: len(t.split()))
    assert n.sum() == taken["taken"].sum()
    assert (out["n_chars"] == out["text"].map(len)).all()


def test_every_row_has_a_budget(spark):
    """Rows that repeat an id, with the same text, with others of the same size, or without an id."""
    rows = [doc(None, f"null id text number{i % 9} " + "w " * 11, "a") for i in range(40)] + [doc(7, "seven words are in this very text", "a")] * 5 + [doc(8, f"other words of size five{i}", "a") for i in range(5)]
    rows += [doc(100 + i, "b " * (5 + i % 7), "b") for i in range(60)] + [doc(300 + i, "c " * 20, "c") for i in range(20)]
    texts = None
    for parts in (1, 6):
        df = make(spark, rows).repartition(parts)
        taken, out = mixing.mix(df).toPandas(), mixing.mixed_documents(df).toPandas()
        out["words"] = out["text"].map(lambda t: len(t.split()))
        assert out.groupby("source")["words"].sum().to_dict() == taken.groupby("source")["taken"].sum().to_dict()
        assert texts in (None, sorted(out["text"]))
        texts = sorted(out["text"])
    assert mixing.mixed_documents(make(spark, [])).count() == 0


# -- 7: fingerprints -----------------------------------------------------------------------------


def folded(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())
    return " ".join(re.split(r"\s+", t)).strip()


def test_fingerprints_and_edits(spark):
    texts = ODD[:-1] + ["Straße", "STRASSE", "  ﬁne\tday ", "fine DAY", "abc", "abcabc", "", "zz"]
    rows = [doc(7 * i + 3, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(make(spark, rows).repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    by = {}
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["near_edited"] == float(folded(t) == folded(edited)) and r["near_next"] == float(folded(t) == folded(nxt))
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (folded(t) == folded(edited))
        by.setdefault(folded(t), set()).add(r["fingerprint"])
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


def test_fingerprint_edges(spark):
    assert fingerprints.compare_edited(make(spark, [])).count() == 0
    one = fingerprints.compare_edited(make(spark, [doc(5, "abcd")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    rows = [doc(None, "x"), doc(None, "x"), doc(1, "y"), doc(1, "y")]
    assert fingerprints.compare_edited(make(spark, rows)).count() == 4
    kept = fingerprints.fingerprints(make(spark, rows).withColumn("fingerprint", F.lit(1)))
    assert kept.select("fingerprint").distinct().count() == 2


@pytest.mark.parametrize("level", [1, 2])
def test_next_over_many_chunks(spark, monkeypatch, level):
    monkeypatch.setattr(fingerprints, "LEVEL", level)
    ids = sorted({int(x) for x in np.random.default_rng(4).integers(-50, 100_000, 200)} | {5, 6, 7})
    df = make(spark, [(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(df, ["text"], "doc_id", rows=7).collect()}
    assert got == {i: f"t{ids[k - 1]}" for k, i in enumerate(ids)}


def test_next_with_hot_and_null_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), f"t{i}") for i in rng.permutation(300)] + [(None, f"n{i % 150}") for i in range(200)] + [(77, f"hot{i}") for i in range(150)] + [(5, "t5")] * 3
    df = make(spark, rows, "doc_id long, text string").withColumn("tie", F.lit(1)).withColumn("part", F.lit("x")).repartition(4)
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    want = sorted((str(i), t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    for size in (5, 40, 100_000):
        got = sorted((str(r["doc_id"]), r["text"], r["next_text"]) for r in fingerprints.with_next(df, ["text"], "doc_id", rows=size).collect())
        assert got == want, size
    # A hot id is cut into several chunks.
    number, part = fingerprints.chunks(df, "doc_id", F.xxhash64("text"), 10)
    assert df.where("doc_id is null or doc_id = 77").select("doc_id", number.alias("n"), part.alias("p")).distinct().count() >= 20


def test_collisions_are_told_apart(spark):
    df = make(spark, [("h", "a"), ("h", "b"), ("g", "c"), ("g", "c")], "h string, canon string")
    bad = fingerprints.collided(df)
    assert [r["h"] for r in bad.collect()] == ["h"]
    assert {r["h"] for r in fingerprints.told_apart(df, bad, "h", "canon").collect()} == {"g", "h-" + hashlib.sha256(b"a").hexdigest(), "h-" + hashlib.sha256(b"b").hexdigest()}


# -- 8: language model ---------------------------------------------------------------------------


@pytest.mark.parametrize("head", [1_000_000, 20])
def test_base_scores_equal_brute_force(spark, sf_dir, head):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").limit(60).collect()] + [(90_001, None), (90_002, "neverseen NEVERSEEN ok"), (None, "The"), (90_003, " ")]
    df = make(spark, rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language_model.score(df, head=head).collect()}
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    total, types = sum(count.values()), len(count)
    for i, t in rows:
        r, w = got[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(count[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 1) / (total + types + 1)) for x in w), rel=1e-9)
        assert r["score"] < 0


def test_gru_gradient_and_state():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, language_model.MEMBERS, n).astype(np.int32) for n in (40, 3, 17, 1)]
    gru = language_model.Gru.fresh(3)
    whole = gru.score(docs)
    for d, got in zip(docs, whole):  # the state is carried: the same as step by step
        s, want = np.zeros((1, language_model.HIDDEN), np.float32), 0.0
        for y in d:
            want += gru.log_probabilities(s, np.array([y]))[0]
            s = gru.step(s, np.array([y]))[0]
        assert got == pytest.approx(want / math.log(10), rel=1e-4)
    y = rng.integers(0, language_model.MEMBERS, (2, 5))
    grads = []
    trainer = language_model.Trainer(language_model.Gru(gru.flat), 0.01)
    trainer.apply = grads.append
    trainer.window(np.zeros((2, language_model.HIDDEN), np.float32), y, np.ones((2, 5), bool))
    loss = lambda f: -math.log(10) * language_model.Gru(f).score(list(y)).sum() / y.size
    at = np.argsort(-np.abs(grads[0]))[[0, 5, 50, 300]]
    for k in at:
        up, down = gru.flat.copy(), gru.flat.copy()
        up[k] += 0.01
        down[k] -= 0.01
        assert grads[0][k] == pytest.approx((loss(up) - loss(down)) / 0.02, rel=0.05, abs=2e-4)


def test_lm_distribution_sums_to_one(spark):
    lex, _ = language_model.lexicon(make(spark, [("a b b c",), ("a zebra xylo d",)], "text string"), head=2)
    for k in range(language_model.FIRST_BUCKET, language_model.MEMBERS):
        if seen := lex.member_types[k]:
            mass = (lex.member_tokens[k] + seen + 1) / (lex.member_tokens[k] + lex.member_types[k] + 1)
            assert mass == 1  # known words' counts plus one each, and one for the unseen
    gru = language_model.Gru.fresh(1, lex.member_tokens)
    s = gru.step(np.zeros((1, language_model.HIDDEN), np.float32), np.array([5]))[0]
    every = np.arange(language_model.MEMBERS)
    assert np.exp(gru.log_probabilities(np.repeat(s, len(every), axis=0), every)).sum() == pytest.approx(1, rel=1e-5)
    # Both factors follow the state.
    other = gru.step(s, np.array([9]))[0]
    for part in (every[: language_model.SIZE], every[:: language_model.SIZE]):
        one, two = (gru.log_probabilities(np.repeat(x, len(part), axis=0), part) for x in (s, other))
        assert np.ptp(one - two) > 1e-4
    assert language_model.score(make(spark, [], "doc_id long, text string")).count() == 0


def brute_lm(texts, training, lex, weights):
    """log10 probabilities of whole texts, token by token in double precision."""
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    count = Counter(w for t in training for w in tokens(t))
    g = language_model.Gru.__new__(language_model.Gru).view(np.asarray(weights, float))
    H, size, first = language_model.HIDDEN, language_model.SIZE, language_model.FIRST_BUCKET
    member = lambda w: 0 if w is None else int(lex.look_up(__import__("pyarrow").array([w], "large_string"))[1][0])
    bucket_tokens, bucket_types = Counter(), Counter()
    for w, c in count.items():
        bucket_tokens[member(w)] += c
        bucket_types[member(w)] += 1
    log_softmax = lambda e, k: e[k] - math.log(np.exp(e).sum())
    out = []
    for t in texts:
        s, total = np.zeros(H), 0.0
        for w in [*tokens(t), None]:
            y = member(w)
            c, k = divmod(y, size)
            total += log_softmax(s @ g.O + g.b, c) + log_softmax(s @ g.M[c] + g.m[c], k)
            if y >= first:
                total += math.log((count[w] + 1) / (bucket_tokens[y] + bucket_types[y] + 1))
            a = s @ g.U
            z, r = (1 / (1 + np.exp(-(a[i : i + H] + g.X[y][i : i + H]))) for i in (0, H))
            n = np.tanh(g.X[y][2 * H :] + r * a[2 * H :])
            s = n + z * (s - n)
        out.append(total / math.log(10))
    return out


def test_lm_scores_equal_brute_force_and_ignore_the_layout(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 4_000)
    monkeypatch.setattr(language_model, "GROUP", 1_500)
    docs = [(r["doc_id"], r["text"][:3_000]) for r in table(spark, sf_dir, "documents").orderBy("doc_id").limit(80).collect() if r["text"]]
    docs += [(1, "again " * 3_000), (1, "a word"), (1, "a word"), (None, "nameless words"), (None, None), (7_001, "unheardof " * 5 + "zzzyx")]
    df = make(spark, docs, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("uid", F.lit(0))
    seen = []
    real = language_model.train
    monkeypatch.setattr(language_model, "train", lambda training, lex, **kw: seen.append((lex, w := real(training, lex, **kw))) or w)
    runs = [language_model.score(df.repartition(n), head=60).toPandas().sort_values(["doc_id", "n_tokens", "score"]).reset_index(drop=True) for n in (2, 7, 31)]
    for k in (1, 2):
        assert np.array_equal(seen[0][1], seen[k][1])
        pd.testing.assert_frame_equal(runs[0], runs[k], rtol=1e-12)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    want = pd.DataFrame({"doc_id": [i for i, _ in docs], "want": brute_lm([t for _, t in docs], [t for i, t in docs if not held(i)], *seen[0])})
    key = lambda f, c: sorted(zip(f["doc_id"].fillna(-1), f[c].round(1)))
    got = runs[0]
    for (i, a), (j, b) in zip(key(got, "score"), key(want, "want"), strict=True):
        assert i == j and a == pytest.approx(b, rel=1e-3, abs=0.2)


def test_lm_scores_do_not_depend_on_neighbours():
    rng = np.random.default_rng(3)
    gru = language_model.Gru(language_model.Gru.fresh(1).flat * 2)
    docs = [rng.integers(0, language_model.MEMBERS, int(n)).astype(np.uint16) for n in rng.integers(1, 400, 60)]
    together, alone = gru.score(docs), [gru.score([d])[0] for d in docs]
    assert np.array_equal(together, alone) and np.array_equal(together[::-1], gru.score(docs[::-1]))


def test_lm_least_count_holds_its_bound_for_any_counts(spark):
    rng = np.random.default_rng(5)
    n = [*rng.integers(1, 40, 300).tolist(), *rng.integers(99_990, 100_060, 50).tolist(), *[10**15 + int(k) for k in rng.integers(0, 5_000, 40)], 10**15, 10**15]
    df = make(spark, [(int(x),) for x in n], "n long")
    for most in (0, 1, 2, 41, 42, 60, 92, 200, 391, 392, 500):
        want = next(c for c in sorted({1, *[x + 1 for x in n]}) if sum(x >= c for x in n) <= most)
        got = language_model.least_count(df, most)
        assert sum(x >= got for x in n) == sum(x >= want for x in n) and got >= 1, (most, got, want)
    words = make(spark, [("aa " * 100_050 + "bb " * 100_050 + "cc " * 100_050 + "dd",)], "text string")
    lex, rare = language_model.lexicon(words, head=2)
    assert len(lex.words) == 0 and rare.count() == 4


def test_lm_beats_unigrams_on_held_out(spark):
    rng = np.random.default_rng(0)
    langs = [[f"{a}{b}{e}" for a in "kmt" for b in "aeiou"] for e in ("na", "ix", "ul")]
    docs = [(i, " ".join(rng.choice(langs[i % 3], 40))) for i in range(300)]
    got = language_model.score(make(spark, docs, "doc_id long, text string")).where("held_out").toPandas()
    assert len(got) > 20 and got["score"].sum() > got["base_score"].sum() + 10


# -- 9: chat -------------------------------------------------------------------------------------


def brute_chat(rows, chunk):
    """(conv_id, n_turns, n_equal, part, text) of rows (conv_id, turn, role, text)."""
    groups: dict = {}
    for k, (c, turn, r, t) in enumerate(rows):
        groups.setdefault(("row", k) if c is None else ("conv", c), []).append((turn, r, t))
    none_first = lambda x: tuple((v is not None, v if v is not None else 0) for v in x)
    conv = {k: sorted(x, key=none_first) for k, x in groups.items()}
    said = {k: tuple((r, t) for _, r, t in x) for k, x in conv.items()}
    heads = {x[:n] for x in said.values() for n in range(1, len(x))}
    out = []
    for x in set(said.values()) - heads:
        same = sorted((k for k in conv if said[k] == x), key=lambda k: (k[0] == "row", k[1]))
        parts: dict = {}
        for turn, r, t in conv[same[0]]:
            parts.setdefault(None if same[0][0] == "row" or turn is None else turn // chunk, []).append(f"<|{'unknown' if r is None else r}|>\n{t or ''}\n")
        for n, key in enumerate(sorted(parts, key=lambda k: (k is not None, k or 0))):
            out.append((same[0][1] if same[0][0] == "conv" else None, len(x), len(same), n, "".join(parts[key])))
    return sorted(out, key=str)


CHAT = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("chunk", [1024, 2, 1])
def test_chat_equals_brute_force(spark, chunk):
    a = [("user", "hi"), ("assistant", "hello"), ("user", "bye")]
    conv = {1: a[:1], 2: a[:2], 3: a, 4: a, 5: a[:2] + [("user", "other")], 6: [("user", "hi"), ("assistant", None)], 7: [(None, "x")], 8: [("user", "hib")], 9: [("user", "")], 10: [("user", None)], 11: [("", "x")], 12: [("user", f"t{k}") for k in range(40)], 13: [("user", f"t{k}") for k in range(39)]}
    rows = [(c, k, r, t) for c, turns in conv.items() for k, (r, t) in enumerate(turns)]
    rows += [(14, k + 5, r, t) for k, (r, t) in enumerate(a)]  # the same turns under other numbers
    rows += [(15, None, "user", "late"), (15, 0, "user", "first"), (16, 3, "b", "equal"), (16, 3, "a", "turns"), (16, 3, "a", "turns"), (16, 3, None, None)]
    rows += [(None, 0, "user", "nobody"), (None, 0, "user", "nobody"), (None, 1, "user", "hi"), (None, None, None, None), (None, 0, None, "x")]
    df = make(spark, [(*r, "e", 1, 1) for r in rows[::-1]], CHAT + ", n_turns string, rank int, chunk int").repartition(3)
    got = [tuple(r) for r in chat.collapse(df, chunk=chunk).collect()]
    assert sorted(got, key=str) == brute_chat(rows, chunk)
    assert chat.collapse(make(spark, [], CHAT)).count() == 0


def test_huge_conversation_comes_in_parts(spark):
    rows = [(7, k, "user", f"turn {k}") for k in range(5_000)] + [(8, k, "user", f"turn {k}") for k in range(4_999)]
    got = chat.collapse(make(spark, rows, CHAT)).orderBy("part").collect()
    assert [r["part"] for r in got] == list(range(5)) and {(r["conv_id"], r["n_turns"]) for r in got} == {(7, 5_000)}
    assert "".join(r["text"] for r in got) == "".join(f"<|user|>\nturn {k}\n" for k in range(5_000))


def test_chat_sql_on_odd_rows(spark):
    import duckdb

    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 2000, "user", "b"), (None, 0, "user", "a"), (None, 0, None, None), (None, 5, None, None), (3, 0, None, "x"), (3, 0, None, "x")]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = con.execute(queries.OP9_SQL)
    names = [c[0] for c in found.description]
    want = [tuple(r) for r in found.fetchall()]
    got = [tuple(r[c] for c in names) for r in chat.collapse(make(spark, rows, CHAT)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) == sorted([tuple(dict(zip(("conv_id", "n_turns", "n_equal", "part", "text"), r))[c] for c in names) for r in brute_chat(rows, 1024)], key=str)


# -- 10: quality ---------------------------------------------------------------------------------


def test_quality_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op10_quality_classifier(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert len(got) > 40
    assert (got["predicted"] == got["quality"]).mean() > 0.93


def test_quality_edges(spark):
    docs = make(spark, [doc(i, t) for i, t in enumerate(ODD)] + [doc(None, "x")])
    labels = make(spark, [(0, 1), (1, 0), (1, 0), (2, None), (None, 1), (3, 7), (4, 1)], "doc_id long, quality int")
    forest = quality.train(docs, labels)
    out = quality.score_documents(docs.withColumn("score", F.lit("clash")), forest).toPandas()
    assert len(out) == len(ODD) + 1 and out["score"].between(0, 1).all()
    empty = quality.train(docs, labels.where("false"))
    assert quality.score_documents(docs, empty).select("score").distinct().count() == 1
    assert quality.score_documents(make(spark, []), empty).count() == 0


def plain_statistics(t):
    """The statistics of a text, one by one."""
    if not t:
        return [0.0] * len(quality.NAMES)
    w, n = t.split(), max(1, len(t.split()))
    size = [len(x) for x in w] or [0]
    lines = [x for x in t.split("\n") if x.strip()]
    m, mean = max(1, len(lines)), sum(size) / len(size)
    white = sum(c <= " " for c in t)
    shown = max(1, len(t) - white)
    among = lambda f: sum(map(f, t)) / shown
    symbols = "#$%&*+<=>@[\\]^_`{}~/"
    named_ = lambda c: c in symbols + "!|,.;:?" or c <= " " or c >= "\x80" or c.isalnum()
    return [
        math.log1p(len(t)), math.log1p(len(w)), mean, math.sqrt(sum((x - mean) ** 2 for x in size) / len(size)), sum(x > 12 for x in size) / len(size), sum(x <= 3 for x in size) / len(size),
        len(set(w)) / n, len(set(zip(w, w[1:]))) / max(1, len(w) - 1), max(Counter(w).values(), default=0) / n,
        math.log1p(len(lines)), math.log1p(len(t) / m), len(set(lines)) / m,
        among(lambda c: "a" <= c <= "z"), among(lambda c: "A" <= c <= "Z"), among(lambda c: "0" <= c <= "9"), among(lambda c: not named_(c)), among(lambda c: c >= "\x80"),
        among(lambda c: c in symbols), among(lambda c: c == "!"), among(lambda c: c == "|"), among(lambda c: c in ",.;:?"),
        sum(not x[-1].isalnum() and x[-1] not in ".,;:?!'\")" for x in w) / n, sum(x.isupper() and len(x) > 1 for x in w) / n,
        sum(x.lstrip()[:1] in tuple("-*•·#>|") for x in lines) / m, sum(x.rstrip()[-1] not in ".!?" for x in lines) / m,
    ]


def test_statistics_and_scores_equal_plain_python(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()] + [(900_000 + i, t) for i, t in enumerate(ODD)] + [(1, "again"), (1, "again"), (910_000, "word " * 100_000)]
    for _, t in rows:
        assert quality.statistics(t) == pytest.approx(plain_statistics(t), rel=1e-9), t
    docs, labels = make(spark, rows, "doc_id long, text string"), table(spark, sf_dir, "labels")
    forest = quality.train(docs, labels)
    assert len(forest.value) and all(np.array_equal(a, b) for a, b in zip((forest.feature, forest.limit, forest.value), (lambda f: (f.feature, f.limit, f.value))(quality.train(docs.repartition(5), labels))))
    got = Counter((r["doc_id"], round(r["score"], 9)) for r in quality.score_documents(docs, forest).collect())
    want: Counter = Counter()
    for i, t in rows:
        x, margin = plain_statistics(t), forest.base
        for f, lim, val in zip(forest.feature, forest.limit, forest.value):
            k = 0
            for _ in range(forest.depth):
                k = 2 * k + 1 + (x[f[k]] > lim[k])
            margin += val[k - (2**forest.depth - 1)]
        want[i, round(1 / (1 + math.exp(-margin)), 9)] += 1
    assert sum((got - want).values()) <= 2  # a statistic may lie on a limit


def test_flat_forest_equals_walking():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 6))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = quality.fit(x, y, trees=10, depth=3)
    for row, got in zip(x[:50], forest.margin(x[:50])):
        want = forest.base
        for f, lim, val in zip(forest.feature, forest.limit, forest.value):
            i = 0
            for _ in range(3):
                i = 2 * i + 1 + (row[f[i]] > lim[i])
            want += val[i - 7]
        assert got == pytest.approx(want)
    assert ((forest.score(x) > 0.5) == y).mean() > 0.85


def test_lm_states_are_rounded_once_for_all_products():
    """Products of states that were rounded before are those of the states, bit for bit; scoring rounds once a step."""
    gru = language_model.Gru.fresh(3).fixed()
    states = np.tanh(np.random.default_rng(3).standard_normal((300, language_model.HIDDEN))).astype(np.float32)
    rounded = language_model._rounded(states)
    for weights in (gru.U, gru.O, gru.M[5]):
        assert np.array_equal(language_model._exact_product(rounded, weights), language_model._product(states, weights))
        assert np.array_equal(language_model._product(rounded, weights), language_model._product(states, weights))
    y = np.arange(300)
    whole, *saved = gru.step(states, y)
    assert np.array_equal(gru.onward(states, language_model._exact_product(rounded, gru.U), y)[0], whole)
    assert all(x.flags.c_contiguous for x in saved)
