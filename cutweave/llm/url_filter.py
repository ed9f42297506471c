"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

Everything is DataFrame expressions.  Training grows depth-limited regression trees from
histograms of (node, feature, bin) gradient sums, one aggregation a level, over a bounded sample
of labelled URLs; the suffix statistics are counted over all of them.  A trained model is a column expression of nested
CASE WHENs, so scoring is a projection over the ``url`` column, with a join of the suffix statistics.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cutweave.functions.columns import named
from cutweave.functions.storage import materialise, scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER_SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Bins of every feature are 0 to 15.
TOP_BIN = 15
#: Labelled URLs that one model's trees are grown on, at most.
SAMPLE = 20_000
#: Suffixes whose statistics may be broadcast (short strings and two numbers each); beyond, a shuffled join.
BROADCAST_ROWS = 100_000
#: Suffix statistics cover the last one, two and three labels of a host.
SUFFIXES = (1, 2, 3)
MAX_RULES = 5_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, action); null if none does.

    A rule ``example.net/en/`` fits host ``example.net`` and its subdomains when the path starts
    with ``/en/``.  The rules are literals, so their number is bounded by ``MAX_RULES``.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} fit into one expression")
    fits = []
    for text, action in sorted(set(rules), key=lambda r: (-len(r[0]), r)):
        at = text.find("/")
        rule_host, rule_path = (text[:at], text[at:]) if at >= 0 else (text, "")
        on_host = (host == rule_host) | host.endswith("." + rule_host)
        fits.append((on_host & path.startswith(rule_path), F.struct(F.lit(text).alias("rule"), F.lit(action).alias("action"))))
    if not fits:
        return F.lit(None).cast("struct<rule:string,action:string>")
    out = F.when(*fits[0])
    for fit in fits[1:]:
        out = out.when(*fit)
    return out


def suffix_of(host: Column, labels: int) -> Column:
    """The last ``labels`` labels of a host (all of it, if it has fewer)."""
    return F.substring_index(host, ".", -labels)


def _entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of ``text``."""
    n = F.char_length(text)
    each = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: (n - F.char_length(F.replace(text, c, F.lit("")))) / n,
    )
    return F.aggregate(each, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def _bin(x: Column) -> Column:
    return F.least(F.lit(TOP_BIN), F.greatest(F.lit(0), F.floor(x))).cast("int")


#: Names of the lexical features, in the order of the array that features() makes.
FEATURES = ("url length", "host length", "path length", "path depth", "digit ratio", "host digit ratio", "entropy", "parameters", "host labels", "hyphens") + tuple(
    f"{what}, suffix of {k}" for k in SUFFIXES for what in ("log count", "positive rate")
)


def features(url: Column, host: Column, path: Column, suffix: Sequence[Column]) -> Column:
    """Array of binned features; ``suffix`` has struct(n, rate) for each of SUFFIXES, or null where unseen."""
    url = F.coalesce(url, F.lit(""))
    n, hosts = F.char_length(url), F.char_length(host)
    digits = lambda x: F.char_length(F.regexp_replace(x, "[^0-9]", ""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    out = [
        n / 8,
        hosts / 3,
        F.char_length(path) / 3,
        F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit(""))),
        16 * digits(url) / F.greatest(n, F.lit(1)),
        16 * digits(host) / F.greatest(hosts, F.lit(1)),
        3 * F.when(n > 0, _entropy(url)).otherwise(0.0),
        F.when(query == "", 0).otherwise(1 + F.char_length(query) - F.char_length(F.replace(query, F.lit("&"), F.lit("")))),
        F.when(host == "", 0).otherwise(F.size(F.split(host, r"\."))),
        F.char_length(url) - F.char_length(F.replace(url, F.lit("-"), F.lit(""))),
    ]
    for s in suffix:
        out += [F.coalesce(F.log2(1 + s["n"]), F.lit(0.0)), F.coalesce(15.999 * s["rate"], F.lit(-1.0))]
    return F.array(*[_bin(x) for x in out])


@dataclass
class Node:
    """A split on ``feature``: bins up to ``bin`` go left; or a leaf with ``value``."""

    value: float = 0.0
    feature: int = -1
    bin: int = 0
    left: "Node | None" = None
    right: "Node | None" = None

    def column(self, x: Column) -> Column:
        if self.left is None:
            return F.lit(float(self.value))
        return F.when(x[self.feature] <= self.bin, self.left.column(x)).otherwise(self.right.column(x))

    def number(self, x: Column, at: int = 1) -> Column:
        """The heap number of the leaf that a row reaches."""
        if self.left is None:
            return F.lit(at)
        return F.when(x[self.feature] <= self.bin, self.left.number(x, 2 * at)).otherwise(self.right.number(x, 2 * at + 1))

    def leaves(self, at: int = 1) -> dict[int, "Node"]:
        return {at: self} if self.left is None else self.left.leaves(2 * at) | self.right.leaves(2 * at + 1)


@dataclass
class UrlModel:
    """Boosted trees with the suffix statistics of all labelled URLs."""

    base: float
    trees: list[Node] = field(default_factory=list)
    #: For each of SUFFIXES: rows (suffix, n, positives), and whether they are few enough to be broadcast.
    suffixes: list[tuple[DataFrame, bool]] = field(default_factory=list)

    def margin(self, x: Column) -> Column:
        out = F.lit(float(self.base))
        for tree in self.trees:
            out = out + tree.column(x)
        return out


def _with_features(df: DataFrame, tables: Sequence[tuple[DataFrame, bool]], own_label: Column | None = None) -> DataFrame:
    """Adds ``_x``; with ``own_label`` a row's own label is left out of its suffixes' rates."""
    held = []
    for k, (t, small) in zip(SUFFIXES, tables, strict=True):
        # One row a suffix on the right, so a suffix of a third of all URLs can be split on the left.
        t = t.select(F.col("suffix").alias(f"_suffix{k}"), F.struct("n", "positives").alias(f"_s{k}"))
        df = df.withColumn(f"_suffix{k}", suffix_of(F.col("_host"), k)).join(F.broadcast(t) if small else t, f"_suffix{k}", "left")
        n, pos = F.col(f"_s{k}.n"), F.col(f"_s{k}.positives")
        if own_label is not None:
            n, pos = n - 1, pos - own_label
        held.append(F.struct(n.alias("n"), ((pos + 0.5) / (n + 1)).alias("rate")))
    df = df.withColumn("_x", features(F.col("_url"), F.col("_host"), F.col("_path"), held))
    return df.drop(*[c for k in SUFFIXES for c in (f"_suffix{k}", f"_s{k}")])


def train(
    labelled: DataFrame, *, trees: int = 8, depth: int = 2, rate: float = 0.5, sample: int = SAMPLE, least: float = 5.0, l2: float = 1.0
) -> UrlModel:
    """Fit on ``labelled(url, label)``; label 1 means block.

    Null urls or labels are left out; repeated rows count each.  Suffixes are counted over all rows; of more than
    ``sample`` rows, those with the smallest hashes of (url, label) are what the trees are grown on.  An empty table gives
    a model that never blocks.
    """
    with scratch() as own:
        return _trained(own, labelled, trees, depth, rate, sample, least, l2)


def _trained(own, labelled: DataFrame, trees: int, depth: int, rate: float, sample: int, least: float, l2: float) -> UrlModel:
    rows = labelled.where("url is not null and label is not null").select(F.col("url").alias("_url"), F.col("label").cast("double").alias("_y"))
    hosts = rows.select(host_of(F.col("_url")).alias("host"), "_y")
    tables = []
    for k in SUFFIXES:
        t = own.keep(materialise(hosts.groupBy(suffix_of(F.col("host"), k).alias("suffix")).agg(F.count("*").alias("n"), F.sum("_y").alias("positives")), "url-suffix"))
        tables.append((t, t.count() <= BROADCAST_ROWS))
    rows = rows.orderBy(F.xxhash64("_url", "_y"), "_url", "_y").limit(sample)
    rows = rows.withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    rows = materialise(rows, "url-sample")
    data = materialise(_with_features(rows, tables, F.col("_y")).select("_x", "_y").coalesce(8), "url-train")
    n, positives = data.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0.0))).first()
    prior = min(max((positives + 0.5) / (n + 1), 1e-4), 1 - 1e-4) if n else 1e-4
    model = UrlModel(math.log(prior / (1 - prior)), [], tables)
    if not n or not 0 < positives < n:
        return model
    # Rows with the same bins and label behave alike, so only their number matters.
    data = materialise(data.groupBy("_x", "_y").agg(F.count("*").alias("_n")).coalesce(4), "url-bins")
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.margin(F.col("_x"))))
        root = Node()
        graded = data.select("_x", (F.col("_n") * (F.col("_y") - p)).alias("_g"), (F.col("_n") * p * (1 - p)).alias("_h"))
        for level in range(depth):
            open_nodes = {at: leaf for at, leaf in root.leaves().items() if at >= 1 << level}
            if not open_nodes:
                break
            sums = (
                graded.select(root.number(F.col("_x")).alias("node"), "_g", "_h", F.posexplode("_x").alias("feature", "bin"))
                .groupBy("node", "feature", "bin")
                .agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"))
                .collect()  # nodes x features x bins rows at most
            )
            for at, leaf in open_nodes.items():
                _split(leaf, [r for r in sums if r["node"] == at], least, l2, rate)
        model.trees.append(root)
    return model


def _split(leaf: Node, sums: list[Row], least: float, l2: float, rate: float) -> None:
    """Give ``leaf`` the split with the greatest gain, and its sides their values."""
    g = math.fsum(r["g"] for r in sums if r["feature"] == 0)
    h = math.fsum(r["h"] for r in sums if r["feature"] == 0)
    score = lambda a, b: a * a / (b + l2)
    leaf.value = rate * g / (h + l2)
    best = (1e-9, -1, -1, 0.0, 0.0)
    for f in range(len(FEATURES)):
        bins = {r["bin"]: (r["g"], r["h"]) for r in sums if r["feature"] == f}
        gl = hl = 0.0
        for b in range(TOP_BIN):
            gb, hb = bins.get(b, (0.0, 0.0))
            gl, hl = gl + gb, hl + hb
            if hb and hl >= least * 0.05 and h - hl >= least * 0.05:
                gain = score(gl, hl) + score(g - gl, h - hl) - score(g, h)
                if gain > best[0] + 1e-9:
                    best = (gain, f, b, gl, hl)
    if best[1] >= 0:
        _, leaf.feature, leaf.bin, gl, hl = best
        leaf.left, leaf.right = Node(rate * gl / (hl + l2)), Node(rate * (g - gl) / (h - hl + l2))


def filter_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = (), *, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, verdict and block_probability to ``pages``.

    The verdict is the longest fitting rule's action (of equally long ones the first by text), else ``block`` where the
    model's probability reaches ``threshold``.  Null urls and those without ``://`` have empty host and path and are
    judged by the model; very long urls are read whole.  Columns of ``pages`` with the added names are replaced, others
    come through whatever their names; rows that are repeated stay repeated, and an empty table gives an empty result.
    """
    added = ("host", "path", "rule", "verdict", "block_probability")
    clash = {c: f"_kept_{i}" for i, c in enumerate(pages.columns) if c.lower() not in added}
    df = pages.select(*[named(c).alias(k) for c, k in clash.items()])
    df = df.withColumn("_url", F.col(clash[url])).withColumn("_host", host_of(F.col("_url"))).withColumn("_path", path_of(F.col("_url")))
    df = _with_features(df, model.suffixes).withColumn("_rule", rule_of(F.col("_host"), F.col("_path"), rules))
    p = 1 / (1 + F.exp(-model.margin(F.col("_x"))))
    df = df.withColumn("_p", p)
    return df.select(
        *[F.col(k).alias(c) for c, k in clash.items()],
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.action", F.when(F.col("_p") >= threshold, "block").otherwise("allow")).alias("verdict"),
        F.col("_p").alias("block_probability"),
    )
