"""BPE encoding and decoding of whole texts with a public vocabulary file.

Forced-boundary splitting: two bytes that stand side by side in no token of the vocabulary can never
be joined by a merge, so each such pair in a word is a certain cut.  The fragments between the cuts
are encoded on their own and their ids strung together, which gives the same ids as merging the
word as a whole.  Fragments are short and recur in many words, so they are kept in a table of
bounded size in each Python worker.

Which characters are letters, how they compose and what their lower case is depends on the version of Unicode.
Characters that Unicode 3.2 has behave alike in all later ones, so words of those are found here; the few other words
are normalised and split by the normaliser and the splitter that the vocabulary file names, as its library runs them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutweave.functions.columns import named, unused
from cutweave.llm.kernels import bounded_batches, hand_back

#: Words, and fragments, that a worker keeps with their ids; at most twice as many words, as the ones before
#: the latest so many stay until as many new ones have come.
CACHE = 150_000
#: Fragments of up to so many symbols are merged in a list, longer ones with a heap.
SHORT = 48
NONE = 1 << 60
WORD_END = "</w>"
#: A text is encoded in pieces of about this many characters, cut at white space.
PIECE = 1 << 20


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _not_settled() -> str:
    """A character class of all that Unicode 3.2 doesn't have, planes beyond the first as a whole."""
    old, out, start = unicodedata.ucd_3_2_0, [], None
    for c in range(0x10001):
        odd = c < 0x10000 and old.category(chr(c)) in ("Cn", "Cs")
        if odd and start is None:
            start = c
        elif not odd and start is not None:
            out.append(f"\\u{start:04x}-\\u{c - 1:04x}")
            start = None
    return "[" + "".join(out) + "\\U00010000-\\U0010ffff]"


#: Stretches without white space that hold a character which isn't settled.
_UNSETTLED = re.compile("[^ \\n]*" + _not_settled() + "[^ \\n]*")


class WordBpe:
    """Encoder and decoder for a vocabulary file of byte pairs with word ends, given by its contents."""

    def __init__(self, contents: str):
        spec = json.loads(contents)
        self.contents, self._library = contents, None
        model = spec["model"]
        if model.get("end_of_word_suffix") != WORD_END or model.get("continuing_subword_prefix"):
            raise ValueError("a vocabulary with word ends is needed")
        self.ids: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.special).items()}
        self.names = np.full(max(self.tokens, default=-1) + 2, "", object)  # the last one stands for unknown ids
        for i, t in self.tokens.items():
            self.names[i] = t
        self.symbols = byte_symbols()
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        space = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        self.words = regex.compile(pattern.replace(r"[^\s", "[^" + space))
        self.split_special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=lambda t: (-len(t), t))) + ")") if self.special else None
        self.touch = self._touching()
        self.fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _touching(self) -> set[tuple[str, str]]:
        """Pairs of symbols that stand side by side inside some token."""
        out: set[tuple[str, str]] = set()
        for token in self.ids:
            body = token.removesuffix(WORD_END)
            out.update(zip(body, body[1:]))
        return out

    def cuts(self, symbols: str) -> list[str]:
        """The fragments of a word: cut wherever two symbols touch in no token."""
        touch, out, start = self.touch, [], 0
        if touch.issuperset(zip(symbols, symbols[1:])):
            return [symbols]
        for i in range(1, len(symbols)):
            if (symbols[i - 1], symbols[i]) not in touch:
                out.append(symbols[start:i])
                start = i
        out.append(symbols[start:])
        return out

    def merge(self, fragment: str, last: bool) -> tuple[int, ...]:
        """Ids of a fragment: the lowest-ranked pair, leftmost first, is joined until none is left."""
        parts: list[str | None] = list(fragment)
        if last:
            parts[-1] += WORD_END
        if len(parts) > SHORT:
            return self._merge_long(parts)
        rank = self.ranks.get
        ranks = [rank(pair, NONE) for pair in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < NONE:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), NONE)
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), NONE)
        return tuple([self.ids[p] for p in parts])

    def _merge_long(self, parts: list[str | None]) -> tuple[int, ...]:
        """The same with a heap over a doubly linked list, so a very long fragment costs n log n."""
        n, ranks = len(parts), self.ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0:
                    pair = (parts[k], parts[after[k]])
                    if (r := ranks.get(pair)) is not None:
                        heapq.heappush(heap, (r, k, *pair))
        return tuple(self.ids[p] for p in parts if p is not None)

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word of the normalised text."""
        symbols = "".join([self.symbols[b] for b in word.encode("utf-8", "surrogatepass")])
        pieces = self.cuts(symbols)
        if len(pieces) == 1:
            return list(self.merge(symbols, True))
        out: list[int] = []
        for k, piece in enumerate(pieces):
            key = (piece, k == len(pieces) - 1)
            found = self.fragments.get(key)
            if found is None:
                if len(self.fragments) >= CACHE:
                    self.fragments.clear()
                found = self.merge(*key)
                if len(piece) <= 64:
                    self.fragments[key] = found
            out += found
        return out

    def normalise(self, text: str) -> str:
        """NFC, then lower case character by character (a final sigma has no form of its own)."""
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def _split_by_library(self, text: str) -> list[str]:
        """The words of a stretch of text with characters that aren't settled."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.contents)
        text = self._library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]

    def split(self, piece: str) -> list[str]:
        """The words of a piece of text, normalised."""
        if piece.isascii() or not (found := _UNSETTLED.search(piece)):
            return self.words.findall(self.normalise(piece))
        out, at = [], 0
        while found:
            out += self.words.findall(self.normalise(piece[at : found.start()]))
            out += self._split_by_library(found[0])
            at = found.end()
            found = _UNSETTLED.search(piece, at)
        return out + self.words.findall(self.normalise(piece[at:]))

    def _word(self, word: str) -> bytes:
        """Ids as little-endian bytes of a word that isn't among the latest."""
        out = self.before.get(word)
        if out is None:
            ids = self.word_ids(word)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= 64:
            if len(self.known) >= CACHE:
                self.before, self.known = self.known, {}
            self.known[word] = out
        return out

    def pieces(self, text: str) -> Iterator[str]:
        """The text cut at spaces or line ends into bounded pieces; words never reach across white space."""
        at = 0
        while len(text) - at > PIECE:
            to = max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE))
            to = at + PIECE if to <= at else to  # no white space in a piece: take the whole rest
            if to == at + PIECE:
                nearest = [x for x in (text.find(" ", to), text.find("\n", to)) if x >= 0]
                to = min(nearest) if nearest else len(text)
            yield text[at:to]
            at = to
        yield text[at:]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; null is the empty text."""
        out: list[bytes] = []
        for part in self.split_special.split(text or "") if self.split_special else [text or ""]:
            if part in self.special:
                out.append(struct.pack("<I", self.special[part]))
                continue
            for piece in self.pieces(part):
                out += [self.known.get(word) or self._word(word) for word in self.split(piece)]
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids) -> str:
        """The tokens of the ids joined by a space: the file names no decoder.  Unknown ids are passed over."""
        ids = np.asarray(ids, np.int64)
        known = (ids >= 0) & (ids < len(self.names) - 1)
        found = self.names[ids if known.all() else ids[known]].tolist()
        return " ".join(found if "" not in found else [t for t in found if t])


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary at a local ``path``, read once in each process."""
    if path not in _loaded:
        with open(path, encoding="utf-8") as f:
            _loaded[path] = WordBpe(f.read())
    return _loaded[path]


def shipped(spark: SparkSession, path: str):
    """A function for workers that gives the vocabulary at ``path``, whose contents (some MB, whatever the input) are broadcast.

    Only the driver reads the path: a local file of its own, or with a scheme any file that Spark reads.
    """
    if "://" in path:
        contents = spark.read.text(path, wholetext=True).first()[0]
    else:
        with open(path, encoding="utf-8") as f:
            contents = f.read()
    name, sent = hashlib.sha256(contents.encode()).hexdigest(), spark.sparkContext.broadcast(contents)

    def get() -> WordBpe:
        if name not in _loaded:
            _loaded[name] = WordBpe(sent.value)
        return _loaded[name]

    return get


def encode_documents(documents: DataFrame, vocabulary: str, *, text_col: str = "text", ids: bool = True, digests: bool = False) -> DataFrame:
    """Adds n_tokens and, as asked for, token_ids (array) or ids_sha256 and decoded_sha256.

    ``decoded_sha256`` is of the text that the ids decode to.  ``vocabulary`` is a path that the driver can open.  Null
    texts count as empty and get no tokens; very long texts are encoded in pieces and their ids held
    as one array; rows keep their other columns, whatever their names, repeated rows stay repeated, columns with the
    added names are replaced; an empty table gives an empty result.
    """
    added = [T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("token_ids", T.ArrayType(T.IntegerType()))] * ids
    added += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] * digests
    get = shipped(documents.sparkSession, vocabulary)

    def run(texts: pd.Series) -> pd.DataFrame:
        bpe, rows = get(), []
        for text in texts:
            found = bpe.encode(text if isinstance(text, str) else "")
            row: dict = {"n_tokens": len(found)}
            if ids:
                row["token_ids"] = found.astype("int32")
            if digests:
                row["ids_sha256"] = hashlib.sha256(found.tobytes()).hexdigest()
                row["decoded_sha256"] = hashlib.sha256(bpe.decode(found).encode("utf-8", "surrogatepass")).hexdigest()
            rows.append(row)
        hand_back()
        return pd.DataFrame(rows, columns=[f.name for f in added])

    names = {f.name.lower() for f in added}
    (all_,) = unused(documents.columns, "encoded")
    keep = [named(c) for c in documents.columns if c.lower() not in names]
    udf = F.pandas_udf(run, T.StructType(added))
    return bounded_batches(documents).select(*keep, udf(named(text_col)).alias(all_)).select(*keep, f"{all_}.*")


def decode_documents(encoded: DataFrame, vocabulary: str, *, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the decoded text of an array of ids; null ids give null, unknown ids are passed over."""
    get = shipped(encoded.sparkSession, vocabulary)

    def run(arrays: pd.Series) -> pd.Series:
        bpe = get()
        return pd.Series([None if a is None else bpe.decode(a) for a in arrays], dtype=object)

    return bounded_batches(encoded).withColumn(out, F.pandas_udf(run, T.StringType())(named(ids_col)))
