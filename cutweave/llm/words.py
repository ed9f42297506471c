"""Words of many texts at once, as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cutweave.llm.kernels import in_slices

#: Words are runs of anything else than these.
SPACE = b" \t\n\v\f\r"
#: Bytes of text whose words are held at once (one text may be larger).
SLICE = 4 << 20


def split(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Offsets of the texts' words (one more than texts), the distinct words, and each word's place among those."""
    stripped = pa.array([t.strip(SPACE).decode() for t in texts], pa.large_string())
    lists = pc.ascii_split_whitespace(stripped)
    offsets = lists.offsets.to_numpy()
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    codes, offsets = coded.indices.to_numpy(), offsets - offsets[0]
    blank = pc.binary_length(stripped).to_numpy(zero_copy_only=False) == 0
    if blank.any():  # a blank text is split into one empty word
        keep = np.ones(len(codes), bool)
        keep[offsets[:-1][blank]] = False
        codes, offsets = codes[keep], np.concatenate([[0], np.cumsum(np.where(blank, 0, np.diff(offsets)))])
    return offsets, coded.dictionary, codes


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, texts as bytes) of consecutive texts of ``limit`` bytes together; null texts are empty."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in in_slices(lambda i: int(lengths[i]) + 8, len(lengths), limit):
        yield a, [(t or "").encode() for t in texts.slice(a, b - a).to_pylist()]
