"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 6).

A text is cut into pieces by the tokenizer's public pattern; the bytes of every
piece are merged by rank. A segment tree over the ranks of adjacent pairs has at
its root the leftmost lowest-rank merge; a merge updates three leaves in
logarithmic time, so that even a piece of a megabyte takes n log n steps.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizers' files; the driver reads the ranks and broadcasts them (under 1 MB).
TOKENIZERS = "/opt/tokenizers"

# Fixed value: the public pre-tokenisation pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces whose ids a worker remembers, and the longest piece (bytes) that it does.
REMEMBERED, REMEMBERED_BYTES = 200_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks from a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTree:
    """Segment tree over the merge ranks of adjacent parts; its root is the leftmost lowest one."""

    def __init__(self, ranks: list[int], none: int):
        n = 1
        while n < len(ranks):
            n *= 2
        self.n, self.none = n, none
        # a leaf holds rank and place in one number, so the minimum is leftmost among equals
        self.low = low = [none * n] * (2 * n)
        for i, r in enumerate(ranks):
            low[n + i] = r * n + i
        for i in range(n - 1, 0, -1):
            a, b = low[2 * i], low[2 * i + 1]
            low[i] = a if a < b else b

    def set(self, i: int, rank: int) -> None:
        low = self.low
        k = self.n + i
        low[k] = rank * self.n + i
        k >>= 1
        while k:
            a, b = low[2 * k], low[2 * k + 1]
            v = a if a < b else b
            if low[k] == v:
                return
            low[k] = v
            k >>= 1

    def best(self) -> tuple[int, int]:
        """Rank and place of the root."""
        return divmod(self.low[1], self.n)


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: merge the leftmost pair of lowest rank until none is left."""
    parts: list[bytes] = [piece[i : i + 1] for i in range(len(piece))]
    n = len(parts)
    if n == 1:
        return [ranks[piece]]
    none = len(ranks) + 1
    get = ranks.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = PairTree([get(parts[i] + parts[i + 1], none) for i in range(n - 1)], none)
    while True:
        rank, i = tree.best()
        if rank >= none:
            break
        j = after[i]
        parts[i] += parts[j]
        parts[j] = b""
        k = after[j]
        after[i] = k
        if k < n:
            before[k] = i
            tree.set(i, get(parts[i] + parts[k], none))
        else:
            tree.set(i, none)
        if j < n - 1:
            tree.set(j, none)
        h = before[i]
        if h >= 0:
            tree.set(h, get(parts[h] + parts[i], none))
    return [ranks[p] for p in parts if p]


class Encoder:
    """Encodes texts; remembers the ids of short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks, self.split, self.known = ranks, regex.compile(pattern).findall, {}

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        known = self.known
        for piece in self.split(text):
            ids = known.get(piece)
            if ids is None:
                raw = piece.encode("utf-8", "replace")
                ids = encode_piece(raw, self.ranks)
                if len(raw) <= REMEMBERED_BYTES:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            out += ids
        return out


def encode_texts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), tokenizers: str = TOKENIZERS, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """The ``keep`` columns and ``ids array<int>`` of every row.

    Null and empty texts get an empty list; blank text is encoded as it is, and
    marks that look like special tokens are ordinary text. No shuffle; only the
    kept columns and the text reach Python. Other columns may have any name.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(f"{tokenizers}/{vocabulary}"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(ranks.value)
        for f in frames:
            ids = [encoder.encode(t) for t in f["__text"]]
            yield f.drop(columns="__text").assign(ids=pd.Series(ids, index=f.index, dtype=object))

    cols = docs.select(*keep, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{c}` {t}" for c, t in cols.dtypes if c != "__text")
    return cols.mapInPandas(run, f"{kept}, ids array<int>")
