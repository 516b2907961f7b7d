"""Evaluation texts leaking into training text (problem 7).

Every document and every item is cut into windows of PASSAGE words, the shortest
passage that counts. Windows have SimHash fingerprints; a multi-index over
BLOCKS blocks of the items' fingerprints gives all item windows within RADIUS
bits, the exact weighted shingle similarity verifies them, and a word-by-word
comparison tells exact passages. Windows that are near (MIN_SIMILARITY) but not
equal differ in about nine bits, more than any multi-index can guarantee at a
useful cost; they meet in the hashes of their word pairs without each one of the
pairs in turn (deletion keys), which windows of that similarity have in common,
so none is missed. How much of an item leaked is the share of its words inside
matched windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window: the shortest passage that counts.
PASSAGE = 10
#: 64-bit fingerprints, BLOCKS blocks of 16 bits; up to BLOCKS - 1 bits may differ.
BLOCKS = 4
RADIUS = BLOCKS - 1
#: Weighted shingle similarity from which a window counts as near.
MIN_SIMILARITY = 0.8
#: Weights of single words and of word pairs in fingerprint and similarity.
WORD_WEIGHT, PAIR_WEIGHT = 1, 2
assert PASSAGE * WORD_WEIGHT + (PASSAGE - 1) * PAIR_WEIGHT < 128
#: Words of the items of one index, and indexes that one pass over the corpus probes:
#: the text is cut and fingerprinted once for all of them.
ITEM_WORDS = 400_000
INDEXES = 8
#: Share of an item's words in matched windows from which the item counts as leaked as a whole.
WHOLE_ITEM = 0.8
#: Words fingerprinted at once.
CHUNK_WORDS = 60_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case."""
    return [w.casefold() for w in _WORD.findall(text)] if text else []


def word_hashes(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words one after the other, and the list each is from."""
    flat = [w for ws in lists for w in ws]
    owner = np.repeat(np.arange(len(lists)), [len(ws) for ws in lists])
    if not flat:
        return np.zeros(0, np.uint64), owner
    codes, uniques = pd.factorize(np.array(flat, dtype=object))
    table = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) for w in uniques), np.uint64, len(uniques))
    return table[codes], owner


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pairs(h: np.ndarray) -> np.ndarray:
    return _mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def _signs(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def _window_sums(x: np.ndarray, width: int) -> np.ndarray:
    """Sums of ``width`` neighbouring rows, from sums of 1, 2, 4, ... rows. The weighted sums of a window fit 8 bits."""
    n, at, size, block, out = len(x) - width + 1, 0, 1, x, None
    while width:
        if width & 1:
            part = block[at : at + n]
            out = part if out is None else out + part
            at += size
        width >>= 1
        if width:
            block = block[:-size] + block[size:]
            size *= 2
    return out


def window_fingerprints(h: np.ndarray) -> np.ndarray:
    """SimHash of every PASSAGE-word window of the word sequence."""
    n = len(h) - PASSAGE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = _window_sums(_signs(h), PASSAGE) * np.int8(WORD_WEIGHT) + _window_sums(_signs(_pairs(h)), PASSAGE - 1) * np.int8(PAIR_WEIGHT)
    return np.packbits(total > 0, axis=1).view(np.uint64).reshape(-1)


def deletion_keys(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For the windows that start at ``at``: the sum of their pairs' hashes without each one of the pairs in turn.

    A window that reaches MIN_SIMILARITY lacks at most one pair of the other
    (asserted below), so two such windows have a key in common.
    """
    p = _mix(_pairs(h))[at[:, None] + np.arange(PASSAGE - 1)]
    return p.sum(axis=1, dtype=np.uint64)[:, None] - p


_WHOLE = PASSAGE * WORD_WEIGHT + (PASSAGE - 1) * PAIR_WEIGHT
assert (_WHOLE - 2 * PAIR_WEIGHT) / (_WHOLE + 2 * PAIR_WEIGHT) < MIN_SIMILARITY


class ItemIndex:
    """Windows of the items, by blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.h, owner = word_hashes([words(t) for _, t in items])
        fp = window_fingerprints(self.h)
        at = np.arange(len(fp))
        inside = owner[at] == owner[at + PASSAGE - 1] if len(fp) else np.zeros(0, bool)
        self.at, self.fp = at[inside], fp[inside]
        self.item = owner[self.at] if len(self.at) else np.zeros(0, np.int64)
        self.size = np.bincount(owner, minlength=len(items)).astype(np.int64) if len(owner) else np.zeros(len(items), np.int64)
        self.begin = np.cumsum(self.size) - self.size
        keys = deletion_keys(self.h, self.at) if len(self.at) else np.zeros((0, PASSAGE - 1), np.uint64)
        entries = np.stack((keys.ravel(), np.repeat(np.arange(len(keys), dtype=np.uint64), PASSAGE - 1)))
        self.keys, self.window = np.unique(entries, axis=1)
        self.window = self.window.astype(np.int64)
        self.marks = np.zeros(1 << 20, bool)
        self.marks[self.keys & np.uint64(len(self.marks) - 1)] = True
        self.blocks = []
        for b in range(BLOCKS):
            v = ((self.fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            order = np.argsort(v, kind="stable")
            self.blocks.append((order, np.searchsorted(v[order], np.arange(65537))))

    def candidates(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) pairs within RADIUS bits."""
        found = []
        for b, (order, offset) in enumerate(self.blocks):
            v = ((fp >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.int64)
            lo, n = offset[v], offset[v + 1] - offset[v]
            who = np.repeat(np.arange(len(fp)), n)
            mine = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            near = np.bitwise_count(fp[who] ^ self.fp[mine]) <= RADIUS
            found.append(who[near] * len(self.fp) + mine[near])
        return self._once(np.concatenate(found))

    def _once(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) of pair numbers, each once."""
        return np.divmod(np.unique(pairs), max(len(self.fp), 1))

    def near(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item window) pairs with a deletion key in common."""
        who, k = np.nonzero(self.marks[keys & np.uint64(len(self.marks) - 1)])
        v = keys[who, k]
        lo = np.searchsorted(self.keys, v)
        n = np.searchsorted(self.keys, v, "right") - lo
        mine = self.window[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        return self._once(np.repeat(who, n) * len(self.fp) + mine)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of windows (rows of word hashes)."""
    both = np.zeros(len(a))
    for x, y, weight in ((a, b, WORD_WEIGHT), (np.apply_along_axis(_pairs, 1, a) if len(a) else a, np.apply_along_axis(_pairs, 1, b) if len(b) else b, PAIR_WEIGHT)):
        x, y = np.sort(x, axis=1), np.sort(y, axis=1)
        # multiset intersection: the k-th occurrence of a value on either side meets
        same = lambda s: (s[:, :, None] == s[:, None, :]) & (np.arange(s.shape[1])[None, :, None] > np.arange(s.shape[1])[None, None, :])
        nx, ny = same(x).sum(2), same(y).sum(2)
        meet = (x[:, :, None] == y[:, None, :]) & (nx[:, :, None] == ny[:, None, :])
        both += weight * meet.any(2).sum(1)
    whole = 2 * (PASSAGE * WORD_WEIGHT + (PASSAGE - 1) * PAIR_WEIGHT)
    return both / (whole - both)


def _covered(positions: np.ndarray) -> int:
    """Words inside windows that start at the positions."""
    at = np.unique(positions)
    return int(np.minimum(np.diff(at, append=at[-1] + PASSAGE), PASSAGE).sum())


HITS = {"doc": [], "item_id": [], "similarity": [], "exact": [], "covered": []}


def search(texts: list[str | None], indexes: list[ItemIndex], near: bool = True) -> pd.DataFrame:
    """Per text and item with a matched window: doc (position), item_id, best similarity, whether a passage is exact, covered share of the item.

    Fingerprints within RADIUS are always looked up; with ``near`` also the
    deletion keys, which find every window of MIN_SIMILARITY.
    """
    h, owner = word_hashes([words(t) for t in texts])
    parts = []
    for a in range(0, max(len(h) - PASSAGE + 1, 0), CHUNK_WORDS):
        piece = h[a : a + CHUNK_WORDS + PASSAGE - 1]
        at = np.arange(a, a + len(piece) - PASSAGE + 1)
        inside = owner[at] == owner[at + PASSAGE - 1]
        at = at[inside]
        if not len(at):
            continue
        fp = window_fingerprints(piece)[inside]
        keys = deletion_keys(piece, at - a) if near else None
        for k, index in enumerate(indexes):
            who, mine = index.candidates(fp)
            if near:
                more, other = index.near(keys)
                who, mine = index._once(np.concatenate((who, more)) * len(index.fp) + np.concatenate((mine, other)))
            for b in range(0, len(who), 20_000):
                w, m = at[who[b : b + 20_000]], index.at[mine[b : b + 20_000]]
                span = np.arange(PASSAGE)
                x, y = h[w[:, None] + span], index.h[m[:, None] + span]
                exact = (x == y).all(1)
                sim = np.ones(len(w))
                sim[~exact] = similarity(x[~exact], y[~exact])
                keep = sim >= MIN_SIMILARITY
                item = index.item[mine[b : b + 20_000]][keep]
                parts.append(pd.DataFrame({"doc": owner[w[keep]], "index": k, "item": item, "similarity": sim[keep], "exact": exact[keep], "place": m[keep] - index.begin[item]}))
    if not parts or not sum(map(len, parts)):
        return pd.DataFrame(HITS)
    got = pd.concat(parts).groupby(["doc", "index", "item"], as_index=False).agg(similarity=("similarity", "max"), exact=("exact", "max"), covered=("place", lambda p: _covered(p.to_numpy())))
    of = [indexes[k] for k in got["index"]]
    got["covered"] /= [x.size[i] for x, i in zip(of, got["item"])]
    got["item_id"] = [x.ids[i] for x, i in zip(of, got["item"])]
    return got[list(HITS)]


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The stated items in blocks of ITEM_WORDS words, one block on the driver at a time."""
    block, size = [], 0
    for r in items.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(words(r.text))
        if size >= ITEM_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


LEAKS_DDL = "doc_id bigint, item_id bigint, similarity double, exact boolean, covered double"


def leaks(docs: DataFrame, items: DataFrame, near: bool = True) -> DataFrame:
    """doc_id, item_id, similarity, exact, covered of all documents with a matched passage of an item.

    The items are a stated query set; their indexes (each a broadcast of bounded
    size, INDEXES of them to a pass) are probed by whole texts of all documents,
    without a shuffle. Items and texts of fewer than PASSAGE words leak nothing,
    nor do null and empty ones. ``exact``: PASSAGE consecutive words are the
    same; ``covered``: the share of the item's words in matched windows.
    """
    sc = docs.sparkSession.sparkContext
    cols = docs.where("doc_id is not null and text is not null").select("doc_id", "text")
    out = docs.sparkSession.createDataFrame([], LEAKS_DDL)
    blocks = [sc.broadcast(ItemIndex(block)) for block in _item_blocks(items)]
    for n in range(0, len(blocks), INDEXES):

        def run(frames: Iterator[pd.DataFrame], some=blocks[n : n + INDEXES]) -> Iterator[pd.DataFrame]:
            indexes = [b.value for b in some]
            for f in frames:
                for a in range(0, len(f), 500):
                    ids = f["doc_id"].to_numpy()[a : a + 500]
                    hit = search(list(f["text"].iloc[a : a + 500]), indexes, near)
                    if len(hit):
                        yield hit.assign(doc_id=ids[hit["doc"].to_numpy(int)]).astype({"item_id": "int64", "exact": bool})[["doc_id", "item_id", "similarity", "exact", "covered"]]

        found = cols.mapInPandas(run, LEAKS_DDL)
        out = found if n == 0 else out.unionByName(found)
    return out


def leaked(found: DataFrame) -> DataFrame:
    """Documents that hold PASSAGE consecutive words of an item."""
    return found.where("exact").select("doc_id", "item_id").distinct()


def leak_report(found: DataFrame, items: DataFrame) -> DataFrame:
    """Per item: documents with an exact passage, with a near one, and with (nearly) the whole item; null ids have none."""
    docs = lambda cond: F.countDistinct(F.when(cond, F.col("doc_id")))
    per = found.groupBy("item_id").agg(docs(F.col("exact")).alias("n_docs"), docs(F.lit(True)).alias("n_near_docs"), docs(F.col("covered") >= WHOLE_ITEM).alias("n_whole_docs"))
    return items.select("item_id", "split_name").join(per, "item_id", "left").fillna(0, ["n_docs", "n_near_docs", "n_whole_docs"])
