"""Leaked passages against all ten-word runs."""

import random

import numpy as np
import pytest

from rasterloom.llm import leak as L
from tests.conftest import rows

VOCAB = [f"w{i}" for i in range(30)] + ["Straße", "naïve", "42"]


def brute(docs, items):
    out = set()
    for i, t in items:
        w = L.words(t)
        runs = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
        for d, x in docs:
            v = L.words(x)
            if d is not None and i is not None and any(tuple(v[k : k + 10]) in runs for k in range(len(v) - 9)):
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def data():
    r = random.Random(4)
    sentence = lambda n: [r.choice(VOCAB) for _ in range(n)]
    items = [(i, " ".join(sentence(r.randrange(6, 40)))) for i in range(30)] + [(99, None), (98, ""), (None, "x " * 20), (97, "one two three")]
    docs = []
    for d in range(200):
        w = sentence(r.randrange(0, 60))
        i, t = items[r.randrange(30)]
        v = t.split()
        if d % 2:
            n = r.choice([9, 10, 11, len(v)])
            k = r.randrange(0, max(1, len(v) - n + 1))
            w[len(w) // 2 : len(w) // 2] = v[k : k + n]
        docs.append((d, r.choice([" ", " ** ", "\n> ", "-", "_"]).join(x.upper() if r.random() < 0.3 else x for x in w)))
    docs += [(500, None), (501, ""), (502, "!!! ..."), (503, items[0][1] + " " + items[1][1]), (503, items[0][1]), (None, items[0][1])]
    return docs, items


@pytest.mark.parametrize("block,near", [(L.ITEM_WORDS, True), (100, True), (100, False)])
def test_exact_passages(spark, data, block, near, monkeypatch):
    monkeypatch.setattr(L, "ITEM_WORDS", block)
    monkeypatch.setattr(L, "INDEXES", 2)
    docs, items = data
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(*x, "test") for x in items], "item_id bigint, text string, split_name string")
    found = L.leaks(d, i, near)
    assert set(rows(L.leaked(found), "doc_id", "item_id")) == brute(docs, items)
    report = {r.item_id: r.n_docs for r in L.leak_report(found, i.where("item_id is not null")).collect()}
    assert sum(report.values()) == len(brute(docs, items)) and len(report) == 33


def test_long_texts_are_read_to_the_end():
    index = L.ItemIndex([(1, " ".join(VOCAB[:12]))])
    far = " ".join(["filler"] * 150_000 + VOCAB[:12])
    assert L.search([far, None, "x"], [index])[["doc", "item_id", "exact", "covered"]].values.tolist() == [[0, 1, True, 1.0]]


def test_no_fingerprint_within_the_radius_is_missed():
    rng = np.random.default_rng(0)
    index = L.ItemIndex([(1, " ".join(VOCAB))])
    fp = index.fp.copy()
    for _ in range(L.RADIUS):
        fp ^= np.uint64(1) << rng.integers(0, 64, len(fp)).astype(np.uint64)
    who, mine = index.candidates(fp)
    assert set(range(len(fp))) <= {int(w) for w, m in zip(who, mine) if w == m}


def test_similarity_counts_repeats():
    a = np.array([[1, 1, 2, 3, 4, 5, 6, 7, 8, 9]], np.uint64)
    b = a.copy()
    b[0, 0] = 50
    assert L.similarity(a, a)[0] == 1.0
    assert np.isclose(L.similarity(a, b)[0], (9 + 2 * 8) / (2 * 28 - (9 + 2 * 8)))


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([], "item_id bigint, text string, split_name string")
    assert L.leaks(d, i).count() == 0 and L.leak_report(L.leaks(d, i), i).count() == 0


def test_window_sums():
    x = np.random.default_rng(1).integers(-1, 2, (30, 64)).astype(np.int8)
    for width in (1, 2, 7, 9, 10, 30):
        assert np.array_equal(L._window_sums(x, width), np.stack([x[i : i + width].sum(axis=0) for i in range(30 - width + 1)]))


def test_covered_share():
    item = [f"i{k}" for k in range(40)]
    index = L.ItemIndex([(0, "some other item of no more than twelve words in all here"), (7, " ".join(item))])
    texts = [" ".join(item), " ".join(item[5:25]), " ".join([*item[:12], "x", "y", *item[20:32]])]
    hit = L.search(texts, [index], near=False)
    assert hit["covered"].round(3).tolist() == [1.0, 0.5, 0.6] and hit["exact"].all()


@pytest.mark.parametrize("near,least", [(True, 1.0), (False, 0.0)])
def test_recall_against_all_pairs(near, least):
    """Every pair of windows of 40 documents and 20 items is compared; all near ones are found."""
    r = random.Random(8)
    items = [[r.choice(VOCAB[:12]) for _ in range(24)] for _ in range(20)]
    docs = []
    for d in range(40):
        w = list(items[d % 20])
        for _ in range(d % 5):
            w[r.randrange(len(w))] = r.choice(VOCAB)
        docs.append(w[r.randrange(5) :] + [r.choice(VOCAB) for _ in range(10)])
    runs = lambda ws: L.word_hashes([ws])[0][np.arange(len(ws) - 9)[:, None] + np.arange(10)]
    want, total = set(), 0
    for d, ws in enumerate(docs):
        x = runs(ws)
        for i, it in enumerate(items):
            y = runs(it)
            a, b = np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))
            total += len(a)
            if (L.similarity(x[a], y[b]) >= L.MIN_SIMILARITY).any():
                want.add((d, i))
    index = L.ItemIndex([(i, " ".join(w)) for i, w in enumerate(items)])
    hit = L.search([" ".join(w) for w in docs], [index], near)
    got = set(zip(hit["doc"].astype(int), hit["item_id"].astype(int)))
    assert len(want) >= 20 and got <= want and len(got & want) >= least * len(want)
