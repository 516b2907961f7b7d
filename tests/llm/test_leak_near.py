"""Every window that reaches MIN_SIMILARITY is found."""

import numpy as np

from rasterloom.llm import leak as L


def test_near_windows_are_found():
    rng = np.random.default_rng(3)
    items = [[f"w{v}" for v in rng.integers(0, 5000, 10)] for _ in range(300)]
    index = L.ItemIndex([(i, " ".join(w)) for i, w in enumerate(items)])
    for change in (lambda w: ["other", *w[1:]], lambda w: [*w[:-1], "other"], lambda w: [*w[4:], *w[:4]]):
        hit = L.search([" ".join(change(w)) for w in items], [index])
        assert {(i, i) for i in range(300)} <= set(zip(hit["doc"].astype(int), hit["item_id"].astype(int)))
        assert not hit["exact"].any()
    assert L.search([" ".join([*w[:5], "other", *w[6:]]) for w in items], [index]).empty
