"""Tables of thumbnails: what is broadcast, what is shuffled, what is compared."""

import numpy as np
import pytest

from rasterloom.llm import overlap as O

DDL = "sample_id bigint, task string, patient_id string, side string, view string, case_id string, source string, thumb array<int>"


@pytest.fixture
def limit(spark):
    """A limit for broadcasts by estimate; none by measured size."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "200000", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield 200_000
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_tables_of_thumbnails_over_the_limit_are_not_broadcast(spark, tmp_path, limit):
    t = np.random.default_rng(3).integers(0, 4096, (3000, 64))
    data = [(i, ["Mass-Test", "Mass-Training"][i % 2], f"P_{i}", "L", "CC", None, "s", [int(v) for v in x]) for i, x in enumerate(t)]
    spark.createDataFrame(data, DDL).write.parquet(f"{tmp_path}/films.parquet")
    assert len(t) * 64 * 12 / 8 > limit
    for df in O.near_thumbs(O.films_with_split(spark.read.parquet(f"{tmp_path}/films.parquet"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_chance_meetings_are_no_candidates(spark):
    """Thumbnails of ten equal blocks in sixteen: their similarity of 0.45 brings nearly half of them into one bucket."""
    rng = np.random.default_rng(4)
    a = np.repeat(np.repeat(rng.integers(0, 4096, (300, 4, 4)), 2, axis=1), 2, axis=2)
    six = np.zeros((8, 8), bool)
    six[0:2], six[2:4, 0:4] = True, True
    a = np.where(six, a % 2048, a)
    b = np.where(six, a + 2048, a)
    a, b = a.reshape(-1, 64), b.reshape(-1, 64)
    keys = [O.band_keys(x, O._table()) for x in (a, b)]
    assert (keys[0] == keys[1]).any(axis=1).mean() > 0.3
    rows = [(bytearray(p), int(i), i < 300, i >= 300) for i, p in enumerate(O.pack(np.concatenate([a, b])))]
    rows.append((bytearray(O.pack(a[:1] + 1)[0]), 1000, False, True))  # a near copy stays one
    got = O.candidates(spark.createDataFrame(rows, "packed binary, thumb_no bigint, in_test boolean, in_train boolean")).collect()
    assert [(r.test_no, r.train_no) for r in got] == [(0, 1000)]


def test_sketches_of_near_thumbnails_are_neighbours():
    rng = np.random.default_rng(6)
    a = rng.integers(-300, 4400, (20_000, 64))
    share = rng.dirichlet(np.full(64, 0.05), len(a))  # often nearly all of it in a few pixels
    b = a + np.floor(share * O.PIXELS * O.MAX_DIFFERENCE).astype(int) * rng.choice([-1, 1], (len(a), 1))
    assert (np.abs(a - b).mean(axis=1) <= O.MAX_DIFFERENCE).all()
    at = 4 * np.arange(O.GROUPS)
    steps = [O.sketches(x)[:, None] >> at & (O.STEPS - 1) for x in (a, b)]
    far = np.abs(steps[0] - steps[1])
    assert far.max() == 1 and O.sketches(a).max() < 2**32


def test_packed_thumbnails_come_back():
    rng = np.random.default_rng(7)
    t = np.concatenate([rng.integers(0, 4096, (50, 64)), rng.integers(-(2**31), 2**31, (50, 64)), np.full((1, 64), 4096), np.full((1, 64), -1)]).astype(np.int32)
    t = t[rng.permutation(len(t))]
    assert (O.unpack(O.pack(t)) == t).all() and len(O.unpack([])) == 0
    assert {len(p) for p in O.pack(t)} == {96, 256}
