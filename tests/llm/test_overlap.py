"""Cross-split overlaps against all pairs."""

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import overlap as O
from tests.conftest import rows

DDL = "sample_id bigint, task string, patient_id string, side string, view string, case_id string, source string, thumb array<int>, bucket string"


def table():
    rng = np.random.default_rng(5)
    base = rng.integers(200, 3900, (40, 64))
    data = []
    for i in range(240):
        t = base[rng.integers(40)].copy()
        kind = i % 4
        if kind == 1:
            t = t + rng.integers(-60, 61, 64)
        elif kind == 2:
            t = t + 30  # exactly at the border
        elif kind == 3:
            t[0:1] += 30 * 64 + 1 if t[0] < 2000 else -(30 * 64 + 1)  # just beyond it
        task = ["Mass-Test", "Mass-Training", "calc test", "CalcTraining"][rng.integers(4)]
        data.append((i, task, f"P_{rng.integers(400)}", ["L", "RIGHT"][i % 2], "CC", None, f"s{i % 3}", [int(v) for v in t], "b"))
    data += [(1000, "Mass-Test", None, None, None, "Mass-Test_P_9_LEFT_CC", None, None, None), (1001, None, None, None, None, "Calc-Training P 00009 LEFT CC", "s", [], None)]
    data += [(1002, "Mass-Test", None, None, None, None, None, [None] * 64, None), (1003, None, None, None, None, None, None, [1] * 64, None), (None, "Mass-Test", "P_1", "L", "CC", None, "s", [1] * 64, None)]
    return data


def brute(spark, df):
    films = [r for r in O.films_with_split(df).collect()]
    out = set()
    for a in films:
        for b in films:
            if a.is_test and not b.is_test:
                same = None not in (a.f_patient, a.f_side, a.f_view) and (a.f_patient, a.f_side, a.f_view) == (b.f_patient, b.f_side, b.f_view)
                near = a.thumb is not None and b.thumb is not None and np.abs(np.array(a.thumb) - np.array(b.thumb)).mean() <= 30
                if same or near:
                    out.add((min(a.sample_id, b.sample_id), max(a.sample_id, b.sample_id)))
    return out


def test_all_pairs_are_found(spark):
    df = spark.createDataFrame(table(), DDL)
    films = O.films_with_split(df)
    pairs = O.cross_split_pairs(films)
    got = rows(O.found_pairs(pairs), "sample_id_a", "sample_id_b")
    assert len(got) == len(set(got)) and set(got) == brute(spark, df)
    assert (1000, 1001) in got


def test_report_counts_what_the_pairs_say(spark):
    df = spark.createDataFrame([*table(), table()[0], *[(2000 + i, ["Mass-Test", "Mass-Training"][i % 2], "P_7", "L", "CC", None, None, [9] * 64, "b") for i in range(9)]], DDL)
    films = O.films_with_split(df)
    per = {}
    for a, b in rows(O.cross_split_pairs(films), "test_id", "train_id"):
        per[a], per[b] = per.get(a, 0) + 1, per.get(b, 0) + 1
    want = {}
    for r in {tuple(x) for x in films.select("is_test", "source", "sample_id").collect()}:
        n = want.setdefault((["Training", "Test"][r[0]], r[1]), [0, 0, 0])
        for i, v in enumerate((1, r[2] in per, per.get(r[2], 0))):
            n[i] += v
    got = {(r.split_name, r.source): [r.n_rows, r.n_overlapping, r.n_pairs] for r in O.overlap_report(films).collect()}
    assert got == want


def test_no_confirmed_pair_is_below_the_least_jaccard(spark):
    pairs, _ = O.near_thumbs(O.films_with_split(spark.createDataFrame(table(), DDL)))
    assert pairs.agg(F.min("jaccard")).first()[0] >= 0.69 > O.MIN_JACCARD


def test_empty(spark):
    films = O.films_with_split(spark.createDataFrame([], DDL))
    assert O.cross_split_pairs(films).count() == 0 and O.overlap_report(films).count() == 0


def test_copies_are_compared_once(spark):
    t = list(range(64))
    df = spark.createDataFrame([(i, "Mass-Test" if i % 2 else "Mass-Training", f"P_{i}", "L", "CC", None, "s", t, "") for i in range(20)], DDL)
    films = O.films_with_split(df)
    assert O.near_thumbs(films)[0].count() == 1 and O.cross_split_pairs(films).count() == 100


def test_shared_shingles_are_counted_exactly(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-50, 4200, (40, 64))
    y = np.where(rng.random((40, 64)) < 0.5, x + rng.integers(-600, 600, (40, 64)), rng.integers(0, 4096, (40, 64)))
    df = spark.createDataFrame([(i, [int(v) for v in a], [int(v) for v in b]) for i, (a, b) in enumerate(zip(x, y))], "i int, a array<int>, b array<int>")
    got = [r.n for r in df.select("i", O._grid_hits(F.col("a"), F.col("b")).alias("n")).orderBy("i").collect()]
    assert got == [len(np.intersect1d(p, q)) for p, q in zip(O._shingles(x), O._shingles(y))]
