"""Cube draws and stable samples."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import draw as D
from rasterloom.llm import stable as S
from tests.conftest import rows

SAMPLES = "sample_id bigint, case_id string, patient_id string, side string, view string, task string, release_no int, pi double"
ROIS = "roi_row_id bigint, file_id string, roi_no int, name string, n int"
TARGETS = "cell_id bigint, draw_id int, draw_size bigint, side string, task string, view string, roi_name string, share double, min_rows bigint"


@pytest.fixture(scope="module")
def samples(spark):
    data = []
    for p in range(300):
        for side in ("LEFT", "right "):
            data.append((len(data), f"Mass-Test_P_{p:05d}_{side.strip().upper()}_CC", f"P_{p:05d}", side, "C.C.", "MassTest", 1 + p % 4, 0.0))
    data += [(9000, None, "P_1", "L", "CC", "mass-test", 4, 0.0), (9001, None, None, None, None, None, None, None), (9002, "", "", "", "", "", 1, None)]
    return spark.createDataFrame(data, SAMPLES)


@pytest.fixture(scope="module")
def rois(spark):
    names = ["Calcification", " calcification_", "Calcifcation", "Mass", "Masses", "mass 3", "???", None, "", "Unknown", "Lymp hNode", "Mask"]
    data = [(i, f"f{i}", 0, n, 0) for i, n in enumerate(names * 5)] + [(900, "f0", 0, "Mass", 0), (901, None, 0, "Mass", 0), (902, "f1", None, "Mass", 0)]
    return spark.createDataFrame(data, ROIS)


def cells(spark, *more):
    return spark.createDataFrame(
        [
            (1, 1, 100, "LEFT", None, None, None, 0.7, 0), (2, 1, 100, "RIGHT", None, None, None, 0.3, 40),
            (3, 2, 30, None, None, None, "Calcification", 0.5, 0), (4, 2, 30, None, None, None, "Mass", 0.5, 20), (5, 2, 30, None, None, None, "Lymph Node", 0.0, 3), (6, 2, 30, None, None, None, "Axilla Fold", 0.1, 0),
            *more,
        ],
        TARGETS,
    )


def test_draw_meets_targets_and_reports_the_rest(spark, samples, rois):
    sample, report = D.cube_draw(samples, rois, cells(spark))
    r = {x.cell_id: x for x in report.collect()}
    assert (r[1].available, r[2].available) == (300, 300)
    assert (r[1].need, r[2].need, r[2].goal >= 40) == (70, 40, True)
    assert sum(r[c].drawn for c in (1, 2)) == 100 and all(abs(x.drawn - x.goal) <= 1 and x.residual == x.drawn - x.need for x in r.values())
    assert [x.cell_id for x in r.values() if not x.met] == [x.cell_id for x in r.values() if x.drawn < x.need] and not r[1].met  # the minimum of the other cell takes its rows
    assert (r[3].available, r[4].available, r[5].available, r[6].available) == (15, 16, 5, 0)
    assert rows(D.unmet(report), "draw_id", "cell_id") == [(2, 4), (2, 6)]
    assert sample.groupBy("draw_id", "row_id").count().where("count > 1").count() == 0
    counted = sample.select("draw_id", F.explode("cells").alias("cell_id")).groupBy("draw_id", "cell_id").count()
    assert {(x.draw_id, x.cell_id): x["count"] for x in counted.collect()} == {(x.draw_id, x.cell_id): x.drawn for x in r.values() if x.drawn}


@pytest.mark.parametrize("per_part", [50, 3])
def test_parts_merge_upward(spark, samples, rois, monkeypatch, per_part):
    monkeypatch.setattr(D, "UNITS_PER_PART", per_part)
    monkeypatch.setattr(D, "FAN_IN", 3)
    sample, report = D.cube_draw(samples, rois, cells(spark))
    assert all(x.drawn == x.goal for x in report.where("draw_id = 1").collect())
    assert all(abs(x.drawn - x.goal) <= 1 for x in report.collect())
    assert rows(sample, "draw_id", "row_id") == rows(D.cube_draw(samples.repartition(3), rois, cells(spark))[0], "draw_id", "row_id")


def test_marginal_cells_overlap(spark, samples, rois):
    two = spark.createDataFrame(
        [(1, 1, 100, "LEFT", None, None, None, 0.25, None), (2, 1, 100, "RIGHT", None, None, None, 0.75, 0), (3, 1, 100, None, "Mass-Test", None, None, 1.0, 0), (4, 1, None, None, None, "CC", None, None, None)], TARGETS
    )
    r = {x.cell_id: x for x in D.cube_draw(samples, rois, two)[1].collect()}
    assert (r[1].drawn, r[2].drawn, r[3].drawn) == (25, 75, 100) and all(r[c].met for c in (1, 2, 3)) and 4 not in r


def test_names(spark):
    words = ["calcification", "calcifications", "calcifcation", "clacification", "calcificationx", "calcif", "mas", "masses", "lymphnod", "lymphnodeee", "x" * 5000]
    k = spark.createDataFrame([(w,) for w in [*words, "", None]], "k string")
    names = spark.createDataFrame([("Calcification",), ("Mass",), ("Lymph Node",), (None,), ("",)], "roi_name string")
    want = {**dict.fromkeys(words[:5], "Calcification"), "masses": "Mass", "lymphnod": "Lymph Node"}
    assert {r.k: r.name for r in D.spelt_names(k, names).collect()} == want


def test_odds_meet_overlapping_goals():
    member = np.array([[1, 0], [0, 1], [1, 1]], bool)
    pi = D.fit_odds(member, np.array([50.0, 80.0, 10.0]), np.array([30.0, 20.0]))
    assert np.allclose((member * (pi * [50, 80, 10])[:, None]).sum(axis=0), [30, 20])
    assert np.allclose(D.fit_odds(np.ones((2, 1), bool), np.array([3.0, 5.0]), np.array([8.0])), 1)


def test_landing_gives_up_the_greatest_goal_first():
    x = np.array([[1, 0, 1], [0, 1, 1]], np.uint8)
    out = [D.land(np.array([0.5, 0.5]), x, np.array([1.0, 90.0]), np.random.default_rng(s)) for s in range(400)]
    assert all(o.sum() == 1 and set(o) == {0.0, 1.0} for o in out) and abs(np.mean([o[0] for o in out]) - 0.5) < 0.1


def test_a_rerun_draws_the_same(spark, samples, rois):
    a, b = (rows(D.cube_draw(samples.repartition(n), rois, cells(spark))[0], "draw_id", "row_id") for n in (1, 5))
    assert a == b


def test_empty(spark, samples, rois):
    sample, report = D.cube_draw(samples.limit(0), rois.limit(0), cells(spark))
    assert sample.count() == 0 and report.where("drawn > 0").count() == 0 and report.where("not met").count() == 6
    assert D.cube_draw(samples, rois, cells(spark).limit(0))[1].count() == 0


def test_overlapping_cells_keep_their_totals():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (400, 5)).astype(float)
    pi = rng.uniform(0.05, 0.95, 400)
    out = D.flight(pi, x, np.random.default_rng(1))
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 5
    assert np.allclose(x.T @ out, x.T @ pi)


def test_flight_keeps_the_inclusion_probabilities():
    pi = np.array([0.2, 0.5, 0.8, 0.5])
    x = np.ones((4, 1))
    mean = np.mean([D.flight(pi, x, np.random.default_rng(s)) for s in range(4000)], axis=0)
    assert np.allclose(mean, pi, atol=0.03)


def test_stable_sample_grows(spark, samples):
    early, late = (set(rows(S.stable_sample(samples.where(F.col("release_no") <= k).repartition(k + 1)), "case_name", "seq")) for k in (2, 4))
    assert early < late
    seq = sorted(r.seq for r in S.sequence_numbers(samples).collect())
    assert seq == list(range(600))  # the blank rows are no case, the redelivered one is no new one


def test_every_block_has_its_positions(spark):
    b = spark.range(S.BLOCK * 40).withColumn("on", S.chosen(F.col("id"), "s"))
    per = b.groupBy(F.floor(F.col("id") / S.BLOCK).alias("b")).agg(F.count_if("on").alias("n"))
    assert {r.n for r in per.collect()} == {S.TAKE}


def test_stable_sample_empty(spark, samples):
    assert S.stable_sample(samples.limit(0)).count() == 0
