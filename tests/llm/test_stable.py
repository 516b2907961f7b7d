"""Samples by stored numbers: nothing chosen is ever lost, however the table grows."""

import random

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import stable as S
from tests.conftest import rows

DDL = "sample_id bigint, case_id string, patient_id string, side string, view string, task string, release_no int, arrived int, seq string, delivery string"  # the last two clash with inner names


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(5)
    data = []
    for i in range(1500):
        p = r.randrange(500)
        release = r.choice([1, 2, 3, 4, None])
        late = r.random() < 0.2
        arrived = None if r.random() < 0.02 else (release or 2) + (r.randrange(1, 5) if late else 0)
        data.append((i, f"Mass-Test_P_{p:05d}_LEFT_CC", r.choice([None, f"P_{p}"]), "left", " cc", "mass test", release, arrived, "x", None))
    data += [(9001, None, None, None, None, None, None, None, None, None), (9002, "", "", "", "", "", 1, 1, "", "")]
    return spark.createDataFrame(data, DDL)


@pytest.mark.parametrize("by", ["release_no", "arrived"])
def test_nothing_is_lost(spark, samples, tmp_path, by):
    ledger = S.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.read().count() == 0 and ledger.sample().count() == 0
    before, steps = set(), [samples.where(F.col(by) <= k) for k in (1, 3)] + [samples]
    for k, part in enumerate(steps):
        ledger.extend(part.repartition(k + 1))
        now = set(rows(ledger.sample(), "case_name", "seq"))
        assert before <= now and len(now) > 0
        before = now
    assert ledger.extend(samples) == 0 and set(rows(ledger.sample(), "case_name", "seq")) == before
    seq = sorted(r.seq for r in ledger.read().collect())
    cases = S.first_seen(samples).count()
    assert seq == list(range(cases)) and abs(len(before) - cases * S.TAKE / S.BLOCK) <= S.TAKE


def test_a_late_row_of_an_old_release_goes_to_the_end(spark, samples, tmp_path):
    ledger = S.Ledger(spark, str(tmp_path / "l"))
    ledger.extend(samples.where("case_id not like '%P_0000%'"))
    held = {r.case_name: r.seq for r in ledger.read().collect()}
    assert ledger.extend(samples) > 0
    now = {r.case_name: r.seq for r in ledger.read().collect()}
    assert all(now[c] == s for c, s in held.items()) and min(s for c, s in now.items() if c not in held) == len(held)


def test_without_a_ledger_the_table_is_one_delivery(spark, samples, tmp_path):
    ledger = S.Ledger(spark, str(tmp_path / "l"))
    one = rows(S.stable_sample(samples), "case_name", "first_release", "seq", "block_no")
    assert one == rows(S.stable_sample(samples.repartition(7), ledger=ledger), "case_name", "first_release", "seq", "block_no")


def test_replay(spark, samples):
    ledger = S.replay(samples, F.col("arrived"))
    assert sorted(r.seq for r in ledger.read().collect()) == list(range(S.first_seen(samples).count()))
    assert S.replay(samples.limit(0), F.col("arrived")).sample().count() == 0
