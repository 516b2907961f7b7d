"""Splits: groups against union-find, bins, allocation."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.llm import splits as S
from tests.conftest import rows

DDL = "patch_id bigint, build_id bigint, patch_idx bigint, case_id string, patient_id string, num bigint, component string"  # the last two clash with inner names


def brute(data):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    import re

    for pid, b, i, c, p, *_ in data:
        keys = [("R", pid)]
        if m := re.fullmatch(r"\s*(?:[Pp][\s_\-]*)?(\d+)\s*", p or ""):
            keys.append(("P", int(m[1])))
        if m := re.search(r"(?i)(?:^|[^a-z])p[\s_\-]*(\d+)", c or ""):
            keys.append(("P", int(m[1])))
        if b is not None and i is not None:
            keys.append(("B", b, i))
        for k in keys[1:]:
            parent[find(keys[0])] = find(k)
    low = {}
    for k in list(parent):
        if k[0] == "P":
            low[find(k)] = min(low.get(find(k), k[1]), k[1])
    return {d[0]: low.get(find(("R", d[0]))) for d in data}, {d[0]: find(("R", d[0])) for d in data}


def table(seed, n=120):
    r = random.Random(seed)
    out = []
    for i in range(n):
        p = r.choice([None, "", "P_", "n/a", f"P_{r.randrange(40):05d}", f" p-{r.randrange(40)}", str(r.randrange(40))])
        c = r.choice([None, "", "Mass-Test_P_", f"Calc-Training_P_{r.randrange(40):05d}_LEFT_CC", f"mass test p {r.randrange(40)} right mlo"])
        out.append((i, r.choice([1, 2, None]), r.choice([None, r.randrange(60)]), c, p, 1, "x"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_union_find(spark, seed):
    data = table(seed)
    want, roots = brute(data)
    g = S.record_groups(spark.createDataFrame(data, DDL)).cache()
    assert {r.patch_id: r.group_no for r in g.collect()} == want
    keys = {}
    for r in g.collect():
        keys.setdefault(r.group_key, set()).add(roots[r.patch_id])
    assert all(len(v) == 1 for v in keys.values()) and len(keys) == len(set(roots.values()))
    cases = {(i, want[i]) for i, *_, p, _, _ in data if want[i] is not None and p != f"P_{want[i]:05d}"}
    assert set(rows(S.contradictions(g), "patch_id", "group_no")) == cases


def test_assignment_keeps_groups_and_shares(spark):
    data = [(i, i % 7, i, f"Calc-Test_P_{i % 300:05d}_LEFT_CC", None, 0, "") for i in range(6000)]
    g = S.record_groups(spark.createDataFrame(data, DDL))
    plan = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15), (None, 0.1)], "split_name string, share double")
    a = S.assign_splits(g, S.read_plan(plan))
    assert a.groupBy("group_key").agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0
    report = {r.split_name: r.actual_share for r in S.split_report(a, plan.where("split_name is not null")).collect()}
    assert all(abs(report[k] - v) < 0.03 for k, v in (("train", 0.7), ("validation", 0.15), ("test", 0.15)))
    assert rows(a, "patch_id", "split_name") == rows(S.assign_splits(g.repartition(7), S.read_plan(plan)), "patch_id", "split_name")


@pytest.mark.parametrize("per_part", [40, 7])
def test_parts_merge_upward(spark, monkeypatch, per_part):
    monkeypatch.setattr(S, "COMPONENTS_PER_PART", per_part)
    monkeypatch.setattr(S, "FAN_IN", 3)
    r = random.Random(2)
    g = spark.createDataFrame([(k, f"P{k % r.randrange(1, 120)}") for k in range(4000)], "patch_id bigint, group_key string")
    plan = [("test", 0.15), ("train", 0.7), ("validation", 0.15)]
    a = S.assign_splits(g, plan)
    assert a.count() == 4000 and a.where("split_name is null").count() == 0
    assert a.groupBy("group_key").agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0
    got = {x.split_name: x["count"] / 4000 for x in a.groupBy("split_name").count().collect()}
    assert all(abs(got[k] - v) < 0.02 for k, v in plan)


def test_empty_plan(spark):
    g = spark.createDataFrame([(1, "P1")], "patch_id bigint, group_key string")
    assert rows(S.assign_splits(g, []), "patch_id", "split_name") == [(1, None)]


def test_empty(spark):
    g = S.record_groups(spark.createDataFrame([], DDL))
    assert S.assign_splits(g, [("train", 1.0)]).count() == 0 and S.contradictions(g).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 50), min_size=4, max_size=4), min_size=1, max_size=12))
def test_differencing_places_every_weight(weights):
    sums, place = S.largest_differencing([tuple(map(float, w)) for w in weights])
    got = [0.0] * 4
    for w, p in zip(weights, place):
        for slot, x in enumerate(w):
            got[p[slot]] += x
            assert x == 0 or 0 <= p[slot] < 4
    nonzero = sum(x > 0 for w in weights for x in w)
    assert sum(got) == sum(map(sum, weights)) and (nonzero == 0 or sorted(got) == sorted(sums))
    for w, p in zip(weights, place):  # slots of one input never share a bin
        used = [b for b, x in zip(p, w) if x]
        assert len(used) == len(set(used))


def test_differencing_balances():
    r = random.Random(1)
    w = [r.randrange(1, 100) for _ in range(400)]
    sums, _ = S.largest_differencing([(float(x), *[0.0] * 9) for x in w])
    assert max(sums) - min(sums) <= 2


def test_whole_bins_go_to_splits():
    assert S.allocate_bins([10.0, 1.0, 1.0], [("a", 0.8), ("b", 0.2)]) == ["a", "b", "b"]
    assert S.allocate_bins([0.0], [("a", 1.0)]) == ["a"]
