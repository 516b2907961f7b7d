"""Connected components on Spark, identity columns."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rasterloom.llm import identity as I
from rasterloom.llm.graph import connected_components
from pyspark.sql import functions as F

from tests.conftest import rows


def brute(edges):
    comp = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        x, y = comp.setdefault(a, {a}), comp.setdefault(b, {b})
        if x is not y:
            x |= y
            for n in y:
                comp[n] = x
    return sorted((n, min(c)) for n, c in comp.items())


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=20))
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 3), (4, None), (5, 5)], "a bigint, b bigint")
    assert rows(connected_components(df), "node", "component") == sorted(brute(edges), key=repr)


def test_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(64)]
    hub = [(1000, i) for i in range(2000, 2200)]
    got = dict(rows(connected_components(spark.createDataFrame(path + hub + path, "a bigint, b bigint")), "node", "component"))
    assert {got[i] for i in range(65)} == {0} and {got[i] for i in range(2000, 2200)} == {1000}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint, x int")).count() == 0


def test_identities(spark):
    df = spark.createDataFrame(
        [("P_00532", "Mass-Test_P_00038_LEFT_CC"), (" p-7 ", "calc training p 12 right mlo.dcm"), ("P_", "Calc-Training_"), ("n/a", None), ("17", "CBIS-DDSM/MASS-TRAINING_P_00009_LEFT_CC_2"), (None, "")],
        "p string, c string",
    )
    got = df.select(I.patient_in_id(F.col("p")), I.patient_in_case(F.col("c")), I.side_in_case(F.col("c")), I.view_in_case(F.col("c")), I.task_in_case(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [
        (532, 38, "LEFT", "CC", "Mass-Test"), (7, 12, "RIGHT", "MLO", "Calc-Training"), (None, None, None, None, "Calc-Training"),
        (None, None, None, None, None), (17, 9, "LEFT", "CC", "Mass-Training"), (None, None, None, None, None),
    ]
    names = spark.createDataFrame([("MassTest", " l ", "M-L-O"), ("mass_train", "Right ", "view cc"), ("x", "", " "), (None, None, None)], "t string, s string, v string")
    assert [tuple(r) for r in names.select(I.task_of(F.col("t")), I.side_of(F.col("s")), I.view_of(F.col("v"))).collect()] == [("Mass-Test", "LEFT", "MLO"), ("Mass-Training", "RIGHT", "CC"), (None, None, None), (None, None, None)]


def test_one_edit(spark):
    pairs = [("cluster", "clutser"), ("cluster", "cluste"), ("cluster", "clusterr"), ("cluster", "blaster"), ("cluster", "clsuetr"), ("", ""), ("ab", "ba"), ("a", "")]
    got = spark.createDataFrame(pairs, "a string, b string").select(I.within_one_edit(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.x for r in got] == [True, True, True, False, False, True, True, True]
