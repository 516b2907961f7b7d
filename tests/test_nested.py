"""Structural indexing against a plain JSON reader."""

import json
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rasterloom.operators import nested as N
from tests.conftest import rows


def number(v):
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, str) and not re.fullmatch(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", v, re.ASCII):
        return None
    if not isinstance(v, (int, float, str)):
        return None
    return f if math.isfinite(f := float(v)) else None


def listed(v):
    return [] if v is None else v if isinstance(v, list) else [v]


def get(o, names):
    return next((v for k, v in reversed(list(o.items())) if k in names), None)


def brute(body):
    try:
        o = json.loads(body)
        while isinstance(o, str):
            o = json.loads(o)
    except ValueError:
        return []
    if not isinstance(o, dict):
        return []
    level = [o]
    while level and not any(set(v) & set(N.IMAGES) for v in level):
        level = [v for x in level for v in x.values() if isinstance(v, dict)]
    o = next((v for v in level if set(v) & set(N.IMAGES)), {})
    out = []
    for i, im in enumerate(listed(get(o, N.IMAGES))):
        if not isinstance(im, dict):
            continue
        out.append(("image", i, -1, -1, -1))
        for j, r in enumerate(listed(get(im, N.ROIS))):
            if not isinstance(r, dict):
                continue
            t = number(get(r, N.ROI_TYPE))
            out.append(("roi", i, j, -1, int(t) if t is not None and t == int(t) and abs(t) < 2**31 else -1))
            for k, p in enumerate(listed(get(r, N.POINTS))):
                x = y = None
                if isinstance(p, str) and (m := re.fullmatch(r"\s*\(([^,]*),([^,)]*)(,[^)]*)?\)\s*", p)):
                    x, y = number(m[1]), number(m[2])
                elif isinstance(p, dict):
                    x, y = number(p.get("x")), number(p.get("y"))
                elif isinstance(p, list) and len(p) >= 2:
                    x, y = number(p[0]), number(p[1])
                if x is not None and y is not None and x >= 0 and y >= 0:
                    out.append(("point", i, j, k, -1))
    return out


def flat(bodies):
    got = pa.Table.from_batches(N._flatten([b.encode("utf-8", "surrogatepass") for b in bodies], np.arange(len(bodies))), schema=N.SCHEMA).to_pylist()
    per = [[] for _ in bodies]
    for r in got:
        per[r["record_id"]].append((r["kind"], r["image_no"], r["roi_no"], r["point_no"], r["roi_type"]))
    return [sorted(p) for p in per]


scalars = st.one_of(st.none(), st.booleans(), st.integers(-5, 40), st.floats(-5, 40, allow_nan=False), st.sampled_from(["", " 19", "7", "x", '"', "\\", "a\\\"b{[", "(1, 2)", "( 3.5 ,4)", "(1, -2)", "(nan, 1)", "(1)", "(1, 2, 3)", "é😀"]))
points = st.one_of(scalars, st.fixed_dictionaries({}, optional={"x": scalars, "y": scalars}), st.lists(scalars, max_size=3))
roi = st.one_of(scalars, st.fixed_dictionaries({}, optional={"Name": scalars, "Type": scalars, "roi_type": scalars, "Point_px": st.one_of(points, st.lists(points, max_size=4)), "Stats": st.dictionaries(st.text(max_size=3), st.lists(scalars, max_size=2), max_size=2)}))
image = st.one_of(scalars, st.fixed_dictionaries({}, optional={"ROIs": st.one_of(roi, st.lists(roi, max_size=3)), "rois": st.one_of(st.none(), st.lists(roi, max_size=2)), "k": scalars}))
document = st.fixed_dictionaries({}, optional={"Images": st.one_of(image, st.lists(image, max_size=3)), "Reader": st.dictionaries(st.text(max_size=3), scalars, max_size=2)})


@st.composite
def bodies(draw):
    doc = draw(document)
    how = draw(st.integers(0, 4))
    if how == 1:
        doc = {"plist": doc, "n": 1}
    text = json.dumps(doc, ensure_ascii=draw(st.booleans()), indent=draw(st.sampled_from([None, 1])))
    if how == 2:
        text = json.dumps(text)
    if how == 3:
        text = text[: draw(st.integers(0, len(text)))]
    return draw(st.sampled_from(["", " ", "\n"])) + text


@settings(max_examples=300, deadline=None)
@given(st.lists(bodies(), min_size=1, max_size=6))
def test_equals_a_plain_reader(texts):
    assert flat(texts) == [sorted(brute(t)) for t in texts]


@pytest.mark.parametrize("text", ["", "  ", "null", "[]", "3", '"abc"', "{", "}", '{"Images": [', '{"Images": [{}]]', '{"Images": [{}}', '{}{"Images": [{}]}', '{"Images": [{}]} x', '{"Images" [{}]}', '{"Images": [{},]}', "[" * 500, '{"a": "' + "\\" * 7])
def test_broken_texts_give_nothing(text):
    assert flat([text, '{"Images": {}}']) == [[], [("image", 0, -1, -1, -1)]]


def test_escaped_keys_and_repeated_keys():
    assert flat([r'{"Images": [{}, null, {}]}', '{"Images": [{}], "Images": []}']) == [[("image", 0, -1, -1, -1), ("image", 2, -1, -1, -1)], []]


def test_deep_and_long_texts():
    deep = '{"x": ' + "[" * 3000 + "]" * 3000 + ', "Images": [{"ROIs": [{"Type": 3}]}]}'
    long = json.dumps({"Images": [{"ROIs": [{"Point_px": [[1, 2]] * 60_000}]}]})
    assert flat([deep])[0][-1] == ("roi", 0, 0, -1, 3)
    assert len(flat([long])[0]) == 60_002


def test_tables(spark):
    x = spark.createDataFrame([(1, '{"Images": [{"ROIs": []}]}', 0), (None, '{"Images": [{}]}', 0), (2, None, 0), (3, '{"Images": [{}]}', 0), (3, '{"Images": [{}]}', 0)], "xml_id bigint, body string, kind int")
    assert rows(N.flatten_documents(x), "kind", "record_id", "image_no") == [("image", 1, 0), ("image", 3, 0), ("image", 3, 0)]
    s = spark.createDataFrame([(9, [("a", None), None, ("", " "), (None, "m")]), (8, None), (7, []), (None, [("a", "b")])], "sample_id bigint, roi_entries array<struct<roi_path:string,mask_path:string>>")
    assert rows(N.flatten_roi_entries(s), "record_id", "roi_no") == [(9, 0), (9, 3)]
    assert N.flat_children(x.limit(0), s.limit(0)).count() == 0


@pytest.mark.parametrize("depth", [0, 1, 2, 3, 7])
def test_wrappers_of_any_depth(depth):
    doc = {"Images": [{"ROIs": [{"Type": 3, "Point_px": ["(1, 2)"]}]}]}
    objects, strings, mixed = dict(doc), json.dumps(doc), dict(doc)
    for k in range(depth):
        objects, strings = {"n": k, "in": objects}, json.dumps(strings)
        mixed = {"n": k, "in": json.dumps(mixed) if k % 2 else mixed}
    want = [("image", 0, -1, -1, -1), ("point", 0, 0, 0, -1), ("roi", 0, 0, -1, 3)]
    assert flat([json.dumps(objects), strings, json.dumps(mixed)]) == [want] * 3
    assert flat([json.dumps({"a": {"b": {"c": 1}}})]) == [[]]
