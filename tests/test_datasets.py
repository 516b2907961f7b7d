"""Samples from generated trees, regions and masks."""

import plistlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions.geometry import inside_vertices
from rasterloom.operators import regions as G
from rasterloom.plans import datasets as D
from rasterloom.sources import codecs
from tests.conftest import rows

X = np.random.RandomState(0).randint(0, 4000, (12, 10))


@pytest.fixture(scope="module")
def cbis(tmp_path_factory):
    root = tmp_path_factory.mktemp("c") / "CBIS-DDSM"
    mask = np.zeros((12, 10))
    mask[2:5, 3:6] = 255
    small = np.zeros((6, 5))
    small[5, 4] = 1
    for path, x in {
        "Calc-Test_P_00038_LEFT_CC/s/full mammogram images/1-1.dcm": X,
        "Calc-Test_P_00038_LEFT_CC_1/s/cropped images/1-1.dcm": X[3:9, 2:8],
        "Calc-Test_P_00038_LEFT_CC_1/s/ROI mask images/1-2.dcm": mask,
        "Mass-Training_P_00001_RIGHT_MLO/s/full mammogram images/1-1.dcm": X + 1,
        "Mass-Training_P_00001_RIGHT_MLO_1/s/ROI mask images/1-1.dcm": small,
        "Mass-Training_P_00002_RIGHT_MLO/s/full mammogram images/1-1.dcm": X + 2,
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(codecs.encode_dicom(x))
    return str(root), mask > 0


def test_q10_full_images(spark, cbis):
    root, mask = cbis
    got = {r.case_id: r for r in D.cbis_full_images(spark, root).collect()}
    one = got["Calc-Test_P_00038_LEFT_CC"]
    assert np.array_equal(np.reshape(one.pixels, (12, 10)), X) and np.array_equal(np.reshape(one.mask, (12, 10)), mask)
    grown = np.reshape(got["Mass-Training_P_00001_RIGHT_MLO"].mask, (12, 10))
    assert grown.sum() == 4 and grown[10:, 8:].sum() == 4  # nearest pixels of the half-size mask
    assert sum(got["Mass-Training_P_00002_RIGHT_MLO"].mask) == 0


def test_q11_q12_patches_and_boxes(spark, cbis):
    full = D.cbis_full_images(spark, cbis[0])
    p = D.patches(full, 8, 4)
    assert p.count() == 3 * 3 * 3 and p.where("is_padded").count() == 3 * 7
    assert rows(D.located_rois(spark, cbis[0]), "case_id", "roi_no", "box") == [("Calc-Test_P_00038_LEFT_CC", 0, [2, 3, 8, 9])]
    assert D.cbis_cases(spark, cbis[0], 0.4).count() == 1
    r = D.resized(full, 6, 5).first()
    assert (r.h, r.w, len(r.mask)) == (6, 5, 30)


def test_q13_q14_inbreast(spark, tmp_path):
    for d in ("AllDICOMs", "AllXML", "AllMasks"):
        (tmp_path / d).mkdir()
    for i in (1, 2, 3):
        (tmp_path / f"AllDICOMs/{i}_a.dcm").write_bytes(codecs.encode_dicom(X))
    xml = plistlib.dumps({"Images": [{"ROIs": [{"Point_px": ["(2, 2)", "(7, 2)", "(7, 9)", "(2, 9)"]}, {"Point_px": ["(0, 0)"]}]}]})
    for i in (1, 2):
        (tmp_path / f"AllXML/{i}.xml").write_bytes(xml)
    (tmp_path / "AllMasks/2_mask.tif").write_bytes(codecs.encode_tiff(X > 2000))
    (tmp_path / "INbreast.csv").write_text("File Name;Laterality;View;Bi-Rads\n1;L;CC;4a\n2;R;MLO;3\n")
    got = {r.case_id: r for r in D.inbreast_samples(spark, str(tmp_path), str(tmp_path / "INbreast.csv")).collect()}
    assert {k: (r.mask_source, r.birads) for k, r in got.items()} == {"1": ("xml", -1), "2": ("tif", 3), "3": ("none", -1)}
    assert np.array_equal(np.reshape(got["2"].mask, X.shape), X > 2000) and sum(got["3"].mask) == 0
    m = np.reshape(got["1"].mask, X.shape)
    assert m[5, 4] == 1 and m[0, 0] == 1 and m[5, 8] == 0 and m.sum() == 7 * 5 + G.draw_points([(0, 0)], *X.shape).sum() - 1 * (G.draw_points([(0, 0)], *X.shape) & G.draw_points([(2, 2), (7, 2), (7, 9), (2, 9)], *X.shape)).sum()


def test_polygons_equal_the_column_rule(spark):
    pts = [(1.5, 0.5), (8.2, 3.0), (4.0, 9.5), (2.0, 4.0)]
    g = spark.range(120).select(F.floor(F.col("id") / 10).alias("r"), F.pmod("id", F.lit(10)).alias("c"))
    xs, ys = (F.array(*[F.lit(float(p[i])) for p in pts]) for i in (0, 1))
    inside = {(r.r, r.c) for r in g.where(inside_vertices(F.col("r"), F.col("c"), xs, ys)).collect()}
    assert inside == set(map(tuple, np.argwhere(G.fill_polygon(pts, 12, 10)).tolist()))
    assert G.fill_polygon([(0, -9), (5, -9), (3, -2)], 12, 10).sum() == 0


def test_one_and_two_points():
    d = G.draw_points([(5, 6)], 12, 10)
    assert d.sum() == 25 and d[6, 5] and not d[6, 8]
    assert G.draw_points([(2, 2), (7, 9)], 12, 10).sum() == 25 + 25


def test_crop(spark):
    df = spark.createDataFrame([(1, 3, 4, [float(v) for v in range(12)], 1, 0, 9, 2), (2, 3, 4, [0.0] * 12, 2, 2, 2, 3), (3, 3, 4, [0.0] * 12, None, 0, 1, 1), (4, 3, 4, None, 0, 0, 1, 1)], "image_id bigint, h int, w int, pixels array<double>, x_min int, y_min int, x_max int, y_max int")
    assert rows(G.crop(df), "image_id", "y_min", "x_min", "h", "w", "pixels") == [(1, 0, 1, 2, 3, [1.0, 2.0, 3.0, 5.0, 6.0, 7.0])]


def test_dice(spark):
    df = spark.createDataFrame([(1, 1, 4, [1.0, 1.0, 0.0, 0.0], [1.0, 0.0, 1.0, 0.0]), (2, 1, 1, [0.0], [0.0])], "image_id bigint, h int, w int, pixels array<double>, other array<double>")
    assert [round(r.dice, 6) for r in D.dice(df).orderBy("image_id").collect()] == [0.5, 0.0]
