"""Geometry, COCO and image JSON against the published example values."""

import json
import math

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from rasterloom.functions import coco as C
from rasterloom.functions import geometry as G
from rasterloom.functions import pointwise as P


def one(spark, shape, coords, expr):
    return spark.createDataFrame([(shape, coords and [float(v) for v in coords])], "shape string, co array<double>").select(expr(F.col("shape"), F.col("co")).alias("x")).first().x


def test_c2_centers(spark):
    assert tuple(one(spark, "RECTANGLE", [10.0, 20, 30, 40], G.center)) == (20, 30)
    assert tuple(one(spark, "POLYGON", [0.0, 0, 10, 0, 10, 10, 0, 10], G.center)) == (5, 5)
    assert one(spark, None, [1.0], G.center) is None and one(spark, "POLYGON", None, G.center) is None


def test_c3_boxes(spark):
    assert one(spark, "ELLIPSE", [50.0, 60, 10, 20], G.bounding_box) == [40, 40, 60, 80]
    assert one(spark, "POLYGON", [5.0, 10, 15, 5, 25, 20, 10, 25], G.bounding_box) == [5, 5, 25, 25]


def test_c4_padding_and_clamping(spark):
    assert one(spark, "RECTANGLE", [10.0, 20, 30, 40], lambda s, c: G.padded_box(s, c, 5)) == [5, 15, 35, 45]
    assert one(spark, "RECTANGLE", [0.0, 0, 50, 50], lambda s, c: G.padded_box(s, c, 10, F.lit(40), F.lit(40))) == [0, 0, 40, 40]
    assert one(spark, "RECTANGLE", [10.0, 20, 30, 40], lambda s, c: G.ellipse_of_box(G.bounding_box(s, c))) == [20, 30, 10, 10]


@pytest.mark.parametrize("shape, coords", [("RECTANGLE", [1.0, 2, 3]), ("ELLIPSE", [1.0]), ("POLYGON", [1.0, 2, 3, 4]), ("STAR", [1.0])])
def test_c1_invalid(spark, shape, coords):
    assert one(spark, shape, coords, G.is_valid) is False
    with pytest.raises(SparkRuntimeException, match=shape.title()):
        one(spark, shape, coords, G.checked)


def test_c6_outlines(spark):
    assert one(spark, "RECTANGLE", [10.0, 20, 30, 40], G.segmentation) == [10, 20, 30, 20, 30, 40, 10, 40]
    ring = one(spark, "ELLIPSE", [100.0, 200, 50, 30], G.segmentation)
    assert len(ring) == 72 and math.isclose(ring[0], 150) and math.isclose(ring[1], 200)


def test_c7_c8_document_round_trip(spark):
    a = spark.createDataFrame(
        [(f, n, s, [float(v) for v in c], label) for f, n, s, c, label in [("b.dcm", 1, "RECTANGLE", [10.0, 20, 30, 40], "mass"), ("b.dcm", 2, "POLYGON", [5.0, 10, 15, 5, 25, 20], None), ("c.dcm", 3, "ELLIPSE", [100.0, 200, 50, 30], "calc"), ("x.dcm", 4, "RECTANGLE", [1.0, 2, 3, 4], "mass"), ("b.dcm", 5, "RECTANGLE", [1.0], "mass")]],
        "file_name string, ann_no bigint, shape string, coordinates array<double>, label string",
    )
    images = C.coco_images(spark.createDataFrame([("c.dcm", 5, 6), ("b.dcm", 7, 8), (None, 1, 1)], "file_name string, h int, w int"))
    cats = C.coco_categories(a)
    assert [(r.id, r.name) for r in cats.orderBy("id").collect()] == [(1, "mass"), (2, "unknown"), (3, "calc")]
    ann = C.coco_annotations(a, images, cats)
    first = ann.where("ann_no = 1").first()
    assert first.bbox == [10, 20, 20, 20] and first.area == 400 and first.iscrowd == 0
    doc = C.coco_document(images, cats, ann)
    parsed = json.loads(doc.first().json)
    assert [i["file_name"] for i in parsed["images"]] == ["b.dcm", "c.dcm"] and len(parsed["annotations"]) == 3
    back = {r.coco_id: r for r in C.coco_import(doc).collect()}
    assert {r.shape for r in back.values()} == {"POLYGON"} and {r.label for r in back.values()} == {"mass", "unknown", "calc"}


def test_c8_box_where_the_outline_is_empty(spark):
    text = json.dumps({"images": [{"id": 1, "file_name": "a"}], "categories": [], "annotations": [{"id": 9, "image_id": 1, "category_id": 4, "bbox": [10, 20, 30, 40], "segmentation": [[]]}, {"id": 10, "image_id": 2, "bbox": [0, 0, 1, 1]}]})
    got = C.coco_import(spark.createDataFrame([(text,), ("{broken",), (None,)], "json string")).collect()
    assert [(r.shape, r.coordinates, r.label) for r in got] == [("RECTANGLE", [10, 20, 40, 60], "unknown")]


def test_k4_s11_image_json(spark):
    ann = C.annotation_struct(F.lit("RECTANGLE"), F.array(*[F.lit(float(v)) for v in (10, 20, 30, 40)]), F.lit("mass"))
    df = spark.range(1).select(F.lit("p").alias("file_path"), F.lit(200).alias("w"), F.lit(300).alias("h"), F.lit("Odd").alias("image_type"), F.array(ann).alias("annotations"))
    s = df.select(C.image_from_json(C.image_json(df)).alias("s")).first().s
    assert (s.width, s.height, s.image_type) == (200, 300, "InMemoryImage") and s.annotations[0].center.x == 20


def test_c11_add_and_remove(spark):
    base = spark.range(1).select(F.lit(None).cast("array<int>").alias("none"), F.array(F.lit(1), F.lit(2)).alias("two"))
    got = base.select(C.add_annotation(F.col("none"), F.lit(7)).alias("a"), C.remove_annotation(F.col("two"), 0).alias("b")).first()
    assert got.a == [7] and got.b == [2]
    for bad in (2, -1):
        with pytest.raises(SparkRuntimeException):
            base.select(C.remove_annotation(F.col("two"), bad)).collect()


def test_pointwise_nulls_and_limits(spark):
    df = spark.createDataFrame([(None,), (1000.0,), (-5.0,), (9000.0,)], "v double")
    got = [r.x for r in df.select(P.dicom_window(F.col("v"), 1000, 100).alias("x")).collect()]
    assert got[1:] == [127.5, 0.0, 255.0]
    assert df.select(P.bits_stored(F.lit(200.0)), P.bits_stored(F.lit(4000.0)), P.bits_stored(F.lit(5000.0))).first()[:] == (8, 12, 16)


def test_numbering_follows_the_order(spark):
    df = spark.createDataFrame([(f"n{i:03d}",) for i in range(50)][::-1], "name string").repartition(7)
    got = C.numbered(df, ["name"], "id").orderBy("id").collect()
    assert [r.name for r in got] == [f"n{i:03d}" for i in range(50)] and [r.id for r in got] == list(range(1, 51))


def test_a_large_document_is_imported_in_linear_time(spark):
    """100,000 images in one document: every id is looked up once."""
    import json
    import time

    from rasterloom.functions import coco

    def document(n):
        return json.dumps({
            "images": [{"id": i, "file_name": f"{i}.dcm", "width": 4, "height": 4} for i in range(n)], "categories": [{"id": 1, "name": "Mass"}],
            "annotations": [{"id": i, "image_id": n - 1 - i, "category_id": 1 + i % 2, "bbox": [0, 0, 1, 1]} for i in range(n)],
        })

    took = {}
    for n in (1_000, 100_000):
        df = spark.createDataFrame([(document(n),)], "json string")
        start = time.time()
        got = coco.coco_import(df).selectExpr("count(*) n", "count(distinct file_name) f", "count_if(label = 'unknown') u").first()
        took[n] = time.time() - start
        assert tuple(got) == (n, n, n // 2)
    assert took[100_000] < 60
