"""Annotation and COCO queries. Annotations are made from ``part`` by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import coco as C
from rasterloom.functions import geometry as G
from rasterloom.operators import regions as R
from rasterloom.session import cut, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

PER_IMAGE = 4  # parts to an image


def annotations(spark: SparkSession, d: str) -> DataFrame:
    """ann_no, file_name, shape, coordinates, label: shape by p_partkey modulo 3."""
    k, s = F.col("p_partkey").cast("double"), F.col("p_size").cast("double")
    x, y = k % 50, s * 2.5
    shape = F.when(F.col("p_partkey") % 3 == 0, G.RECTANGLE).when(F.col("p_partkey") % 3 == 1, G.ELLIPSE).otherwise(G.POLYGON)
    coords = (
        F.when(shape == G.RECTANGLE, F.array(x, y, x + 20, y + s))
        .when(shape == G.ELLIPSE, F.array(x + 50, y + 60, s + 0.5, s / 2))
        .otherwise(F.array(x, y, x + 15, y - 5, x + 25, y + s, x + 10, y + 30))
    )
    file = F.concat(F.lit("img_"), F.lpad(F.floor(F.col("p_partkey") / PER_IMAGE).cast("string"), 8, "0"), F.lit(".dcm"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("ann_no"), file.alias("file_name"), shape.alias("shape"), coords.alias("coordinates"), F.col("p_brand").alias("label"))


A = """a AS (SELECT p_partkey AS ann_no, p_partkey % 3 AS kind, 'img_' || lpad(CAST(p_partkey // 4 AS VARCHAR), 8, '0') || '.dcm' AS file_name, p_brand AS label,
  CAST(p_partkey % 50 AS DOUBLE) AS x, p_size * 2.5::DOUBLE AS y, CAST(p_size AS DOUBLE) AS s FROM part),
 b AS (SELECT *, CASE kind WHEN 0 THEN [x, y, x + 20, y + s] WHEN 1 THEN [x + 50, y + 60, s + 0.5, s / 2] ELSE [x, y, x + 15, y - 5, x + 25, y + s, x + 10, y + 30] END AS co,
  CASE kind WHEN 0 THEN [x, y, x + 20, y + s] WHEN 1 THEN [trunc(x + 50 - s - 0.5), trunc(y + 60 - s / 2), trunc(x + 50 + s + 0.5), trunc(y + 60 + s / 2)] ELSE [x, least(y, y - 5, y + s, y + 30), x + 25, greatest(y, y - 5, y + s, y + 30)] END AS bb FROM a)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add




@query("annotation_bbox", f"WITH {A} SELECT ann_no, bb[1] AS x_min, bb[2] AS y_min, bb[3] AS x_max, bb[4] AS y_max FROM b")
def annotation_bbox(spark, d):
    a = annotations(spark, d).select("ann_no", G.bounding_box(F.col("shape"), F.col("coordinates")).alias("b"))
    return a.select("ann_no", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))])


@query("annotation_center", f"WITH {A} SELECT ann_no, round(CASE kind WHEN 0 THEN (co[1] + co[3]) / 2 WHEN 1 THEN co[1] ELSE (co[1] + co[3] + co[5] + co[7]) / 4 END, 4) AS cx, round(CASE kind WHEN 0 THEN (co[2] + co[4]) / 2 WHEN 1 THEN co[2] ELSE (co[2] + co[4] + co[6] + co[8]) / 4 END, 4) AS cy FROM b")
def annotation_center(spark, d):
    a = annotations(spark, d).select("ann_no", G.center(F.col("shape"), F.col("coordinates")).alias("m"))
    return a.select("ann_no", F.round("m.x", 4).alias("cx"), F.round("m.y", 4).alias("cy"))


@query("annotation_roi_padded", f"WITH {A} SELECT ann_no, greatest(bb[1] - 10, 0) AS x_min, greatest(bb[2] - 10, 0) AS y_min, least(bb[3] + 10, 60) AS x_max, least(bb[4] + 10, 80) AS y_max FROM b")
def annotation_roi_padded(spark, d):
    box = G.padded_box(F.col("shape"), F.col("coordinates"), 10, F.lit(80), F.lit(60))
    a = annotations(spark, d).select("ann_no", box.alias("b"))
    return a.select("ann_no", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("x_min", "y_min", "x_max", "y_max"))])


@query("annotation_roi_ellipse", f"WITH {A} SELECT ann_no, (bb[1] + bb[3]) / 2 AS cx, (bb[2] + bb[4]) / 2 AS cy, (bb[3] - bb[1]) / 2 AS rx, (bb[4] - bb[2]) / 2 AS ry FROM b")
def annotation_roi_ellipse(spark, d):
    a = annotations(spark, d).select("ann_no", G.ellipse_of_box(G.bounding_box(F.col("shape"), F.col("coordinates"))).alias("b"))
    return a.select("ann_no", *[F.get("b", F.lit(i)).alias(n) for i, n in enumerate(("cx", "cy", "rx", "ry"))])


@query("annotation_valid", "SELECT p_partkey AS ann_no, p_partkey % 5 <> 0 AS ok FROM part")
def annotation_valid(spark, d):
    """Every fifth annotation loses its last coordinates and is no longer valid."""
    a = annotations(spark, d).withColumn("coordinates", F.when(F.col("ann_no") % 5 == 0, F.slice("coordinates", 1, 3)).otherwise(F.col("coordinates")))
    return a.select("ann_no", G.is_valid(F.col("shape"), F.col("coordinates")).alias("ok"))


def _images(spark, d):
    return cut(C.coco_images(annotations(spark, d).select("file_name").distinct().select("file_name", F.lit(80).alias("h"), F.lit(60).alias("w"))))


IMG = "i AS (SELECT row_number() OVER (ORDER BY file_name) AS id, file_name FROM (SELECT DISTINCT file_name FROM b))"
CAT = "k AS (SELECT row_number() OVER (ORDER BY min(ann_no), label) AS id, label AS name FROM b GROUP BY label)"


@query("coco_images", f"WITH {A}, {IMG} SELECT id, file_name, 60 AS width, 80 AS height FROM i")
def coco_images(spark, d):
    return _images(spark, d)


@query("coco_categories", f"WITH {A}, {CAT} SELECT id, name FROM k")
def coco_categories(spark, d):
    return C.coco_categories(annotations(spark, d))


def _annotations(spark, d):
    a = annotations(spark, d)
    return C.coco_annotations(a, _images(spark, d), cut(C.coco_categories(a)))


@query("coco_annotations", f"""WITH {A}, {IMG}, {CAT} SELECT row_number() OVER (ORDER BY i.id, ann_no) AS id, i.id AS image_id, k.id AS category_id,
 bb[1] AS x, bb[2] AS y, bb[3] - bb[1] AS w, bb[4] - bb[2] AS h, (bb[3] - bb[1]) * (bb[4] - bb[2]) AS area, 0 AS iscrowd, CAST(CASE kind WHEN 1 THEN 72 ELSE 8 END AS INTEGER) AS n_outline
 FROM b JOIN i USING (file_name) JOIN k ON k.name = b.label""")
def coco_annotations(spark, d):
    at = lambda i, n: F.get("bbox", F.lit(i)).alias(n)
    return _annotations(spark, d).select("id", "image_id", "category_id", at(0, "x"), at(1, "y"), at(2, "w"), at(3, "h"), "area", "iscrowd", F.size(F.get("segmentation", F.lit(0))).alias("n_outline"))


@query("coco_import", f"WITH {A} SELECT file_name, CASE WHEN ann_no % 2 = 0 THEN 'POLYGON' ELSE 'RECTANGLE' END AS shape, CAST(CASE WHEN ann_no % 2 = 0 THEN CASE kind WHEN 1 THEN 72 ELSE 8 END ELSE 4 END AS INTEGER) AS n, round(CASE WHEN ann_no % 2 = 0 THEN CASE kind WHEN 1 THEN co[1] + co[3] ELSE co[1] END ELSE bb[1] END, 4) AS first, label FROM b")
def coco_import(spark, d):
    """One document per file is written and read again; annotations with an odd number lose their outline."""
    a = annotations(spark, d)
    outline = F.when(F.col("ann_no") % 2 == 0, F.array(G.segmentation(F.col("shape"), F.col("coordinates")))).otherwise(F.array(F.array().cast("array<double>")))
    b = a.withColumn("b", G.bounding_box(F.col("shape"), F.col("coordinates")))
    at = lambda i: F.get("b", F.lit(i))
    row = F.struct(
        F.col("ann_no").alias("id"), F.lit(1).alias("image_id"), F.col("ann_no").alias("category_id"),
        F.array(at(0), at(1), at(2) - at(0), at(3) - at(1)).alias("bbox"), outline.alias("segmentation"),
    )
    docs = b.groupBy("file_name").agg(F.collect_list(row).alias("annotations"), F.collect_list(F.struct(F.col("ann_no").alias("id"), F.col("label").alias("name"))).alias("categories"))
    text = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("id"), "file_name", F.lit(60).alias("width"), F.lit(80).alias("height"))).alias("images"), "categories", "annotations"))
    got = C.coco_import(docs.select(text.alias("json")))
    return got.select("file_name", "shape", F.size("coordinates").alias("n"), F.round(F.get("coordinates", F.lit(0)), 4).alias("first"), "label")


@query("image_json_roundtrip", f"WITH {A} SELECT file_name AS file_path, 60 AS width, 80 AS height, CASE WHEN ann_no % 2 = 0 THEN 'DicomImage' ELSE 'InMemoryImage' END AS image_type, CASE kind WHEN 0 THEN 'RECTANGLE' WHEN 1 THEN 'ELLIPSE' ELSE 'POLYGON' END AS shape, CAST(len(co) AS INTEGER) AS n, label FROM b")
def image_json_roundtrip(spark, d):
    a = annotations(spark, d).select(
        F.col("file_name").alias("file_path"), F.lit(60).alias("w"), F.lit(80).alias("h"), F.when(F.col("ann_no") % 2 == 0, "DicomImage").otherwise("SomethingElse").alias("image_type"),
        F.array(C.annotation_struct(F.col("shape"), F.col("coordinates"), F.col("label"))).alias("annotations"),
    )
    s = a.select(C.image_from_json(C.image_json(a)).alias("s")).select("s.*", F.get("s.annotations", F.lit(0)).alias("a"))
    return s.select("file_path", "width", "height", "image_type", F.col("a.shape").alias("shape"), F.size("a.coordinates").alias("n"), F.col("a.label").alias("label"))


@query("polygon_raster", f"""WITH {A}, p AS (SELECT ann_no, co, least(co[2], co[4], co[6], co[8]) AS y0, greatest(co[2], co[4], co[6], co[8]) AS y1, least(co[1], co[3], co[5], co[7]) AS x0, greatest(co[1], co[3], co[5], co[7]) AS x1 FROM b WHERE kind = 2),
 rows_ AS (SELECT ann_no, co, x0, x1, unnest(range(greatest(CAST(floor(y0) AS INTEGER), 0), least(CAST(ceil(y1) AS INTEGER), 159) + 1)) AS r FROM p),
 g AS (SELECT ann_no, co, r, unnest(range(greatest(CAST(floor(x0) AS INTEGER), 0), least(CAST(ceil(x1) AS INTEGER), 79) + 1)) AS c FROM rows_),
 e AS (SELECT ann_no, r, c, co[2 * k + 1] AS xa, co[2 * k + 2] AS ya, co[2 * ((k + 1) % 4) + 1] AS xb, co[2 * ((k + 1) % 4) + 2] AS yb FROM g, (SELECT unnest(range(4)) AS k))
 SELECT ann_no, count(*) AS n_pixels, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(c) AS BIGINT) AS sum_c FROM (
  SELECT ann_no, r, c FROM e WHERE (ya > r) <> (yb > r) AND c < (xb - xa) * (r - ya) / (yb - ya) + xa GROUP BY ann_no, r, c HAVING count(*) % 2 = 1) GROUP BY ann_no""")
def polygon_raster(spark, d):
    """Pixels inside all polygons of 160 x 80 images (even-odd rule), from the runs of their rows."""
    a = annotations(spark, d).where(F.col("shape") == G.POLYGON)
    point = lambda i: F.struct(F.get("coordinates", 2 * i).alias("x"), F.get("coordinates", 2 * i + 1).alias("y"))
    points = F.transform(F.sequence(F.lit(0), (F.size("coordinates") / 2 - 1).cast("int")), point)
    runs = R.outline_runs(a.select(F.col("ann_no").alias("key"), points.alias("points"), F.lit(160).alias("h"), F.lit(80).alias("w")))
    n = F.col("c1") - F.col("c0") + 1
    return runs.groupBy(F.col("key").alias("ann_no")).agg(F.sum(n).alias("n_pixels"), F.sum(F.col("r") * n).cast("bigint").alias("sum_r"), F.sum((F.col("c0") + F.col("c1")) * n / 2).cast("bigint").alias("sum_c"))


@query("annotation_edit", f"WITH {A} SELECT ann_no, CAST(1 AS INTEGER) AS n, CASE WHEN ann_no % 2 = 0 THEN label ELSE 'second' END AS label FROM b")
def annotation_edit(spark, d):
    """An annotation is added to a null list and a second one behind it; then the first or the last is removed."""
    one = C.annotation_struct(F.col("shape"), F.col("coordinates"), F.col("label"))
    a = annotations(spark, d).select("ann_no", one.alias("one"), F.lit("second").alias("label"), "shape", "coordinates").withColumn("two", C.annotation_struct(F.col("shape"), F.col("coordinates"), F.col("label")))
    both = a.withColumn("list", C.add_annotation(F.when(F.lit(False), F.array("one")), F.col("one"))).withColumn("list", C.add_annotation(F.col("list"), F.col("two")))
    left = F.when(F.col("ann_no") % 2 == 0, C.remove_annotation(F.col("list"), 1)).otherwise(C.remove_annotation(F.col("list"), 0))
    return both.withColumn("list", left).select("ann_no", F.size("list").alias("n"), F.get("list", F.lit(0))["label"].alias("label"))
