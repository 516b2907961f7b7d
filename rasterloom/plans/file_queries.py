"""Queries over files: each writes its input files from a table into the shared folder and reads them again."""

from __future__ import annotations

import json
import plistlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import coco as C
from rasterloom.operators import kernels as K
from rasterloom.plans import datasets as D
from rasterloom.plans.raster_queries import PX, _px, images, polygon_sql
from rasterloom.session import cut, shared_folder, table
from rasterloom.sources import catalog as S
from rasterloom.sources import files as X
from rasterloom.sources.plist import read_annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _path(*parts) -> Column:
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _id(width: int = 6) -> Column:
    return F.lpad(F.col("image_id").cast("string"), width, "0")


def _write(spark: SparkSession, name: str, *trees: DataFrame) -> str:
    """A new shared folder with the trees' files (path, content)."""
    folder = shared_folder(spark, name)
    for t in trees:
        X.write_tree(t, folder).count()
    return folder


def _as_images(read: DataFrame) -> DataFrame:
    """Image rows of a scan of files named by the image's id."""
    return read.select(F.regexp_extract("file_path", r"(\d+)[^/]*$", 1).cast("bigint").alias("image_id"), "h", "w", "pixels")


# -- formats ----------------------------------------------------------------------------


def _roundtrip(name: str, form: str, scale: int) -> None:
    def run(spark, d):
        i = images(spark, d).withColumn("pixels", F.transform("pixels", lambda v: F.floor(v / scale).cast("double")))
        folder = _write(spark, name, X.encoded(i.withColumn("path", _path("d/", _id(), f".{form}")), form))
        return _px(_as_images(X.require_loaded(cut(X.read_images(spark, folder)))), None)

    query(name, f"WITH {PX} SELECT image_id, r, c, floor(v / {scale}) AS v FROM px")(run)


_roundtrip("dicom_roundtrip", "dcm", 1)
_roundtrip("png_roundtrip", "png", 16)
_roundtrip("tif_roundtrip", "tif", 16)


@query("dicom_header_scan", "SELECT vec_id AS image_id, 8 AS h, 8 AS w, 16 AS bits_stored FROM embeddings WHERE len(embedding) = 64")
def dicom_header_scan(spark, d):
    """Sizes from headers alone, by the data source of that name."""
    folder = _write(spark, "headers", X.encoded(images(spark, d).withColumn("path", _path(_id(), ".dcm")), "dcm"))
    X.register(spark)
    return spark.read.format("dicom_header").load(X.local_path(folder)).select(F.regexp_extract("file_path", r"(\d+)\.dcm$", 1).cast("bigint").alias("image_id"), "h", "w", "bits_stored")


@query("dicom_source", f"WITH {PX} SELECT image_id, sum(v) AS pixel_sum FROM px GROUP BY image_id")
def dicom_source(spark, d):
    """Pixels by the data source ``dicom``."""
    folder = _write(spark, "source", X.encoded(images(spark, d).withColumn("path", _path(_id(), ".dcm")), "dcm"))
    X.register(spark)
    got = spark.read.format("dicom").load(X.local_path(folder)).select(F.regexp_extract("file_path", r"(\d+)\.dcm$", 1).cast("bigint").alias("image_id"), "pixels")
    return got.select("image_id", F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).alias("pixel_sum"))


@query("export_images", "SELECT e.vec_id || '_modified.' || f AS name, f <> 'dcm' AS is_export FROM embeddings e, (SELECT unnest(['png', 'tif', 'jpg', 'dcm']) AS f) WHERE len(embedding) = 64")
def export_images(spark, d):
    """Every image in every form that is written, by the names of the files."""
    i, folder = images(spark, d), shared_folder(spark, "export")
    out = None
    for form in ("png", "tif", "jpg", "dcm"):
        w = X.write_images(i, folder, form).select(S.base_name(F.col("path")).alias("name"), F.lit(form != "dcm").alias("is_export"))
        out = w if out is None else out.unionByName(w)
    return out


@query("file_errors", "SELECT vec_id AS image_id, vec_id % 3 <> 0 AS loaded FROM embeddings WHERE len(embedding) = 64")
def file_errors(spark, d):
    """Every third file is cut off; it gives a row with the reason instead of pixels."""
    whole = X.encoded(images(spark, d).withColumn("path", _path(_id(), ".dcm")), "dcm")
    broken = whole.withColumn("content", F.when(F.regexp_extract("path", r"(\d+)", 1).cast("bigint") % 3 == 0, F.expr("substring(content, 1, 200)")).otherwise(F.col("content")))
    got = X.read_images(spark, _write(spark, "broken", broken))
    return got.select(F.regexp_extract("file_path", r"(\d+)\.dcm$", 1).cast("bigint").alias("image_id"), (F.col("pixels").isNotNull() & F.col("error").isNull()).alias("loaded"))


@query("merge_mask_files", f"WITH {PX} SELECT image_id // 4 AS image_id, r, c, max(CASE WHEN v > 2500 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS v FROM px GROUP BY 1, r, c")
def merge_mask_files(spark, d):
    """TIFF masks of four neighbouring images, OR-ed."""
    m = images(spark, d).withColumn("pixels", F.transform("pixels", lambda v: F.when(v > 2500, 255.0).otherwise(0.0)))
    folder = _write(spark, "masks", X.encoded(m.withColumn("path", _path(_id(), "_mask.tif")), "tif"))
    masks = X.read_masks(spark, folder).withColumn("g", F.floor(F.regexp_extract("file_path", r"(\d+)_mask", 1).cast("bigint") / 4).cast("bigint"))
    return _px(X.merge_masks(masks, "g").withColumnRenamed("g", "image_id"), None)


@query("download_subset", "SELECT greatest(1, CAST(floor(count(*) * 0.3) AS BIGINT)) AS n_files, true AS again FROM embeddings WHERE len(embedding) = 64")
def download_subset(spark, d):
    """A seeded share of a local tree is copied, twice the same."""
    folder = X.local_path(_write(spark, "remote", X.encoded(images(spark, d).withColumn("path", _path("a/", _id(), ".png")), "png")))
    one, two = (X.download(folder, X.local_path(shared_folder(spark, "local")), 0.3) for _ in range(2))
    names = [sorted(p.rsplit("/", 1)[-1] for p in got) for got in (one, two)]
    return spark.createDataFrame([(len(one), names[0] == names[1])], "n_files bigint, again boolean")


# -- annotation files -----------------------------------------------------------------------

# Whole-number triangles (x, y), by the image's id.
_TRIANGLE = [(1, 1), (6, 2), (2, 7)]


def _xml(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One property list a row: the triangle, and a point for ids divisible by 4."""
    for f in frames:
        rows = []
        for i in f["image_id"]:
            rois = [{"Name": "Mass" if i % 4 else "Calcification", "Type": 15, "NumberOfPoints": 3, "Point_px": [f"({x}, {y})" for x, y in _TRIANGLE]}]
            if i % 4 == 0:
                rois.append({"Name": "", "Type": 19, "NumberOfPoints": 1, "Point_px": ["(5.5, 6)"]})
            rows.append((f"AllXML/{i:06d}.xml", plistlib.dumps({"Images": [{"ROIs": rois}]})))
        yield pd.DataFrame(rows, columns=["path", "content"])


def _xml_files(i: DataFrame) -> DataFrame:
    return i.select("image_id").mapInPandas(_xml, "path string, content binary")


@query("plist_rois", """WITH i AS (SELECT vec_id AS image_id FROM embeddings WHERE len(embedding) = 64)
 SELECT image_id, 0 AS roi_no, CASE WHEN image_id % 4 = 0 THEN 'Calcification' ELSE 'Mass' END AS name, 15 AS roi_type, 3 AS n_points, 9.0::DOUBLE AS sum_x FROM i UNION ALL SELECT image_id, 1, '', 19, 1, 5.5 FROM i WHERE image_id % 4 = 0""")
def plist_rois(spark, d):
    folder = _write(spark, "xml", _xml_files(images(spark, d)))
    a = read_annotations(spark, folder)
    return a.select(
        F.regexp_extract("path", r"(\d+)\.xml$", 1).cast("bigint").alias("image_id"), "roi_no", "name", "roi_type", F.size("points").alias("n_points"),
        F.aggregate("points", F.lit(0.0), lambda s, p: s + p["x"]).alias("sum_x"),
    )


@query("case_csv", "SELECT lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS case_id, CASE WHEN c_nationkey % 2 = 0 THEN 'L' ELSE 'R' END AS laterality, CASE WHEN c_nationkey % 5 = 0 THEN -1 ELSE c_nationkey END AS birads FROM customer")
def case_csv(spark, d):
    """The ;-separated case table, written from ``customer``: first a stale line of every case, then the one that counts."""
    c = table(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("id"), "c_nationkey")
    line = lambda lat, b: F.concat_ws(";", F.concat(F.lit(" "), "id"), lat, F.lit("CC"), b)
    n = F.col("c_nationkey")
    lines = F.concat_ws("\n", line(F.lit("?"), F.lit("0")), line(F.when(n % 2 == 0, "L").otherwise("R"), F.when(n % 5 == 0, "4a").otherwise(n.cast("string"))))
    one = c.agg(F.concat_ws("\n", F.lit("File Name;Laterality;View;Bi-Rads"), F.array_join(F.collect_list(lines), "\n")).cast("binary").alias("content")).select(F.lit("cases.csv").alias("path"), "content")
    folder = _write(spark, "csv", one)
    return S.read_case_csv(spark, f"{folder}/cases.csv").select("case_id", "laterality", "birads")


# -- collections --------------------------------------------------------------------------------


def _inbreast(spark: SparkSession, d: str) -> str:
    """AllDICOMs, AllXML for even ids, AllMasks (two TIFFs) for ids divisible by 6."""
    i = images(spark, d)
    bright = lambda n, level: X.encoded(
        i.where("image_id % 6 = 0").withColumn("pixels", F.transform("pixels", lambda v: F.when(v > level, 255.0).otherwise(0.0))).withColumn("path", _path("AllMasks/", _id(), f"_{n}.tif")), "tif"
    )
    return _write(spark, "inbreast", X.encoded(i.withColumn("path", _path("AllDICOMs/", _id(), "_x.dcm")), "dcm"), _xml_files(i.where("image_id % 2 = 0")), bright(0, 3500), bright(1, 2500))


_INSIDE = polygon_sql([(y, x) for x, y in _TRIANGLE]).replace(" r)", " r + 0.0)")
_DISK = "(r - 6) * (r - 6) + (c - 5) * (c - 5) < 9"


@query("inbreast_samples", f"""WITH {PX} SELECT lpad(CAST(image_id AS VARCHAR), 6, '0') AS case_id, CASE WHEN image_id % 6 = 0 THEN 'tif' WHEN image_id % 2 = 0 THEN 'xml' ELSE 'none' END AS mask_source, sum(v) AS pixel_sum,
 CAST(sum(CASE WHEN image_id % 6 = 0 THEN CASE WHEN v > 2500 THEN 1 ELSE 0 END WHEN image_id % 2 = 0 THEN CASE WHEN {_INSIDE} OR (image_id % 4 = 0 AND {_DISK}) THEN 1 ELSE 0 END ELSE 0 END) AS DOUBLE) AS mask_sum FROM px GROUP BY image_id""")
def inbreast_samples(spark, d):
    """Images with the mask of their TIFFs, their outlines, or none."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return D.inbreast_samples(spark, _inbreast(spark, d)).select("case_id", "mask_source", total("pixels").alias("pixel_sum"), total("mask").alias("mask_sum"))


@query("inbreast_coco_export", """WITH i AS (SELECT vec_id AS image_id FROM embeddings WHERE len(embedding) = 64), a AS (SELECT image_id, 'POLYGON' AS shape, CASE WHEN image_id % 4 = 0 THEN 'Calcification' ELSE 'Mass' END AS label FROM i WHERE image_id % 2 = 0 UNION ALL SELECT image_id, 'RECTANGLE', 'unknown' FROM i WHERE image_id % 4 = 0)
 SELECT lpad(CAST(image_id AS VARCHAR), 6, '0') || '_x.dcm' AS file_name, 8 AS width, 8 AS height, 'POLYGON' AS shape, CASE shape WHEN 'POLYGON' THEN 6 ELSE 8 END AS n, label FROM a""")
def inbreast_coco_export(spark, d):
    """The outlines of a collection as one COCO document, read again."""
    sizes, annotations = D.inbreast_annotations(spark, _inbreast(spark, d))
    annotations = cut(annotations)
    i, c = cut(C.coco_images(sizes)), cut(C.coco_categories(annotations))
    got = C.coco_import(C.coco_document(i, c, C.coco_annotations(annotations, i, c)))
    return got.select("file_name", "width", "height", "shape", F.size("coordinates").alias("n"), "label")


@query("inbreast_coco_samples", f"""WITH {PX} SELECT lpad(CAST(image_id AS VARCHAR), 6, '0') AS case_id, CAST(CASE WHEN image_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n_annotations, sum(v) AS pixel_sum, CAST(sum(CASE WHEN image_id % 2 = 0 AND {_INSIDE} THEN 1 ELSE 0 END) AS DOUBLE) AS mask_sum FROM px WHERE image_id % 5 <> 0 GROUP BY image_id""")
def inbreast_coco_samples(spark, d):
    """The COCO layout: a document of all images and a folder that lacks every fifth of them."""
    i = images(spark, d).select("image_id", "h", "w", "pixels", _path(_id(), ".dcm").alias("name"))
    flat = [float(v) for p in _TRIANGLE for v in p]
    listed = lambda cond, s: F.array_join(F.array_sort(F.collect_list(F.when(cond, s))), ",")
    image = F.to_json(F.struct(F.col("image_id").alias("id"), F.col("name").alias("file_name"), F.col("w").alias("width"), F.col("h").alias("height")))
    ann = F.concat(F.lit('{"id":'), F.col("image_id").cast("string"), F.lit(',"image_id":'), F.col("image_id").cast("string"), F.lit(',"category_id":1,"segmentation":' + json.dumps([flat]) + "}"))
    doc = i.agg(listed(F.lit(True), image).alias("i"), listed(F.col("image_id") % 2 == 0, ann).alias("a")).select(F.lit("annotations.json").alias("path"), F.concat(F.lit('{"categories":[{"id":1,"name":"Mass"}],"images":['), "i", F.lit('],"annotations":['), "a", F.lit("]}")).cast("binary").alias("content"))
    folder = _write(spark, "coco", doc, X.encoded(i.where("image_id % 5 <> 0").withColumn("path", _path("images/", F.col("name"))), "dcm"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return D.inbreast_coco_samples(spark, folder).select("case_id", "n_annotations", total("pixels").alias("pixel_sum"), total("mask").alias("mask_sum"))


def _cbis(spark: SparkSession, d: str) -> str:
    """A case of every image: the mammogram, for even ids a first ROI (its crop, rows 2-6 and columns 1-5, and a mask), for ids divisible by 3 a second one (a mask alone)."""
    i = images(spark, d)
    case = lambda tail: F.concat(F.when(F.col("image_id") % 2 == 0, "Calc-Test_P_").otherwise("Mass-Training_P_"), _id(), F.lit("_LEFT_CC"), F.lit(tail))
    above = lambda level: F.transform("pixels", lambda v: F.when(v > level, 255.0).otherwise(0.0))
    part = F.flatten(F.transform(F.sequence(F.lit(2), F.lit(6)), lambda r: F.slice("pixels", r * 8 + 2, 5)))
    even, third = i.where("image_id % 2 = 0"), i.where("image_id % 3 = 0")
    return _write(
        spark, "cbis",
        X.encoded(i.withColumn("path", _path("CBIS/", case("/s/full mammogram images/1-1.dcm"))), "dcm"),
        X.encoded(even.select("image_id", F.lit(5).alias("h"), F.lit(5).alias("w"), part.alias("pixels")).withColumn("path", _path("CBIS/", case("_1/s/cropped images/1-1.dcm"))), "dcm"),
        X.encoded(even.withColumn("pixels", above(3000)).withColumn("path", _path("CBIS/", case("_1/s/ROI mask images/1-2.dcm"))), "dcm"),
        X.encoded(third.withColumn("pixels", above(2500)).withColumn("path", _path("CBIS/", case("_2/s/ROI mask images/1-1.dcm"))), "dcm"),
    )


_CASE = "CASE WHEN image_id % 2 = 0 THEN 'Calc-Test' ELSE 'Mass-Training' END"
_CASE_ID = f"{_CASE} || '_P_' || lpad(CAST(image_id AS VARCHAR), 6, '0') || '_LEFT_CC'"
_IN_MASK = "CASE WHEN (image_id % 2 = 0 AND v > 3000) OR (image_id % 3 = 0 AND v > 2500) THEN 1.0 ELSE 0.0 END"


@query("cbis_samples_full", f"WITH {PX} SELECT {_CASE_ID} AS case_id, {_CASE} AS task, sum(v) AS pixel_sum, CAST(sum({_IN_MASK}) AS DOUBLE) AS mask_sum FROM px GROUP BY image_id")
def cbis_samples_full(spark, d):
    """Whole mammograms with the OR of their ROIs' masks."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return D.cbis_full_images(spark, _cbis(spark, d)).select("case_id", "task", total("pixels").alias("pixel_sum"), total("mask").alias("mask_sum"))


@query("cbis_patches", f"""WITH {PX}, o AS (SELECT unnest(range(0, 8, 3)) AS x), p AS (SELECT image_id, y.x AS y0, x.x AS x0, sum(v) AS pixel_sum, CAST(sum({_IN_MASK}) AS DOUBLE) AS mask_sum FROM px, o y, o x WHERE r >= y.x AND r < y.x + 5 AND c >= x.x AND c < x.x + 5 GROUP BY ALL)
 SELECT CAST(y0 // 3 * 3 + x0 // 3 AS INTEGER) AS patch_idx, count(*) AS n, round(sum(pixel_sum), 0) AS pixel_sum, sum(mask_sum) AS mask_sum FROM p GROUP BY 1""")
def cbis_patches(spark, d):
    """5 x 5 patches at every third row and column of images and masks, by their number."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    p = D.patches(D.cbis_full_images(spark, _cbis(spark, d)), 5, 3)
    return p.groupBy("patch_idx").agg(F.count("*").alias("n"), F.round(F.sum(total("pixels")), 0).alias("pixel_sum"), F.sum(total("mask")).alias("mask_sum"))


@query("cbis_detailed", f"""WITH {PX}, roi AS (SELECT image_id, 0 AS roi_no, sum(CASE WHEN r BETWEEN 2 AND 6 AND c BETWEEN 1 AND 5 THEN v ELSE 0 END) AS crop_sum, CAST(sum(CASE WHEN v > 3000 THEN 1 ELSE 0 END) AS DOUBLE) AS mask_sum, true AS located FROM px WHERE image_id % 2 = 0 GROUP BY image_id
 UNION ALL SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 1 ELSE 0 END, NULL, CAST(sum(CASE WHEN v > 2500 THEN 1 ELSE 0 END) AS DOUBLE), false FROM px WHERE image_id % 3 = 0 GROUP BY image_id)
 SELECT {_CASE_ID} AS case_id, CAST(roi_no AS INTEGER) AS roi_no, crop_sum, mask_sum, located FROM roi""")
def cbis_detailed(spark, d):
    """Crop, mask and box of every ROI of the detailed samples."""
    r = D.cbis_detailed(spark, _cbis(spark, d)).select("case_id", F.explode("rois").alias("r"))
    total = lambda c: F.when(F.col(c).isNotNull(), F.aggregate(c, F.lit(0.0), lambda a, x: a + x))
    fits = (F.get("r.box", F.lit(2)) - F.get("r.box", F.lit(0)) == 5) & (F.get("r.box", F.lit(3)) - F.get("r.box", F.lit(1)) == 5)
    return r.select("case_id", "r.roi_no", total("r.crop").alias("crop_sum"), total("r.mask").alias("mask_sum"), F.coalesce(fits, F.lit(False)).alias("located"))


@query("cbis_resized", f"WITH {PX} SELECT {_CASE_ID} AS case_id, 4 AS h, 4 AS w, CAST(16 - sum(CASE WHEN r % 2 = 0 AND c % 2 = 0 THEN {_IN_MASK} ELSE 0 END) AS DOUBLE) AS mask_sum FROM px GROUP BY image_id")
def cbis_resized(spark, d):
    """Samples at a target size with transforms of image and mask: the mask is inverted."""
    s = D.resized(D.cbis_full_images(spark, _cbis(spark, d)), 4, 4, lambda x: K.intensity_window(x, x.min(axis=(1, 2)), x.max(axis=(1, 2))), lambda m: 1 - m)
    return s.select("case_id", "h", "w", F.aggregate("mask", F.lit(0.0), lambda a, x: a + x).alias("mask_sum"))
