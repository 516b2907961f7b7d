"""Samples of the public mammography layouts: listing, pairing, then pixels.

Every function pairs paths first (narrow tables) and joins the paths to the
undecoded files; only files that a sample needs are decoded, each once, after
the one shuffle that brings a case's files together. There they are folded file
by file: masks are OR-ed onto each other, and the image that comes last gets the
merged mask at its own size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G
from rasterloom.operators import kernels as K
from rasterloom.operators.raster import _listed, map_images, map_pairs, together
from rasterloom.operators.regions import draw_points, fill_polygon, sliding_patches
from rasterloom.sources import catalog as S
from rasterloom.sources.files import IMAGE_FILES, decoded, raw_files
from rasterloom.sources.plist import parse_annotations

_OUTLINES = "array<array<struct<x: double, y: double>>>"
#: In the order in which a case's files are folded.
MASK, CROP, IMAGE = 0, 1, 2
_FOLDED = "case_id string, h int, w int, c int, pixels array<double>, mask array<double>"


def cbis_cases(spark: SparkSession, root: str, share: float | None = None, seed: int = 42) -> DataFrame:
    """Paired cases of a CBIS-DDSM tree (``<case folder>/.../<series>/*.dcm``), perhaps a stable share of them."""
    p = S.listing(spark, root, "*.{dcm,DCM}").select("path", F.split("path", "/").alias("s"))
    folder = F.element_at(F.filter("s", lambda x: x.rlike(S.CASE_PATTERN)), -1)
    cases = S.pair_case_folders(p.select(folder.alias("folder"), F.element_at("s", -2).alias("series"), "path").where("folder is not null"))
    return cases if share is None else cases.join(S.sample_cases(cases, share, seed), "case_id", "left_semi")


def _merge(mask: np.ndarray, other: np.ndarray) -> np.ndarray:
    """OR at the top left; the result is as large as the larger one on either side."""
    h, w = (max(a, b) for a, b in zip(mask.shape, other.shape))
    out = np.zeros((h, w), bool)
    out[: mask.shape[0], : mask.shape[1]] = mask
    out[: other.shape[0], : other.shape[1]] |= other
    return out


def _foreground(x: np.ndarray) -> np.ndarray:
    """Where any channel is above 0."""
    return (x > 0).any(axis=2) if x.ndim == 3 else x > 0


def _drawn(outlines: list, h: int, w: int, whole: bool) -> np.ndarray:
    out = np.zeros((h, w), bool)
    for points in outlines or []:
        if points:
            xy = [(p["x"], p["y"]) for p in points]
            out |= draw_points(xy, h, w) if whole else fill_polygon(xy, h, w)
    return out


def _fold_masks(wanted: DataFrame, whole: bool = True) -> DataFrame:
    """case_id, h, w, c, pixels, mask of files (case_id, role, outlines, path, content): one row per image.

    Masks that lie with the case are OR-ed; without any the outlines are drawn;
    a mask of another size is brought to the image's by nearest pixels. Files
    that can't be decoded count as missing. Channels stay interleaved.
    """
    rows = together(wanted.select("case_id", "role", "outlines", "path", "content"), "case_id", "role", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, mask = None, None
        for b in batches:
            ids, roles, outlines, paths = (b.column(i).to_pylist() for i in range(4))
            for i in range(b.num_rows):
                if ids[i] != case:
                    case, mask = ids[i], None
                x = decoded(paths[i], b.column(4)[i].as_py())
                if x is None:
                    continue
                if roles[i] == MASK:
                    mask = _foreground(x) if mask is None else _merge(mask, _foreground(x))
                    continue
                h, w = x.shape[:2]
                m = _drawn(outlines[i], h, w, whole) if mask is None else mask if mask.shape == (h, w) else K.resize_nearest(mask[None], h, w)[0]
                size = [pa.array([v], pa.int32()) for v in (h, w, x.shape[2] if x.ndim == 3 else 1)]
                yield pa.RecordBatch.from_arrays([pa.array([case]), *size, _listed(x.reshape(1, -1)), _listed(m[None])], names=["case_id", "h", "w", "c", "pixels", "mask"])

    return rows.mapInArrow(run, _FOLDED)


def _with_files(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """The wanted rows (path and others) with their files' bytes; paths without a file are dropped."""
    return raw_files(spark, root, IMAGE_FILES).join(wanted, "path")


def cbis_full_images(spark: SparkSession, root: str, cases: DataFrame | None = None) -> DataFrame:
    """case_id, task, patient_id, side, view, h, w, c, pixels, mask; the masks of a case's ROIs are OR-ed, a case without any has zeros."""
    cases = cbis_cases(spark, root) if cases is None else cases
    none = F.lit(None).cast(_OUTLINES).alias("outlines")
    images = cases.select("case_id", F.lit(IMAGE).alias("role"), none, F.col("dicom_path").alias("path"))
    masks = cases.select("case_id", F.lit(MASK).alias("role"), none, F.explode("roi_entries.mask_path").alias("path")).where("path is not null")
    folded = _fold_masks(_with_files(spark, root, images.unionByName(masks)))
    return cases.select("case_id", "task", "patient_id", "side", "view").join(folded, "case_id")


_ROI = "struct<roi_no: int, crop_h: int, crop_w: int, crop: array<double>, mask_h: int, mask_w: int, mask: array<double>, box: array<int>>"


def cbis_detailed(spark: SparkSession, root: str, cases: DataFrame | None = None, crops: bool = True, masks: bool = True) -> DataFrame:
    """case_id, task, patient_id, side, view, h, w, pixels and rois of every case with an image.

    Each ROI has its crop, its 0/1 mask and its box [x0, y0, x1, y1] in the
    mammogram, where the crop's edges correlate best; what an ROI lacks is null.
    ``crops`` or ``masks`` False leaves those files or their pixels out.
    """
    cases = cbis_cases(spark, root) if cases is None else cases
    entries = cases.select("case_id", F.posexplode("roi_entries").alias("roi_no", "e"))
    wanted = cases.select("case_id", F.lit(-1).alias("roi_no"), F.lit(IMAGE).alias("role"), F.col("dicom_path").alias("path"))
    wanted = wanted.unionByName(entries.select("case_id", "roi_no", F.lit(CROP).alias("role"), F.col("e.roi_path").alias("path")))
    if masks:
        wanted = wanted.unionByName(entries.select("case_id", "roi_no", F.lit(MASK).alias("role"), F.col("e.mask_path").alias("path")))
    rows = together(_with_files(spark, root, wanted.where("path is not null")).select("case_id", "roi_no", "role", "path", "content"), "case_id", "roi_no", "role")
    gray = lambda x: x if x.ndim == 2 else x.mean(axis=2)
    types = pa.struct([("roi_no", pa.int32()), ("crop_h", pa.int32()), ("crop_w", pa.int32()), ("crop", pa.list_(pa.float64())), ("mask_h", pa.int32()), ("mask_w", pa.int32()), ("mask", pa.list_(pa.float64())), ("box", pa.list_(pa.int32()))])

    def record(case: str, image: np.ndarray, rois: dict[int, dict]) -> pa.RecordBatch:
        found = pa.array([[rois[k] for k in sorted(rois)]], pa.list_(types))
        return pa.RecordBatch.from_arrays([pa.array([case]), *[pa.array([v], pa.int32()) for v in image.shape], _listed(image[None]), found], names=["case_id", "h", "w", "pixels", "rois"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, image, rois = None, None, {}
        for b in batches:
            ids, numbers, roles, paths = (b.column(i).to_pylist() for i in range(4))
            for i in range(b.num_rows):
                if ids[i] != case:
                    if image is not None:
                        yield record(case, image, rois)
                    case, image, rois = ids[i], None, {}
                x = decoded(paths[i], b.column(4)[i].as_py())
                if x is None:
                    continue
                if roles[i] == IMAGE:  # the image's number is -1, so it comes first
                    image = gray(x)
                    continue
                roi = rois.setdefault(numbers[i], dict.fromkeys(t.name for t in types) | {"roi_no": numbers[i]})
                if roles[i] == MASK:
                    m = _foreground(x)
                    roi |= {"mask_h": m.shape[0], "mask_w": m.shape[1], "mask": m.astype(float).ravel()}
                else:
                    x = gray(x)
                    roi |= {"crop_h": x.shape[0], "crop_w": x.shape[1]}
                    if crops:
                        roi["crop"] = x.ravel()
                    if image is not None and x.shape[0] <= image.shape[0] and x.shape[1] <= image.shape[1]:
                        roi["box"] = list(K.locate(image, x))
        if image is not None:
            yield record(case, image, rois)

    folded = rows.mapInArrow(run, f"case_id string, h int, w int, pixels array<double>, rois array<{_ROI}>")
    return cases.select("case_id", "task", "patient_id", "side", "view").join(folded, "case_id")


def located_rois(spark: SparkSession, root: str, cases: DataFrame | None = None) -> DataFrame:
    """case_id, roi_no and box [x0, y0, x1, y1] of every cropped ROI, found in its mammogram by correlation of edges."""
    d = cbis_detailed(spark, root, cases, crops=False, masks=False)
    return d.select("case_id", F.explode("rois").alias("r")).where("r.box is not null").select("case_id", "r.roi_no", "r.box")


def patches(samples: DataFrame, size: int = 512, stride: int = 256) -> DataFrame:
    """image_id (hash of case_id), patch_idx, row_off, col_off, is_padded, pixels, mask of every patch."""
    both = samples.select(F.xxhash64("case_id").alias("image_id"), "h", "w", "pixels", "mask")
    return sliding_patches(both, size, stride, other="mask").drop("h", "w")


def inbreast_samples(spark: SparkSession, root: str, csv: str | None = None) -> DataFrame:
    """case_id, mask_source, h, w, c, pixels, mask of an INbreast tree; with ``csv`` also laterality, view, birads.

    The mask is that of the TIF files (OR-ed), else the XML outlines, else empty.
    """
    pairs = S.mask_source(S.pair_by_id(S.listing(spark, root)))
    xml = pairs.where("mask_source = 'xml'").select("case_id", F.col("xml_path").alias("path"))
    outlines = parse_annotations(raw_files(spark, root, "*.[xX][mM][lL]").join(xml, "path")).where(F.size("points") > 0).groupBy("case_id").agg(F.collect_list("points").alias("outlines"))
    images = pairs.select("case_id", F.lit(IMAGE).alias("role"), F.col("dicom_path").alias("path")).join(outlines, "case_id", "left")
    tif = pairs.where("mask_source = 'tif'").select("case_id").distinct().join(S.ids_of(S.listing(spark, root, "*.{tif,TIF}")), "case_id")
    masks = tif.select("case_id", F.lit(MASK).alias("role"), "path", F.lit(None).cast(_OUTLINES).alias("outlines"))
    folded = _fold_masks(_with_files(spark, root, images.unionByName(masks)))
    out = pairs.select("case_id", "mask_source").distinct().join(folded, "case_id")
    return S.with_case_metadata(out, S.read_case_csv(spark, csv)) if csv else out


def inbreast_annotations(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The XML outlines of an INbreast tree as tables for the COCO functions: (file_name, h, w) and (ann_no, file_name, shape, coordinates, label).

    Outlines of three points and more are polygons; one and two points are
    rectangles around them. ``ann_no`` follows file, image and ROI; unnamed ROIs have a null label.
    """
    pairs = S.pair_by_id(S.listing(spark, root))
    heads = raw_files(spark, root, "*.{dcm,DCM}").join(pairs.select(F.col("dicom_path").alias("path")), "path")
    sizes = sizes_of(heads).select(S.base_name(F.col("path")).alias("file_name"), "h", "w")
    xml = pairs.where("xml_path is not null").select(F.col("xml_path").alias("path"), S.base_name(F.col("dicom_path")).alias("file_name"))
    rois = parse_annotations(raw_files(spark, root, "*.[xX][mM][lL]").join(xml, "path")).where(F.size("points") > 0)
    xs, ys = F.transform("points", lambda p: p["x"]), F.transform("points", lambda p: p["y"])
    polygon = F.size("points") >= 3
    coordinates = F.when(polygon, F.flatten(F.transform("points", lambda p: F.array(p["x"], p["y"])))).otherwise(F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    from rasterloom.functions.coco import numbered

    named = rois.select("file_name", "image_no", "roi_no", F.when(polygon, G.POLYGON).otherwise(G.RECTANGLE).alias("shape"), coordinates.alias("coordinates"), F.nullif(F.trim("name"), F.lit("")).alias("label"))
    return sizes, numbered(named, ["file_name", "image_no", "roi_no"], "ann_no").drop("image_no", "roi_no")


def sizes_of(raw: DataFrame) -> DataFrame:
    """path, h and w of DICOM files (path, content), from their headers."""
    from rasterloom.sources import codecs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [codecs.header_of(c.as_py()) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x.get(k) for x in heads], pa.int32()) for k in ("rows", "cols")]], names=["path", "h", "w"])

    return raw.select("path", "content").mapInArrow(run, "path string, h int, w int").where("h is not null and w is not null")


def inbreast_coco_samples(spark: SparkSession, root: str) -> DataFrame:
    """case_id, file_name, n_annotations, h, w, c, pixels, mask of the COCO layout (``annotations.json`` and ``images/``).

    Every listed image that exists gives a row; all outlines of its annotations
    are filled (even-odd rule), an image without any has an empty mask.
    """
    from rasterloom.functions.coco import coco_outlines

    listed = coco_outlines(raw_files(spark, root, "annotations.json").select(F.col("content").cast("string").alias("json")))
    files = S.listing(spark, f"{root.rstrip('/')}/images", "*").select("path", S.base_name(F.col("path")).alias("file_name"))
    cases = listed.join(files, "file_name").select(F.col("file_name").alias("case_id"), F.lit(IMAGE).alias("role"), "outlines", "path")
    folded = _fold_masks(_with_files(spark, root, cases), whole=False).withColumnRenamed("case_id", "file_name")
    return folded.join(listed.select("file_name", "n_annotations"), "file_name").select(F.regexp_replace("file_name", r"\.dcm$", "").alias("case_id"), "file_name", "n_annotations", "h", "w", "c", "pixels", "mask")


def resized(samples: DataFrame, h: int, w: int, transform: Callable[[np.ndarray], np.ndarray] | None = None, mask_transform: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """case_id-keyed samples at one size: images bilinear, masks nearest; the transforms are stack kernels applied to images and masks."""
    same = lambda v: v
    key = samples.withColumn("image_id", F.xxhash64("case_id"))
    image = map_images(key.select("image_id", "h", "w", "pixels"), lambda x: (transform or same)(K.resize_bilinear(x, h, w)))
    mask = map_images(key.select("image_id", "h", "w", F.col("mask").alias("pixels")), lambda x: (mask_transform or same)(K.resize_nearest(x, h, w))).select("image_id", F.col("pixels").alias("mask"))
    return key.drop("h", "w", "pixels", "mask").join(image, "image_id").join(mask, "image_id")


def dice(pairs: DataFrame) -> DataFrame:
    """Dice score of two 0/1 images: rows (image_id, h, w, pixels, other)."""
    score = lambda a, b: {"dice": 2 * (a * b).sum(axis=(1, 2)) / (a.sum(axis=(1, 2)) + b.sum(axis=(1, 2)) + 1e-8)}
    return map_pairs(pairs, score, "image_id bigint, dice double")
