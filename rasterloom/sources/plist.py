"""INbreast annotation files (property lists) and their point texts."""

from __future__ import annotations

import plistlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the pattern of a point text.
POINT = r"\(\s*([\d.]+)\s*,\s*([\d.]+)"
DDL = "path string, image_no int, roi_no int, name string, roi_type int, num_points int, points array<string>"


def parse_point(text: Column) -> Column:
    """struct<x, y> of "(x, y)"; null for anything else."""
    x, y = (F.regexp_extract(text, POINT, i).try_cast("double") for i in (1, 2))
    return F.when(text.rlike(POINT) & x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def rois_of(content: bytes) -> list[dict]:
    """ROIs of one property list; unreadable files have none."""
    try:
        doc = plistlib.loads(content)
    except Exception:  # plistlib and expat raise many kinds
        return []
    out = []
    for i, image in enumerate((doc.get("Images") or []) if isinstance(doc, dict) else []):
        for j, roi in enumerate(image.get("ROIs") or []):
            points = [str(p) for p in roi.get("Point_px") or []]
            out.append({"image_no": i, "roi_no": j, "name": roi.get("Name") or "", "roi_type": int(roi.get("Type") or 0), "num_points": int(roi.get("NumberOfPoints") or 0), "points": points})
    return out


def parse_annotations(files: DataFrame) -> DataFrame:
    """ROIs of property lists (path, content and other columns): the other columns, path, image_no, roi_no, name, roi_type, num_points, points array<struct<x, y>>."""
    others = [c for c in files.columns if c not in ("path", "content")]
    extra = "".join(f"`{n}` {t}, " for n, t in files.select(others).dtypes)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [*others, "path", "image_no", "roi_no", "name", "roi_type", "num_points", "points"]
        for f in frames:
            rows = [{**{k: r[k] for k in others}, "path": r["path"], **roi} for r in f.to_dict("records") for roi in rois_of(bytes(r["content"]))]
            if rows:
                yield pd.DataFrame(rows)[names]

    return files.select(*others, "path", "content").mapInPandas(read, extra + DDL).withColumn("points", F.filter(F.transform("points", parse_point), lambda p: p.isNotNull()))


def read_annotations(spark: SparkSession, root: str) -> DataFrame:
    """path, image_no, roi_no, name, roi_type, num_points, points array<struct<x, y>> of all .xml files under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][mM][lL]").load(root)
    return parse_annotations(files.select("path", "content"))
