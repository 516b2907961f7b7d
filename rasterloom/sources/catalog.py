"""Catalogue queries: pairing images with annotations and masks by their names.

All of them work on listings (a ``path`` column), never on pixels; the pixels
are joined last. Right sides are one row per key, so hot keys on the left only
make longer streams, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the folder names of the public CBIS-DDSM collection.
CASE_PATTERN = r"^((?:Calc|Mass)-(?:Test|Training)_P_\d+_(?:LEFT|RIGHT)_(?:CC|MLO))(?:_(\d+))?$"


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Paths and sizes of the files under ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def numeric_id(name: Column) -> Column:
    """Leading digits, or null."""
    return F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit(""))


def has_suffix(path: Column, suffix: str) -> Column:
    return F.lower(path).endswith(suffix)


def ids_of(files: DataFrame) -> DataFrame:
    """case_id (leading digits of the name) and path of the files that have one."""
    return files.where("path is not null").select(numeric_id(base_name(F.col("path"))).alias("case_id"), "path").where("case_id is not null")


def pair_by_id(files: DataFrame) -> DataFrame:
    """case_id, dicom_path, xml_path, roi_path, mask_path: every .dcm with an id, left-joined to the others by id.

    Images without leading digits are dropped; of repeated annotations of one
    id the last counts. Null paths are ignored; suffixes are case-insensitive.
    All kinds of annotation are gathered in one aggregate, so there is one join.
    """
    p = files.where("path is not null").select(numeric_id(base_name(F.col("path"))).alias("case_id"), "path", F.lower(F.right("path", F.lit(4))).alias("kind")).where("case_id is not null")
    last = lambda suffix, name: F.max(F.when(F.col("kind") == suffix, F.col("path"))).alias(name)
    right = p.where(F.col("kind").isin(".xml", ".roi", ".tif")).groupBy("case_id").agg(last(".xml", "xml_path"), last(".roi", "roi_path"), last(".tif", "mask_path"))
    return p.where("kind = '.dcm'").select("case_id", F.col("path").alias("dicom_path")).join(right, "case_id", "left")


def mask_source(pairs: DataFrame) -> DataFrame:
    """The mask each case uses: TIF before XML before none."""
    return pairs.withColumn("mask_source", F.when(F.col("mask_path").isNotNull(), "tif").when(F.col("xml_path").isNotNull(), "xml").otherwise("none"))


def case_parts(case_id: Column) -> dict[str, Column]:
    """task, patient_id, side and view of a well-formed case id."""
    p = F.split(case_id, "_")
    at = lambda i: F.get(p, F.lit(i))
    return {"task": at(0), "patient_id": F.concat(F.lit("P_"), at(2)), "side": at(3), "view": at(4)}


def pair_case_folders(files: DataFrame) -> DataFrame:
    """case_id, task, patient_id, side, view, dicom_path, roi_entries of (folder, series, path) rows.

    A folder without a number is a mammogram, of which the first .dcm counts; numbered
    folders are its ROIs: of a "cropped images" series the first file is the crop,
    of a "roi mask images" series the first is the mask, or, without a cropped
    series, the first of two is the crop and the second the mask. ROIs are
    sorted by folder; mammograms without a file and ROIs without a mammogram
    are dropped.
    """
    f = files.where("folder is not null and path is not null").where(has_suffix(F.col("path"), ".dcm"))
    f = f.select(
        "folder", F.lower(F.coalesce("series", F.lit(""))).alias("series"), "path",
        F.regexp_extract("folder", CASE_PATTERN, 1).alias("case_id"), F.substring("folder", -1, 1).between("0", "9").alias("is_roi"),  # a case ends in letters
    ).where("case_id <> ''")
    # one aggregate a case: the mammogram's first file, and every ROI file with its folder
    kind = F.when(F.col("series").contains("cropped images"), "c").when(F.col("series").contains("roi mask images"), "m")
    case = f.groupBy("case_id").agg(
        F.min(F.when(~F.col("is_roi"), F.col("path"))).alias("dicom_path"),
        F.array_sort(F.collect_list(F.when(F.col("is_roi"), F.struct("folder", kind.alias("kind"), "path")))).alias("f"),
    ).where("dicom_path is not null")
    of = lambda folder, k: F.transform(F.filter("f", lambda x: (x["folder"] == folder) & (x["kind"] == k)), lambda x: x["path"])
    first, second = lambda a: F.get(a, F.lit(0)), lambda a: F.get(a, F.lit(1))

    def entry(folder: Column) -> Column:
        crops, masks = of(folder, "c"), of(folder, "m")
        two = (F.size(crops) == 0) & (F.size(masks) >= 2)
        return F.struct(F.when(two, first(masks)).otherwise(first(crops)).alias("roi_path"), F.when(two, second(masks)).otherwise(first(masks)).alias("mask_path"))

    folders = F.array_distinct(F.transform("f", lambda x: x["folder"]))
    return case.select("case_id", *[c.alias(n) for n, c in case_parts(F.col("case_id")).items()], "dicom_path", F.transform(folders, entry).alias("roi_entries"))


def read_case_csv(spark: SparkSession, path: str) -> DataFrame:
    """case_id, laterality, view, birads of the ;-separated case table; blank keys skipped, the last of repeated keys counts.

    ``birads`` is -1 where it isn't a whole number.
    """
    raw = spark.read.option("sep", ";").option("header", "true").csv(path)
    order = F.monotonically_increasing_id()  # follows the file's order
    t = raw.select(F.trim("File Name").alias("case_id"), F.trim("Laterality").alias("laterality"), F.trim("View").alias("view"), F.trim("Bi-Rads").try_cast("int").alias("birads"), order.alias("n"))
    last = t.where("case_id <> ''").groupBy("case_id").agg(F.max_by(F.struct("laterality", "view", "birads"), "n").alias("r"))
    return last.select("case_id", F.coalesce("r.laterality", F.lit("")).alias("laterality"), F.coalesce("r.view", F.lit("")).alias("view"), F.coalesce("r.birads", F.lit(-1)).alias("birads"))


def with_case_metadata(samples: DataFrame, cases: DataFrame) -> DataFrame:
    """Left join with defaults "", "" and -1."""
    return samples.join(cases, "case_id", "left").fillna("", ["laterality", "view"]).fillna(-1, ["birads"])


def sample_cases(cases: DataFrame, share: float, seed: int, key: str = "case_id") -> DataFrame:
    """max(1, int(n * share)) of the distinct cases, the same for one seed, sorted.

    The cases are ordered by a seeded hash; only a top-n, no global order, is needed.
    """
    d = cases.where(F.col(key).isNotNull()).select(key).distinct()
    n = max(1, int(d.count() * share))
    return d.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n).orderBy(key)
