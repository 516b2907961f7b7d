"""Annotations to and from COCO documents and image JSON, as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import geometry as G

IMAGE_JSON = "file_path string, width int, height int, image_type string, annotations array<struct<shape: string, coordinates: array<double>, label: string, metadata: map<string, string>, center: struct<x: double, y: double>, bounding_box: array<double>>>"
UNKNOWN = "unknown"


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Sequential numbers from 1 in the given order, without one task seeing all rows.

    Rows are range-partitioned and sorted; the ranges' sizes (a row per task)
    give each range its offset.
    """
    part = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    from rasterloom.session import cut

    part = cut(part)
    sizes = part.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__start")
    local = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return part.withColumn("__i", local).join(before, "__part").withColumn(name, (F.col("__start") + F.col("__i")).cast("bigint")).drop("__part", "__i", "__start")


def coco_images(images: DataFrame) -> DataFrame:
    """id (from 1, by file name), file_name, width, height of (file_name, h, w); null names are left out."""
    named = images.where("file_name is not null").select("file_name", F.col("w").alias("width"), F.col("h").alias("height"))
    return numbered(named, ["file_name"], "id").select("id", "file_name", "width", "height")


def coco_categories(annotations: DataFrame) -> DataFrame:
    """id (from 1, in the order of first appearance) and name of the labels; a null label is "unknown"."""
    first = annotations.groupBy(F.coalesce("label", F.lit(UNKNOWN)).alias("name")).agg(F.min("ann_no").alias("first"))
    # one row a label; their numbers need one order over all labels
    return first.select(F.row_number().over(Window.orderBy("first", "name")).cast("bigint").alias("id"), "name")


def coco_annotations(annotations: DataFrame, images: DataFrame, categories: DataFrame) -> DataFrame:
    """COCO rows of (file_name, ann_no, shape, coordinates, label): bbox [x, y, w, h], area of the box, outline.

    Annotations of unknown files and invalid shapes are left out.
    """
    a = annotations.where(G.is_valid(F.col("shape"), F.col("coordinates"))).withColumn("name", F.coalesce("label", F.lit(UNKNOWN)))
    b = G.bounding_box(F.col("shape"), F.col("coordinates"))
    rows = (
        a.join(images.select(F.col("id").alias("image_id"), "file_name"), "file_name")
        .join(categories.select(F.col("id").alias("category_id"), "name"), "name")
        .select("ann_no", "image_id", "category_id", b.alias("b"), G.segmentation(F.col("shape"), F.col("coordinates")).alias("outline"))
    )
    at = lambda i: F.get("b", F.lit(i))
    return numbered(rows, ["image_id", "ann_no"], "id").select(
        "id", "image_id", "category_id",
        F.array(at(0), at(1), at(2) - at(0), at(3) - at(1)).alias("bbox"), ((at(2) - at(0)) * (at(3) - at(1))).alias("area"),
        F.lit(0).alias("iscrowd"), F.array("outline").alias("segmentation"), "ann_no",
    )


def coco_document(images: DataFrame, categories: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row ``json`` with the whole document.

    Every entry becomes a text where it lies; one aggregate puts the texts of
    the three lists together. The document is one value and so one task's work;
    corpora that are too large for that keep the three tables.
    """
    part = lambda df, name, cols: df.select(F.lit(name).alias("part"), "id", F.to_json(F.struct(*cols)).alias("text"))
    parts = (
        part(images, "images", ["id", "file_name", "width", "height"])
        .unionByName(part(categories, "categories", ["id", "name"]))
        .unionByName(part(annotations, "annotations", ["id", "image_id", "category_id", "segmentation", "bbox", "area", "iscrowd"]))
    )
    listed = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == name, F.struct("id", "text")))), lambda x: x["text"]), ",").alias(name)
    one = parts.agg(listed("images"), listed("categories"), listed("annotations"))
    info = F.to_json(F.struct(F.lit("annotations").alias("description"), F.lit("1.0").alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("date_created")))
    lit = F.lit
    return one.select(F.concat(lit('{"info":'), info, lit(',"licenses":[],"categories":['), "categories", lit('],"images":['), "images", lit('],"annotations":['), "annotations", lit("]}")).alias("json"))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Readable documents (objects) of the first column."""
    for b in batches:
        for text in b.column(0).to_pylist():
            try:
                d = json.loads(text) if text else None
            except ValueError:
                d = None
            if isinstance(d, dict):
                yield {k: [x for x in d.get(k) or [] if isinstance(x, dict)] for k in ("images", "categories", "annotations")}


#: Annotations of one batch of imported documents.
IMPORT_ROWS = 10_000
_IMPORT = pa.schema([("file_name", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("shape", pa.string()), ("coordinates", pa.list_(pa.float64())), ("label", pa.string()), ("coco_id", pa.int64())])
_OUTLINED = pa.schema([("file_name", pa.string()), ("n_annotations", pa.int32()), ("outlines", pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))])
IMPORT_DDL = "file_name string, width int, height int, shape string, coordinates array<double>, label string, coco_id bigint"


def coco_import(documents: DataFrame) -> DataFrame:
    """file_name, width, height, shape, coordinates, label, coco_id of COCO texts (column ``json``).

    The first outline becomes a POLYGON; without one the box becomes a
    RECTANGLE. Annotations of unlisted images are dropped, unlisted categories
    are "unknown", of repeated ids the last counts; unreadable texts give
    nothing. Ids are looked up in tables, so the work is linear in the document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for d in _documents(batches):
            images = {i.get("id"): i for i in d["images"]}
            names = {c.get("id"): c.get("name") for c in d["categories"]}
            for a in d["annotations"]:
                i = images.get(a.get("image_id"))
                if i is None:
                    continue
                outline = (a.get("segmentation") or [[]])[0]
                x, y, w, h = [*(a.get("bbox") or []), None, None, None, None][:4]
                box = [x, y, None if x is None or w is None else x + w, None if y is None or h is None else y + h]
                coordinates = [None if v is None else float(v) for v in (outline or box)]
                rows.append((i.get("file_name"), i.get("width"), i.get("height"), G.POLYGON if outline else G.RECTANGLE, coordinates, names.get(a.get("category_id")) or UNKNOWN, a.get("id")))
                if len(rows) == IMPORT_ROWS:
                    yield _batch(rows, _IMPORT)
                    rows = []
        if rows:
            yield _batch(rows, _IMPORT)

    return documents.select(F.col("json").cast("string")).mapInArrow(run, IMPORT_DDL)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def coco_outlines(documents: DataFrame) -> DataFrame:
    """file_name, n_annotations and outlines (all polygons of three points and more) of every listed image of COCO texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for d in _documents(batches):
            of: dict = {}
            for a in d["annotations"]:
                of.setdefault(a.get("image_id"), []).append(a.get("segmentation") or [])
            for i in d["images"]:
                drawn = [[{"x": float(s[k]), "y": float(s[k + 1])} for k in range(0, len(s) - 1, 2)] for seg in of.get(i.get("id"), []) for s in seg if isinstance(s, list) and len(s) >= 6]
                rows.append((i.get("file_name"), len(of.get(i.get("id"), [])), drawn))
                if len(rows) == IMPORT_ROWS:
                    yield _batch(rows, _OUTLINED)
                    rows = []
        if rows:
            yield _batch(rows, _OUTLINED)

    return documents.select(F.col("json").cast("string")).mapInArrow(run, "file_name string, n_annotations int, outlines array<array<struct<x: double, y: double>>>")


def image_json(annotated: DataFrame) -> Column:
    """JSON of an image row (file_path, w, h, image_type, annotations); no pixels."""
    return F.to_json(F.struct("file_path", F.col("w").alias("width"), F.col("h").alias("height"), "image_type", "annotations"))


def image_from_json(text: Column) -> Column:
    """struct of IMAGE_JSON; an unknown image type is InMemoryImage."""
    s = F.from_json(text, IMAGE_JSON)
    kind = F.when(s["image_type"].isin("DicomImage", "PNGImage", "InMemoryImage"), s["image_type"]).otherwise("InMemoryImage")
    return F.when(s.isNotNull(), s.withField("image_type", kind))


def annotation_struct(shape: Column, coords: Column, label: Column, metadata: Column | None = None) -> Column:
    """The annotation with its derived centre and box."""
    m = metadata if metadata is not None else F.create_map().cast("map<string,string>")
    return F.struct(shape.alias("shape"), coords.alias("coordinates"), label.alias("label"), m.alias("metadata"), G.center(shape, coords).alias("center"), G.bounding_box(shape, coords).alias("bounding_box"))


def add_annotation(annotations: Column, one: Column) -> Column:
    """A null list counts as empty."""
    return F.when(annotations.isNull(), F.array(one)).otherwise(F.array_append(annotations, one))


def remove_annotation(annotations: Column, index: int) -> Column:
    """The list without one place; an error if there is no such place (negative ones included)."""
    ok = (F.lit(index) >= 0) & (F.lit(index) < F.size(annotations))
    return F.when(ok, F.filter(annotations, lambda _, i: i != index)).otherwise(F.raise_error(F.lit(f"no annotation at {index}")))
