"""Image files as DataFrames: scans, header scans, masks and writers.

Scans go through ``binaryFile`` (any file system that Spark reads, listed and
split by Spark) and decode in Arrow batches. ``register`` also offers the formats
``dicom`` and ``dicom_header`` for folders that every node mounts.
"""

from __future__ import annotations

import os
import pathlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from rasterloom.errors import EngineError, FileMissing, PixelsNotLoaded, UnsupportedFile
from rasterloom.operators.raster import fold, together
from rasterloom.sources import codecs

HEADER_DDL = "file_path string, h int, w int, bits_stored int, window_center double, window_width double"
SCAN_DDL = "file_path string, image_type string, h int, w int, c int, dtype string, bits_stored int, window_center double, window_width double, pixels array<double>, error string"
#: Bytes first read of a file whose header is wanted.
HEADER_BYTES = 1 << 16


#: Names of the files that are decoded.
IMAGE_FILES = "*.{dcm,DCM,png,PNG,tif,TIF,tiff}"


def raw_files(spark: SparkSession, root: str, pattern: str = IMAGE_FILES) -> DataFrame:
    """path and content (undecoded) of the files under ``root``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


def decoded(path: str, content: bytes) -> np.ndarray | None:
    """Pixels of one file, (rows, columns[, channels]); None if it can't be decoded."""
    row = _decode(path, content)
    return None if row["pixels"] is None else row["pixels"].reshape((row["h"], row["w"], row["c"]) if row["c"] > 1 else (row["h"], row["w"]))


def _decode(path: str, content: bytes) -> dict:
    kind = pathlib.PurePath(path).suffix.lower()
    row = {"file_path": path, "image_type": None, "h": None, "w": None, "c": None, "dtype": None, "bits_stored": None, "window_center": None, "window_width": None, "pixels": None, "error": None}
    try:
        head: dict = {}
        if kind == ".dcm":
            head, x = codecs.decode_dicom(content)
        elif kind == ".png":
            x = codecs.decode_png(content)
        elif kind in (".tif", ".tiff"):
            x = codecs.decode_tiff(content)
        else:
            raise UnsupportedFile(f"only .dcm, .png and .tif files are read, not {kind or 'files without suffix'}")
    except UnsupportedFile as e:
        return row | {"error": e.message}
    row |= {k: head.get(k) for k in ("bits_stored", "window_center", "window_width")}
    return row | {"image_type": {".dcm": "DicomImage", ".png": "PNGImage"}.get(kind, "TiffImage"), "h": x.shape[0], "w": x.shape[1], "c": x.shape[2] if x.ndim == 3 else 1, "dtype": x.dtype.name, "pixels": x.astype(float).ravel()}


def _arrow(rows: list[dict], ddl_schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=ddl_schema)


_SCAN = pa.schema([("file_path", pa.string()), ("image_type", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("c", pa.int32()), ("dtype", pa.string()), ("bits_stored", pa.int32()), ("window_center", pa.float64()), ("window_width", pa.float64()), ("pixels", pa.list_(pa.float64())), ("error", pa.string())])


def read_images(spark: SparkSession, root: str, pattern: str = IMAGE_FILES, strict: bool = False, only: DataFrame | None = None) -> DataFrame:
    """All image files under ``root``, or those whose ``path`` is in ``only``: SCAN_DDL.

    Files that can't be decoded give a row with null pixels and the reason in
    ``error``; with ``strict`` they fail the query. What ``only`` leaves out is
    not decoded.
    """
    files = raw_files(spark, root, pattern)
    if only is not None:
        files = files.join(only.select("path").distinct(), "path", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):  # one decoded image at a time
                row = _decode(path, content.as_py())
                if strict and row["error"]:
                    raise UnsupportedFile(f"{path}: {row['error']}")
                yield _arrow([row], _SCAN)

    return files.select("path", "content").mapInArrow(run, SCAN_DDL)


def read_masks(spark: SparkSession, root: str, pattern: str = "*.{tif,TIF,tiff,dcm,png}") -> DataFrame:
    """Masks as 0/1 images: file_path, h, w, pixels (1 where any channel is above 0)."""
    any_channel = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.array_max(F.slice("pixels", i * F.col("c") + 1, F.col("c"))))
    value = F.when(F.col("c") == 1, F.col("pixels")).otherwise(any_channel)
    return read_images(spark, root, pattern).where("pixels is not null").select("file_path", "h", "w", F.transform(value, lambda v: F.when(v > 0, 1.0).otherwise(0.0)).alias("pixels"))


#: Bytes of partly merged masks that a task holds before it passes them on.
MERGE_BYTES = 256 << 20


def merge_masks(masks: DataFrame, key: str) -> DataFrame:
    """One mask a key: the masks OR-ed, aligned at the top left, as large as the largest.

    Masks are merged where they lie, as far as MERGE_BYTES goes, and the rest
    after one shuffle, mask after mask, so a key with most of the masks is
    never gathered. Null keys, null pixels and pixels that don't fit their size
    give nothing.
    """
    kind = dict(masks.dtypes)[key]
    rows = masks.where(F.col(key).isNotNull() & (F.size("pixels") == F.col("h") * F.col("w"))).select(F.col(key).alias("key"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("pixels").cast("array<double>").alias("pixels"))
    ddl = f"key {kind}, h int, w int, pixels array<tinyint>"

    def onto(out: np.ndarray, row: dict, pixels: np.ndarray) -> np.ndarray:
        h, w = row["h"], row["w"]
        if h > out.shape[0] or w > out.shape[1]:
            out = np.pad(out, ((0, max(h - out.shape[0], 0)), (0, max(w - out.shape[1], 0))))
        out[:h, :w] |= pixels.reshape(h, w) > 0
        return out

    def batch(keys: pa.Array, x: np.ndarray, form: pa.DataType) -> pa.RecordBatch:
        listed = pa.ListArray.from_arrays(pa.array([0, x.size], pa.int32()), pa.array(x.ravel().astype(np.int8)).cast(form))
        return pa.RecordBatch.from_arrays([keys, *[pa.array([v], pa.int32()) for v in x.shape], listed], names=["key", "h", "w", "pixels"])

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for b in batches:
            keys, h, w = (b.column(i).to_pylist() for i in range(3))
            for i in range(b.num_rows):
                before = held.get(keys[i], np.zeros((0, 0), bool))
                held[keys[i]] = after = onto(before, {"h": h[i], "w": w[i]}, b.column(3)[i].values.to_numpy(zero_copy_only=False))
                size += after.nbytes - before.nbytes
                if size > MERGE_BYTES:
                    yield from (batch(pa.array([k], b.column(0).type), x, pa.int8()) for k, x in held.items())
                    held, size = {}, 0
            form = b.column(0).type
        if held:
            yield from (batch(pa.array([k], form), x, pa.int8()) for k, x in held.items())

    parts = together(rows.mapInArrow(here, ddl), "key")
    folded = fold(parts, "key", lambda row: np.zeros((0, 0), bool), onto)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: list[pa.DataType] = []

        def seen():
            for b in batches:
                forms.append(b.column(0).type)
                yield b

        for k, x in folded(seen()):
            yield batch(pa.array([k], forms[0]), x, pa.float64())

    return parts.mapInArrow(merge, f"key {kind}, h int, w int, pixels array<double>").withColumnRenamed("key", key)


def require_loaded(images: DataFrame) -> DataFrame:
    """The same rows; PixelsNotLoaded if any has no pixels."""
    if not images.where("pixels is null").isEmpty():
        raise PixelsNotLoaded("load the images before they are processed")
    return images


def write_images(images: DataFrame, folder: str, form: str = "png") -> DataFrame:
    """Write every image (file_path or image_id, h, w, pixels[, c]) to a shared folder as ``<name>_modified.<form>``.

    ``form``: png, tif, jpg (clipped to 8 bits) or dcm (16 bits). Returns the written
    paths when it is run; a task that runs again writes the same files.
    """
    if form not in ("png", "tif", "jpg", "dcm"):
        raise UnsupportedFile("form must be png, tif, jpg or dcm")
    name = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "") if "file_path" in images.columns else F.col("image_id").cast("string")
    named = images.withColumn("path", F.concat(name, F.lit(f"_modified.{form}")))
    root = local_path(folder)
    return write_tree(encoded(named, form), folder).select(F.concat(F.lit(root.rstrip("/") + "/"), "path").alias("path"))


def local_path(folder: str) -> str:
    """A folder that every node mounts, without the scheme ``file:``."""
    return re.sub("^file:(?=/)(?://)?", "", folder)


def write_tree(rows: DataFrame, folder: str) -> DataFrame:
    """Write every row's ``content`` (bytes) to ``path`` below a shared folder; returns the paths when it is run.

    A file appears when it is complete; a task that runs again writes the same files. Null paths and contents are left out.
    """
    root = local_path(folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                to = os.path.join(root, path)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                part = f"{to}.{os.getpid()}.part"
                pathlib.Path(part).write_bytes(content)
                os.replace(part, to)
            yield f[["path"]]

    return rows.where("path is not null and content is not null").select("path", "content").mapInPandas(run, "path string")


def encoded(images: DataFrame, form: str) -> DataFrame:
    """path and content of image rows (path, h, w, pixels[, c]) in the form png, tif, jpg or dcm."""
    encode = {"png": codecs.encode_png, "tif": codecs.encode_tiff, "jpg": codecs.encode_jpeg, "dcm": codecs.encode_dicom}[form]
    c = F.col("c") if "c" in images.columns else F.lit(1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            shaped = (np.asarray(r.pixels, float).reshape((r.h, r.w) if r.c == 1 else (r.h, r.w, r.c)) for r in f.itertuples())
            yield pd.DataFrame({"path": f["path"], "content": [encode(x) for x in shaped]})

    return images.where("pixels is not null").select("path", "h", "w", c.alias("c"), "pixels").mapInPandas(run, "path string, content binary")


def download(source: str, destination: str, share: float | None = None, seed: int = 42) -> list[str]:
    """Copy a local tree, or max(1, share) of its files; http(s) and ftp addresses give one file, an ftp address that ends in a slash all files of the folder. A driver-side helper."""
    import random
    import shutil
    import urllib.request

    target = pathlib.Path(destination)
    target.mkdir(parents=True, exist_ok=True)
    if source.startswith("ftp://") and source.endswith("/"):
        return _ftp_folder(source, target)
    if source.split(":", 1)[0] in ("http", "https", "ftp"):
        to = target / (source.rstrip("/").rsplit("/", 1)[-1] or "download")
        urllib.request.urlretrieve(source, to)
        return [str(to)]
    root = pathlib.Path(source)
    if not root.exists():
        raise FileMissing(f"{source} does not exist")
    if share is not None and not 0 < share <= 1:
        raise EngineError("share must be above 0 and at most 1", 422)
    names = sorted(p.relative_to(root) for p in root.rglob("*") if p.is_file())
    if share is not None:
        names = sorted(random.Random(seed).sample(names, max(1, int(len(names) * share)))) if names else []
    for n in names:
        (target / n).parent.mkdir(parents=True, exist_ok=True)
        shutil.copy2(root / n, target / n)
    return [str(target / n) for n in names]


def _ftp_folder(source: str, target: pathlib.Path) -> list[str]:
    """The files directly in a folder ``ftp://host[:port]/path/``, each moved into place once it is complete."""
    import ftplib
    from urllib.parse import unquote, urlsplit

    address = urlsplit(source)
    got = []
    with ftplib.FTP() as ftp:
        ftp.connect(address.hostname, address.port or ftplib.FTP_PORT)
        ftp.login(address.username or "anonymous", address.password or "")
        ftp.cwd(unquote(address.path) or "/")
        for name in sorted(pathlib.PurePosixPath(n).name for n in ftp.nlst()):
            part = target / (name + ".part")
            try:
                with part.open("wb") as f:
                    ftp.retrbinary(f"RETR {name}", f.write)
            except ftplib.error_perm:  # a folder
                part.unlink(missing_ok=True)
                continue
            part.replace(target / name)
            got.append(str(target / name))
    return got


# -- data sources ---------------------------------------------------------------------------


#: Bytes of files that one task of the ``dicom`` source reads.
TASK_BYTES = 128 << 20
_HEADER = pa.schema([("file_path", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("bits_stored", pa.int32()), ("window_center", pa.float64()), ("window_width", pa.float64())])


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """Files are grouped to tasks by size (headers by number) and leave them as Arrow batches."""

    def __init__(self, options: dict, header: bool):
        self.root, self.header = options.get("path"), header
        if not self.root or not os.path.exists(self.root):
            raise FileMissing(f"{self.root} does not exist")

    def partitions(self):
        root = pathlib.Path(self.root)
        found = [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.suffix.lower() == ".dcm")
        groups, size = [[]], 0
        for p in found:
            n = HEADER_BYTES if self.header else p.stat().st_size
            if groups[-1] and size + n > TASK_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(str(p))
            size += n
        return [_Files(g) for g in groups if g]

    def read(self, partition):
        for path in partition.paths if partition else []:
            if self.header:
                head = _head(path)
                row = {"file_path": path, "h": head.get("rows"), "w": head.get("cols"), **{k: head.get(k) for k in ("bits_stored", "window_center", "window_width")}}
                yield _arrow([row], _HEADER)
            else:
                yield _arrow([_decode(path, pathlib.Path(path).read_bytes())], _SCAN)


def _head(path: str) -> dict:
    """Header values; HEADER_BYTES of the file are read, and on until rows and columns are found."""
    with open(path, "rb") as f:
        data, more = b"", HEADER_BYTES
        while True:
            piece = f.read(more)
            data += piece
            head = codecs.header_of(data)
            if len(piece) < more or (head.get("rows") is not None and head.get("cols") is not None):
                return head
            more = len(data)


class _Written(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Writer(DataSourceWriter):
    """Rows of (name, h, w, pixels) become <name>_modified.dcm."""

    def __init__(self, options: dict):
        self.folder = options["path"]

    def write(self, iterator):
        os.makedirs(self.folder, exist_ok=True)
        paths = []
        for row in iterator:
            path = os.path.join(self.folder, f"{row['name']}_modified.dcm")
            pathlib.Path(path).write_bytes(codecs.encode_dicom(np.asarray(row["pixels"], float).reshape(row["h"], row["w"])))
            paths.append(path)
        return _Written(paths)

    def commit(self, messages):
        return None

    def abort(self, messages):
        for m in messages:
            for p in m.paths if m else []:
                pathlib.Path(p).unlink(missing_ok=True)


class DicomSource(DataSource):
    @classmethod
    def name(cls):
        return "dicom"

    def schema(self):
        return SCAN_DDL

    def reader(self, schema):
        return _Reader(self.options, header=False)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


class DicomHeaderSource(DataSource):
    """Sizes and windows without reading pixels: HEADER_BYTES of each file, and on until rows and columns are found."""

    @classmethod
    def name(cls):
        return "dicom_header"

    def schema(self):
        return HEADER_DDL

    def reader(self, schema):
        return _Reader(self.options, header=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DicomSource)
    spark.dataSource.register(DicomHeaderSource)
