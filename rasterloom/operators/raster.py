"""Images as rows and as a pixel relation, and NumPy kernels over Arrow batches.

An image row is (image_id, h, w, pixels array<double>, row by row). Kernels run
in ``mapInArrow`` where the row lies: no shuffle, whatever the stencil's size.
Images too large for one row are cut into tiles with a halo (``tiled``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.session import shuffle_width

IMAGE_DDL = "image_id bigint, h int, w int, pixels array<double>"
_TILE_SCHEMA = pa.schema(
    [("image_id", pa.int64()), *[(k, pa.int32()) for k in ("row_idx", "col_idx", "row_off", "col_off", "image_h", "image_w", "h", "w")], ("pixels", pa.list_(pa.float64()))]
)
#: Pixels that one kernel call takes at once.
BATCH_PIXELS = 4_000_000


def images_from_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", h: int = 8, w: int = 8) -> DataFrame:
    """12-bit images from float vectors in [-1, 1]: v = floor((x + 1) * 2047.5).

    Null ids, null vectors and vectors of another length give no image.
    """
    level = lambda x: F.floor((x.cast("double") + 1.0) * 2047.5).cast("double")
    return vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) == h * w)).select(
        F.col(id_col).cast("bigint").alias("image_id"), F.lit(h).alias("h"), F.lit(w).alias("w"), F.transform(vector_col, level).alias("pixels")
    )


def to_px(images: DataFrame, value: str = "v", cast: str = "double") -> DataFrame:
    """The pixel relation: image_id, r, c, v."""
    at = images.select("image_id", "w", F.posexplode("pixels").alias("pos", "x"))
    return at.select("image_id", F.floor(F.col("pos") / F.col("w")).cast("int").alias("r"), F.pmod("pos", "w").cast("int").alias("c"), F.col("x").cast(cast).alias(value))


def from_px(px: DataFrame, value: str = "v") -> DataFrame:
    """Images from a complete pixel relation; one shuffle on image_id."""
    return px.groupBy("image_id").agg(
        (F.max("r") + 1).cast("int").alias("h"),
        (F.max("c") + 1).cast("int").alias("w"),
        F.transform(F.array_sort(F.collect_list(F.struct("r", "c", F.col(value).cast("double").alias("v")))), lambda s: s["v"]).alias("pixels"),
    )


def mosaic(images: DataFrame, across: int) -> DataFrame:
    """across x across neighbouring images (by id) side by side; a missing image is zeros, and a mosaic is as large as its members' largest."""
    n = across * across
    k = F.pmod("image_id", F.lit(n))
    size = images.groupBy(F.floor(F.col("image_id") / n).cast("bigint").alias("g")).agg(F.max("h").alias("top_h"), F.max("w").alias("top_w"))
    placed = images.withColumn("g", F.floor(F.col("image_id") / n).cast("bigint")).join(size, "g")
    tiles = placed.select(
        F.col("g").alias("image_id"), (F.floor(k / across) * F.col("top_h")).cast("int").alias("row_off"), (F.pmod(k, F.lit(across)) * F.col("top_w")).cast("int").alias("col_off"),
        (F.col("top_h") * across).cast("int").alias("image_h"), (F.col("top_w") * across).cast("int").alias("image_w"), "h", "w", "pixels",
    )
    return untile(tiles)


def stacks(batch: pa.RecordBatch, pixels: str = "pixels") -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, stack, row numbers) of the images of one shape in a batch with image_id, h, w and pixels."""
    ids = batch.column("image_id").to_numpy(zero_copy_only=False)
    h, w = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "w"))
    col = batch.column(pixels)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    offset = col.offsets.to_numpy() - col.offsets[0].as_py()
    for shape in sorted(set(zip(h.tolist(), w.tolist()))):
        rows = np.flatnonzero((h == shape[0]) & (w == shape[1]))
        size = shape[0] * shape[1]
        per = max(1, BATCH_PIXELS // max(size, 1))
        for a in range(0, len(rows), per):
            some = rows[a : a + per]
            yield ids[some], flat[offset[some][:, None] + np.arange(size)].reshape(len(some), *shape).astype(float), some


def whole(images: DataFrame, *others: str) -> DataFrame:
    """Images whose pixels are there and fit their size, with the named arrays; others can't be computed on and give no rows."""
    return images.where((F.col("h") > 0) & (F.col("w") > 0) & (F.size("pixels") == F.col("h") * F.col("w")) & F.col("image_id").isNotNull()).select(
        F.col("image_id").cast("bigint").alias("image_id"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("pixels").cast("array<double>").alias("pixels"), *[F.col(o).cast("array<double>").alias(o) for o in others]
    )


def map_images(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply a stack kernel to every image; the result is an image row again, perhaps of another size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, _ in stacks(b):
                y = np.ascontiguousarray(kernel(x), dtype=float)
                size = [pa.array(np.full(len(y), v, np.int32)) for v in y.shape[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), *size, _listed(y)], names=["image_id", "h", "w", "pixels"])

    return whole(images).mapInArrow(run, IMAGE_DDL)


def describe_images(images: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], ddl: str) -> DataFrame:
    """Apply a kernel (ids, stack) -> columns of any length; ``ddl`` names and types them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, _ in stacks(b):
                cols = kernel(ids, x)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))

    return whole(images).mapInArrow(run, ddl)


def map_pairs(pairs: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], ddl: str) -> DataFrame:
    """Kernel over two images of one shape: rows (image_id, h, w, pixels, other); the columns follow image_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for (ids, x, _), (_, y, _) in zip(stacks(b), stacks(b, "other")):
                cols = {"image_id": ids, **kernel(x, y)}
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], names=list(cols))

    return pairs.where((F.size("pixels") == F.size("other")) & (F.size("pixels") == F.col("h") * F.col("w"))).select("image_id", "h", "w", "pixels", "other").mapInArrow(run, ddl)


def channel_planes(images: DataFrame) -> DataFrame:
    """image_id, ch, h, w, pixels: one row a channel of images whose ``c`` channels are interleaved (row, column, channel).

    A null c counts as 1. Stencils, masks and measures run on planes as on
    images. Pixels that don't fit their size give nothing.
    """
    c = F.coalesce(F.col("c"), F.lit(1))
    ok = images.where(F.size("pixels") == F.col("h") * F.col("w") * c).select(F.col("image_id").cast("bigint").alias("image_id"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), c.cast("int").alias("c"), F.col("pixels").cast("array<double>").alias("pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, w, c = (b.column(k).to_pylist() for k in ("h", "w", "c"))
            for i in range(b.num_rows):
                x = b.column("pixels")[i].values.to_numpy(zero_copy_only=False).reshape(h[i] * w[i], c[i]).T
                same = lambda v, n=c[i]: pa.array([v] * n, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([b.column("image_id")[i].as_py()] * c[i], pa.int64()), pa.array(range(c[i]), pa.int32()), same(h[i]), same(w[i]), _listed(x)], names=["image_id", "ch", "h", "w", "pixels"])

    return ok.mapInArrow(run, "image_id bigint, ch int, h int, w int, pixels array<double>")


def spread(images: DataFrame) -> DataFrame:
    """Images dealt evenly over the session's shuffle partitions, for kernels that cost far more than moving the rows."""
    return images.repartition(shuffle_width(images.sparkSession), "image_id")


def _tiles_of(x: np.ndarray, tile: int, halo: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row offset, column offset, stack of tiles) of a stack of images; the edge is repeated beyond the image."""
    h, w = x.shape[1:]
    p = np.pad(x, ((0, 0), (halo, halo), (halo, halo)), mode="edge")
    for r in range(0, h, tile):
        for c in range(0, w, tile):
            yield r, c, p[:, r : min(r + tile, h) + 2 * halo, c : min(c + tile, w) + 2 * halo]


def _listed(y: np.ndarray) -> pa.Array:
    n, size = len(y), int(np.prod(y.shape[1:]))
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(np.ascontiguousarray(y, dtype=float).ravel()))


def tiled(images: DataFrame, tile: int, halo: int) -> DataFrame:
    """Tiles of tile x tile pixels with halo pixels of their neighbours around them.

    Beyond the image the halo repeats the edge, so stencils with the replicate
    rule and a radius of at most halo give on tiles what they give on the whole.
    Returns image_id, row_idx, col_idx, row_off, col_off, image_h, image_w, h, w
    (of the tile with its halo) and pixels. Images are cut where they lie.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, _ in stacks(b):
                for r, c, y in _tiles_of(x, tile, halo):
                    same = lambda v, n=len(ids): pa.array(np.full(n, v, np.int32))
                    cols = [pa.array(ids), *[same(v) for v in (r // tile, c // tile, r, c, *x.shape[1:], *y.shape[1:])], _listed(y)]
                    yield pa.RecordBatch.from_arrays(cols, schema=_TILE_SCHEMA)

    ddl = "image_id bigint, row_idx int, col_idx int, row_off int, col_off int, image_h int, image_w int, h int, w int, pixels array<double>"
    return whole(images).mapInArrow(run, ddl)


def map_tiles(images: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], tile: int, halo: int, apart: bool = False) -> DataFrame:
    """A replicate-border kernel of radius <= halo over tiles: image_id, row_off, col_off, h, w, pixels without the halo.

    With ``apart`` the tiles of one image are dealt to different tasks, which
    pays for images so large that one task should not compute them alone.
    """
    tiles = tiled(images, tile, halo)
    if apart:
        tiles = tiles.repartition(shuffle_width(images.sparkSession), "image_id", "row_off", "col_off")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, x, rows in stacks(b):
                y = kernel(x)
                y = y[:, halo : y.shape[1] - halo, halo : y.shape[2] - halo]
                pick = pa.array(rows)
                size = [pa.array(np.full(len(y), v, np.int32)) for v in y.shape[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), b.column("row_off").take(pick), b.column("col_off").take(pick), *size, _listed(y)], names=["image_id", "row_off", "col_off", "h", "w", "pixels"])

    return tiles.select("image_id", "row_off", "col_off", "h", "w", "pixels").mapInArrow(run, "image_id bigint, row_off int, col_off int, h int, w int, pixels array<double>")


def together(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of one key in one partition, side by side, in the given order.

    The shuffle goes by a hash of the key, not by the key itself: the planner
    takes a shuffle by a key for done where the rows seem to lie by it, but an
    adaptive plan may then read them locally.
    """
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)


def fold(rows: DataFrame, key: str, start: Callable[[dict], np.ndarray], add: Callable[[np.ndarray, dict, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]]:
    """A batch function that folds neighbouring rows of one key into one array, one row after the other.

    ``start(row)`` makes the array of a new key, ``add(array, row, pixels)``
    enters a row and returns the array. Only the key at hand is held.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        current, out = None, None
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in names if n != "pixels"}
            pixels = b.column("pixels")
            for i in range(b.num_rows):
                row = {n: v[i] for n, v in cols.items()}
                if out is None or row[key] != current:
                    if out is not None:
                        yield current, out
                    current, out = row[key], start(row)
                out = add(out, row, pixels[i].values.to_numpy(zero_copy_only=False))
        if out is not None:
            yield current, out

    return run


def untile(tiles: DataFrame) -> DataFrame:
    """Images from tiles (image_id, row_off, col_off, h, w, pixels[, image_h, image_w]): one shuffle on image_id.

    Tiles are written into their image one by one; only the image at hand is in
    memory. Without image_h and image_w an image grows to its last tile; what no
    tile covers is 0, of overlapping tiles the last in order of offsets counts.
    """
    sized = "image_h" in tiles.columns
    cols = ["image_id", "row_off", "col_off", "h", "w", "pixels", *(["image_h", "image_w"] if sized else [])]
    t = tiles.where("image_id is not null and pixels is not null").select(cols)

    t = together(t, "image_id", "row_off", "col_off")

    def add(out: np.ndarray, row: dict, pixels: np.ndarray) -> np.ndarray:
        r, c, h, w = (row[k] for k in ("row_off", "col_off", "h", "w"))
        if r + h > out.shape[0] or c + w > out.shape[1]:
            out = np.pad(out, ((0, max(r + h - out.shape[0], 0)), (0, max(c + w - out.shape[1], 0))))
        out[r : r + h, c : c + w] = pixels.reshape(h, w)
        return out

    folded = fold(t, "image_id", lambda row: np.zeros((row["image_h"], row["image_w"]) if sized else (0, 0)), add)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for image_id, x in folded(batches):
            yield pa.RecordBatch.from_arrays([pa.array([image_id], pa.int64()), *[pa.array([v], pa.int32()) for v in x.shape], _listed(x[None])], names=["image_id", "h", "w", "pixels"])

    return t.mapInArrow(run, IMAGE_DDL)


def collate(images: DataFrame, batch: Column) -> DataFrame:
    """image_id, batch, h, w, pixels: zero-padding right and below to the largest height and width of each batch."""
    b = images.withColumn("batch", batch.cast("bigint"))
    top = b.groupBy("batch").agg(F.max("h").alias("bh"), F.max("w").alias("bw"))
    rows = b.join(top, "batch").where(F.size("pixels") == F.col("h") * F.col("w")).select("image_id", "batch", "h", "w", "bh", "bw", "pixels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bh, bw = (b.column(k).to_numpy(zero_copy_only=False) for k in ("bh", "bw"))
            for ids, x, at in stacks(b):
                for one, i, n in zip(x, ids, at):
                    y = np.zeros((bh[n], bw[n]))
                    y[: one.shape[0], : one.shape[1]] = one
                    yield pa.RecordBatch.from_arrays([pa.array([i]), b.column("batch").slice(int(n), 1), *[pa.array([v], pa.int32()) for v in y.shape], _listed(y[None])], names=["image_id", "batch", "h", "w", "pixels"])

    return rows.mapInArrow(run, "image_id bigint, batch bigint, h int, w int, pixels array<double>")


def stat(images: DataFrame, name: str, value: Column) -> DataFrame:
    """One scalar per image from its pixel array, JVM-side."""
    return images.select("image_id", value.alias(name))
