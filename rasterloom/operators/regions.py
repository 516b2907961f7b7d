"""Regions of images: crops, sliding patches, and annotations drawn as masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import kernels as K
from rasterloom.operators.raster import _listed, stacks, whole

#: Radius of the disk that a lone point becomes.
POINT_RADIUS = 3


def crop(boxed: DataFrame) -> DataFrame:
    """Half-open boxes [y_min, y_max) x [x_min, x_max) of images, clamped to them: image_id, y_min, x_min, h, w, pixels.

    ``boxed``: image rows with x_min, y_min, x_max, y_max. Empty boxes and null corners give nothing.
    """
    corners = ["x_min", "y_min", "x_max", "y_max"]
    ok = boxed.dropna(subset=corners).where((F.size("pixels") == F.col("h") * F.col("w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            box = [b.column(c).to_pylist() for c in corners]
            for ids, x, rows in stacks(b):
                for one, image, n in zip(ids, x, rows):
                    x0, y0, x1, y1 = (c[n] for c in box)
                    x0, y0 = max(x0, 0), max(y0, 0)
                    part = image[y0 : max(y1, 0), x0 : max(x1, 0)]
                    if part.size:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([one]), *[pa.array([v], pa.int32()) for v in (y0, x0, *part.shape)], _listed(part[None])],
                            names=["image_id", "y_min", "x_min", "h", "w", "pixels"],
                        )

    cols = ok.select(F.col("image_id").cast("bigint").alias("image_id"), F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w"), F.col("pixels").cast("array<double>").alias("pixels"), *[F.col(c).cast("int").alias(c) for c in corners])
    return cols.mapInArrow(run, "image_id bigint, y_min int, x_min int, h int, w int, pixels array<double>")


def sliding_patches(images: DataFrame, size: int = 512, stride: int = 256, other: str | None = None) -> DataFrame:
    """Zero-padded size x size patches at every stride-th row and column, every start kept: image_id, patch_idx, row_off, col_off, is_padded, h, w, pixels.

    ``other`` names a second array of the same shape (a mask), whose patches go
    along. The patches are cut where the image lies; only patches, never copies
    of the image, leave the task.
    """
    ok = images.where(F.size("pixels") == F.size(other)) if other else images
    rows = whole(ok, *([other] if other else []))
    names = ["image_id", "patch_idx", "row_off", "col_off", "is_padded", "h", "w", "pixels", *([other] if other else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, *stack in ((ids, x, *([o] if o is not None else [])) for ids, x, o in _both(b, other)):
                h, w = stack[0].shape[1:]
                padded = [np.pad(x, ((0, 0), (0, size), (0, size))) for x in stack]
                at = [(r, c) for r in range(0, h, stride) for c in range(0, w, stride)]
                for i, (r, c) in enumerate(at):
                    cut = [_listed(p[:, r : r + size, c : c + size]) for p in padded]
                    same = lambda v, t=pa.int32(), n=len(ids): pa.array([v] * n, t)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), same(i), same(r), same(c), same(r + size > h or c + size > w, pa.bool_()), same(size), same(size), *cut], names=names)

    ddl = "image_id bigint, patch_idx int, row_off int, col_off int, is_padded boolean, h int, w int, pixels array<double>"
    return rows.mapInArrow(run, ddl + (f", {other} array<double>" if other else ""))


def _both(b: pa.RecordBatch, other: str | None) -> Iterator[tuple]:
    """(ids, stack, stack of the other array or None)."""
    if other is None:
        yield from ((ids, x, None) for ids, x, _ in stacks(b))
    else:
        yield from ((ids, x, y) for (ids, x, _), (_, y, _) in zip(stacks(b), stacks(b, other)))


def draw_points(points: list[tuple[float, float]], h: int, w: int, whole: bool = True) -> np.ndarray:
    """Mask of one outline of (x, y) points: one or two points are disks, more a polygon; ``whole`` cuts vertices to whole numbers."""
    out = np.zeros((h, w), bool)
    if len(points) < 3:
        r, c = np.ogrid[:h, :w]
        for x, y in points:
            out |= (r - int(y)) ** 2 + (c - int(x)) ** 2 < POINT_RADIUS**2
        return out
    return fill_polygon([(int(x), int(y)) for x, y in points] if whole else points, h, w)


def fill_polygon(points: list[tuple[float, float]], h: int, w: int) -> np.ndarray:
    """Even-odd rule for (x, y) vertices at the pixels' corners, clipped to the image.

    Works row by row on the crossings of each edge; the polygon's size, not the image's, sets the cost.
    """
    out = np.zeros((h, w), bool)
    y0 = max(int(np.floor(min(p[1] for p in points))), 0)
    y1 = min(int(np.ceil(max(p[1] for p in points))), h - 1)
    if y1 < y0:
        return out
    rows = np.arange(y0, y1 + 1)
    part = np.zeros((len(rows), w), bool)
    c = np.arange(w)
    for (xa, ya), (xb, yb) in zip(points, [*points[1:], points[0]]):
        if ya == yb:
            continue
        hit = (ya > rows) != (yb > rows)
        x = (xb - xa) * (rows[hit] - ya) / (yb - ya) + xa
        part[hit] ^= c[None, :] < x[:, None]
    out[y0 : y1 + 1] = part
    return out


def outline_runs(outlines: DataFrame) -> DataFrame:
    """Runs of pixels inside outlines (key, points array<struct<x, y>>, h, w): key, r, c0, c1 (inclusive).

    Every outline is filled in its own box of an h x w image; only its runs
    leave the task. Null and empty outlines give nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, points, hs, ws = (b.column(i).to_pylist() for i in range(4))
            cols = [[], [], [], []]
            for k, ps, h, w in zip(keys, points, hs, ws):
                m = np.zeros((h, w + 2), np.int8)
                m[:, 1:-1] = draw_points([(p["x"], p["y"]) for p in ps], h, w, whole=False)
                step = np.diff(m, axis=1)
                r, c0 = np.nonzero(step == 1)
                c1 = np.nonzero(step == -1)[1] - 1
                for col, v in zip(cols, ([k] * len(r), r.tolist(), c0.tolist(), c1.tolist())):
                    col.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.int32()) for c in cols[1:]]], names=["key", "r", "c0", "c1"])

    ok = outlines.where("key is not null and h > 0 and w > 0 and size(points) > 0")
    return ok.select(F.col("key").cast("bigint").alias("key"), "points", F.col("h").cast("int").alias("h"), F.col("w").cast("int").alias("w")).mapInArrow(run, "key bigint, r int, c0 int, c1 int")


def rasterise(outlines: DataFrame, sizes: DataFrame, key: str = "case_id") -> DataFrame:
    """One 0/1 mask a key: all outlines OR-ed. ``outlines``: key, points array<struct<x, y>>; ``sizes``: key, h, w.

    Keys without outlines get an empty mask, outlines without a size are
    dropped. A key's outlines meet in the task that draws its mask.
    """
    kind = dict(sizes.dtypes)[key]
    merged = outlines.where(F.size("points") > 0).groupBy(key).agg(F.collect_list("points").alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ws, alls = (b.column(i).to_pylist() for i in (1, 2, 3))
            for i in range(b.num_rows):
                mask = np.zeros((hs[i], ws[i]), bool)
                for points in alls[i] or []:
                    mask |= draw_points([(p["x"], p["y"]) for p in points], hs[i], ws[i])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([hs[i]], pa.int32()), pa.array([ws[i]], pa.int32()), _listed(mask[None])], names=[key, "h", "w", "pixels"])

    return sizes.where("h > 0 and w > 0").select(key, "h", "w").join(merged, key, "left").mapInArrow(run, f"`{key}` {kind}, h int, w int, pixels array<double>")


def located(pairs: DataFrame) -> DataFrame:
    """image_id and box x0, y0, x1, y1 of crops in their images: rows (image_id, h, w, pixels, ch, cw, crop), each found where its edges correlate best.

    Crops larger than their image give nothing.
    """
    ok = pairs.where((F.size("pixels") == F.col("h") * F.col("w")) & (F.size("crop") == F.col("ch") * F.col("cw")) & (F.col("ch") <= F.col("h")) & (F.col("cw") <= F.col("w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, w, ch, cw = (b.column(k).to_pylist() for k in ("h", "w", "ch", "cw"))
            values = lambda k, i: b.column(k)[i].values.to_numpy(zero_copy_only=False)
            boxes = [K.locate(values("pixels", i).reshape(h[i], w[i]), values("crop", i).reshape(ch[i], cw[i])) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("image_id"), *[pa.array([x[k] for x in boxes], pa.int32()) for k in range(4)]], names=["image_id", "x0", "y0", "x1", "y1"])

    cols = [F.col("image_id").cast("bigint").alias("image_id"), *[F.col(k).cast("int").alias(k) for k in ("h", "w", "ch", "cw")], *[F.col(k).cast("array<double>").alias(k) for k in ("pixels", "crop")]]
    return ok.select(cols).mapInArrow(run, "image_id bigint, x0 int, y0 int, x1 int, y1 int")


def box_area(box: Column) -> Column:
    at = lambda i: F.get(box, F.lit(i))
    return (at(2) - at(0)) * (at(3) - at(1))
