"""Raster queries over the 8 x 8 images of ``embeddings``, and their DuckDB oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import pointwise as P
from rasterloom.operators import kernels as K
from rasterloom.operators import measures as M
from rasterloom.operators import regions as R
from rasterloom.operators.raster import channel_planes, collate, describe_images, images_from_vectors, map_images, mosaic, tiled, to_px, untile, map_tiles
from rasterloom.plans import pipelines as L
from rasterloom.session import table
from rasterloom.sources.files import merge_masks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LEVEL = 2200  # the cut of the threshold masks used by component queries


def images(spark: SparkSession, d: str) -> DataFrame:
    return images_from_vectors(table(spark, d, "embeddings"))


def _px(df: DataFrame, digits: int | None = 4, cast: str = "double") -> DataFrame:
    px = to_px(df, cast=cast)
    return px if digits is None else px.withColumn("v", F.round("v", digits))


def _mask(df: DataFrame, level: int = LEVEL) -> DataFrame:
    return df.withColumn("pixels", F.transform("pixels", lambda v: F.when(v > level, 1.0).otherwise(0.0)))


# -- SQL building blocks -----------------------------------------------------------

PX = """px AS (
  SELECT vec_id AS image_id, CAST((i - 1) // 8 AS INTEGER) AS r, CAST((i - 1) % 8 AS INTEGER) AS c,
         CAST(floor((CAST(embedding[i] AS DOUBLE) + 1.0) * 2047.5) AS DOUBLE) AS v
  FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))"""

_INDEX = {
    "zero": "{x}",
    "replicate": "least(greatest({x}, 0), 7)",
    "reflect": "CASE WHEN {x} < 0 THEN -({x}) WHEN {x} > 7 THEN 14 - ({x}) ELSE {x} END",
    "symmetric": "CASE WHEN {x} < 0 THEN -({x}) - 1 WHEN {x} > 7 THEN 15 - ({x}) ELSE {x} END",
}


def offsets(radius: int) -> str:
    return f"(SELECT a.x AS dr, b.x AS dc FROM (SELECT unnest(range(-{radius}, {radius + 1})) AS x) a, (SELECT unnest(range(-{radius}, {radius + 1})) AS x) b)"


def stencil(src: str, radius: int, rule: str, agg: str, out: str = "v") -> str:
    """SELECT of one value per pixel of ``src`` (image_id, r, c, v) from its neighbourhood; ``agg`` reads n, dr and dc."""
    r, c = (_INDEX[rule].format(x=x) for x in ("p.r + o.dr", "p.c + o.dc"))
    return f"""SELECT p.image_id, p.r, p.c, {agg.format(n='coalesce(q.v, 0)')} AS {out}
  FROM {src} p CROSS JOIN {offsets(radius)} o
  LEFT JOIN {src} q ON q.image_id = p.image_id AND q.r = {r} AND q.c = {c}
  GROUP BY p.image_id, p.r, p.c"""


def kernel_case(kernel: list[list[float]]) -> str:
    k = len(kernel) // 2
    return "CASE " + " ".join(f"WHEN o.dr = {i - k} AND o.dc = {j - k} THEN {w}" for i, row in enumerate(kernel) for j, w in enumerate(row) if w) + " ELSE 0 END"


def gaussian_sql(src: str, sigma: float, out: str = "v") -> str:
    radius = int(4.0 * sigma + 0.5)
    norm = f"(SELECT sum(exp(-(x * x) / (2.0 * {sigma} * {sigma}))) FROM (SELECT unnest(range(-{radius}, {radius + 1})) AS x))"
    w = f"exp(-(o.dr * o.dr + o.dc * o.dc) / (2.0 * {sigma} * {sigma}))"
    return stencil(src, radius, "replicate", f"sum({{n}} * {w}) / ({norm} * {norm})", out)


def rounded(body: str, digits: int = 4) -> str:
    return f"SELECT image_id, r, c, round(v, {digits}) AS v FROM ({body})"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# -- pixels and point-wise ------------------------------------------------------------


@query("px_scan", f"WITH {PX} SELECT image_id, r, c, CAST(v AS BIGINT) AS v FROM px")
def px_scan(spark, d):
    return _px(images(spark, d), None, "bigint")


def _pointwise(name: str, expr: Callable[[Column, Column, Column], Column], sql: str) -> None:
    """expr of (v, image minimum, image maximum); the extremes come from the row itself, without a shuffle."""

    def run(spark, d):
        i = images(spark, d)
        at = i.select("image_id", F.array_min("pixels").alias("lo"), F.array_max("pixels").alias("hi"), F.posexplode("pixels").alias("pos", "x"))
        return at.select("image_id", F.floor(F.col("pos") / 8).cast("int").alias("r"), F.pmod("pos", F.lit(8)).cast("int").alias("c"), F.round(expr(F.col("x"), F.col("lo"), F.col("hi")) + 1e-9, 4).alias("v"))

    ext = "px2 AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM px)"
    query(name, f"WITH {PX}, {ext} SELECT image_id, r, c, round(CAST({sql} AS DOUBLE) + 1e-9, 4) AS v FROM px2")(run)


_pointwise("gamma_correct", lambda v, lo, hi: P.gamma_correction(v, 1.25), "pow(v / 4095.0, 1.25) * 4095.0")
_pointwise("contrast_adjust", lambda v, lo, hi: P.contrast_adjust(v, hi, 60, 20), "least(greatest(v * (60.0 / ((CASE WHEN hi <= 255 THEN 255.0 ELSE 4095.0 END) / 2) + 1.0) - 40.0, 0), CASE WHEN hi <= 255 THEN 255.0 ELSE 4095.0 END)")
_pointwise("normalize_12bit", lambda v, lo, hi: P.normalize_12bit(v), "least(greatest(v / 4095.0, 0), 1)")
_pointwise("dicom_window", lambda v, lo, hi: P.dicom_window(v, 2000, 800), "least(greatest((v - 1600.0) / 800.0, 0), 1) * 255.0")
_pointwise("dicom_window_auto", lambda v, lo, hi: P.dicom_window(v, *P.window_of(lo, hi)), "least(greatest((v - ((lo + hi) / 2 - (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) / 2)) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 0), 1) * 255.0")
_pointwise("intensity_window", lambda v, lo, hi: P.intensity_window(v, 1500, 2500), "least(greatest((v - 1500.0) / 1000.0, 0), 1) * 255.0")
_pointwise("bit_depth_norm", lambda v, lo, hi: P.normalize_bit_depth(v, P.bits_stored(hi)), "least(greatest(v / (CASE WHEN hi <= 255 THEN 255.0 WHEN hi <= 4095 THEN 4095.0 ELSE 65535.0 END), 0), 1) * 255.0")


@query("dicom_window_pipeline", f"WITH {PX}, px2 AS (SELECT *, min(v) OVER (PARTITION BY image_id) AS lo, max(v) OVER (PARTITION BY image_id) AS hi FROM px) SELECT image_id, r, c, round(least(greatest((v - ((lo + hi) / 2 - (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) / 2)) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END), 0), 1) * 255.0 + 1e-9, 4) AS v FROM px2")
def dicom_window_pipeline(spark, d):
    return _px(L.DicomWindow()(images(spark, d)).withColumn("pixels", F.transform("pixels", lambda v: v + 1e-9)))


@query("bit_depth_pipeline", f"WITH {PX}, px2 AS (SELECT *, max(v) OVER (PARTITION BY image_id) AS hi FROM px) SELECT image_id, r, c, round(least(greatest(v / (CASE WHEN hi <= 255 THEN 255.0 WHEN hi <= 4095 THEN 4095.0 ELSE 65535.0 END), 0), 1) * 255.0 + 1e-9, 4) AS v FROM px2")
def bit_depth_pipeline(spark, d):
    return _px(L.BitDepthNorm()(images(spark, d)).withColumn("pixels", F.transform("pixels", lambda v: v + 1e-9)))


@query("abs_values", f"WITH {PX} SELECT image_id, r, c, abs(v - 2048.0) AS v FROM px")
def abs_values(spark, d):
    return _px(images(spark, d).withColumn("pixels", F.transform("pixels", lambda v: P.absolute(v - 2048.0))), None)


@query("histogram_16", f"""WITH {PX}, ext AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id), e AS (SELECT image_id, CASE WHEN hi > lo THEN lo ELSE lo - 1 END AS lo, CASE WHEN hi > lo THEN hi ELSE hi + 1 END AS hi FROM ext)
 SELECT image_id, CAST(bin AS INTEGER) AS bin, round(min(lo + bin * (hi - lo) / 16), 4) AS lo, count(*) AS n FROM (SELECT image_id, lo, hi, least(floor((v - lo) * 16 / (hi - lo)), 15) AS bin FROM px JOIN e USING (image_id)) GROUP BY image_id, bin""")
def histogram_16(spark, d):
    return M.histograms(images(spark, d), 16).select("image_id", "bin", F.round("lo", 4).alias("lo"), "n")


@query("channels_first", f"""WITH {PX} SELECT image_id // 3 AS image_id, CAST(image_id % 3 AS INTEGER) AS ch, r, c, v FROM px WHERE image_id // 3 IN (SELECT image_id // 3 FROM (SELECT DISTINCT image_id FROM px) GROUP BY 1 HAVING count(*) = 3)""")
def channels_first(spark, d):
    """Three neighbouring images as the interleaved channels of one, brought to planes."""
    g = images(spark, d).select(F.floor(F.col("image_id") / 3).cast("bigint").alias("g"), F.pmod("image_id", F.lit(3)).alias("k"), "h", "w", "pixels")
    rgb = g.groupBy("g").agg(F.first("h").alias("h"), F.first("w").alias("w"), F.transform(F.array_sort(F.collect_list(F.struct("k", "pixels"))), lambda s: s["pixels"]).alias("p")).where(F.size("p") == 3)
    mixed = rgb.select(F.col("g").alias("image_id"), "h", "w", F.lit(3).alias("c"), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform("p", lambda q: F.get(q, i)))).alias("pixels"))
    planes = channel_planes(mixed)
    return planes.select("image_id", "ch", "w", F.posexplode("pixels").alias("pos", "v")).select("image_id", "ch", F.floor(F.col("pos") / F.col("w")).cast("int").alias("r"), F.pmod("pos", "w").cast("int").alias("c"), "v")


@query("image_stats", f"WITH {PX} SELECT image_id, min(v) AS v_min, max(v) AS v_max, round(avg(v), 4) AS v_mean, count(*) AS n, CAST(256 AS BIGINT) AS n_bytes FROM px GROUP BY image_id")
def image_stats(spark, d):
    mean = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x) / F.size("pixels")
    return images(spark, d).select(
        "image_id", F.array_min("pixels").alias("v_min"), F.array_max("pixels").alias("v_max"), F.round(mean, 4).alias("v_mean"),
        F.size("pixels").cast("bigint").alias("n"), P.image_bytes(F.col("h"), F.col("w")).alias("n_bytes"),
    )


# -- thresholds and measures -----------------------------------------------------------

OTSU = f"""WITH {PX},
 ext AS (SELECT image_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY image_id),
 cfg AS (SELECT *, CASE WHEN hi <= 255 THEN 256 ELSE 4096 END AS nb FROM ext),
 binned AS (SELECT p.image_id, lo, hi, nb, CASE WHEN hi > lo THEN least(floor((v - lo) * nb / (hi - lo)), nb - 1) ELSE 0 END AS bin FROM px p JOIN cfg USING (image_id)),
 hist AS (SELECT image_id, bin, lo, hi, nb, count(*) AS n FROM binned GROUP BY ALL),
 cum AS (SELECT *, lo + bin * (hi - lo) / (nb - 1) AS centre,
   sum(n) OVER a AS w1, sum(n * (lo + bin * (hi - lo) / (nb - 1))) OVER a AS s1,
   sum(n) OVER (PARTITION BY image_id) AS w, sum(n * (lo + bin * (hi - lo) / (nb - 1))) OVER (PARTITION BY image_id) AS s
   FROM hist WINDOW a AS (PARTITION BY image_id ORDER BY bin ROWS UNBOUNDED PRECEDING)),
 best AS (SELECT image_id, bin, centre, row_number() OVER (PARTITION BY image_id ORDER BY round(w1 * (w - w1) * pow(s1 / greatest(w1, 1e-6) - (s - s1) / greatest(w - w1, 1e-6), 2), 2) DESC, bin) AS k FROM cum),
 otsu AS (SELECT image_id, bin, centre AS threshold FROM best WHERE k = 1)"""


@query("otsu_threshold", OTSU + " SELECT image_id, CAST(bin AS INTEGER) AS bin, round(threshold, 4) AS threshold FROM otsu")
def otsu_threshold(spark, d):
    return M.otsu_thresholds(images(spark, d)).select("image_id", "bin", F.round("threshold", 4).alias("threshold"))


@query("otsu_foreground_count", OTSU + " SELECT o.image_id, round(threshold, 4) AS threshold, CAST(count(*) FILTER (WHERE v > threshold) AS BIGINT) AS n_foreground FROM otsu o JOIN px USING (image_id) GROUP BY o.image_id, threshold")
def otsu_foreground_count(spark, d):
    return M.otsu_thresholds(images(spark, d)).select("image_id", F.round("threshold", 4).alias("threshold"), F.col("foreground").alias("n_foreground"))


_SAUVOLA = stencil("px", 2, "replicate", "struct_pack(m := sum({n}) / 25, e := sum({n} * {n}) / 25)", "s")


@query("sauvola_w5", f"WITH {PX}, st AS ({_SAUVOLA}) SELECT p.image_id, p.r, p.c, CASE WHEN p.v > s.m * (1 + 0.2 * (sqrt(s.e - s.m * s.m + 1e-8) / 128.0 - 1)) THEN 255.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM px p JOIN st USING (image_id, r, c)")
def sauvola_w5(spark, d):
    return _px(map_images(images(spark, d), lambda x: K.sauvola(x, 5, k=0.2)))


_LOCAL = stencil("px", 2, "reflect", "var_samp({n})")


@query("local_variance_w5", f"WITH {PX} " + rounded(_LOCAL))
def local_variance_w5(spark, d):
    return _px(map_images(images(spark, d), lambda x: K.local_variance(x, 5)))


@query("global_variance", f"WITH {PX} SELECT image_id, round(var_samp(v), 4) AS variance FROM px GROUP BY image_id")
def global_variance(spark, d):
    return M.global_variances(images(spark, d)).select("image_id", F.round("variance", 4).alias("variance"))


@query("binarize_variance", f"WITH {PX}, lv AS ({_LOCAL}), gv AS (SELECT image_id, var_samp(v) AS g FROM px GROUP BY image_id) SELECT image_id, r, c, CASE WHEN v * v >= g * g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM lv JOIN gv USING (image_id)")
def binarize_variance(spark, d):
    return _px(map_images(images(spark, d), lambda x: K.binarize_by_variance(x, 1.0)))


ENT = "ent AS (SELECT image_id, round(-sum(n / 64.0 * log2(n / 64.0)) + 1e-9, 4) AS h FROM (SELECT image_id, v, count(*) AS n FROM px GROUP BY image_id, v) GROUP BY image_id)"
JOINT = "jnt AS (SELECT image_id, round(-sum(n / 64.0 * log2(n / 64.0)) + 1e-9, 4) AS h FROM (SELECT a.image_id, a.v AS x, b.v AS y, count(*) AS n FROM px a JOIN px b ON b.image_id = a.image_id + 1 AND a.r = b.r AND a.c = b.c GROUP BY ALL) GROUP BY image_id)"


@query("entropy", f"WITH {PX}, {ENT} SELECT image_id, h AS entropy FROM ent")
def entropy(spark, d):
    return M.entropies(images(spark, d))


@query("joint_entropy", f"WITH {PX}, {JOINT} SELECT image_id, h AS joint_entropy FROM jnt")
def joint_entropy(spark, d):
    return M.pair_information(M.neighbours(images(spark, d))).select("image_id", "joint_entropy")


@query("joint_entropy_raw", f"""WITH {PX}, ext AS (SELECT image_id, max(v) - min(v) + 1 AS nb FROM px GROUP BY image_id),
 keys AS (SELECT a.image_id, a.v * y.nb + b.v AS k, x.nb * y.nb AS top FROM px a JOIN px b ON b.image_id = a.image_id + 1 AND a.r = b.r AND a.c = b.c JOIN ext x ON x.image_id = a.image_id JOIN ext y ON y.image_id = b.image_id),
 n AS (SELECT image_id, k, count(*) AS n FROM keys WHERE k <= top - 1 GROUP BY image_id, k),
 t AS (SELECT image_id, round(-sum(n / tot * log2(n / tot)) + 1e-9, 4) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY image_id) AS tot FROM n) GROUP BY image_id)
 SELECT i.image_id, coalesce(h, 0.0) AS joint_entropy FROM (SELECT DISTINCT image_id FROM keys) i LEFT JOIN t USING (image_id)""")
def joint_entropy_raw(spark, d):
    return M.pair_information(M.neighbours(images(spark, d)), normalized=False).select("image_id", "joint_entropy")


@query("mutual_information", f"WITH {PX}, {ENT}, {JOINT} SELECT j.image_id, round(a.h + b.h - j.h, 4) AS mutual_information FROM jnt j JOIN ent a ON a.image_id = j.image_id JOIN ent b ON b.image_id = j.image_id + 1")
def mutual_information(spark, d):
    return M.pair_information(M.neighbours(images(spark, d))).select("image_id", "mutual_information")


# -- filters -------------------------------------------------------------------------------

EDGE = [[1.0, 2.0, 1.0], [0.0, 0.0, 0.0], [-1.0, -2.0, -1.0]]


def _kernel(name: str, kernel: Callable[[np.ndarray], np.ndarray], sql: str | None) -> None:
    query(name, sql)(lambda spark, d: _px(map_images(images(spark, d), kernel)))


_kernel("convolve_3x3", lambda x: K.correlate(x, np.array(EDGE)), f"WITH {PX} " + rounded(stencil("px", 1, "zero", f"sum({{n}} * ({kernel_case(EDGE)}))")))
_kernel("gaussian_s1", lambda x: K.gaussian(x, 1.0), f"WITH {PX} " + rounded(gaussian_sql("px", 1.0)))
_kernel("dog", lambda x: K.difference_of_gaussian(x, 1.0), f"WITH {PX}, a AS ({gaussian_sql('px', 1.0)}), b AS ({gaussian_sql('px', 1.6)}) SELECT image_id, r, c, round(a.v - b.v, 4) AS v FROM a JOIN b USING (image_id, r, c)")
_kernel("log_s2", lambda x: K.laplacian_of_gaussian(x, 2.0), f"WITH {PX}, g AS ({gaussian_sql('px', 2.0)}) " + rounded(stencil("g", 1, "reflect", f"sum({{n}} * ({kernel_case(K.LAPLACE.tolist())}))")))
for _size in (3, 5):
    _kernel(f"median_{_size}", lambda x, k=_size: K.median(x, k), f"WITH {PX} " + rounded(stencil("px", _size // 2, "reflect", "median({n})")))
_kernel(
    "sobel",
    K.sobel,
    f"WITH {PX}, g AS ("
    + stencil("px", 1, "symmetric", "sqrt((pow(sum({n} * o.dr * (2 - abs(o.dc))) / 8, 2) + pow(sum({n} * o.dc * (2 - abs(o.dr))) / 8, 2)) / 2)")
    + ") SELECT image_id, r, c, round(v, 4) AS v FROM g",
)
_kernel("max_filter_3", lambda x: K.box(x, 3, "symmetric", np.maximum), f"WITH {PX} " + stencil("px", 1, "symmetric", "max({n})"))


@query("gaussian_tiled", f"WITH {PX} " + rounded(gaussian_sql("px", 1.0)))
def gaussian_tiled(spark, d):
    """The Gaussian on 3 x 3 tiles with a halo of its radius: equal to the whole image's."""
    return _px(untile(map_tiles(images(spark, d), lambda x: K.gaussian(x, 1.0), 3, 4)))


# -- morphology ---------------------------------------------------------------------------------

ERODE = stencil("px", 2, "zero", "min({n})")
_kernel("erode_r2", lambda x: K.erode(x, 2), f"WITH {PX} " + ERODE)
_kernel("dilate_r2", lambda x: K.dilate(x, 2), f"WITH {PX} " + stencil("px", 2, "zero", "max({n})"))
_kernel("white_top_hat_r2", lambda x: K.white_top_hat(x, 2), f"WITH {PX}, e AS ({ERODE}), o AS ({stencil('e', 2, 'zero', 'max({n})')}) SELECT image_id, r, c, greatest(px.v - o.v, 0) AS v FROM px JOIN o USING (image_id, r, c)")
MASK = f"m AS (SELECT image_id, r, c, CASE WHEN v > {LEVEL} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM px)"
for _size in (3, 7):
    query(f"closing_k{_size}", f"WITH {PX}, {MASK}, d AS ({stencil('m', _size // 2, 'zero', 'max({n})')}) " + stencil("d", _size // 2, "zero", "min({n})"))(
        lambda spark, d, k=_size: _px(map_images(_mask(images(spark, d)), lambda x: K.closing(x, k)))
    )


_NEAR8 = "q.image_id = p.image_id AND abs(q.r - p.r) <= 1 AND abs(q.c - p.c) <= 1 AND (q.r <> p.r OR q.c <> p.c)"


@query("regional_maxima", f"""WITH RECURSIVE {PX}, flat AS (SELECT image_id FROM px GROUP BY image_id HAVING min(v) = max(v)),
 low(image_id, r, c, v) AS (SELECT DISTINCT p.image_id, p.r, p.c, p.v FROM px p JOIN px q ON {_NEAR8} WHERE q.v > p.v
   UNION SELECT p.image_id, p.r, p.c, p.v FROM px p JOIN low q ON {_NEAR8} AND p.v = q.v)
 SELECT image_id, r, c FROM px WHERE NOT EXISTS (SELECT 1 FROM low l WHERE l.image_id = px.image_id AND l.r = px.r AND l.c = px.c) AND image_id NOT IN (SELECT image_id FROM flat)""")
def regional_maxima(spark, d):
    return to_px(map_images(images(spark, d), lambda x: K.regional_maxima(x).astype(float))).where("v = 1").select("image_id", "r", "c")


# -- components -----------------------------------------------------------------------------------


def components_sql(cond: str, src: str = "px", name: str = "comp") -> str:
    """CTEs: ``name`` (image_id, r, c, root) with the least place of the component that holds the pixel."""
    return f"""fg_{name} AS (SELECT image_id, r, c, r * 8 + c AS k FROM {src} WHERE {cond}),
 walk_{name}(image_id, r, c, k) AS (SELECT image_id, r, c, k FROM fg_{name} UNION
   SELECT f.image_id, f.r, f.c, w.k FROM walk_{name} w JOIN fg_{name} f ON f.image_id = w.image_id AND abs(f.r - w.r) + abs(f.c - w.c) = 1),
 {name} AS (SELECT image_id, r, c, min(k) AS root FROM walk_{name} GROUP BY image_id, r, c)"""


COMP = f"WITH RECURSIVE {PX}, {components_sql(f'v > {LEVEL}')}"
LABELS = "lab AS (SELECT image_id, r, c, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM comp)"


@query("connected_components", f"{COMP}, {LABELS} SELECT image_id, r, c, CAST(label AS BIGINT) AS label FROM lab")
def connected_components(spark, d):
    return M.component_labels(_mask(images(spark, d)))


@query("component_bboxes", f"{COMP}, {LABELS} SELECT image_id, CAST(label AS BIGINT) AS label, min(c) AS x_min, min(r) AS y_min, max(c) AS x_max, max(r) AS y_max, count(*) AS n FROM lab GROUP BY image_id, label")
def component_bboxes(spark, d):
    return M.component_boxes(_mask(images(spark, d)))


BIGGEST = "big AS (SELECT image_id, root FROM (SELECT image_id, root, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, root) AS k FROM comp GROUP BY image_id, root) WHERE k = 1)"


@query("largest_component", f"{COMP}, {BIGGEST} SELECT comp.image_id, r, c FROM comp JOIN big USING (image_id, root)")
def largest_component(spark, d):
    return to_px(map_images(_mask(images(spark, d)), K.largest_component)).where("v = 1").select("image_id", "r", "c")


_BREAST = OTSU.replace("WITH ", "WITH RECURSIVE ", 1) + f", ot AS (SELECT px.image_id, r, c, v, threshold FROM px JOIN otsu USING (image_id)), {components_sql('v > threshold', 'ot')}, {BIGGEST}, keep AS (SELECT comp.image_id, r, c FROM comp JOIN big USING (image_id, root))"


@query("breast_mask", _BREAST + " SELECT image_id, r, c FROM keep")
def breast_mask(spark, d):
    return to_px(L.BreastMask()(images(spark, d))).where("v = 1").select("image_id", "r", "c")


@query("apply_breast_mask", _BREAST + " SELECT px.image_id, px.r, px.c, CASE WHEN keep.r IS NULL THEN 0.0 ELSE v END AS v FROM px LEFT JOIN keep ON px.image_id = keep.image_id AND px.r = keep.r AND px.c = keep.c")
def apply_breast_mask(spark, d):
    return _px(L.BreastMask(mask_only=False)(images(spark, d)))


@query("fill_holes", f"""WITH RECURSIVE {PX}, {components_sql(f'v <= {LEVEL}')},
 rim AS (SELECT DISTINCT image_id, root FROM comp WHERE r IN (0, 7) OR c IN (0, 7)),
 out_ AS (SELECT image_id, r, c FROM comp JOIN rim USING (image_id, root))
 SELECT p.image_id, p.r, p.c, CASE WHEN o.r IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM px p LEFT JOIN out_ o ON p.image_id = o.image_id AND p.r = o.r AND p.c = o.c""")
def fill_holes(spark, d):
    return _px(map_images(_mask(images(spark, d)), K.fill_holes))


# -- masks ------------------------------------------------------------------------------------------


@query("or_merge_masks", f"WITH {PX} SELECT image_id // 4 AS group_id, r, c, CAST(max(CASE WHEN v > 2500 THEN 1 ELSE 0 END) AS INTEGER) AS v FROM px GROUP BY 1, r, c")
def or_merge_masks(spark, d):
    """Masks of four neighbouring images merged: 1 where any has a bright pixel."""
    m = _mask(images(spark, d), 2500).select(F.floor(F.col("image_id") / 4).cast("bigint").alias("group_id"), "h", "w", "pixels")
    return to_px(merge_masks(m, "group_id").withColumnRenamed("group_id", "image_id"), cast="int").withColumnRenamed("image_id", "group_id")


@query("mask_and_not", f"WITH {PX} SELECT image_id, r, c FROM px WHERE v > 2000 AND NOT v > 2200")
def mask_and_not(spark, d):
    return _px(images(spark, d), None).where("v > 2000 and not v > 2200").select("image_id", "r", "c")


@query("dice", f"""WITH {PX} SELECT a.image_id, round(2.0 * sum(CASE WHEN a.v > {LEVEL} AND b.v > {LEVEL} THEN 1 ELSE 0 END) / (sum(CASE WHEN a.v > {LEVEL} THEN 1 ELSE 0 END) + sum(CASE WHEN b.v > {LEVEL} THEN 1 ELSE 0 END) + 1e-8), 4) AS dice
 FROM px a JOIN px b ON b.image_id = a.image_id + 1 AND a.r = b.r AND a.c = b.c GROUP BY a.image_id""")
def dice(spark, d):
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    both = total(F.zip_with("pixels", "other", lambda a, b: a * b))
    return M.neighbours(_mask(images(spark, d))).select("image_id", F.round(2.0 * both / (total("pixels") + total("other") + 1e-8), 4).alias("dice"))


# -- tiles, regions, resizing ------------------------------------------------------------------------


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


@query("patch_grid_3", f"""WITH {PX} SELECT image_id, r // 3 AS row_idx, c // 3 AS col_idx, r // 3 * 3 AS row_off, c // 3 * 3 AS col_off,
 (r // 3 = 2 OR c // 3 = 2) AS is_padded, sum(v) AS pixel_sum FROM px GROUP BY ALL""")
def patch_grid_3(spark, d):
    """Tiles of 3 x 3, zero-padded at the bottom and right; padding adds nothing to the sums."""
    t = tiled(images(spark, d), 3, 0)
    padded = (F.col("h") < 3) | (F.col("w") < 3)
    return t.select("image_id", "row_idx", "col_idx", "row_off", "col_off", padded.alias("is_padded"), _total(F.col("pixels")).alias("pixel_sum"))


@query("patch_reconstruct", f"WITH {PX} SELECT image_id, r, c, v FROM px")
def patch_reconstruct(spark, d):
    return _px(untile(tiled(images(spark, d), 3, 0)), None)


@query("sliding_patches", f"""WITH {PX}, g AS (SELECT DISTINCT image_id // 16 AS image_id FROM px), big AS (SELECT image_id // 16 AS image_id, (image_id % 16) // 4 * 8 + r AS r, image_id % 4 * 8 + c AS c, v FROM px),
 offs AS (SELECT unnest(range(0, 32, 8)) AS x)
 SELECT g.image_id, CAST(y.x // 8 * 4 + x.x // 8 AS INTEGER) AS patch_idx, CAST(y.x AS INTEGER) AS row_off, CAST(x.x AS INTEGER) AS col_off, coalesce(sum(v), 0.0) AS pixel_sum, (y.x + 16 > 32 OR x.x + 16 > 32) AS is_padded
 FROM g CROSS JOIN offs y CROSS JOIN offs x LEFT JOIN big b ON b.image_id = g.image_id AND r >= y.x AND r < y.x + 16 AND c >= x.x AND c < x.x + 16 GROUP BY ALL""")
def sliding_patches(spark, d):
    """16 x 16 patches at every 8th row and column of 32 x 32 mosaics of all images; those beyond the edge are zero-padded."""
    p = R.sliding_patches(mosaic(images(spark, d), 4), 16, 8)
    return p.select("image_id", "patch_idx", "row_off", "col_off", _total(F.col("pixels")).alias("pixel_sum"), "is_padded")


@query("patch_to_image", f"WITH {PX} SELECT image_id, r - 3 AS r, c - 6 AS c, v FROM px WHERE r >= 3 AND r < 6 AND c >= 6")
def patch_to_image(spark, d):
    """The second tile of the last column of every image, as an image of its own."""
    return _px(tiled(images(spark, d), 3, 0).where("row_idx = 1 and col_idx = 2").select("image_id", "h", "w", "pixels"), None)


@query("roi_from_center", f"""WITH b AS (SELECT vec_id AS image_id, vec_id % 8 AS cx, vec_id // 8 % 8 AS cy, 1 + vec_id % 3 AS half FROM embeddings)
 SELECT image_id, CAST(greatest(cy - half, 0) AS INTEGER) AS x_min, CAST(greatest(cx - half, 0) AS INTEGER) AS y_min, CAST(least(cy + half + 1, 8) AS INTEGER) AS x_max, CAST(least(cx + half + 1, 8) AS INTEGER) AS y_max FROM b""")
def roi_from_center(spark, d):
    """Boxes around a centre, clamped to the image; the centre is given as (row, column)."""
    from rasterloom.functions.geometry import box_from_center

    i = images(spark, d)
    cx, cy, half = F.pmod("image_id", F.lit(8)), F.pmod(F.floor(F.col("image_id") / 8), F.lit(8)), 1 + F.pmod("image_id", F.lit(3))
    return i.select("image_id", *[c.cast("int").alias(n) for n, c in box_from_center(cx, cy, half, F.col("h"), F.col("w")).items()])


@query("roi_bbox_crop", f"WITH {PX} SELECT image_id, r - 2 AS r, c - 1 AS c, v FROM px WHERE r >= 2 AND r < 6 AND c >= 1 AND c < 7")
def roi_bbox_crop(spark, d):
    """Half-open box [1, 2, 7, 6] of every image, with offsets from its corner."""
    boxed = images(spark, d).selectExpr("*", "1 x_min", "2 y_min", "7 x_max", "6 y_max")
    return _px(R.crop(boxed), None)


TRIANGLE = [(0.5, 0.5), (6.5, 2.5), (2.5, 7.5)]  # (row, column), off the pixels' centres


def polygon_sql(points: list[tuple[float, float]]) -> str:
    edges = zip(points, [*points[1:], points[0]])
    return "(" + " + ".join(f"CASE WHEN ({a} > r) <> ({c} > r) AND c < ({d} - {b}) * (r - {a}) / ({c} - {a}) + {b} THEN 1 ELSE 0 END" for (a, b), (c, d) in edges) + ") % 2 = 1"


@query("roi_polygon_crop", f"WITH {PX} SELECT image_id, r, c, CASE WHEN {polygon_sql(TRIANGLE)} THEN v ELSE 0.0 END AS v FROM px WHERE r >= 1 AND r <= 6 AND c >= 1 AND c <= 6")
def roi_polygon_crop(spark, d):
    """Pixels in the box of a triangle, zero outside the triangle (even-odd rule)."""
    from rasterloom.functions.geometry import point_in_polygon

    inside = point_in_polygon(F.col("r"), F.col("c"), TRIANGLE)
    box = F.expr("r >= 1 and r <= 6 and c >= 1 and c <= 6")
    return _px(images(spark, d), None).where(box).withColumn("v", F.when(inside, F.col("v")).otherwise(0.0))


@query("roi_mask_crop", f"WITH {PX}, m AS (SELECT *, v > {LEVEL} AS f FROM px), b AS (SELECT image_id, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM m WHERE f GROUP BY image_id) SELECT m.image_id, CAST(r - r0 AS INTEGER) AS r, CAST(c - c0 AS INTEGER) AS c, CASE WHEN f THEN v ELSE 0.0 END AS v FROM m JOIN b USING (image_id) WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1")
def roi_mask_crop(spark, d):
    """Tight crop around a mask's pixels, zero outside the mask; an empty mask gives nothing."""

    def box(ids, x):
        cols = {k: [] for k in ("image_id", "x_min", "y_min", "x_max", "y_max")}
        for i, one in zip(ids, x):
            r, c = np.nonzero(one > LEVEL)
            if len(r):
                for k, v in zip(cols, (i, c.min(), r.min(), c.max() + 1, r.max() + 1)):
                    cols[k].append(v)
        return {k: np.array(v, np.int64 if k == "image_id" else np.int32) for k, v in cols.items()}

    i = images(spark, d)
    kept = i.withColumn("pixels", F.transform("pixels", lambda v: F.when(v > LEVEL, v).otherwise(0.0)))
    return _px(R.crop(kept.join(describe_images(i, box, "image_id bigint, x_min int, y_min int, x_max int, y_max int"), "image_id")), None)


@query("collate_pad", f"""WITH {PX}, s AS (SELECT image_id, 4 + image_id % 5 AS h, 3 + image_id % 6 AS w, image_id // 8 AS batch FROM (SELECT DISTINCT image_id FROM px)),
 b AS (SELECT batch, max(h) AS bh, max(w) AS bw FROM s GROUP BY batch)
 SELECT s.image_id, CAST(bh AS INTEGER) AS h, CAST(bw AS INTEGER) AS w, sum(CASE WHEN r < s.h AND c < s.w THEN v ELSE 0 END) AS pixel_sum, count(*) AS n
 FROM s JOIN b USING (batch) JOIN px p ON p.image_id = s.image_id AND p.r < bh AND p.c < bw GROUP BY s.image_id, bh, bw""")
def collate_pad(spark, d):
    """Images of different sizes in batches of 8, zero-padded right and below to the batch's largest."""
    h, w = 4 + F.pmod("image_id", F.lit(5)), 3 + F.pmod("image_id", F.lit(6))
    line = lambda i: F.slice("pixels", (i * 8 + 1).cast("int"), w.cast("int"))
    small = images(spark, d).select("image_id", h.cast("int").alias("h"), w.cast("int").alias("w"), F.flatten(F.transform(F.sequence(F.lit(0), h.cast("int") - 1), line)).alias("pixels"))
    return collate(small, F.floor(F.col("image_id") / 8)).select("image_id", "h", "w", _total(F.col("pixels")).alias("pixel_sum"), F.size("pixels").cast("bigint").alias("n"))


def _grid(h: int, w: int) -> str:
    return f"(SELECT CAST(a.x AS INTEGER) AS r, CAST(b.x AS INTEGER) AS c FROM (SELECT unnest(range({h})) AS x) a, (SELECT unnest(range({w})) AS x) b)"


_BIL = f"""WITH {PX}, g AS (SELECT r, c, CAST(least(floor(r * 7.0 / 4), 7) AS INTEGER) AS r0, CAST(least(floor(c * 7.0 / 5), 7) AS INTEGER) AS c0, r * 7.0 / 4 AS y, c * 7.0 / 5 AS x FROM {_grid(5, 6)})
 SELECT p.image_id, g.r, g.c, round(sum(p.v * (CASE WHEN p.r = r0 THEN 1 - (y - r0) ELSE 0 END + CASE WHEN p.r = least(r0 + 1, 7) THEN y - r0 ELSE 0 END) * (CASE WHEN p.c = c0 THEN 1 - (x - c0) ELSE 0 END + CASE WHEN p.c = least(c0 + 1, 7) THEN x - c0 ELSE 0 END)), 4) AS v
 FROM g JOIN px p ON p.r BETWEEN r0 AND r0 + 1 AND p.c BETWEEN c0 AND c0 + 1 GROUP BY p.image_id, g.r, g.c"""
_kernel("resize_bilinear", lambda x: K.resize_bilinear(x, 5, 6), _BIL)
_kernel("resize_nearest", lambda x: K.resize_nearest(x, 5, 12), f"WITH {PX} SELECT p.image_id, g.r, g.c, p.v FROM {_grid(5, 12)} g JOIN px p ON p.r = g.r * 8 // 5 AND p.c = g.c * 8 // 12")


# -- frequency -----------------------------------------------------------------------------------------

_DFT = f"""f1 AS (SELECT image_id, r, k.x AS l, sum(v * cos(2 * pi() * k.x * c / 8)) AS re, -sum(v * sin(2 * pi() * k.x * c / 8)) AS im FROM px CROSS JOIN (SELECT unnest(range(8)) AS x) k GROUP BY image_id, r, k.x),
 f2 AS (SELECT image_id, CAST(k.x AS INTEGER) AS r, CAST(l AS INTEGER) AS c, sum(re * cos(2 * pi() * k.x * r / 8) + im * sin(2 * pi() * k.x * r / 8)) AS re, sum(im * cos(2 * pi() * k.x * r / 8) - re * sin(2 * pi() * k.x * r / 8)) AS im FROM f1 CROSS JOIN (SELECT unnest(range(8)) AS x) k GROUP BY image_id, k.x, l)"""
_kernel("fft_mag", lambda x: np.abs(np.fft.fft2(x)), f"WITH {PX}, {_DFT} SELECT image_id, r, c, round(sqrt(re * re + im * im), 4) AS v FROM f2")
_kernel("fft_roundtrip", lambda x: np.fft.ifft2(np.fft.fft2(x)).real, f"WITH {PX} SELECT image_id, r, c, v FROM px")
_BW = "1.0 / (1.0 + pow((d * d - 441.0) / (CASE WHEN d = 0 THEN 1e-6 ELSE 256.0 * d END), 6))"


@query("butterworth_kernel", f"SELECT r, c, round({_BW}, 6) AS v FROM (SELECT r, c, sqrt(pow(c - 4.0, 2) + pow(r - 4.0, 2)) AS d FROM {_grid(8, 8)})")
def butterworth_kernel(spark, d):
    """The 8 x 8 transfer function, generated by expressions."""
    g = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("r"), F.pmod("id", F.lit(8)).cast("int").alias("c"))
    dist = F.sqrt(F.pow(F.col("c") - 4.0, F.lit(2.0)) + F.pow(F.col("r") - 4.0, F.lit(2.0)))
    v = 1.0 / (1.0 + F.pow((dist * dist - 441.0) / F.when(dist == 0, 1e-6).otherwise(dist * 256.0), F.lit(6.0)))
    return g.select("r", "c", F.round(v, 6).alias("v"))


_INV = """i1 AS (SELECT image_id, r, k.x AS x, sum(re * cos(2 * pi() * k.x * c / 8) - im * sin(2 * pi() * k.x * c / 8)) AS re, sum(im * cos(2 * pi() * k.x * c / 8) + re * sin(2 * pi() * k.x * c / 8)) AS im FROM fb CROSS JOIN (SELECT unnest(range(8)) AS x) k GROUP BY image_id, r, k.x),
 i2 AS (SELECT image_id, CAST(k.x AS INTEGER) AS r, CAST(i1.x AS INTEGER) AS c, sum(re * cos(2 * pi() * k.x * r / 8) - im * sin(2 * pi() * k.x * r / 8)) / 64 AS re FROM i1 CROSS JOIN (SELECT unnest(range(8)) AS x) k GROUP BY image_id, k.x, i1.x)"""
_kernel(
    "butterworth_apply",
    lambda x: np.abs(np.fft.ifft2(np.fft.fft2(x) * K.butterworth(8, 8)).real),
    f"WITH {PX}, {_DFT}, fb AS (SELECT image_id, r, c, re * w AS re, im * w AS im FROM (SELECT *, {_BW} AS w FROM (SELECT *, sqrt(pow(c - 4.0, 2) + pow(r - 4.0, 2)) AS d FROM f2))), {_INV} SELECT image_id, r, c, round(abs(re), 4) AS v FROM i2",
)

# -- clustering ------------------------------------------------------------------------------------------


def _stats(df: DataFrame) -> DataFrame:
    return df.withColumn("centroid", F.round("centroid", 3))


def kmeans_sql(steps: int) -> str:
    parts = ["c0 AS (SELECT image_id, 0 AS k, min(v) AS m FROM px GROUP BY image_id UNION ALL SELECT image_id, 1, max(v) FROM px GROUP BY image_id)"]
    for i in range(steps):
        parts.append(f"a{i} AS (SELECT p.image_id, p.r, p.c, p.v, CASE WHEN pow(p.v - x.m, 2) <= pow(p.v - y.m, 2) THEN 0 ELSE 1 END AS k FROM px p JOIN c{i} x ON x.image_id = p.image_id AND x.k = 0 JOIN c{i} y ON y.image_id = p.image_id AND y.k = 1)")
        parts.append(f"c{i + 1} AS (SELECT c.image_id, c.k, coalesce(avg(a.v), any_value(c.m)) AS m, count(a.v) AS n FROM c{i} c LEFT JOIN a{i} a ON a.image_id = c.image_id AND a.k = c.k GROUP BY c.image_id, c.k)")
    return ", ".join(parts)


@query("kmeans_4it", f"WITH {PX}, {kmeans_sql(4)} SELECT image_id, CAST(k AS INTEGER) AS cluster, round(m, 3) AS centroid, n AS pixels, m = max(m) OVER (PARTITION BY image_id) AS is_mc FROM c4")
def kmeans_4it(spark, d):
    return _stats(M.kmeans_statistics(images(spark, d), iterations=4, tol=0.0, seed=None))


@query("cluster_stats", f"WITH {PX}, {kmeans_sql(6)} SELECT image_id, CAST(sum(n) AS BIGINT) AS pixels, count(*) AS clusters, round(max(m), 3) AS brightest FROM c6 GROUP BY image_id")
def cluster_stats(spark, d):
    s = M.kmeans_statistics(images(spark, d), iterations=6, tol=0.0, seed=None)
    # the statistics of an image come from one row, and so from one task: the aggregate's shuffle is 4 numbers an image
    return s.groupBy("image_id").agg(F.sum("pixels").alias("pixels"), F.count("*").alias("clusters"), F.round(F.max("centroid"), 3).alias("brightest"))


def _memb(src: str, out: str) -> str:
    return f"{out} AS (SELECT image_id, r, c, v, k, iv / sum(iv) OVER (PARTITION BY image_id, r, c) AS u, d2 FROM (SELECT p.image_id, p.r, p.c, p.v, x.k, pow(p.v - x.m, 2) AS d2, 1.0 / (pow(p.v - x.m, 2) + 1e-10) AS iv FROM px p JOIN {src} x USING (image_id)))"


def fcm_sql(steps: int) -> str:
    cent = lambda src, out: f"{out} AS (SELECT image_id, k, sum(u * u * v) / (sum(u * u) + 1e-10) AS m FROM {src} GROUP BY image_id, k)"
    parts = ["s0 AS (SELECT image_id, 0 AS k, min(v) AS m FROM px GROUP BY image_id UNION ALL SELECT image_id, 1, max(v) FROM px GROUP BY image_id)", _memb("s0", "u0"), cent("u0", "v0")]
    for i in range(steps):
        parts += [_memb(f"v{i}", f"u{i + 1}"), cent(f"u{i + 1}", f"v{i + 1}")]
    return ", ".join(parts)


@query("fcm_3it", f"WITH {PX}, {fcm_sql(3)} SELECT image_id, CAST(k AS INTEGER) AS cluster, round(m, 3) AS centroid FROM v3")
def fcm_3it(spark, d):
    return _stats(M.fcm_statistics(images(spark, d), iterations=3, tol=0.0, seed=None)).select("image_id", "cluster", "centroid")


def pfcm_sql(steps: int) -> str:
    typ = lambda src, out: f"{out} AS (SELECT image_id, r, c, v, k, u, 1.0 / (1.0 + 4.0 / (g + 1e-10) * d2 + 1e-10) AS t FROM (SELECT *, sum(u * u * d2) OVER w / (sum(u * u) OVER w + 1e-10) AS g FROM {src} WINDOW w AS (PARTITION BY image_id, k)))"
    parts = [fcm_sql(3), "du AS (SELECT u3.image_id, r, c, v, u3.k, u, pow(v - m, 2) AS d2 FROM u3 JOIN v3 USING (image_id, k))", typ("du", "t0")]
    for i in range(steps):
        parts += [f"w{i} AS (SELECT image_id, k, sum((u * u + 4.0 * t * t) * v) / (sum(u * u + 4.0 * t * t) + 1e-10) AS m FROM t{i} GROUP BY image_id, k)", _memb(f"w{i}", f"q{i}"), typ(f"q{i}", f"t{i + 1}")]
    return ", ".join(parts)


@query("pfcm_3it", f"WITH {PX}, {pfcm_sql(3)} SELECT image_id, CAST(k AS INTEGER) AS cluster, round(m, 3) AS centroid FROM w2")
def pfcm_3it(spark, d):
    return _stats(M.pfcm_statistics(images(spark, d), iterations=3, fcm_iterations=3, tol=0.0, seed=None)).select("image_id", "cluster", "centroid")


def _md5_uniform(seed: str, i: int) -> str:
    return f"(CAST('0x' || md5(CAST({seed} AS VARCHAR) || ':{i}')[1:8] AS BIGINT) / 4294967296.0)"


def kmeans_run(src: str, keys: str, seed: str | None, out: str = "km") -> str:
    """CTEs: two-means of the lists z of ``src`` (keys, z) until the centroids rest; ``out`` has keys, z, a, b (centroids) and za (pixels of the first), of the last step.

    ``seed``: an expression for starts by squared distance, None for the extremes.
    """
    first, again = _md5_uniform(seed, 0) if seed else "", _md5_uniform(seed, 1) if seed else ""
    start = (
        f"SELECT {keys}, z, list_min(z) AS a, list_max(z) AS b FROM {src}"
        if seed is None
        else f"SELECT {keys}, z, a, CASE WHEN t[len(z)] > 0 THEN z[len(list_filter(t, lambda x: x <= {again} * t[len(z)])) + 1] ELSE z[1 + CAST(floor({again} * len(z)) AS BIGINT)] END AS b FROM (SELECT *, list_transform(range(1, len(z) + 1), lambda i: list_sum(d[1:i])) AS t FROM (SELECT *, list_transform(z, lambda x: (x - a) * (x - a)) AS d FROM (SELECT *, z[1 + CAST(floor({first} * len(z)) AS BIGINT)] AS a FROM {src})))"
    )
    near = "(x - a) * (x - a) <= (x - b) * (x - b)"
    return f"""{out}_0 AS ({start}),
 {out}_r({keys}, z, a, b, za, i, moved) AS (SELECT {keys}, z, CAST(a AS DOUBLE), CAST(b AS DOUBLE), CAST([] AS DOUBLE[]), 0, 1e300 FROM {out}_0 UNION ALL
  SELECT {keys}, z, na, nb, za, i + 1, sqrt((na - a) * (na - a) + (nb - b) * (nb - b)) FROM (SELECT {keys}, z, a, b, i, l AS za, coalesce(list_sum(l) / len(l), a) AS na, coalesce(list_sum(m) / len(m), b) AS nb FROM (SELECT *, list_filter(z, lambda x: {near}) AS l, list_filter(z, lambda x: NOT ({near})) AS m FROM {out}_r WHERE i < 100 AND moved >= 1e-4))),
 {out} AS (SELECT * FROM {out}_r QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY i DESC) = 1)"""


_Z = "zs AS (SELECT image_id, list(v ORDER BY r, c) AS z FROM px GROUP BY image_id)"
_IMAGE_SEED = "42 * 1000003 + image_id"


@query("kmeans_full", f"WITH RECURSIVE {PX}, {_Z}, {kmeans_run('zs', 'image_id', _IMAGE_SEED)} SELECT image_id, CAST(k AS INTEGER) AS cluster, round(CASE k WHEN 0 THEN a ELSE b END, 3) AS centroid, CASE k WHEN 0 THEN len(za) ELSE 64 - len(za) END AS pixels, CASE k WHEN 0 THEN a >= b ELSE b > a END AS is_mc FROM km, (SELECT unnest(range(2)) AS k)")
def kmeans_full(spark, d):
    """Seeded k-means++ starts, at most 100 steps."""
    return _stats(M.kmeans_statistics(images(spark, d)))


def fcm_run(seeded: bool, keep: str = "fc") -> str:
    """CTEs: fuzzy two-means of zs (image_id, z) until the memberships rest: ``fc`` (image_id, z, u, w: memberships, a, b: centroids)."""
    salt = f"CAST('0x' || md5(CAST({_IMAGE_SEED} AS VARCHAR) || ':0')[1:8] AS BIGINT)"
    raw = lambda j: f"list_transform(range(1, 65), lambda i: (((i - 1) * 2 + {j + 1}) * 2654435761 + s) % 4294967296 / 4294967296.0)"
    inv = lambda m: f"list_transform(z, lambda x: 1.0 / ((x - {m}) * (x - {m}) + 1e-10))"
    start = f"SELECT image_id, z, {raw(0)} AS p, {raw(1)} AS q FROM (SELECT *, {salt} AS s FROM zs)" if seeded else f"SELECT image_id, z, {inv('list_min(z)')} AS p, {inv('list_max(z)')} AS q FROM zs"
    share = lambda x, y: f"list_transform(range(1, 65), lambda i: {x}[i] / ({x}[i] + {y}[i]))"
    mean = lambda u: f"list_sum(list_transform(range(1, 65), lambda i: {u}[i] * {u}[i] * z[i])) / (list_sum(list_transform({u}, lambda x: x * x)) + 1e-10)"
    return f"""f0 AS (SELECT image_id, z, {share('p', 'q')} AS u, {share('q', 'p')} AS w FROM ({start})),
 fr(image_id, z, u, w, a, b, i, moved) AS (SELECT image_id, z, u, w, {mean('u')}, {mean('w')}, 0, 1e300 FROM f0 UNION ALL
  SELECT image_id, z, nu, nw, {mean('nu')}, {mean('nw')}, i + 1, sqrt(list_sum(list_transform(range(1, 65), lambda i: (nu[i] - u[i]) * (nu[i] - u[i]) + (nw[i] - w[i]) * (nw[i] - w[i]))))
  FROM (SELECT *, {share('p', 'q')} AS nu, {share('q', 'p')} AS nw FROM (SELECT *, {inv('a')} AS p, {inv('b')} AS q FROM fr WHERE i < 100 AND moved >= 1e-3))),
 {keep} AS (SELECT * FROM fr QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY i DESC) = 1)"""


_FUZZY = "CAST(k AS INTEGER) AS cluster, round(CASE k WHEN 0 THEN a ELSE b END, 3) AS centroid, len(list_filter(range(1, 65), lambda i: CASE k WHEN 0 THEN u[i] >= w[i] ELSE u[i] < w[i] END)) AS pixels, CASE k WHEN 0 THEN a >= b ELSE b > a END AS is_mc"


@query("fcm_full", f"WITH RECURSIVE {PX}, {_Z}, {fcm_run(True)} SELECT image_id, {_FUZZY} FROM fc, (SELECT unnest(range(2)) AS k)")
def fcm_full(spark, d):
    """Seeded memberships, at most 100 steps."""
    return _stats(M.fcm_statistics(images(spark, d)))


def pfcm_run(seeded: bool) -> str:
    """CTEs: possibilistic fuzzy two-means after the fuzzy ones: ``pf`` (image_id, z, u, w, s, t: typicalities, a, b)."""
    sq = lambda m: f"list_transform(z, lambda x: (x - {m}) * (x - {m}))"
    typ = lambda d, u: f"list_transform({d}, lambda x: 1.0 / (1.0 + 4.0 / (list_sum(list_transform(range(1, 65), lambda i: {u}[i] * {u}[i] * {d}[i])) / (list_sum(list_transform({u}, lambda y: y * y)) + 1e-10) + 1e-10) * x + 1e-10))"
    mean = lambda u, t: f"list_sum(list_transform(range(1, 65), lambda i: ({u}[i] * {u}[i] + 4.0 * {t}[i] * {t}[i]) * z[i])) / (list_sum(list_transform(range(1, 65), lambda i: {u}[i] * {u}[i] + 4.0 * {t}[i] * {t}[i])) + 1e-10)"
    share = lambda x, y: f"list_transform(range(1, 65), lambda i: (1.0 / ({x}[i] + 1e-10)) / (1.0 / ({x}[i] + 1e-10) + 1.0 / ({y}[i] + 1e-10)))"
    return f"""{fcm_run(seeded)},
 pr(image_id, z, u, w, s, t, a, b, i, moved) AS (SELECT image_id, z, u, w, {typ('da', 'u')}, {typ('db', 'w')}, a, b, 0, 1e300 FROM (SELECT *, {sq('a')} AS da, {sq('b')} AS db FROM fc) UNION ALL
  SELECT image_id, z, nu, nw, ns, nt, a, b, i + 1, sqrt(list_sum(list_transform(range(1, 65), lambda i: (ns[i] - s[i]) * (ns[i] - s[i]) + (nt[i] - t[i]) * (nt[i] - t[i]))))
  FROM (SELECT *, {typ('da', 'nu')} AS ns, {typ('db', 'nw')} AS nt FROM (SELECT *, {share('da', 'db')} AS nu, {share('db', 'da')} AS nw FROM (SELECT image_id, z, s, t, i, a, b, {sq('a')} AS da, {sq('b')} AS db FROM
   (SELECT image_id, z, s, t, i, {mean('u', 's')} AS a, {mean('w', 't')} AS b FROM pr WHERE i < 100 AND moved >= 1e-3))))),
 pf AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY i DESC) = 1)"""


@query("pfcm_full", f"WITH RECURSIVE {PX}, {_Z}, {pfcm_run(True)} SELECT image_id, {_FUZZY} FROM pf, (SELECT unnest(range(2)) AS k)")
def pfcm_full(spark, d):
    return _stats(M.pfcm_statistics(images(spark, d)))


# -- Gabor -------------------------------------------------------------------------------------------------

_BANK = """bank AS (SELECT CAST(m * 6 + n AS INTEGER) AS kernel_id, dr, dc, exp(-(dc * dc + dr * dr) / (2 * s * s)) * cos(2 * pi() * f * (dc * sin(n * pi() / 6) + dr * cos(n * pi() / 6))) AS w
  FROM (SELECT m, f, 1.0 / (2 * f) AS s, CAST(ceil(3.0 / f) AS INTEGER) + 1 - CAST(ceil(3.0 / f) AS INTEGER) % 2 AS k FROM (SELECT m, 0.25 / pow(sqrt(2.0), m) AS f FROM (SELECT unnest(range(3)) AS m))), (SELECT unnest(range(6)) AS n),
  (SELECT unnest(range(-12, 13)) AS dr), (SELECT unnest(range(-12, 13)) AS dc) WHERE abs(dr) <= k // 2 AND abs(dc) <= k // 2),
 op AS (SELECT kernel_id, r, c, least(greatest(r + dr, 0), 7) AS r2, least(greatest(c + dc, 0), 7) AS c2, sum(w) AS w FROM bank, (SELECT unnest(range(8)) AS r), (SELECT unnest(range(8)) AS c) GROUP BY ALL),
 g AS (SELECT image_id, kernel_id, op.r, op.c, sum(v * w) AS v FROM px JOIN op ON px.r = op.r2 AND px.c = op.c2 GROUP BY image_id, kernel_id, op.r, op.c)"""


@query("gabor_response", f"WITH {PX}, {_BANK} SELECT image_id, kernel_id, round(avg(abs(v)), 4) AS response FROM g GROUP BY image_id, kernel_id")
def gabor_response(spark, d):
    """Mean absolute response to every kernel of the whole bank, three scales and six orientations."""
    return M.gabor_means(images(spark, d), 3, 6).withColumn("response", F.round("response", 4))


_QUANT = "SELECT image_id, kernel_id, r, c, CASE WHEN hi > lo THEN CAST(floor(round((v - lo) / (hi - lo) * 255.0, 6)) AS INTEGER) ELSE 0 END AS q FROM (SELECT image_id, kernel_id, r, c, abs(v) AS v, min(abs(v)) OVER w AS lo, max(abs(v)) OVER w AS hi FROM g WINDOW w AS (PARTITION BY image_id, kernel_id))"


@query("gabor_mi", f"""WITH {PX}, {_BANK}, q AS ({_QUANT}),
 j AS (SELECT a.image_id, a.kernel_id, a.q AS x, b.q AS y FROM q a JOIN q b ON b.image_id = a.image_id + 1 AND a.kernel_id = b.kernel_id AND a.r = b.r AND a.c = b.c),
 n AS (SELECT *, count(*) OVER (PARTITION BY image_id, kernel_id, x, y) / 64.0 AS pxy, count(*) OVER (PARTITION BY image_id, kernel_id, x) / 64.0 AS p, count(*) OVER (PARTITION BY image_id, kernel_id, y) / 64.0 AS s FROM j)
 SELECT image_id, round(sum(log2(pxy / greatest(p * s, 1e-12))) / 64.0, 4) AS information FROM n GROUP BY image_id""")
def gabor_mi(spark, d):
    return M.gabor_information(M.neighbours(images(spark, d)), 3, 6).withColumn("information", F.round("information", 4))


query("grail_window")(lambda spark, d: M.grail_windows(images(spark, d)))

# -- pipelines ------------------------------------------------------------------------------------------------

_BASE = PX.replace("px AS (", "p0 AS (", 1)


def otsu_above(src: str, out: str) -> str:
    """CTEs: ``out`` with 1 above the Otsu threshold of ``src``."""
    body = OTSU.split(",\n ext AS", 1)[1]
    names = ("ext", "cfg", "binned", "hist", "cum", "best", "otsu")
    body = "ext AS" + body
    for n in names:
        body = re.sub(rf"\b{n}\b", f"{n}_{out}", body)
    return re.sub(r"\bpx\b", src, body) + f", {out} AS (SELECT image_id, r, c, CASE WHEN v > threshold THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM {src} JOIN otsu_{out} USING (image_id))"


_TWICE = f"WITH {_BASE}, ga AS ({gaussian_sql('p0', 2.0)}), gb AS ({gaussian_sql('ga', 2.0)}), {otsu_above('gb', 'ob')} SELECT image_id, r, c, v FROM ob"
query("custom_gauss_otsu", _TWICE)(lambda spark, d: _px(L.Pipeline(lambda x: K.gaussian(x, 2.0), lambda x: K.gaussian(x, 2.0), K.otsu)(images(spark, d))))


def febds_sql(first: str, binary: str) -> str:
    """The steps after the edge boost ``e`` (CTEs ``first``): median, gamma, binarisation, closing, hole filling."""
    return f"""WITH RECURSIVE {_BASE}, {first}, md AS ({stencil('e', 2, 'reflect', 'median({n})')}), gm AS (SELECT image_id, r, c, pow(v / 4095.0, 1.25) * 4095.0 AS v FROM md), {binary},
 dl AS ({stencil('bi', 3, 'zero', 'max({n})')}), cl AS ({stencil('dl', 3, 'zero', 'min({n})')}), {components_sql('v = 0', 'cl')},
 rim AS (SELECT DISTINCT image_id, root FROM comp WHERE r IN (0, 7) OR c IN (0, 7)), out_ AS (SELECT image_id, r, c FROM comp JOIN rim USING (image_id, root))
 SELECT p.image_id, p.r, p.c, CASE WHEN o.r IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM cl p LEFT JOIN out_ o ON p.image_id = o.image_id AND p.r = o.r AND p.c = o.c"""


_VARIANCE = f"lv AS ({stencil('gm', 2, 'reflect', 'var_samp({n})')}), gv AS (SELECT image_id, var_samp(v) AS g FROM gm GROUP BY image_id), bi AS (SELECT image_id, r, c, CASE WHEN v * v >= g * g THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM lv JOIN gv USING (image_id))"
_DOG = f"ga AS ({gaussian_sql('p0', 1.7)}), gb AS ({gaussian_sql('p0', 2.0)}), e AS (SELECT image_id, r, c, abs(ga.v - gb.v) AS v FROM ga JOIN gb USING (image_id, r, c))"
_LOG = f"ga AS ({gaussian_sql('p0', 2.0)}), gl AS ({stencil('ga', 1, 'reflect', 'sum({n} * (' + kernel_case(K.LAPLACE.tolist()) + '))')}), e AS (SELECT image_id, r, c, abs(v) AS v FROM gl)"
_FFT = f"{re.sub(r'\bpx\b', 'p0', _DFT)}, fb AS (SELECT image_id, r, c, re * w AS re, im * w AS im FROM (SELECT *, {_BW} AS w FROM (SELECT *, sqrt(pow(c - 4.0, 2) + pow(r - 4.0, 2)) AS d FROM f2))), {_INV}, e AS (SELECT image_id, r, c, abs(re) AS v FROM i2)"
query("febds_dog", febds_sql(_DOG, otsu_above("gm", "bi")))(lambda spark, d: _px(L.Febds("dog")(images(spark, d))))
query("febds_log", febds_sql(_LOG, otsu_above("gm", "bi")))(lambda spark, d: _px(L.Febds("log")(images(spark, d))))
query("febds_fft", febds_sql(_FFT, _VARIANCE))(lambda spark, d: _px(L.Febds("fft")(images(spark, d))))

# The first 64 numbers of NumPy's generator of seed 42; an 8 x 8 image has no more maxima.
_DRAWN = ", ".join(f"({i + 1}, {v!r}::DOUBLE)" for i, v in enumerate(np.random.RandomState(42).random(64).tolist()))
_SOBEL = "sqrt((pow(sum({n} * o.dr * (2 - abs(o.dc))) / 8, 2) + pow(sum({n} * o.dc * (2 - abs(o.dr))) / 8, 2)) / 2)"


@query("sbrg", f"""WITH RECURSIVE {PX}, drawn(k, u) AS (VALUES {_DRAWN}), flat AS (SELECT image_id FROM px GROUP BY image_id HAVING min(v) = max(v)),
 low(image_id, r, c, v) AS (SELECT DISTINCT p.image_id, p.r, p.c, p.v FROM px p JOIN px q ON {_NEAR8} WHERE q.v > p.v UNION SELECT p.image_id, p.r, p.c, p.v FROM px p JOIN low q ON {_NEAR8} AND p.v = q.v),
 peak AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY r, c) AS k FROM (SELECT px.* FROM px ANTI JOIN low USING (image_id, r, c)) WHERE image_id NOT IN (SELECT image_id FROM flat)),
 gap AS (SELECT image_id, coalesce(min(g) FILTER (WHERE g > 0), 1e-6) AS gap FROM (SELECT image_id, v - lag(v) OVER (PARTITION BY image_id ORDER BY v) AS g FROM peak) GROUP BY image_id),
 lifted AS (SELECT p.image_id, p.r, p.c, p.v, p.v + u * gap AS t FROM peak p JOIN gap USING (image_id) JOIN drawn USING (k)),
 lead AS (SELECT * FROM lifted p WHERE t > 0 AND NOT EXISTS (SELECT 1 FROM lifted q WHERE {_NEAR8} AND q.t > p.t)),
 seed AS (SELECT px.image_id, coalesce(any_value(l.m), any_value(pk.m), avg(px.v)) AS s FROM px LEFT JOIN (SELECT image_id, avg(v) AS m FROM lead GROUP BY image_id) l USING (image_id) LEFT JOIN (SELECT image_id, avg(v) AS m FROM peak GROUP BY image_id) pk USING (image_id) GROUP BY px.image_id),
 grown AS (SELECT image_id, r, c, CASE WHEN v >= s THEN 1.0 ELSE 0.0 END AS v FROM px JOIN seed USING (image_id)), so AS ({stencil('grown', 1, 'symmetric', _SOBEL)}), ed AS (SELECT image_id, r, c, CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END AS v FROM so),
 dl AS ({stencil('ed', 2, 'zero', 'max({n})')}), er AS ({stencil('dl', 2, 'zero', 'min({n})')}) SELECT image_id, r, c, CASE WHEN v > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM er""")
def sbrg(spark, d):
    return _px(L.Sbrg()(images(spark, d)))


_ROI = f"""WITH RECURSIVE {_BASE}, roi AS (SELECT image_id, r - 1 AS r, c - 1 AS c, least(greatest(v / 4095.0, 0), 1) AS v FROM p0 WHERE r BETWEEN 1 AND 6 AND c BETWEEN 1 AND 6),
 e AS ({stencil('roi', 1, 'zero', 'min({n})')}), o AS ({stencil('e', 1, 'zero', 'max({n})')}), px AS (SELECT image_id, r, c, greatest(roi.v - o.v, 0) AS v FROM roi JOIN o USING (image_id, r, c)), {_Z}, {kmeans_run('zs', 'image_id', None)}"""
#: 1 in the brightest cluster; a place's cluster is that of the last step's pixels, by value.
_BRIGHT = "CASE WHEN CASE WHEN list_contains(za, v) THEN a ELSE b END = greatest(a, b) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
query("roi_top_hat_kmeans", _ROI + f" SELECT image_id, r, c, {_BRIGHT} AS v FROM px JOIN km USING (image_id)")(
    lambda spark, d: _px(L.Pipeline(lambda x: np.clip(x[:, 1:7, 1:7] / 4095.0, 0, 1), lambda x: K.white_top_hat(x, 1), L.KMeans(seed=None).kernel)(images(spark, d)))
)
query("pfcm_mask", f"""WITH RECURSIVE {PX}, {_Z}, {pfcm_run(False)} SELECT image_id, r, c, CASE WHEN greatest(s[r * 8 + c + 1], t[r * 8 + c + 1]) < 0.04 AND NOT (CASE WHEN u[r * 8 + c + 1] >= w[r * 8 + c + 1] THEN a <= b ELSE b < a END) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM px JOIN pf USING (image_id)""")(
    lambda spark, d: _px(L.Pfcm(seed=None)(images(spark, d)))
)
_E4 = stencil("px", 4, "zero", "min({n})")
query("top_hat_r4", f"WITH {PX}, e AS ({_E4}), o AS ({stencil('e', 4, 'zero', 'max({n})')}) SELECT image_id, r, c, greatest(px.v - o.v, 0) AS v FROM px JOIN o USING (image_id, r, c)")(lambda spark, d: _px(L.TopHat(4)(images(spark, d))))
_TILED = f"""WITH RECURSIVE {PX}, tile AS (SELECT image_id * 4 + r // 4 * 2 + c // 4 AS tile_id, image_id, r, c, v FROM px), zs AS (SELECT tile_id, list(v ORDER BY r, c) AS z FROM tile GROUP BY tile_id), {kmeans_run('zs', 'tile_id', '42 * 1000003')}"""
query("patch_kmeans", _TILED + f" SELECT image_id, r, c, CASE WHEN list_stddev_pop(z) < 1e-6 THEN v ELSE {_BRIGHT} END AS v FROM tile JOIN km USING (tile_id)")(lambda spark, d: _px(L.per_patch_kmeans(images(spark, d), 4)))
query("kmeans_quantized", f"WITH RECURSIVE {PX}, {_Z}, {kmeans_run('zs', 'image_id', '42 * 1000003')} SELECT image_id, r, c, round(CASE WHEN list_contains(za, v) THEN a ELSE b END / greatest(a, b), 4) AS v FROM px JOIN km USING (image_id)")(
    lambda spark, d: _px(L.KMeans(output="quantized")(images(spark, d)))
)
query("fuzzy_labels", f"WITH RECURSIVE {PX}, {_Z}, {fcm_run(False)} SELECT image_id, r, c, CASE WHEN u[r * 8 + c + 1] >= w[r * 8 + c + 1] THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS v FROM px JOIN fc USING (image_id)")(
    lambda spark, d: _px(L.Fcm(seed=None, output="labels")(images(spark, d)))
)


@query("locate_crop", "SELECT g AS image_id, CAST(g * 3 % 20 AS INTEGER) AS x0, CAST(g * 5 % 20 AS INTEGER) AS y0, CAST(g * 3 % 20 + 12 AS INTEGER) AS x1, CAST(g * 5 % 20 + 12 AS INTEGER) AS y1 FROM (SELECT DISTINCT vec_id // 16 AS g FROM embeddings WHERE len(embedding) = 64) WHERE g IN (SELECT vec_id // 16 FROM embeddings WHERE len(embedding) = 64 GROUP BY 1 HAVING count(*) = 16)")
def locate_crop(spark, d):
    """A 12 x 12 crop of every whole 32 x 32 mosaic is found in it again."""
    i = images(spark, d)
    whole = i.groupBy(F.floor(F.col("image_id") / 16).cast("bigint").alias("image_id")).count().where("count = 16").select("image_id")
    m = mosaic(i, 4).join(whole, "image_id")
    x, y = (F.pmod(F.col("image_id") * k, F.lit(20)).cast("int") for k in (3, 5))
    part = R.crop(m.withColumn("x_min", x).withColumn("y_min", y).withColumn("x_max", x + 12).withColumn("y_max", y + 12)).select("image_id", F.col("h").alias("ch"), F.col("w").alias("cw"), F.col("pixels").alias("crop"))
    return R.located(m.join(part, "image_id"))
