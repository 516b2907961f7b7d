"""Measures of images: thresholds, entropies, variances, components, clusters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.operators import kernels as K
from rasterloom.operators.raster import describe_images, map_pairs, spread


def otsu_thresholds(images: DataFrame) -> DataFrame:
    """image_id, bin, threshold, foreground (pixels above it)."""

    def run(ids, x):
        got = [K.otsu_of(i) for i in x]
        t = np.array([g[1] for g in got])
        return {"image_id": ids, "bin": np.array([g[0] for g in got], np.int32), "threshold": t, "foreground": (x > t[:, None, None]).sum(axis=(1, 2)).astype(np.int64)}

    return describe_images(images, run, "image_id bigint, bin int, threshold double, foreground bigint")


def _entropy(values: np.ndarray) -> float:
    n = np.unique(values, return_counts=True)[1]
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum()) + 0.0


def _round(x: float, decimals: int) -> float:
    """Half up, whatever the last bit of the sum."""
    return float(np.floor((x + 1e-9) * 10**decimals + 0.5) / 10**decimals)


def _bins(image: np.ndarray) -> tuple[np.ndarray, int]:
    lo, hi = image.min(), image.max()
    n = int(hi - lo + 1)
    if hi <= lo:
        return np.zeros(image.size, int), 1
    return np.minimum(np.floor((image.ravel() - lo) * n / (hi - lo)), n - 1).astype(int), n


def entropies(images: DataFrame, decimals: int = 4) -> DataFrame:
    """Shannon entropy (bits) over max - min + 1 equal bins; images within [0, 1) collapse to one bin and have 0."""
    run = lambda ids, x: {"image_id": ids, "entropy": np.array([_round(_entropy(_bins(i)[0]), decimals) for i in x])}
    return describe_images(images, run, "image_id bigint, entropy double")


def joint_entropy_of(a: np.ndarray, b: np.ndarray, normalized: bool) -> float:
    """Entropy of the pairs' keys a * bins(b) + b within [0, bins(a) * bins(b)); exact if the minima are 0 or ``normalized``."""
    na, nb = int(a.max() - a.min() + 1), int(b.max() - b.min() + 1)
    if normalized:
        a, b = a - a.min(), b - b.min()
    key = a.ravel() * nb + b.ravel()
    key = key[(key >= 0) & (key <= na * nb - 1)]
    return _entropy(np.floor(key)) if len(key) else 0.0


def pair_information(pairs: DataFrame, decimals: int = 4, normalized: bool = True) -> DataFrame:
    """image_id, joint_entropy and mutual_information (of rounded terms) of image pairs."""

    def run(x, y):
        joint = [_round(joint_entropy_of(a, b, normalized), decimals) for a, b in zip(x, y)]
        single = [_round(_entropy(_bins(a)[0]), decimals) + _round(_entropy(_bins(b)[0]), decimals) for a, b in zip(x, y)]
        return {"joint_entropy": np.array(joint), "mutual_information": np.round(np.array(single) - np.array(joint), decimals)}

    return map_pairs(pairs, run, "image_id bigint, joint_entropy double, mutual_information double")


def neighbours(images: DataFrame, step: int = 1) -> DataFrame:
    """Each image with the one ``step`` ids on: image_id, h, w, pixels, other."""
    later = images.select((F.col("image_id") - step).alias("image_id"), F.col("pixels").alias("other"))
    return images.join(later, "image_id")


def global_variances(images: DataFrame) -> DataFrame:
    return describe_images(images, lambda ids, x: {"image_id": ids, "variance": K.variance_of(x)}, "image_id bigint, variance double")


def component_labels(masks: DataFrame, diagonal: bool = False) -> DataFrame:
    """Foreground pixels with their component: image_id, r, c, label (from 1, in raster order)."""

    def run(ids, x):
        lab = K.label(x, diagonal)
        i, r, c = np.nonzero(lab)
        return {"image_id": ids[i], "r": r.astype(np.int32), "c": c.astype(np.int32), "label": lab[i, r, c]}

    return describe_images(masks, run, "image_id bigint, r int, c int, label bigint")


def component_boxes(masks: DataFrame) -> DataFrame:
    """Inclusive bounding boxes and sizes of the components: image_id, label, x_min, y_min, x_max, y_max, n."""

    def run(ids, x):
        lab = K.label(x)
        i, r, c = np.nonzero(lab)
        key = i * (int(lab.max()) + 1) + lab[i, r, c] if len(i) else np.zeros(0, np.int64)
        groups, at, n = np.unique(key, return_inverse=True, return_counts=True)
        low, high = np.full((2, len(groups)), 2**31 - 1), np.full((2, len(groups)), -1)
        for k, v in enumerate((c, r)):
            np.minimum.at(low[k], at, v)
            np.maximum.at(high[k], at, v)
        width = int(lab.max()) + 1
        return {
            "image_id": ids[groups // width], "label": groups % width,
            "x_min": low[0].astype(np.int32), "y_min": low[1].astype(np.int32), "x_max": high[0].astype(np.int32), "y_max": high[1].astype(np.int32), "n": n.astype(np.int64),
        }

    return describe_images(masks, run, "image_id bigint, label bigint, x_min int, y_min int, x_max int, y_max int, n bigint")


def _rows(ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Cluster statistics: id, centroid, pixels and whether it is the brightest."""
    b, k = v.shape
    n = (labels[:, None, :] == np.arange(k)[None, :, None]).sum(axis=2)
    return {
        "image_id": np.repeat(ids, k), "cluster": np.tile(np.arange(k, dtype=np.int32), b), "centroid": v.ravel(), "pixels": n.ravel().astype(np.int64),
        "is_mc": (np.arange(k)[None, :] == v.argmax(axis=1)[:, None]).ravel(),
    }


STATS_DDL = "image_id bigint, cluster int, centroid double, pixels bigint, is_mc boolean"


def _start(z, k, ids, seed):
    return K.spread_centroids(z, k) if seed is None else K.plus_plus_centroids(z, k, [(seed * 1_000_003 + int(i)) % 2**63 for i in ids])


def _membership_start(z, c, ids, seed, m):
    if seed is None:
        return K.memberships((z[:, None, :] - K.spread_centroids(z, c)[:, :, None]) ** 2, m)
    return np.stack([K.random_memberships(z.shape[1], c, (seed * 1_000_003 + int(i)) % 2**63) for i in ids])


def kmeans_statistics(images: DataFrame, k: int = 2, iterations: int = 100, tol: float = 1e-4, seed: int | None = 42) -> DataFrame:
    """Lloyd's k-means per image. ``seed`` None starts from evenly spaced levels, else k-means++ per image."""

    def run(ids, x):
        z = x.reshape(len(x), -1)
        return _rows(ids, *K.kmeans(z, _start(z, k, ids, seed), iterations, tol))

    return describe_images(images, run, STATS_DDL)


def fcm_statistics(images: DataFrame, c: int = 2, m: float = 2.0, iterations: int = 100, tol: float = 1e-3, seed: int | None = 42) -> DataFrame:
    def run(ids, x):
        z = x.reshape(len(x), -1)
        u, v = K.fcm(z, _membership_start(z, c, ids, seed, m), m, iterations, tol)
        return _rows(ids, u.argmax(axis=1), v)

    return describe_images(images, run, STATS_DDL)


def pfcm_statistics(images: DataFrame, c: int = 2, m: float = 2.0, eta: float = 2.0, a: float = 1.0, b: float = 4.0, iterations: int = 100, fcm_iterations: int = 100, tol: float = 1e-3, seed: int | None = 42) -> DataFrame:
    def run(ids, x):
        z = x.reshape(len(x), -1)
        u, v = K.fcm(z, _membership_start(z, c, ids, seed, m), m, fcm_iterations, tol)
        _, u, v = K.pfcm(z, u, v, m, eta, a, b, iterations, tol)
        return _rows(ids, u.argmax(axis=1), v)

    return describe_images(images, run, STATS_DDL)


def gabor_means(images: DataFrame, scales: int, orientations: int) -> DataFrame:
    """Mean absolute response per image and kernel."""

    def run(ids, x):
        bank = K.GaborBank(scales, orientations)
        r = np.concatenate([bank.response(x, k).mean(axis=(1, 2)) for k in range(len(bank))])
        return {"image_id": np.tile(ids, len(bank)), "kernel_id": np.repeat(np.arange(len(bank), dtype=np.int32), len(ids)), "response": r}

    return describe_images(images, run, "image_id bigint, kernel_id int, response double")


def gabor_information(pairs: DataFrame, scales: int, orientations: int) -> DataFrame:
    """Mutual information of the Gabor responses of two images, summed over the kernels."""
    return map_pairs(pairs, lambda x, y: {"information": K.response_information(x, y, K.GaborBank(scales, orientations))}, "image_id bigint, information double")


def histograms(images: DataFrame, bins: int = 256, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """image_id, bin, lo, hi and n (pixels) of the bins that hold any, between the bounds or else each image's own extremes."""

    def run(ids, x):
        cols = {k: [] for k in ("image_id", "bin", "lo", "hi", "n")}
        for i, one in zip(ids, x):
            a, b = (float(one.min()), float(one.max())) if lo is None or hi is None else (lo, hi)
            n = K.histogram(one, bins, a, b)
            if b <= a:
                a, b = a - 1, b + 1
            at = np.flatnonzero(n)
            edge = a + np.arange(bins + 1) * (b - a) / bins
            for k, v in zip(cols, (np.full(len(at), i), at.astype(np.int32), edge[at], edge[at + 1], n[at])):
                cols[k].append(v)
        return {k: np.concatenate(v) if v else np.zeros(0) for k, v in cols.items()}

    return describe_images(images, run, "image_id bigint, bin int, lo double, hi double, n bigint")


def grail_windows(images: DataFrame, scales: int = 3, orientations: int = 6, delta: int = 300, rounds: int = 3) -> DataFrame:
    """Window of every image that keeps most texture information: image_id, a, b.

    A search costs over a thousand convolutions an image, so the rows are first
    spread over all cores.
    """

    def run(ids, x):
        a, b = K.grail_bounds(x, scales, orientations, delta, rounds)
        return {"image_id": ids, "a": a, "b": b}

    return describe_images(spread(images), run, "image_id bigint, a double, b double")
