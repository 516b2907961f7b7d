"""Named pipelines: callables from image rows to image rows, to chain with ``DataFrame.transform``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from rasterloom.operators import kernels as K
from rasterloom.operators.measures import _membership_start, _start
from rasterloom.operators.raster import map_images, map_tiles, untile


class Pipeline:
    """A kernel chain run in one pass over the rows. ``pipeline(df)`` and ``df.transform(pipeline)`` are the same."""

    def __init__(self, *steps: Callable[[np.ndarray], np.ndarray]):
        self.steps = steps

    def kernel(self, x: np.ndarray) -> np.ndarray:
        for f in self.steps:
            x = f(x)
        return x

    def __call__(self, images: DataFrame) -> DataFrame:
        return map_images(images, self.kernel)

    def per_tile(self, images: DataFrame, tile: int, halo: int = 0) -> DataFrame:
        """The kernel on tiles instead of whole images, put together again."""
        return untile(map_tiles(images, self.kernel, tile, halo))


class Febds(Pipeline):
    """Edge boost (``dog``, ``log`` or ``fft``), median, gamma, binarisation, closing and hole filling."""

    def __init__(self, method: str = "dog", low: float = 1.7, high: float = 2.0, sigma: float = 2.0, gamma: float = 1.25, median: int = 5, closing: int = 7):
        def fft(x: np.ndarray) -> np.ndarray:
            return np.abs(np.fft.ifft2(np.fft.fft2(x) * K.butterworth(*x.shape[1:])).real)

        first = {
            "dog": lambda x: np.abs(K.difference_of_gaussian(x, low, high)),
            "log": lambda x: np.abs(K.laplacian_of_gaussian(x, sigma)),
            "fft": fft,
        }
        if method not in first:
            raise ValueError(f"method must be one of {sorted(first)}")
        binary = (lambda x: K.binarize_by_variance(x, 1.0)) if method == "fft" else K.otsu
        super().__init__(first[method], lambda x: K.median(x, median), lambda x: K.gamma(x, gamma), binary, lambda x: K.closing(x, closing), K.fill_holes)


class TopHat(Pipeline):
    def __init__(self, radius: int = 4):
        super().__init__(lambda x: K.white_top_hat(x, radius))


class BreastMask(Pipeline):
    """The largest component above Otsu's threshold: as a mask, or the image within it."""

    def __init__(self, mask_only: bool = True):
        super().__init__(K.breast_mask if mask_only else lambda x: x * K.breast_mask(x))


class Sbrg(Pipeline):
    def __init__(self):
        super().__init__(K.sbrg)


class DicomWindow(Pipeline):
    """Window by centre and width; without both, by each image's range."""

    def __init__(self, centre: float | None = None, width: float | None = None):
        def window(x: np.ndarray) -> np.ndarray:
            lo, hi = x.min(axis=(1, 2), keepdims=True), x.max(axis=(1, 2), keepdims=True)
            c, w = ((lo + hi) / 2, np.where(hi > lo, hi - lo, 1.0)) if centre is None or width is None else (centre, width)
            return np.clip((x - (c - w / 2)) / w, 0, 1) * 255.0

        super().__init__(window)


class GrailWindow(Pipeline):
    def __init__(self, scales: int = 3, orientations: int = 6, delta: int = 300, rounds: int = 3):
        super().__init__(lambda x: K.intensity_window(x, *K.grail_bounds(x, scales, orientations, delta, rounds)))


class BitDepthNorm(Pipeline):
    def __init__(self, bits: int | None = None, target_max: float = 255.0):
        def norm(x: np.ndarray) -> np.ndarray:
            top = x.max(axis=(1, 2), keepdims=True)
            b = np.where(top <= 255, 8, np.where(top <= 4095, 12, 16)) if bits is None else bits
            return np.clip(x / (2.0**b - 1), 0, 1) * target_max

        super().__init__(norm)


def _clustered(run: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], output: str):
    def kernel(x: np.ndarray) -> np.ndarray:
        labels, v = run(x.reshape(len(x), -1))
        if output == "labels":
            return labels.reshape(x.shape)
        top = v.max(axis=1, keepdims=True)
        level = np.take_along_axis(np.where(top > 0, v / np.where(top > 0, top, 1), v), labels, axis=1)
        if output == "mask":
            level = level == level.max(axis=1, keepdims=True)
        return level.astype(float).reshape(x.shape)

    return kernel


class KMeans(Pipeline):
    """``output``: mask (brightest cluster), quantized (centroid / brightest) or labels. The same seed gives the same result."""

    def __init__(self, k: int = 2, iterations: int = 100, tol: float = 1e-4, seed: int | None = 42, output: str = "mask"):
        super().__init__(_clustered(lambda z: K.kmeans(z, _start(z, k, range(len(z)) if seed is None else [0] * len(z), seed), iterations, tol), output))


class Fcm(Pipeline):
    def __init__(self, c: int = 2, m: float = 2.0, iterations: int = 100, tol: float = 1e-3, seed: int | None = 42, output: str = "mask"):
        def run(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            u, v = K.fcm(z, _membership_start(z, c, [0] * len(z), seed, m), m, iterations, tol)
            return u.argmax(axis=1), v

        super().__init__(_clustered(run, output))


class Pfcm(Pipeline):
    """Atypical pixels (greatest typicality below tau) outside the darkest cluster; ``output`` typicality gives the map itself."""

    def __init__(self, c: int = 2, m: float = 2.0, eta: float = 2.0, a: float = 1.0, b: float = 4.0, tau: float = 0.04, iterations: int = 100, tol: float = 1e-3, seed: int | None = 42, output: str = "mask"):
        def kernel(x: np.ndarray) -> np.ndarray:
            z = x.reshape(len(x), -1)
            u, v = K.fcm(z, _membership_start(z, c, [0] * len(z), seed, m), m, 100, tol)
            t, u, v = K.pfcm(z, u, v, m, eta, a, b, iterations, tol)
            best = t.max(axis=1)
            if output == "typicality":
                return best.reshape(x.shape)
            dark = u.argmax(axis=1) == v.argmin(axis=1)[:, None]
            return ((best < tau) & ~dark).astype(float).reshape(x.shape)

        super().__init__(kernel)


def per_patch_kmeans(images: DataFrame, tile: int, least_deviation: float = 1e-6) -> DataFrame:
    """K-means mask of every tile; tiles with hardly any contrast stay as they are."""
    km = KMeans()

    def kernel(x: np.ndarray) -> np.ndarray:
        flat = x.reshape(len(x), -1).std(axis=1) < least_deviation
        return np.where(flat[:, None, None], x, km.kernel(x))

    return untile(map_tiles(images, kernel, tile, 0))
