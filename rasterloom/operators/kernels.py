"""NumPy kernels over stacks of images of one shape: (images, rows, columns) in, the same out.

They run inside Arrow batches (see ``raster``); every image is independent, so
no kernel needs a shuffle. Arithmetic is in double precision.
"""

from __future__ import annotations

import hashlib

import numpy as np

# -- padding and stencils ------------------------------------------------------

#: Name of a border rule -> NumPy's: what lies outside an image.
PAD = {"zero": "constant", "replicate": "edge", "reflect": "reflect", "symmetric": "symmetric"}


def padded(x: np.ndarray, rh: int, rw: int, rule: str) -> np.ndarray:
    """The stack with rh rows and rw columns more on every side."""
    if rule == "reflect" and (rh >= x.shape[1] or rw >= x.shape[2]):
        raise ValueError("reflect needs a radius below the image's size")
    return np.pad(x, ((0, 0), (rh, rh), (rw, rw)), mode=PAD[rule])


def windows(x: np.ndarray, kh: int, kw: int, rule: str) -> np.ndarray:
    """(images, rows, columns, kh, kw) view of all neighbourhoods."""
    return np.lib.stride_tricks.sliding_window_view(padded(x, kh // 2, kw // 2, rule), (kh, kw), axis=(1, 2))


def correlate(x: np.ndarray, kernel: np.ndarray, rule: str = "zero") -> np.ndarray:
    """Sum of neighbours times weights; the kernel isn't turned. Even kernels give one row or column more."""
    kernel = np.asarray(kernel, float)
    kh, kw = kernel.shape
    p = padded(x, kh // 2, kw // 2, rule)
    h, w = p.shape[1] - kh + 1, p.shape[2] - kw + 1
    out = np.zeros((len(x), h, w))
    for i, j in zip(*np.nonzero(kernel)):
        out += kernel[i, j] * p[:, i : i + h, j : j + w]
    return out


def correlate_rows_columns(x: np.ndarray, line: np.ndarray, rule: str) -> np.ndarray:
    """Correlation with the outer product of ``line`` with itself, as two passes."""
    return correlate(correlate(x, line[:, None], rule), line[None, :], rule)


def box(x: np.ndarray, k: int, rule: str, reduce: np.ufunc, kw: int | None = None) -> np.ndarray:
    """Minimum, maximum or sum of k x kw boxes (k x k by default), separably: k + kw steps instead of their product."""
    kw = k if kw is None else kw
    p = padded(x, k // 2, kw // 2, rule)
    h, w = p.shape[1] - k + 1, p.shape[2] - kw + 1
    rows = p[:, :h]
    for i in range(1, k):
        rows = reduce(rows, p[:, i : i + h])
    out = rows[:, :, :w]
    for j in range(1, kw):
        out = reduce(out, rows[:, :, j : j + w])
    return out


# -- filters ---------------------------------------------------------------------


def gaussian_line(sigma: float, truncate: float = 4.0) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    at = np.arange(-radius, radius + 1)
    g = np.exp(-(at**2) / (2.0 * sigma**2))
    return g / g.sum()


def gaussian(x: np.ndarray, sigma: float, truncate: float = 4.0) -> np.ndarray:
    return correlate_rows_columns(x, gaussian_line(sigma, truncate), "replicate")


#: Values that the windows of one row band may hold.
BAND_VALUES = 4_000_000


def median(x: np.ndarray, size: int) -> np.ndarray:
    """Median of size x size windows, band after band of rows, so that the windows of a band are the only copies."""
    if size % 2 == 0:
        raise ValueError("median size must be odd")
    v = windows(x, size, size, "reflect")
    out = np.empty(x.shape)
    rows = max(1, BAND_VALUES // max(1, len(x) * x.shape[2] * size * size))
    middle = size * size // 2
    for r in range(0, x.shape[1], rows):
        part = v[:, r : r + rows]
        out[:, r : r + rows] = np.partition(part.reshape(*part.shape[:3], -1), middle, axis=-1)[..., middle]
    return out


def difference_of_gaussian(x: np.ndarray, low: float, high: float | None = None, truncate: float = 4.0) -> np.ndarray:
    if low <= 0:
        raise ValueError("low sigma must be above 0")
    high = 1.6 * low if high is None else high
    if high < low:
        raise ValueError("high sigma must not be below low sigma")
    return gaussian(x, low, truncate) - gaussian(x, high, truncate)


LAPLACE = np.array([[0.0, 1.0, 0.0], [1.0, -4.0, 1.0], [0.0, 1.0, 0.0]])


def laplacian_of_gaussian(x: np.ndarray, sigma: float) -> np.ndarray:
    return correlate(gaussian(x, sigma), LAPLACE, "reflect")


def sobel(x: np.ndarray) -> np.ndarray:
    """Edge strength: root of the mean of the squared axis responses; smoothing 1 2 1, difference 1 0 -1, both normalised."""
    smooth, diff = np.array([1.0, 2.0, 1.0]) / 4, np.array([1.0, 0.0, -1.0]) / 2
    gy = correlate(x, np.outer(diff, smooth), "symmetric")
    gx = correlate(x, np.outer(smooth, diff), "symmetric")
    return np.sqrt((gx * gx + gy * gy) / 2)


# -- thresholds --------------------------------------------------------------------


def histogram_bins(x: np.ndarray) -> int:
    return 256 if x.max() <= 255 else 4096


def histogram(image: np.ndarray, bins: int, lo: float, hi: float) -> np.ndarray:
    """Pixels per bin of equal width from lo to hi, the last one closed; values outside count nowhere, equal bounds widen by 1 on both sides."""
    v = image.ravel()
    if hi <= lo:
        lo, hi = lo - 1, hi + 1
    v = v[(v >= lo) & (v <= hi)]
    return np.bincount(np.minimum(np.floor((v - lo) * bins / (hi - lo)).astype(int), bins - 1), minlength=bins)


def otsu_of(image: np.ndarray) -> tuple[int, float]:
    """Bin and threshold of one image; a constant image has bin 0 and its value."""
    lo, hi = float(image.min()), float(image.max())
    bins = histogram_bins(image)
    if hi <= lo:
        return 0, lo
    at = np.minimum(np.floor((image.ravel() - lo) * bins / (hi - lo)).astype(int), bins - 1)
    n = np.bincount(at, minlength=bins).astype(float)
    centre = lo + np.arange(bins) * (hi - lo) / (bins - 1)
    w1, s1 = np.cumsum(n), np.cumsum(n * centre)
    w2, s2 = w1[-1] - w1, s1[-1] - s1
    between = w1 * w2 * (s1 / np.maximum(w1, 1e-6) - s2 / np.maximum(w2, 1e-6)) ** 2
    best = int(np.argmax(np.round(between, 2)))
    return best, float(centre[best])


def otsu(x: np.ndarray) -> np.ndarray:
    """1 above each image's Otsu threshold."""
    t = np.array([otsu_of(i)[1] for i in x])
    return (x > t[:, None, None]).astype(float)


def sauvola(x: np.ndarray, window: int, k: float = 0.5, r: float = 128.0) -> np.ndarray:
    """255 above the local threshold. The window must be odd."""
    if window % 2 == 0:
        raise ValueError("window must be odd")
    n = window * window
    mean = box(x, window, "replicate", np.add) / n
    dev = np.sqrt(box(x * x, window, "replicate", np.add) / n - mean * mean + 1e-8)
    return np.where(x > mean * (1 + k * (dev / r - 1)), 255.0, 0.0)


def local_variance(x: np.ndarray, kh: int, kw: int | None = None) -> np.ndarray:
    """Sample variance of kh x kw windows, from box sums."""
    kw = kh if kw is None else kw
    n = kh * kw
    s1, s2 = box(x, kh, "reflect", np.add, kw), box(x * x, kh, "reflect", np.add, kw)
    return np.maximum(n * s2 - s1 * s1, 0) / (n * (n - 1))


def variance_of(x: np.ndarray) -> np.ndarray:
    return x.reshape(len(x), -1).var(axis=1, ddof=1)


def binarize_by_variance(x: np.ndarray, alpha: float, window: int = 5) -> np.ndarray:
    """1 where the squared local variance reaches alpha times the squared global one."""
    return (local_variance(x, window) ** 2 >= alpha * variance_of(x)[:, None, None] ** 2).astype(float)


# -- morphology ----------------------------------------------------------------------


def erode(x: np.ndarray, radius: int) -> np.ndarray:
    return box(x, 2 * radius + 1, "zero", np.minimum)


def dilate(x: np.ndarray, radius: int) -> np.ndarray:
    return box(x, 2 * radius + 1, "zero", np.maximum)


def white_top_hat(x: np.ndarray, radius: int = 4) -> np.ndarray:
    return np.maximum(x - dilate(erode(x, radius), radius), 0)


def closing(x: np.ndarray, size: int = 7) -> np.ndarray:
    return box(box(x, size, "zero", np.maximum), size, "zero", np.minimum)


def disk(radius: int) -> np.ndarray:
    at = np.arange(-radius, radius + 1)
    return (at[:, None] ** 2 + at[None, :] ** 2 <= radius * radius).astype(float)


# -- connected components ------------------------------------------------------------


def label(mask: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Components of a stack of masks, numbered from 1 in raster order per image; 0 is background.

    Runs of the rows are nodes, overlaps of neighbouring rows edges; the labels
    are hooked and halved in a logarithmic number of array steps.
    """
    b, h, w = mask.shape
    m = np.zeros((b, h + 1, w + 2), np.int8)  # an empty row ends each image
    m[:, :h, 1 : w + 1] = mask != 0
    flat = m.reshape(-1, w + 2)
    step = np.diff(flat, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]
    n = len(row)
    out = np.zeros((b, h, w), np.int64)
    if not n:
        return out
    width, reach = w + 2, int(diagonal)
    s_key, e_key = row * width + start, row * width + end
    lo = np.searchsorted(e_key, (row + 1) * width + start - reach, "right")
    hi = np.searchsorted(s_key, (row + 1) * width + end + reach, "left")
    count = np.maximum(hi - lo, 0)
    u = np.repeat(np.arange(n), count)
    v = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
    root = np.arange(n)
    while True:
        a, c = root[u], root[v]
        low, high = np.minimum(a, c), np.maximum(a, c)
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while not np.array_equal(root, nxt := root[root]):
            root = nxt
    image = row // (h + 1)
    roots, number = np.unique(root, return_inverse=True)
    first = np.searchsorted(image[roots], np.arange(b))
    number = number - first[image] + 1
    length = end - start
    at = np.repeat(row * width + start, length) + np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    r, c = at // width, at % width
    out[r // (h + 1), r % (h + 1), c] = np.repeat(number, length)
    return out


def fill_holes(x: np.ndarray) -> np.ndarray:
    """Background that is not joined to the border becomes 1."""
    p = np.pad(x != 0, ((0, 0), (1, 1), (1, 1)))
    outside = label(~p) == 1  # the rim's component comes first
    return (~outside[:, 1:-1, 1:-1]).astype(float)


def largest_component(mask: np.ndarray) -> np.ndarray:
    """The biggest component alone, the first of equal ones; an empty mask stays empty."""
    lab = label(mask)
    out = np.zeros(mask.shape)
    for i, one in enumerate(lab):
        n = np.bincount(one.ravel())
        if len(n) > 1:
            out[i] = one == np.argmax(n[1:]) + 1
    return out


def breast_mask(x: np.ndarray) -> np.ndarray:
    return largest_component(otsu(x))


def regional_maxima(x: np.ndarray) -> np.ndarray:
    """Plateaus (8 neighbours) above everything around them; a constant image has none."""
    p = np.pad(x, ((0, 0), (1, 1), (1, 1)), constant_values=-np.inf)
    h, w = x.shape[1], x.shape[2]
    near = [(i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    view = lambda a, i, j: a[:, i : i + h, j : j + w]
    lower = np.zeros(x.shape, bool)
    for i, j in near:
        lower |= view(p, i, j) > x
    while True:
        q = np.pad(lower, ((0, 0), (1, 1), (1, 1)))
        grown = lower.copy()
        for i, j in near:
            grown |= view(q, i, j) & (view(p, i, j) == x)
        if (grown == lower).all():
            break
        lower = grown
    flat = (x == x[:, :1, :1]).reshape(len(x), -1).all(axis=1)
    return ~lower & ~flat[:, None, None]


# -- frequency -------------------------------------------------------------------------


def butterworth(h: int, w: int, d0: float = 21.0, band: float = 32.0, n: int = 3) -> np.ndarray:
    """Transfer function around the centre (h / 2, w / 2)."""
    v, u = np.meshgrid(np.arange(h), np.arange(w), indexing="ij")
    d = np.sqrt((u - w / 2) ** 2 + (v - h / 2) ** 2)
    cut = 8.0 * band * d
    cut[cut == 0] = 1e-6
    return 1.0 / (1.0 + ((d * d - d0 * d0) / cut) ** (2 * n))


# -- mammography --------------------------------------------------------------------------


def gamma(x: np.ndarray, g: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return (x / 4095.0) ** g * 4095.0


def intensity_window(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    span = np.where(b - a <= 0, 1.0, b - a)
    return np.clip((x - a[:, None, None]) / span[:, None, None], 0, 1) * 255.0


class GaborBank:
    """Real Gabor kernels: frequency 0.25 / sqrt(2)^m, deviation 1 / (2 f), odd size of six deviations.

    A kernel is the difference of two products of lines, cosines along columns
    and rows less sines along both, each under a Gaussian, so a response takes
    line passes, whatever the image's size. A pass is a product with banded
    matrices of LINE_BLOCK outputs.
    """

    #: Outputs of one banded matrix.
    LINE_BLOCK = 128

    def __init__(self, scales: int, orientations: int):
        self.kernels = []
        for m in range(scales):
            f = 0.25 / np.sqrt(2.0) ** m
            dev = 1.0 / (2.0 * f)
            size = int(np.ceil(6 * dev))
            size += 1 - size % 2
            at = np.arange(-(size // 2), size // 2 + 1, dtype=float)
            g = np.exp(-(at**2) / (2 * dev**2))
            for n in range(orientations):
                a, b = (2 * np.pi * f * at * t for t in (np.sin(n * np.pi / orientations), np.cos(n * np.pi / orientations)))
                self.kernels.append(((g * np.cos(a), g * np.sin(a)), (g * np.cos(b), g * np.sin(b))))
        self.bands: dict[tuple[int, int, int], np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.kernels)

    def dense(self, k: int) -> np.ndarray:
        """The kernel as a square of weights."""
        (ca, sa), (cb, sb) = self.kernels[k]
        return np.outer(cb, ca) - np.outer(sb, sa)

    def _band(self, k: int, axis: int, outputs: int) -> np.ndarray:
        """Matrix (outputs + size - 1, 2 outputs) of the cosine and the sine line of kernel k."""
        key = (k, axis, outputs)
        if key not in self.bands:
            lines = self.kernels[k][axis]
            size = len(lines[0])
            m = np.zeros((outputs + size - 1, 2 * outputs))
            for i, line in enumerate(lines):
                for j in range(outputs):
                    m[j : j + size, i * outputs + j] = line
            self.bands[key] = m
        return self.bands[key]

    def response(self, x: np.ndarray, k: int) -> np.ndarray:
        """Absolute response (images, rows, columns) to kernel k, edges repeated."""
        h, w = x.shape[1:]
        half = len(self.kernels[k][0][0]) // 2
        p = np.pad(x, ((0, 0), (half, half), (half, half)), mode="edge")
        out = np.empty(x.shape)
        for r in range(0, h, self.LINE_BLOCK):
            n = min(self.LINE_BLOCK, h - r)
            rows = self._band(k, 1, n)
            for c in range(0, w, self.LINE_BLOCK):
                m = min(self.LINE_BLOCK, w - c)
                lines = p[:, r : r + n + 2 * half, c : c + m + 2 * half] @ self._band(k, 0, m)
                out[:, r : r + n, c : c + m] = np.abs(rows[:, :n].T @ lines[:, :, :m] - rows[:, n:].T @ lines[:, :, m:])
        return out


def _levels(v: np.ndarray) -> np.ndarray:
    """Whole levels 0..255 between each image's own extremes; a constant image has level 0."""
    lo, hi = v.min(axis=(-2, -1), keepdims=True), v.max(axis=(-2, -1), keepdims=True)
    span = np.where(hi > lo, hi - lo, 1.0)
    return np.where(hi > lo, np.round((v - lo) / span * 255.0, 6), 0).astype(np.uint8)


def level_information(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mutual information (bits) of two stacks of levels, per image, from the joint levels' counts."""
    n, size = len(x), x[0].size if len(x) else 0
    key = (x.astype(np.uint16) << 8 | y).reshape(n, size)
    key = np.sort(key, axis=1, kind="stable")  # a radix sort
    new = np.ones(key.shape, bool)
    new[:, 1:] = key[:, 1:] != key[:, :-1]
    at = np.flatnonzero(new)
    count = np.diff(at, append=key.size)
    image, cell = at // size, key.ravel()[at].astype(np.int64)
    a, b = image * 256 + (cell >> 8), image * 256 + (cell & 255)
    px, py = (np.bincount(v, weights=count, minlength=n * 256)[v] / size for v in (a, b))
    p = count / size
    return np.bincount(image, weights=p * np.log2(p / np.maximum(px * py, 1e-12)), minlength=n)


def response_information(x: np.ndarray, y: np.ndarray, bank: GaborBank) -> np.ndarray:
    """Mutual information (bits) of the Gabor responses of two image stacks, summed over the kernels; one response at a time is held."""
    return sum(level_information(_levels(bank.response(x, k)), _levels(bank.response(y, k))) for k in range(len(bank)))


def grail_bounds(x: np.ndarray, scales: int = 3, orientations: int = 6, delta: int = 300, rounds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows [a, b] of a stack of images that keep most texture information of the originals.

    Upper and lower bound are searched in turn among eleven candidates, all
    images at once; the first best candidate wins. The originals' responses are
    kept as levels, one byte a pixel and kernel.
    """
    bank = GaborBank(scales, orientations)
    whole = [_levels(bank.response(x, k)) for k in range(len(bank))]
    a, b = x.min(axis=(1, 2)), x.max(axis=(1, 2))
    for _ in range(rounds):
        for upper in (True, False):
            here = b if upper else a
            best, chosen = np.full(len(x), -np.inf), here.copy()
            for i in range(-5, 6):
                c = here + i * delta
                fit = c > a if upper else c < b
                if not fit.any():
                    continue
                seen = intensity_window(x[fit], a[fit] if upper else c[fit], c[fit] if upper else b[fit])
                score = np.round(sum(level_information(w[fit], _levels(bank.response(seen, k))) for k, w in enumerate(whole)), 9)
                better = score > best[fit]
                at = np.flatnonzero(fit)[better]
                best[at], chosen[at] = score[better], c[at]
            a, b = (a, chosen) if upper else (chosen, b)
        delta = max(delta // 10, 1)
    return a, b


# -- resize and matching -------------------------------------------------------------------


def resize_bilinear(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Corners stay corners."""
    def at(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = np.arange(m) * ((n - 1) / (m - 1) if m > 1 else 0.0)
        i = np.minimum(np.floor(p).astype(int), n - 1)
        return i, np.minimum(i + 1, n - 1), p - i

    r0, r1, fr = at(x.shape[1], h)
    c0, c1, fc = at(x.shape[2], w)
    top = x[:, r0][:, :, c0] * (1 - fc) + x[:, r0][:, :, c1] * fc
    low = x[:, r1][:, :, c0] * (1 - fc) + x[:, r1][:, :, c1] * fc
    return top * (1 - fr)[:, None] + low * fr[:, None]


def resize_nearest(x: np.ndarray, h: int, w: int) -> np.ndarray:
    return x[:, np.arange(h) * x.shape[1] // h][:, :, np.arange(w) * x.shape[2] // w]


def locate(full: np.ndarray, crop: np.ndarray) -> tuple[int, int, int, int]:
    """Box [x0, y0, x1, y1] of the first best normalised correlation of edge images."""
    def edges(a: np.ndarray) -> np.ndarray:
        return sobel(((a - a.mean()) / (a.std() + 1e-8))[None])[0]

    f, t = edges(full.astype(float)), edges(crop.astype(float))
    th, tw = t.shape
    n = th * tw
    t0 = t - t.mean()
    shape = (f.shape[0] + th, f.shape[1] + tw)
    cross = np.fft.irfft2(np.fft.rfft2(f, shape) * np.conj(np.fft.rfft2(t0, shape)), shape)[: f.shape[0] - th + 1, : f.shape[1] - tw + 1]
    sums = lambda a: np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    part = lambda s: s[th:, tw:] - s[:-th, tw:] - s[th:, :-tw] + s[:-th, :-tw]
    s1, s2 = part(sums(f)), part(sums(f * f))
    norm = np.sqrt(np.maximum(s2 - s1 * s1 / n, 0) * (t0 * t0).sum())
    score = np.where(norm > 1e-12, cross / np.maximum(norm, 1e-12), 0)
    y, xx = np.unravel_index(int(np.argmax(np.round(score, 9))), score.shape)
    return int(xx), int(y), int(xx) + tw, int(y) + th


# -- clustering ------------------------------------------------------------------------------


def spread_centroids(z: np.ndarray, k: int) -> np.ndarray:
    """k evenly spaced levels from each image's minimum to its maximum: (images, k)."""
    lo, hi = z.min(axis=1, keepdims=True), z.max(axis=1, keepdims=True)
    return lo + (hi - lo) * np.arange(k) / max(k - 1, 1)


def uniform(seed: int, i: int) -> float:
    """A number in [0, 1) from the hash of (seed, i): the same in every engine."""
    return int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) / 2.0**32


def plus_plus_centroids(z: np.ndarray, k: int, seeds: list[int]) -> np.ndarray:
    """k-means++ starts, one seed per image: the next centre is drawn by squared distance from those there are."""
    out = np.empty((len(z), k))
    for i, (v, seed) in enumerate(zip(z, seeds)):
        out[i, 0] = v[int(uniform(seed, 0) * len(v))]
        d = np.full(len(v), np.inf)
        for j in range(1, k):
            d = np.minimum(d, (v - out[i, j - 1]) ** 2)
            total = np.cumsum(d)
            u = uniform(seed, j)
            out[i, j] = v[np.searchsorted(total, u * total[-1], "right")] if total[-1] > 0 else v[int(u * len(v))]
    return out


def random_memberships(n: int, c: int, seed: int) -> np.ndarray:
    """(c, n) memberships that sum to 1 per pixel: multiples of a fixed odd number, shifted by the seed's hash."""
    salt = int(uniform(seed, 0) * 2**32)
    at = np.arange(n * c, dtype=np.uint64).reshape(n, c).T + np.uint64(1)
    u = ((at * np.uint64(2654435761) + np.uint64(salt)) & np.uint64(0xFFFFFFFF)) / 2.0**32
    return u / u.sum(axis=0)


def kmeans(z: np.ndarray, v: np.ndarray, iterations: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's steps on (images, pixels); an empty cluster keeps its centroid. Returns labels and centroids.

    The labels are those that the last centroids were averaged over.
    """
    v = v.copy()
    labels = np.zeros(z.shape, np.int64)
    live = np.arange(len(z))
    for _ in range(iterations):
        lab = ((z[live, None, :] - v[live, :, None]) ** 2).argmin(axis=1)
        new = v[live]
        for j in range(v.shape[1]):
            n = (lab == j).sum(axis=1)
            s = np.where(lab == j, z[live], 0).sum(axis=1)
            new[:, j] = np.where(n > 0, s / np.maximum(n, 1), new[:, j])
        shift = np.sqrt(((new - v[live]) ** 2).sum(axis=1))
        v[live], labels[live] = new, lab
        live = live[shift >= tol]
        if not len(live):
            break
    return labels, v


def memberships(d2: np.ndarray, m: float) -> np.ndarray:
    u = (d2 + 1e-10) ** (-1.0 / (m - 1.0))
    return u / u.sum(axis=1, keepdims=True)


def _centres(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (w * z[:, None, :]).sum(axis=2) / (w.sum(axis=2) + 1e-10)


def _squares(z: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (z[:, None, :] - v[:, :, None]) ** 2


def fcm(z: np.ndarray, u: np.ndarray, m: float, iterations: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """Fuzzy c-means from memberships u (images, c, pixels). Returns memberships and centroids."""
    u = u.copy()
    v = _centres(z, u**m)
    live = np.arange(len(z))
    for _ in range(iterations):
        new = memberships(_squares(z[live], v[live]), m)
        v[live] = _centres(z[live], new**m)
        shift = np.sqrt(((new - u[live]) ** 2).sum(axis=(1, 2)))
        u[live] = new
        live = live[shift >= tol]
        if not len(live):
            break
    return u, v


def typicalities(d2: np.ndarray, u: np.ndarray, m: float, eta: float, b: float) -> np.ndarray:
    g = (u**m * d2).sum(axis=2) / ((u**m).sum(axis=2) + 1e-10)
    return 1.0 / (1.0 + ((b / (g + 1e-10))[:, :, None] * d2 + 1e-10) ** (1.0 / (eta - 1.0)))


def pfcm(z: np.ndarray, u: np.ndarray, v: np.ndarray, m: float, eta: float, a: float, b: float, iterations: int, tol: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Possibilistic fuzzy c-means from a fuzzy result. Returns typicalities, memberships and centroids."""
    u, v = u.copy(), v.copy()
    t = typicalities(_squares(z, v), u, m, eta, b)
    live = np.arange(len(z))
    for _ in range(iterations):
        v[live] = _centres(z[live], a * u[live] ** m + b * t[live] ** eta)
        d2 = _squares(z[live], v[live])
        u[live] = memberships(d2, m)
        new = typicalities(d2, u[live], m, eta, b)
        shift = np.sqrt(((new - t[live]) ** 2).sum(axis=(1, 2)))
        t[live] = new
        live = live[shift >= tol]
        if not len(live):
            break
    return t, u, v


# -- seeded region growing -----------------------------------------------------------------------


def growing_seed(image: np.ndarray) -> float:
    """Mean of the regional maxima that lead their 3 x 3 surroundings; ties within a plateau are parted by NumPy's generator of seed 42, in raster order."""
    peak = regional_maxima(image[None])[0]
    if not peak.any():
        return float(image.mean())
    values = image[peak]
    gaps = np.diff(np.sort(values))
    gap = gaps[gaps > 0].min() if (gaps > 0).any() else 1e-6
    lifted = np.zeros(image.shape)
    lifted[peak] = values + np.random.RandomState(42).random(len(values)) * gap
    top = box(lifted[None], 3, "symmetric", np.maximum)[0]
    lead = peak & (lifted == top) & (lifted > 0)
    return float(image[lead].mean()) if lead.any() else float(values.mean())


def region_boundary(region: np.ndarray) -> np.ndarray:
    """Edges of a stack of 0/1 regions, dilated and eroded by 2."""
    return (erode(dilate((sobel(region) > 0).astype(float), 2), 2) > 0).astype(float)


def sbrg(x: np.ndarray) -> np.ndarray:
    seeds = np.array([growing_seed(i) for i in x])
    return region_boundary((x >= seeds[:, None, None]).astype(float))
