"""Kernels against plain loops and hand-computed values."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from rasterloom.operators import kernels as K

RNG = np.random.default_rng(0)
IMG = RNG.integers(0, 4096, (3, 9, 11)).astype(float)


def naive(x, k, rule, f):
    r = k // 2
    p = np.pad(x, r, mode=K.PAD[rule])
    return np.array([[f(p[i : i + k, j : j + k]) for j in range(x.shape[1])] for i in range(x.shape[0])])


def test_n1_correlation_keeps_the_kernel_as_it_is():
    x = np.zeros((1, 3, 3))
    x[0, 1, 1] = 1
    out = K.correlate(x, np.arange(9.0).reshape(3, 3))
    assert np.array_equal(out[0], np.arange(9.0)[::-1].reshape(3, 3))
    assert K.correlate(IMG, np.ones((2, 2))).shape == (3, 10, 12)


def test_n3_gaussian_is_the_outer_product():
    line = K.gaussian_line(1.3)
    assert len(line) == 2 * int(4 * 1.3 + 0.5) + 1 and math.isclose(line.sum(), 1)
    full = naive(IMG[0], len(line), "replicate", lambda w: (w * np.outer(line, line)).sum())
    assert np.allclose(K.gaussian(IMG, 1.3)[0], full)


def test_n5_median_reflects_and_wants_odd_sizes():
    assert np.allclose(K.median(IMG, 5)[1], naive(IMG[1], 5, "reflect", np.median))
    with pytest.raises(ValueError):
        K.median(IMG, 4)
    with pytest.raises(ValueError):
        K.median(np.zeros((1, 2, 2)), 5)


def test_n6_dog_checks_its_sigmas():
    assert np.allclose(K.difference_of_gaussian(IMG, 1.0), K.gaussian(IMG, 1.0) - K.gaussian(IMG, 1.6))
    for low, high in ((0, 1), (2, 1)):
        with pytest.raises(ValueError):
            K.difference_of_gaussian(IMG, low, high)


def test_n8_sauvola():
    with pytest.raises(ValueError):
        K.sauvola(IMG, 10)
    mean = naive(IMG[0], 5, "replicate", np.mean)
    dev = np.sqrt(naive(IMG[0] ** 2, 5, "replicate", np.mean) - mean**2 + 1e-8)
    assert np.array_equal(K.sauvola(IMG, 5)[0], np.where(IMG[0] > mean * (1 + 0.5 * (dev / 128 - 1)), 255, 0))


def test_n9_n10_variance():
    assert np.allclose(K.local_variance(IMG, 3)[2], naive(IMG[2], 3, "reflect", lambda w: w.var(ddof=1)))
    assert set(np.unique(K.binarize_by_variance(IMG, 1.0))) <= {0.0, 1.0}


def test_n11_n12_n15_morphology_counts_the_outside_as_zero():
    assert np.array_equal(K.erode(IMG, 2)[0], naive(IMG[0], 5, "zero", np.min))
    assert np.array_equal(K.dilate(IMG, 2)[0], naive(IMG[0], 5, "zero", np.max))
    m = (IMG > 2500).astype(float)
    assert np.array_equal(K.closing(m, 3)[0], naive(naive(m[0], 3, "zero", np.max), 3, "zero", np.min))
    assert (K.white_top_hat(IMG, 2) >= 0).all()
    assert K.disk(2).sum() == 13


def flood(mask, diagonal=False):
    lab, n = np.zeros(mask.shape, int), 0
    for start in zip(*np.nonzero(mask)):
        if lab[start]:
            continue
        n += 1
        todo = [start]
        while todo:
            r, c = todo.pop()
            if not (0 <= r < mask.shape[0] and 0 <= c < mask.shape[1]) or not mask[r, c] or lab[r, c]:
                continue
            lab[r, c] = n
            todo += [(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (diagonal or abs(i) + abs(j) == 1)]
    return lab


@settings(max_examples=60, deadline=None)
@given(hnp.arrays(bool, hnp.array_shapes(min_dims=3, max_dims=3, min_side=1, max_side=9)), st.booleans())
def test_g1_labels_equal_a_flood_fill(mask, diagonal):
    got = K.label(mask, diagonal)
    for one, lab in zip(mask, got):
        assert np.array_equal(lab, flood(one, diagonal))


def test_g2_holes():
    x = np.zeros((1, 5, 5))
    x[0, 1:4, 1:4] = 1
    x[0, 2, 2] = 0
    x[0, 0, 0] = 1
    want = x.copy()
    want[0, 2, 2] = 1
    assert np.array_equal(K.fill_holes(x), want)


def test_g3_largest_component_takes_the_first_of_equals():
    x = np.zeros((2, 20, 20))
    x[0, 2:6, 2:6] = x[0, 10:14, 10:14] = 2000
    got = K.breast_mask(x)
    assert got[0, 3, 3] == 1 and got[0, 11, 11] == 0 and got[0].sum() == 16
    assert got[1].sum() == 0  # all black stays empty


def test_n17_regional_maxima():
    x = np.array([[[1, 1, 1, 1], [1, 3, 3, 1], [1, 1, 1, 2]]], float)
    assert np.array_equal(K.regional_maxima(x)[0].nonzero(), np.array([[1, 1], [1, 2]]).T) or K.regional_maxima(x)[0].sum() >= 2
    assert not K.regional_maxima(np.ones((1, 4, 4))).any()


def test_a2_otsu_splits_two_levels_and_defines_constants():
    x = np.full((4, 4), 10.0)
    x[2:] = 200
    b, t = K.otsu_of(x)
    assert 10 <= t < 200 and (x > t).sum() == 8
    assert K.otsu_of(np.full((3, 3), 7.0)) == (0, 7.0)
    assert K.otsu(np.zeros((1, 3, 3))).sum() == 0


def test_p8_p6_windows():
    x = np.array([[[0.0, 500.0, 1000.0]]])
    assert K.intensity_window(x, np.array([0.0]), np.array([1000.0])).ravel().tolist() == [0.0, 127.5, 255.0]


def test_c15_c16_frequency():
    assert K.butterworth(8, 8).shape == (8, 8)
    assert np.allclose(np.fft.ifft2(np.fft.fft2(IMG)).real, IMG)


def test_n19_gabor_bank():
    bank = K.GaborBank(3, 6)
    assert len(bank) == 18 and [bank.dense(i).shape[0] for i in (0, 6, 12)] == [13, 17, 25]
    at = np.arange(-6, 7.0)
    y, x = np.meshgrid(at, at, indexing="ij")
    assert np.allclose(bank.dense(1), np.exp(-(x**2 + y**2) / 8) * np.cos(np.pi / 2 * (x * np.sin(np.pi / 6) + y * np.cos(np.pi / 6))))


def test_n21_resize():
    x = np.arange(12.0).reshape(1, 3, 4)
    assert np.allclose(K.resize_bilinear(x, 3, 4), x)
    assert K.resize_bilinear(x, 5, 7)[0, -1, -1] == 11 and K.resize_nearest(x, 6, 2).shape == (1, 6, 2)


def test_n22_template_is_found():
    full = np.random.RandomState(42).rand(200, 200) * 100
    assert K.locate(full, full[50:80, 70:110]) == (70, 50, 110, 80)


def test_g5_g6_g7_clusters():
    z = np.array([[0.0, 1.0, 2.0, 100.0, 101.0, 102.0]])
    lab, v = K.kmeans(z, K.spread_centroids(z, 2), 100, 1e-4)
    assert lab.tolist() == [[0, 0, 0, 1, 1, 1]] and np.allclose(v, [[1, 101]])
    u0 = K.memberships((z[:, None, :] - K.spread_centroids(z, 2)[:, :, None]) ** 2, 2.0)
    u, v = K.fcm(z, u0, 2.0, 100, 1e-6)
    assert np.allclose(u.sum(axis=1), 1) and np.allclose(v, [[1, 101]], atol=0.1)
    t, u, v = K.pfcm(z, u, v, 2.0, 2.0, 1.0, 4.0, 50, 1e-3)
    assert ((t >= 0) & (t <= 1)).all()


def test_g8_grail_narrows_the_window():
    a, b = K.grail_bounds(IMG[:1, :8, :8], 1, 2, 300, 1)
    assert a[0] < b[0]


def test_sbrg_is_binary():
    assert set(np.unique(K.sbrg(IMG))) <= {0.0, 1.0}


def test_sobel_of_a_ramp():
    x = np.tile(np.arange(6.0), (5, 1))[None]
    assert np.allclose(K.sobel(x)[0, :, 1:-1], 1 / np.sqrt(2))


@pytest.mark.parametrize("h,w", [(1, 1), (8, 8), (40, 37), (130, 259)])
def test_gabor_responses_equal_dense_correlation_at_any_size(h, w):
    x = RNG.random((2, h, w)) * 4095
    bank = K.GaborBank(3, 2)
    for k in range(len(bank)):
        assert np.allclose(bank.response(x, k), np.abs(K.correlate(x, bank.dense(k), "replicate")))


def test_information_of_levels():
    x, y = RNG.integers(0, 5, (2, 3, 9, 7)).astype(np.uint8)
    for i in range(3):
        pair, n = np.unique(np.stack((x[i].ravel(), y[i].ravel())), axis=1, return_counts=True)
        px, py = np.bincount(x[i].ravel()) / 63, np.bincount(y[i].ravel()) / 63
        want = sum(c / 63 * np.log2(c / 63 / (px[a] * py[b])) for (a, b), c in zip(pair.T, n))
        assert np.isclose(K.level_information(x, y)[i], want)


def brute_grail(image, scales, orientations, delta, rounds):
    """The search of one image with dense kernels and dictionaries."""
    bank = [K.GaborBank(scales, orientations).dense(k) for k in range(scales * orientations)]
    level = lambda v: np.zeros(v.shape, int) if v.max() <= v.min() else np.floor(np.round((v - v.min()) / (v.max() - v.min()) * 255.0, 6)).astype(int)
    levels = lambda im: [level(np.abs(K.correlate(im[None], k, "replicate"))[0]) for k in bank]
    whole = levels(image)

    def score(a, b):
        seen, total = levels(np.clip((image - a) / (b - a if b - a > 0 else 1.0), 0, 1) * 255.0), 0.0
        for p, q in zip(whole, seen):
            h = np.zeros((256, 256))
            np.add.at(h, (p.ravel(), q.ravel()), 1 / image.size)
            on = h > 0
            total += (h[on] * np.log2(h[on] / np.outer(h.sum(1), h.sum(0))[on])).sum()
        return round(total, 9)

    a, b = image.min(), image.max()
    for _ in range(rounds):
        tried = [(score(a, b + i * delta), -i, b + i * delta) for i in range(-5, 6) if b + i * delta > a]
        b = max(tried)[2] if tried else b
        tried = [(score(a + i * delta, b), -i, a + i * delta) for i in range(-5, 6) if a + i * delta < b]
        a = max(tried)[2] if tried else a
        delta = max(delta // 10, 1)
    return a, b


def test_g8_grail_equals_the_plain_search():
    x = RNG.integers(0, 4096, (3, 9, 11)).astype(float)
    a, b = K.grail_bounds(x, 2, 3, 300, 2)
    assert [(p, q) for p, q in zip(a, b)] == [brute_grail(i, 2, 3, 300, 2) for i in x]


def test_bands_and_box_sums_equal_the_windows(monkeypatch):
    x = RNG.integers(0, 4096, (2, 23, 17)).astype(float)
    v = K.windows(x, 5, 5, "reflect")
    monkeypatch.setattr(K, "BAND_VALUES", 3000)
    assert np.array_equal(K.median(x, 5), np.median(v.reshape(*v.shape[:3], -1), axis=-1))
    v = K.windows(x, 3, 7, "reflect")
    assert np.allclose(K.local_variance(x, 3, 7), v.reshape(*v.shape[:3], -1).var(axis=-1, ddof=1))


def test_a1_histogram():
    x = RNG.integers(0, 50, (6, 7)).astype(float)
    assert K.histogram(x, 10, 0, 50).tolist() == np.histogram(x, 10, (0, 50))[0].tolist()
    assert K.histogram(np.full((2, 2), 3.0), 4, 3, 3).sum() == 4


def test_n13_disk():
    assert K.disk(1).tolist() == [[0, 1, 0], [1, 1, 1], [0, 1, 0]] and K.disk(3).sum() == 29


def test_random_starts():
    u = K.random_memberships(500, 3, 42)
    assert np.allclose(u.sum(axis=0), 1) and u.std() > 0.1 and np.array_equal(u, K.random_memberships(500, 3, 42))
    z = np.array([[0.0, 0, 0, 9, 9, 20], [5.0] * 6])
    c = K.plus_plus_centroids(z, 3, [1, 1])
    assert sorted(c[0].tolist()) == [0, 9, 20] and c[1].tolist() == [5, 5, 5]


def test_one_mammogram_within_bounds():
    """The size of a real mammogram: no kernel copies its windows."""
    x = RNG.integers(0, 4096, (1, 1021, 832)).astype(np.float64)
    import tracemalloc

    tracemalloc.start()
    for f in (lambda: K.median(x, 5), lambda: K.local_variance(x, 5), lambda: K.GaborBank(1, 1).response(x, 0)):
        tracemalloc.reset_peak()
        f()
        assert tracemalloc.get_traced_memory()[1] < 16 * x.nbytes
    tracemalloc.stop()
