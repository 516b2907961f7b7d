"""polygon_raster over every polygon of ``part``."""

import os

import pytest

from rasterloom.plans import annotation_queries as Q

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def raster(xs, ys):
    """Pixels of a 160 x 80 image by the even-odd rule, every pixel tried."""
    edges = [(xs[k], ys[k], xs[(k + 1) % len(xs)], ys[(k + 1) % len(xs)]) for k in range(len(xs))]
    odd = lambda r, c: sum((ya > r) != (yb > r) and c < (xb - xa) * (r - ya) / (yb - ya) + xa for xa, ya, xb, yb in edges) % 2
    px = [(r, c) for r in range(160) for c in range(80) if odd(r, c)]
    return len(px), sum(r for r, _ in px), sum(c for _, c in px)


def test_every_polygon_is_rasterised(spark):
    polygons = Q.annotations(spark, DIR).where("shape = 'POLYGON'").collect()
    want = {p.ann_no: raster(p.coordinates[::2], p.coordinates[1::2]) for p in polygons}
    got = {r.ann_no: (r.n_pixels, r.sum_r, r.sum_c) for r in Q.polygon_raster(spark, DIR).collect()}
    assert got == {n: x for n, x in want.items() if x[0]}
