"""Images as rows and relations, tiles, measures and pipelines on Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.errors import PixelsNotLoaded
from rasterloom.operators import kernels as K
from rasterloom.operators import measures as M
from rasterloom.operators import raster as R
from rasterloom.plans import pipelines as L
from rasterloom.sources.files import require_loaded
from tests.conftest import rows

DDL = "image_id bigint, h int, w int, pixels array<double>, r int"  # r: a column that clashes with the relation's


@pytest.fixture(scope="module")
def stack():
    return np.random.default_rng(1).integers(0, 4096, (5, 6, 7)).astype(float)


@pytest.fixture(scope="module")
def images(spark, stack):
    data = [(i, 6, 7, x.ravel().tolist(), 0) for i, x in enumerate(stack)]
    data += [(100, None, 7, [1.0], 0), (101, 2, 2, None, 0), (None, 1, 1, [1.0], 0), (102, 2, 2, [1.0], 0), (103, 1, 1, [5.0], 0)]
    return spark.createDataFrame(data, DDL)


def pixels(df):
    return {r.image_id: np.array(r.pixels).reshape(r.h, r.w) for r in df.collect()}


def test_map_images_skips_what_has_no_pixels(images, stack):
    got = pixels(R.map_images(images, lambda x: x + 1))
    assert sorted(got) == [0, 1, 2, 3, 4, 103]
    assert all(np.array_equal(got[i], stack[i] + 1) for i in range(5))


def test_relation_and_back(images, stack):
    px = R.to_px(images.where("image_id < 5"))
    assert px.count() == 5 * 42
    got = pixels(R.from_px(px))
    assert all(np.array_equal(got[i], stack[i]) for i in range(5))


@pytest.mark.parametrize("tile", [1, 3, 4, 10])
def test_tiles_cover_every_pixel_once_and_come_back(images, stack, tile):
    t = R.tiled(images.where("image_id < 5"), tile, 0)
    assert t.agg(F.sum(F.size("pixels"))).first()[0] == 5 * 42
    got = pixels(R.untile(t))
    assert all(np.array_equal(got[i], stack[i]) for i in range(5))


def test_halo_tiles_equal_the_whole_image(images, stack):
    got = pixels(R.untile(R.map_tiles(images.where("image_id < 5"), lambda x: K.gaussian(x, 1.0), 4, 4)))
    assert all(np.allclose(got[i], K.gaussian(stack, 1.0)[i]) for i in range(5))


def test_mosaic(spark):
    df = spark.createDataFrame([(i, 1, 2, [float(i), i + 0.5]) for i in range(9)], "image_id bigint, h int, w int, pixels array<double>")
    got = pixels(R.mosaic(df, 2))
    assert sorted(got) == [0, 1, 2] and (got[2] == 0).any() and got[0].tolist() == [[0, 0.5, 1, 1.5], [2, 2.5, 3, 3.5]]


def test_empty_table(spark):
    none = spark.createDataFrame([], DDL)
    assert R.map_images(none, lambda x: x).count() == 0
    assert M.otsu_thresholds(none).count() == 0
    assert R.untile(R.tiled(none, 3, 1)).count() == 0


def test_vectors_of_other_lengths_give_no_image(spark):
    df = spark.createDataFrame([(1, [0.0] * 64), (2, [0.0] * 3), (3, None), (None, [0.0] * 64)], "vec_id bigint, embedding array<float>")
    assert rows(R.images_from_vectors(df), "image_id", "h", "w") == [(1, 8, 8)]


def test_require_loaded(images):
    with pytest.raises(PixelsNotLoaded):
        require_loaded(images)
    assert require_loaded(images.where("image_id < 5")).count() == 5


def test_measures(images):
    five = images.where("image_id < 5")
    assert M.kmeans_statistics(five).groupBy("image_id").agg(F.sum("pixels").alias("n")).where("n <> 42").count() == 0
    assert M.entropies(images.where("image_id = 103")).first().entropy == 0.0
    assert M.component_boxes(five.withColumn("pixels", F.transform("pixels", lambda v: F.lit(0.0)))).count() == 0


def test_same_seed_same_result_on_any_partitioning(images):
    five = images.where("image_id < 5")
    a, b = (rows(M.kmeans_statistics(x, k=3), "image_id", "cluster", "centroid") for x in (five.repartition(4), five.coalesce(1)))
    assert a == b


@pytest.mark.parametrize("pipe", [L.Febds("dog"), L.Febds("log"), L.Febds("fft"), L.TopHat(2), L.Sbrg(), L.BreastMask(), L.KMeans(), L.Fcm(), L.Pfcm(), L.DicomWindow(), L.BitDepthNorm(), L.GrailWindow(1, 2, rounds=1)], ids=lambda p: type(p).__name__)
def test_pipelines_keep_the_shape(images, pipe):
    big = images.where("image_id < 2").withColumn("h", F.lit(6))
    got = pixels(big.transform(pipe))
    assert {x.shape for x in got.values()} == {(6, 7)}
    if isinstance(pipe, (L.Febds, L.Sbrg, L.BreastMask, L.KMeans, L.Fcm, L.Pfcm)):
        assert {v for x in got.values() for v in np.unique(x)} <= {0.0, 1.0}


def test_unknown_method():
    with pytest.raises(ValueError):
        L.Febds("nothing")


def test_patch_kmeans_leaves_flat_tiles(spark):
    df = spark.createDataFrame([(1, 4, 8, [5.0] * 4 * 8)], "image_id bigint, h int, w int, pixels array<double>")
    assert set(pixels(L.per_patch_kmeans(df, 4))[1].ravel()) == {5.0}
