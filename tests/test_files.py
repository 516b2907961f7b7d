"""Codecs and sources on generated files."""

import plistlib
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from pyspark.sql import functions as F

from rasterloom.errors import EngineError, FileMissing, UnsupportedFile
from rasterloom.operators import kernels as K
from rasterloom.operators.raster import map_images
from rasterloom.sources import catalog as S
from rasterloom.sources import codecs, files, plist
from rasterloom.streaming import inbox
from tests.conftest import rows

X = np.arange(48).reshape(6, 8) * 80


@settings(max_examples=30, deadline=None)
@given(hnp.arrays(np.uint8, hnp.array_shapes(min_dims=2, max_dims=2, max_side=12)))
def test_round_trips(x):
    assert np.array_equal(codecs.decode_png(codecs.encode_png(x)), x)
    assert np.array_equal(codecs.decode_tiff(codecs.encode_tiff(x)), x)
    for implicit in (False, True):
        assert np.array_equal(codecs.decode_dicom(codecs.encode_dicom(x, implicit=implicit))[1], x)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 4), hnp.arrays(np.uint8, (5, 9)))
def test_png_filters(kind, x):
    """Every filter type is undone; the reference is the definition, byte by byte."""
    step, above = 3, np.zeros(9, np.uint8)
    for line in x:
        coded = np.zeros(9, np.uint8)
        for i in range(9):
            a, b, c = (int(line[i - step]) if i >= step else 0), int(above[i]), (int(above[i - step]) if i >= step else 0)
            p = a + b - c
            nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            coded[i] = (int(line[i]) - [0, a, b, (a + b) // 2, nearest][kind]) & 255
        assert np.array_equal(codecs._unfilter(kind, coded, above, step), line)
        above = line


def test_colour_png_and_16_bits():
    rgb = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert np.array_equal(codecs.decode_png(codecs.encode_png(rgb)), rgb)


def test_packbits_and_big_endian_tiff():
    assert codecs._packbits(b"\x02abc\xfex\x80") == b"abcxxx"
    body = struct.pack(">4H", 1, 2, 3, 65535)
    tags = [(256, 4, 2), (257, 4, 2), (258, 3, 16), (259, 3, 1), (273, 4, 8), (277, 3, 1), (279, 4, 8)]
    ifd = struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in tags)
    assert codecs.decode_tiff(struct.pack(">2sHI", b"MM", 42, 16) + body + ifd).tolist() == [[1, 2], [3, 65535]]


def test_broken_files():
    good = codecs.encode_dicom(X)
    for f, raw in ((codecs.decode_dicom, b""), (codecs.decode_dicom, good[:-5]), (codecs.decode_png, b"\x89PNG\r\n\x1a\n"), (codecs.decode_tiff, b"II*\0"), (codecs.decode_tiff, codecs.encode_tiff(X)[:12])):
        with pytest.raises(UnsupportedFile):
            f(raw)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.dcm").write_bytes(codecs.encode_dicom(X, 12, (2000, 500)))
    (tmp_path / "sub/b.DCM").write_bytes(codecs.encode_dicom(X + 1, implicit=True))
    (tmp_path / "c.png").write_bytes(codecs.encode_png(X / 16))
    (tmp_path / "m1.tif").write_bytes(codecs.encode_tiff(X > 1000))
    (tmp_path / "bad.dcm").write_bytes(b"nothing")
    return tmp_path


def test_s1_s3_s4_scan(spark, folder):
    got = {r.file_path.rsplit("/", 1)[-1]: r for r in files.read_images(spark, str(folder)).collect()}
    assert set(got) == {"a.dcm", "b.DCM", "c.png", "m1.tif", "bad.dcm"}
    assert got["a.dcm"].pixels == X.ravel().tolist() and (got["a.dcm"].bits_stored, got["a.dcm"].window_center) == (12, 2000)
    assert got["b.DCM"].pixels == (X + 1).ravel().tolist()
    assert got["bad.dcm"].pixels is None and "DICOM" in got["bad.dcm"].error
    with pytest.raises(Exception, match="not a DICOM"):
        files.read_images(spark, str(folder), strict=True).collect()


def test_s2_data_sources(spark, folder, tmp_path_factory):
    files.register(spark)
    head = rows(spark.read.format("dicom_header").load(str(folder)).where("h is not null"), "h", "w", "bits_stored")
    assert head == [(6, 8, 12), (6, 8, 16)]
    full = spark.read.format("dicom").load(str(folder)).where("pixels is not null")
    assert full.count() == 2
    out = tmp_path_factory.mktemp("out")
    full.select(F.lit("k").alias("name"), "h", "w", "pixels").limit(1).write.format("dicom").mode("append").save(str(out))
    assert codecs.decode_dicom((out / "k_modified.dcm").read_bytes())[1].shape == (6, 8)


def test_k1_k2_writers(spark, folder, tmp_path_factory):
    out = tmp_path_factory.mktemp("png")
    df = files.read_images(spark, str(folder), "a.dcm")
    for form in ("png", "tif", "dcm"):
        assert [r.path.rsplit("/", 1)[-1] for r in files.write_images(df, str(out), form).collect()] == [f"a_modified.{form}"]
    assert np.array_equal(codecs.decode_png((out / "a_modified.png").read_bytes()), np.clip(X, 0, 255))
    with pytest.raises(UnsupportedFile):
        files.write_images(df, str(out), "bmp")


def test_s5_masks_are_merged_at_the_top_left(spark):
    m = spark.createDataFrame([("k", 1, 2, [0.0, 1.0]), ("k", 2, 1, [0.0, 1.0]), ("e", 1, 1, [0.0])], "k string, h int, w int, pixels array<double>")
    got = {r.k: (r.h, r.w, r.pixels) for r in files.merge_masks(m, "k").collect()}
    assert got == {"k": (2, 2, [0.0, 1.0, 1.0, 0.0]), "e": (1, 1, [0.0])}


def test_s16_download(tmp_path):
    src = tmp_path / "s"
    (src / "d").mkdir(parents=True)
    for i in range(10):
        (src / "d" / f"{i}.txt").write_text(str(i))
    assert len(files.download(str(src), str(tmp_path / "t"))) == 10
    a, b = (files.download(str(src), str(tmp_path / n), 0.3) for n in ("u", "v"))
    assert len(a) == 3 and [x.rsplit("/", 1)[-1] for x in a] == [x.rsplit("/", 1)[-1] for x in b]
    with pytest.raises(EngineError):
        files.download(str(src), str(tmp_path / "w"), 1.5)
    with pytest.raises(FileMissing):
        files.download(str(tmp_path / "none"), str(tmp_path / "w"))


def test_s6_s7_property_lists(spark, tmp_path):
    doc = {"Images": [{"ROIs": [{"Name": "Mass", "Type": 15, "NumberOfPoints": 2, "Point_px": ["(1.5, 2)", "(-1, 2)", "( 3 ,4.25)"]}]}]}
    (tmp_path / "1.xml").write_bytes(plistlib.dumps(doc))
    (tmp_path / "2.xml").write_bytes(b"<broken")
    got = plist.read_annotations(spark, str(tmp_path)).collect()
    assert len(got) == 1 and [(p.x, p.y) for p in got[0].points] == [(1.5, 2.0), (3.0, 4.25)] and got[0].roi_type == 15


def test_s8_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("File Name;Laterality;View;Bi-Rads\n 1 ;L;CC;4a\n;R;CC;2\n2;R;MLO;3\n2;L;MLO;5\n")
    assert rows(S.read_case_csv(spark, str(tmp_path / "c.csv")), "case_id", "laterality", "birads") == [("1", "L", -1), ("2", "L", 5)]


def test_j3_case_folders(spark):
    data = [
        ("Calc-Test_P_00038_LEFT_CC", "full", "z/2.dcm"), ("Calc-Test_P_00038_LEFT_CC", "full", "z/1.dcm"),
        ("Calc-Test_P_00038_LEFT_CC_2", "ROI mask images", "b/1.dcm"), ("Calc-Test_P_00038_LEFT_CC_2", "ROI mask images", "b/2.dcm"),
        ("Calc-Test_P_00038_LEFT_CC_1", "cropped images", "a/1.dcm"), ("Calc-Test_P_00038_LEFT_CC_1", "ROI mask images", "a/2.dcm"),
        ("Mass-Training_P_1_RIGHT_MLO_1", "cropped images", "q.dcm"), ("Mass-Training_P_2_RIGHT_MLO", "full", "q.txt"), ("junk", None, "x.dcm"), (None, None, None),
    ]
    got = S.pair_case_folders(spark.createDataFrame(data, "folder string, series string, path string")).collect()
    assert [(r.case_id, r.dicom_path, [tuple(e) for e in r.roi_entries]) for r in got] == [("Calc-Test_P_00038_LEFT_CC", "z/1.dcm", [("a/1.dcm", "a/2.dcm"), ("b/1.dcm", "b/2.dcm")])]


def test_j1_pairs(spark):
    p = ["/d/12_a.dcm", "/d/x.dcm", "/d/12.xml", "/d/12_z.XML", "/d/13.dcm", None]
    got = rows(S.mask_source(S.pair_by_id(spark.createDataFrame([(x,) for x in p], "path string"))), "case_id", "xml_path", "mask_path", "mask_source")
    assert got == [("12", "/d/12_z.XML", None, "xml"), ("13", None, None, "none")]


def test_w7_sample_is_stable(spark):
    c = spark.createDataFrame([(f"c{i}",) for i in range(20)] + [("c1",), (None,)], "case_id string")
    a, b = (rows(S.sample_cases(c.repartition(n), 0.25, 3), "case_id") for n in (1, 5))
    assert a == b and len(a) == 5
    assert S.sample_cases(c.limit(0), 0.5, 1).count() == 0


def test_inbox_stream(spark, folder, tmp_path_factory):
    out, ck = tmp_path_factory.mktemp("o"), tmp_path_factory.mktemp("k")
    for more in (False, True):
        if more:
            (folder / "new.png").write_bytes(codecs.encode_png(X / 20))
        inbox.run_inbox(spark, str(folder), lambda df: map_images(df, K.otsu), str(out), str(ck)).awaitTermination(120)
    got = spark.read.parquet(str(out))
    assert got.count() == 4 and got.select("image_id").distinct().count() == 4  # no file of the first run twice; sub/ is not listed


def test_k3_jpeg_is_read_by_another_decoder(spark, tmp_path):
    """The JVM's decoder gives the pixels back, but for the loss."""
    y, x = np.mgrid[:61, :83]
    grey = np.sin(x / 9) * 60 + np.cos(y / 7) * 50 + 128
    noise = np.random.default_rng(1).integers(0, 256, (16, 24))
    for n, image in enumerate((grey, np.stack([grey, grey[::-1], 255 - grey], 2), noise, np.zeros((1, 1)))):
        path = tmp_path / f"{n}.jpg"
        path.write_bytes(codecs.encode_jpeg(image))
        got = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.File(str(path)))
        h, w = image.shape[:2]
        assert (got.getHeight(), got.getWidth()) == (h, w)
        raster = got.getRaster()
        bands = raster.getNumBands()
        values = np.array(list(raster.getPixels(0, 0, w, h, spark.sparkContext._gateway.new_array(spark._jvm.int, w * h * bands)))).reshape(h, w, bands)
        want = image if image.ndim == 3 else image[:, :, None]
        assert np.abs(values - want).mean() < (25 if n == 2 else 3)


def test_only_wanted_files_are_decoded(spark, folder, monkeypatch):
    wanted = files.read_images(spark, str(folder), "a.dcm").select(F.col("file_path").alias("path"))
    got = files.read_images(spark, str(folder), only=wanted)
    assert [r.file_path.rsplit("/", 1)[-1] for r in got.collect()] == ["a.dcm"]
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_colour_masks_count(spark, tmp_path):
    x = np.zeros((2, 3, 3))
    x[1, 2, 1] = 9
    (tmp_path / "m.png").write_bytes(codecs.encode_png(x))
    assert files.read_masks(spark, str(tmp_path)).first().pixels == [0, 0, 0, 0, 0, 1]


def test_s17_ftp_folder(tmp_path, monkeypatch):
    import ftplib

    class Server:
        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        connect = login = cwd = lambda self, *a: None

        def nlst(self):
            return ["b.dcm", "sub", "a.dcm"]

        def retrbinary(self, command, write):
            if command.endswith("sub"):
                raise ftplib.error_perm("550 not a file")
            write(command.encode())

    monkeypatch.setattr(ftplib, "FTP", Server)
    got = files.download("ftp://host:2121/some/folder/", str(tmp_path))
    assert [p.rsplit("/", 1)[-1] for p in got] == ["a.dcm", "b.dcm"] and (tmp_path / "a.dcm").read_bytes() == b"RETR a.dcm" and len(list(tmp_path.iterdir())) == 2
