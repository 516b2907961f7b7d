"""Same or near-same records across splits (problem 5).

Films of Test tasks that also are in Training tasks: the same patient, side and
view, or thumbnails that differ by at most MAX_DIFFERENCE on average. Near
copies are found by minwise hashing of quantised-pixel shingles with banded
buckets; only buckets that hold both splits give candidates. Chance meetings are
refused in the join itself by a sketch beside the key, the others are confirmed
by the exact Jaccard similarity and then the exact difference.

Thumbnails travel as packed bytes, a third of the array's size. Tables of
classes and buckets are joined by merge hints: the planner's estimate of them is
far too low (it counts an array as one element and a bucket table as one row per
class), so that it would broadcast them from the driver at many times the limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.identity import film_identity
from rasterloom.session import cut

PIXELS = 64
#: Greatest mean of absolute pixel differences of near-same thumbnails.
MAX_DIFFERENCE = 30
#: Width of a grey-level bin and the number of evenly shifted bin grids.
BIN, GRIDS = 512, 8
LEVELS = 4096 // BIN + 2
#: 32 bands of 5 minima. A shingle is (grid, pixel, bin). Over the grids a pixel
#: that moved by |d| changes at most |d| / BIN + 1 / GRIDS of its shingles, so
#: thumbnails within MAX_DIFFERENCE keep at least 1 - 30/512 - 1/8 = 0.816 of
#: theirs, a Jaccard similarity of 0.69 or more: no confirmed pair is below
#: MIN_JACCARD. Typical near copies reach 0.89, missed with odds under 1e-11.
BANDS, ROWS = 32, 5
MIN_JACCARD = 0.68
#: The sketch of a thumbnail: GROUPS sums of neighbouring pixels, cut to STEPS steps. Sums of thumbnails within
#: MAX_DIFFERENCE are less than one step apart, so their steps are equal or neighbours.
GROUPS, STEPS = 8, 16
STEP = PIXELS // GROUPS * 4096 // STEPS
assert PIXELS * MAX_DIFFERENCE < STEP


def _shingles(thumbs: np.ndarray) -> np.ndarray:
    """Shingle numbers, PIXELS x GRIDS a row: one for each pixel and shifted grid."""
    shift = np.arange(GRIDS) * (BIN // GRIDS)
    bins = (np.clip(thumbs, 0, 4095)[:, :, None] + shift) // BIN
    cell = np.arange(PIXELS)[:, None] * GRIDS + np.arange(GRIDS)
    return (cell * LEVELS + bins).reshape(len(thumbs), -1)


def _table(seed: int = 11) -> np.ndarray:
    """Hash of every possible shingle under every hash function."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**32, size=(PIXELS * GRIDS * LEVELS, BANDS * ROWS), dtype=np.uint32)


def band_keys(thumbs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band, the band's number mixed in."""
    out = np.empty((len(thumbs), BANDS), np.int64)
    for a in range(0, len(thumbs), 64):
        s = _shingles(thumbs[a : a + 64])
        minima = table[s[:, 0]].copy()
        for j in range(1, s.shape[1]):
            np.minimum(minima, table[s[:, j]], out=minima)
        m = minima.reshape(len(s), BANDS, ROWS).astype(np.uint64)
        key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(s), 1))
        for r in range(ROWS):
            key = (key ^ m[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out[a : a + 64] = key.view(np.int64)
    return out


def pack(thumbs: np.ndarray) -> list[bytes]:
    """Rows as bytes: 12 bits a pixel where all pixels fit in, else 32. Equal rows, and only they, have equal bytes."""
    fits = ((thumbs >= 0) & (thumbs < 4096)).all(axis=1)
    v = np.where(fits[:, None], thumbs, 0).astype(np.uint16)
    even, odd = v[:, 0::2], v[:, 1::2]
    out = np.stack([even & 255, even >> 8 | (odd & 15) << 4, odd >> 4], axis=2).astype(np.uint8).reshape(len(v), -1)
    return [out[i].tobytes() if fits[i] else thumbs[i].astype("<i4").tobytes() for i in range(len(thumbs))]


def unpack(packed: list[bytes]) -> np.ndarray:
    """The rows that ``pack`` made bytes of."""
    out = np.empty((len(packed), PIXELS), np.int64)
    size = np.array([len(x) for x in packed], np.int64)
    wide = size == 4 * PIXELS
    b = np.frombuffer(b"".join(x for x, w in zip(packed, wide) if not w), np.uint8).reshape(-1, PIXELS // 2, 3).astype(np.int64)
    out[~wide] = np.stack([b[:, :, 0] | (b[:, :, 1] & 15) << 8, b[:, :, 1] >> 4 | b[:, :, 2] << 4], axis=2).reshape(-1, PIXELS)
    out[wide] = np.frombuffer(b"".join(x for x, w in zip(packed, wide) if w), "<i4").reshape(-1, PIXELS)
    return out


def sketches(thumbs: np.ndarray) -> np.ndarray:
    """32 bits a row: the steps of its groups' sums, two rows by four columns of the thumbnail a group."""
    sums = np.clip(thumbs, 0, 4095).reshape(-1, 4, 2, 2, 4).sum(axis=(2, 4)).reshape(-1, GROUPS)
    return ((sums // STEP) << (4 * np.arange(GROUPS))).sum(axis=1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        thumbs = b.column("thumb").flatten().to_numpy(zero_copy_only=False).reshape(-1, PIXELS)
        names = [n for n in b.schema.names if n != "thumb"]
        yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(pack(thumbs), pa.binary())], [*names, "packed"])


def _band_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _table()
    for b in batches:
        thumbs = unpack(b.column("packed").to_pylist())
        cells = (band_keys(thumbs, table) & ~np.int64(0xFFFFFFFF)) | sketches(thumbs)[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(cells.reshape(-1)), pa.array(np.repeat(b.column("thumb_no").to_numpy(), BANDS))], ["cell", "thumb_no"])


def _unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.assign(**{c: list(unpack(f[c].tolist()).astype(np.int32)) for c in ("a", "b")})


def _buckets(classes: DataFrame, cell: str, name: str) -> DataFrame:
    """One row per class and band: half of the band's key and, in the lower 32 bits, the sketch."""
    return classes.select("packed", "thumb_no").mapInArrow(_band_batches, "cell bigint, thumb_no bigint").toDF(cell, name).hint("merge")


def candidates(classes: DataFrame) -> DataFrame:
    """Pairs (test_no, train_no) of different classes that share a bucket and whose sketches allow MAX_DIFFERENCE.

    The buckets of the two splits meet in the join, so only cross-split pairs ever exist; each side is shuffled once, and a
    hot bucket is split by AQE.
    """
    a, b = F.col("test_cell"), F.col("train_cell")
    meet = F.shiftright(a, 32) == F.shiftright(b, 32)
    for i in range(GROUPS):
        step = lambda x: F.shiftright(x, 4 * i).bitwiseAND(F.lit(STEPS - 1))  # noqa: B023, E731
        meet = meet & (F.abs(step(a) - step(b)) <= 1)
    return (
        _buckets(classes.where("in_test"), "test_cell", "test_no")
        .join(_buckets(classes.where("in_train"), "train_cell", "train_no"), meet & (F.col("test_no") != F.col("train_no")))
        .select("test_no", "train_no")
        .distinct()
    )


def _grid_hits(a: Column, b: Column) -> Column:
    """Shingles that two thumbnails share, of PIXELS x GRIDS.

    The grids' bin borders together are the multiples of BIN / GRIDS, each the
    border of one grid; two grey levels with n such borders between them differ
    in n grids, or in all.
    """
    bits = (BIN // GRIDS).bit_length() - 1
    step = lambda x: F.shiftright(F.least(F.greatest(x, F.lit(0)), F.lit(4095)), bits)
    per = lambda x, y: F.lit(GRIDS) - F.least(F.abs(step(x) - step(y)), F.lit(GRIDS))
    return F.aggregate(F.zip_with(a, b, per), F.lit(0), lambda s, v: s + v)


def films_with_split(samples: DataFrame) -> DataFrame:
    """sample_id, source, is_test, identity columns and thumb of the rows whose task can be read.

    Thumbs that are not PIXELS values without nulls count as absent.
    """
    f = samples.where("sample_id is not null").select("sample_id", "source", "thumb", *[c.alias(n) for n, c in film_identity().items()])
    whole = (F.size("thumb") == PIXELS) & ~F.exists("thumb", lambda v: v.isNull())
    return f.where("f_task is not null").select(
        "sample_id", "source", F.col("f_task").endswith("Test").alias("is_test"), "f_patient", "f_side", "f_view", F.when(whole, F.col("thumb")).alias("thumb")
    )


def _hashes() -> list[Column]:
    """128 bits of hash, null without a thumb. Classes are made of equal bytes; these only lead a row to its class."""
    there = F.col("thumb").isNotNull()
    return [F.when(there, F.xxhash64("thumb")).alias("h"), F.when(there, F.xxhash64(F.lit(1), "thumb")).alias("h2")]


def film_rows(films: DataFrame) -> DataFrame:
    """sample_id, is_test, source, film (null if a part of it cannot be read) and 128 bits of hash for each thumb.

    The spellings are read here once, without the thumbs.
    """
    film = F.when(F.col("f_patient").isNotNull() & F.col("f_side").isNotNull() & F.col("f_view").isNotNull(), F.concat_ws("|", "f_patient", "f_side", "f_view"))
    return cut(films.select("sample_id", "is_test", "source", film.alias("film"), *_hashes()))


def _same_film(rows: DataFrame) -> DataFrame:
    """(test row, training row) of one patient, side and view; unreadable parts match nothing."""
    full = rows.where("film is not null")
    return (
        full.where("is_test").select("film", F.col("sample_id").alias("test_id"))
        .join(full.where("not is_test").select("film", F.col("sample_id").alias("train_id")), "film")
        .select("test_id", "train_id")
    )


def near_thumbs(films: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Confirmed pairs of different thumb texts, and the thumb class of every row.

    Equal thumbnails are one class (thumb_no is its least row), so copies are
    hashed and compared once. Returns pairs (test_no, train_no, jaccard,
    difference), each class with itself included, and all rows as members
    (sample_id, is_test, source, film, thumb_no; null thumb_no without a thumb).
    ``rows``: ``film_rows(films)``, if it is there already.
    """
    rows = film_rows(films) if rows is None else rows
    with_thumb = films.where("thumb is not null").select("sample_id", "is_test", *_hashes(), "thumb")
    classes = cut(
        with_thumb.mapInArrow(_packed, "sample_id bigint, is_test boolean, h bigint, h2 bigint, packed binary")
        .groupBy("packed")
        .agg(F.min("sample_id").alias("thumb_no"), F.max("is_test").alias("in_test"), F.min("is_test").alias("all_test"), F.min("h").alias("h"), F.min("h2").alias("h2"))
        .select("packed", "thumb_no", "in_test", (~F.col("all_test")).alias("in_train"), "h", "h2")
    )
    members = rows.join(classes.select("h", "h2", "thumb_no").hint("merge"), ["h", "h2"], "left").select("sample_id", "is_test", "source", "film", "thumb_no")
    side = lambda no, as_: classes.select(F.col("thumb_no").alias(no), F.col("packed").alias(as_)).hint("merge")
    shared = _grid_hits(F.col("a"), F.col("b"))
    total = F.lit(2 * PIXELS * GRIDS)
    l1 = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, v: s + v)
    near = (
        candidates(classes)
        .join(side("test_no", "a"), "test_no")
        .join(side("train_no", "b"), "train_no")
        .select("test_no", "train_no", "a", "b")
        .mapInPandas(_unpacked, "test_no bigint, train_no bigint, a array<int>, b array<int>")
        .withColumn("shared", shared)
        .withColumn("jaccard", F.col("shared") / (total - F.col("shared")))
        .where(F.col("jaccard") >= MIN_JACCARD)
        .withColumn("difference", l1 / PIXELS)
        .where(F.col("difference") <= MAX_DIFFERENCE)
        .select("test_no", "train_no", "jaccard", "difference")
    )
    same = classes.where("in_test and in_train").select(F.col("thumb_no").alias("test_no"), F.col("thumb_no").alias("train_no"), F.lit(1.0).alias("jaccard"), F.lit(0.0).alias("difference"))
    return near.unionByName(same), members


def cross_split_pairs(films: DataFrame) -> DataFrame:
    """All overlapping (test_id, train_id) row pairs, each once. Empty for an empty table."""
    rows = film_rows(films)
    pairs, members = near_thumbs(films, rows)
    members = members.where("thumb_no is not null")
    near = (
        pairs.join(members.where("is_test").select(F.col("thumb_no").alias("test_no"), F.col("sample_id").alias("test_id")), "test_no")
        .join(members.where("not is_test").select(F.col("thumb_no").alias("train_no"), F.col("sample_id").alias("train_id")), "train_no")
        .select("test_id", "train_id")
    )
    return near.unionByName(_same_film(rows)).distinct()


def found_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("test_id", "train_id").alias("sample_id_a"), F.greatest("test_id", "train_id").alias("sample_id_b"))


def overlap_report(films: DataFrame) -> DataFrame:
    """Per split and source: rows, rows with a partner in the other split, and pairs.

    Pairs are counted, never listed: a row's partners are those of near thumbs
    (sizes of the classes its class is near to) and those of the same film (rows
    of its patient, side and view in the other split), less those that are both.
    Null sources are one source;
    exact repetitions of a row count once. Empty for an empty table.
    """
    pairs, members = near_thumbs(films)
    pairs = cut(pairs.select("test_no", "train_no"))
    # rows of one class, film, source and split are alike, so the rest of the work is on their counts
    alike = cut(members.distinct().groupBy("is_test", "source", "film", "thumb_no").agg(F.count("*").alias("rows")))
    both_ways = pairs.select(F.lit(True).alias("is_test"), F.col("test_no").alias("thumb_no"), F.col("train_no").alias("other_no")).unionByName(
        pairs.select(F.lit(False).alias("is_test"), F.col("train_no").alias("thumb_no"), F.col("test_no").alias("other_no"))
    )
    other = lambda *by: alike.where(" and ".join(f"{c} is not null" for c in by)).groupBy((~F.col("is_test")).alias("is_test"), *by).agg(F.sum("rows").alias("n"))
    sizes = other("thumb_no").withColumnRenamed("thumb_no", "other_no")
    near = both_ways.join(sizes, ["is_test", "other_no"]).groupBy("is_test", "thumb_no").agg(F.sum("n").alias("near"))
    same = other("film").withColumnRenamed("n", "same")
    both = (
        alike.where("film is not null and thumb_no is not null").select("is_test", "film", "thumb_no").distinct()
        .join(both_ways, ["is_test", "thumb_no"])
        .join(other("film", "thumb_no").withColumnRenamed("thumb_no", "other_no"), ["is_test", "film", "other_no"])
        .groupBy("is_test", "film", "thumb_no").agg(F.sum("n").alias("both"))
    )
    n = F.coalesce("near", F.lit(0)) + F.coalesce("same", F.lit(0)) - F.coalesce("both", F.lit(0))
    got = alike.join(near, ["is_test", "thumb_no"], "left").join(same, ["is_test", "film"], "left").join(both, ["is_test", "film", "thumb_no"], "left").withColumn("n", n)
    return (
        got.groupBy(F.when(F.col("is_test"), "Test").otherwise("Training").alias("split_name"), "source")
        .agg(F.sum("rows").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("rows"))), F.lit(0)).alias("n_overlapping"), F.sum(F.col("rows") * F.col("n")).alias("n_pairs"))
    )
