"""An inbox folder of image files as a stream, through the same stateless operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterloom.sources.files import _SCAN, SCAN_DDL, _arrow, _decode


def image_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Every new image file of ``folder`` as a row of the batch scan's columns, with its modification time."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("pathGlobFilter", "*.{dcm,DCM,png,PNG,tif,TIF}")
        .load(folder)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                yield _arrow([_decode(path, content.as_py())], _SCAN)

    return raw.select("path", "content").mapInArrow(run, SCAN_DDL)


def as_images(stream: DataFrame) -> DataFrame:
    """image_id (hash of the path), h, w, pixels of the readable one-channel images."""
    return stream.where("pixels is not null and c = 1").select(F.xxhash64("file_path").alias("image_id"), "h", "w", "pixels")


def run_inbox(spark: SparkSession, folder: str, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_trigger: int = 1000) -> StreamingQuery:
    """Apply an image operator to new files and append its rows to parquet, exactly once, until the inbox is empty."""
    rows = operator(as_images(image_stream(spark, folder, files_per_trigger)))
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
