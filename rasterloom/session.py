"""Session helpers: table access, lineage cuts and partition sizing."""

from __future__ import annotations

import os
import pathlib
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

from rasterloom.errors import EngineError


#: Bytes of one Arrow batch to a Python worker: a batch of whole images is cut by its size, not only by its rows.
MOST_BATCH_BYTES = 64 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the input folder."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only a session on one
    machine (master ``local``) may do without: it gets a temporary folder. On a
    cluster such a folder would lie on each node's own disk, so it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise EngineError("spark.checkpoint.dir must name a folder that all executors share", 500)
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rasterloom-ckpt-"))
    return named or sc.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder, for tables that a query writes and reads again."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    Reliable checkpoints survive the loss of executors, unlike local ones.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    """The configured number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers and bound Arrow batches by bytes, once per application.

    With that, vectorised functions work on clusters whose nodes do not have the
    package on their path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_rasterloom_shipped", False):
        return
    if int(spark.conf.get(_BATCH_BYTES, str(2**31 - 1))) > MOST_BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(MOST_BATCH_BYTES))
    root = pathlib.Path(__file__).parent
    name = os.path.join(tempfile.mkdtemp(prefix="rasterloom-"), "rasterloom.zip")
    with zipfile.ZipFile(name, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    sc._rasterloom_shipped = True
