"""What the operators share: table reads, saved intermediate results, text hashes."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgold.sources.shared import new_folder, shared_folder

#: A word is a longest run of characters other than these six (space, tab to carriage return).
BLANKS = r"\x20\x09-\x0D"
WORD = f"[^{BLANKS}]+"


def ship(spark: SparkSession) -> None:
    """Send this library's code to the executors, once per Spark application (as ``--py-files`` does)."""
    context = spark.sparkContext
    if getattr(context, "_fleetgold_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "fleetgold"), "zip", root, "fleetgold")
    context.addPyFile(archive)
    context._fleetgold_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, with its lineage cut.

    Spark removes the files when nothing refers to them any more, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    if not df.sparkSession.sparkContext.getCheckpointDir():
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


#: Folders of this driver's intermediate results; what is still there when the driver ends goes then.
_folders: dict[str, SparkSession] = {}


@atexit.register
def _remove_folders() -> None:
    for folder, spark in _folders.items():
        try:
            _remove(spark, folder)
        except Exception:  # the JVM may be gone already
            return


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as compressed Parquet below the shared folder and reread: for wide rows.

    Small row groups, as a writer holds one of each task in memory. The files stay until ``discard`` or the driver's end, as
    results that read them may be lazy.
    """
    folder = new_folder(df.sparkSession, purpose)
    _folders[folder] = df.sparkSession
    df.write.option("compression", "zstd").option("parquet.block.size", str(16 << 20)).parquet(folder)
    read = df.sparkSession.read.schema(df.schema).parquet(folder)
    read._folder = folder
    return read


def discard(df: DataFrame) -> None:
    """Delete the files of a ``written`` result that nothing reads any more."""
    _remove(df.sparkSession, df._folder)
    _folders.pop(df._folder, None)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of results that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_of(column: str = "text") -> Column:
    """The text, a null one as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of an id written as decimal text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def python_tasks(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of one Arrow batch, so that very long texts fit a worker's memory; ship the code."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    room = x >> np.uint64(30)
    x ^= room
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=room)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=room)
    return x


def seeds(n: int, seed: int = 1) -> np.ndarray:
    """n odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
