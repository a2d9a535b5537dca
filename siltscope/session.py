"""What every operator needs from the Spark session: code on the workers, and the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_made: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application.

    Rows that hold texts go to Python in batches of a thousand at most, unless the session asks for another number: with the
    default of ten thousand a batch of long texts takes tens of MB on both sides.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "1000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    path = os.path.join(tempfile.mkdtemp(prefix="siltscope-"), "siltscope.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, str(p.relative_to(_PACKAGE.parent)))
    spark.sparkContext.addPyFile(path)
    atexit.register(shutil.rmtree, os.path.dirname(path), True)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = "file://" + tempfile.mkdtemp(prefix="siltscope-shared-")
        spark.sparkContext.setCheckpointDir(_made[app])
    return _made[app]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one. It is removed when the driver ends."""
    path = f"{shared_dir(spark)}/siltscope/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have been stopped before the interpreter ends
        if path.startswith("file:"):
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its scan has fewer partitions than that, as a table of one small file has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{work_dir(spark, name)}/t"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove a table of cut() before the driver ends; nothing may read it any more."""
    _remove(df.sparkSession, df.cut_path)
