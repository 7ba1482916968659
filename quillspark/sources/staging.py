"""Staged intermediate tables: a plan is cut by writing its rows to the folder that all executors share.

A staged table survives the loss of any executor, unlike cached or locally checkpointed blocks, and Parquet keeps it small.
All tables of one application lie in one folder of their own; :func:`discard` deletes it when its results are no longer read.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only where none is set and Spark runs in one process, which
    goes when that process ends."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quillspark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def _own(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/staged-{spark.sparkContext.applicationId}"


#: Shuffle files go as soon as the query that wrote them is over, not when the driver happens to collect its garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once and return a reader of what was written; what was shuffled for it is deleted."""
    spark = df.sparkSession
    path = f"{_own(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the staged tables that ``df`` reads; neither it nor what is made of it can be used afterwards."""
    spark = df.sparkSession
    jvm, own = spark.sparkContext._jvm, f"/staged-{spark.sparkContext.applicationId}/"
    for path in {f.rpartition("/")[0] for f in df.inputFiles() if own in f}:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(spark: SparkSession) -> None:
    """Delete all tables that this application staged.  Frames that read them can't be used afterwards."""
    jvm, path = spark.sparkContext._jvm, _own(spark)
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
