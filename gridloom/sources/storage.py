"""Shared storage for tables that must not be computed anew."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share (``spark.checkpoint.dir``); a temporary one only on a single machine without that setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, label: str = "table") -> str:
    """A path for a new folder in the shared one, deleted when the driver ends."""
    path, app = f"{shared_folder(spark)}/gridloom/{label}-{uuid.uuid4().hex}", spark.sparkContext.applicationId
    if app not in _MADE:
        _MADE[app] = []
        atexit.register(_drop, app)
    _MADE[app].append(path)
    return path


def _drop(app: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext.applicationId == app:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for p in _MADE.pop(app, []):
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def materialized(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, so that partition numbers and samples stay as they are."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish(df: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, which is computed and written only where there is none; it is there whole, or not at all.

    Each writer writes a folder of its own under ``path`` and then creates the file ``current``, which names it and can be
    created only once: the first writer's table is the one that is read, and others drop theirs. The name is one
    short write; a reader that finds the file still without it waits.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = jvm.org.apache.hadoop.fs.Path(f"{path}/current")
    fs = name.getFileSystem(conf)
    if not fs.exists(name):
        own = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{own}")
        try:
            out = fs.create(name, False)
            out.writeBytes(own)
            out.close()
        except Py4JJavaError:
            if not fs.exists(name):
                raise
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{own}"), True)
    for _ in range(600):
        if fs.getFileStatus(name).getLen() > 0:
            break
        time.sleep(0.1)
    held = spark.read.text(f"{path}/current").first()  # the one line of a manifest
    return spark.read.schema(df.schema).parquet(f"{path}/{held[0]}")


def in_batches(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], path: str, files: int = 8) -> DataFrame:
    """``work`` applied to the Parquet files in ``source``, some ``files`` at a time, as micro-batches over all there is.

    The input is listed and scanned once in all. Each batch's result goes to a folder of its number, which a repeated
    batch writes again; what is done is kept under ``path``, so that a run that was stopped goes on where it was, and a
    later run takes only new files. Rows that ``work`` needs together have to be in one file.
    """

    def write(rows: DataFrame, number: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    shape = work(spark.createDataFrame([], schema)).schema
    return spark.read.schema(shape).parquet(f"{path}/out")
