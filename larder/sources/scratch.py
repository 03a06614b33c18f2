"""Where a query may put a stored table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all machines share: below spark.checkpoint.dir, or, where that is unset (tests
    on one machine), below a local temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    root = named or "file://" + tempfile.mkdtemp(prefix="larder-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of folder()'s."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file wherever Spark can."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
