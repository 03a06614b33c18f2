"""Shared scratch tables: how operators cut lineage so that a lost executor costs one stage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all machines share. spark.checkpoint.dir names it; only where that is unset and Spark
    runs in one process (tests) a local temporary folder stands in."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="larder-"))
        current = sc.getCheckpointDir()
    return current


_scopes: list[list[Scratch]] = []


class Scratch:
    """Parquet tables under the shared folder, dropped as soon as no later step reads them. What a lazy
    result still reads stays until the scope ends in which it was made; without one, it stays."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        for made in _scopes:
            made.append(self)

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df once and return a scan of what was written."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that keep() returned and nothing reads any more."""
        for t in tables:
            self._delete(t._scratch_path)

    def drop_all(self) -> None:
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope() -> Iterator[None]:
    """Drops, at its end, every scratch table that was made in it. The results read from them have to be
    written by then."""
    made: list[Scratch] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.pop()
        for scratch in made:
            scratch.drop_all()
