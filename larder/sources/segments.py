"""Segments and log commits as Parquet directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.model import CorruptError, schema
from larder.operators.log import record_bytes
from larder.sources.manifest import Part

ROWS = schema("key binary, gen long, pos long, deleted boolean, value binary")


def write(df: DataFrame, path: str, gen: int, rate: float | None = None, rows: int = 0) -> tuple[Part, int]:
    """Write rows under path. With a rate, as a segment: sorted by key across files, so that footers
    prune key ranges, and with Parquet Bloom filters on the key sized to `rows`. Returns the part and its
    highest position, out of one look at what was written."""
    out = df.select("key", F.lit(gen).cast("long").alias("gen"), "pos", "deleted", F.when(~F.col("deleted"), F.col("value")).alias("value"))
    writer = out.write
    if rate is not None:
        out = out.repartitionByRange("key").sortWithinPartitions("key")
        writer = out.write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(rate)).option("parquet.bloom.filter.expected.ndv#key", str(max(1, rows)))
    writer.option("parquet.page.write-checksum.enabled", "true").parquet(path)
    spark = df.sparkSession
    *n, last = read_paths(spark, [path]).agg(F.count("*"), F.coalesce(F.sum(record_bytes(F.col("key"), F.col("value"))), F.lit(0)), F.count_if("deleted"), F.coalesce(F.max("pos"), F.lit(-1))).first()
    return Part(path, gen, *map(int, n)), int(last)


def read_paths(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of directories. Damage is an error, never a missing row: page checksums are verified and
    corrupt or missing files are not passed over."""
    reader = spark.read.schema(ROWS).option("parquet.page.verify-checksum.enabled", "true").option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false")
    return reader.parquet(*paths) if paths else spark.createDataFrame([], ROWS)


def verify(spark: SparkSession, parts: tuple[Part, ...]) -> None:
    """Every listed part has the rows its manifest says; one job, whatever the number of parts."""
    if not parts:
        return
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    found = {r["name"]: r["n"] for r in read_paths(spark, [p.path for p in parts]).groupBy(name.alias("name")).agg(F.count("key").alias("n")).collect()}
    for p in parts:
        n = found.get(p.path.rsplit("/", 1)[1], 0)
        if n != p.rows:
            raise CorruptError(f"{p.path} has {n} rows; its manifest says {p.rows}")


def directory_size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a folder, from their listing: no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def copy_directory(spark: SparkSession, source: str, target: str) -> None:
    """Copy a folder with all it holds, through Hadoop's file system API."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, conf):
        raise OSError(f"could not copy {source} to {target}")
