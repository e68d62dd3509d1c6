"""Tables by name, and snapshots swapped by pointer.

Plain files have no row-level update: a new state goes to a new version folder, then a one-line
pointer file is replaced. Readers resolve the pointer once, so they see one version or the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pointer(spark: SparkSession, path: str):
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(f"{path}/current.txt")
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def current_version(spark: SparkSession, path: str) -> str | None:
    pointer, fs = _pointer(spark, path)
    if not fs.exists(pointer):
        return None
    return spark.read.text(f"{path}/current.txt").first()[0]


def write_snapshot(df: DataFrame, path: str, version: str, partition_by: list[str] | None = None) -> str:
    """Write one version and make it current. Writing a version again gives the same state."""
    spark = df.sparkSession
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/v={version}")
    pointer, fs = _pointer(spark, path)
    out = fs.create(pointer, True)
    out.write(bytearray(version.encode()))
    out.close()
    return version


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_buckets(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write rows into folders by the hash of `key`; only the buckets that `df` has rows for are replaced.

    `df` holds all rows of those buckets and must not read from `path` any more. A bucket is one task, so its number is
    chosen by the size of the table: at 100 TB, tens of thousands.
    """
    rows = df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_buckets(spark: SparkSession, path: str, key: str, touched: DataFrame, buckets: int) -> DataFrame:
    """All rows of the buckets that hold any key of `touched`: other folders are not listed into the scan."""
    numbers = touched.select(bucket_of(key, buckets).alias("bucket")).distinct().collect()  # at most `buckets` numbers
    return spark.read.parquet(path).filter(F.col("bucket").isin([r.bucket for r in numbers])).drop("bucket")


def read_snapshot(spark: SparkSession, path: str, version: str | None = None) -> DataFrame | None:
    version = version or current_version(spark, path)
    return None if version is None else spark.read.parquet(f"{path}/v={version}")
