"""Session defaults for local runs; on a cluster the submitted configuration wins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "hirelake", memory: str = "8g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only for local runs that set none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="hirelake-")


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one run's files."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[str] = []


def cut_lineage(df: DataFrame, reader: SparkSession | None = None) -> DataFrame:
    """`df` written once to the shared folder and read back: a lost executor costs no recomputation, later steps read only
    the columns they need, and joins know the real size. `clear_scratch` removes what a job has written so. `reader` is the
    session that goes on with it, where that is another one."""
    path = run_folder(df.sparkSession, "cut")
    df.write.parquet(path)
    _SCRATCH.append(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> None:
    """Deletes the files of `cut_lineage` so far; call it once what was built from them is written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _SCRATCH:
        path = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(conf).delete(path, True)
