"""Company CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.functions.text import trim_ws
from hirelake.operators.lists import company_filters
from hirelake.schema import COMPANY_INDUSTRIES

COLUMNS = ["name", "website", "careersUrl", "industry", "country"]


def scan_company_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw rows by header, every column text, with file and row number (1 = first data row).

    A row is numbered inside its file split, then shifted by the rows of the splits before it, so
    no file is numbered in one task.
    """
    df = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    missing = {c: F.lit(None).cast("string") for c in COLUMNS if c not in df.columns}
    rows = df.withColumns(missing).select(
        *COLUMNS, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("read_order"),
    )
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("file", "split").orderBy("read_order")))
    sizes = rows.groupBy("file", "split").agg(F.count("*").alias("_rows"))
    earlier = F.sum("_rows").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1))
    shift = sizes.select("file", "split", F.coalesce(earlier, F.lit(0)).alias("_shift"))
    return rows.join(shift, ["file", "split"]).select(*COLUMNS, "file", (F.col("_n") + F.col("_shift")).alias("row"))


def check_companies(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): good rows as companies to create, bad rows with a message and their data."""
    text = {c: F.nullif(trim_ws(F.col(c)), F.lit("")) for c in COLUMNS}
    industry = F.upper(text["industry"])
    message = F.when(text["name"].isNull(), "Name is required").when(
        ~industry.isin(COMPANY_INDUSTRIES), "Invalid industry. Allowed values: " + ", ".join(COMPANY_INDUSTRIES)
    )
    checked = rows.withColumn("message", message)
    good = checked.filter(F.col("message").isNull()).select(
        text["name"].alias("name"), text["website"].alias("website"), text["careersUrl"].alias("careers_url"),
        industry.alias("industry"), text["country"].alias("country"), F.lit("PENDING").alias("status"),
    )
    bad = checked.filter(F.col("message").isNotNull()).select(
        "message", F.to_json(F.struct(*COLUMNS)).alias("data"), *[c for c in rows.columns if c not in COLUMNS]
    )
    return good, bad


def import_counts(rows: DataFrame) -> DataFrame:
    good, bad = check_companies(rows)
    return (
        good.select(F.lit(1).alias("ok"), F.lit(0).alias("failed"))
        .unionByName(bad.select(F.lit(0).alias("ok"), F.lit(1).alias("failed")))
        .agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("success_count"), F.coalesce(F.sum("failed"), F.lit(0)).alias("error_count"))
    )


def read_company_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return check_companies(scan_company_csv(spark, path))


def export_companies(companies: DataFrame, search=None, industry=None, status=None) -> DataFrame:
    """The six columns of an export, missing values blank."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return company_filters(companies, search, industry, status).select(
        "name", blank("website").alias("website"), blank("careers_url").alias("careersUrl"),
        blank("industry").alias("industry"), blank("country").alias("country"), "status", "created_at", "id",
    )


def write_company_csv(companies: DataFrame, path: str, **filters) -> None:
    """Newest first, as one sorted set of part files."""
    rows = export_companies(companies, **filters).orderBy(F.col("created_at").desc(), "id").drop("created_at", "id")
    rows.write.mode("overwrite").option("emptyValue", "").csv(path, header=True)
