"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.session import run_folder

#: Characters that part words: blank and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`df`, written once to the folder that all executors share and read back.

    What follows starts from files, so a lost executor never reruns what came before.
    """
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_worker(kind: str, key: object, make):
    """One object of a kind per Python worker, made by the first task that asks for this key and kept for the next ones."""
    store = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker"))
    held = getattr(store, kind, None)
    if held is None or held[0] != key:
        setattr(store, kind, None)  # the old one goes before the new one comes
        held = (key, make())
        setattr(store, kind, held)
    return held[1]


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_rank(df: DataFrame, group: str, coarse: str, fine: str, order: list[Column], name: str) -> DataFrame:
    """`df` with the 1-based rank of each row in its group, ordered by (coarse, fine, *order).

    A sum of three small ranks, so that no task holds a whole group: rows are numbered inside a (group, coarse, fine)
    cell, cells inside (group, coarse), and coarse values inside the group; the last two run over counts only. `coarse`
    is a small number such as a size, `fine` takes few values, and none of the three columns is null.
    """
    cell = [group, coarse, fine]
    counts = df.groupBy(*cell).agg(F.count("*").alias("_n"))
    earlier = (W.unboundedPreceding, -1)
    in_coarse = W.partitionBy(group, coarse).orderBy(fine).rowsBetween(*earlier)
    in_group = W.partitionBy(group).orderBy(coarse).rowsBetween(*earlier)
    steps = (
        counts.groupBy(group, coarse)
        .agg(F.sum("_n").alias("_m"))
        .withColumn("_c", F.coalesce(F.sum("_m").over(in_group), F.lit(0)))
        .drop("_m")
    )
    offsets = (
        counts.withColumn("_f", F.coalesce(F.sum("_n").over(in_coarse), F.lit(0)))
        .join(steps, [group, coarse])
        .select(*cell, (F.col("_c") + F.col("_f")).alias("_before"))
    )
    inside = F.row_number().over(W.partitionBy(*cell).orderBy(*order))
    return (
        df.withColumn("_inside", inside)
        .join(offsets, cell)
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .drop("_before", "_inside")
    )
