"""Small relational helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Steps:
    """Stands for a frame while its columns are made: what is asked of it is kept, and done to any frame by `on`.

    Columns are built call by call in the JVM. Where they are many and always the same, one set serves all frames.
    """

    def __init__(self):
        self._calls: list[tuple[str, tuple]] = []

    def _keep(self, name: str, *args) -> Steps:
        self._calls.append((name, args))
        return self

    def withColumn(self, name: str, c: Column) -> Steps:
        return self._keep("withColumn", name, c)

    def withColumns(self, columns: dict[str, Column]) -> Steps:
        return self._keep("withColumns", columns)

    def filter(self, c: Column) -> Steps:
        return self._keep("filter", c)

    def select(self, *columns) -> Steps:
        return self._keep("select", *columns)

    def drop(self, *names: str) -> Steps:
        return self._keep("drop", *names)

    def on(self, df: DataFrame) -> DataFrame:
        for name, args in self._calls:
            df = getattr(df, name)(*args)
        return df


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First `n` rows of each key under `order`.

    Written as `row_number() <= n` so that Spark prunes every map task to n rows per key before the
    shuffle: a key that holds a third of the table costs its reducer only n rows per task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def first_wins(
    df: DataFrame,
    keys: list[list[str]],
    order: Column,
    checkpoint: Callable[[DataFrame], DataFrame],
    taken: DataFrame | None = None,
) -> DataFrame:
    """Rows an ordered insert keeps when every key in `keys` is unique (a NULL key never collides).

    A row goes in when no earlier row that went in shares a key with it, and none of `taken` (the rows
    that are in already, with the same key columns) does. Each round settles every
    row that is the first of all its keys, and every row one of those shuts out; a row waits for the
    next round only when what blocks it was itself blocked. Rounds go on until none waits, so the
    answer is exact; listings need one or two. Per-key firsts are plain aggregates joined back, so a
    hot key is combined map-side and its join is split by the skew rule. `order` names one row: rows that are equal in it
    are taken for repeats, of which one takes part.

    Rows are sorted and numbered once, and a key is known by the number of the first row that has it: the rounds move
    numbers alone, whatever the rows and keys hold.
    """
    # The number of a partition leads the numbers of its rows, and partitions are ranges of the order.
    numbered = checkpoint(
        df.withColumn("_at", order).dropDuplicates(["_at"]).repartitionByRange("_at").sortWithinPartitions("_at").drop("_at")
        .withColumn("_n", F.monotonically_increasing_id())
    )
    ids = [f"_key{i}" for i in range(len(keys))]
    rows = numbered.select("_n", *dict.fromkeys(c for key in keys for c in key))
    for key, name in zip(keys, ids):
        holders = rows.select(*key, "_n")
        if taken is not None:
            holders = holders.unionByName(taken.select(*key, F.lit(-1).cast("bigint").alias("_n")))
        firsts = holders.dropna(subset=key).groupBy(*key).agg(F.min("_n").alias(name))
        rows = rows.join(firsts, key, "left")
    free = reduce(lambda a, b: a & b, [F.coalesce(F.col(k) >= 0, F.lit(True)) for k in ids])
    waiting = checkpoint(rows.filter(free).select("_n", *ids))
    kept: list[DataFrame] = []
    while True:
        lead = waiting
        for i, k in enumerate(ids):
            lead = lead.join(waiting.dropna(subset=[k]).groupBy(k).agg(F.min("_n").alias(f"_first{i}")), k, "left")
        blocked = [F.coalesce(F.col(f"_first{i}") < F.col("_n"), F.lit(False)) for i in range(len(ids))]
        lead = checkpoint(lead.withColumn("_wins", ~reduce(lambda a, b: a | b, blocked)))
        winners = lead.filter("_wins").select("_n")
        kept.append(winners)
        # Only the first row of a key can have won it.
        waiting = lead.filter("NOT _wins")
        for i in range(len(ids)):
            waiting = waiting.join(winners.withColumnRenamed("_n", f"_first{i}"), f"_first{i}", "left_anti")
        waiting = waiting.select("_n", *ids)
        if waiting.isEmpty():
            return numbered.join(reduce(DataFrame.unionByName, kept), "_n", "left_semi").select(*df.columns)


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: list[str],
    right_id: list[str],
    pairs_per_task: int = 100_000,
) -> DataFrame:
    """Inner equi-join whose hot keys are cut into cells of about `pairs_per_task` pairs.

    A key with n rows left and m right becomes a grid of a x b cells: left rows fall into one of a
    rows of the grid by the hash of their id and are repeated for its b columns, right rows the other
    way round, with a : b as n : m, which copies least. Cold keys have one cell. The result is the
    plain join.
    """
    n, m = F.col("_n").cast("double"), F.col("_m").cast("double")
    cells = F.ceil(n * m / pairs_per_task)
    grid = (
        left.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .join(right.groupBy(*keys).agg(F.count("*").alias("_m")), keys)
        .withColumn("_a", F.greatest(F.lit(1), F.round(F.sqrt(cells * n / m))).cast("int"))
        .select(*keys, "_a", F.ceil(cells / F.col("_a")).cast("int").alias("_b"))
    )

    def placed(df: DataFrame, id_columns: list[str], own: str, other: str) -> DataFrame:
        return (
            df.join(grid, keys)
            .withColumn(f"_at{own}", F.pmod(F.xxhash64(*id_columns), F.col(own)).cast("int"))
            .withColumn(f"_at{other}", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("_a", "_b")
            # A fixed number: the rows are small but each pair is work, so byte-based coalescing
            # would put the pairs of many cells into one task.
            .repartition(tasks, *keys, *cell)
        )

    cell = ["_at_a", "_at_b"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed(left, left_id, "_a", "_b").join(placed(right, right_id, "_b", "_a"), [*keys, *cell]).drop(*cell)
