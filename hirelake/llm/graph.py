"""Connected components of a link table, and the union-find that tasks use on what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b): component is the smallest id that links lead to.

    Each round takes the smallest label among the neighbours, then the label of one's label, so long chains halve. Both
    joins have one row per key on one side and files on both, so the skew rule splits a hub; rounds end when no label
    moves. Only counts reach the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = materialise(both.filter("a <> b").distinct(), "links")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "a"), "a").groupBy(F.col("b").alias("id")).agg(F.min("label").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = materialise(hooked, "labels")
        up = hooked.select(F.col("id").alias("label"), F.col("label").alias("up"))
        jumped = materialise(hooked.join(up, "label").select("id", "old", F.col("up").alias("label")), "labels")
        moved = jumped.filter("label <> old").count()
        labels = jumped.select("id", "label")
        if not moved:
            return labels.withColumnRenamed("label", "component")


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """True if i and j were apart."""
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
