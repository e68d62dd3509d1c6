"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.llm.common import WORD, with_rank

#: Documents of one source and size are numbered in so many parts.
PARTS = 64


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): shares by weight, none above `cap` times its size.

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share the sum of all sizes. What the caps cut off is
    shared again by weight until none is above. With sources ordered by cap per weight, source j is capped just if it
    would exceed its cap after all before it were: two running sums instead of rounds. The table has a row per source.
    """
    everything = W.partitionBy()
    ordered = sizes.withColumn("_w", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    by_ratio = W.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    earlier = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    limit = F.col("source_size") * cap
    room = F.sum("source_size").over(everything) - F.coalesce(F.sum(limit).over(earlier), F.lit(0.0))
    weight = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0))
    level = ordered.withColumn("_level", room / weight)
    capped = level.withColumn("_capped", limit <= F.col("_level") * F.col("_w"))
    left = F.sum("source_size").over(everything) - F.sum(F.when(F.col("_capped"), limit).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(~F.col("_capped"), F.col("_w")).otherwise(0)).over(everything)
    share = F.when(F.col("_capped"), limit).otherwise(F.col("_w") * (left / open_weight))
    return capped.select("source", "source_size", share.alias("target"))


def start_of(source: Column, seed: int) -> Column:
    """One number in [0, 1) per source, the same in every run: the first 32 bits of a digest."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\0")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def mixed(docs: DataFrame, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """(row, size, source_size, target, copies, taken) of each document; `row` holds all columns of `docs`.

    Every document of a source expects r = target / source_size copies, at most `cap`. Running sums of r over the source's
    documents, plus one offset, are cut at the integers: a document is emitted once per integer its step crosses, so r is
    met to within one document, and no document exceeds ceil(r) copies. Documents are ordered by size first, so each
    stretch of like sizes gets its share and the words taken come near the target.

    The running sum is r times a rank that is summed from small parts, so a source with a third of all rows is no task.
    Null text: size 0. Null source: a source of its own, last. Sources without a word: target 0. Rows alike in source,
    size and doc_id: ordered by a digest of the text. Empty table: no rows. Other columns are carried inside `row`.
    """
    return _with_copies(_sized(docs, docs.columns), cap, seed)


def mixed_sizes(docs: DataFrame, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """`mixed` without the documents themselves: doc_id, size, source_size, target, copies, taken; no text is shuffled."""
    return _with_copies(_sized(docs, ["doc_id"]), cap, seed).select("row.doc_id", "size", "source_size", "target", "copies", "taken")


def _sized(docs: DataFrame, kept: list[str]) -> DataFrame:
    return docs.select(
        F.struct(*kept).alias("row"),
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.xxhash64("text").alias("_tie"),
        word_count(F.col("text")).alias("size"),
        # One key without nulls; the letter in front keeps a null source apart from every name.
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_key"),
        F.coalesce(F.pmod(F.col("doc_id"), F.lit(PARTS)), F.lit(0)).alias("_part"),
    )


def _with_copies(sized: DataFrame, cap: float, seed: int) -> DataFrame:
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), cap)
    targets = targets.withColumn("_key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))).drop("source")
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    ranked = with_rank(sized, "_key", "size", "_part", order, "_rank").join(targets, "_key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    begin = start_of(F.col("source"), seed)
    copies = F.floor(F.col("_rank") * rate + begin) - F.floor((F.col("_rank") - 1) * rate + begin)
    taken = ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return taken.select("row", "size", "source_size", "target", "copies", "taken")


def emitted(docs: DataFrame, cap: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: each document as often as `mixed` says, with the columns of `docs`."""
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed(docs, cap, seed).filter("copies > 0").select("row", again.alias("_copy")).select("row.*")
