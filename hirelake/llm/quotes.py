"""Quotation linking: quoted passages find the messages they come from. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import materialise, with_rank
from hirelake.llm.graph import components

#: The marks in front of a quoted line, as many as its level.
MARKS = r"^[ \t]*(?:>[ \t]*)+"
TURNS = 1024


def with_lines(text: Column) -> Column:
    """array<struct<level, words>> of the lines of a text: how deep each is quoted, and the line without its marks."""
    lines = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    level = lambda line: F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))
    return F.transform(lines, lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("words")))


def passages(lines: Column, level: Column) -> Column:
    """Normalised passages of one level: neighbouring lines of it up to a blank one, in lower case, single-spaced."""
    own = F.transform(lines, lambda x: F.when(x["level"] == level, F.trim(x["words"])).otherwise(""))
    plain = F.transform(F.split(F.array_join(own, "\n"), "\n[ \t]*\n", -1), lambda p: F.trim(F.lower(F.regexp_replace(p, r"\s+", " "))))
    return F.filter(plain, lambda p: p != "")


def _digests(found: Column) -> Column:
    return F.transform(found, lambda p: F.struct(F.xxhash64(p).alias("h"), F.xxhash64(F.reverse(p)).alias("g")))


def linked_messages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, thread_id, position, reply_conv_id, reply_turn, n_quoted, n_linked, text) of each message.

    Lines that start with `>` marks are quoted, one level per mark. A passage is a run of lines of one level up to a blank
    line; its digest, free of case and spacing, is joined to the digests of what messages say themselves. The original is
    the first message of the same conversation that says it, if that came before; else, of all messages that say it, the
    first by (conv_id, turn), if its conversation has a smaller id: copies of an original take no link away. reply_conv_id and reply_turn name the original of the
    shallowest linked passage (the latest of several), null where nothing is linked. thread_id is the smallest
    conversation id that such links lead to; `position` counts a conversation's messages from 1 by turn, and as originals
    come before, (thread_id, conv_id, position) is an order of replies. `text` is the message without quoted lines.

    Lines and passages stay inside their row; only digests are shuffled, grouped map-side, so a passage that a third of
    all messages share costs a row per task. Positions are summed from parts (`with_rank`): no task holds a conversation.
    Null text: empty. Null conv_id: a message of no conversation: position 0, thread null, linked to the
    first original that has one. Null turn: position after smaller ones counts it as 0, and it quotes nothing of its own conversation.
    Messages alike in conv_id, turn, role and text are one. Empty table: no rows. Other columns are not read.
    """
    rows = messages.select("conv_id", "turn", "role", "text").withColumn("fp", F.xxhash64("role", "text"))
    rows = rows.dropDuplicates(["conv_id", "turn", "fp"]).withColumn("lines", with_lines(F.col("text")))
    levels = F.array_distinct(F.filter(F.transform("lines", lambda x: x["level"]), lambda n: n > 0))
    at_level = lambda n: F.transform(_digests(passages(F.col("lines"), n)), lambda d: F.struct(n.alias("level"), d["h"].alias("h"), d["g"].alias("g")))
    said = F.filter("lines", lambda x: x["level"] == 0)
    rows = rows.select(
        "conv_id", "turn", "role", "fp",
        F.trim(F.array_join(F.transform(said, lambda x: x["words"]), "\n"), F.lit("\n")).alias("text"),
        _digests(passages(F.col("lines"), F.lit(0))).alias("said"),
        F.flatten(F.transform(levels, at_level)).alias("quoted"),
    )
    rows = materialise(rows, "messages")
    source = F.struct("conv_id", "turn")
    says = rows.select("conv_id", "turn", F.explode(F.array_distinct("said")).alias("d")).select("conv_id", "turn", "d.h", "d.g")
    here = says.filter("conv_id IS NOT NULL").groupBy("conv_id", "h", "g").agg(F.min("turn").alias("first_turn"))
    anywhere = says.groupBy("h", "g").agg(F.min(F.when(F.col("conv_id").isNotNull(), source)).alias("only"))
    asks = rows.select("conv_id", "turn", "fp", F.explode("quoted").alias("q")).select("conv_id", "turn", "fp", "q.level", "q.h", "q.g")
    met = asks.join(here, ["conv_id", "h", "g"], "left").join(anywhere, ["h", "g"], "left")
    same = F.col("first_turn") < F.col("turn")
    other = (F.col("only.conv_id") < F.col("conv_id")) | (F.col("conv_id").isNull() & F.col("only.conv_id").isNotNull())
    origin = F.when(same, F.struct(F.col("conv_id"), F.col("first_turn").alias("turn"))).when(other, F.col("only"))
    met = met.withColumn("origin", origin)
    best = F.max(F.when(F.col("origin").isNotNull(), F.struct((-F.col("level")).alias("near"), "origin"))).alias("best")
    links = met.groupBy("conv_id", "turn", "fp").agg(
        F.count("*").alias("n_quoted"), F.count("origin").alias("n_linked"), best
    ).select("conv_id", "turn", "fp", "n_quoted", "n_linked", F.col("best.origin").alias("origin"))
    links = materialise(links, "quotes")
    across = links.filter("origin.conv_id <> conv_id").select(F.col("conv_id").alias("a"), F.col("origin.conv_id").alias("b"))
    threads = components(across).select(F.col("id").alias("conv_id"), F.col("component").alias("thread"))
    keyed = rows.drop("said", "quoted").withColumns(
        {
            "_conv": F.coalesce("conv_id", F.lit(0)),
            "_block": F.floor(F.coalesce("turn", F.lit(0)) / TURNS).cast("long"),
            "_turn": F.pmod(F.coalesce("turn", F.lit(0)), F.lit(TURNS)).cast("long"),
        }
    )
    placed = with_rank(keyed.filter("conv_id IS NOT NULL"), "_conv", "_block", "_turn", [F.col("fp")], "position")
    loose = keyed.filter("conv_id IS NULL").withColumn("position", F.lit(0).cast("long"))
    every = placed.unionByName(loose).alias("m").join(threads, "conv_id", "left")
    asked = links.select(
        F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("fp").alias("_f"), "n_quoted", "n_linked", "origin"
    )
    on = (F.col("fp") == F.col("_f")) & F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t"))
    return every.join(asked, on, "left").select(
        "conv_id", "turn", "role", F.coalesce("thread", "conv_id").alias("thread_id"), "position",
        F.col("origin.conv_id").alias("reply_conv_id"), F.col("origin.turn").alias("reply_turn"),
        F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "text",
    )
