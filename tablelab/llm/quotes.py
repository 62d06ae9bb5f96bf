"""Chat formatting by quotation linking.

Quoted lines (``>``, ``>>``, ...) are parsed into passages of one level; their normalised lines are hashed
and joined to the first message of the conversation that says them. The linked originals give every reply
its parent. Messages come back without quotes, ordered by thread: after the message they answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelab.operators.dataset import with_row_ids
from tablelab.session import materialize

QUOTE = r"^\s*(?:>\s?)+"
# A line such as "On Monday, A wrote:", directly before a quote.
INTRODUCTION = r"(?i)\b(?:wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"


def normalised(line):
    return F.trim(F.regexp_replace(F.lower(line), r"[\s>]+", " "))


def parse(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, place, level, line)``: the lines with words; level 0 is the message's own text."""
    lines = messages.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("place", "raw"))
    marks = F.regexp_extract("raw", QUOTE, 0)
    return lines.select(
        "conv_id", "turn", "place", (F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))).alias("level"),
        normalised(F.regexp_replace("raw", QUOTE, "")).alias("line")).filter("line <> ''")


def passages(lines: DataFrame) -> DataFrame:
    """``(conv_id, turn, place, level, passage, hash)`` of quoted lines: neighbours of one level are one
    passage."""
    by = Window.partitionBy("conv_id", "turn").orderBy("place")
    begins = (F.col("level") != F.coalesce(F.lag("level").over(by), F.lit(-1))).cast("int")
    return lines.withColumn("passage", F.sum(begins).over(by)).filter("level > 0").select(
        "conv_id", "turn", "place", "level", "passage", F.md5("line").alias("hash"))


def links(messages: DataFrame) -> DataFrame:
    """``(conv_id, turn, passage, level, original_turn, lines)`` of every quoted passage with an original.

    The original is the earlier message that first said most of the passage's lines; of several the
    latest. Lines meet through minima per (conversation, hash), never pair by pair.
    """
    lines = parse(messages).distinct()
    first = materialize(lines.filter("level = 0").groupBy(F.col("conv_id").alias("c_"), F.md5("line").alias("h_")).agg(
        F.min("turn").alias("original_turn")), "originals")
    quoted = passages(lines).join(first, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("hash") == F.col("h_")))
    votes = quoted.filter("original_turn < turn").groupBy("conv_id", "turn", "passage", "level", "original_turn").agg(
        F.count("*").alias("lines"))
    return votes.groupBy("conv_id", "turn", "passage", "level").agg(
        F.max_by("original_turn", F.struct("lines", "original_turn")).alias("original_turn"), F.max("lines").alias("lines"))


def ancestors(parents: DataFrame) -> DataFrame:
    """``(conv_id, turn, root_turn, depth)`` of replies, by pointer doubling: a chain of n replies takes
    log2(n) rounds."""
    state = materialize(parents.select("conv_id", "turn", F.col("parent_turn").alias("up"), F.lit(1).alias("depth")), "replies")
    while True:
        above = state.select(F.col("conv_id").alias("c_"), F.col("turn").alias("t_"), F.col("up").alias("u_"), F.col("depth").alias("d_"))
        joined = state.join(above, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("up") == F.col("t_")), "left")
        if not joined.filter("t_ is not null").limit(1).count():
            return state.withColumnRenamed("up", "root_turn")
        state = materialize(joined.select(
            "conv_id", "turn", F.coalesce("u_", "up").alias("up"),
            (F.col("depth") + F.coalesce("d_", F.lit(0))).alias("depth")), "replies")


def without_quotes(text):
    """The text without quoted lines and without the lines that introduce them."""
    lines = F.split(text, "\n")
    after = F.concat(F.slice(lines, 2, F.size(lines)), F.array(F.lit("")))
    own = F.filter(F.arrays_zip(lines.alias("line"), after.alias("after")), lambda x: ~(
        x["line"].rlike(QUOTE) | (x["line"].rlike(INTRODUCTION) & x["after"].rlike(QUOTE))))
    return F.regexp_replace(F.array_join(F.transform(own, lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")


def reply_order(messages: DataFrame) -> DataFrame:
    """One row per message: ``conv_id, turn, role, body, parent_turn, root_turn, depth, n_quotes,
    position, formatted``.

    ``parent_turn`` is the original of the shallowest linked quote. A thread is a message without a
    parent and its replies; ``position`` counts a conversation's messages by thread, then depth, then
    turn, so a reply stands after what it answers. ``formatted`` is the body after a role tag. Null text
    gives an empty body. Rows with one (conv_id, turn) count as one message for links, and each is
    returned. A message without turn has no links and comes first.
    """
    found = materialize(links(messages), "links")
    parents = found.groupBy("conv_id", "turn").agg(
        F.min_by("original_turn", F.struct("level", "passage")).alias("parent_turn"), F.count("*").alias("n_quotes"))
    placed = parents.alias("p").join(ancestors(parents).alias("a"), F.col("p.conv_id").eqNullSafe(F.col("a.conv_id")) & (
        F.col("p.turn") == F.col("a.turn"))).select(
        F.col("p.conv_id").alias("c_"), F.col("p.turn").alias("t_"), "parent_turn", "n_quotes", "root_turn", "depth")
    rows = messages.select("conv_id", "turn", "role", without_quotes(F.coalesce("text", F.lit(""))).alias("body"))
    joined = rows.join(placed, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("turn") == F.col("t_")), "left").select(
        "conv_id", "turn", "role", "body", "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"))
    order = ["conv_id", "root_turn", "depth", "turn", "role", "body"]
    # a global sort splits even one huge conversation; positions are places in the written table
    numbered = with_row_ids(materialize(joined.repartitionByRange(*order).sortWithinPartitions(*order), "ordered"), "at")
    starts = materialize(numbered.groupBy(F.col("conv_id").alias("c_")).agg(F.min("at").alias("begin")), "starts")
    return numbered.join(starts, F.col("conv_id").eqNullSafe(F.col("c_"))).select(
        "conv_id", "turn", "role", "body", "parent_turn", "root_turn", "depth", "n_quotes",
        (F.col("at") - F.col("begin")).alias("position"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), "body").alias("formatted"))
