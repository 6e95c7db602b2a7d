"""Conversations as texts, and message trees in reading order."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from lakesight.functions.messages import body_text, is_visible, message_block
from lakesight.functions.text import WHITESPACE, rstrip, strip
from lakesight.operators.ordered import carry_last
from lakesight.session import materialize

def with_bodies(messages: DataFrame) -> DataFrame:
    """Messages with their body as ``text``: out of their parts where they have some, trimmed, NULL if blank."""
    if "parts" in messages.columns:
        body = body_text(F.col("content_type"), F.col("context"), F.col("parts"), F.col("attachments"))
    else:
        body = F.nullif(strip(F.col("text")), F.lit(""))
    return messages.withColumn("text", body)


def visible_messages(messages: DataFrame) -> DataFrame:
    """Messages a reader sees, with their body text: no system role, not hidden, not blank."""
    hidden = F.col("hidden") if "hidden" in messages.columns else None
    return with_bodies(messages).where(is_visible(F.col("role"), hidden) & F.col("text").isNotNull())


def transcripts(messages: DataFrame, turns: int, markdown: bool = False) -> DataFrame:
    """Text of every conversation, one row per part of ``turns`` turns that has a message.

    The part size is the caller's and part of the result: turns 0 to ``turns`` - 1 are
    part 0, and so on. Reading the parts of a conversation in order gives its exact
    transcript, and no cell holds more than one part.
    """
    shown = visible_messages(messages)
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown"))
    block = message_block(role, F.col("text"), markdown)
    part = F.floor(F.col("turn") / turns).cast("long")
    joined = (
        shown.groupBy("conv_id", part.alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("block")))).alias("blocks"))
        .select("conv_id", "part", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n").alias("body"))
    )
    ends = shown.groupBy("conv_id").agg(F.min(part).alias("first"), F.max(part).alias("last"))
    opening, closing = F.col("part") == F.col("first"), F.col("part") == F.col("last")
    body = F.when(opening, F.ltrim("body", F.lit(WHITESPACE))).otherwise(F.col("body"))
    body = F.when(closing, F.concat(rstrip(body), F.lit("\n"))).otherwise(F.concat(body, F.lit("\n")))
    return joined.join(ends, "conv_id").select("conv_id", "part", body.alias("body"))


def preorder(
    nodes: DataFrame, tree: str = "conv_id", node: str = "id", parent: str = "parent", order: str = "ord"
) -> DataFrame:
    """Position and depth of every node in a walk that visits parents before children.

    ``order`` is a whole number, unique among siblings; a node has one parent, NULL
    for a root, and roots follow one another. Nodes that no root leads to are left
    out. The walk enters and leaves each node once; these steps form a chain whose
    links are doubled until every step knows its distance to the end, so the number
    of rounds grows with the logarithm of the largest tree and no round gathers a
    tree in one place.
    """
    spark = nodes.sparkSession
    base = nodes.select(
        F.col(tree).alias("t"), F.col(node).alias("id"), F.col(parent).alias("p"), F.col(order).alias("o")
    )
    roots = base.where(F.col("p").isNull())
    children = base.where(F.col("p").isNotNull())
    # The next sibling is the one before it in descending order.
    following = lambda df, keys: carry_last(
        df.withColumn("neg", -F.col("o")), "id", "sibling", keys, seq="neg"
    ).drop("neg")
    siblings = following(children, ["t", "p"]).unionByName(following(roots, ["t"]))
    first = children.groupBy("t", "p").agg(F.min_by("id", "o").alias("child")).withColumnRenamed("p", "id")
    linked = siblings.join(first, ["t", "id"], "left")

    enter = linked.select(
        "t", "id", F.lit(0).alias("side"),
        F.coalesce("child", "id").alias("n_id"),
        F.when(F.col("child").isNotNull(), 0).otherwise(1).alias("n_side"),
        F.lit(1).cast("long").alias("entered"), F.lit(1).cast("long").alias("level"),
    )
    leave = linked.select(
        "t", "id", F.lit(1).alias("side"),
        F.coalesce("sibling", "p").alias("n_id"),
        F.when(F.col("sibling").isNotNull(), 0).otherwise(1).alias("n_side"),
        F.lit(0).cast("long").alias("entered"), F.lit(-1).cast("long").alias("level"),
    )
    open_steps = materialize(enter.unionByName(leave).withColumn("done", F.col("n_id").isNull()), "walk")
    # Finished steps stay where they were written; a round carries on the open ones only.
    finished, running = [open_steps.where("done")], open_steps.where(~F.col("done"))

    longest = nodes.groupBy(tree).count().agg(F.max("count")).first()[0] or 0
    for _ in range(math.ceil(math.log2(2 * longest + 2)) if longest else 0):
        steps = reduce(DataFrame.unionByName, [*finished, running])
        ahead = steps.select(
            "t", F.col("id").alias("n_id"), F.col("side").alias("n_side"), F.col("n_id").alias("a_id"),
            F.col("n_side").alias("a_side"), F.col("entered").alias("a_entered"), F.col("level").alias("a_level"),
            F.col("done").alias("a_done"),
        )
        # A link to a node that does not exist drops out here, with all that lead to it.
        moved = running.join(ahead, ["t", "n_id", "n_side"]).select(
            "t", "id", "side", F.col("a_id").alias("n_id"), F.col("a_side").alias("n_side"),
            (F.col("entered") + F.col("a_entered")).alias("entered"),
            (F.col("level") + F.col("a_level")).alias("level"),
            F.col("a_done").alias("done"),
        )
        moved = materialize(moved, "walk")
        finished.append(moved.where("done"))
        running = moved.where(~F.col("done"))
        if running.isEmpty():
            break

    reached = reduce(DataFrame.unionByName, finished).where("side = 0")
    size = reached.groupBy("t").agg(F.max("entered").alias("size"))
    return reached.join(size, "t").select(
        F.col("t").alias(tree),
        F.col("id").alias(node),
        (F.col("size") - F.col("entered")).alias("position"),
        (-F.col("level")).alias("depth"),
    )
