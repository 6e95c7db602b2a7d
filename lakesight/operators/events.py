"""Server-sent event text: blocks, event names and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lakesight.functions.text import strip


def _blocks(body: Column) -> Column:
    """``array<struct<event, data>>``: one entry per block between blank lines.

    The last ``event:`` line names the event; the last ``data:`` line that parses
    is its payload, others are ignored.
    """

    def lines(block: Column, label: str) -> Column:
        found = F.filter(F.split(block, "\n", -1), lambda line: line.startswith(label))
        return F.transform(found, lambda line: strip(F.substring(line, len(label) + 1, 2_147_483_647)))

    def entry(block: Column) -> Column:
        payloads = F.filter(lines(block, "data:"), lambda text: F.try_parse_json(text).isNotNull())
        return F.struct(
            F.try_element_at(lines(block, "event:"), F.lit(-1)).alias("event"),
            F.try_element_at(payloads, F.lit(-1)).alias("data"),
        )

    return F.transform(F.split(body, "\n\n", -1), entry)


def _last_value(blocks: Column, event: str, key: str) -> Column:
    """The value under ``key`` in the last block of that event that has the key."""
    having = F.filter(
        blocks,
        lambda b: (b["event"] == event)
        & F.coalesce(F.array_contains(F.json_object_keys(b["data"]), key), F.lit(False)),
    )
    return F.get_json_object(F.try_element_at(having, F.lit(-1))["data"], f"$.{key}")


def parse_bodies(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Final answer and last error of every event text."""
    return (
        bodies.withColumn("_blocks", _blocks(F.col(column)))
        .withColumns(
            {
                "answer": _last_value(F.col("_blocks"), "complete", "answer"),
                "error_message": _last_value(F.col("_blocks"), "error", "message"),
            }
        )
        .drop("_blocks")
    )
