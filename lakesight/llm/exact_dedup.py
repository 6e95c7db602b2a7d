"""Exact duplicates by a two-pass Bloom filter.

The first pass counts, per cell of a Bloom filter, whether one or several rows set it. A
text can only be repeated if all its cells were set again. The second pass probes that:
only rows which may be repeated are shuffled by their digest; the rest pass straight
through the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lakesight.llm.common import documents, whole, without
from lakesight.session import materialize

# The characters that equal texts may differ in.
IGNORED = [" ", "\t", "\n", "\x0b", "\x0c", "\r"]
HASHES = 3
CELLS_PER_ROW = 16
#: At most this many cells: 2^18 words of 64 cells, about 12 MB when broadcast, at any input size.
MOST_CELLS = 1 << 24
#: Names that the operator uses on the way; input columns so named are left out.
INNER = ["_row", "_plain", "_hash", "_possible", "_keep_row"]
OUTPUT = ["keep_id", "group_size", "kept", "text_sha256"]


def normalized(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), IGNORED, whole(text))


def _cell(j: int, cells: int) -> Column:
    """Cell ``j`` of a hash, by double hashing of its halves."""
    low, high = F.col("_hash").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(F.col("_hash"), 32)
    return F.pmod(low + F.lit(j) * (high * 2 + 1), F.lit(cells))


def repeat_filter(hashes: DataFrame, cells: int) -> DataFrame:
    """(word, bits): the cells that two or more rows set, 64 to a word; at most ``cells / 64`` rows."""
    again = (
        hashes.select(F.explode(F.array(*[_cell(j, cells) for j in range(HASHES)])).alias("_cell"))
        .groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    )
    return again.groupBy(F.expr("_cell div 64").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(_cell % 64))")).alias("_bits")
    )


def mark_possible(rows: DataFrame, again: DataFrame, cells: int) -> DataFrame:
    """Add ``_possible``: all cells of ``_hash`` were set by several rows."""
    hits = []
    for j in range(HASHES):
        rows = rows.withColumn(f"_c{j}", _cell(j, cells))
        words = again.select(F.col("_word").alias(f"_w{j}"), F.col("_bits").alias(f"_b{j}"))
        rows = rows.join(F.broadcast(words), F.expr(f"_c{j} div 64") == F.col(f"_w{j}"), "left")
        hits.append(F.expr(f"coalesce(shiftrightunsigned(_b{j}, int(_c{j} % 64)) & 1L, 0L) = 1L"))
    extra = [f"_{x}{j}" for j in range(HASHES) for x in "cwb"]
    return rows.withColumn("_possible", reduce(Column.__and__, hits)).drop(*extra)


def exact_dedup(docs: DataFrame, cells: int | None = None) -> DataFrame:
    """All rows of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical without blanks (U+0020, U+0009 to U+000D); a null text
    counts as empty. Of equal texts the row with the most code points stays, then the
    smallest doc_id (null last), then, of fully repeated rows, the first one read. An empty
    table gives an empty table. Input columns named like an output column are replaced, those named as in ``INNER`` left out.

    The broadcast filter has at most ``MOST_CELLS`` cells. Beyond about a million rows per
    2^24 cells it lets more rows into the shuffle, which stays right: raise ``cells`` with
    the memory of the executors.
    """
    if cells is None:
        cells = 1 << 16
        rows = docs.count()
        while cells < min(MOST_CELLS, CELLS_PER_ROW * rows):
            cells *= 2
    base = without(docs, *OUTPUT, *INNER).withColumns({
        "_row": F.monotonically_increasing_id(),
        "_plain": normalized(F.col("text")),
    }).withColumn("_hash", F.xxhash64("_plain"))
    again = materialize(repeat_filter(base.select("_hash"), cells), "bloom")
    marked = mark_possible(base, again, cells)
    digest = F.sha2(F.col("_plain"), 256)
    size = F.char_length(whole("text"))

    possible = marked.filter("_possible").withColumn("text_sha256", digest)
    first = F.struct((-size).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = materialize(
        possible.groupBy("text_sha256").agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("text_sha256", "group_size", F.col("_first.id").alias("keep_id"), F.col("_first.row").alias("_keep_row")),
        "groups",
    )
    columns = without(docs, *OUTPUT, *INNER).columns
    shuffled = possible.join(groups, "text_sha256", "left").select(
        *[F.col(f"`{c}`") for c in columns],
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("_keep_row") == F.col("_row"))).alias("kept"),
        "text_sha256",
    )
    straight = marked.filter(~F.col("_possible")).select(
        *[F.col(f"`{c}`") for c in columns],
        F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        digest.alias("text_sha256"),
    )
    return straight.unionByName(shuffled)


def op9_exact_dedup(spark, folder: str) -> DataFrame:
    """Exact duplicate groups of all documents."""
    return exact_dedup(documents(spark, folder).select("doc_id", "text")).select("doc_id", *OUTPUT)


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
