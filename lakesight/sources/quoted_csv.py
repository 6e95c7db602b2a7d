"""Delimited files with line breaks inside quotes, cut into records by many tasks.

A file is read as lines, so Spark splits it where it likes. Whether a line begins inside
quotes depends on everything before it, but only through one of two states. Each block of a
file is therefore cut from both: until a line ends a record either way, the records of each
case are kept apart; from there on they are the same. Where a block leads from either state
is composed in file order, which gives every block the state it really began in. Then the
case that holds is taken, and a record that crosses borders is put together from its pieces.

The text is scanned once; what meets afterwards are a few rows for each block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lakesight.session import materialize

# A field from its start: quoted, where a doubled quote is one of the text, or anything up to the delimiter. A quote
# inside an unquoted field is text; what follows a closing quote belongs to the field.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|)'
_REST = rf"(?:,{_FIELD})*+\Z"
#: Does a line that begins outside, or inside quotes, end outside of them?
FROM_OUTSIDE = re.compile(_FIELD + _REST)
FROM_INSIDE = re.compile(rf'[^"]*+(?:""[^"]*+)*+"[^,]*+{_REST}')
OUTSIDE, INSIDE = 0, 1
#: Rows of a cut block: a record in either case, in one case only, and what a block leads to. In pieces: the rest of a
#: record that began before the block, the beginning of one that goes on behind it, or both in one.
RECORD, SUMMARY = "record", "summary"
REST, START, MIDDLE = "rest", "start", "middle"
CUT = "_file string, _block long, _row long, _kind string, _case int, record string, _ends array<int>"


def step(line: str, state: int) -> int:
    """The state after a line."""
    if '"' not in line:
        return state
    return OUTSIDE if (FROM_INSIDE if state else FROM_OUTSIDE).match(line) else INSIDE


def joined(parts: list[str]) -> str:
    """A record of its lines; a carriage return at the end of a line is part of the break."""
    return parts[0].removesuffix("\r") if len(parts) == 1 else "\n".join([p.removesuffix("\r") for p in parts])


def cut_block(rows: Iterator[str]) -> Iterator[tuple]:
    """(row, kind, case, text, ends) of the lines of one block; case None holds in both."""
    states, parts, firsts = [OUTSIDE, INSIDE], [[], []], [0, 0]
    met, number = False, -1
    rows = iter(rows)
    for number, line in enumerate(rows):
        for case in (0, 1):
            parts[case].append(line)
            states[case] = step(line, states[case])
        for case in (0, 1):
            if states[case] == OUTSIDE:
                kind = REST if case == INSIDE and firsts[case] == 0 else RECORD
                yield firsts[case], kind, case, joined(parts[case]), None
                parts[case], firsts[case] = [], number + 1
        if states == [OUTSIDE, OUTSIDE]:
            met = True
            break
    # From here on both cases are one: nearly all lines of a block.
    state, part, first, outside, inside = states[0], parts[0], firsts[0], FROM_OUTSIDE.match, FROM_INSIDE.match
    for number, line in enumerate(rows, number + 1):
        part.append(line)
        if '"' in line:
            state = OUTSIDE if (inside if state else outside)(line) else INSIDE
        if state == OUTSIDE:
            yield first, RECORD, None, joined(part), None
            part, first = [], number + 1
    states[0], parts[0], firsts[0] = state, part, first
    for case in (0,) if met else (0, 1):
        if parts[case]:
            kind = MIDDLE if case == INSIDE and firsts[case] == 0 else START
            yield firsts[case], kind, None if met else case, joined(parts[case]), None
    ends = [states[0], states[0] if met else states[1]]
    yield number + 1, SUMMARY, None, None, ends


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[str]]]:
    """((file, block), lines) of the runs of lines of one block in each batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block, line = (batch.column(c) for c in ("_file", "_block", "line"))
        changed = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(block[1:], block[:-1]))
        starts = [0, *(np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for at, end in zip(starts, starts[1:], strict=False):
            # By way of numpy texts become Python's several times faster than one by one.
            yield (file[at].as_py(), block[at].as_py()), line[at:end].to_numpy(zero_copy_only=False).tolist()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["_file", "_block", "_row", "_kind", "_case", "record", "_ends"]
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int32())]
    for (file, block), own in groupby(_runs(batches), key=lambda r: r[0]):
        found = cut_block(chain.from_iterable(lines for _, lines in own))
        while made := list(islice(found, 2048)):
            place = [pa.repeat(pa.scalar(file, pa.string()), len(made)), pa.repeat(pa.scalar(block, pa.int64()), len(made))]
            columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*place, *columns], names)


def block_states(summaries: DataFrame) -> DataFrame:
    """(_f, _b, _state): where each block begins, by composing what the blocks before it lead to.

    A block leads both states to one, keeps them, or swaps them. The state is that of the last
    block before that leads both to one, swapped as often as blocks since then swap.
    """
    out, in_ = F.col("_ends")[0], F.col("_ends")[1]
    swaps = ((out == INSIDE) & (in_ == OUTSIDE)).cast("int")
    order = Window.partitionBy("_file").orderBy("_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = summaries.withColumn("_swaps", F.sum(swaps).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    running = counted.withColumns({
        "_fixed": F.last(F.when(out == in_, F.struct(out.alias("to"), "_swaps")), ignorenulls=True).over(before),
        "_so_far": F.coalesce(F.sum(swaps).over(before), F.lit(0)),
    })
    state = F.coalesce(F.col("_fixed.to"), F.lit(OUTSIDE)) + F.col("_so_far") - F.coalesce(F.col("_fixed._swaps"), F.lit(0))
    return running.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), F.pmod(state, F.lit(2)).alias("_state"))


def records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_file, _block, _row, record): the records of all files, each by the block and line where it begins.

    Line breaks inside a record are line feeds; the one at its end is left off. The header
    (the first record of each file) and empty records are left out. A quote that is never
    closed takes in the rest of its file.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    lines = text.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.col("value").alias("line"))
    cut = materialize(lines.mapInArrow(_cut, CUT), "records")
    states = block_states(cut.where(F.col("_kind") == SUMMARY))
    here = (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b"))
    # What holds in one case only, or is a piece: a few rows of each block.
    unsure = cut.where(F.col("_kind").isin(REST, START, MIDDLE) | ((F.col("_kind") == RECORD) & F.col("_case").isNotNull()))
    held = unsure.join(states, here).where(F.col("_case").isNull() | (F.col("_case") == F.col("_state")))
    order = Window.partitionBy("_file").orderBy("_block", "_row")
    pieces = held.where(F.col("_kind") != RECORD).withColumn("_n", F.sum((F.col("_kind") == START).cast("int")).over(order))
    whole = pieces.groupBy("_file", "_n").agg(F.array_sort(F.collect_list(F.struct("_block", "_row", "record"))).alias("p")).select(
        "_file", F.col("p")[0]["_block"].alias("_block"), F.col("p")[0]["_row"].alias("_row"), F.array_join(F.col("p")["record"], "\n").alias("record"))
    columns = ["_file", "_block", "_row", "record"]
    every = (
        cut.where((F.col("_kind") == RECORD) & F.col("_case").isNull()).select(*columns)
        .unionByName(held.where(F.col("_kind") == RECORD).select(*columns)).unionByName(whole.select(*columns))
    )
    header = (F.col("_block") == 0) & (F.col("_row") == 0)
    return every.where(~header & (F.col("record") != ""))
