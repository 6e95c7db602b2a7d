"""Near-duplicates by SimHash fingerprints and a grid over segment bit counts.

A fingerprint is cut into bands and each band into segments; the bit counts of a band's
segments are its place on a grid. Bit counts differ by at most as much as bits do, so the
Manhattan distance on the grid is a lower bound of the Hamming distance. Of fingerprints that
differ in four bits, one of the three bands differs in one bit at most: there they lie in the
same cell or in neighbouring ones. Each fingerprint is at home in its cell, and those with an
odd total also visit the neighbours; what meets in a cell is verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from lakesight.llm.common import bounded_batches, documents, whole, without
from lakesight.llm.components import components
from lakesight.session import materialize

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: First bit and number of bits of each band. Three bands hold for distances up to five.
BANDS = [(0, 21), (21, 21), (42, 22)]
SEGMENT = 2
#: Rows of a cell that one task compares with each other; larger cells are split into blocks that meet in pairs.
CELL_ROWS = 1_500
#: Rows that a task holds at once.
FLUSH_ROWS = 400_000
OUTPUT = ["fingerprint", "component_id"]


def fingerprint(text: str) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit number; 0 for a text of no words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
        starts, ends = [0, *(b + 1 for b in blanks[: 1 - SHINGLE])], [*blanks[SHINGLE - 1 :], len(joined)]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends, strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return texts.map(fingerprint).astype("int64")


def grid_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp) → (cell, home, fp): the home cell of each band, and the neighbours that odd ones visit."""
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        out = []
        for band, (first, width) in enumerate(BANDS):
            sizes = [min(SEGMENT, width - s) for s in range(0, width, SEGMENT)]
            counts = [
                np.bitwise_count((fp >> np.uint64(first + SEGMENT * j)) & np.uint64((1 << size) - 1)).astype(np.int64)
                for j, size in enumerate(sizes)
            ]
            home = np.full(len(fp), band << 60, np.int64)
            for j, count in enumerate(counts):
                home += count << (2 * j)
            out.append((home, np.ones(len(fp), bool), fp))
            odd = sum(counts) % 2 == 1
            for j, (count, size) in enumerate(zip(counts, sizes, strict=True)):
                for step, fits in ((1, odd & (count < size)), (-1, odd & (count > 0))):
                    out.append((home[fits] + (step << (2 * j)), np.zeros(int(fits.sum()), bool), fp[fits]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([o[0] for o in out])), pa.array(np.concatenate([o[1] for o in out])),
             pa.array(np.concatenate([o[2] for o in out]).view(np.int64))], ["cell", "home", "fp"])


def forest(n: int, a: np.ndarray, b: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """The least index connected to each of ``n``, by pairs (a, b) and an earlier result."""
    parent = np.arange(n) if parent is None else parent
    while True:
        pa_, pb = parent[a], parent[b]
        open_ = pa_ != pb
        if not open_.any():
            return parent
        np.minimum.at(parent, np.maximum(pa_, pb)[open_], np.minimum(pa_, pb)[open_])
        while not np.array_equal(parent, up := parent[parent]):
            parent = up


def cell_links(cell: np.ndarray, block: np.ndarray, home: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one sorted run of whole cells: a spanning star of each connected set of fingerprints.

    ``cell`` numbers the cells. Two rows are compared if one is at home; in a cell of two
    blocks, only rows of different blocks.
    """
    unique, node = np.unique(fp, return_inverse=True)
    parent = np.arange(len(unique))
    ends = np.searchsorted(cell, cell, side="right")
    mixed = np.zeros(len(cell), bool)
    if len(cell):
        lowest = block[np.searchsorted(cell, cell, side="left")]
        mixed = block != lowest
        mixed = np.add.reduceat(mixed, np.unique(np.searchsorted(cell, cell, side="left"))) > 0
        mixed = np.repeat(mixed, np.unique(cell, return_counts=True)[1])
    at, d, found_a, found_b, held = np.arange(len(cell)), 1, [], [], 0
    while len(at := at[at + d < ends[at]]):
        other = at + d
        near = (np.bitwise_count(fp[at] ^ fp[other]) <= DISTANCE) & (home[at] | home[other])
        near &= ~mixed[at] | (block[at] != block[other])
        if near.any():
            found_a.append(node[at[near]])
            found_b.append(node[other[near]])
            held += len(found_a[-1])
            if held > 1_000_000:
                parent, found_a, found_b, held = forest(len(unique), np.concatenate(found_a), np.concatenate(found_b), parent), [], [], 0
        d += 1
    if found_a:
        parent = forest(len(unique), np.concatenate(found_a), np.concatenate(found_b), parent)
    linked = np.flatnonzero(parent != np.arange(len(unique)))
    return unique[linked], unique[parent[linked]]


def link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (cell, pair, block, home, fp) → links (a, b); the last cell of a run waits for the next one."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        cell, pair, block, home, fp = (table.column(i).to_numpy() for i in range(5))
        fresh = np.ones(len(cell), bool)
        fresh[1:] = (cell[1:] != cell[:-1]) | (pair[1:] != pair[:-1])
        number = np.cumsum(fresh)
        keep = len(cell) if last else int(np.searchsorted(number, number[-1]))
        if keep:
            a, b = cell_links(number[:keep], block[:keep], home[:keep], fp[:keep].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])
        held = table.slice(keep).to_batches()
        size = len(cell) - keep

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= FLUSH_ROWS:
            yield from flush(False)
    yield from flush(True)


def links(keys: DataFrame) -> DataFrame:
    """(a, b) over distinct fingerprints ``fp``: enough of the links within ``DISTANCE`` bits to connect what they connect.

    Cells above ``CELL_ROWS`` are split: a row of block i goes to the pairs (i, j) of all
    blocks j, so that every two rows of the cell still meet once and no task takes more than
    two blocks.
    """
    rows = materialize(keys.select("fp").mapInArrow(grid_rows, "cell long, home boolean, fp long"), "grid")
    crowded = materialize(
        rows.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > CELL_ROWS)
        .select(F.col("cell").alias("_cell"), F.ceil(F.col("_n") / CELL_ROWS).cast("int").alias("_blocks")), "crowded")
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = rows.join(crowded, F.col("cell") == F.col("_cell"), "left").withColumn(
        "block", F.pmod(F.xxhash64("fp"), blocks).cast("int")
    ).select(
        "cell", "block", "home", "fp",
        F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: (
            F.least(j, F.col("block")).cast("long") * (1 << 31) + F.greatest(j, F.col("block"))))).alias("pair"),
    ).select("cell", "pair", "block", "home", "fp")
    return dealt.repartition("cell", "pair").sortWithinPartitions("cell", "pair").mapInArrow(link_rows, "a long, b long")


def simhash_groups(docs: DataFrame, keep: list[str] | None = None, root: str | None = None) -> DataFrame:
    """All rows of ``docs``, columns ``keep`` or all, with ``fingerprint`` (16 hexadecimal digits) and ``component_id``.

    A column named ``root``, if asked for, tells components apart, also those without any doc_id.

    Fingerprints link at ``DISTANCE`` or fewer differing bits; a component is what links
    reach, and its id the smallest doc_id in it (null only if no row of it has one). A null
    or empty text has fingerprint zero, which links like any other. Repeated rows share a
    fingerprint and so a component. An empty table gives an empty table; input columns named
    like an output, ``_fp``, ``_key`` or ``_id`` are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = without(docs, *OUTPUT, "_fp", "_key", "_id")
    kept = [F.col(f"`{c}`") for c in (keep or docs.columns)]
    marked = docs.withColumn("_fp", fingerprints(whole("text"))).select(*kept, "_fp", F.col("doc_id").alias("_id"))
    # Written once, so that the fingerprints are not computed again for each use.
    rows = materialize(marked, "fingerprints")
    keys = materialize(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("first")), "keys")
    reached = components(links(keys))
    roots = keys.join(reached, F.col("fp") == F.col("a"), "left").select("fp", "first", F.coalesce("b", "fp").alias("root"))
    roots = materialize(roots, "roots")
    least = materialize(roots.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("component_id")), "least")
    ids = materialize(
        roots.join(least, F.col("root") == F.col("_root")).select(F.col("fp").alias("_key"), "component_id", "root"), "ids")
    return rows.join(ids, F.col("_fp") == F.col("_key")).select(
        *kept, F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id",
        *([ids["root"].alias(root)] if root else []),
    )


def op6_simhash(spark, folder: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash_groups(documents(spark, folder).select("doc_id", "text"), keep=["doc_id"])
