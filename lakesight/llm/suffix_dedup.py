"""Repeated byte strings by a Burrows-Wheeler transform.

Every string of ``LENGTH`` bytes has two anchors, the least and the greatest hash of its
grams; equal strings have equal anchors. Strings with an anchor that occurs once cannot be
repeated. The others are cut into pieces by the least, and pieces of one anchor meet in a task. There a breadth-first backward
extension on the transform of the pieces derives common prefixes by increasing value: it
starts from the intervals of short strings, extends them to the left one byte at a time, and
each string that ends an interval where no boundary was known fixes one common prefix. It
stops at the minimum length; suffixes with no boundary between them share at least that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lakesight.llm.common import bounded_batches, documents, whole, without
from lakesight.session import materialize

LENGTH = 200
GRAM = 32
#: Cells of the bit set of repeated anchors, 16 MB when broadcast at any input size. When it fills up, more
#: strings than needed become pieces; the result is the same.
CELLS = 1 << 27
#: Bytes that are hashed, and bytes that are transformed, at once.
CHUNK, TRANSFORM = 1 << 20, 1 << 21
#: Beyond so many pieces or bytes an anchor's pieces are first cut down to strings whose digest is repeated.
CROWD_PIECES, CROWD_BYTES = 500, 1 << 21
#: Digests are dealt over so many parts of the bit set, and sent on when a task holds so many.
PARTS, HELD = 256, 1 << 20
OUTPUT = ["n_bytes", "n_removed", "n_spans", "kept"]
INNER = ["_row", "_text", "_key", "_cover"]

_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Tells the greatest hashes from the least ones in one bit set.
_GREATEST = np.uint64(0x5851F42D4C957F2D)


def rolling(data: np.ndarray, length: int, base: int) -> np.ndarray:
    """A 64-bit hash of every ``length`` bytes, put together from hashes of powers of two."""
    out, done, power, part = None, 0, np.uint64(base), _TABLE[data]
    whole_power, bit = None, 1
    while bit <= length:
        if length & bit:
            if out is None:
                out, done = part, bit
            else:
                out = out[: len(data) - done - bit + 1] * power + part[done : len(data) - bit + 1]
                done += bit
        part = part[:-bit] * power + part[bit:] if len(part) > bit else part[:0]
        power = np.uint64(int(power) * int(power) & 0xFFFFFFFFFFFFFFFF)
        bit *= 2
    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _over(values: np.ndarray, width: int, least) -> np.ndarray:
    """``least`` of every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        values = least(values[:-size], values[size:])
        size *= 2
    return least(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def chunks(rows: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Buffers of about ``CHUNK`` bytes with (row, offset in the text, start, end in the buffer) of what they hold.

    A longer text is cut, with an overlap of one string less a byte, so that every string is whole somewhere.
    """
    parts, held, size = [], [], 0
    for row, text in zip(rows.tolist(), texts, strict=True):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            part = text[at : at + CHUNK + LENGTH - 1]
            held.append((row, at, size, size + len(part)))
            parts.append(part)
            size += len(part)
            if size >= CHUNK:
                yield np.frombuffer(b"".join(parts), np.uint8), held
                parts, held, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), held


def anchors(data: np.ndarray, held: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, the least and the greatest anchor of each string, and whether the string lies in one text."""
    grams = rolling(data, GRAM, _BASES[0])
    width = LENGTH - GRAM + 1
    least, greatest = _over(grams, width, np.minimum), _over(grams, width, np.maximum)
    inside = np.zeros(len(least) + 1, np.int32)
    for _, _, start, end in held:
        inside[start] += 1
        inside[end - LENGTH + 1] -= 1
    return grams, least, greatest, np.cumsum(inside[:-1]) > 0


def _chosen(grams: np.ndarray, anchor: np.ndarray, inside: np.ndarray, least) -> np.ndarray:
    """The grams that are the anchor of some string, once for each place."""
    width = LENGTH - GRAM + 1
    none = np.uint64(0) if least is np.maximum else ~np.uint64(0)
    padded = np.full(len(anchor) + 2 * (width - 1), none)
    padded[width - 1 : width - 1 + len(anchor)][inside] = anchor[inside]
    return grams[grams == _over(padded, width, least)]


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) → one row per place of an anchor."""
    for batch in batches:
        for data, held in chunks(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
            grams, least, greatest, inside = anchors(data, held)
            chosen = np.concatenate([
                _chosen(grams, least, inside, np.maximum), _chosen(grams, greatest, inside, np.minimum) ^ _GREATEST])
            yield pa.RecordBatch.from_arrays([pa.array(chosen.view(np.int64))], ["anchor"])


def _is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    cell = (hashes & np.uint64(CELLS - 1)).astype(np.int64)
    return ((bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1).astype(bool)


def _runs(keep: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs of kept places with one value."""
    at = np.flatnonzero(keep)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (value[at[1:]] != value[at[:-1]])
    starts = np.flatnonzero(new)
    return at[starts], at[np.append(starts[1:], len(at)) - 1] + 1


def piece_rows(bits: Broadcast):
    """(row, text) → (anchor, piece, row, start, bytes): maximal runs of strings with one least anchor, both repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            for data, held in chunks(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                _, least, greatest, inside = anchors(data, held)
                starts, ends = _runs(inside & _is_set(cells, least) & _is_set(cells, greatest ^ _GREATEST), least)
                of = np.searchsorted([h[2] for h in held], starts, side="right") - 1
                raw = data.tobytes()
                pieces = [raw[s : e + LENGTH - 1] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                row, offset, first = (np.array([h[i] for h in held], np.int64)[of] for i in range(3))
                yield pa.RecordBatch.from_arrays([
                    pa.array(least[starts].view(np.int64)),
                    pa.array([hashlib.md5(p).digest() for p in pieces], pa.binary()),
                    pa.array(row), pa.array(starts - first + offset), pa.array(pieces, pa.binary()),
                ], ["anchor", "piece", "row", "start", "bytes"])

    return run


def suffix_order(symbols: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffixes in the order of their first ``length`` symbols, by prefix doubling.

    ``symbols`` are bytes plus one, 0 closes a piece; ``left`` counts the symbols before that.
    Closing symbols are all different. Returns the order, its inverse, where a new string of
    the first width starts in it, and that width.
    """
    n, width = len(symbols), 7
    key = np.zeros(n, np.int64)
    padded = np.append(symbols, np.zeros(width, symbols.dtype)).astype(np.int64)
    alive = np.ones(n, bool)
    for i in range(width):
        here = padded[i : i + n]
        key = (key << 9) | np.where(alive, here, 0)
        alive &= here > 0
    order = np.argsort(key, kind="stable")
    new = np.ones(n + 1, bool)
    new[1:n] = (key[order[1:]] != key[order[:-1]]) | (left[order[1:]] < width) | (left[order[:-1]] < width)
    first = new.copy()
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new[:n], np.arange(n), 0))
    size = width
    while size < length:
        # Only places in groups of several suffixes are still open.
        open_ = np.flatnonzero(~(new[:n] & new[1:]))
        if not len(open_):
            break
        suffix = order[open_]
        after = rank[np.minimum(suffix + size, n - 1)]
        by = np.lexsort((after, rank[suffix]))
        group, after, suffix = rank[suffix][by], after[by], suffix[by]
        order[open_] = suffix
        fresh = np.ones(len(open_), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1]) | (left[suffix[1:]] < 2 * size) | (left[suffix[:-1]] < 2 * size)
        new[open_[fresh]] = True
        rank[suffix] = open_[np.maximum.accumulate(np.where(fresh, np.arange(len(open_)), 0))]
        size *= 2
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    return order, inverse, first, width


def boundaries(symbols: np.ndarray, order: np.ndarray, inverse: np.ndarray, first: np.ndarray, width: int, length: int) -> np.ndarray:
    """Where neighbours in the suffix order share fewer than ``length`` symbols (one more entry closes the last).

    An interval holds the suffixes that begin with one string. Extended by the symbols before
    them, it splits into the intervals of strings one longer. One that ends where no boundary
    is known sets it, with the common prefix of its own length less one, and goes on.
    """
    known = first.copy()
    low = np.flatnonzero(first[:-1])
    high = np.append(low[1:], len(symbols))
    before = np.where(order > 0, symbols[order - 1], 0)
    target = np.where(before > 0, inverse[order - 1], -1)
    for _ in range(width, length):
        if not len(low):
            break
        sizes = high - low
        number = np.repeat(np.arange(len(low)), sizes)
        at = np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[number]
        kept = target[at] >= 0
        at, number = at[kept], number[kept]
        to, symbol = target[at], before[at]
        by = np.argsort(to)
        to, number, symbol = to[by], number[by], symbol[by]
        if not len(to):
            break
        last = np.ones(len(to), bool)
        last[:-1] = (number[1:] != number[:-1]) | (symbol[1:] != symbol[:-1]) | (to[1:] != to[:-1] + 1)
        ends = np.flatnonzero(last)
        starts = np.append(0, ends[:-1] + 1)
        low, high = to[starts], to[ends] + 1
        fresh = ~known[high]
        low, high = low[fresh], high[fresh]
        known[high] = True
    return known


def repeated_ranges(pieces: list[bytes], weights: np.ndarray, length: int = LENGTH) -> Iterator[tuple[int, int, int]]:
    """(piece, start, end): maximal byte runs covered by strings found twice, a piece counting ``weights`` times."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    joined = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8).astype(np.int16) + 1
    close = np.cumsum(sizes + 1) - 1
    joined[close] = 0
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    left = close[owner] - np.arange(len(joined))
    order, inverse, first, width = suffix_order(joined, left, length)
    known = boundaries(joined, order, inverse, first, width, length)
    short = np.flatnonzero(left[order] < length)
    known[short] = known[short + 1] = True
    heads = np.flatnonzero(known[:-1])
    total = np.add.reduceat(weights[owner[order]], heads)
    again = np.zeros(len(joined), bool)
    again[order] = np.repeat(total > 1, np.diff(np.append(heads, len(joined))))
    again &= left >= length
    edge = np.zeros(len(joined) + 1, np.int32)
    places = np.flatnonzero(again)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + length, -1)
    covered = np.cumsum(edge[:-1]) > 0
    starts, ends = _runs(covered, owner)
    base = close - sizes
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        yield int(owner[s]), s - int(base[owner[s]]), e - int(base[owner[s]])


def cut_down(pieces: list[bytes], weights: list[int]) -> tuple[list[bytes], np.ndarray, list[tuple[int, int, int]]]:
    """Distinct cuts of the pieces, their weights, and (piece, offset, cut) for each cut's places.

    A cut is a run of strings whose digest occurs twice in the pieces; other strings are not
    repeated, and a transform need not see them. Equal cuts are transformed once.
    """
    digests = [rolling(np.frombuffer(p, np.uint8), LENGTH, _BASES[1]) for p in pieces]
    _, at = np.unique(np.concatenate(digests), return_inverse=True)
    counts = np.bincount(at, weights=np.repeat(weights, [len(d) for d in digests]))
    again, offset = counts[at] > 1, 0
    numbers: dict[bytes, int] = {}
    totals: list[int] = []
    places = []
    for i, (piece, own) in enumerate(zip(pieces, digests, strict=True)):
        keep = again[offset : offset + len(own)]
        offset += len(own)
        starts, ends = _runs(keep, keep)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            number = numbers.setdefault(piece[s : e + LENGTH - 1], len(numbers))
            if number == len(totals):
                totals.append(0)
            totals[number] += weights[i]
            places.append((i, s, number))
    return list(numbers), np.array(totals, np.int64), places


def transform_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by anchor → covered (piece, low, high); whole anchors are transformed together."""
    keys, pieces, weights, size, last = [], [], [], 0, None

    def flush() -> pa.RecordBatch:
        cuts, totals, places = cut_down(pieces, weights)
        ranges: dict[int, list[tuple[int, int]]] = {}
        if cuts:
            for number, start, end in repeated_ranges(cuts, totals):
                ranges.setdefault(number, []).append((start, end))
        found = [(i, at + s, at + e) for i, at, number in places for s, e in ranges.get(number, ())]
        return pa.RecordBatch.from_arrays([
            pa.array([keys[i] for i, _, _ in found], pa.binary()),
            pa.array([s for _, s, _ in found], pa.int64()), pa.array([e for _, _, e in found], pa.int64())], ["piece", "low", "high"])

    for batch in batches:
        for anchor, key, raw, weight in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if size >= TRANSFORM and anchor != last:
                yield flush()
                keys, pieces, weights, size = [], [], [], 0
            keys.append(key)
            pieces.append(raw)
            weights.append(weight)
            size += len(raw)
            last = anchor
    if pieces:
        yield flush()


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces → (part, digests, again): distinct digests of their strings, and whether the task met them twice."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        digests, at = np.unique(np.concatenate([h for h, _ in held]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([w for _, w in held]))
        part = (digests & np.uint64(CELLS - 1)) // np.uint64(CELLS // PARTS)
        order = np.argsort(part, kind="stable")
        starts = np.searchsorted(part[order], np.arange(PARTS + 1))
        lists = [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values) for values in (
            pa.array(digests[order].view(np.int64)), pa.array(counts[order] > 1))]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS), pa.int32()), *lists], ["part", "digests", "again"])

    for batch in batches:
        for raw, weight in zip(batch.column("bytes").to_pylist(), batch.column("weight").to_pylist(), strict=True):
            digests = rolling(np.frombuffer(raw, np.uint8), LENGTH, _BASES[1])
            held.append((digests, np.full(len(digests), weight)))
            size += len(digests)
        if size >= HELD:
            yield flush()
            held.clear()
            size = 0
    if held:
        yield flush()


def repeated_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part → (word, bits) of the bit set: cells of digests that were met twice."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    last = None

    def flush() -> pa.RecordBatch:
        digests, at = np.unique(np.concatenate([d for d, _ in held]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([1 + a.astype(np.int64) for _, a in held]))
        cell = np.unique(digests[counts > 1].view(np.uint64) & np.uint64(CELLS - 1))
        word, starts = np.unique(cell >> np.uint64(6), return_index=True)
        bit = np.left_shift(np.uint64(1), cell & np.uint64(63))
        bits = np.bitwise_or.reduceat(bit, starts) if len(starts) else bit
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    for batch in batches:
        for i in range(batch.num_rows):
            part = batch.column(0)[i].as_py()
            if part != last and held:
                yield flush()
                held.clear()
            last = part
            held.append((batch.column(1)[i].values.to_numpy(), batch.column(2)[i].values.to_numpy(zero_copy_only=False)))
    if held:
        yield flush()


def trim_rows(bits: Broadcast):
    """Pieces → (anchor, piece, cut, at, bytes, weight): their runs of strings with a repeated digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.frombuffer(bits.value, np.uint8)
        for batch in batches:
            out: list[tuple] = []
            for anchor, piece, raw, weight in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                keep = _is_set(cells, rolling(np.frombuffer(raw, np.uint8), LENGTH, _BASES[1]))
                starts, ends = _runs(keep, keep)
                for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                    cut = raw[s : e + LENGTH - 1]
                    out.append((anchor, piece, hashlib.md5(cut).digest(), s, cut, weight))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]
            names = ["anchor", "piece", "cut", "at", "bytes", "weight"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names)

    return run


def _collected(words: DataFrame) -> bytes:
    """The bit set out of (word, bits), at most ``CELLS`` / 64 rows."""
    rows = words.toArrow()
    cells = np.zeros(CELLS // 64, np.int64)
    cells[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return cells.astype("<i8").tobytes()


def anchor_bits(texts: DataFrame) -> bytes:
    """The bit set of anchors with two places or more; ``CELLS`` / 64 words come to the driver at most."""
    again = texts.mapInArrow(anchor_rows, "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _collected(again.select(F.col("anchor").bitwiseAND(CELLS - 1).alias("c")).groupBy(F.expr("c div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(c % 64))")).alias("bits")))


def digest_bits(pieces: DataFrame) -> bytes:
    """The bit set of string digests that occur twice in the pieces; digests travel in lists, not as rows."""
    dealt = pieces.mapInArrow(digest_rows, "part int, digests array<long>, again array<boolean>")
    return _collected(dealt.repartition("part").sortWithinPartitions("part").mapInArrow(repeated_words, "word long, bits long"))


def repeated_cover(texts: DataFrame) -> DataFrame:
    """(_key, _cover): of each row, the byte ranges covered by repeated strings; ``texts`` has row and text bytes."""
    spark = texts.sparkSession
    bits = spark.sparkContext.broadcast(anchor_bits(texts))
    found = materialize(
        texts.mapInArrow(piece_rows(bits), "anchor long, piece binary, row long, start long, bytes binary"), "pieces")
    distinct = materialize(
        found.groupBy("anchor", "piece").agg(F.first("bytes").alias("bytes"), F.count(F.lit(1)).alias("weight")), "distinct")
    groups = distinct.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(F.length("bytes")).alias("b"), F.max(F.length("bytes")).alias("most"))
    crowd = (F.col("n") > CROWD_PIECES) | ((F.col("n") > 1) & (F.col("b") > CROWD_BYTES))
    # An anchor with one short piece that occurs once was let through by the bit set and repeats nothing.
    groups = materialize(groups.filter((F.col("w") > 1) | (F.col("most") > LENGTH)).select(F.col("anchor").alias("_a"), crowd.alias("crowd")), "groups")
    joined = distinct.join(groups, F.col("anchor") == F.col("_a")).select("anchor", "piece", "bytes", "weight", "crowd")
    few, crowded = joined.filter(~F.col("crowd")).drop("crowd"), joined.filter("crowd").drop("crowd")
    trimmed = materialize(crowded.mapInArrow(
        trim_rows(spark.sparkContext.broadcast(digest_bits(crowded))),
        "anchor long, piece binary, cut binary, at long, bytes binary, weight long"), "trimmed")
    cuts = trimmed.groupBy("anchor", F.col("cut").alias("piece")).agg(F.first("bytes").alias("bytes"), F.sum("weight").alias("weight"))
    sort = few.unionByName(cuts.select(*few.columns)).repartition("anchor").sortWithinPartitions("anchor")
    ranges = materialize(sort.mapInArrow(transform_rows, "piece binary, low long, high long"), "ranges").withColumnRenamed("piece", "_piece")
    # Ranges of a cut are put back where it was cut out; a piece that was not cut stands for itself.
    whole_ = ranges.join(few.select(F.col("piece").alias("_few")), F.col("_piece") == F.col("_few"), "left_semi")
    inside = trimmed.select("piece", "cut", "at").join(ranges, F.col("cut") == F.col("_piece")).select(
        F.col("piece").alias("_piece"), (F.col("low") + F.col("at")).alias("low"), (F.col("high") + F.col("at")).alias("high"))
    covered = materialize(whole_.unionByName(inside), "covered")
    places = found.select("piece", "row", "start").join(covered, F.col("piece") == F.col("_piece"))
    return places.groupBy(F.col("row").alias("_key")).agg(
        _merged(F.array_sort(F.collect_list(F.struct(
            (F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high"))))).alias("_cover"))


def _merged(ranges):
    """Sorted ranges without overlap or touch; what is finished is appended once per gap, not per range."""
    kind = "array<struct<low:bigint,high:bigint>>"
    breaks = F.aggregate(
        ranges, F.struct(F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"), F.array().cast(kind).alias("done")),
        lambda s, r: F.when(r["low"] <= s["high"], F.struct(s["low"].alias("low"), F.greatest(s["high"], r["high"]).alias("high"), s["done"].alias("done"))).otherwise(
            F.struct(r["low"].alias("low"), r["high"].alias("high"), F.when(s["high"] < 0, s["done"]).otherwise(
                F.concat(s["done"], F.array(F.struct(s["low"].alias("low"), s["high"].alias("high"))))).alias("done"))),
        lambda s: F.when(s["high"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(F.struct(s["low"].alias("low"), s["high"].alias("high"))))),
    )
    return breaks


def suffix_dedup(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """All rows of ``docs``, columns ``keep`` or all, with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes).

    Texts are UTF-8 bytes; null counts as empty. Each byte covered by a string of ``LENGTH``
    bytes that also starts anywhere else, in any row, is removed; repeated rows thus lose all
    their strings. Texts shorter than ``LENGTH`` are kept. An empty table gives an empty
    table. Input columns named like an output or as in ``INNER`` are left out.
    """
    bounded_batches(docs.sparkSession, 256)
    docs = without(docs, *OUTPUT, *INNER)
    kept = [F.col(f"`{c}`") for c in (keep or docs.columns)]
    rows = docs.withColumns({"_row": F.monotonically_increasing_id(), "_text": F.encode(whole("text"), "UTF-8")})
    cover = repeated_cover(rows.filter(F.length("_text") >= LENGTH).select("_row", "_text"))
    parts = rows.join(cover, F.col("_row") == F.col("_key"), "left").select(*kept, "_text", F.coalesce("_cover", F.array().cast("array<struct<low:bigint,high:bigint>>")).alias("_cover"))
    # What lies between the covered ranges, end to end; the text is bound so that it is encoded once.
    ends = F.concat(F.transform("_cover", lambda r: r["low"]), F.array(F.length("_text").cast("long")))
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform("_cover", lambda r: r["high"]))
    gaps = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    left = F.transform(F.array(F.struct(F.col("_text").alias("t"), gaps.alias("gaps"))), lambda x: F.array_join(F.transform(
        x["gaps"], lambda g: F.hex(F.substring(x["t"], (g["s"] + 1).cast("int"), (g["e"] - g["s"]).cast("int")))), ""))
    whole_text = F.unhex(F.element_at(left, 1))
    return parts.select(
        *kept, F.length("_text").cast("long").alias("n_bytes"),
        F.aggregate("_cover", F.lit(0).cast("long"), lambda s, r: s + r["high"] - r["low"]).alias("n_removed"),
        F.size("_cover").cast("long").alias("n_spans"),
        F.when(F.size("_cover") > 0, whole_text).otherwise(F.col("_text")).alias("kept"),
    )


def op7_repeated_strings(spark, folder: str) -> DataFrame:
    """What stays of all documents without their repeated strings."""
    return suffix_dedup(documents(spark, folder).select("doc_id", "text"), keep=["doc_id"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
