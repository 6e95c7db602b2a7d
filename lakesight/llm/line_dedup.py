"""Line dedup by pairwise alignment.

Documents overlap if they share a seed: a line, a run of short lines, or two lines in a row.
Each seed links its documents to the first that has it, so that a passage of n documents
makes n - 1 links and not n². Rare seeds link first. Linked documents are aligned by patience
diff over their line hashes, and the aligned common blocks are deleted from the later one. A
seed of more documents links only those where such alignments have left it standing, so that
no shared line is passed over however many documents have it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakesight.llm.common import bounded_batches, documents, whole, without
from lakesight.session import materialize

#: Seeds of at most so many documents link first, the others where something is left of them.
RARE = 50
#: Characters that a seed has at least, as has a block that is deleted: a line, or several short ones together.
LEAST_CHARS = 24
OUTPUT = ["kept_text", "n_lines", "n_removed", "n_partners"]
INNER = ["_row", "_key", "_removed", "_lines"]


def _rising(places: list[int]) -> list[int]:
    """Indices of a longest strictly rising subsequence."""
    tails, at, before = [], [], [-1] * len(places)
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        before[i] = at[k - 1] if k else -1
        tails[k : k + 1] = [p]
        at[k : k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _anchors(a: list, b: list, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Lines found once on either side, in a common order; if there is none, the n-th of each counts as one."""
    for numbered in (False, True):
        sides = []
        for lines, start, end in ((a, a0, a1), (b, b0, b1)):
            seen: Counter = Counter()
            places: dict = {}
            for i in range(start, end):
                key = (lines[i], seen[lines[i]]) if numbered else lines[i]
                seen[lines[i]] += 1
                places[key] = i
            sides.append(places if numbered else {k: i for k, i in places.items() if seen[k] == 1})
        common = [(i, sides[1][k]) for k, i in sides[0].items() if k in sides[1]]
        if common:
            common.sort()
            return [common[i] for i in _rising([j for _, j in common])]
    return []


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned equal lines (index in a, index in b), rising in both."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        a0, a1, b0, b1 = open_.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, b, a0, a1, b0, b1)
        at, bt = a0, b0
        for i, j in anchors:
            out.append((i, j))
            open_.append((at, i, bt, j))
            at, bt = i + 1, j + 1
        if anchors:
            open_.append((at, a1, bt, b1))
    return sorted(out)


def removed_lines(earlier: list, later: list, sizes: list[int]) -> list[int]:
    """Indices of the later document's lines in aligned common blocks of ``LEAST_CHARS`` or more together."""
    out, block, last = [], [], None
    for pair in [*patience(earlier, later), None]:
        if block and (pair is None or (pair[0] - 1, pair[1] - 1) != last):
            if sum(sizes[j] for j in block) >= LEAST_CHARS:
                out += block
            block = []
        if pair:
            block.append(pair[1])
            last = pair
    return out


def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        gone = [removed_lines(r["earlier_lines"], r["lines"], r["sizes"]) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["later"] for r in rows], pa.int64()), pa.array(gone, pa.list_(pa.int32()))], ["later", "gone"])


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _seeds() -> Column:
    """(run, seed, at): hashes that documents may share, and the line where each begins.

    Run 1 is a line of ``LEAST_CHARS``, run 2 two lines in a row of which one is as long, run 3
    so many short lines in a row, empty ones left out, as are as long together.
    """
    kept = F.filter(F.arrays_zip(F.col("lines").alias("line"), F.col("sizes").alias("size"), F.sequence(F.lit(0), F.size("lines") - 1).alias("at")), lambda x: x["size"] > 0)

    def of(lines: Column) -> Column:
        n = F.size(lines)

        def short_run(i: Column) -> Column:
            # No more lines than characters are needed.
            near = F.slice(lines, i, LEAST_CHARS)
            length = F.aggregate(near["size"], F.struct(F.lit(0).alias("sum"), F.lit(0).alias("k")), lambda s, x: F.when(
                s["sum"] >= LEAST_CHARS, s).otherwise(F.struct((s["sum"] + x).alias("sum"), (s["k"] + 1).alias("k"))))
            return F.element_at(F.transform(F.array(length), lambda m: F.when(
                m["sum"] >= LEAST_CHARS, F.xxhash64(F.slice(near["line"], F.lit(1), m["k"])))), 1)

        def at(i: Column) -> Column:
            one, two = F.get(lines, i - 1), F.get(lines, i)
            long_, next_long = one["size"] >= LEAST_CHARS, F.coalesce(two["size"] >= LEAST_CHARS, F.lit(False))
            entry = lambda run, seed: F.struct(F.lit(run).alias("run"), seed.alias("seed"), one["at"].alias("at"))
            return F.array(
                entry(1, F.when(long_, one["line"])),
                entry(2, F.when((i < n) & (long_ | next_long), F.xxhash64(one["line"], two["line"]))),
                entry(3, F.when(~long_, short_run(i))),
            )

        numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.flatten(F.transform(numbers, at)), lambda e: e["seed"].isNotNull())

    return F.element_at(F.transform(F.array(kept), of), 1)


def postings(lined: DataFrame) -> DataFrame:
    """(_row, order, run, seed, at): the seeds of each document, with the lines where they begin."""
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_row"))
    rows = lined.select("_row", order.alias("order"), F.explode(_seeds()).alias("s")).select("_row", "order", "s.*")
    return materialize(rows.groupBy("_row", "order", "run", "seed").agg(F.collect_list("at").alias("at")), "postings")


def first_documents(found: DataFrame) -> DataFrame:
    """(_run, _seed, n, earlier): of each seed of several documents their number and the first one."""
    return materialize(
        found.groupBy("run", "seed").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("first")).filter("n > 1")
        .select(F.col("run").alias("_run"), F.col("seed").alias("_seed"), "n", F.col("first._row").alias("earlier")), "firsts")


def links(found: DataFrame, firsts: DataFrame) -> DataFrame:
    """(later, earlier, at) of each posting of some seeds but those of their first document."""
    return found.join(firsts, (F.col("run") == F.col("_run")) & (F.col("seed") == F.col("_seed"))).filter(
        F.col("_row") != F.col("earlier")).select(F.col("_row").alias("later"), "earlier", "at")


def aligned(pairs: DataFrame, lined: DataFrame) -> DataFrame:
    """(later, earlier, gone): the lines of aligned blocks of each pair."""
    later = lined.select(F.col("_row").alias("_later"), "lines", "sizes")
    earlier = lined.select(F.col("_row").alias("_earlier"), F.col("lines").alias("earlier_lines"))
    # Merge joins at every size: what meets here grows with the documents, and a plan that holds
    # the smaller side whole in each task while it is small would only change on the way.
    both = pairs.hint("merge").join(later, F.col("later") == F.col("_later")).drop("_later")
    both = both.join(earlier.hint("merge"), F.col("earlier") == F.col("_earlier")).drop("_earlier")
    return both.select("later", "lines", "sizes", "earlier_lines").mapInArrow(align, "later long, gone array<int>")


def removals(lined: DataFrame) -> DataFrame:
    """(_key, _removed, n_partners): the lines that go from each document, and how many it was aligned with."""
    def per_document(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("later").alias("_key")).agg(
            F.array_distinct(F.flatten(F.collect_list("gone"))).alias("_removed"), F.count(F.lit(1)).alias("n_partners"))

    found = postings(lined)
    firsts = first_documents(found)
    rare = materialize(links(found, firsts.filter(F.col("n") <= RARE)).select("later", "earlier").distinct(), "pairs")
    first_round = materialize(per_document(aligned(rare, lined)), "removed")
    # What rare seeds have left standing of frequent ones.
    gone = first_round.select("_key", F.col("_removed").alias("_gone"))
    frequent = links(found, firsts.filter(F.col("n") > RARE))
    standing = frequent.join(gone.hint("merge"), F.col("later") == F.col("_key"), "left").filter(
        F.col("_gone").isNull() | (F.size(F.array_except("at", "_gone")) > 0)).select("later", "earlier").distinct()
    more = materialize(standing.join(rare.hint("merge"), ["later", "earlier"], "left_anti"), "more")
    second_round = per_document(aligned(more, lined))
    return materialize(
        first_round.unionByName(second_round).groupBy("_key").agg(
            F.array_distinct(F.flatten(F.collect_list("_removed"))).alias("_removed"), F.sum("n_partners").alias("n_partners")), "removed")


def line_dedup(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with ``kept_text``, ``n_lines``, ``n_removed`` and ``n_partners``.

    Lines end at a line feed. The earlier document is the one of smaller doc_id (null last),
    then the one read first, so a repeated row loses its lines to the first. Lines are
    compared by 64-bit hashes within a pair. A null or empty text has no lines and stays
    empty. An empty table gives an empty table. Input columns named like an output or as in
    ``INNER`` are left out.
    """
    bounded_batches(docs.sparkSession)
    docs = without(docs, *OUTPUT, *INNER).withColumn("_row", F.monotonically_increasing_id())
    text = whole("text")
    lined = materialize(docs.filter(F.length(text) > 0).select(
        "_row", "doc_id",
        F.transform(_lines(text), lambda x: F.xxhash64(x)).alias("lines"),
        F.transform(_lines(text), lambda x: F.char_length(x)).alias("sizes"),
    ), "lines")
    removed = removals(lined)
    lines = F.when(F.length(text) > 0, _lines(text)).otherwise(F.array().cast("array<string>"))
    # Bound as a lambda variable, the lines are split once.
    left = F.transform(F.array(F.struct("_lines", "_removed")), lambda s: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(s["_lines"]) - 1), s["_removed"]), lambda i: F.get(s["_lines"], i)), "\n"))
    kept_text = F.when(F.size("_removed") > 0, F.element_at(left, 1)).otherwise(text)
    return (
        docs.join(removed.hint("merge"), F.col("_row") == F.col("_key"), "left")
        .withColumns({"_lines": lines, "_removed": F.coalesce("_removed", F.array().cast("array<int>"))})
        .select(*[F.col(f"`{c}`") for c in docs.columns if c != "_row"], kept_text.alias("kept_text"),
                F.size("_lines").cast("long").alias("n_lines"), F.size("_removed").cast("long").alias("n_removed"),
                F.coalesce("n_partners", F.lit(0)).cast("long").alias("n_partners"))
    )


def op1_line_dedup(spark, folder: str) -> DataFrame:
    """What line dedup leaves of all documents."""
    return line_dedup(documents(spark, folder).select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", "n_partners", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
