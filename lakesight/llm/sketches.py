"""Document fingerprints: threshold-scaled sketches of word shingles.

Every shingle hash below a fixed fraction of the hash range is kept, and of a text with few
such hashes its smallest ones, so that any text with words has a sketch. The sketch of a union
follows from the sketches, and the share of one sketch found in another, over the range that
both cover, estimates containment whatever the sizes of the two documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakesight.llm.common import BLANK, documents, whole

SHINGLE = 5
#: One shingle in so many is kept.
SCALE = 8
#: A text keeps so many of its smallest shingle hashes at least, or all if it has fewer.
LEAST = 16
#: Rows of one range of doc_id, and the most bounds that go through the driver; between two bounds ranges are equally wide.
RANGE_ROWS, MOST_RANGES = 1_000, 4_096


def _bound(scale: int) -> int:
    return -(1 << 63) + (1 << 64) // scale


def _least(hashes: Column) -> Column:
    """The ``LEAST`` smallest of the hashes, sorted."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, LEAST)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _kept(hashes: Column, scale: int) -> Column:
    """Of all hashes those below 1/``scale`` of the range, or the ``LEAST`` smallest if there are fewer; sorted."""
    return _bind(hashes, lambda every: _bind(
        F.array_sort(F.array_distinct(F.filter(every, lambda h: h < _bound(scale)))),
        lambda below: F.when(F.size(below) >= LEAST, below).otherwise(_least(every)),
    ))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted distinct shingle hashes below 1/``scale`` of the range, at least the ``LEAST`` smallest, as an array of longs.

    Words are runs of other characters than blanks, lower-cased; a text of fewer words than
    a shingle is one shingle. Only a text of no words has an empty sketch.
    """
    words = F.filter(F.split(F.lower(text), f"[{BLANK}]+"), lambda w: w != "")
    return _bind(words, lambda w: F.when(F.size(w) > 0, _kept(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice(w, i, shingle)),
    ), scale)).otherwise(F.array().cast("array<bigint>")))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two documents together."""
    return _kept(F.array_union(a, b), scale)


def _reach(sketched: Column, scale: int) -> Column:
    """The greatest hash up to which a sketch has every hash of its text."""
    return F.when(F.size(sketched) < LEAST, F.lit((1 << 63) - 1)).otherwise(
        F.greatest(F.element_at(sketched, -1), F.lit(_bound(scale) - 1))
    )


def _common(a: Column, b: Column, scale: int) -> tuple[Column, Column]:
    """Both sketches over the range that both cover."""
    reach = F.least(_reach(a, scale), _reach(b, scale))
    return F.filter(a, lambda h: h <= reach), F.filter(b, lambda h: h <= reach)


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has; null if ``a`` has none in the range that both cover."""
    a, b = _common(a, b, scale)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Containment of the smaller sketch in the other, over the range that both cover.

    Without a hash of one of them there it is 0; of two texts without words it is 1.
    """
    a, b = _common(a, b, scale)
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(
        F.when(F.size(a) == F.size(b), 1.0).otherwise(0.0)
    )


def printed(sketched: Column) -> Column:
    """The hashes in hexadecimal, 16 digits each."""
    return F.array_join(F.transform(sketched, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def _range_of(bounds: list[int]) -> Column:
    """How many of the sorted bounds are below doc_id, by halving; -1 for a null doc_id."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    steps = len(bounds).bit_length()
    table = F.array(*[F.lit(b) for b in bounds])
    halves = F.array(*[F.lit(1 << s) for s in reversed(range(steps))])
    found = F.aggregate(halves, F.lit(0), lambda at, half: F.when(
        (at + half <= len(bounds)) & (F.get(table, at + half - 1) < F.col("doc_id")), at + half
    ).otherwise(at))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(found)


def _piece_of(ends: list, pieces: int) -> Column:
    """Which of so many equally wide parts of its range ``_range`` a doc_id lies in; it never falls as doc_id grows."""
    if pieces == 1 or len(ends) < 2:
        return F.lit(0)
    below = F.get(F.array(*[F.lit(float(e)) for e in ends[:-1]]), F.col("_range"))
    width = F.get(F.array(*[F.lit(float(b) - float(a)) for a, b in zip(ends, ends[1:])]), F.col("_range"))
    share = F.try_divide(F.col("doc_id").cast("double") - below, width)
    return F.coalesce(F.least(F.floor(share * pieces), F.lit(pieces - 1)), F.lit(0))


def with_next(docs: DataFrame, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Add to each row the ``columns`` of the next one by descending doc_id; after the last comes the first.

    Rows are dealt by ranges of doc_id and shuffled once; a copy of the first row of the next
    range closes each range. The number of ranges grows with the rows. Equal doc_ids are ordered
    by text, descending; a null is last.
    """
    size, least, greatest = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    fences = []
    ranges = max(1, min(MOST_RANGES, -(-size // RANGE_ROWS)))
    pieces = max(1, -(-size // (RANGE_ROWS * ranges)))
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        fences = docs.agg(F.percentile_approx("doc_id", shares, 10 * MOST_RANGES)).first()[0] or []
    fences = sorted(set(fences))
    ends = [] if least is None else [least, *fences, greatest]
    rows = docs.withColumn("_range", _range_of(fences)).withColumn("_range", F.col("_range") * F.lit(pieces) + _piece_of(ends, pieces))
    order = ["doc_id", "text"]
    heads = rows.groupBy("_range").agg(F.max(F.struct(*order, *[c for c in columns if c not in order])).alias("_head"))
    around = Window.orderBy(F.col("_range").desc())
    before = F.lag("_range").over(around)
    last = F.last("_range").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    # One row per range: the head closes the range before it, the first head the last range.
    steps = rows.select("_range").distinct().select("_range", F.coalesce(before, last).alias("_closes"))
    guards = heads.join(steps, "_range").select(
        F.col("_closes").alias("_range"), F.lit(True).alias("_guard"),
        *[(F.col(f"_head.{c}") if c in columns or c in order else F.lit(None).cast(t)).alias(c)
          for c, t in docs.dtypes],
    )
    closed = rows.withColumn("_guard", F.lit(False)).unionByName(guards)
    within = Window.partitionBy("_range").orderBy("_guard", F.col("doc_id").desc(), F.col("text").desc())
    following = closed.withColumns({f"{prefix}{c}": F.lead(c).over(within) for c in columns})
    return following.filter(~F.col("_guard")).drop("_guard", "_range")


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id and text with ``sketch``, the next document's, and the text edited by it.

    A null text counts as empty. A table of one row is its own next document; an empty
    table gives an empty table. Columns other than doc_id and text are left out.
    """
    texts = docs.select("doc_id", whole("text").alias("text"))
    paired = with_next(texts.withColumn("sketch", sketch(F.col("text"), scale=scale)), ["text", "sketch"])
    half = F.expr("int(char_length(text) div 2)")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - int(char_length(text) div 2))"),
                      F.substring(F.col("next_text"), F.lit(1), half))
    return paired.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), scale=scale))


def op3_fingerprints(spark, folder: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(documents(spark, folder)).select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
