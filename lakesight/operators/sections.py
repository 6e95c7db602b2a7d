"""Documents with numbered headings: sections, routing and renumbering.

All of it is per-document text work inside one row: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from lakesight.functions.text import rstrip

RULE = "---\n\n"
SEPARATOR = "\n" + RULE
HEADING = r"^## \d+\. "
#: A text of two gigabytes has no more than 2^29 separators.
PLACE_BITS = 29


def pieces(text: Column) -> Column:
    """The text before the first heading, then one piece per ``## n. `` heading."""
    return F.split(text, r"(?md)(?=^## \d+\. )", -1)


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _separators(parts: Column) -> Column:
    """The places of the pieces that hold a separator, in order."""
    return F.filter(F.transform(parts, lambda piece, i: F.when(piece.contains(SEPARATOR), i)), lambda i: i.isNotNull())


def _before(places: Column, i: Column) -> Column:
    """The last of the sorted places below ``i``, found by halving; NULL if there is none."""
    steps = F.array(*[F.lit(1 << bit) for bit in reversed(range(PLACE_BITS))])
    n = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(places, at + step - 1) < i, at + step).otherwise(at))
    return F.get(places, n - 1)


def _opening(parts: Column, separators: Column, i: Column) -> Column:
    """What precedes piece ``i`` since the last separator, which is written in front."""
    return _bind(_before(separators, i), lambda at: F.when(at.isNull(), "").otherwise(F.concat(
        F.lit(RULE), F.substring_index(F.get(parts, at), SEPARATOR, -1), F.array_join(F.slice(parts, at + 2, i - at - 1), ""),
    )))


def route(number: Column, routes: Mapping[str, Iterable[int]], default: str) -> Column:
    """The bucket whose id set holds the section number."""
    rule = None
    for bucket, ids in routes.items():
        hit = number.isin(list(ids))
        rule = F.when(hit, bucket) if rule is None else rule.when(hit, bucket)
    return F.lit(default) if rule is None else rule.otherwise(default)


def split_documents(
    documents: DataFrame, routes: Mapping[str, Iterable[int]], default: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per numbered section with its place, number, bucket and text.

    A section starts at the last separator line before its heading, wherever that
    is; without one it starts at the heading. It ends one character before the next
    heading, trailing white space removed.
    """
    # Arrays are columns of their own: named again inside a lambda, an expression would run per element.
    found = documents.select(key, pieces(F.col(text)).alias("parts")).select(key, "parts", _separators(F.col("parts")).alias("separators"))

    def section(piece: Column, i: Column) -> Column:
        kept = F.when(i + 1 == F.size("parts"), piece).otherwise(F.left(piece, F.length(piece) - 1))
        body = rstrip(F.concat(_opening(F.col("parts"), F.col("separators"), i), kept))
        number = F.regexp_extract(piece, r"^## (\d+)\. ", 1).try_cast("int")
        return F.when(piece.rlike(HEADING), F.struct(number.alias("number"), body.alias("body")))

    # Only the first piece can be without a heading.
    first = F.when(F.get("parts", F.lit(0)).rlike(HEADING), 0).otherwise(1)
    sections = found.select(key, F.slice(F.transform("parts", section), first + 1, 2_147_483_647).alias("sections"))
    # The outer form keeps the optimizer from adding a size filter that computes the array twice.
    exploded = sections.select(key, F.posexplode_outer("sections").alias("position", "s")).where("position IS NOT NULL")
    return exploded.select(
        key, "position", F.col("s.number").alias("number"),
        route(F.col("s.number"), routes, default).alias("bucket"), F.col("s.body").alias("body"),
    )


def renumber(documents: DataFrame, text: str = "text") -> DataFrame:
    """Sections numbered 1, 2, 3 … with their subsections, repeated separators collapsed."""
    split = documents.withColumn("_parts", pieces(F.col(text)))
    shift = F.when(F.get("_parts", F.lit(0)).rlike(HEADING), 1).otherwise(0)

    def numbered(piece: Column, i: Column) -> Column:
        number = (i + F.col("_shift")).cast("string")
        renamed = F.regexp_replace(piece, F.lit(HEADING), F.concat(F.lit("## "), number, F.lit(". ")))
        children = F.regexp_replace(
            renamed, F.lit(r"(?md)^### \d+\.(\d+)\s*"), F.concat(F.lit("### "), number, F.lit(".$1 "))
        )
        return F.when(piece.rlike(HEADING), children).otherwise(piece)

    joined = F.array_join(F.transform("_parts", numbered), "")
    collapsed = F.regexp_replace(joined, r"(\n---\n\n)(\s*---\n\n)+", "$1")
    return split.withColumn("_shift", shift).withColumn(text, collapsed).drop("_parts", "_shift")
