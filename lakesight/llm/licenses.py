"""License scan by diagonal voting.

Every rolling word k-gram of the documents is hashed and joined to the positions of the same
grams in the templates. A hit votes for its diagonal, the offset of the document position
against the template position. Votes are summed by diagonal, neighbouring diagonals (a word
more or less) are merged, and the spans they cover are verified word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lakesight.llm.common import documents, whole, without
from lakesight.session import materialize

# Phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices that the method finds in addition, in part or with small changes, by label.
NOTICES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
]
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Diagonals at most so far apart are one place.
DRIFT = 3
#: Share of a notice's grams that must vote, and of its word pairs that the span must have.
LEAST_VOTES, LEAST_LIKENESS = 0.4, 0.6
# Fixed value: what separates words, everything ASCII but digits and letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTPUT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def _grams(w: Column, k: int) -> Column:
    return F.when(
        F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k)))
    ).otherwise(F.array().cast("array<bigint>"))


def templates(spark: SparkSession, phrases: dict[str, str], notices: list[tuple[str, str]]) -> DataFrame:
    """(template, label, base, pattern, k, at, gram): one row per gram of each template; a few hundred in all."""
    rows = [(i, label, base, text.split(), k) for i, (label, base, text, k) in enumerate(
        [(label, True, text, PHRASE_GRAM) for text, label in phrases.items()]
        + [(label, False, text, NOTICE_GRAM) for label, text in notices])]
    frame = spark.createDataFrame(rows, "template int, label string, base boolean, pattern array<string>, k int")
    grams = F.when(F.col("base"), _grams(F.col("pattern"), PHRASE_GRAM)).otherwise(_grams(F.col("pattern"), NOTICE_GRAM))
    return frame.select("*", F.posexplode(grams).alias("at", "gram"))


def _scanned(docs: DataFrame) -> DataFrame:
    """Add a row key, the lower-cased words and their grams of both lengths.

    Lower-casing here also changes letters beyond A to Z; that can only add hits, which the
    verification on exactly lower-cased words drops.
    """
    grams = F.transform(F.array(words(F.lower(whole("text")))), lambda w: F.struct(
        F.size(w).alias("n"), F.concat(_grams(w, PHRASE_GRAM), _grams(w, NOTICE_GRAM)).alias("grams")))
    return docs.withColumns({"_row": F.monotonically_increasing_id(), "_g": F.element_at(grams, 1)})


def votes(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(_row, template, diagonal, first, last, votes): hits summed by diagonal; first and last are word positions."""
    hits = (
        _scanned(docs).select("_row", F.col("_g.n").alias("n"), F.posexplode("_g.grams").alias("p", "gram"))
        # The templates are a fixed list, whatever the input.
        .join(F.broadcast(known.select("gram", "template", "k", "at")), "gram")
        .withColumn("position", F.col("p") - F.when(F.col("k") == NOTICE_GRAM, F.greatest(F.col("n") - (PHRASE_GRAM - 1), F.lit(0))).otherwise(0))
        # The first part of a document's grams are of the one length, the rest of the other.
        .filter((F.col("k") == NOTICE_GRAM) == (F.col("p") >= F.greatest(F.col("n") - (PHRASE_GRAM - 1), F.lit(0))))
    )
    return hits.groupBy("_row", "template", (F.col("position") - F.col("at")).alias("diagonal")).agg(
        F.min("position").alias("first"), F.max(F.col("position") + F.col("k") - 1).alias("last"), F.count(F.lit(1)).alias("votes"),
    )


def spans(voted: DataFrame, known: DataFrame) -> DataFrame:
    """Candidate places: a phrase needs all votes of one diagonal, a notice ``LEAST_VOTES`` of merged ones."""
    described = known.groupBy("template", "label", "base", "pattern").agg(F.count(F.lit(1)).alias("grams"))
    # A window holds the hits of one template in one document.
    by = Window.partitionBy("_row", "template").orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(by)
    rows = voted.join(F.broadcast(described), "template").withColumn(
        "_place", F.sum(F.when(~F.col("base") & (far <= DRIFT), 0).otherwise(1)).over(by))
    merged = rows.groupBy("_row", "template", "label", "base", "pattern", "grams", "_place").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("votes").alias("votes"))
    return merged.filter(F.when(F.col("base"), F.col("votes") == F.col("grams")).otherwise(F.col("votes") >= LEAST_VOTES * F.col("grams")))


def _pairs(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 2), " "))


def license_scan(docs: DataFrame, keep: list[str] | None = None, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """All rows of ``docs``, columns ``keep`` or all, with the columns ``OUTPUT``.

    ``n_base`` counts the places of the phrases, ``first_word`` and ``last_word`` are their
    least and largest start (null without any); ``base_labels`` and ``labels``, with those of
    the notices, are sorted and joined by commas (empty without any); ``score`` is the best
    verified likeness, 0 without a find. A null text counts as empty. Repeated rows are each
    scanned; an empty table gives an empty table. Input columns named like an output,
    ``_row``, ``_g`` or ``_key`` are left out.
    """
    docs = without(docs, *OUTPUT, "_row", "_g", "_key")
    kept = [F.col(f"`{c}`") for c in (keep or docs.columns)]
    known = templates(docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    places = materialize(spans(votes(docs, known), known), "places")
    # Only rows with a hit send their text to the verification; template grams are a bounded list.
    grams = F.array(*[F.lit(r["gram"]) for r in known.select("gram").distinct().collect()]).cast("array<bigint>")
    exact = words(F.translate(whole("text"), UPPER, LOWER))
    hit = _scanned(docs).filter(F.arrays_overlap("_g.grams", grams)).select(F.col("_row").alias("_key"), exact.alias("_words"))
    part = F.slice(F.col("_words"), F.col("first") + 1, F.col("last") - F.col("first") + 1)
    checked = (
        places.join(hit, F.col("_row") == F.col("_key")).withColumn("_part", part)
        .withColumn("likeness", F.when(F.col("base"), (F.col("_part") == F.col("pattern")).cast("double")).otherwise(
            F.size(F.array_intersect(_pairs(F.col("_part")), _pairs(F.col("pattern")))) / F.size(F.array_distinct(_pairs(F.col("pattern"))))))
        .filter(F.when(F.col("base"), F.col("likeness") == 1).otherwise(F.col("likeness") >= LEAST_LIKENESS))
        .select("_row", "base", "label", "first", "likeness")
    )
    base = F.col("base")
    found = checked.groupBy(F.col("_row").alias("_key")).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("likeness").alias("score"),
    )
    counted = docs.withColumns({"_row": F.monotonically_increasing_id(), "n_words": F.size(words(F.lower(whole("text")))).cast("long")})
    return counted.join(materialize(found, "licenses"), F.col("_row") == F.col("_key"), "left").select(
        *kept, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op8_licenses(spark, folder: str) -> DataFrame:
    """License phrases and notices of all documents."""
    return license_scan(documents(spark, folder).select("doc_id", "text"), keep=["doc_id"])
