"""The stages of the training-data pipeline, from raw documents to token numbers.

Each takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Columns named like those that the operators add inside are left out. An
empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakesight.llm import bpe, exact_dedup, language, mixing, simhash
from lakesight.llm.common import without
from lakesight.session import materialize

#: Of the held-out documents whose language is told rightly, the share that the bound on the score may lose.
LOST = 0.005
#: So many documents count as much as what is assumed before any is seen.
PRIOR = 20


def shrunk(low: float, n: int, before: float) -> float:
    """A bound from ``n`` documents and one from before: the more documents, the nearer to theirs."""
    return (n * low + PRIOR * before) / (n + PRIOR)


def least_scores(judged: DataFrame) -> dict[str, float]:
    """For each predicted language the score below which a document is of no clear language.

    It is a low quantile of the scores of held-out documents of that language that are told
    rightly (the least of few), drawn towards that of all languages together, and this one
    towards 0: with few documents to go by, little is rejected, and nothing changes at once
    when there are some more. No language's bound is above what its own documents say.
    """
    right = judged.filter(language.held_out() & (F.col("lang") == F.col("lang_pred")))
    rows = right.rollup("lang_pred").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("score", LOST, 10_000).alias("low")
    ).collect()
    every = next((r for r in rows if r["lang_pred"] is None), None)
    if every is None or not every["n"]:
        return {}
    together = shrunk(every["low"], every["n"], 0.0)
    return {r["lang_pred"]: min(r["low"], shrunk(r["low"], r["n"], together)) for r in rows if r["lang_pred"] is not None}


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents without letters (null and empty ones among them) and those of no clear language.

    The network learns from the documents themselves: from texts with a language that are not
    held out. Those held out tell what score is clear. If there is none to learn from, nothing
    can be told and only texts without letters go.
    """
    network = language.fit(docs)
    letters = docs.filter(F.col("text").rlike(r"\p{L}"))
    if network is None:
        return letters
    judged = materialize(language.predict(letters, network), "judged")
    least = F.lit(0.0)
    for label, score in least_scores(judged).items():
        least = F.when(F.col("lang_pred") == label, score).otherwise(least)
    return judged.filter(F.col("score") >= least).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for blanks, keep the longest, then that of the smallest doc_id (null last)."""
    return exact_dedup.exact_dedup(docs).filter("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component keep one document: of the smallest doc_id (null last), then text hash, then the one read first."""
    rows = without(docs, "_row", "_hash", "_root").withColumn("_row", F.monotonically_increasing_id())
    groups = simhash.simhash_groups(
        rows.withColumn("_hash", F.xxhash64("text")), keep=["doc_id", "_row", "_hash"], root="_root")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_hash"), F.col("_row"))
    # Texts travel once, to the rows that are kept.
    kept = groups.groupBy("_root").agg(F.min(order).alias("_first")).select(F.col("_first._row").alias("_kept"))
    return rows.join(kept.hint("merge"), F.col("_row") == F.col("_kept"), "left_semi").drop("_row")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that each source comes near its target of words."""
    columns = without(docs, *mixing.OUTPUT, *mixing.INNER).columns
    taken = mixing.mix(docs).filter("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and token numbers of every document, with digests of them and of the text they decode to."""
    import public_tokenizers

    return bpe.round_trip(
        docs.select("doc_id", "source", "text"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True,
    )
