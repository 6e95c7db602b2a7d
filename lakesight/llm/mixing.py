"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target number of words. Whole copies that every document of the source
gets are certain; the rest is a sample of fixed size in words, drawn in Pareto order: the
document's random odds u/(1-u) divided by its inclusion odds p/(1-p), smallest first.
The decision on a document depends on its own hash and a few numbers of its source, so the
texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lakesight.llm.common import BLANK, documents, ranked, uniform, whole, without
from lakesight.session import materialize

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_COPIES = 2.0
#: Order keys are cut in two steps: first among this many slices of a source, then inside one.
SLICES = 4096
#: After the first cut, so many times more documents that still fit fill what is left of the target.
FILLS = 3
#: Equal rows are numbered in ranges of 2 to this power rows of one scan partition.
RANGE_BITS = 16
#: Inclusion grows with the size to this power: long documents are settled first, short ones fit the rest to the target.
SIZE_POWER = 0.5
OUTPUT = ["size", "source_size", "target", "copies", "taken"]
INNER = ["_row", "_copy", "_twin", "_u", "_w", "_source", "_whole", "_rest", "_alpha", "_left", "_cuts", "_limits", "_key"]


def words(text: str) -> Column:
    return F.regexp_count(whole(text), F.lit(f"[^{BLANK}]+")).cast("long")


def numbered_copies(docs: DataFrame) -> DataFrame | None:
    """(_twin, _copy) of the rows that repeat an earlier row's doc_id and text, numbered from 1; None if no row does.

    ``docs`` has ``_row``. Equal rows are interchangeable, so any numbering draws alike. They
    are counted in the ranges of the scan they come from, and each range starts where the
    ones before it end: a text that fills a third of the table is numbered in many tasks.
    """
    keyed = docs.select("_row", F.xxhash64("doc_id", whole("text")).alias("_key"), F.shiftright("_row", RANGE_BITS).alias("_range"))
    repeated = materialize(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_key"), "repeated")
    if repeated.isEmpty():
        return None
    twins = materialize(keyed.join(repeated, "_key", "left_semi"), "twins")
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = twins.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_key", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_key", "_range").orderBy("_row")) - 1
    numbered = twins.withColumn("_at", inside).join(starts, ["_key", "_range"])
    return materialize(numbered.select(F.col("_row").alias("_twin"), (F.col("_at") + F.col("_start")).alias("_copy")).filter("_copy > 0"), "copies")


def _drawn(docs: DataFrame, seed: int, copies: DataFrame | None) -> DataFrame:
    """Size, random number and inclusion weight (in steps of 1/64 octave) of each document."""
    steps = F.round(F.log2(F.col("size").cast("double")) * SIZE_POWER * 64) / 64
    own = [F.col("doc_id"), whole("text"), F.lit(seed)]
    draw = uniform(*own)
    if copies is not None:
        docs = docs.join(copies, F.col("_row") == F.col("_twin"), "left")
        draw = F.when(F.col("_copy").isNull(), draw).otherwise(uniform(*own, F.col("_copy")))
    return docs.withColumn("size", words("text")).withColumns({
        "_u": draw,
        "_w": F.when(F.col("size") > 0, F.pow(F.lit(2.0), steps)).otherwise(F.lit(0.0)),
    })


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): shares by weight, none above ``most`` times its source.

    The level of the uncapped sources is found by rounds over the table of sources; each
    round brings two numbers to the driver.
    """
    order = [F.col("source").asc_nulls_last()]
    index = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = materialize(ranked(sizes, order, "_rank").withColumn("_weight", index), "sources")
    cap = F.col("source_size") * most
    total = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:
        full = cap < F.col("_weight") * level
        capped, open_weight = rows.agg(
            F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_weight")))
        ).first()
        raised = (total - (capped or 0.0)) / open_weight if open_weight else level
        if raised <= level:
            break
        level = raised
    return rows.select("source", "source_size", F.least(cap, F.col("_weight") * max(level, 0.0)).alias("target"))


def inclusion_levels(profile: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, _alpha, _sure): p = min(1, alpha · w) of which the expected words fill the rest.

    ``profile`` has the words of each source by weight. Weights come in steps, so that a
    source has a few thousand rows here, however many documents it has.
    """
    by = Window.partitionBy("source").orderBy(F.col("_w").desc())
    above = F.coalesce(F.sum("_words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    below = F.sum(F.col("_words") * F.col("_w")).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    fits = profile.filter("_w > 0").join(plan, profile.source.eqNullSafe(plan.source)).select(
        profile.source, "_w", "_words", "_rest"
    ).withColumns({"_above": above, "_below": below}).withColumn(
        "_alpha", (F.col("_rest") - F.col("_above")) / F.col("_below")
    ).filter(F.col("_alpha") * F.col("_w") < 1.0)
    return fits.groupBy("source").agg(
        F.max_by(F.struct("_alpha", F.col("_above").alias("_sure")), "_w").alias("_at")
    ).select("source", "_at._alpha", "_at._sure")


def _order_key() -> Column:
    """The Pareto order key as q/(1+q), in (0, 1); 0 for a certain document, 2 for one with no chance."""
    p = F.col("_alpha") * F.col("_w")
    odds, inclusion = F.col("_u") / (1 - F.col("_u")), p / (1 - p)
    return F.when(p >= 1, F.lit(0.0)).when(p > 0, odds / (odds + inclusion)).otherwise(F.lit(2.0))


def _chosen() -> Column:
    """Some round of the cuts takes the document."""
    rounds = F.arrays_zip(F.col("_cuts"), F.col("_limits"))
    return F.exists(rounds, lambda r: (F.col("_key") <= r["_cuts"]) & (F.col("size") <= r["_limits"]))


def next_cut(rows: DataFrame, budgets: DataFrame, nearest: bool) -> DataFrame:
    """(source, _cut, _words): the order key up to which documents fit the source's ``_left`` words.

    ``rows`` has source, size and _key. The slice of keys that holds the cut is found from
    sums per slice; only that slice is put in order.
    """
    sliced = rows.withColumn("_slice", F.floor(F.col("_key") * SLICES).cast("int"))
    sums = sliced.groupBy("source", "_slice").agg(F.sum("size").alias("_n"))
    upto = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = materialize(
        sums.withColumn("_sum", F.sum("_n").over(upto)).join(budgets.select(F.col("source").alias("_s"), "_left"),
                                                             F.col("source").eqNullSafe(F.col("_s")))
        .groupBy("source", "_left").agg(
            F.min(F.when(F.col("_sum") > F.col("_left"), F.struct("_slice", (F.col("_sum") - F.col("_n")).alias("_before")))).alias("_at"),
            F.max("_sum").alias("_all"),
        ).select("source", "_left", "_at._slice", "_at._before", "_all"), "slices")
    edge = met.filter("_slice is not null").select(
        F.col("source").alias("_s"), F.col("_slice").alias("_edge"), "_left", "_before"
    )
    inside = sliced.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_edge")))
    order = Window.partitionBy("source").orderBy("_key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("_sum", F.col("_before") + F.sum("size").over(order))
    off = F.abs(F.col("_sum") - F.col("_left")) if nearest else F.when(F.col("_sum") <= F.col("_left"), F.col("_left") - F.col("_sum"))
    start = F.struct(F.abs(F.col("_left") - F.col("_before")).alias("off"), (F.col("_edge") / F.lit(float(SLICES))).alias("key"), F.col("_before").cast("long").alias("words"))
    best = inside.groupBy("source").agg(
        F.min(F.when(off.isNotNull(), F.struct(off.alias("off"), F.col("_key").alias("key"), F.col("_sum").cast("long").alias("words")))).alias("_in"),
        F.min(start).alias("_start"),
    ).select("source", F.least(F.coalesce("_in", "_start"), F.col("_start")).alias("_best"))
    return best.select("source", F.col("_best.key").alias("_cut"), F.col("_best.words").alias("_words")).unionByName(
        met.filter("_slice is null").select("source", F.lit(1.0).alias("_cut"), F.col("_all").alias("_words"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, seed: int = 10) -> DataFrame:
    """All rows of ``docs`` with ``size`` (words), ``source_size``, ``target``, ``copies`` and ``taken`` (words).

    A null text has size 0 and is never sampled; a null source is a source of its own,
    ordered last. Rows of equal doc_id and text are drawn one by one. Documents of no words get the whole copies only. An empty table gives an empty
    table. Input columns named like an output or as in ``INNER`` are replaced or left out.
    The draw depends on doc_id, text and ``seed`` alone, so reruns agree.
    """
    columns = without(docs, *OUTPUT, *INNER).columns
    docs = without(docs, *OUTPUT, *INNER).withColumn("_row", F.monotonically_increasing_id())
    copies = numbered_copies(docs)
    narrow = materialize(_drawn(docs.select("_row", "doc_id", "source", "text"), seed, copies).select("source", "size", "_u", "_w"), "drawn")
    profile = materialize(narrow.groupBy("source", "_w").agg(F.sum("size").alias("_words")), "profile")
    sizes = profile.groupBy("source").agg(F.sum("_words").alias("source_size"))
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = materialize(
        targets(sizes, weights, share, most).withColumn("_whole", F.floor(times).cast("int"))
        .withColumn("_rest", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0))), "plan")
    levels = inclusion_levels(profile, plan).withColumnRenamed("source", "_s")
    params = materialize(
        plan.join(levels, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        .withColumns({
            "_alpha": F.coalesce("_alpha", F.lit(0.0)),
            "_left": F.col("_rest") - F.coalesce("_sure", F.lit(0.0)),
            "_cuts": F.array(F.lit(0.0)), "_limits": F.array(F.lit(1 << 62)),
        }).drop("_sure"), "levels")

    def keyed(rows: DataFrame) -> DataFrame:
        p = params.withColumnRenamed("source", "_source")
        return rows.join(p, F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("_key", _order_key())

    for fill in range(1 + FILLS):
        # The last round may pass the target, by less than what is missing now.
        fits = F.col("_left") * (2 if fill == FILLS else 1)
        rows = keyed(narrow.filter("size > 0")).filter(
            ~_chosen() & (F.col("_key") < 1) & (F.col("size") <= fits if fill else F.lit(True))
        ).select("source", "size", "_key")
        cut = materialize(next_cut(rows, params, nearest=fill == FILLS), "cut").withColumnRenamed("source", "_s")
        limit = F.floor(fits).cast("long") if fill else F.lit(1 << 62)
        params = materialize(
            params.join(cut, F.col("source").eqNullSafe(F.col("_s")), "left").withColumns({
                "_cuts": F.concat("_cuts", F.array(F.coalesce("_cut", F.lit(0.0)))),
                "_limits": F.concat("_limits", F.array(limit)),
                "_left": F.col("_left") - F.coalesce("_words", F.lit(0)),
            }).drop("_s", "_cut", "_words"), "cuts")

    taken = F.col("_whole") + F.when(_chosen() & (F.col("size") > 0), 1).otherwise(0)
    return keyed(_drawn(docs, seed, copies)).select(
        *[F.col(f"`{c}`") for c in columns], "size", "source_size", "target",
        taken.cast("int").alias("copies"), (taken * F.col("size")).cast("long").alias("taken"),
    )


def op10_mix_sources(spark, folder: str) -> DataFrame:
    """How often the mix takes each document."""
    return mix(documents(spark, folder).select("doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )
