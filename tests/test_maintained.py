"""Rollups and key ranges that follow the edits of a table, against folding it anew."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakesight.operators import maintained as M, runsketches as K
from lakesight.plans.refresh import FOLDS, refreshed_parts, sales_of
from lakesight.plans.snapshot import section_parts
from lakesight.sources import ranges
from lakesight.sources.store import TableStore

SALES = "id string, brand string, fridge_model string, store_name string, price decimal(18,2), feedback_sentiment_category string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sale(rng, i):
    price = rng.choice([None, *[Decimal(rng.randrange(1, 40)) for _ in range(6)]])
    return (f"{i:05d}", rng.choice(["A", "A", "B", None]), rng.choice(["m", "n", None]), rng.choice(["s1", "s2", ""]), price,
            rng.choice(["Negative", "Positive", "Neutral", None]))


@pytest.mark.parametrize("extremes", [16, 2])
def test_partials_after_changes_equal_a_new_fold(spark, extremes, monkeypatch):
    monkeypatch.setattr(M, "EXTREMES", extremes)
    rng, keys = random.Random(extremes), ["brand", "fridge_model"]
    table = [sale(rng, i) for i in range(60)]
    frame = lambda r: spark.createDataFrame(r, SALES)
    parts, asked = M.build(frame(table), keys), []
    for _ in range(2):
        gone = rng.sample(table, 30)
        came = [sale(rng, i) for i in range(rng.randrange(25))]
        table = [r for r in table if r not in gone] + came

        def present(groups, now=list(table)):
            asked.append(groups.count())
            return M.rows_in(frame(now), groups, keys)

        parts = M.apply_changes(parts, M.changes(frame(gone), frame(came)), keys, present)
        fresh = M.build(frame(table), keys)
        assert rows(M.as_partials(parts, keys)) == rows(M.as_partials(fresh, keys))
    # Long lists outlast these changes; short ones run empty and are folded again, group by group.
    assert (sum(asked) > 0) == (extremes == 2)


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path))


def test_refreshed_parts_after_puts_and_deletes(spark, store):
    rng = random.Random(8)
    frame = lambda r: spark.createDataFrame(r, SALES)
    ranges.write_ranged(store, "sales_raw", frame([sale(rng, i) for i in range(0, 400, 2)]), ranges=8)

    def check():
        found, wanted = refreshed_parts(store), section_parts(sales_of(store.current("sales_raw")))
        for parts, fresh, keys in zip(found, wanted, FOLDS.values(), strict=True):
            columns = [*keys, "n", "revenue", "low", "high", "negative", "positive"]
            assert rows(parts.select(columns)) == rows(fresh.select(columns))

    check()
    for at in (0, 390):
        store.edit("sales_raw", frame([sale(rng, i) for i in range(at, at + 9)]))
        store.edit("sales_raw", frame([sale(rng, i) for i in range(at + 4, at + 20)]).select("id"), delete=True)
        check()
    # Repeating the last edit changes nothing; a new version is folded from the start.
    store.edit("sales_raw", store.current("sales_raw").limit(5))
    check()
    ranges.compact_ranged(store, "sales_raw")
    check()


def scanned(spark, df):
    """Rows that the file scans of a plan returned."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        frame = df.select("*")
        plan = frame._jdf.queryExecution().executedPlan()
        frame._jdf.queryExecution().toRdd().count()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()) if "Scan" in leaves.apply(i).nodeName())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_lookup_reads_only_the_ranges_of_its_keys(spark, store):
    table = spark.range(20_000).select(F.format_string("%06d", "id").alias("id"), F.col("id").alias("v"))
    ranges.write_ranged(store, "t", table, ranges=10)
    keys = spark.createDataFrame([("000007",), ("013333",), ("x",)], "id string")
    rows_, _ = ranges.borders(store, "t")
    spans = ranges._spans(rows_, ranges.placed(keys, rows_, "id"))
    found = ranges.lookup(store, "t", keys, spans)
    assert rows(found.select("v")) == [(13333,), (7,)]
    near = store.current("t").where(ranges.within("id", spans))
    assert "PushedFilters: [Or(" in near._jdf.queryExecution().toString()
    assert 0 < scanned(spark, near) < 9_000


def test_stored_pages_follow_the_edits(spark, store):
    rng = random.Random(2)
    kind = "id string, v int"
    table = {f"{i:04d}": 0 for i in range(0, 900, 3)}
    ranges.write_ranged(store, "t", spark.createDataFrame([*table.items(), (None, -1), (None, -1)], kind), ranges=7)

    def check():
        expected = [*sorted(table), None, None]
        for offset in (0, len(table) // 2, len(table) - 3, len(table) + 2):
            found = ranges.stored_page(store, "t", "id", 6, offset)
            assert [r["id"] for r in found.rows.collect()] == expected[offset : offset + 6] and found.total == len(expected)

    check()
    for number in (1, 2):
        puts = {f"{rng.randrange(2000):04d}": number for _ in range(40)}
        gone = rng.sample(sorted(table), 15) + ["none"]
        store.edit("t", spark.createDataFrame(list(puts.items()), kind))
        table |= puts
        store.edit("t", spark.createDataFrame([(k,) for k in gone], "id string"), delete=True)
        for k in gone:
            table.pop(k, None)
        check()
    before = store.runs("t_keys")
    assert ranges.stored_page(store, "t", "id", 9999, -5).rows.count() == min(500, len(table) + 2)
    assert store.runs("t_keys") == before
    with pytest.raises(ValueError):
        ranges.stored_page(store, "t", "id", -1)


def test_files_in_no_order_form_one_range(spark, store):
    store.write("t", spark.createDataFrame([(i,) for i in range(50)], "id int").repartition(4))
    assert ranges.directory(store, "t").count() == 1
    assert [r["id"] for r in ranges.stored_page(store, "t", "id", 3, 40).rows.collect()] == [40, 41, 42]
    store.write("empty", spark.createDataFrame([], "id int"))
    assert ranges.stored_page(store, "empty", "id", 3, 0).rows.collect() == []


def test_sketches_of_runs_merge(spark, store):
    rows = spark.range(30_000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") % 5000).alias("who"), F.col("id").cast("double").alias("v"))
    for run in range(3):
        K.add_run(store, "s", rows.where(F.col("v") % 10 % 3 == run), f"r{run}", ["g"], "who", "v")
    K.add_run(store, "s", rows.where("v % 10 % 3 = 1"), "r1", ["g"], "who", "v")
    said = {r["g"]: r for r in K.estimated(K.merged(store, "s", ["g"]), ["g"], {"p10": 0.1, "p50": 0.5}).collect()}
    for r in said.values():
        assert r["n"] == 10_000 and abs(r["distinct"] - 5000) <= K.DISTINCT_ERROR * 5000
        assert abs(r["p10"] / 30_000 - 0.1) < K.RANK_ERROR and abs(r["p50"] / 30_000 - 0.5) < K.RANK_ERROR
    # Nulls are no values; one run alone, and none.
    K.add_run(store, "n", spark.createDataFrame([("a", None, None), ("b", 1, 2.0)], "g string, who long, v double"), "r", ["g"], "who", "v")
    none = {r["g"]: (r["n"], r["distinct"], r["p"]) for r in K.estimated(K.merged(store, "n", ["g"]), ["g"], {"p": 0.5}).collect()}
    assert none == {"a": (1, 0, None), "b": (1, 1, 2.0)}
    assert K.merged(store, "n", ["g"], F.col("run") == "other").count() == 0
