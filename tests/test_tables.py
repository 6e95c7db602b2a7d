"""Load, keyed maintenance, the snapshot lane and the table store."""

import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F, types as T

from lakesight import schema, session
from lakesight.operators import keyed, rollups as R
from lakesight.plans import load as lane, snapshot as snap
from lakesight.sources import csv_files
from lakesight.sources.store import (
    TableStore, bootstrap, load_once, require_rows, require_vectors, reset_schema, vector_report,
)

HEADER = ",".join(csv_files.REQUIRED_COLUMNS)
few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def line(id_, rating="4", brand="LG", feedback="fine", price="10.50"):
    return f'{id_},c1,{brand},M1,350,{price},2026-01-02,Main,"1 A St, Boston",{feedback},{rating},Positive'


def load(spark, path, *lines, header=HEADER, **options):
    path.write_text("\n".join([header, *lines]) + "\n")
    return csv_files.clean_raw(csv_files.read_raw_csv(spark, str(path)), **options)


def test_csv_cleaning_and_last_row(spark, tmp_path):
    rows = load(
        spark, tmp_path / "a.csv", line("1"), line("2", brand="N/A"), line("1", feedback='"two\nlines, ""quoted"""', rating=""),
        line("3", brand="", price="x"),
    )
    got = {r["id"]: r for r in csv_files.last_in_file(rows).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["1"]["customer_feedback"] == 'two\nlines, "quoted"' and got["1"]["feedback_rating"] is None
    assert got["2"]["brand"] is None and got["2"]["feedback_rating"] == 4
    assert got["3"]["brand"] is None and got["3"]["price"] is None
    assert got["1"]["store_address"] == "1 A St, Boston" and got["1"]["price"] == Decimal("10.50")


def test_ratings_follow_the_type_of_the_whole_column(spark, tmp_path):
    numbers = load(spark, tmp_path / "n.csv", line("1", "4"), line("2", "4.7"), line("3", ""))
    assert [r["feedback_rating"] for r in numbers.orderBy("id").collect()] == [4, 4, None]
    mixed = load(spark, tmp_path / "m.csv", line("1", "4"), line("2", "4.0"), line("3", "x"))
    assert [r["feedback_rating"] for r in mixed.orderBy("id").collect()] == [4, None, None]


def test_missing_csv_column(spark, tmp_path):
    with pytest.raises(ValueError, match="Missing required column: FEEDBACK_SENTIMENT_CATEGORY"):
        load(spark, tmp_path / "bad.csv", "1,c", header=HEADER.rsplit(",", 1)[0])


def test_files_follow_by_name(spark, tmp_path):
    for name, brand in (("b.csv", "late"), ("a.csv", "early")):
        (tmp_path / name).write_text(f"{HEADER}\n{line('1', brand=brand)}\n")
    rows = csv_files.clean_raw(csv_files.read_raw_csv(spark, str(tmp_path)))
    assert csv_files.last_in_file(rows).first()["brand"] == "late"


def test_store_versions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert store.version("t") is None and store.is_empty("t")
    assert store.write("t", spark.range(3)).count() == 3
    # A version may be computed from the one it replaces.
    assert store.write("t", store.read("t").where("id > 0")).count() == 2
    assert store.version("t") == 2 and not store.exists("other")
    with pytest.raises(FileNotFoundError):
        store.read("other")


def test_load_once(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    assert load_once(store, "t", lambda: spark.range(2))[1]
    again, written = load_once(store, "t", lambda: spark.range(9))
    assert not written and again.count() == 2
    assert load_once(store, "t", lambda: spark.range(9), force=True)[0].count() == 9


def test_minimum_rows(spark):
    assert require_rows(spark.range(10)).count() == 10
    with pytest.raises(RuntimeError, match="only 9 rows"):
        require_rows(spark.range(9))


def test_bootstrap(spark, tmp_path):
    assert bootstrap(spark, str(tmp_path)).agg(F.count("x"), F.sum("x")).first() == (100, 4950)


def test_schema_reset(spark):
    reset_schema(spark, "lakesight_test", force=True)
    reset_schema(spark, "lakesight_test")
    table = spark.table("lakesight_test.sales_embeddings")
    assert table.columns == schema.SALES_EMBEDDINGS.fieldNames()
    assert schema.vector_column_ok(table) and not schema.vector_column_ok(spark.table("lakesight_test.sales_raw"))
    spark.sql("DROP DATABASE lakesight_test CASCADE")


def test_vectors_of_wrong_length(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0]), ("c", None)], "id string, embedding array<double>")
    assert tuple(vector_report(df, 2).first()) == (True, 3, 2)
    with pytest.raises(ValueError):
        require_vectors(df, 2)
    with pytest.raises(RuntimeError):
        require_vectors(df.drop("embedding"), 2)
    assert require_vectors(df.where("id = 'a'"), 2).count() == 1


def test_session_settings():
    assert session.spark_path("s3://b/k") == "s3a://b/k" and session.spark_path("gs://b/k") == "gs://b/k"
    aws = session.session_settings("aws")
    assert aws["spark.hadoop.fs.s3a.connection.timeout"] == "60000" and len(session.S3A_NUMERIC_OVERRIDES) == 12
    assert "spark.hadoop.fs.gs.impl" in session.session_settings("gcp")
    assert not any("s3a" in k or "gs" in k for k in session.session_settings())


def keys(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


@few
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 9)), min_size=1, max_size=20), st.integers(1, 6))
def test_last_write_wins_whatever_the_partitioning(spark, pairs, partitions):
    rows = [(k, i, v) for i, (k, v) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "id int, seq int, v int").repartition(partitions)
    got = {r["id"]: r["v"] for r in keyed.last_write_wins(df, "id", ["seq"]).collect()}
    assert got == dict(pairs)


@few
@given(st.dictionaries(st.integers(0, 9), st.integers(), max_size=6), st.dictionaries(st.integers(0, 9), st.integers(), max_size=6))
def test_upsert_twice_changes_nothing(spark, old, new):
    frame = lambda d: spark.createDataFrame([(k, str(v)) for k, v in d.items()], "id int, v string")
    once = keyed.upsert(frame(old), frame(new))
    assert keys(once) == sorted((k, str(v)) for k, v in {**old, **new}.items())
    assert keys(keyed.upsert(once, frame(new))) == keys(once)


def raw(spark, *ids):
    rows = [(i, "c", "LG", "M", Decimal(300), Decimal(5), dt.date(2026, 1, 1), "S", "A", "F", 7, "Positive") for i in ids]
    return spark.createDataFrame(rows, schema.SALES_RAW)


def test_full_row_edits(spark):
    edits = spark.createDataFrame([("a", None), ("z", Decimal(3))], "id string, price decimal(18,2)")
    edited = keyed.replace_rows(raw(spark, "a", "b"), keyed.full_rows(edits))
    rows = {r["id"]: r.asDict() for r in edited.table.collect()}
    assert rows["a"] == {
        "id": "a", "customer_id": "", "brand": "Unknown", "fridge_model": "Unknown", "capacity_liters": None,
        "price": Decimal("0.00"), "sales_date": None, "store_name": "Unknown", "store_address": "",
        "customer_feedback": "", "feedback_rating": None, "feedback_sentiment_category": "Neutral",
    }
    assert rows["b"]["brand"] == "LG" and keys(edited.not_found) == [("z",)]


def test_deletes(spark):
    ids = spark.createDataFrame([("a",), ("x",), ("a",)], "id string")
    vectors = spark.createDataFrame([("a",), ("b",), ("x",)], "id string")
    result = keyed.delete_rows(raw(spark, "a", "b").select("id"), vectors, ids)
    assert (keys(result.raw), keys(result.embeddings), keys(result.not_found)) == ([("b",)], [("b",), ("x",)], [("x",)])


def test_changed_rows_and_refresh(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", 1.0)], "id int, t string, v double")
    after = spark.createDataFrame([(1, "a", None), (2, "c", 1.0), (3, "d", None)], before.schema)
    changed = keyed.changed_rows(before, after)
    assert [r["id"] for r in changed.orderBy("id").collect()] == [2, 3]
    vectors = spark.createDataFrame([(1, "old"), (2, "old")], "id int, e string")
    fresh = keyed.refresh_vectors(vectors, changed.select("id"), lambda df: df.withColumn("e", F.lit("new")))
    assert keys(fresh) == [(1, "old"), (2, "new"), (3, "new")]


def test_pages(spark):
    ids = [str(i) for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    expected = sorted(ids)
    got = [r["id"] for o in range(0, 300, 70) for r in keyed.page(df, "id", 70, o).rows.collect()]
    assert got == expected
    assert [r["id"] for r in keyed.page_after(df, "id", expected[9], 5).collect()] == expected[10:15]
    assert keyed.page(df, "id", 9999, -3).rows.count() == 300 == keyed.page(df, "id", 1).total
    with pytest.raises(ValueError):
        keyed.page(df, "id", -1)
    for offset in (5, 111, 222, 297, 300, 900):
        assert [r["id"] for r in keyed.page(df, "id", 3, offset).rows.collect()] == expected[offset:offset + 3]


def test_pages_with_nulls_and_ties(spark):
    values = ["ca", None, "cb", "bc", "ca", None, "ab", "bc", "ca"]
    df = spark.createDataFrame([(v,) for v in values], "id string")
    expected = sorted(values, key=lambda v: (v is None, v or ""))
    for offset in range(10):
        found = keyed.page(df, "id", 2, offset)
        assert [r["id"] for r in found.rows.collect()] == expected[offset:offset + 2] and found.total == 9


# ---- rollups and snapshots ----------------------------------------------------------------------

SALES = "brand string, fridge_model string, store_name string, price decimal(18,2), feedback_sentiment_category string"


def sales(spark, rows):
    return spark.createDataFrame([(b, m, s, Decimal(p), t) for b, m, s, p, t in rows], SALES)


ROWS = [
    ("B", "m1", "S1", "10", "Negative"), ("A", "m2", "S1", "20", "Positive"), ("A", "m2", "S2", "30", "Negative"),
    ("B", "m1", "S2", "5", "Neutral"), ("C", "m3", "S3", "1", "Negative"),
]


def test_rollups_break_ties_by_key(spark):
    parts = R.partials(sales(spark, ROWS), "brand", "fridge_model", "store_name")
    assert [r["brand"] for r in R.sales_by_brand(parts, 2).collect()] == ["A", "B"]
    stores = R.store_performance(parts).collect()
    assert [(r["store_name"], r["negative_feedback_rate"]) for r in stores] == [
        ("S2", Decimal("50.00")), ("S1", Decimal("50.00")), ("S3", Decimal("100.00")),
    ]


def test_totals_of_nothing(spark):
    assert tuple(R.totals(sales(spark, [])).first()) == (0, Decimal("0.00"), 0.0, 0.0, 0.0)


def test_dimension_join_equals_the_direct_fold(spark):
    facts = spark.createDataFrame([(i % 3, Decimal(i)) for i in range(30)], "k int, price decimal(18,2)")
    dimension = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "k int, brand string")
    folded = R.by_dimension(facts, dimension, "k", "brand")
    direct = R.partials(facts.join(dimension, "k"), "brand")
    assert keys(folded, "brand", "n", "revenue", "low", "high") == keys(direct, "brand", "n", "revenue", "low", "high")


def test_batch_run(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    rows = [(f"B{i % 12:02d}", f"m{i}", "S", str(i), "Neutral") for i in range(30)]
    first = dt.datetime(2026, 1, 1, 8, 0)
    snap.run_batch(store, sales(spark, rows[:20]).drop("store_name"), first, "kube")
    # The newest run wins, whatever its scope.
    snapshots = snap.run_batch(store, sales(spark, rows), dt.datetime(2026, 1, 2, 9, 30), None)
    assert snapshots.count() == 2
    served = snap.serve(snapshots, 30).first()
    assert served["total_records"] == 30 and served["updated_by_scope"] is None
    assert served["last_updated_at"] == "2026-01-02T09:30:00Z" and served["analytics_run_interval_minutes"] == 1
    assert len(served["sales_by_brand"]) == 8
    feedback = snap.latest_feedback(store, snapshots)
    assert feedback.count() == 12 and feedback.agg(F.sum("count")).first()[0] == 30
    assert [b["brand"] for b in served["sales_by_brand"]][:3] == ["B00", "B01", "B02"]
    assert len(snap.parsed(snap.latest(snapshots)).first()["top_models"]) == 20
    assert store.read_appended(snap.FEEDBACK).count() == 24
    # A repeated run replaces what it left the first time.
    snapshots = snap.run_batch(store, sales(spark, rows), dt.datetime(2026, 1, 2, 9, 30), None)
    assert snapshots.count() == 2 and store.read_appended(snap.FEEDBACK).count() == 24
    with pytest.raises(RuntimeError, match="self-check failed"):
        snap.verify_saved_total(snapshots, 31)
    with pytest.raises(RuntimeError, match="no snapshot"):
        snap.verify_saved_total(snapshots.limit(0), 1)


def test_sections_are_folded_without_expansion(spark):
    parts = snap.section_parts(sales(spark, ROWS))
    plans = parts.models._jdf.queryExecution().toString() + parts.stores._jdf.queryExecution().toString()
    assert "Expand" not in plans


def test_serving_fills_missing_totals(spark):
    row = spark.createDataFrame([(dt.datetime(2026, 1, 1), "", None, None) + (None,) * 4 + ("r1",)], T.StructType([*schema.SNAPSHOT.fields, T.StructField("run", T.StringType())]))
    served = snap.serve(row, 60).first()
    assert (served["total_records"], served["total_revenue"], served["updated_by_scope"]) == (0, Decimal("0.00"), None)


def test_count_checks(spark):
    counts = snap.layer_counts({"csv": spark.range(3), "raw": spark.range(3), "vectors": spark.range(2)})
    rows = snap.report_rows(snap.count_check(counts, "csv"), "local", "kube").collect()
    assert {r["endpoint"]: r["ok"] for r in rows} == {"csv": True, "raw": True, "vectors": False}
    assert {r["notes"] for r in rows if not r["ok"]} == {"count=2 expected=3"}


# ---- load lane and row edits ----------------------------------------------------------------------

@pytest.fixture
def short_embed():
    # A local function travels to the workers by value; they cannot import this module.
    return lambda texts: [[float(len(t)), 1.0] for t in texts]


def test_load_lane(spark, tmp_path, short_embed):
    store = TableStore(spark, str(tmp_path / "store"))
    path = tmp_path / "a.csv"
    path.write_text("\n".join([HEADER, line("1", feedback=""), line("2"), line("1", feedback="good")]) + "\n")
    raw, written = lane.load_raw(store, str(path))
    assert written and raw.count() == 2 and not lane.load_raw(store, str(path))[1]
    vectors, _ = lane.load_vectors(store, short_embed, 2)
    assert keys(vectors, "id", "embedding") == [("1", [4.0, 1.0]), ("2", [4.0, 1.0])]
    assert keys(lane.announce(raw, vectors)) == [("EMBEDDINGS_COUNT=2",), ("RAW_COUNT=2",)]
    with pytest.raises(ValueError):
        lane.load_vectors(store, short_embed, 3, force=True)


def test_row_edits(spark, tmp_path, short_embed):
    store = TableStore(spark, str(tmp_path))
    store.write(lane.RAW, raw(spark, "a", "b", "c"))
    store.write(lane.VECTORS, lane.embedded(raw(spark, "a", "b", "c"), short_embed))
    lane.save_rows(store, spark.createDataFrame([("d", "longer")], "id string, customer_feedback string"), short_embed)
    edits = spark.createDataFrame([("a", "LG2"), ("x", "no")], "id string, brand string")
    assert keys(lane.update_rows(store, edits, short_embed)) == [("x",)]
    assert keys(lane.delete_ids(store, spark.createDataFrame([("b",), ("y",), ("b",)], "id string"))) == [("y",)]

    def check():
        assert keys(store.current(lane.RAW), "id", "brand") == [("a", "LG2"), ("c", "LG"), ("d", "Unknown")]
        assert keys(store.current(lane.VECTORS), "id", "embedding") == [
            ("a", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", [6.0, 1.0]),
        ]

    assert store.read(lane.RAW).count() == 3
    check()
    store.compact(lane.RAW)
    assert store.read(lane.RAW).count() == 3 and store.version(lane.RAW) == 2
    check()
    # A key deleted once may come back.
    lane.save_rows(store, spark.createDataFrame([("b",)], "id string"), short_embed)
    assert keys(store.current(lane.RAW), "id") == [("a",), ("b",), ("c",), ("d",)]
    # A full load replaces the table and its edits.
    store.write(lane.RAW, raw(spark, "q"))
    assert keys(store.current(lane.RAW), "id") == [("q",)]


def test_unfinished_version_is_ignored(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("t", spark.range(3))
    (tmp_path / "t" / "v00000002-e00000000").mkdir()
    assert store.version("t") == 1 and store.read("t").count() == 3
    assert store.write("t", spark.range(4)).count() == 4 and store.version("t") == 3


def test_writers_never_share_a_number(spark, tmp_path):
    first, second = TableStore(spark, str(tmp_path)), TableStore(spark, str(tmp_path))
    first.write("t", spark.range(3))
    numbers = [store._claim(f"{tmp_path}/t/edits") for store in (first, second, first)]
    assert numbers == [1, 2, 3]


def test_compaction_waits_for_edits_being_written(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.write("t", spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int"))
    slow = store._claim(f"{tmp_path}/t/edits")
    store.edit("t", spark.createDataFrame([("a", 2)], "id string, v int"))
    # Edit 1 is claimed but not committed: edit 2 is visible, but not folded in before it.
    assert keys(store.current("t"), "id", "v") == [("a", 2), ("b", 1)]
    assert keys(store.compact("t"), "id", "v") == [("a", 1), ("b", 1)]
    path = f"{tmp_path}/t/edits/e{slow:08d}"
    late = spark.createDataFrame([("b", 9, False, slow)], "id string, v int, _deleted boolean, _edit int")
    store._save(late, path)
    store._commit(path)
    assert keys(store.compact("t"), "id", "v") == [("a", 2), ("b", 9)]


def test_failed_check_publishes_nothing(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    raw = spark.createDataFrame([tuple(["x"] + [None] * 11)], schema.SALES_RAW)
    store.write(lane.RAW, raw)
    short = lambda texts: [[0.0, 1.0] for _ in texts]
    for _ in range(2):
        with pytest.raises(ValueError, match="do not have length 4"):
            lane.load_vectors(store, short, dimension=4)
        assert not store.exists(lane.VECTORS)
    right = lambda texts: [[0.0] * 4 for _ in texts]
    assert lane.load_vectors(store, right, dimension=4)[1] and store.read(lane.VECTORS).count() == 1
