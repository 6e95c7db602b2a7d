"""Search by byte codes, against the search that measures every row."""

import os

import numpy as np
import pytest

from lakesight.operators import quantized as Z
from lakesight.operators.search import nearest
from lakesight.sources.store import TableStore

SCHEMA = "id long, brand string, embedding array<float>"


def stored(spark, folder, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df, Z.load_codes(TableStore(spark, str(folder)), "v", lambda: df)


def rows_of(vectors):
    return [(i, "ab"[i % 2], [float(x) for x in v]) for i, v in enumerate(vectors)]


@pytest.mark.parametrize("seed", range(3))
def test_bounds_hold_for_every_row(seed):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 10.0 ** rng.integers(-8, 9, (300, 1)), (300, 33)).astype(np.float32).astype(np.float64)
    vectors[:5] = 0.0
    for query in (vectors[7], rng.normal(0, 1, 33), np.zeros(33)):
        lower, upper = Z.bounds(*Z.encode(vectors), query)
        exact = np.sqrt(((vectors - query) ** 2).sum(axis=1))
        assert (lower <= exact).all() and (exact <= upper).all()


def test_what_cannot_be_coded_is_always_measured():
    vectors = np.array([[np.nan, 1.0], [np.inf, 0.0], [1e200, -1e200], [1.0, 2.0]])
    codes, step, error = Z.encode(vectors)
    assert np.isinf(error).tolist()[:2] == [True, True] and np.isfinite(error[3]) and codes.dtype == np.int8
    lower, upper = Z.bounds(codes, step, error, np.zeros(2))
    assert (lower[:3] == -np.inf).all() and (upper[:3] == np.inf).all()


def test_exact_and_few_vectors_read(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = rng.normal(0, 1, (4_000, 48))
    df, coded = stored(spark, tmp_path, rows_of(vectors))
    for query in (vectors[3].tolist(), rng.normal(0, 1, 48).tolist()):
        for filters in (None, {"brand": ["b"]}):
            wanted = nearest(df, query, 10, filters, ["brand"], columns=["id", "distance"]).collect()
            assert coded.search(query, 10, filters, ["brand"], columns=["id", "distance"]).collect() == wanted
            assert 10 <= coded.candidates(query, 10, filters, ["brand"]).count() < 100


def test_codes_take_about_a_quarter_of_the_bytes(spark, tmp_path):
    stored(spark, tmp_path, rows_of(np.random.default_rng(6).normal(0, 1, (2_000, 768))))
    size = {name: sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(tmp_path / name) for f in files if f.endswith(".parquet"))
            for name in ("v_rows", "v_codes")}
    assert size["v_codes"] < 0.3 * size["v_rows"]


def test_ties_repeats_and_odd_rows(spark, tmp_path):
    same = [(i, "a", [1.0, 2.0, 3.0]) for i in range(200)]
    odd = [(900, "a", None), (901, "a", []), (902, "a", [1.0]), (903, None, [1.0, None, 3.0]), (904, "b", [float("nan"), 0.0, 0.0]),
           (905, "b", [9.0, 9.0, 9.0]), (906, "b", [3e38, 3e38, -3e38])]
    _, coded = stored(spark, tmp_path, same + odd)
    found = lambda query, k, **more: [r["id"] for r in coded.search(query, k, columns=["id"], **more).collect()]
    assert found([1.0, 2.0, 3.0], 7) == list(range(7))
    assert found([9.0, 9.0, 9.0], 3) == [905, 0, 1]
    assert found([1.0, 2.0, 3.0], 9, filters={"brand": ["b"]}) == [905, 906, 904]
    assert found([4.0], 5) == [902] and found([4.0, 4.0], 5) == []
    with pytest.raises(ValueError):
        coded.search([1.0, float("inf"), 0.0], 2)


def test_empty_table_and_second_load(spark, tmp_path):
    df, coded = stored(spark, tmp_path, [])
    assert coded.search([1.0], 3, columns=["id"]).collect() == []
    full = spark.createDataFrame(rows_of([[1.0], [2.0]]), SCHEMA)
    store = TableStore(spark, str(tmp_path / "two"))
    Z.load_codes(store, "v", lambda: full)
    again = Z.load_codes(store, "v", lambda: pytest.fail("the rows were stored before"))
    assert [r["id"] for r in again.search([2.0], 1, columns=["id"]).collect()] == [1]


def test_only_blocks_with_candidates_are_read(spark, tmp_path):
    _, coded = stored(spark, tmp_path, rows_of(np.random.default_rng(8).normal(0, 1, (400, 6))))
    plan = coded.search([0.0] * 6, 2, columns=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression(_block" in plan and "CartesianProduct" not in plan
