"""Operators against brute force: ordered scans, trees, search, traces, inventories, documents."""

import datetime as dt
import random
import re
import time
from contextlib import contextmanager

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from lakesight import schema
from lakesight.functions.resources import Naming
from lakesight.operators import ann, embed as B, inventory as I, logs as L, ordered as O, search as N, sections as X
from lakesight.operators import sqlapi as Q, trace as T, transcripts as C
from lakesight.plans.registry import Registry
from lakesight.sources.store import TableStore

few = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


# ---- ordered scans over ranges ------------------------------------------------------------------

@contextmanager
def partitions(spark, n):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@few
@given(st.lists(st.booleans(), max_size=40), st.integers(1, 7))
def test_failure_streaks_across_chunks(spark, flags, size):
    # Sparse numbers, as of hashed ids.
    rows = [(3 * i**5 + 1, ok) for i, ok in enumerate(flags)]
    df = spark.createDataFrame(rows, "seq long, ok boolean").repartition(3)
    expected, run = {}, 0
    for seq, ok in rows:
        run = 0 if ok else run + 1
        expected[seq] = run
    with partitions(spark, size):
        got = {r["seq"]: r["streak"] for r in O.failure_streaks(df).collect()}
    assert got == expected


def test_abort_needs_ten_failures(spark):
    for n, expected in ((9, None), (10, 9), (12, 9)):
        df = spark.createDataFrame([(i, i >= n) for i in range(20)], "seq long, ok boolean")
        assert O.abort_point(O.failure_streaks(df)).first()[0] == expected


@few
@given(st.lists(st.tuples(st.integers(0, 2), st.one_of(st.none(), st.integers(0, 9))), max_size=40), st.integers(1, 7))
def test_carry_last_across_chunks(spark, items, size):
    rows = [(k, i, v) for i, (k, v) in enumerate(items)]
    df = spark.createDataFrame(rows, "k int, seq long, v int").repartition(3)
    expected, last = {}, {}
    for k, i, v in rows:
        expected[i] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    with partitions(spark, size):
        got = {r["seq"]: r["p"] for r in O.carry_last(df, "v", "p", ["k"]).collect()}
    assert got == expected


# ---- trees and transcripts ------------------------------------------------------------------------

def test_preorder_of_random_forests(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for tree in range(4):
        n = [1, 2, 17, 60][tree]
        parents = [None] + [rng.randrange(i) if tree != 2 else i - 1 for i in range(1, n)]
        order = list(range(n))
        rng.shuffle(order)
        rows += [(tree, f"n{i}", None if p is None else f"n{p}", order[i]) for i, p in enumerate(parents)]
        children = {i: sorted((j for j in range(n) if parents[j] == i), key=lambda j: order[j]) for i in range(n)}
        position = 0

        def walk(i, depth):
            nonlocal position
            expected[tree, f"n{i}"] = (position, depth)
            position += 1
            for c in children[i]:
                walk(c, depth + 1)

        walk(0, 0)
    # A cycle and a node under a missing parent are reached from no root.
    rows += [(0, "x", "y", 1), (0, "y", "x", 2), (1, "z", "gone", 9)]
    df = spark.createDataFrame(rows, "conv_id int, id string, parent string, ord int")
    got = {(r["conv_id"], r["id"]): (r["position"], r["depth"]) for r in C.preorder(df).collect()}
    assert got == expected


MESSAGES = [
    (1, 0, "system", "rules", False), (1, 1, "user", " hi ", False), (1, 2, "assistant", "secret", True),
    (1, 3, "assistant", "yes\n", False), (2, 0, "system", "only", False), (3, 5, "user", "", False), (3, 6, None, "x", False), (3, 7, "user", " \n\t", False),
]


def expected_transcript(messages, markdown):
    blocks = [
        (f"\n### {r or 'unknown'}\n\n{t.strip()}\n" if markdown else f"\n----- MESSAGE (role={r or 'unknown'}) -----\n{t.strip()}\n")
        for _, _, r, t, hidden in messages if r != "system" and not hidden and t.strip()
    ]
    body = "\n".join(blocks).strip()
    return body + "\n" if body else ""


@pytest.mark.parametrize("markdown", [False, True])
@pytest.mark.parametrize("turns", [1, 2, 1000])
def test_transcript_parts_join_to_the_whole(spark, markdown, turns):
    df = spark.createDataFrame(MESSAGES, "conv_id int, turn int, role string, text string, hidden boolean")
    texts = {}
    for r in C.transcripts(df, turns, markdown).orderBy("conv_id", "part").collect():
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["body"]
    for conv in (1, 2, 3):
        assert texts.get(conv, "") == expected_transcript([m for m in MESSAGES if m[0] == conv], markdown)


# ---- search -----------------------------------------------------------------------------------------

def brute(corpus, questions, k):
    result = set()
    for q, v in questions:
        ranked = sorted((round(float(np.sqrt(((np.array(c) - v) ** 2).sum())), 9), i) for i, c in corpus)
        result |= {(q, i, rank) for rank, (_, i) in enumerate(ranked[:k], 1)}
    return result


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    corpus = [(f"d{i:03d}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(120)]
    questions = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(7)] + [(7, corpus[5][1])]
    return corpus, questions


@pytest.mark.parametrize("chunk", [1_000, 20])
def test_batch_search_equals_brute_force(spark, vectors, chunk):
    corpus, questions = vectors
    df = spark.createDataFrame(corpus, "id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame(questions, "question_id int, embedding array<double>")
    got = N.nearest_batch(df, asked, 9, chunk=chunk).collect()
    assert {(r["question_id"], r["id"], r["rank"]) for r in got} == brute(corpus, questions, 9)
    assert N.nearest_batch(df, asked.limit(0), 9).count() == 0


def test_single_search(spark, vectors):
    corpus, questions = vectors
    df = spark.createDataFrame(corpus, "id string, embedding array<double>")
    for q, v in questions[:2] + questions[-1:]:
        got = [r["id"] for r in N.nearest(df, v, 9, columns=["id"]).collect()]
        assert {(q, i, rank) for rank, i in enumerate(got, 1)} == brute(corpus, [(q, v)], 9)


def test_filters(spark):
    assert N.filterable_columns(None) == ["store_name", "brand", "feedback_sentiment_category"]
    allowed = N.filterable_columns(schema.SALES_EMBEDDINGS)
    assert "store_address" in allowed and "customer_id" in allowed
    assert not {"id", "customer_feedback", "feedback_rating", "embedding"} & set(allowed)
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "id string, brand string")
    ids = lambda f: sorted(r["id"] for r in N.apply_filters(df, f, ["brand"]).collect())
    assert ids({"brand": ["x"]}) == ids({"brand": "x"}) == ["a", "c"]
    assert ids({"brand": [], "id": ["a"], "other": ["q"]}) == ids(None) == ["a", "b", "c"]
    assert N.collect_filters({"brand": "x", "store_name": 5, "limit": 3, "filters": {"brand": ["y"]}}, ["brand", "store_name"]) == {
        "brand": ["y"], "store_name": ["5"],
    }


def test_histogram_only_for_long_results(spark):
    df = lambda n: spark.createDataFrame([("ab"[i % 2] if i % 5 else "",) for i in range(n)], "brand string")
    assert N.brand_histogram(df(20)).count() == 0
    assert [tuple(r) for r in N.brand_histogram(df(21)).collect()] == [("a", 8), ("b", 8)]


def test_cells_are_exact_and_probes_measured(spark, tmp_path, vectors):
    corpus, questions = vectors
    rows = [(i, v) for i, v in corpus if any(v)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    index = ann.build_cells(TableStore(spark, str(tmp_path)), "cells", df, lists=4)
    assert index.table.count() == len(rows)
    exact = N.nearest(df, questions[0][1], 10, columns=["id"])
    for _, question in questions:
        found = index.search(question, 10, probes=1, columns=["id"]).collect()
        assert found == N.nearest(df, question, 10, columns=["id"]).collect()
    partial = ann.recall(index.probe(questions[0][1], 10, probes=2, columns=["id"]), exact).first()["recall"]
    assert 0.0 < partial <= 1.0


def test_embedding_batches_and_nulls(spark):
    sizes = spark.sparkContext.accumulator(0)

    def embed(texts):
        assert len(texts) <= 64 and all(isinstance(t, str) for t in texts)
        sizes.add(1)
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.range(150).select(F.when(F.col("id") > 0, F.lit("abc")).alias("t")).coalesce(1)
    rows = B.embed_column(df, "t", embed).collect()
    assert rows[0]["embedding"] == [0.0, 1.0] and rows[1]["embedding"] == [3.0, 1.0] and sizes.value == 3


def test_hashing_vectors_have_unit_length():
    one, same, none = B.hashing_embedder()(["Red  widget red", "red widget\nRED", " "])
    assert np.array_equal(one, same) and abs(np.linalg.norm(one) - 1) < 1e-6 and not none.any()


# ---- the SQL guard ------------------------------------------------------------------------------------

STATEMENTS = {
    "SELECT count(*) FROM t": (True, True), "DROP TABLE t": (False, False), "SELECT created_at FROM t": (False, True),
    "WITH x AS (SELECT 1) SELECT * FROM x": (False, False), "": (False, False), "   ": (False, False),
    "  select 1": (True, True), "SELECT 1; SELECT 2": (True, True), "SELECT reflect('a', 'b')": (True, False),
    "SELECT 1; DELETE FROM t": (False, False), "SELECT executed FROM t": (False, True),
}


def test_guard_modes(spark):
    df = spark.createDataFrame([(s,) for s in STATEMENTS], "sql string")
    rows = df.select("sql", Q.guard_error(F.col("sql"), "substring").alias("r"), Q.guard_error(F.col("sql")).alias("w")).collect()
    assert {r["sql"]: (r["r"] is None, r["w"] is None) for r in rows} == STATEMENTS
    for r in rows:
        assert (Q.check_statement(r["sql"], "substring"), Q.check_statement(r["sql"])) == (r["r"], r["w"])
    assert Q.check_statement("DROP TABLE t") == "Dangerous SQL keyword 'DROP' is not allowed"


@given(st.text(max_size=30), st.sampled_from(Q.REFUSED_WORDS), st.text(max_size=30), st.sampled_from(["substring", "words"]))
def test_guard_never_admits_a_write(before, word, after, mode):
    assert Q.check_statement(f"SELECT {before} {word} {after}", mode) is not None
    assert Q.check_statement(f"{word} {before}", mode) is not None


def test_run_select(spark):
    spark.range(20).createOrReplaceTempView("numbers")
    good = Q.run_select(spark, "SELECT id, CAST(id AS DECIMAL(5,2)) AS d FROM numbers ORDER BY id;")
    assert good.success and good.columns == ["id", "d"] and good.row_count() == 20
    assert good.payload(1) == ['{"id":0,"d":0.0}']
    for sql in ("SELECT nothing FROM numbers", "SELECT 1; SELECT 2", "UPDATE numbers SET id = 1", None):
        bad = Q.run_select(spark, sql)
        assert not bad.success and bad.error and bad.row_count() == 0
    late = Q.run_select(spark, "SELECT 1 / (id - id) AS x FROM numbers")
    assert late.success and late.payload() == [] and not late.success and "DIVIDE_BY_ZERO" in late.error


def test_hidden_calls_and_files_do_not_run(spark, tmp_path):
    spark.range(3).createOrReplaceTempView("numbers")
    (tmp_path / "secret.txt").write_text("secret")
    for sql in (
        "SELECT `reflect`('java.util.UUID', 'randomUUID')", "SELECT reflect/**/('java.util.UUID', 'randomUUID')",
        f"SELECT * FROM text.`{tmp_path}`", f"SELECT * FROM text/**/.`{tmp_path}`",
        f"SELECT id, (SELECT max(value) FROM `text`.`{tmp_path}`) FROM numbers",
        "SELECT id FROM numbers WHERE id = (SELECT length(reflect('java.util.UUID', 'randomUUID')))",
    ):
        for mode in ("words", "substring"):
            found = Q.run_select(spark, sql, mode)
            assert not found.success and found.error, sql
    assert Q.run_select(spark, "SELECT n.id FROM numbers n JOIN (SELECT max(id) AS m FROM numbers) t ON n.id = t.m").row_count() == 1


def test_json_rows(spark):
    row = [(dt.datetime(2026, 1, 1, 12), dt.date(2026, 1, 2), None)]
    df = spark.createDataFrame(row, "t timestamp_ntz, day date, n string").select(
        "*", F.expr("array(named_struct('p', 1.50BD))").alias("nested")
    )
    assert Q.json_rows(df).first()[0] == '{"t":"2026-01-01T12:00:00","day":"2026-01-02","n":null,"nested":[{"p":1.5}]}'


def test_schema_listing(spark):
    lines = [r["line"] for r in Q.schema_listing(spark.createDataFrame([], schema.SALES_RAW), "sales_raw").orderBy("position").collect()]
    assert lines[0] == "Table: sales_raw" and "- feedback_rating: int" in lines and len(lines) == 13


# ---- traces -----------------------------------------------------------------------------------------------

def trace(spark, *rows):
    names = schema.TRACE.fieldNames()
    made = []
    for i, row in enumerate(rows):
        made.append(tuple({"seq": i, "event_type": T.TOOL_CALL, "query_id": "q", **row}.get(n) for n in names))
    return spark.createDataFrame(made, schema.TRACE)


SQL_HIT = {"tool": "execute_sql", "success": True, "row_count": 3}
SQL_EMPTY = {"tool": "execute_sql", "success": True, "row_count": 0}
SQL_FAIL = {"tool": "execute_sql", "success": False, "error": "bad"}
FOUND = {"tool": "semantic_search", "success": True, "row_count": 2}
MADE = {"tool": "generate_sql", "success": True, "sql": "SELECT 1"}
DONE = {"event_type": "complete", "answer": "the answer"}


@pytest.mark.parametrize("rows, expected", [
    ([SQL_HIT, FOUND, DONE], (True, "sql", 3, "the answer")),
    ([SQL_EMPTY, DONE], (False, None, 0, "No relevant data found for this query.")),
    ([FOUND, SQL_FAIL, DONE], (True, "semantic", 2, "the answer")),
    ([SQL_FAIL, DONE], (False, None, 0, "I cannot answer")),
    ([MADE, DONE], (False, None, 0, "I cannot answer")),
    ([DONE], (False, None, 0, "No relevant data found for this query.")),
    ([{**SQL_FAIL, "iteration": 5}, DONE], (False, None, 0, "Search exceeded")),
    ([{**SQL_EMPTY, "iteration": 5}, DONE], (False, None, 0, "No relevant data found for this query.")),
    ([SQL_HIT, {**SQL_HIT, "row_count": 9}, DONE], (True, "sql", 9, "the answer")),
])
def test_outcomes(spark, rows, expected):
    r = T.outcomes(trace(spark, *rows)).first()
    assert (r["data_available"], r["primary_result_type"], r["primary_result_row_count"]) == expected[:3]
    assert r["answer"].startswith(expected[3])


def test_context_of_primary_results(spark):
    context = lambda *rows: [tuple(c) for c in T.primary_results(trace(spark, *rows)).first()["context_results"]]
    assert context(MADE, FOUND) == [("generate_sql", "Generated SQL query")]
    assert context(MADE, FOUND, SQL_HIT) == [("semantic_search", "Retrieved 2 rows")]
    assert context(SQL_FAIL) == []


def test_chained_sql(spark):
    rows = T.chain_generated_sql(trace(
        spark, {"tool": "execute_sql"}, MADE, {"tool": "execute_sql", "sql": "(The SQL above)"},
        {**MADE, "sql": "SELECT 2"}, {**MADE, "success": False, "sql": "SELECT 3"}, {"tool": "execute_sql", "sql": ""},
        {"tool": "execute_sql", "sql": "SELECT own"}, {"tool": "execute_sql", "query_id": "other"},
    )).orderBy("query_id", "seq").collect()
    assert [(r["sql_to_run"], r["chained"]) for r in rows] == [
        (None, False), (None, False), ("SELECT 1", True), ("SELECT 2", True), ("SELECT own", False),
    ]


def test_agent_metrics(spark):
    m = T.agent_metrics(trace(
        spark, SQL_HIT, SQL_FAIL, {**FOUND, "total_tokens": 5}, {"tool": T.SYNTHESIS, "success": True},
        {"tool": "web_search", "success": False},
        {**DONE, "execution_time_ms": 10.0, "iteration": 2, "input_tokens": 4, "total_tokens": 6},
        {"event_type": "error", "execution_time_ms": 20.0, "iteration": 1, "input_tokens": 0},
    )).first()
    assert (m["total_queries"], m["success_count"], m["failure_count"], m["success_rate"]) == (2, 1, 1, 50.0)
    assert (m["avg_latency_ms"], m["avg_iterations"]) == (15.0, 1.5)
    assert m["tool_calls"] == {"execute_sql": 2, "semantic_search": 1, "web_search": 1}
    assert m["errors"] == {"error": 1, "tool_execute_sql": 1, "tool_web_search": 1}
    assert (m["total_input_tokens"], m["avg_input_tokens"], m["total_tokens"], m["avg_total_tokens"], m["token_calls"]) == (4, 4.0, 11, 5.5, 2)
    empty = T.agent_metrics(trace(spark)).first()
    assert (empty["total_queries"], empty["avg_latency_ms"], empty["tool_calls"]) == (0, 0.0, {})


def test_answers_to_add(spark):
    said = spark.createDataFrame(
        [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (3, 0, "user", "q"), (3, 1, "user", "r")],
        "conv_id int, turn int, role string, text string",
    )
    answers = spark.createDataFrame([(1, "q", "a"), (2, "q", "a"), (3, "q", "a")], "conv_id int, question string, answer string")
    assert [r["conv_id"] for r in T.answers_to_add(said, answers).collect()] == [2]


# ---- logs, inventory, documents ---------------------------------------------------------------------------

def test_new_log_lines_and_mark(spark):
    stamps = ["05.000001", "06.5", "06.5", "04.0"]
    rows = [(i, f"[2026-01-02 03:04:{s} UTC] l{i}") for i, s in enumerate(stamps)] + [(9, "plain")]
    df = spark.createDataFrame(rows, schema.LOG_LINES)
    mark = dt.datetime(2026, 1, 2, 3, 4, 5, 1)
    assert L.new_lines(df, None).count() == 4
    assert sorted(r["line_no"] for r in L.new_lines(df, mark).collect()) == [1, 2]
    assert L.next_mark(df, mark).first()[0] == dt.datetime(2026, 1, 2, 3, 4, 6, 500000)
    late = dt.datetime(2027, 1, 1)
    assert L.new_lines(df, late).count() == 0 and L.next_mark(df, late).first()[0] == late


def test_duration_table(spark):
    empty = spark.createDataFrame([], schema.PHASES)
    assert L.duration_table(empty).count() == 0
    rows = [("kube", "a", "x", 1.25), ("kube", "a", "x", 1.25), ("nonkube", "b", "y", 0.1)]
    got = L.duration_table(spark.createDataFrame(rows, schema.PHASES)).collect()
    assert len(got) == 4 and [r["duration_sec"] for r in got if r["is_total"]] == [2.6]


def resource(seq, kind, name, region="r1", lb="", tags=None, display=None):
    return (seq, kind, name, region, display or f"{kind}:{name}", lb, tags or {})


OURS = {"kubernetes.io/cluster/acme-dev-eks": "owned"}
INVENTORY = [
    resource(0, "security_group", "k8s-elb-X", tags=OURS), resource(1, "security_group", "k8s-elb-Y", tags=OURS),
    resource(2, "alb", "X", region="r2", lb="classic"), resource(3, "iam_role", "acme-dev-odd", region=""),
    resource(4, "target_group", "k8s-ingressn-1"), resource(5, "iam_role", "acme-dev-ecs-task-r1", region=None),
    resource(6, "security_group", "k8s-elb-Z"), resource(7, "vpc", "v", display="vpc:default (10.0.0.0/8) [x]"),
    resource(8, "target_group", "k8s-acmekube-acmeapisv-1"), resource(9, "s3", "stranger"), resource(10, "s3", "stranger"),
    resource(11, "security_group", "k8s-elb-W", tags={"kubernetes.io/cluster/acme-eks-dev-r1": "shared"}),
]


@pytest.fixture(scope="module")
def classified(spark):
    return I.classify(spark.createDataFrame(INVENTORY, schema.RESOURCES), Naming("acme", "dev"))


def test_resource_buckets(classified):
    got = {r["seq"]: (r["bucket"], r["category"]) for r in classified.collect()}
    assert got == {
        0: ("definitely", None), 1: ("definitely", None), 2: ("definitely", None), 3: ("likely", None),
        4: ("definitely", None), 5: ("project", "nonkube"), 6: ("other", None), 7: ("builtin", None),
        8: ("project", "nonkube"), 9: ("other", None), 10: ("other", None), 11: ("definitely", None),
    }


def test_classic_track(spark):
    df = I.classify(spark.createDataFrame(INVENTORY, schema.RESOURCES), Naming("acme", "dev"), classic_track=True)
    notes = {r["seq"]: r["orphan_note"] for r in df.collect()}
    assert notes[0] == "Classic ELB track: in-tree SG" and notes[2] is None
    assert notes[8] == "Classic ELB track: TG from previous NLB migration"


def test_deletion_order(classified):
    rows = I.deletion_order(I.orphans(classified)).collect()
    assert [(r["phase"], r["seq"]) for r in rows] == [(1, 2), (1, 3), (1, 4), (1, 1), (1, 11), (2, 0)]


def test_reports(classified):
    tallies = I.bucket_tallies(classified).first().asDict()
    assert tallies == {"definitely": 5, "likely": 1, "project": 2, "other": 3, "builtin": 1}
    matrix = {r["region"]: r["nonkube"] for r in I.category_matrix(classified).collect()}
    assert matrix == {"r1": 1, "r2": 0, "(global)": 1}
    hints = {r["resource_type"]: r["hint"] for r in I.recovery_hints(I.orphans(classified)).collect()}
    assert set(hints) == {"security_group", "load_balancer", "iam_role", "target_group"}
    listed = I.first_listed(classified.where("bucket = 'other'"), "display", 1).collect()
    assert [(r["kind"], r["item"], r["n"]) for r in listed] == [("item", "s3:stranger", None), ("overflow", None, 2)]
    assert I.first_listed(classified.where("bucket = 'other'"), "display", 3).count() == 2


DOCUMENTS = [
    "# T\n\n---\n\n## 7. a\nx\n### 7.2  s\n\n---\n\n## 9. b\n## 10. c\ny\n",
    "## 3. only\ntext", "no heading", "", "intro\n## 1. a\n---\n\n---\n\n## 2. b\n\n---\n\n---\n\n  ---\n\n## 5. c\n### 4.4 t",
]


def test_sections_and_renumbering(spark):
    df = spark.createDataFrame(list(enumerate(DOCUMENTS)), "doc_id int, text string")
    got = X.split_documents(df, {"a": [7, 9], "b": [3]}, "rest").orderBy("doc_id", "position").collect()
    assert [(r["doc_id"], r["number"], r["body"]) for r in got] == [
        (0, 7, "---\n\n## 7. a\nx\n### 7.2  s\n\n---"), (0, 9, "---\n\n## 9. b"), (0, 10, "---\n\n## 9. b\n## 10. c\ny"),
        (1, 3, "## 3. only\ntext"), (4, 1, "## 1. a\n---\n\n---"), (4, 2, "---\n\n## 2. b\n\n---\n\n---\n\n  ---"),
        (4, 5, "---\n\n  ---\n\n## 5. c\n### 4.4 t"),
    ]
    assert [r["bucket"] for r in got] == ["a", "a", "rest", "b", "rest", "rest", "rest"]
    texts = [r["text"] for r in X.renumber(df).orderBy("doc_id").collect()]
    assert texts[0] == "# T\n\n---\n\n## 1. a\nx\n### 1.2 s\n\n---\n\n## 2. b\n## 3. c\ny\n"
    assert texts[1:4] == ["## 1. only\ntext", "no heading", ""]
    assert texts[4] == "intro\n## 1. a\n---\n\n## 2. b\n\n---\n\n## 3. c\n### 3.4 t"


def test_sections_of_random_documents(spark):
    rng = random.Random(4)
    atoms = ["## 3. a\n", "\n---\n\n", "---\n\n", "x", "\n", "### 1.2 b\n", "## 12. c"]
    texts = ["".join(rng.choices(atoms, k=rng.randrange(12))) for _ in range(300)]

    def plain(text):
        starts = [m.start() for m in re.finditer(r"(?m)^## \d+\. ", text)]
        for i, start in enumerate(starts):
            at = text.rfind("\n---\n\n", 0, start)
            end = starts[i + 1] - 1 if i + 1 < len(starts) else len(text)
            yield i, (text[at + 1:start] if at >= 0 else "") + text[start:end]

    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "doc_id int, text string")
    got = sorted((r["doc_id"], r["position"], r["body"]) for r in X.split_documents(df, {}, "rest").collect())
    assert got == [(d, i, body.rstrip(" \t\n\r\x0b\x0c")) for d, text in enumerate(texts) for i, body in plain(text)]


def test_sections_of_a_long_document_take_linear_time(spark):
    text = "".join(f"## {i}. head\n{'line ' * 20}\n\n---\n\n" for i in range(40_000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.monotonic()
    found = X.split_documents(df, {}, "rest").agg(F.count("body").alias("n"), F.max("number").alias("last"), F.sum(F.length("body")).alias("size")).first()
    assert (found["n"], found["last"]) == (40_000, 39_999) and found["size"] < 2 * len(text)
    assert time.monotonic() - began < 30


# ---- plans and registry -------------------------------------------------------------------------------------

def test_plan_shapes(spark, vectors):
    from lakesight.operators import keyed, rollups as R

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    corpus = spark.createDataFrame(vectors[0], "id string, embedding array<double>")
    asked = spark.createDataFrame(vectors[1], "question_id int, embedding array<double>")
    assert "TakeOrderedAndProject" in plan(N.nearest(corpus, vectors[1][0][1], 5, columns=["id"]))
    assert "WindowGroupLimit" in plan(N.nearest_batch(corpus, asked, 5))
    sales = spark.createDataFrame([], "brand string, price decimal(18,2)")
    assert "TakeOrderedAndProject" in plan(R.sales_by_brand(R.partials(sales, "brand")))
    assert plan(R.sales_by_brand(R.partials(sales, "brand"))).count("Exchange") == 1
    assert "WindowGroupLimit" in plan(keyed.last_write_wins(spark.range(3).withColumn("s", F.col("id")), "id", ["s"]))


def test_registry():
    registry = Registry()

    @registry.register("SELECT 1")
    def thing(spark, folder):
        """A thing."""

    assert registry.names() == ["thing"] and registry.get("thing").description == "A thing."
    with pytest.raises(ValueError):
        registry.register()(thing)
    with pytest.raises(KeyError):
        registry.get("other")
