"""Streams from files, restarted from their checkpoint, against their batch twins."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Row, functions as F

from lakesight import schema
from lakesight.plans import snapshot as snap
from lakesight.sources.store import TableStore
from lakesight.streaming import agent_events as A, keyed_state as K, log_tail as L, runs as R

T0 = dt.datetime(2026, 1, 1, 8, 0)


def event(query, seq, minute, kind, **values):
    return {"query_id": query, "seq": seq, "ts": (T0 + dt.timedelta(minutes=minute)).isoformat(), "event_type": kind, **values}


FIRST = [
    event("a", 1, 0, "question", question="why"), event("a", 2, 1, "tool_call_start", tool="execute_sql"),
    event("a", 3, 2, "tool_call_complete", tool="execute_sql", success=True, row_count=2),
    event("b", 1, 0, "question", question="how many"), event("b", 2, 3, "tool_call_complete", tool="semantic_search", success=False),
    event("c", 1, 4, "question", question="lost"),
]
SECOND = [
    event("a", 4, 5, "tool_call_complete", tool="pseudo_tool#llm_synthesize_answer", success=True),
    event("a", 5, 5, "complete", answer="first", iteration=1, execution_time_ms=9.0, total_tokens=3),
    event("a", 6, 6, "complete", answer="second", iteration=1, execution_time_ms=9.5),
    event("b", 3, 6, "error", error="boom"),
]
SENTINEL = [event("z", 1, 600, "question", question="later")]
STATES = ["query_id", "question", "calls", "iterations", "answer", "error", "status"]


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def batch(spark, folder):
    return spark.read.schema(schema.TRACE).json(str(folder))


def test_states_survive_a_restart(spark, tmp_path):
    folder = tmp_path / "events"
    run = lambda: A.query_states(R.run_updated(
        A.state_parts(A.read_events(spark, str(folder), 1)), str(tmp_path / "out"), str(tmp_path / "cp"), ["query_id", "window_start"]
    ))
    drop(folder, "1.json", FIRST)
    assert rows(run(), "query_id", "calls", "status") == [("a", 1, "running"), ("b", 1, "running"), ("c", 0, "running")]
    drop(folder, "2.json", SECOND)
    states = run()
    assert rows(states, *STATES) == [
        ("a", "why", 1, 1, "second", None, "complete"), ("b", "how many", 1, None, None, "boom", "error"),
        ("c", "lost", 0, None, None, None, "running"),
    ]
    assert rows(states, *STATES) == rows(A.query_states(A.state_parts(batch(spark, folder))), *STATES)


def test_queries_close_after_the_timeout(spark, tmp_path):
    folder = tmp_path / "events"
    run = lambda: R.run_appended(
        A.closed_queries(A.read_events(spark, str(folder), 1)), str(tmp_path / "out"), str(tmp_path / "cp")
    )
    drop(folder, "1.json", FIRST)
    drop(folder, "2.json", SECOND)
    assert run().count() == 0
    drop(folder, "3.json", SENTINEL)
    closed = run()
    assert rows(closed, "query_id", "status", "answer") == [("a", "complete", "second"), ("b", "error", None), ("c", "abandoned", None)]
    twin = A.closed_queries(batch(spark, folder)).where("query_id != 'z'")
    assert rows(closed, *STATES, "closed_at") == rows(twin, *STATES, "closed_at")


def test_repeated_terminal_events_are_dropped(spark, tmp_path):
    folder = tmp_path / "events"
    drop(folder, "1.json", SECOND)
    drop(folder, "2.json", [event("a", 9, 7, "complete", answer="third")])
    got = R.run_appended(A.first_terminal_events(A.read_events(spark, str(folder), 1)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(got, "query_id", "event_type") == [("a", "complete"), ("b", "error")]


def test_windowed_metrics_equal_the_batch(spark, tmp_path):
    folder = tmp_path / "events"
    drop(folder, "1.json", FIRST)
    drop(folder, "2.json", SECOND + SENTINEL)
    parts = A.windowed_parts(A.read_events(spark, str(folder), 1))
    live = A.windowed_metrics(R.run_updated(parts, str(tmp_path / "out"), str(tmp_path / "cp"), ["window_start", "tool"]))
    columns = ["window_start", "total_queries", "success_count", "failure_count", "avg_latency_ms", "token_calls", "tool_calls", "errors"]
    assert rows(live, *columns) == rows(A.windowed_metrics(A.windowed_parts(batch(spark, folder))), *columns)
    assert live.agg(F.sum("total_queries")).first()[0] == 3


def test_log_lines_are_shown_once(spark, tmp_path):
    folder = tmp_path / "logs"
    run = lambda: R.run_appended(L.tail(L.read_lines(spark, str(folder))), str(tmp_path / "out"), str(tmp_path / "cp"))
    stamp = lambda s, text: f"[2026-01-02 03:04:{s:02d}.000 UTC] {text}"
    drop(folder, "1.log", [stamp(1, "a"), "no time", stamp(2, "b"), stamp(1, "a")])
    assert rows(run(), "line") == [(stamp(1, "a"),), (stamp(2, "b"),)]
    drop(folder, "2.log", [stamp(2, "b"), stamp(3, "c")])
    assert rows(run(), "line") == [(stamp(1, "a"),), (stamp(2, "b"),), (stamp(3, "c"),)]


def test_refresh_upserts_and_snapshots(spark, tmp_path):
    folder, store = tmp_path / "raw", TableStore(spark, str(tmp_path / "store"))
    kind = "id string, brand string, price decimal(18,2), version int"
    clock = iter(T0 + dt.timedelta(hours=h) for h in range(9))

    def refresh():
        raw = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(folder))
        R.start_refresh(raw, store, str(tmp_path / "cp"), ["version"], "kube", clock=lambda: next(clock)).awaitTermination()
        return store.read_appended(snap.SNAPSHOTS)

    sale = lambda i, price, version=1: {"id": str(i), "brand": "A", "price": price, "version": version}
    drop(folder, "1.json", [sale(i, 1) for i in range(12)] + [sale(0, 5, 2)])
    assert rows(refresh(), "total_records", "total_revenue") == [(12, 16)]
    drop(folder, "2.json", [sale(11, 3, 3), sale(12, 10)])
    snapshots = refresh()
    assert snapshots.count() == 2
    latest = snap.latest(snapshots).first()
    assert (latest["total_records"], latest["total_revenue"]) == (13, 28)
    # Nothing new, nothing done.
    assert refresh().count() == 2


def test_refresh_stops_on_too_few_rows(spark, tmp_path):
    folder = tmp_path / "raw"
    drop(folder, "1.json", [{"id": "1", "brand": "A", "price": 1, "version": 1}])
    raw = spark.readStream.schema("id string, brand string, price decimal(18,2), version int").json(str(folder))
    query = R.start_refresh(raw, TableStore(spark, str(tmp_path / "store")), str(tmp_path / "cp"), ["version"])
    with pytest.raises(Exception, match="only 1 rows"):
        query.awaitTermination()


def test_terminal_events_are_forgotten_after_a_silence(spark, tmp_path):
    folder, checkpoint = tmp_path / "events", str(tmp_path / "cp")

    def run():
        with K.state_store(spark):
            found = K.first_terminal_events(A.read_events(spark, str(folder), 1), 30 * 60 * 1000)
            return rows(R.run_appended(found, str(tmp_path / "out"), checkpoint), "query_id", "event_type")

    def remembered():
        state = spark.read.format("statestore").option("stateVarName", "state").load(checkpoint)
        return sorted(r["query_id"] for r in state.select("key.query_id").collect())

    drop(folder, "1.json", FIRST + SECOND)
    assert run() == [("a", "complete"), ("b", "error")]
    # The same again after a restart; a sign of life of b that is not terminal.
    drop(folder, "2.json", [event("a", 7, 8, "complete", answer="again"), event("b", 4, 20, "question", question="still here")])
    assert run() == [("a", "complete"), ("b", "error")]
    assert remembered() == ["a", "b", "c"]
    # Much later: timers of a, b and c have passed, and only z is remembered.
    drop(folder, "3.json", SENTINEL)
    drop(folder, "4.json", [event("z", 2, 601, "complete", answer="x")])
    assert run() == [("a", "complete"), ("b", "error"), ("z", "complete")]
    assert remembered() == ["z"]
    drop(folder, "5.json", [event("a", 8, 610, "complete", answer="anew")])
    assert run().count(("a", "complete")) == 2
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != K.PROVIDER


class CountedState:
    """State and timers of one query, counting the calls, each of which is a message to the JVM."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_a_query_costs_few_calls_to_its_state():
    ttl, minute, draw = 30 * 60 * 1000, 60_000_000, random.Random(7)
    kinds = [K.COMPLETE, K.ERROR, "tool_call_complete", None]
    for _ in range(200):
        state, processor = CountedState(), K.FirstOfEachKind(ttl)
        processor.init(state)
        last, seen = None, set()
        for batch_number in range(3):
            events = [(draw.randrange(-2, 200) * minute + draw.randrange(3), draw.choice(kinds)) for _ in range(draw.randrange(1, 6))]
            expected = []
            for us, kind in sorted(events, key=lambda e: (e[0], e[1] or "~")):
                if last is not None and us // 1000 >= last + ttl:
                    seen = set()
                last = max(us // 1000, us // 1000 if last is None else last)
                if kind in (K.COMPLETE, K.ERROR) and kind not in seen:
                    seen.add(kind)
                    expected.append(("q", kind, us))
            state.calls = 0
            rows_in = (Row(query_id="q", event_type=kind, us=us) for us, kind in events)
            assert [tuple(r) for r in processor.handleInputRows(("q",), rows_in, None)] == expected
            assert state.calls <= (4 if batch_number else 3)
            assert state.value == (",".join(sorted(seen)), last) and state.timers == {last + ttl}
        # Events that change nothing are one read.
        state.calls = 0
        assert list(processor.handleInputRows(("q",), iter([Row(query_id="q", event_type="question", us=last * 1000)]), None)) == []
        assert state.calls == 1
        assert list(processor.handleExpiredTimer(("q",), None, None)) == [] and state.value is None


def test_queries_pass_without_a_call_into_python(spark, tmp_path, monkeypatch):
    folder, draw = tmp_path / "events", random.Random(3)
    kinds = [K.COMPLETE, K.ERROR, "tool_call_complete", None]
    queries = ["", "é", None, *(f"q{n}" for n in range(30))]
    for number in range(4):
        # Files overlap in time, and the first begins before 1970; one query is much larger than the others.
        start = -60 if number == 0 else -60 + 25 * number
        batch = [event(draw.choice(queries), 1, start + draw.randrange(70) + draw.randrange(3) / 6e7, draw.choice(kinds)) for _ in range(200)]
        batch += [event("large", 1, start + draw.randrange(70), draw.choice(kinds)) for _ in range(100)]
        for e in batch:
            e["ts"] = (dt.datetime.fromisoformat(e["ts"]) - T0 + dt.datetime(1970, 1, 1)).isoformat()
        drop(folder, f"{number}.json", [*batch, {**batch[0], "ts": None}])

    def run(python):
        monkeypatch.setattr(K, "is_remote", lambda: python, raising=False)
        checkpoint = str(tmp_path / f"cp-{python}")
        with K.state_store(spark):
            found = K.first_terminal_events(A.read_events(spark, str(folder), 1), 30 * 60 * 1000)
            plan = found._jdf.queryExecution().analyzed().toString()
            kept = rows(R.run_appended(found, str(tmp_path / f"out-{python}"), checkpoint), "query_id", "event_type", F.unix_micros("ts"))
        read = lambda **options: spark.read.format("statestore").options(**options).load(checkpoint)
        state = rows(read(stateVarName="state"), "key.query_id", "value.kinds", "value.last_ms")
        timers = rows(read(readRegisteredTimers=True), "key.query_id", "expiration_timestamp_ms")
        return "InPySpark" in plan, kept, state, timers

    calls_python, *found = run(python=False)
    assert not calls_python
    assert run(python=True) == (True, *found)
    kept, state, timers = found
    assert kept and state and [(q, last + 30 * 60 * 1000) for q, _, last in state] == timers
