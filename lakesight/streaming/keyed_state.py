"""Terminal events of queries, each kind once, with state that a timer clears.

The state of a query lives as long as the query is heard of: every event of it moves a timer,
and once the watermark passes it the state goes. How long events of different queries lie
apart therefore plays no part, unlike with a watermark over the whole stream.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.utils import is_remote

from lakesight.streaming.agent_events import COMPLETE, ERROR, LATE
from lakesight.streaming.jvm_classes import jvm_class

#: Named state, timers and clearing by key need this state store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "query_id string, event_type string, us long"
#: Terminal kinds in the order in which those of one time pass; a time and its kind travel as one number.
KINDS = [COMPLETE, ERROR]
CODES = {kind: n for n, kind in enumerate(KINDS)}
OTHER = len(KINDS)
Passed = Row("query_id", "event_type", "us")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside use the state store that named state and timers need; others keep theirs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class FirstOfEachKind(StatefulProcessor):
    """Passes a terminal event on unless the query had one of its kind within ``ttl_ms`` of its last event.

    Every call to the state is a message to the JVM and back, and there are very many queries: a
    query costs one read, and a write and a moved timer if something changed. It has one timer, at
    ``ttl_ms`` after the last event that its state names, so the timers need not be asked for.
    """

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "kinds string, last_ms long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # The events of one query in one micro-batch, eight bytes each; those of one time by kind.
        events = array("q", (r.us * (OTHER + 1) + CODES.get(r.event_type, OTHER) for r in rows))
        before = self.state.get() or ("", None)
        seen, last = set(filter(None, before[0].split(","))), before[1]
        passed = []
        for event in sorted(events):
            us, code = divmod(event, OTHER + 1)
            at = us // 1000
            if last is not None and at >= last + self.ttl_ms:
                seen.clear()
            last = at if last is None else max(at, last)
            if code != OTHER and KINDS[code] not in seen:
                seen.add(KINDS[code])
                passed.append(Passed(key[0], KINDS[code], us))
        if last != before[1]:
            if before[1] is not None:
                self.handle.deleteTimer(before[1] + self.ttl_ms)
            self.handle.registerTimer(last + self.ttl_ms)
        now = (",".join(sorted(seen)), last)
        if now != before:
            self.state.update(now)
        return iter(passed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_terminal_events(events: DataFrame, ttl_ms: int, late: str = LATE) -> DataFrame:
    """(query_id, event_type, ts) of the first terminal event of each kind, again only after a silence of ``ttl_ms``.

    ``events`` is a stream with query_id, event_type and ts; all events of a query keep its
    state alive. Start it inside :func:`state_store`.
    """
    # Times travel as numbers, which no session zone moves.
    timed = events.select("query_id", "event_type", "ts", F.unix_micros("ts").alias("us")).where(F.col("ts").isNotNull()).withWatermark("ts", late)
    passed = in_python(timed, ttl_ms) if is_remote() else in_jvm(timed, ttl_ms)
    return passed.select("query_id", "event_type", F.timestamp_micros("us").alias("ts"))


def in_python(timed: DataFrame, ttl_ms: int) -> DataFrame:
    """:class:`FirstOfEachKind` over (query_id, event_type, ts, us), for sessions that have no JVM of their own."""
    return timed.groupBy("query_id").transformWithState(
        statefulProcessor=FirstOfEachKind(ttl_ms), outputStructType=SCHEMA, outputMode="append", timeMode="EventTime")


def in_jvm(timed: DataFrame, ttl_ms: int) -> DataFrame:
    """The same by its twin in ``FirstOfEachKind.java``: a query then costs no message and no Arrow batch of its own."""
    spark = timed.sparkSession
    sql = spark._jvm.org.apache.spark.sql

    def encoder(schema: StructType) -> JavaObject:
        return sql.Encoders.row(sql.types.StructType.fromJson(schema.json()))

    kinds = _array(spark, "String", KINDS)
    processor = jvm_class(spark, "FirstOfEachKind").getConstructors()[0].newInstance(_array(spark, "Object", [ttl_ms, kinds]))
    key, passed = encoder(timed.select("query_id").schema), encoder(StructType.fromDDL(SCHEMA))
    grouped = getattr(timed.groupBy("query_id")._jgd, "as")(key, encoder(timed.schema))
    mode, output = sql.streaming.TimeMode.EventTime(), sql.streaming.OutputMode.Append()
    return DataFrame(grouped.transformWithState(processor, mode, output, passed).toDF(), spark)


def _array(spark: SparkSession, kind: str, values: list) -> JavaObject:
    array = spark.sparkContext._gateway.new_array(getattr(spark._jvm.java.lang, kind), len(values))
    for i, value in enumerate(values):
        array[i] = value
    return array
