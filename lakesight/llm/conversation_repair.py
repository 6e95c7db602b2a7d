"""Repair of conversations: the cheapest edits that let user and assistant take turns.

A conversation is right if it is empty, or an optional system turn is followed by user and
assistant in turns, ending with the assistant. The edits of a conversation form a lattice of
turns by states of that pattern; a path through it is a list of edits. The cheapest path is
found by Dijkstra's search from both ends: the heaps meet, all crossings of equal cost are
finished, and of their audits (the edits' initials) the least in ASCII order is taken.

Spark keeps conversations of any length in bounded pieces: turns are put in order by range
partitions and cut into segments. Of a conversation with several segments only costs between
the states at their borders are brought together; the search then runs inside each segment,
between the states that the whole conversation passes there. No edit is inserted at the end
of a segment but the last, so of two audits between two borders neither begins the other and
segments can be compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lakesight.llm.common import BLANK
from lakesight.session import materialize

#: Segments have up to 2 to this power turns.
SEGMENT_BITS = 11
# The costs of the edits, and what a truncated turn that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States of the pattern: nothing yet, after system, after user, after assistant; where each initial leads.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an inserted or changed turn takes in each state; of the two roles only one is possible.
TAKES = ("u", "u", "a", "u")
ENDS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Code of a turn that has to go; others have their role's initial, in upper case if truncated.
GONE, OTHER = "d", "x"
FAULTS = ("", "blank", "duplicate", "truncated")
OUTPUT = ["turn", "fault", "edit", "old_role", "role", "text"]
TALLY = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

Found = tuple[int, str]


def forward(code: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, state after, cost) of the edits that consume a turn."""
    yield "D", state, DELETE
    if code != GONE:
        extra = TRUNCATED if code.isupper() else 0
        kept = STEPS[state].get(code.lower())
        if kept is not None:
            yield "K", kept, KEEP + extra
        yield "R", STEPS[state][TAKES[state]], REROLE + extra


#: For each code and state, the edits that lead to the state: (initial, state before, cost).
BACKWARD = {
    code: [[(edit, before, cost) for before in range(4) for edit, after, cost in forward(code, before) if after == state] for state in range(4)]
    for code in "suaxSUAXd"
}
FORWARD = {code: [list(forward(code, state)) for state in range(4)] for code in "suaxSUAXd"}
INSERTED = [[before for before in range(4) if STEPS[before][TAKES[before]] == state] for state in range(4)]


def cheapest(codes: str, start: int, goals: tuple[int, ...], insert_at_end: bool = True) -> Found | None:
    """(cost, least audit) of the edits from a state before the first turn to one of the goals after the last.

    Entries of a heap are ordered by cost, then by how far they have come: edits of no cost
    consume a turn, so whatever can reach a node at its cost is there before it is settled, and
    the first entry of a node has its least audit.
    """
    n = len(codes)
    ahead: dict[tuple[int, int], Found] = {}
    behind: dict[tuple[int, int], Found] = {}
    out, back = [(0, 0, "", start)], [(0, -n, "", goal) for goal in sorted(goals)]
    best: Found | None = None

    def cross(left: Found, edit: str, cost: int, right: Found) -> None:
        nonlocal best
        found = (left[0] + cost + right[0], left[1] + edit + right[1])
        if best is None or found < best:
            best = found

    while out and back and (best is None or out[0][0] + back[0][0] <= best[0]):
        if out[0][0] < back[0][0]:
            cost, at, audit, state = heappop(out)
            if (at, state) in ahead:
                continue
            here = ahead[at, state] = (cost, audit)
            if (at, state) in behind:
                cross(here, "", 0, behind[at, state])
            edits = [(e, at + 1, s, c) for e, s, c in FORWARD[codes[at]][state]] if at < n else []
            if at < n or insert_at_end:
                edits.append(("I", at, STEPS[state][TAKES[state]], INSERT))
            for edit, to, after, more in edits:
                if (to, after) in behind:
                    cross(here, edit, more, behind[to, after])
                if (to, after) not in ahead:
                    heappush(out, (cost + more, to, audit + edit, after))
        else:
            cost, at, audit, state = heappop(back)
            at = -at
            if (at, state) in behind:
                continue
            here = behind[at, state] = (cost, audit)
            if (at, state) in ahead:
                cross(ahead[at, state], "", 0, here)
            edits = [(e, at - 1, s, c) for e, s, c in BACKWARD[codes[at - 1]][state]] if at else []
            if at < n or insert_at_end:
                edits += [("I", at, before, INSERT) for before in INSERTED[state]]
            for edit, to, before, more in edits:
                if (to, before) in ahead:
                    cross(ahead[to, before], edit, more, here)
                if (to, before) not in behind:
                    heappush(back, (cost + more, -to, edit + audit, before))
    return best


def borders(codes: str, last: bool) -> tuple[list[int], list[int]]:
    """Costs from each state before a segment to each after it (-1: none), and the audits' order among equals.

    For the last segment, where the end is free, only the first of each four counts.
    """
    costs, order = [], []
    for start in range(4):
        ways = [cheapest(codes, start, ENDS)] + [None] * 3 if last else [cheapest(codes, start, (goal,), False) for goal in range(4)]
        audits = sorted(w[1] for w in ways if w)
        costs += [w[0] if w else -1 for w in ways]
        order += [audits.index(w[1]) if w else -1 for w in ways]
    return costs, order


def passed_states(segments: pd.DataFrame) -> pd.DataFrame:
    """(conv_id, _block, _enter, _leave) of the segments of one conversation, from their border costs; _leave is -1 at the end."""
    segments = segments.sort_values("_block", ignore_index=True)
    far = float("inf")
    costs = [[[c if c >= 0 else far for c in row[4 * s : 4 * s + 4]] for s in range(4)] for row in segments["_costs"]]
    rest = [[c[0] for c in costs[-1]]]
    for ways in reversed(costs[:-1]):
        rest.append([min(c + r for c, r in zip(w, rest[-1], strict=True)) for w in ways])
    rest.reverse()
    enter, leave, state = [], [], 0
    for k, order in enumerate(segments["_order"]):
        enter.append(state)
        if k < len(costs) - 1:
            state = min((costs[k][state][to] + rest[k + 1][to], order[4 * state + to], to) for to in range(4) if costs[k][state][to] < far)[2]
            leave.append(state)
    return segments[["conv_id", "_block"]].assign(_enter=enter, _leave=[*leave, -1])


def placed(audit: str, codes: str, state: int) -> Iterator[tuple[str, str]]:
    """For each turn its edits and the roles these give: inserts before it, its own, behind the last turn also the rest."""
    edits, roles, at = "", "", 0
    done: list[tuple[str, str]] = []
    for edit in audit:
        edits += edit
        if edit != "D":
            role = codes[at].lower() if edit == "K" else TAKES[state]
            roles += role
            state = STEPS[state][role]
        if edit != "I":
            done.append((edits, roles))
            edits, roles, at = "", "", at + 1
    if edits:
        done[-1] = (done[-1][0] + edits, done[-1][1] + roles)
    yield from done


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{BLANK}]")


def told_apart(turns: DataFrame) -> DataFrame:
    """Turns with nulls as spaces, and the columns that order those of one number: role, text, digest of both.

    Of role and text 32 characters stand for the whole; where they are alike the digest decides.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return rows.withColumns({
        "_role": F.left("role", F.lit(32)), "_head": F.left("text", F.lit(32)),
        "_digest": F.unhex(F.sha2(F.concat_ws("\0", "role", "text"), 256)),
    })


ORDER = ["conv_id", "turn", "_role", "_head", "_digest"]


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Turns in order without their texts, equal ones merged: ``ORDER``, _copies, _fault, _code, _place.

    Places come from range partitions, so that a long conversation is spread over several of
    them. Texts stay where they are.
    """
    rows = told_apart(turns)
    end = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    initial = F.left("role", F.lit(1))
    merged = materialize(
        rows.select(*ORDER, F.when(initial.isin("s", "u", "a"), initial).otherwise(OTHER).alias("_known"), is_blank(F.col("text")).alias("_blank"),
                    (~end.isin(".", "!", "?")).alias("_cut"))
        .groupBy(*ORDER, "_known", "_blank", "_cut").agg(F.count(F.lit(1)).alias("_copies")), "merged")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    firsts = (
        merged.groupBy("conv_id", "_digest").agg(F.count(F.lit(1)).alias("_n"), F.min(when).alias("_first"))
        .filter("_n > 1").select(F.col("conv_id").alias("_c"), F.col("_digest").alias("_d"), "_first")
    )
    again = merged.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_digest") == F.col("_d")), "left")
    fault = (
        F.when(F.col("_blank"), 1).when(F.col("_first").isNotNull() & (when > F.col("_first")), 2)
        .when(F.col("_cut"), 3).otherwise(0)
    )
    code = F.when(F.col("_fault").isin(1, 2), GONE).when(F.col("_fault") == 3, F.upper("_known")).otherwise(F.col("_known"))
    return materialize(
        again.withColumn("_fault", fault).withColumn("_code", code).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
        .select(*ORDER, "_copies", "_fault", "_code", F.monotonically_increasing_id().alias("_place")),
        "ordered")


def _mapped(batches: Iterator[pa.RecordBatch], columns: list[str], schema: pa.Schema, each, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Batches of what ``each`` makes of a stream of rows."""
    rows = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True))
    made: list[tuple] = []
    for row in each(rows):
        made.append(row)
        if len(made) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)
            made = []
    if made:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def turn_edits(turns: DataFrame, segment_bits: int) -> DataFrame:
    """(conv_id, _place, _edit, _roles) of the turns of ``ordered_turns``."""
    segments = materialize(
        turns.groupBy("conv_id", F.shiftright("_place", segment_bits).alias("_block"))
        .agg(F.sort_array(F.collect_list(F.struct("_place", "_code"))).alias("_turns"))
        .select("conv_id", "_block", F.col("_turns")[0]["_place"].alias("_from"), F.array_join(F.col("_turns")["_code"], "").alias("_codes")),
        "segments")
    several = segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_block").alias("_last")).filter("_n > 1")
    several = several.select(F.col("conv_id").alias("_c"), "_last")
    pieces = segments.join(several, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "_block", "_codes", (F.col("_block") == F.col("_last")).alias("_end"))
    bordered = pieces.select("conv_id", "_block").withColumns({"_costs": F.array().cast("array<long>"), "_order": F.array().cast("array<long>")}).schema
    bordered_arrow = _arrow(bordered)

    def measure(rows):
        for conv, block, codes, end in rows:
            yield (conv, block, *borders(codes, end))

    costs = pieces.mapInArrow(lambda batches: _mapped(batches, ["conv_id", "_block", "_codes", "_end"], bordered_arrow, measure), bordered)
    states = costs.groupBy("conv_id").applyInPandas(
        passed_states, pieces.select("conv_id", "_block", F.lit(0).alias("_enter"), F.lit(0).alias("_leave")).schema)
    states = states.select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), "_enter", "_leave")
    known = segments.join(states, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left").select(
        "conv_id", "_from", "_codes", F.coalesce("_enter", F.lit(0)).alias("_enter"), F.coalesce("_leave", F.lit(-1)).alias("_leave"))
    edited = known.select("conv_id", F.col("_from").alias("_place"), F.lit("").alias("_edit"), F.lit("").alias("_roles")).schema
    edited_arrow = _arrow(edited)

    def search(rows):
        for conv, place, codes, enter, leave in rows:
            _, audit = cheapest(codes, enter, ENDS) if leave < 0 else cheapest(codes, enter, (leave,), False)
            for i, (edit, roles) in enumerate(placed(audit, codes, enter)):
                yield conv, place + i, edit, roles

    return known.mapInArrow(lambda batches: _mapped(batches, ["conv_id", "_from", "_codes", "_enter", "_leave"], edited_arrow, search), edited)


def _met(turns: DataFrame, segment_bits: int) -> tuple[DataFrame, DataFrame]:
    """Turns behind their edits, in order, each conversation in one partition; and the turns in order.

    Texts travel once, here. Equal turns share one row of edits.
    """
    ordered = ordered_turns(turns)
    edits = turn_edits(ordered, segment_bits).select(F.col("_place").alias("_p"), "_edit", "_roles")
    edited = ordered.join(edits, F.col("_place") == F.col("_p")).select(*ORDER, "_copies", "_fault", "_edit", "_roles")
    rows = told_apart(turns).unionByName(edited, allowMissingColumns=True)
    return rows.repartition("conv_id").sortWithinPartitions(*ORDER, F.col("_edit").isNull()), ordered


MET = ["conv_id", "turn", "role", "text", "_copies", "_fault", "_edit", "_roles"]


def _edited(rows) -> Iterator[tuple]:
    """(conv_id, turn, fault, edit, old_role, role, text) of each edit, from a stream of edits and their turns."""
    pending = None
    for conv, turn, role, text, copies_, fault_, edit, roles in rows:
        if edit is not None:
            pending, copies, fault = (edit, roles), copies_, fault_
            continue
        if pending is None:
            continue  # equal to the turn before, which has had its edits
        given, (letters, _), pending = iter(pending[1]), pending, None
        for letter in letters:
            if letter == "I":
                yield conv, None, 0, "I", None, ROLES[next(given)], ""
            elif letter == "D":
                yield conv, turn, fault, "D", role, None, None
            else:
                to = next(given)
                yield conv, turn, fault, letter, role, role if letter == "K" else ROLES[to], text
            if letter != "I":
                # Further equal turns go, right behind the first.
                for _ in range(copies - 1):
                    yield conv, turn, 1 if fault == 1 else 2, "D", role, None, None


def repair(turns: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """The edits of each conversation in order: conv_id, turn, fault, edit, old_role, role, text.

    ``turns`` has conv_id, turn, role and text; other columns are left out. One row is
    returned for each turn and each inserted turn; deleted ones have no role and text,
    inserted ones no turn and old_role. ``fault`` is blank, duplicate, truncated or empty.

    A null role or text is one space, a null conv_id a conversation of its own, null turns
    come first. Turns of one number are ordered by role and text. Repeated rows are kept
    once: the others are duplicates. Roles that begin neither with s, u nor a, among them the
    empty one, cannot be kept. An empty table gives an empty table.

    All rows of a conversation end in one partition, where they pass as a stream; the search
    itself works on segments of bounded length.
    """
    met, rows = _met(turns, segment_bits)
    schema = rows.select(
        "conv_id", "turn", F.lit("").alias("fault"), F.lit("").alias("edit"),
        *[F.lit("x").cast("string").alias(c) for c in ("old_role", "role", "text")]).schema
    for field in schema.fields:
        field.nullable = True
    arrow = _arrow(schema)

    def named(stream):
        for conv, turn, fault, *rest in _edited(stream):
            yield (conv, turn, FAULTS[fault], *rest)

    return met.mapInArrow(lambda batches: _mapped(batches, MET, arrow, named), schema)


def _tallied(rows) -> Iterator[tuple]:
    """Figures of each conversation, from the stream of its edits."""
    for conv, edits in groupby(_edited(rows), key=itemgetter(0)):
        faults, cost, audit, turns, illegal = [0] * 4, 0, [], [None, None, 0], 0
        digest, before, lines = hashlib.sha256(), None, 0
        for _, turn, fault, edit, old, role, text in edits:
            audit.append(edit)
            cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + (TRUNCATED if fault == 3 and edit != "D" else 0)
            if edit != "I":
                faults[fault] += 1
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                illegal += before is not None and (before + old[:1]) not in ("su", "ua", "au")
                before = old[:1]
            if role is not None:
                digest.update((("\n" if lines else "") + f"{role}:{text}").encode("utf-8", "replace"))
                lines += 1
        gaps = min(turns[1] - turns[0] + 1 - turns[2], (1 << 63) - 1) if turns[2] else 0
        yield conv, gaps, *faults[1:], illegal, cost, "".join(audit), digest.hexdigest()


def tally(turns: DataFrame, conversations: DataFrame, segment_bits: int = SEGMENT_BITS) -> DataFrame:
    """A row of figures for each conv_id of ``conversations`` (null included), from the edits of ``turns``.

    The digest of a repaired conversation is taken as its turns pass in order. A conversation
    without turns has zeros, an empty audit and the digest of nothing.
    """
    met, rows = _met(turns, segment_bits)
    zero = F.lit(0).cast("long")
    empty = {c: zero for c in TALLY[:6]} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    schema = rows.select(F.col("conv_id").alias("_c"), *[v.alias(k) for k, v in empty.items()]).schema
    arrow = _arrow(schema)
    found = met.mapInArrow(lambda batches: _mapped(batches, MET, arrow, _tallied), schema)
    every = conversations.select("conv_id").distinct()
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").select(
        "conv_id", *[F.coalesce(c, v).alias(c) for c, v in empty.items()])


def damaged(conversations: DataFrame) -> DataFrame:
    """The turns after the damage that the query is asked to do, by a checksum of conversation and turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select(
        "conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("_kind")
    ).filter("_kind != 0")
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def op11_conversation_repair(spark, folder: str) -> DataFrame:
    """Faults, cheapest repair and digest of every damaged conversation."""
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return tally(damaged(conversations), conversations)
