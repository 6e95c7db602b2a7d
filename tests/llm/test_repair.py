"""Conversation repair against a plain search over all edits, on damaged and odd conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakesight.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string"
STEPS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
TAKES = "uuau"
NAMES = {"u": "user", "a": "assistant"}


def plain(codes):
    """(cost, audit): the least pair of each node, node after node. Codes: initial, gone, truncated."""
    found = {(0, 0): (0, "")}

    def reach(node, value):
        if node not in found or value < found[node]:
            found[node] = value

    for i in range(len(codes) + 1):
        for _ in range(4):
            for q in range(4):
                if (i, q) in found:
                    cost, audit = found[i, q]
                    reach((i, STEPS[q][TAKES[q]]), (cost + 5, audit + "I"))
        if i == len(codes):
            break
        initial, gone, truncated = codes[i]
        for q in range(4):
            if (i, q) not in found:
                continue
            cost, audit = found[i, q]
            reach((i + 1, q), (cost + 2, audit + "D"))
            if not gone:
                cost += 5 * truncated
                if initial in STEPS[q]:
                    reach((i + 1, STEPS[q][initial]), (cost, audit + "K"))
                reach((i + 1, STEPS[q][TAKES[q]]), (cost + 1, audit + "R"))
    return min(found[n] for n in ((len(codes), 0), (len(codes), 3)) if n in found)


def expected(rows, damage):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20 if damage else 19
        role, text = (" " if x is None else x for x in (role, text))
        by[conv] += [] if kind == 0 else [(
            turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text,
        )] * (2 if kind == 3 else 1)
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        numbers = {t[0] for t in turns} - {None}
        seen, faults, codes = set(), [0] * 4, []
        for _, role, text in turns:
            shown = re.sub(r"[ \t-\r]+\Z", "", text)
            fault = 1 if not shown else 2 if (role, text) in seen else 3 if shown[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            codes.append((role[:1], fault in (1, 2), fault == 3))
        cost, audit = plain(codes)
        lines, state, at = [], 0, 0
        for edit in audit:
            if edit != "D":
                role = TAKES[state] if edit != "K" else turns[at][1][:1]
                lines.append(f"{turns[at][1] if edit == 'K' else NAMES[role]}:{'' if edit == 'I' else turns[at][2]}")
                state = STEPS[state][role]
            at += edit != "I"
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *faults[1:],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def test_search_from_both_ends():
    rng = random.Random(11)
    for _ in range(3000):
        codes = "".join(rng.choice("suauauaxSUAXd") for _ in range(rng.randrange(12)))
        want = plain([(c.lower() if c != "d" else "x", c == "d", c.isupper()) for c in codes])
        assert repair.cheapest(codes, 0, repair.ENDS) == want
        for size in (1, 3):
            cut = [codes[i : i + size] for i in range(0, len(codes), size)]
            if len(cut) > 1:
                rows = [(7, i, *repair.borders(piece, i == len(cut) - 1)) for i, piece in enumerate(cut)]
                states = repair.passed_states(pd.DataFrame(rows, columns=["conv_id", "_block", "_costs", "_order"]))
                parts = [
                    repair.cheapest(piece, enter, repair.ENDS) if leave < 0 else repair.cheapest(piece, enter, (leave,), False)
                    for piece, enter, leave in zip(cut, states["_enter"], states["_leave"], strict=True)
                ]
                assert (sum(p[0] for p in parts), "".join(p[1] for p in parts)) == want


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [None, "", " ok.", "yes!", "no", "a.", "why?", "because. \n", "b c d.", " \t\n"]
    roles = [None, "", "user", "assistant", "system", "tool", "assistant", "user"]
    odd = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, -3, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(150)]
    dropped = next(i for i in range(100, 999) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    long = [(50, i, ["user", "assistant"][i % 2], f"turn {i}" + "." * (i % 7 > 0)) for i in range(60)]
    return odd + [(dropped, 0, "user", "x."), (60, 1, "user", "x" * 200_000 + "."), (61, 5, "user", "same.")] + [(61, 5, "user", "same.")] * 40 + long


@pytest.mark.parametrize("bits", [11, 2, 0])
def test_repair_equals_plain_search(spark, rows, bits):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for damage in (True, False):
        turns = repair.damaged(table) if damage else table
        found = {r["conv_id"]: tuple(r)[1:] for r in repair.tally(turns, table, bits).collect()}
        assert found == expected(rows, damage)


def test_edits_are_listed_in_order(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    edits = defaultdict(list)
    for r in repair.repair(table).collect():
        edits[r["conv_id"]].append(r)
    for conv, want in expected(rows, False).items():
        own = edits[conv]
        assert "".join(r["edit"] for r in own) == want[6]
        kept = "\n".join(f"{r['role']}:{r['text']}" for r in own if r["edit"] != "D")
        assert hashlib.sha256(kept.encode()).hexdigest() == want[7]
        assert all((r["edit"] == "D") == (r["text"] is None) and (r["edit"] == "I") == (r["old_role"] is None) for r in own)
        assert sum(r["fault"] == "duplicate" for r in own) == want[2]


def test_empty_table_and_clashing_names(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair(empty).collect() == []
    assert repair.tally(empty, empty).collect() == []
    table = spark.createDataFrame(rows, SCHEMA)
    clashing = table.select("*", *[F.lit("x").alias(c) for c in ("_place", "_code", "edit", "audit", "_copies", "fault")])
    assert sorted(map(str, repair.tally(clashing, clashing).collect())) == sorted(map(str, repair.tally(table, table).collect()))
    none_left = repair.tally(empty, table.filter("conv_id = 1")).first()
    assert tuple(none_left) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
