"""Conversation repair against enumeration of all edits and a plain reading of the contract."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabscope.llm import repair
from tabscope.llm.common import read_table
from tabscope.llm.queries import QUERIES, damaged

WORD = r"[^\x20\x09-\x0D]"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def price(initials, faults, script):
    """(cost, audit, roles) of one script: per row (inserted before, edit, symbol), then inserted at the end."""
    *rows, end = script
    cost, audit, roles = 3 * len(end), "", ""
    for initial, fault, (before, edit, symbol) in zip(initials, faults, rows):
        cost += 3 * len(before) + {"K": 0, "R": 3, "D": 4}[edit]
        cost += 3 if edit != "D" and fault == repair.CUT_OFF else 0
        audit += "I" * len(before) + edit
        roles += before + {"K": initial, "R": symbol, "D": ""}[edit]
    return cost, audit + "I" * len(end), roles + end


def enumerated(initials, faults):
    """The least (cost, audit) of all scripts with at most two inserts in a row."""
    inserts = ["", "u", "a", "ua", "au"]
    choices = []
    for fault in faults:
        edits = [("D", "")] + ([("K", ""), ("R", "u"), ("R", "a")] if fault in (repair.SOUND, repair.CUT_OFF) else [])
        choices.append([(i, *e) for i in inserts for e in edits])
    scripts = itertools.product(*choices, inserts)
    return min(p[:2] for p in (price(initials, faults, s) for s in scripts) if GRAMMAR.fullmatch(p[2]))


def plain_best(initials, faults):
    """(cost, audit) by a table over (rows, state) with whole strings; states by what has been said."""
    follows = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "ua", ("ua", "u"): "u"}

    def closed(table):
        for _ in range(4):
            for state, (cost, audit) in list(table.items()):
                for x in "ua":
                    to = follows.get((state, x))
                    if to and (cost + 3, audit + "I") < table.get(to, (10**9, "")):
                        table[to] = cost + 3, audit + "I"
        return table

    table = closed({"": (0, "")})
    for initial, fault in zip(initials, faults):
        new: dict = {}

        def offer(state, cost, audit):
            if state is not None and (cost, audit) < new.get(state, (10**9, "")):
                new[state] = cost, audit

        extra = 3 if fault == repair.CUT_OFF else 0
        for state, (cost, audit) in table.items():
            offer(state, cost + 4, audit + "D")
            if fault in (repair.SOUND, repair.CUT_OFF):
                offer(follows.get((state, initial)), cost + extra, audit + "K")
                for x in "ua":
                    offer(follows.get((state, x)), cost + extra + 3, audit + "R")
        table = closed(new)
    return min(table[s] for s in ("", "ua") if s in table)


def codes_of(initials, faults) -> bytes:
    return bytes((repair.INITIALS + "-").index(i) * 4 + f for i, f in zip(initials, faults))


TURNS = st.lists(st.tuples(st.sampled_from("sua-"), st.sampled_from(range(4))), max_size=40)


def audit_of(edits, at_end):
    return "".join("I" * len(b) + e for b, e, _ in edits) + "I" * len(at_end)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua-"), st.sampled_from(range(4))), max_size=3))
def test_edits_are_the_least_of_all_scripts(turns):
    initials, faults = [t[0] for t in turns], [t[1] for t in turns]
    edits, at_end = repair.edits_of(codes_of(initials, faults))
    cost, audit, roles = price(initials, faults, [*edits, at_end])
    assert GRAMMAR.fullmatch(roles)
    assert (cost, audit) == enumerated(initials, faults) == plain_best(initials, faults)


@settings(max_examples=300, deadline=None)
@given(TURNS)
def test_edits_of_long_conversations(turns):
    initials, faults = [t[0] for t in turns], [t[1] for t in turns]
    edits, at_end = repair.edits_of(codes_of(initials, faults))
    assert price(initials, faults, [*edits, at_end])[:2] == plain_best(initials, faults)


@settings(max_examples=300, deadline=None)
@given(st.lists(TURNS, min_size=1, max_size=5))
def test_segments_join_to_the_same_edits(parts):
    parts = [p for p in parts if p] or [[("u", 0)]]
    codes = [codes_of([t[0] for t in p], [t[1] for t in p]) for p in parts]
    tops = repair.join_segments([repair.segment(c) for c in codes])
    split, at_end = [], ""
    for i, (code, (first, last)) in enumerate(zip(codes, tops)):
        found, at_end = repair.edits_of(code, first, last if i < len(codes) - 1 else None)
        split += found
    assert (split, at_end) == repair.edits_of(b"".join(codes))


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def plain_rows(given, turns):
    """The result rows for original rows ``given`` and rows after damage ``turns``."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in turns:
        by_conv[conv].append((turn is not None, turn or 0, role, text))
    out = set()
    for conv in {r[0] for r in given}:
        rows = sorted(by_conv[conv])
        seen, faults = set(), []
        for _, _, role, text in rows:
            said = re.findall(WORD, text)
            faults.append(
                repair.BLANK if not said else repair.COPY if (role, text) in seen else repair.CUT_OFF if said[-1] not in ".!?" else repair.SOUND
            )
            seen.add((role, text))
        initials = [r[2][:1] for r in rows]
        numbers = [t for known, t, _, _ in rows if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = plain_best(initials, faults)
        said, at, complete = [], 0, 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else rows[at][2:]
            at += letter != "I"
            if letter == "K" and role[:1] == "s":
                said.append(f"{role}:{text}")
            elif letter != "D":
                said.append(f"{role if letter == 'K' else ('user', 'assistant')[complete % 2]}:{text}")
                complete += 1
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.add(
            (conv, gaps, *(faults.count(f) for f in (repair.BLANK, repair.COPY, repair.CUT_OFF)), illegal, cost, audit,
             hashlib.sha256("\n".join(said).encode()).hexdigest())
        )
    return out


def test_query_equals_the_contract(spark, sf_dir):
    given = [tuple(r) for r in read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_conversation_repair"](spark, sf_dir).collect()
    assert {tuple(r) for r in got} == plain_rows(given, plain_damage(given))
    assert len(got) == len({r[0] for r in given})


ODD_TURNS = (
    [(c, t, "user" if t == 0 else "tool", f"{c}.") for c in range(-60, -40) for t in range(3)]
    + [(1, i, ("user", "assistant", "tool", "system", "")[i * i % 5], f"turn {i % 700}." if i % 11 else "no end") for i in range(3_000)]
    + [(2, 0, "user", "the same."), (2, 0, "user", "the same."), (2, 1, "assistant", "ok!")]
    + [(2, 5, "assistant", "ok!")] * 1_500
    + [(None, None, None, None), (None, 3, "user", None), (None, None, "assistant", "x" * 300_000 + ".")]
    + [(4, 1, "", ""), (5, 0, "User", "upper case."), (5, 1, "assistant", " \t\n"), (6, 7, "system", "only.")]
    + [(c, t, "user" if t % 2 == 0 else "assistant", "fine.") for c in range(10, 700) for t in range(3)]
)


@pytest.mark.parametrize("partitions", [1, 8, 40])
def test_hot_conversation_and_odd_turns(spark, partitions):
    rows = [(*r, "x", 1, 2) for r in ODD_TURNS]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, edit string, pos int, part int").repartition(7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for damage in (False, True):
            plain = [tuple(r) for r in ODD_TURNS]
            hurt = damaged(turns) if damage else turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
            after = plain_damage(plain) if damage else [(c, t, r or "", x or "") for c, t, r, x in plain]
            found = repair.repair(hurt)
            got = repair.digests(found, turns).collect()
            assert {tuple(r) for r in got} == plain_rows(plain, after)
        if partitions > 1:
            assert found.rows.where("conv_id = 1").selectExpr("shiftright(pos, 33) p").distinct().count() > 1
        # the repaired turns themselves say what the digests say
        lines = defaultdict(list)
        for r in repair.repaired(found).orderBy("pos", "place").collect():
            lines[r.conv_id].append(f"{r.role}:{r.text}")
            assert (r.turn is None) <= (r.edit == "I" or r.conv_id is None)
        for r in got:
            assert hashlib.sha256("\n".join(lines[r.conv_id]).encode()).hexdigest() == r.repaired_sha256
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_no_turns(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    found = repair.repair(turns)
    assert repair.digests(found, turns).count() == 0
    assert repair.repaired(found).count() == 0


def test_every_column_can_be_read_alone(spark, sf_dir):
    table = QUERIES["op13_conversation_repair"](spark, sf_dir)
    rows = table.collect()
    assert table.count() == len(rows)
    for c in table.columns:
        assert sorted(map(str, (r[c] for r in table.select(c).collect()))) == sorted(str(r[c]) for r in rows)
