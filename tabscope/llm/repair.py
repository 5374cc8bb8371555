"""Repair of conversations by generalised LR parsing with weighted edits.

The roles of a conversation must form ``(s?(ua)+)?``: nothing, or a system turn at most
and then pairs of a user and an assistant turn. The grammar

    C -> (nothing) | B      B -> P | s P | B P      P -> u a

has an LR table. A graph-structured stack is driven over the turns; before every turn it
may insert user or assistant turns, and each turn is kept, given another role or deleted.
Heads of the stack whose top states are equal are merged into the one of the least
(cost, audit); an audit is the string of the edits' initials. Insertions bring any head
to any other top, so there are at most four heads, and a turn costs a bounded step.

Heads carry the rank of their audit, not the audit: two audits up to the same turn
differ before either of them ends, so a rank and the last letters decide every tie.

A conversation of any length is split: turns lie in range partitions of (conversation,
turn), a hot one in many. Each partition gives, for the conversations at its two ends,
cost and rank from every top to every top; a scan over these few numbers per partition
finds the heads with which each segment starts and ends, and the partitions then write
their edits. Whether a turn repeats an earlier one is found by an aggregate over
(conversation, digest of role and text), which copies enter pre-aggregated.

Defined cases: a null conversation id is a conversation of its own; null turns come
first; turns of one number follow the order of the first 64 characters of role and of
text, then of a digest of both; null roles and texts are empty ones here; a role counts
by its first character, upper case being another; a turn that is blank or repeats an
earlier role and text must be deleted; repeated rows are such copies; very long texts
pass one at a time; an empty table gives no rows; further columns are left out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabscope.llm.common import SEPARATORS, saved

#: Costs of the edits; an undeleted turn whose text is cut off costs TRUNCATED besides.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: The LR table: shifts, reductions (left side, length of right side) and gotos.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 7}
REDUCE = {7: ("P", 2), 4: ("B", 1), 5: ("B", 2), 6: ("B", 2)}
GOTO = {(0, "P"): 4, (1, "P"): 5, (3, "P"): 6, (0, "B"): 3}
ACCEPT = (0, 3)
#: A stack for each top that can stand between two turns.
START = {0: (0, None), 1: (1, (0, None)), 2: (2, (0, None)), 3: (3, (0, None))}
#: Faults of a turn, the first that holds; codes join them with the role's initial.
SOUND, CUT_OFF, BLANK, COPY = range(4)
INITIALS = "sua"


def push(stack: tuple, symbol: str) -> tuple | None:
    """The stack after a shift and the reductions that follow; None where the table has no shift."""
    state = SHIFT.get((stack[0], symbol))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        rule, size = REDUCE[stack[0]]
        for _ in range(size):
            stack = stack[1]
        stack = (GOTO[stack[0], rule], stack)
    return stack


def with_inserts(heads: tuple) -> dict[int, tuple]:
    """{top: (cost, rank, inserted symbols, stack, core top)}: heads and what inserts make of them."""
    found = {stack[0]: (cost, rank, "", stack, stack[0]) for cost, rank, stack in heads}
    queue = list(found.values())
    while queue:
        cost, rank, inserted, stack, core = queue.pop()
        for symbol in ROLES:
            new = push(stack, symbol)
            if new is not None:
                head = (cost + INSERT, rank, inserted + symbol, new, core)
                old = found.get(new[0])
                if old is None or (head[0], rank, len(head[2])) < (old[0], old[1], len(old[2])):
                    found[new[0]] = head
                    queue.append(head)
    return found


@lru_cache(maxsize=100_000)
def step(heads: tuple, code: int) -> tuple[tuple, int, dict]:
    """(heads after a turn, cost to add to all of them, {top: (core top, inserted, edit, symbol)})."""
    initial, fault = (INITIALS + "-")[code // 4], code % 4
    extra = TRUNCATED if fault == CUT_OFF else 0
    best: dict[int, tuple] = {}
    for cost, rank, inserted, stack, core in with_inserts(heads).values():
        edits = [(DELETE, "D", "", stack)]
        if fault not in (BLANK, COPY):
            edits.append((KEEP + extra, "K", initial, push(stack, initial)))
            edits += [(REROLE + extra, "R", r, push(stack, r)) for r in ROLES if r != initial]
        for price, letter, symbol, new in edits:
            if new is not None:
                key = (cost + price, rank, "I" * len(inserted) + letter)
                if new[0] not in best or key < best[new[0]][0]:
                    best[new[0]] = key, new, (core, inserted, letter, symbol)
    least = min(key[0] for key, _, _ in best.values())
    order = sorted(best, key=lambda top: best[top][0][1:])
    after = tuple((best[t][0][0] - least, i, best[t][1]) for i, t in enumerate(order))
    return after, least, {t: best[t][2] for t in order}


def start(top: int) -> tuple:
    return ((0, 0, START[top]),)


def drive(heads: tuple, codes: bytes) -> tuple[tuple, int, list[dict]]:
    """Heads after all turns, the cost to add to them, and the links back of each turn."""
    total, links = 0, []
    for code in codes:
        heads, more, back = step(heads, code)
        total += more
        links.append(back)
    return heads, total, links


def finish(heads: tuple) -> tuple[int, str]:
    """(core top, symbols inserted at the end) of the cheapest accepted head."""
    found = [h for top, h in with_inserts(heads).items() if top in ACCEPT]
    _, _, inserted, _, core = min(found, key=lambda h: (h[0], h[1], len(h[2])))
    return core, inserted


def edits_of(codes: bytes, first: int = 0, last: int | None = None) -> tuple[list[tuple], str]:
    """([(inserted before, edit, symbol)] of each turn, inserted at the end).

    ``first`` is the top at the start and ``last`` that at the end of a segment; without
    ``last`` the conversation ends here.
    """
    heads, _, links = drive(start(first), codes)
    top, at_end = (last, "") if last is not None else finish(heads)
    found = []
    for back in reversed(links):
        top, *edit = back[top]
        found.append(tuple(edit))
    return found[::-1], at_end


def segment(codes: bytes) -> list[int]:
    """Cost and rank of the head at each top for each top at the start; cost -1 where there is none."""
    out = []
    for top in START:
        heads, total, _ = drive(start(top), codes)
        ends = {stack[0]: (cost + total, rank) for cost, rank, stack in heads}
        out += [x for t in START for x in ends.get(t, (-1, 0))]
    return out


def join_segments(tables: list[list[int]]) -> list[tuple[int, int]]:
    """(top at the start, top at the end) of each segment of one conversation."""
    heads, links = {0: (0, 0)}, []
    for table in tables:
        best: dict[int, tuple] = {}
        for top, (cost, rank) in heads.items():
            for end in START:
                more, place = table[8 * top + 2 * end : 8 * top + 2 * end + 2]
                key = (cost + more, rank, place)
                if more >= 0 and (end not in best or key < best[end][0]):
                    best[end] = key, top
        order = sorted(best, key=lambda t: best[t][0][1:])
        heads = {t: (best[t][0][0], i) for i, t in enumerate(order)}
        links.append({t: best[t][1] for t in order})
    top, _ = finish(tuple((cost, rank, START[t]) for t, (cost, rank) in heads.items()))
    found = []
    for back in reversed(links):
        found.append((back[top], top))
        top = back[top]
    return found[::-1]


class Repair(NamedTuple):
    """``rows``: all turns in order of ``pos``; ``edits``: what each of them gets, by ``pos``."""

    rows: DataFrame
    edits: DataFrame


EDITS = "conv_id long, pos long, fault int, before string, edit string, symbol string, after string"
SUMMARY = "part long, conv_id long, at_start boolean, at_end boolean, numbers array<long>"


def in_order(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, key, pos): turns sorted over range partitions, ``pos`` rising."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")
    ).withColumn("key", F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    # the last key spreads rows that are equal in all others
    rows = rows.select("*", F.substring("role", 1, 64).alias("_r"), F.substring("text", 1, 64).alias("_t"), F.monotonically_increasing_id().alias("_n"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "_r", "_t", "key", "_n"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(placed.drop("_r", "_t", "_n").withColumn("pos", F.monotonically_increasing_id()), "turns")


def coded(rows: DataFrame) -> DataFrame:
    """(part, pos, conv_id, code): the partition of a turn, its initial and its fault."""
    end = F.right(F.rtrim("text", F.lit(SEPARATORS)), F.lit(1))
    first = rows.groupBy("conv_id", "key").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("_first"))
    initial = F.when(F.char_length("role") > 0, F.left("role", F.lit(1)))
    narrow = rows.select(
        "pos",
        "conv_id",
        F.coalesce(F.position(initial, F.lit(INITIALS)), F.lit(0)).alias("_i"),
        end.alias("_end"),
    ).join(first, "pos", "left")
    fault = (
        F.when(F.col("_end") == "", BLANK)
        .when(F.col("_first").isNull(), COPY)
        .when(~F.col("_end").isin(".", "!", "?"), CUT_OFF)
        .otherwise(SOUND)
    )
    place = F.when(F.col("_i") > 0, F.col("_i") - 1).otherwise(len(INITIALS))
    return narrow.select(F.shiftright("pos", 33).alias("part"), "pos", "conv_id", (place * 4 + fault).cast("int").alias("code"))


def _runs(batches):
    """(part, conv_id, first pos, codes, begins the part, ends the part) of neighbouring turns."""
    now, begins = None, True
    for batch in batches:
        parts, places, convs, codes = (c.to_pylist() for c in batch.columns)
        for part, pos, conv, code in zip(parts, places, convs, codes):
            if now is None or part != now[0] or conv != now[1]:
                if now is not None:
                    yield (*now, begins, part != now[0])
                begins = now is None or part != now[0]
                now = (part, conv, pos, bytearray())
            now[3].append(code)
    if now is not None:
        yield (*now, begins, True)


def _tops(summaries: list) -> dict[tuple[int, bool], tuple[int, int | None]]:
    """{(part, begins it): (top at the start, top at the end)} of segments of split conversations."""
    chains: list[list] = []
    for row in sorted(summaries, key=lambda r: (r["part"], not r["at_start"])):
        if row["at_start"] and chains and chains[-1][-1]["at_end"] and chains[-1][-1]["conv_id"] == row["conv_id"]:
            chains[-1].append(row)
        else:
            chains.append([row])
    found = {}
    for chain in chains:
        if len(chain) > 1:
            tops = join_segments([list(r["numbers"]) for r in chain])
            for i, (row, (first, last)) in enumerate(zip(chain, tops)):
                found[row["part"], row["at_start"]] = first, last if i < len(chain) - 1 else None
    return found


def repair(turns: DataFrame) -> Repair:
    """The cheapest edits of every conversation of ``turns`` (conv_id, turn, role, text)."""
    rows = in_order(turns)
    codes = saved(coded(rows), "codes")
    # a number of tasks of its own: codes are few bytes, but each is a step of the parser
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    laid = codes.repartition(tasks, "part").sortWithinPartitions("part", "pos")
    summary, target = (to_arrow_schema(StructType.fromDDL(s)) for s in (SUMMARY, EDITS))

    def ends(batches):
        for part, conv, _, found, begins, finishes in _runs(batches):
            if begins or finishes:
                row = [part], [conv], [begins], [finishes], [segment(bytes(found))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, summary)], schema=summary)

    # at most two rows of 32 numbers for each partition
    tops = _tops(laid.mapInArrow(ends, SUMMARY).collect())

    def write(batches):
        for part, conv, pos, found, begins, finishes in _runs(batches):
            first, last = tops.get((part, begins), (0, None)) if begins or finishes else (0, None)
            edits, at_end = edits_of(bytes(found), first, last)
            n = len(edits)
            for a in range(0, n, 10_000):
                piece = edits[a : a + 10_000]
                m = len(piece)
                before, edit, symbol = zip(*piece)
                after = [""] * m
                if a + m == n:
                    after[-1] = at_end
                faults = [c % 4 for c in found[a : a + m]]
                columns = [conv] * m, range(pos + a, pos + a + m), faults, before, edit, symbol, after
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, target)], schema=target)

    return Repair(rows, laid.mapInArrow(write, EDITS))


def repaired(found: Repair) -> DataFrame:
    """(conv_id, pos, place, edit, turn, role, text): the turns of the repaired conversations.

    They are in order by (pos, place); deleted turns are left out, inserted ones have no
    ``turn``.
    """
    joined = found.rows.drop("key").join(found.edits.drop("conv_id"), "pos")
    role = lambda s: F.when(s == "u", ROLES["u"]).otherwise(ROLES["a"])
    none = F.lit(None).cast("long")
    made = lambda s: F.struct(F.lit("I").alias("edit"), none.alias("turn"), role(s).alias("role"), F.lit("").alias("text"))
    added = lambda c: F.transform(F.filter(F.split(c, ""), lambda s: s != ""), made)
    own = F.struct("edit", "turn", F.when(F.col("edit") == "R", role(F.col("symbol"))).otherwise(F.col("role")).alias("role"), "text")
    kept = F.when(F.col("edit") == "D", F.array()).otherwise(F.array(own)).cast(
        "array<struct<edit:string,turn:bigint,role:string,text:string>>"
    )
    every = F.concat(added("before"), kept, added("after"))
    return joined.select("conv_id", "pos", F.posexplode(every).alias("place", "_made")).select("conv_id", "pos", "place", "_made.*")


DIGESTS = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
LEGAL = {"su", "ua", "au"}


class _Digest:
    """Counts, audit and running hash of one conversation as its turns come by."""

    def __init__(self, conv_id):
        self.conv_id, self.audit, self.hash, self.any = conv_id, [], hashlib.sha256(), False
        self.faults, self.cost, self.illegal, self.before = [0] * 4, 0, 0, None
        self.least = self.most = None
        self.turns = 0

    def say(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def insert(self, symbols: str) -> None:
        self.audit.append("I" * len(symbols))
        self.cost += INSERT * len(symbols)
        for s in symbols:
            self.say(ROLES[s], "")

    def turn(self, edit: dict, row: dict) -> None:
        self.faults[edit["fault"]] += 1
        initial = row["role"][:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.before = initial
        if row["turn"] is not None:
            self.turns += row["turn"] != self.most
            self.least = row["turn"] if self.least is None else self.least
            self.most = row["turn"]
        self.insert(edit["before"])
        self.audit.append(edit["edit"])
        self.cost += {"K": KEEP, "R": REROLE, "D": DELETE}[edit["edit"]]
        if edit["edit"] != "D":
            self.cost += TRUNCATED if edit["fault"] == CUT_OFF else 0
            self.say(ROLES[edit["symbol"]] if edit["edit"] == "R" else row["role"], row["text"])
        self.insert(edit["after"])

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (
            self.conv_id, gaps, self.faults[BLANK], self.faults[COPY], self.faults[CUT_OFF],
            self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest(),
        )


def digests(found: Repair, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of ``conversations``: its faults, and the digest of its repair.

    Turns and their edits stream through a task in order, one at a time; a digest over a
    whole conversation cannot be had in parallel. Only the audit is held.
    """
    empty = {"fault": F.lit(0), "before": F.lit(""), "edit": F.lit(""), "symbol": F.lit(""), "after": F.lit("")}
    text = {"turn": F.lit(None).cast("long"), "role": F.lit(""), "text": F.lit("")}

    def frame(df: DataFrame, kind: int) -> DataFrame:
        own = lambda c, other: F.col(c) if c in df.columns else other.alias(c)
        return df.select("conv_id", own("pos", F.lit(-1).cast("long")), F.lit(kind).alias("kind"), *[own(c, o) for c, o in (empty | text).items()])

    marks = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = frame(marks, 0).unionByName(frame(found.edits, 1)).unionByName(frame(found.rows.drop("key"), 2))
    laid = every.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pos", "kind")
    target = to_arrow_schema(StructType.fromDDL(DIGESTS))

    def out(rows: list[tuple]):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), target)], schema=target)

    def run(batches):
        state, edit = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if state is not None:
                        done.append(state.row())
                    state = _Digest(row["conv_id"])
                elif row["kind"] == 1:
                    edit = row
                else:
                    state.turn(edit, row)
            if done:
                yield out(done)
        if state is not None:
            yield out([state.row()])

    return laid.mapInArrow(run, DIGESTS)
