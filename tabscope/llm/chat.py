"""Chat formatting by columnar byte assembly.

A turn becomes the segments

    <s> role [INST] text [/INST] </s>

Control strings inside roles and texts are escaped reversibly, so that a reader can
find the turns again and nothing in a text can end a turn. For a slice of rows the
lengths of all segments and their cumulative offsets are computed in numpy, one buffer
of the total size is allocated, and headers and contents are scattered into it by index
arrays. The bytes of assistant texts are the loss mask.

Rows are ordered by conversation and turn within partitions and stream through a task,
so a conversation of any length needs the memory of one slice: it comes out as parts
(``part`` from 0), each with whole turns.

Defined cases: null texts and roles are empty ones; null turns come first; rows with
equal turn follow the order of role, then text, so repeated rows stand side by side; a
null conversation id is a conversation of its own; an empty table gives no rows;
further columns are left out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The control strings of the template and of its common relatives.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
OPEN, MIDDLE, CLOSE = b"<s>", b"[INST]", b"[/INST]</s>"
LEARNED_ROLE = "assistant"
ESCAPE = "\\"
SLICE = 2_048
PARTS = "conv_id long, part int, n_turns int, body binary, loss_from array<long>, loss_to array<long>"

_TURN = re.compile(r"<s>(.*?)\[INST\](.*?)\[/INST\]</s>", re.DOTALL)
_MARK = re.compile(r"\\(\\?)")


def escape(column: pa.Array) -> pa.Array:
    """Backslashes are doubled; a single one goes behind the first character of a control string."""
    column = pc.replace_substring(column, ESCAPE, ESCAPE * 2)
    for c in CONTROL:
        column = pc.replace_substring(column, c, c[0] + ESCAPE + c[1:])
    return column


def unescape(text: str) -> str:
    return _MARK.sub(r"\1", text) if ESCAPE in text else text


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and the offsets of its values."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, row offsets, text starts, text ends): all turns in one preallocated buffer."""
    pieces = [np.frombuffer(b, np.uint8) for b in (OPEN, MIDDLE, CLOSE)]
    role, role_at = _bytes(escape(roles))
    text, text_at = _bytes(escape(texts))
    n = len(roles)
    lengths = np.empty((n, 5), np.int64)
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = (len(p) for p in pieces)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = lengths.ravel().cumsum().reshape(n, 5)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for column, piece in zip((0, 2, 4), pieces):
        out[starts[:, column, None] + np.arange(len(piece))] = piece
    for column, data, at in ((1, role, role_at), (3, text, text_at)):
        # where each byte goes: its place in the column moved by the shift of its row
        out[np.arange(len(data)) + np.repeat(starts[:, column] - at[:-1], lengths[:, column])] = data
    return out, np.concatenate([starts[:, 0], ends[-1:, 4]]), starts[:, 3], ends[:, 3]


def format_conversations(rows: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """(conv_id, part, n_turns, body, loss_from, loss_to) of conversations given as turns.

    ``loss_from`` and ``loss_to`` are byte ranges in ``body``. The parts of a
    conversation are neighbours in one partition.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    ordered = (
        rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), role.alias("role"), text.alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    )
    target = to_arrow_schema(StructType.fromDDL(PARTS))

    def run(batches):
        last, part = object(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                piece = batch.slice(start, SLICE)
                roles, texts = piece.column(2), piece.column(3)
                out, at, text_from, text_to = assemble(roles, texts)
                ids = piece.column(0)
                keys = ids.fill_null(0).to_numpy(zero_copy_only=False)
                nulls = ids.is_null().to_numpy(zero_copy_only=False)
                new = np.flatnonzero((keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])) + 1
                edges = [0, *new.tolist(), len(keys)]
                learns = pc.equal(roles, learned).to_numpy(zero_copy_only=False)
                columns: dict[str, list] = {f.name: [] for f in target}
                for a, b in zip(edges, edges[1:]):
                    key = None if nulls[a] else int(keys[a])
                    part = part + 1 if key == last else 0
                    last = key
                    mask = np.flatnonzero(learns[a:b]) + a
                    columns["conv_id"].append(key)
                    columns["part"].append(part)
                    columns["n_turns"].append(b - a)
                    columns["body"].append(out[at[a] : at[b]].tobytes())
                    columns["loss_from"].append((text_from[mask] - at[a]).tolist())
                    columns["loss_to"].append((text_to[mask] - at[a]).tolist())
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    return ordered.mapInArrow(run, PARTS)


def read_turns(body: bytes) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted part."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(body.decode())]


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted parts as they stream by."""
    target = to_arrow_schema(StructType.fromDDL(DIGESTS))

    def run(batches):
        state = None

        def row(s):
            return (s["id"], s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"])

        for batch in batches:
            done = []
            for p in batch.to_pylist():
                if p["part"] == 0:
                    if state:
                        done.append(row(state))
                    state = {"id": p["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                body = p["body"]
                for role, text in read_turns(body):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                for a, b in zip(p["loss_from"], p["loss_to"]):
                    learned = unescape(body[a:b].decode())
                    state["loss_chars"] += len(learned)
                    state["loss"].update(learned.encode())
                state["chars"] += len(body.decode())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(target, zip(*done) if done else [[]] * 6)], schema=target)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for f, v in zip(target, row(state))], schema=target)

    return parts.mapInArrow(run, DIGESTS)
