"""Lines appended to log files, as a stream whose offsets are byte positions.

Spark's file source reads a file once, so what is appended later never arrives. Here the
offset holds, for each file, the byte behind its last complete line. A batch reads what
lies between two offsets: long stretches are cut into splits for many tasks, and a line
belongs to the split in which it begins. A last line without its line break waits until
the break is written, so half-written records are never parsed.

Offsets come from file sizes; only the tail of files that have grown since is looked at.
A batch that is repeated after a failure reads the same bytes, as logs only grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tabscope.sources.logs import EVENT_SCHEMA, parse_lines

LINE_SCHEMA = "path string, position bigint, line string"
SPLIT_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
TAIL_BYTES = 64 << 10
BYTE_ORDER_MARK = b"\xef\xbb\xbf"


def follow_lines(spark: SparkSession, path: str, suffix: str = "", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A streaming DataFrame ``path, position, line`` of the complete lines below ``path``.

    ``path`` is a file or a folder, which may be empty or not exist yet; files in folders
    below it count, names that start with ``.`` or ``_`` do not, nor those without
    ``suffix``. ``position`` is the byte at which the line begins. A file that is shorter
    than what was read of it has been written anew and is read from its start; one that was
    written anew and is longer cannot be told from a grown one. Files that vanish give no
    more lines. Bytes that are no UTF-8 become replacement characters. The offset has one
    number per file, so move old files away.
    """
    spark.dataSource.register(AppendedLines)
    return (
        spark.readStream.format(AppendedLines.name())
        .option("path", path)
        .option("suffix", suffix)
        .option("splitBytes", str(split_bytes))
        .load()
    )


def follow_appended_events(spark: SparkSession, path: str, suffix: str = "", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A streaming DataFrame of event records, also of lines appended to known files.

    Blank lines are left out; a line that is no record has nulls in every column, as in
    ``read_events``.
    """
    return parse_lines(follow_lines(spark, path, suffix, split_bytes), "line", EVENT_SCHEMA)


class AppendedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tabscope_appended_lines"

    def schema(self) -> str:
        return LINE_SCHEMA

    def streamReader(self, schema) -> "AppendedLinesReader":
        return AppendedLinesReader(
            self.options["path"], self.options.get("suffix", ""), int(self.options.get("splitBytes", SPLIT_BYTES))
        )


@dataclass
class Split(InputPartition):
    """Lines of ``path`` that begin in [start, stop); the last of them ends by ``end``."""

    path: str
    start: int
    stop: int
    end: int
    first: bool


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str, suffix: str = "") -> dict[str, int]:
    """Size of each visible file at or below ``path``."""
    system, root = _open(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return {info.path: info.size}
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    sizes = {}
    for f in found:
        below = f.path[len(root) :].strip("/").split("/")
        if f.type == fs.FileType.File and f.path.endswith(suffix) and not any(p[:1] in (".", "_") for p in below):
            sizes[f.path] = f.size
    return sizes


def end_of_lines(system: fs.FileSystem, path: str, size: int) -> int:
    """The byte behind the last line break of the first ``size`` bytes; 0 without any."""
    with system.open_input_file(path) as f:
        stop = size
        while stop > 0:
            start = max(0, stop - TAIL_BYTES)
            f.seek(start)
            at = f.read(stop - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            stop = start
    return 0


def splits_between(start: dict, end: dict, split_bytes: int) -> list[Split]:
    splits = []
    for path, stop in sorted(end.items()):
        begin = start.get(path, 0)
        if stop < begin:  # written anew
            begin = 0
        for at in range(begin, stop, split_bytes):
            splits.append(Split(path, at, min(at + split_bytes, stop), stop, at == begin))
    return splits


def lines_of(system: fs.FileSystem, split: Split) -> Iterator[tuple[list[int], list[str]]]:
    """Positions and texts of the lines of a split, by blocks."""
    with system.open_input_file(split.path) as f:
        # from one byte before, so that a line that begins at the border is seen to begin
        at = split.start if split.first else split.start - 1
        skipping = not split.first
        f.seek(at)
        pending, begin = bytearray(), at
        while begin < split.stop and at < split.end:
            block = f.read(min(BLOCK_BYTES, split.end - at))
            if not block:
                raise OSError(f"{split.path} ends at {at}, before {split.end}")
            at += len(block)
            cut = block.rfind(b"\n") + 1
            if not cut:
                pending += block
                continue
            pending += block[:cut]
            positions, lines = [], []
            for raw in bytes(pending).split(b"\n")[:-1]:
                if skipping:
                    skipping = False
                elif begin < split.stop:
                    positions.append(begin)
                    text = raw.removeprefix(BYTE_ORDER_MARK) if begin == 0 else raw
                    lines.append(text.removesuffix(b"\r").decode("utf-8", "replace"))
                begin += len(raw) + 1
            pending = bytearray(block[cut:])
            yield positions, lines


class AppendedLinesReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str, split_bytes: int):
        self.path, self.suffix, self.split_bytes = path, suffix, split_bytes
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = _open(self.path)
        seen = {}
        for path, size in list_files(self.path, self.suffix).items():
            known = self.seen.get(path)
            seen[path] = known if known and known[0] == size else (size, end_of_lines(system, path, size))
        self.seen = seen
        return {path: end for path, (_, end) in sorted(seen.items())}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        return splits_between(start, end, self.split_bytes)

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        for positions, lines in lines_of(system, split):
            if lines:
                yield pa.RecordBatch.from_pydict(
                    {
                        "path": pa.array([split.path] * len(lines), pa.string()),
                        "position": pa.array(positions, pa.int64()),
                        "line": pa.array(lines, pa.string()),
                    }
                )
