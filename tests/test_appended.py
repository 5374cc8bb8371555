"""Appended log lines as a stream: each complete line arrives once."""

from __future__ import annotations

import json
import random

from pyarrow import fs

from tabscope.streaming.appended import (
    Split,
    end_of_lines,
    follow_appended_events,
    follow_lines,
    lines_of,
    list_files,
    splits_between,
)


def _run(stream, target, checkpoint):
    query = (
        stream.writeStream.format("parquet").option("path", str(target)).option("checkpointLocation", str(checkpoint))
        .trigger(availableNow=True).start()
    )
    assert query.awaitTermination(60)


def _event(i: int, kind: str = "t") -> str:
    return json.dumps({"id": f"e{i}", "event_type": kind, "reason": "ü" * (i % 5)}, ensure_ascii=False)


def test_appended_lines_arrive_once(spark, tmp_path):
    log, target, checkpoint = tmp_path / "log", tmp_path / "out", tmp_path / "cp"

    def drain():
        _run(follow_appended_events(spark, str(log), ".jsonl", split_bytes=100), target, checkpoint)
        return sorted(r["id"] for r in spark.read.parquet(str(target)).collect())

    log.mkdir()
    (log / "_hidden.jsonl").write_text(_event(99) + "\n", encoding="utf-8")
    (log / "other.txt").write_text(_event(98) + "\n", encoding="utf-8")
    with open(log / "a.jsonl", "w", encoding="utf-8") as f:
        f.write("".join(_event(i) + "\n" for i in range(20)))
        f.write(_event(20)[:9])  # half a record: waits for its end
    assert drain() == sorted(f"e{i}" for i in range(20))
    # a restart from the checkpoint: the rest of the record, a blank line, a further file
    with open(log / "a.jsonl", "a", encoding="utf-8") as f:
        f.write(_event(20)[9:] + "\n\n" + _event(21) + "\r\n")
    (log / "sub").mkdir()
    (log / "sub" / "b.jsonl").write_text(_event(22) + "\n", encoding="utf-8")
    assert drain() == sorted(f"e{i}" for i in range(23))
    assert drain() == sorted(f"e{i}" for i in range(23))
    # shorter than before: written anew
    (log / "a.jsonl").write_text(_event(30) + "\n", encoding="utf-8")
    assert drain() == sorted(f"e{i}" for i in [*range(23), 30])


def test_a_missing_folder_has_no_lines(spark, tmp_path):
    target = tmp_path / "out"
    _run(follow_lines(spark, str(tmp_path / "none")), target, tmp_path / "cp")
    assert list_files(str(tmp_path / "none")) == {}


def test_every_line_belongs_to_one_split(tmp_path):
    rng, system = random.Random(7), fs.LocalFileSystem()
    for trial in range(30):
        lines = ["x" * rng.choice([0, 0, 1, 3, 10, 50]) for _ in range(rng.randrange(40))]
        path = str(tmp_path / f"f{trial}")
        data = "".join(line + "\n" for line in lines) + "tail" * rng.randrange(2)
        with open(path, "w", encoding="utf-8") as f:
            f.write(data)
        end = end_of_lines(system, path, len(data))
        assert end == data.rfind("\n") + 1
        for size in (1, 2, 7, 64, 10_000):
            found = [
                pair for split in splits_between({}, {path: end}, size)
                for positions, texts in lines_of(system, split) for pair in zip(positions, texts)
            ]
            assert [t for _, t in found] == lines
            assert all(data[p : p + len(t) + 1] == t + "\n" for p, t in found)


def test_blocks_shorter_than_a_line(tmp_path, monkeypatch):
    monkeypatch.setattr("tabscope.streaming.appended.BLOCK_BYTES", 5)
    monkeypatch.setattr("tabscope.streaming.appended.TAIL_BYTES", 4)
    path, system = str(tmp_path / "f"), fs.LocalFileSystem()
    data = b"\xef\xbb\xbfone\nlonger than a block\n\xff\nrest"
    with open(path, "wb") as f:
        f.write(data)
    end = end_of_lines(system, path, len(data))
    assert end == len(data) - 4
    read = [t for _, texts in lines_of(system, Split(path, 0, end, end, True)) for t in texts]
    assert read == ["one", "longer than a block", "�"]


def test_only_grown_stretches_are_read():
    splits = splits_between({"a": 100, "b": 50, "gone": 7}, {"a": 100, "b": 80, "c": 10}, 20)
    assert [(s.path, s.start, s.stop) for s in splits] == [("b", 50, 70), ("b", 70, 80), ("c", 0, 10)]
