from __future__ import annotations

import json

import pytest

from tabscope import profile_frame, scratch_path
from tabscope.operators.logs import artifacts_of_type, events_by_type, last_sql_result, repeated_failures, tool_summary
from tabscope.sources.delimited import read_profile_csv, read_sql_csv, sniff_delimiter
from tabscope.sources.files import list_files
from tabscope.sources.logs import messages, read_artifacts, read_assumptions, read_events, read_sessions, tool_results
from tabscope.sources.notebooks import read_notebooks
from tabscope.sources.store import list_profiled, load_profile, save_profile
from tabscope.streaming.event_log import follow_events


def test_profile_csv_types(spark, tmp_path):
    file = tmp_path / "t.csv"
    file.write_text(
        "i,f,b,s,e,m,inf\n1,1.5,True,x,,NA,inf\nNA,2,False,\"a, \"\"b\"\"\",,1,-inf\n-3,1e3,TRUE,null,,2,1\n", encoding="utf-8"
    )
    df = read_profile_csv(spark, str(file))
    assert df.dtypes == [
        ("i", "bigint"), ("f", "double"), ("b", "boolean"), ("s", "string"), ("e", "double"), ("m", "bigint"), ("inf", "double"),
    ]
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, "x", None, None, float("inf")),
        (None, 2.0, False, 'a, "b"', None, 1, float("-inf")),
        (-3, 1000.0, True, None, None, 2, 1.0),
    ]


def test_integers_beyond_long_keep_their_digits(spark, tmp_path):
    file = tmp_path / "big.csv"
    file.write_text("n,m\n1,1\n99999999999999999999," + "9" * 40 + "\n", encoding="utf-8")
    assert read_profile_csv(spark, str(file)).dtypes == [("n", "decimal(38,0)"), ("m", "string")]


@pytest.mark.parametrize("read", [read_profile_csv, read_sql_csv])
def test_csv_that_would_be_read_wrongly(spark, tmp_path, read):
    file = tmp_path / "f.csv"
    file.write_text('id,t\n1,"two\nlines"\n2,x\n', encoding="utf-8")
    assert [tuple(r) for r in read(spark, str(file)).collect()] == [(1, "two\nlines"), (2, "x")]
    wide, empty, parts = tmp_path / "w.csv", tmp_path / "e.csv", tmp_path / "p.csv"
    wide.write_text("a,b\n3,4,5\n", encoding="utf-8")
    with pytest.raises(ValueError, match="more fields"):
        read(spark, str(wide))
    assert [tuple(r) for r in read(spark, str(wide), bad_rows="cut").collect()] == [(3, 4)]
    empty.write_text("", encoding="utf-8")
    with pytest.raises(ValueError, match="No header"):
        read(spark, str(empty))
    parts.mkdir()
    (parts / "1.csv").write_text("a,b\n1,2\n", encoding="utf-8")
    (parts / "2.csv").write_text("b,a\n1,2\n", encoding="utf-8")
    with pytest.raises(Exception):
        read(spark, str(parts)).collect()


def test_missing_root_and_store(spark, tmp_path):
    assert list_files(spark, str(tmp_path / "none")).count() == 0
    assert load_profile(spark, "x.csv", str(tmp_path / "none")) is None
    assert list_profiled(spark, str(tmp_path / "none")).count() == 0


def test_multiline_csv(spark, tmp_path):
    file = tmp_path / "m.csv"
    file.write_text('a,b\n1,"x\ny"\n2,z\n', encoding="utf-8")
    assert [tuple(r) for r in read_profile_csv(spark, str(file), multiline=True).collect()] == [(1, "x\ny"), (2, "z")]


@pytest.mark.parametrize("sep", [",", "|", ";", "\t"])
def test_delimiters(spark, tmp_path, sep):
    file = tmp_path / "d.csv"
    file.write_text(f"a{sep}b\n1{sep}2024-01-02\n", encoding="utf-8")
    assert sniff_delimiter(spark, str(file)) == sep
    assert read_sql_csv(spark, str(file)).dtypes == [("a", "int"), ("b", "date")]


def test_notebooks(spark, tmp_path):
    notebook = {
        "cells": [
            {"cell_type": "markdown", "source": "# [title]"},
            {
                "cell_type": "code",
                "source": ["a = 1\n", "b" * 600],
                "execution_count": 3,
                "outputs": [
                    {"output_type": "stream", "text": ["x\n", "y"]},
                    {"output_type": "error", "ename": "E"},
                    {"output_type": "display_data", "data": {"image/png": "AAA"}},
                    {"output_type": "execute_result", "data": {"text/plain": ["1"], "text/html": ["<b>"]}},
                    {"output_type": "stream", "text": "plain"},
                    {"output_type": "stream", "text": "fourth"},
                ],
            },
        ]
    }
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "n.ipynb").write_text(json.dumps(notebook), encoding="utf-8")
    (tmp_path / "other.json").write_text("{}", encoding="utf-8")
    first, second = read_notebooks(spark, str(tmp_path)).orderBy("cell_index").collect()
    assert (first["cell_type"], first["source"], first["outputs"], first["execution_count"]) == ("markdown", "# [title]", [], None)
    assert second["source"] == ("a = 1\n" + "b" * 600)[:500] and second["execution_count"] == 3
    assert [tuple(o) for o in second["outputs"]] == [("stream", "x\ny"), ("text", "1"), ("stream", "plain")]


def test_logs(spark, tmp_path):
    events = [
        {"id": "e1", "event_type": "a", "timestamp": "2024-01-01T00:00:00Z", "inputs": {"p": 1}, "outputs": {}, "artifact_paths": ["x"]},
        {"id": "e2", "event_type": "a", "timestamp": "2024-01-02T00:00:00Z"},
        {"id": "e3", "event_type": "b", "timestamp": "2024-01-03T00:00:00Z"},
    ]
    (tmp_path / "events.jsonl").write_text("\n".join(map(json.dumps, events)) + "\n\n", encoding="utf-8")
    counts = {r["event_type"]: r["n_events"] for r in events_by_type(read_events(spark, str(tmp_path / "events.jsonl"))).collect()}
    assert counts == {"a": 2, "b": 1}
    artifacts = [{"id": "1", "path": "/c.png", "artifact_type": "chart", "metadata": {"k": [1]}}, {"id": "2", "path": "/r", "artifact_type": "report"}]
    (tmp_path / "artifacts.json").write_text(json.dumps(artifacts, indent=2), encoding="utf-8")
    table = read_artifacts(spark, str(tmp_path / "artifacts.json"))
    assert table.count() == 2 and [r["id"] for r in artifacts_of_type(table, "chart").collect()] == ["1"]
    assert artifacts_of_type(table).count() == 2
    (tmp_path / "assumptions.jsonl").write_text('{"id":"a","text":"t","confidence":"high"}\n', encoding="utf-8")
    assert read_assumptions(spark, str(tmp_path / "assumptions.jsonl")).first()["confidence"] == "high"


def test_sessions(spark, tmp_path):
    ok = {"query": "SELECT 1", "preview_rows": [{"n": i} for i in range(8)], "artifact_path": "q.sql", "error": None}
    bad = {"query": "SELEC", "error": "syntax"}
    session = {
        "messages": [{"role": "user", "content": "hi"}, {"role": "tool", "content": "{}", "name": "run_sql"}],
        "tool_results": [
            {"tool_name": "run_sql", "success": True, "result": ok},
            {"tool_name": "run_sql", "success": False, "result": bad, "error": "syntax"},
            {"tool_name": "run_sql", "success": False, "result": bad, "error": "syntax"},
            {"tool_name": "run_sql", "success": True, "result": {**ok, "query": "SELECT 2"}},
            {"tool_name": "save_report", "success": True, "result": {"path": "r.md"}},
            {"tool_name": "inspect", "success": True, "result": '{"cut": "... [truncated]'},
        ],
        "final_content": "done",
    }
    (tmp_path / "s1.json").write_text(json.dumps(session, indent=2), encoding="utf-8")
    (tmp_path / "s2.json").write_text(json.dumps({"messages": [], "tool_results": []}), encoding="utf-8")
    sessions = read_sessions(spark, str(tmp_path))
    assert {r["session_id"] for r in sessions.collect()} == {"s1", "s2"}
    assert messages(sessions).count() == 2
    results = tool_results(sessions)
    last = last_sql_result(results).collect()
    assert len(last) == 1 and last[0]["query"] == "SELECT 2" and last[0]["seq"] == 3
    assert [json.loads(r) for r in last[0]["preview_rows"]] == ok["preview_rows"][:5]
    assert [tuple(r) for r in repeated_failures(results).collect()] == [("s1", "run_sql", "SELEC", "syntax", 2)]
    rows = [(r["status"], r["artifact"], r["error"]) for r in tool_summary(results).orderBy("seq").collect()]
    assert rows == [
        ("success", "q.sql", None), ("failed", None, "syntax"), ("failed", None, "syntax"),
        ("success", "q.sql", None), ("success", "r.md", None), ("success", None, None),
    ]


def test_store_replaces_one_dataset_only(spark):
    root = scratch_path(spark, "store")
    one = spark.createDataFrame([(1,)], "a bigint")
    for path, df in (("/x/a.csv", one), ("/y/a.csv", one), ("/x/a.csv", one.unionAll(one))):
        save_profile(profile_frame(df, path=path, file_type="csv"), root)
    assert load_profile(spark, "/x/a.csv", root).first()["row_count"] == 2
    assert load_profile(spark, "/y/a.csv", root).first()["row_count"] == 1
    assert load_profile(spark, "/z/a.csv", root).count() == 0
    assert {r["path"] for r in list_profiled(spark, root).collect()} == {"/x/a.csv", "/y/a.csv"}


def test_event_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    for i in range(3):
        (log / f"{i}.jsonl").write_text(json.dumps({"id": f"e{i}", "event_type": "t"}) + "\n", encoding="utf-8")
    counts = follow_events(spark, str(log)).groupBy("event_type").count()
    query = (
        counts.writeStream.outputMode("complete").format("memory").queryName("event_counts")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(60)
    assert [tuple(r) for r in spark.table("event_counts").collect()] == [("t", 3)]
