from __future__ import annotations

import random
import re
import time

import fnmatch
import itertools

from pyspark.sql import functions as F

from tabscope.operators.inventory import classify_files, is_ignored, read_patterns, summarize_files, pattern_regex
from tabscope.sources.files import dataset_size, list_files


def tree(root, *paths: str) -> str:
    for p in paths:
        file = root / p
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text("x", encoding="utf-8")
    return str(root)


def kinds(df) -> dict:
    return {r["rel_path"]: r["kind"] for r in df.collect()}


def test_directory_pattern(spark, tmp_path):
    root = tree(tmp_path, "agents/codex/migration.sql", "examples/sales.csv")
    assert kinds(classify_files(list_files(spark, root), ["agents/"])) == {"examples/sales.csv": "datasets"}
    assert kinds(classify_files(list_files(spark, root)))["agents/codex/migration.sql"] == "sql_files"


def test_summary(spark, tmp_path):
    root = tree(tmp_path, "sales.csv", *[f"agents/file_{i:03d}.sql" for i in range(60)])
    files = list_files(spark, root)
    hidden = {r["kind"]: r for r in summarize_files(classify_files(files, ["agents/"])).collect()}
    assert hidden["datasets"]["n_files"] == 1 and hidden["sql_files"]["n_files"] == 0
    assert hidden["artifacts"]["sample_paths"] == []
    shown = {r["kind"]: r for r in summarize_files(classify_files(files)).collect()}
    assert shown["sql_files"]["n_files"] == 60
    assert shown["sql_files"]["sample_paths"] == [f"agents/file_{i:03d}.sql" for i in range(5)]


def test_wildcard_and_kinds(spark, tmp_path):
    root = tree(tmp_path, "notes.md", "data.CSV", "b.ipynb", "c.py", "d.xlsx", "e.txt", "__pycache__/c.py", "noext")
    assert kinds(classify_files(list_files(spark, root), ["*.md"])) == {
        "data.CSV": "datasets", "b.ipynb": "notebooks", "c.py": "python_files", "d.xlsx": "datasets",
    }


def test_artifacts(spark):
    paths = ["out/artifacts/q.sql", "out/artifacts/chart.png", "out/artifacts/report.md", "chart.png"]
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    got = kinds(classify_files(df, ["out/"], artifacts_prefix="out/artifacts"))
    assert got == {paths[0]: "sql_files", paths[1]: "artifacts", paths[2]: "artifacts"}


def test_patterns_file(spark, tmp_path):
    (tmp_path / "ignore").write_text("# comment\n\n  *.log \n/data/raw/\n", encoding="utf-8")
    assert read_patterns(spark, str(tmp_path / "ignore")) == ["*.log", "/data/raw/"]


def test_size(spark, tmp_path):
    path = tree(tmp_path, "a/b.csv", "a/c/d.csv")
    row = dataset_size(spark, path).first()
    assert (row["file_count"], row["file_size_bytes"]) == (2, 2)


def fits(pattern: str, path: str) -> bool:
    """The meaning of one pattern, spelled out over the path's parts and tails."""
    glob = pattern.lstrip("/").rstrip("/")
    if pattern.startswith("/"):
        return fnmatch.fnmatchcase(path, glob) or fnmatch.fnmatchcase(path, glob + "/*")
    parts = path.split("/")
    tails = ["/".join(parts[i:]) for i in range(len(parts))]
    return any(fnmatch.fnmatchcase(x, glob) for x in parts + tails)


def test_patterns_match_definition(spark):
    names = ["a", "ab", "a.b", "[x]", "a-b", "A"]
    paths = names + ["/".join(p) for p in itertools.product(names[:4], repeat=2)] + ["a/ab/a.b", "ab/a/[x]"]
    patterns = ["a", "a/", "/a", "/a/", "*", "a*", "*b", "?b", "a/*", "*/a", "a/ab", "[ab]", "[!a]", "[a-b]?", "a.b", "[x]", "a**b", "/a*/", "[", "a[!b]b"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = df.select("p", *[is_ignored(F.col("p"), [g]).alias(f"g{i}") for i, g in enumerate(patterns)]).collect()
    for row in got:
        for i, g in enumerate(patterns):
            assert row[f"g{i}"] == fits(g, row["p"]), (g, row["p"])


def test_last_pattern_wins(spark):
    df = spark.createDataFrame([("agents/other.sql",), ("agents/keep.sql",)], "p string")
    rows = df.select(is_ignored(F.col("p"), ["agents/", "!agents/keep.sql"])).collect()
    assert [r[0] for r in rows] == [True, False]


def one_by_one(path: str, patterns: list[str]) -> bool:
    """The rule itself: each pattern's expression in turn, the last that fits decides."""
    ignored = False
    for p in patterns:
        regex = pattern_regex(p.removeprefix("!"))
        if regex and re.search(regex.replace("(?s)", ""), path, re.DOTALL):
            ignored = not p.startswith("!")
    return ignored


def test_many_patterns_follow_the_rule(spark):
    rng = random.Random(2)
    words = ["a", "b", "c1", "d.py", "e.tar.gz", "f", "g.sql", ".h"]
    paths = ["/".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(400)]

    def pattern():
        body = "/".join(rng.choices([*words, "*", "c?", "*.py", "*.gz", "[ab]", "d*", "*.tar.gz", ".*"], k=rng.choice([1, 1, 2, 3])))
        return rng.choice(["", "", "!"]) + rng.choice(["", "/"]) + body + rng.choice(["", "/"])

    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for many in (1, 3, 12, 60):
        patterns = [pattern() for _ in range(many)]
        got = {r.p: r.i for r in df.select("p", is_ignored(F.col("p"), patterns).alias("i")).collect()}
        assert got == {p: one_by_one(p, patterns) for p in paths}, patterns


def test_thousands_of_patterns_plan_in_seconds(spark):
    patterns = [f"dir{i}/" for i in range(2_000)] + [f"/top{i}/x" for i in range(1_500)] + [f"*.ext{i}" for i in range(1_000)]
    patterns += ["!keep.ext5", *[f"file-{i}-*.log" for i in range(499)], "!dir7/deep/keep.txt"]
    paths = {
        "a/dir1999/b": True, "top3/x/y": True, "a/top3/x": False, "n.ext999": True, "keep.ext5": False, "file-7-1.log": True,
        "dir7/deep/keep.txt": False, "dir7/deep/other.txt": True, "plain.txt": False,
    }
    began = time.monotonic()
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.i for r in df.select("p", is_ignored(F.col("p"), patterns).alias("i")).collect()}
    assert got == paths and time.monotonic() - began < 15
