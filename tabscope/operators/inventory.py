"""File inventory: kinds by extension, ignore patterns and a compact summary."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabscope.session import small_frame

# Extension -> kind of file.
KIND_OF_EXTENSION = {
    ".csv": "datasets",
    ".xlsx": "datasets",
    ".xls": "datasets",
    ".parquet": "datasets",
    ".ipynb": "notebooks",
    ".sql": "sql_files",
    ".py": "python_files",
    ".md": "markdown_files",
}
KINDS = ["datasets", "notebooks", "sql_files", "python_files", "markdown_files", "artifacts"]
HIDDEN_PARTS = [".git", "__pycache__"]
WILD = re.compile(r"[*?\[]")
ENDING = re.compile(r"\*\.[^*?\[/.]+")
REGEXES_AT_ONCE = 200


def file_kind(rel_path: Column, artifacts_prefix: str | None = None) -> Column:
    """Kind by extension; other files below ``artifacts_prefix`` are artifacts, else null."""
    extension = F.lower(F.regexp_extract(rel_path, r"[^/](\.[^./]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for pair in KIND_OF_EXTENSION.items() for x in pair])
    kind = F.try_element_at(kinds, extension)
    if artifacts_prefix:
        below = rel_path.startswith(artifacts_prefix.rstrip("/") + "/")
        kind = F.coalesce(F.when(~(below & (kind == "markdown_files")), kind), F.when(below, F.lit("artifacts")))
    return kind


def read_patterns(spark: SparkSession, path: str) -> list[str]:
    """Ignore patterns of a file; blank lines and ``#`` lines are left out."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("p")).where((F.col("p") != "") & ~F.col("p").startswith("#"))
    return [r["p"] for r in rows.collect()]


def _glob_regex(glob: str, within_part: bool) -> str:
    """Shell wildcards as a regular expression; ``*`` crosses ``/`` unless ``within_part``."""
    anything, one = ("[^/]*", "[^/]") if within_part else (".*", ".")
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += anything
        elif c == "?":
            out += one
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            body = "^" + body[1:] if body.startswith("!") else (r"\^" + body[1:] if body.startswith("^") else body)
            out += ("(?!/)" if within_part else "") + f"[{body}]"
            i = close
        else:
            out += re.escape(c) if not c.isalnum() else c
        i += 1
    return out


def pattern_regex(pattern: str) -> str | None:
    """One regular expression for an ignore pattern without its leading ``!``.

    A leading ``/`` anchors at the root. Otherwise the pattern fits a whole path
    part, or the path from some part on to its end.
    """
    glob = pattern.strip()
    anchored = glob.startswith("/")
    glob = (glob[1:] if anchored else glob).rstrip("/")
    if not glob:
        return None
    if anchored:
        return f"(?s)^{_glob_regex(glob, False)}(/.*)?$"
    tail = f"{_glob_regex(glob, False)}$"
    part = "" if "/" in glob else f"{_glob_regex(glob, True)}(/|$)|"
    return f"(?s)(^|/)({part}{tail})"


class _Run(NamedTuple):
    """Neighbouring patterns of one sign, by the way they are looked up."""

    keep: bool
    parts: set[str]  # whole parts of the path
    heads: set[str]  # the path down to some part
    tails: set[str]  # the path from some part on
    endings: set[str]  # what follows the last dot of a part, with the dot
    regexes: list[str]

    def add(self, pattern: str) -> None:
        glob = pattern.strip()
        anchored = glob.startswith("/")
        glob = (glob[1:] if anchored else glob).rstrip("/")
        if not glob:
            return
        if not WILD.search(glob):
            (self.heads if anchored else self.tails if "/" in glob else self.parts).add(glob)
        elif not anchored and ENDING.fullmatch(glob):
            self.endings.add(glob[1:])
        else:
            self.regexes.append(pattern_regex(pattern))

    def fits(self, path: Column) -> Column:
        parts = F.split(path, "/")
        places = F.sequence(F.lit(1), F.size(parts))
        found = F.lit(False)
        if self.parts:
            found |= F.exists(parts, lambda p: p.isin(sorted(self.parts)))
        if self.heads:
            heads = F.transform(places, lambda i: F.array_join(F.slice(parts, 1, i), "/"))
            found |= F.exists(heads, lambda p: p.isin(sorted(self.heads)))
        if self.tails:
            tails = F.transform(places, lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
            found |= F.exists(tails, lambda p: p.isin(sorted(self.tails)))
        if self.endings:
            endings = F.transform(parts, lambda p: F.concat(F.lit("."), F.substring_index(p, ".", -1)))
            dotted = F.zip_with(parts, endings, lambda p, e: F.when(p.contains("."), e))
            found |= F.exists(dotted, lambda e: F.coalesce(e.isin(sorted(self.endings)), F.lit(False)))
        for start in range(0, len(self.regexes), REGEXES_AT_ONCE):
            found |= path.rlike("|".join(f"(?:{r})" for r in self.regexes[start : start + REGEXES_AT_ONCE]))
        return found


def is_ignored(rel_path: Column, patterns: list[str]) -> Column:
    """Whether a path is ignored: the last pattern that fits decides, ``!`` keeps.

    Only where the sign changes from one pattern to the next is a decision of its own.
    Patterns without wildcards, and those for an extension, are looked up in hash sets, so
    thousands of them cost a path no more than a few; the others are tested together.
    """
    runs: list[_Run] = []
    for pattern in patterns:
        keep = pattern.startswith("!")
        if not runs or runs[-1].keep != keep:
            runs.append(_Run(keep, set(), set(), set(), set(), []))
        runs[-1].add(pattern[1:] if keep else pattern)
    verdict = F.lit(False)
    for run in runs:
        verdict = F.when(run.fits(rel_path), F.lit(not run.keep)).otherwise(verdict)
    return verdict


def is_hidden(rel_path: Column, parts: list[str] | None = None) -> Column:
    names = "|".join(re.escape(p) for p in (parts or HIDDEN_PARTS))
    return rel_path.rlike(f"(^|/)({names})(/|$)")


def classify_files(files: DataFrame, patterns: list[str] | None = None, artifacts_prefix: str | None = None) -> DataFrame:
    """Add ``kind`` to a file list with ``rel_path``; drop ignored and unclassified files."""
    path = F.col("rel_path")
    ignored = is_ignored(path, patterns or [])
    if artifacts_prefix:
        ignored = ignored & ~path.startswith(artifacts_prefix.rstrip("/") + "/")
    return (
        files.where(~is_hidden(path) & ~ignored)
        .withColumn("kind", file_kind(path, artifacts_prefix))
        .where(F.col("kind").isNotNull())
    )


def summarize_files(classified: DataFrame, samples: int = 5) -> DataFrame:
    """``kind, n_files, sample_paths`` for every kind, also those without files.

    Counts and samples are separate: the samples are cut to a few paths per kind
    in each task, so no list of all paths of a kind is ever built.
    """
    counts = classified.groupBy("kind").agg(F.count("*").alias("n_files"))
    first = (
        classified.select("kind", "rel_path")
        .withColumn("n", F.row_number().over(W.partitionBy("kind").orderBy("rel_path")))
        .where(F.col("n") <= samples)
        .groupBy("kind")
        .agg(F.sort_array(F.collect_list("rel_path")).alias("sample_paths"))
    )
    kinds = small_frame(classified.sparkSession, [(k,) for k in KINDS], "kind string")
    return (
        kinds.join(counts, "kind", "left")
        .join(first, "kind", "left")
        .select(
            "kind",
            F.coalesce("n_files", F.lit(0)).alias("n_files"),
            F.coalesce("sample_paths", F.array().cast("array<string>")).alias("sample_paths"),
        )
    )
