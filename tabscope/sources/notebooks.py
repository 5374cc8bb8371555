"""Notebook files as a table of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_CHARS = 500
OUTPUTS_PER_CELL = 3

# ``source`` and ``text`` may be a text or a list of texts, so they stay raw JSON.
NOTEBOOK_SCHEMA = (
    "cells array<struct<cell_type: string, source: string, execution_count: bigint,"
    " outputs: array<struct<output_type: string, text: string, data: map<string, string>>>>>"
)


def _joined(raw: Column) -> Column:
    """A JSON list of texts joined, or the text itself."""
    return F.when(raw.startswith("["), F.coalesce(F.array_join(F.from_json(raw, "array<string>"), ""), raw)).otherwise(raw)


def _output(out: Column) -> Column:
    stream = out["output_type"] == "stream"
    plain = F.try_element_at(out["data"], F.lit("text/plain"))
    return F.struct(
        F.when(stream, F.lit("stream")).otherwise(F.lit("text")).alias("type"),
        F.when(stream, F.coalesce(_joined(out["text"]), F.lit(""))).otherwise(_joined(plain)).alias("text"),
    )


def _shown(out: Column) -> Column:
    plain = F.try_element_at(out["data"], F.lit("text/plain"))
    rich = out["output_type"].isin("execute_result", "display_data") & plain.isNotNull()
    return F.coalesce((out["output_type"] == "stream") | rich, F.lit(False))


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """One row per cell of ``path, content``: type, first 500 source characters, first 3 outputs."""
    cells = notebooks.select(
        "path", F.posexplode(F.from_json("content", NOTEBOOK_SCHEMA)["cells"]).alias("cell_index", "cell")
    )
    outputs = F.coalesce(F.col("cell.outputs"), F.array().cast("array<struct<output_type:string,text:string,data:map<string,string>>>"))
    return cells.select(
        "path",
        "cell_index",
        F.coalesce("cell.cell_type", F.lit("")).alias("cell_type"),
        F.left(F.coalesce(_joined(F.col("cell.source")), F.lit("")), F.lit(SOURCE_CHARS)).alias("source"),
        F.slice(F.transform(F.filter(outputs, _shown), _output), 1, OUTPUTS_PER_CELL).alias("outputs"),
        F.col("cell.execution_count").alias("execution_count"),
    )


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every notebook below ``path``; each file is one JSON document."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.ipynb").text(path, wholetext=True)
    return notebook_cells(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))
