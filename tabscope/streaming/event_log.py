"""An event log of complete files, followed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscope.sources.logs import EVENT_SCHEMA


def follow_events(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """A streaming DataFrame of the event records in new files below ``path``.

    Each file is read once, so writers add complete files; a line appended to a file
    that has been read does not arrive; ``follow_appended_events`` reads such logs.
    ``read_events`` reads a log whole.
    """
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)
