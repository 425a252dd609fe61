"""The record passes over streams. They are row-local, so a stream needs no state: each micro-batch is the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import enhance, records, validation


def validated_stream(raw: DataFrame) -> DataFrame:
    """A stream of raw records as validated records."""
    return validation.validate_records(enhance.second_pass(records.first_pass(raw)))


def start(raw: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write validated records to Parquet; ``trigger`` as for ``DataStreamWriter.trigger``."""
    out = validated_stream(raw).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()
