"""References as they arrive: the batch plan's parsing over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refloom.functions.refs import parse_reference


def parsed_stream(lines: DataFrame, text: str = "text", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """A stream with parsed; a text that comes again while the watermark still covers it is dropped. State is bounded by late."""
    parsed = lines.withColumn("parsed", parse_reference(text)).where("parsed is not null")
    return parsed.withColumn("digest", F.sha2(text, 256)).withWatermark(at, late).dropDuplicatesWithinWatermark(["digest"])


def write_stream(parsed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet files, exactly once, until what is there now has been read."""
    return parsed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
