"""Stream newly arriving log files into an archive layout.

``readStream.text`` -> blank lines dropped -> layout columns (a per-row
projection, so no state) -> ``writeStream`` Parquet with a checkpoint, so a
restarted or failed job resumes exactly where it stopped. Micro-batches are
bounded by ``max_files_per_trigger`` (the reference's fixed bulk sizes).
The inferred-struct layout needs a whole-input schema and is batch only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logvault.layouts import get_layout
from logvault.layouts.base import Layout
from logvault.sources.lines import drop_blank

STREAMABLE = ("json_string", "pairwise", "static_dynamic", "variant", "document")


def line_stream(spark: SparkSession, src: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return drop_blank(r.load(src).select(F.col("value").alias("line")), "empty")


def ingest_stream(spark: SparkSession, src: str, dst: str, layout: Layout | str, checkpoint: str,
                  max_files_per_trigger: int | None = None, available_now: bool = True,
                  processing_time: str | None = None) -> StreamingQuery:
    """Start the ingest stream; ``available_now`` drains what is there and stops."""
    lay = get_layout(layout) if isinstance(layout, str) else layout
    if lay.name not in STREAMABLE:
        raise ValueError(f"layout {lay.name} is batch only (needs the whole input for its schema)")
    out = lay.build(line_stream(spark, src, max_files_per_trigger))
    w = (out.writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint)
         .option("compression", "zstd").outputMode("append"))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def run_to_completion(q: StreamingQuery, timeout_s: int | None = None) -> None:
    """Wait for an availableNow stream, as long as it takes unless ``timeout_s``
    is given; raise its error if it failed."""
    q.awaitTermination(timeout_s)
    if q.isActive:
        q.stop()
        raise TimeoutError("stream did not finish in time")
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
