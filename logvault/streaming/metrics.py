"""T03 on a stream: resource samples aligned to a polling grid, per run.

Event-time tumbling windows with a watermark: a window is emitted once the
watermark passes its end (append mode), and its state is then dropped, so
state stays bounded however long the stream runs.

``grid_stream`` stores every change of a window instead (update mode), so a
drained stream has the totals of its open windows too, and a later run goes on
from them; ``read_grid`` takes the newest total of each window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logvault.operators.runs import parse_ps, related_samples
from logvault.sinks.versions import commit_part, live_parts, parts_path

EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def ntz_to_instant(c):
    """Local time -> instant with the same wall clock in UTC (zone-free)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr(EPOCH_NTZ), c))


def instant_to_ntz(c):
    """Inverse of ``ntz_to_instant``."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.expr(EPOCH_NTZ))


def stream_sample_total(samples: DataFrame, related: DataFrame, interval: str, lateness: str,
                        tool: str | None = None, ts: str = "ts") -> DataFrame:
    """Streaming A06: ``(run_id, sample_ts, total_rss_bytes)`` per grid slot.

    Watermarks need TIMESTAMP; a TIMESTAMP_NTZ time column is mapped to the
    instant with the same UTC wall clock and back, so slots do not depend on
    the session time zone."""
    ntz = isinstance(samples.schema[ts].dataType, T.TimestampNTZType)
    s = related_samples(parse_ps(samples), related, tool)
    if ntz:
        s = s.withColumn(ts, ntz_to_instant(F.col(ts)))
    start = instant_to_ntz(F.col("w.start")) if ntz else F.col("w.start")
    return (s.withWatermark(ts, lateness)
            .groupBy("run_id", F.window(F.col(ts), interval).alias("w"))
            .agg(F.sum("rss_bytes").alias("total_rss_bytes"))
            .select("run_id", start.alias("sample_ts"), "total_rss_bytes"))


def grid_stream(samples: DataFrame, related: DataFrame, dst: str, checkpoint: str, interval: str, lateness: str,
                tool: str | None = None, ts: str = "ts") -> StreamingQuery:
    """Drain ``samples`` into the grid ``dst``: each micro-batch stores the windows
    it changed as one part, exactly once (a repeated batch has the same part name).
    One stream writes a grid."""
    def take(batch: DataFrame, batch_id: int) -> None:
        s, part = batch.sparkSession, f"{batch_id:010d}"
        if any(p["part"] == part for p in live_parts(s, dst)):
            return
        batch.withColumn("batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{dst}/parts/{part}")
        commit_part(s, dst, part)

    totals = stream_sample_total(samples, related, interval, lateness, tool, ts)
    return (totals.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_grid(spark: SparkSession, dst: str) -> DataFrame:
    """``(run_id, sample_ts, total_rss_bytes)`` of all windows, closed or open."""
    parts = [p["part"] for p in live_parts(spark, dst)]
    if not parts:
        raise ValueError(f"no grid in {dst}")
    return (spark.read.parquet(parts_path(dst, parts)).groupBy("run_id", "sample_ts")
            .agg(F.max_by("total_rss_bytes", "batch").alias("total_rss_bytes")))
