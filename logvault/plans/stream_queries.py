"""Registered queries for streams (T02, T03, S06) and versioned archives."""

from __future__ import annotations

from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logvault.layouts import get_layout
from logvault.operators.search import count_hits_many
from logvault.plans import oracle
from logvault.plans.queries import EVENT_ID, FORMS_OF_LAYOUT
from logvault.plans.standard import FIXTURE, searches
from logvault.session import configure, scratch_path
from logvault.sinks.versions import read_version, write_version
from logvault.sinks.writers import write_raw
from logvault.sources.archive import read_archive
from logvault.sources.fixtures import event_log_lines
from logvault.sources.fixtures import ps_samples, related_processes
from logvault.streaming.archive import archive_stream, read_rejected, read_stream_archive
from logvault.streaming.ingest import ingest_stream, run_to_completion
from logvault.streaming.metrics import grid_stream, read_grid

LAYOUTS = ("variant", "pairwise", "document")


def q_stream_ingest(spark: SparkSession, sf_dir: str, layout_name: str):
    """Log files arrive in a folder, a stream archives them, searches count."""
    configure(spark)
    src = scratch_path(spark, "stream-src")
    write_raw(event_log_lines(spark, sf_dir), src, "none")
    dst, ckpt = scratch_path(spark, f"stream-{layout_name}"), scratch_path(spark, "stream-ckpt")
    run_to_completion(ingest_stream(spark, src, dst, layout_name, ckpt, max_files_per_trigger=1))
    lay = get_layout(layout_name)
    df = read_archive(spark, dst, layout_name)
    preds = {s: searches(d, FIXTURE)[k] for s, d, k, _ in FORMS_OF_LAYOUT[layout_name]}
    return count_hits_many(df, lay, preds)


def _broken(lines):
    """Every tenth event loses its last character, so it is no JSON."""
    return lines.withColumn("line", F.when(F.get_json_object("line", "$.attr.event_id").cast("long") % 10 == 0,
                                           F.expr("left(line, length(line) - 1)")).otherwise(F.col("line")))


def _archived(spark, sf_dir, layout_name, broken=False):
    """Log files of differing shapes (a file holds the events of one type), streamed a few at a time."""
    lines = event_log_lines(spark, sf_dir).withColumn("c", F.get_json_object("line", "$.c"))
    src, dst, ckpt = (scratch_path(spark, f"stream-{n}") for n in ("drift", layout_name, "ckpt"))
    (_broken(lines) if broken else lines).write.partitionBy("c").text(src)
    run_to_completion(archive_stream(spark, f"{src}/*/*.txt", dst, layout_name, ckpt, max_files_per_trigger=2))
    return dst


def q_stream_ingest_inferred(spark: SparkSession, sf_dir: str):
    """T02 with schema evolution: each micro-batch has fields and types of its own,
    the inferred layout (merged types) reads all of them under one schema."""
    configure(spark)
    lay = get_layout("merged")
    df = read_stream_archive(spark, _archived(spark, sf_dir, "merged"), lay)
    return count_hits_many(df, lay, {s: searches(d, FIXTURE)[k] for s, d, k, _ in FORMS_OF_LAYOUT["merged"]})


def q_stream_rejected(spark: SparkSession, sf_dir: str):
    """S06 on a stream: every line is an event of the archive or set aside, once."""
    configure(spark)
    lay = get_layout("variant")
    dst = _archived(spark, sf_dir, "variant", broken=True)
    df = read_stream_archive(spark, dst, lay)
    events = df.select(lay.resolver(df).integer(EVENT_ID).alias("event_id"), F.lit("archive").alias("stored"))
    bad = read_rejected(spark, dst).select(
        F.regexp_extract("line", r'"event_id": ?(\d+)', 1).cast("bigint").alias("event_id"), F.lit("rejected").alias("stored"))
    return events.unionByName(bad)


def q_versioned_archive(spark: SparkSession, sf_dir: str):
    """S18 all or nothing: an archive written, appended to and replaced, read at
    each version and as it is now."""
    configure(spark)
    lay, path = get_layout("variant"), scratch_path(spark, "versions")
    lines = event_log_lines(spark, sf_dir)
    kind = F.get_json_object("line", "$.c")
    for mode, some in (("errorifexists", kind == "CLICK"), ("append", kind == "VIEW"), ("overwrite", kind == "ERROR")):
        write_version(lay.build(lines.filter(some)), lay, path, mode=mode)
    out = None
    for version in (1, 2, 3, None):
        df = read_version(spark, path, lay, version)
        part = (df.groupBy(lay.resolver(df).text("c").alias("c")).agg(F.count(F.lit(1)).alias("n_events"))
                .select(F.lit("newest" if version is None else str(version)).alias("version"), "c", "n_events"))
        out = part if out is None else out.unionByName(part)
    return out


GRID, LATENESS = "1 hour", "1 hour"


def q_stream_sample_total(spark: SparkSession, sf_dir: str):
    """T03 on a stream: sample files arrive, related samples (J01, stream-static
    semi join) are totalled per run and hourly slot with a watermark; windows
    still open when the stream is drained are part of the grid."""
    configure(spark)
    src = scratch_path(spark, "samples-src")
    ps_samples(spark, sf_dir).write.parquet(src)
    dst, ckpt = scratch_path(spark, "samples-grid"), scratch_path(spark, "samples-ckpt")
    # The sample files each span the whole period, so they are taken in one
    # micro-batch: with several, rows older than the advanced watermark would
    # be dropped as late (correct stream semantics, but order-dependent).
    stream = spark.readStream.schema("run_id bigint, ts timestamp_ntz, ps_line string").parquet(src)
    run_to_completion(grid_stream(stream, related_processes(spark), dst, ckpt, GRID, LATENESS, tool="sparksql"))
    return read_grid(spark, dst)


QUERIES = {f"stream_ingest_{n}": partial(q_stream_ingest, layout_name=n) for n in LAYOUTS}
QUERIES.update(stream_sample_total=q_stream_sample_total, stream_ingest_inferred=q_stream_ingest_inferred,
               stream_rejected=q_stream_rejected, versioned_archive=q_versioned_archive)


def oracles() -> dict:
    from logvault.plans import run_oracle
    out = {f"stream_ingest_{n}": oracle.search_counts({s: o for s, _, _, o in FORMS_OF_LAYOUT[n]})
           for n in LAYOUTS}
    out["stream_sample_total"] = run_oracle.SAMPLES + "SELECT run_id, sample_ts, total_rss_bytes FROM tot"
    out["stream_ingest_inferred"] = oracle.search_counts({s: o for s, _, _, o in FORMS_OF_LAYOUT["merged"]})
    out["stream_rejected"] = ("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'rejected' ELSE 'archive' END AS stored "
                              "FROM events")
    out["versioned_archive"] = """
SELECT version, upper(event_type) AS c, count(*) AS n_events FROM events JOIN (VALUES
  ('1', 'click'), ('2', 'click'), ('2', 'view'), ('3', 'error'), ('newest', 'error')) v(version, kind) ON event_type = kind
GROUP BY version, event_type"""
    return out
