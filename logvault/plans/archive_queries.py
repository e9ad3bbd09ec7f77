"""Registered queries for archive writers, readers and quality checks.

Each query writes its archive to a fresh folder under the shared checkpoint
folder (``spark.checkpoint.dir``), reads it back and checks it.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logvault.layouts import LAYOUTS, get_layout
from logvault.layouts.base import hot_name
from logvault.operators.quality import (
    archive_size, compression_ratio, line_count_check, roundtrip_report,
)
from logvault.operators.search import count_hits_many, search
from logvault.operators.sequence import roundtrip_ordered
from logvault.plans import oracle
from logvault.plans.queries import EVENT_ID, FORMS_OF_LAYOUT
from logvault.plans.standard import FIXTURE, TS_SEC, searches
from logvault.session import configure, scratch_path
from logvault.sinks.writers import ingest, restore, write_ordered, write_raw
from logvault.sources.archive import read_archive
from logvault.sources.catalog import catalog_frame
from logvault.sources.fixtures import event_log_lines
from logvault.sources.lines import read_lines


def q_archive_roundtrip(spark: SparkSession, sf_dir: str, layout_name: str):
    """Ingest into a layout archive, read it back, count every search form."""
    configure(spark)
    lay = get_layout(layout_name)
    path = scratch_path(spark, f"archive-{layout_name}")
    ingest(event_log_lines(spark, sf_dir), lay, path)
    df = read_archive(spark, path, layout_name)
    preds = {s: searches(d, FIXTURE)[k] for s, d, k, _ in FORMS_OF_LAYOUT[layout_name]}
    return count_hits_many(df, lay, preds)


def q_roundtrip_gzip(spark, sf_dir):
    """S16 + S17 + R09: gzip text archive restored equals the original lines."""
    configure(spark)
    lines = event_log_lines(spark, sf_dir)
    path = scratch_path(spark, "raw-gzip")
    write_raw(lines, path, "gzip")
    return roundtrip_report(lines, restore(spark, path, "raw"))


def q_roundtrip_json_string(spark, sf_dir):
    """S09 + S17 + R09: the JSON-string archive keeps every line byte for byte."""
    configure(spark)
    lines = event_log_lines(spark, sf_dir)
    path = scratch_path(spark, "json-string")
    ingest(lines, "json_string", path)
    return roundtrip_report(lines, restore(spark, path, "json_string"))


def q_roundtrip_ordered(spark, sf_dir):
    """R09 with order: a compressed copy keeps every line in its place; one with
    the lines of each file sorted holds the same lines and is told apart."""
    configure(spark)
    lines = event_log_lines(spark, sf_dir)
    paths = {n: scratch_path(spark, f"ordered-{n}") for n in ("original", "gzip", "json_string", "sorted")}
    write_raw(lines, paths["original"], "none")
    write_raw(lines, paths["gzip"], "gzip")
    ingest(lines, "json_string", paths["json_string"])
    write_raw(lines.sortWithinPartitions(F.desc("line")), paths["sorted"], "none")
    out = None
    for name in ("gzip", "json_string", "sorted"):
        fmt = "json_string" if name == "json_string" else "text"
        row = roundtrip_ordered(spark, paths["original"], paths[name], restored_fmt=fmt).withColumn("copy", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def q_line_count_check(spark, sf_dir):
    """Lines read back from the raw archive vs the catalogue row count."""
    configure(spark)
    lines = event_log_lines(spark, sf_dir)
    path = scratch_path(spark, "raw-lines")
    write_raw(lines, path, "none")
    declared = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").count()
    cat = catalog_frame(spark, [("events-log", "events", declared, "t.$date", "events.log", None, None)])
    return line_count_check(read_lines(spark, path), cat, "events-log")


def q_read_many(spark, sf_dir):
    """A dataset spread over many files in several folders, read with one
    glob; lines counted per source folder from each line's file path."""
    configure(spark)
    base = scratch_path(spark, "many")
    lines = event_log_lines(spark, sf_dir)
    # the folder a line lands in is only used as its provenance label
    lines.withColumn("event_type", F.lower(F.get_json_object("line", "$.c")))\
        .write.partitionBy("event_type").text(base)
    got = read_lines(spark, f"{base}/*/*.txt", provenance=True)
    return (got.groupBy(F.element_at(F.split("source_file", "/"), -2).alias("source_dir"))
            .agg(F.count(F.lit(1)).alias("n_lines")))


def q_ordered_variant(spark, sf_dir):
    """Variant archive ordered by (c, ctx) then event time; Q5 read back."""
    configure(spark)
    lay = get_layout("variant")
    df = lay.build(event_log_lines(spark, sf_dir))
    r = lay.resolver(df)
    df = df.withColumn("c", r.text("c")).withColumn("ctx", r.text("ctx")).withColumn(
        "event_time", F.try_to_timestamp(r.text("t.$date")))
    path = scratch_path(spark, "ordered-variant")
    write_ordered(df, lay, path, keys=["c", "ctx"], timestamp_key="event_time")
    back = read_archive(spark, path, "variant")
    hits = search(back, lay, searches("sql", FIXTURE)["q5"])
    rr = lay.resolver(hits)
    return hits.select(rr.integer(EVENT_ID).alias("event_id"), rr.integer("id").alias("id"),
                       rr.text("ctx").alias("ctx"))


def q_ordered_hot(spark, sf_dir, layout_name: str, form: str, keys: tuple):
    """S15 with hot columns: an archive sorted by typed columns beside the
    VARIANT, read back by a search that skips row groups on them."""
    configure(spark)
    lay = get_layout(layout_name, hot=HOT_PATHS)
    path = scratch_path(spark, f"hot-{layout_name}")
    write_ordered(lay.build(event_log_lines(spark, sf_dir, spread=True)), lay, path, keys=[hot_name(*k) for k in keys])
    hits = search(read_archive(spark, path, layout_name), lay, searches("sql", FIXTURE)[form])
    rr = lay.resolver(hits)
    return hits.select(rr.integer(EVENT_ID).alias("event_id"), rr.integer("id").alias("id"),
                       rr.text("ctx").alias("ctx"))


def q_archive_sizes(spark, sf_dir):
    """A03 + A04: stored bytes per layout archive and the ratio to raw text."""
    configure(spark)
    lines = event_log_lines(spark, sf_dir)
    raw = scratch_path(spark, "raw-size")
    write_raw(lines, raw, "none")
    rows = []
    raw_bytes = archive_size(spark, raw)
    for name in LAYOUTS:
        p = scratch_path(spark, f"size-{name}")
        ingest(lines, name, p)
        rows.append((name, raw_bytes, archive_size(spark, p)))
    df = spark.createDataFrame(rows, "archive string, raw_bytes bigint, stored_bytes bigint")
    return df.withColumn("compression_ratio", compression_ratio(F.col("raw_bytes"), F.col("stored_bytes")))


# the paths that the standard searches Q2, Q4, Q5 and Q6 compare
HOT_PATHS = (("id", "number"), ("c", "text"), ("ctx", "text"), (TS_SEC, "number"))
HOT_ORDER = {"q2": (("id", "number"),), "q5": (("c", "text"), (TS_SEC, "number"))}

QUERIES = {f"archive_roundtrip_{n}": partial(q_archive_roundtrip, layout_name=n) for n in LAYOUTS}
QUERIES.update({f"ordered_hot_{n}_{q}": partial(q_ordered_hot, layout_name=n, form=q, keys=k)
                for n in ("variant", "static_dynamic") for q, k in HOT_ORDER.items()})
QUERIES.update({
    "roundtrip_gzip": q_roundtrip_gzip,
    "roundtrip_json_string": q_roundtrip_json_string,
    "roundtrip_ordered": q_roundtrip_ordered,
    "line_count_check": q_line_count_check,
    "ordered_variant_q5": q_ordered_variant,
    "read_many_provenance": q_read_many,
    "archive_sizes": q_archive_sizes,
})

ROUNDTRIP_SQL = "SELECT count(*) AS n_original, count(*) AS n_restored, true AS equal FROM events"


def oracles() -> dict:
    out = {f"archive_roundtrip_{n}": oracle.search_counts({s: o for s, _, _, o in FORMS_OF_LAYOUT[n]})
           for n in LAYOUTS}
    out.update({f"ordered_hot_{n}_{q}": oracle.search_rows(oracle.SEARCH_SQL[q])
                for n in ("variant", "static_dynamic") for q in HOT_ORDER})
    out.update({
        "roundtrip_gzip": ROUNDTRIP_SQL,
        "roundtrip_json_string": ROUNDTRIP_SQL,
        "roundtrip_ordered": "SELECT copy, n AS n_original, n AS n_restored, copy <> 'sorted' AS equal "
                             "FROM (SELECT count(*) AS n FROM events), (VALUES ('gzip'), ('json_string'), ('sorted')) c(copy)",
        "line_count_check": ("SELECT 'events-log' AS dataset, count(*) AS number_of_lines, "
                             "count(*) AS counted, true AS ok FROM events"),
        "ordered_variant_q5": oracle.search_rows(oracle.SEARCH_SQL["q5"]),
        "read_many_provenance": ("SELECT 'event_type=' || event_type AS source_dir, count(*) AS n_lines "
                                 "FROM events GROUP BY event_type"),
    })
    return out
