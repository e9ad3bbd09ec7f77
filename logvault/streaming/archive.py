"""T02 with a malformed-line policy and drifting schemas: a stream into a versioned archive.

Each micro-batch is parsed once and written as one part of the archive
(``sinks.versions``); lines that are no JSON go to a part of the same name under
``rejected``. One manifest row then shows both, so events and rejected lines
appear together and exactly once: a batch that a restart repeats finds its row,
or overwrites what it had left unfinished. The merged-types layout writes each part under
the schema that all parts so far agree on, and reads them under the merged one.
"""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from logvault.layouts import get_layout
from logvault.layouts.base import Layout
from logvault.layouts.evolve import conform, merge_schemas, rest_names
from logvault.layouts.layouts import MergedLayout, merged_schema
from logvault.sinks.versions import commit_part, live_parts, parts_path, read_version
from logvault.streaming.ingest import line_stream

POLICIES = ("skip", "fail")
QUERY_ID = "sql.streaming.queryId"


def _agreed(parts) -> tuple[T.StructType, set]:
    """The schema of all parts, and the names that some part keeps without a type."""
    notes = [json.loads(n) for n in sorted({p["note"] for p in parts})]
    untyped = {n for x in notes for n in x["untyped"]}
    return merge_schemas([T.StructType.fromJson(x["schema"]) for x in notes], untyped), untyped


def _write_part(spark, parsed: DataFrame, lay: Layout, path: str, part: str) -> str | None:
    """Write parsed rows (``line``, ``j``) as one part; returns its manifest note."""
    target = f"{path}/parts/{part}"
    if isinstance(lay, MergedLayout):
        before, untyped = _agreed(live_parts(spark, path))
        schema = merge_schemas([before, merged_schema(parsed)], untyped)
        MergedLayout.write(lay, MergedLayout(schema=schema).from_variant(parsed, "j"), target, mode="overwrite")
        return json.dumps({"schema": schema.jsonValue(), "untyped": rest_names(lay.read(spark, target))}, sort_keys=True)
    df = lay.from_variant(parsed, "j") if hasattr(lay, "from_variant") else lay.build(parsed.drop("j"))
    lay.write(df, target, mode="overwrite")
    return None


def archive_stream(spark: SparkSession, src: str, dst: str, layout: Layout | str, checkpoint: str,
                   malformed: str = "skip", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start a stream that archives the log files of ``src`` and stops when all are taken.

    ``malformed``: ``skip`` sets bad lines aside (``read_rejected``); ``fail``
    ends the stream at the first one, with nothing of its batch in the archive.
    """
    lay = get_layout(layout) if isinstance(layout, str) else layout
    if malformed not in POLICIES:
        raise ValueError(f"malformed must be one of {POLICIES}")
    if lay.name == "inferred":
        raise ValueError("use the merged layout: its parts keep every type they meet")

    def take(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        # the query's id is stored in its checkpoint: another stream has other parts
        part = f"{s.sparkContext.getLocalProperty(QUERY_ID)}-{batch_id:010d}"
        if any(p["part"] == part for p in live_parts(s, dst)):
            return
        lines = batch.withColumn("j", F.parse_json("line") if malformed == "fail" else F.try_parse_json("line"))
        lines.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            lines.filter(F.col("j").isNull()).select("line").write.mode("overwrite").parquet(f"{dst}/rejected/{part}")
            note = _write_part(s, lines.filter(F.col("j").isNotNull()), lay, dst, part)
        finally:
            lines.unpersist()
        commit_part(s, dst, part, note=note)

    return (line_stream(spark, src, max_files_per_trigger).writeStream.foreachBatch(take)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def read_stream_archive(spark: SparkSession, path: str, layout: Layout | str = "variant") -> DataFrame:
    """The archive of ``archive_stream``; parts of differing schemas are read
    with one scan for each schema, not for each part."""
    lay = get_layout(layout) if isinstance(layout, str) else layout
    if not isinstance(lay, MergedLayout):
        return read_version(spark, path, lay)
    parts = live_parts(spark, path)
    if not parts:
        raise ValueError(f"no archive in {path}")
    schema, _ = _agreed(parts)
    by_schema: dict = {}
    for p in parts:
        own = json.dumps(json.loads(p["note"])["schema"], sort_keys=True)
        by_schema.setdefault(own, []).append(p["part"])
    out = None
    for own, names in by_schema.items():
        df = conform(lay.read(spark, parts_path(path, names)), T.StructType.fromJson(json.loads(own)), schema)
        out = df if out is None else out.unionByName(df)
    return out


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    """The lines that were no JSON, of all batches in the archive."""
    names = [p["part"] for p in live_parts(spark, path)]
    if not names:
        return spark.createDataFrame([], "line string")
    return spark.read.schema("line string").parquet(f"{path}/rejected/{{{','.join(names)}}}")
