"""S18 without a half-written archive: parts written beside each other, and a manifest that readers follow.

A write puts its rows into a folder of its own under ``parts`` and then appends
one row to ``manifest``; that row, one file, is what makes the part visible. A
write that fails leaves the archive as it was. ``overwrite`` hides all earlier
parts at once, and they can still be read by ``version`` until they are removed.

One writer at a time may replace an archive. The manifest has a row for each
write, which is what the driver reads; rows of the archive never pass it.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from logvault.layouts import get_layout
from logvault.layouts.base import Layout
from logvault.sinks.writers import WRITE_MODES, write_layout

MANIFEST = "seq bigint, part string, replaces boolean, note string"


def manifest(spark: SparkSession, path: str) -> list[Row]:
    """All writes of an archive in their order; empty where there is none."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = []
    return sorted(rows, key=lambda r: (r["seq"], r["part"]))


def live_parts(spark: SparkSession, path: str, version: int | None = None) -> list[Row]:
    """The writes that make up an archive, or made it up at ``version``."""
    live = []
    for r in manifest(spark, path):
        if version is None or r["seq"] <= version:
            live = [r] if r["replaces"] else [*live, r]
    return live


def commit_part(spark: SparkSession, path: str, part: str, replaces: bool = False, note: str | None = None) -> int:
    """Make a written part visible; returns the version."""
    seq = max([r["seq"] for r in manifest(spark, path)], default=0) + 1
    row = spark.createDataFrame([(seq, part, replaces, note)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return seq


def parts_path(path: str, parts: list[str]) -> str:
    """One path for several parts."""
    return f"{path}/parts/{{{','.join(parts)}}}"


def write_version(df: DataFrame, layout: Layout | str, path: str, mode: str = "errorifexists", **kw) -> int | None:
    """``write_layout`` whose result appears as a whole or not at all; returns
    the version (None if ``ignore`` found an archive)."""
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}")
    spark = df.sparkSession
    if mode in ("errorifexists", "ignore") and live_parts(spark, path):
        if mode == "ignore":
            return None
        raise ValueError(f"archive {path} exists")
    part = uuid.uuid4().hex
    write_layout(df, layout, f"{path}/parts/{part}", **kw)
    return commit_part(spark, path, part, replaces=mode == "overwrite")


def read_version(spark: SparkSession, path: str, layout: Layout | str = "variant",
                 version: int | None = None) -> DataFrame:
    """The archive as its last write left it, or as it was at ``version``.

    A DataFrame keeps the parts it was opened with, also while others are written."""
    lay = get_layout(layout) if isinstance(layout, str) else layout
    parts = [r["part"] for r in live_parts(spark, path, version)]
    if not parts:
        raise ValueError(f"no archive in {path}")
    return lay.read(spark, parts_path(path, parts))
