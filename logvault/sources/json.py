"""JSON log files opened directly as a layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logvault.layouts import InferredLayout, StaticDynamicLayout, VariantLayout
from logvault.sources.lines import parse_lines, read_lines


def read_json_inferred(spark: SparkSession, path) -> DataFrame:
    """Struct schema inferred over the whole input, case-sensitive names.
    Conflicting types become STRING holding the JSON text."""
    return InferredLayout().from_files(spark, path)


def read_json_declared(spark: SparkSession, path, static=None, dynamic: str = "attr",
                       timestamp_formats: tuple = (), mode: str = "skip") -> DataFrame:
    """Declared typed fields plus one VARIANT for the dynamic rest;
    malformed lines follow the S06 policy ``mode``."""
    kw = {"dynamic": dynamic, "timestamp_formats": timestamp_formats}
    if static is not None:
        kw["static"] = tuple(static)
    parsed, _ = parse_lines(read_lines(spark, path), mode, out="_j")
    return StaticDynamicLayout(**kw).from_variant(parsed, "_j")


def read_json_variant(spark: SparkSession, path, mode: str = "skip") -> tuple[DataFrame, DataFrame]:
    """S05 (+S06): one VARIANT column ``j``; returns ``(events, rejected_lines)``."""
    parsed, rejected = parse_lines(read_lines(spark, path), mode, out=VariantLayout().column)
    return parsed.drop("line"), rejected
