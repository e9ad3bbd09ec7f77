"""Dataset catalogue (one row per dataset).

A dataset directory holds the log file(s) and a ``metadata.yaml`` of flat
``key: value`` lines (source, number_of_lines, timestamp, normal_log,
cleaned_log, base32_log). Joins against it carry no broadcast hint: Spark
broadcasts by measured bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = ("dataset string, source string, number_of_lines bigint, timestamp_key string, "
                  "normal_log string, cleaned_log string, base32_log string")


def read_catalog(spark: SparkSession, glob: str) -> DataFrame:
    """Read ``<dataset>/metadata.yaml`` files (glob) into catalogue rows."""
    raw = spark.read.text(glob, wholetext=True).select(
        F.col("value").alias("text"), F.col("_metadata.file_path").alias("file"))
    kv = raw.select("file", F.explode(F.split("text", "\n")).alias("l")).filter(F.col("l").contains(":"))
    kv = kv.select("file", F.trim(F.substring_index("l", ":", 1)).alias("k"),
                   F.trim(F.expr("substring(l, instr(l, ':') + 1)")).alias("v"))
    m = kv.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return m.select(
        F.element_at(F.split("file", "/"), -2).alias("dataset"),
        F.col("m")["source"].alias("source"),
        F.col("m")["number_of_lines"].try_cast("bigint").alias("number_of_lines"),
        F.col("m")["timestamp"].alias("timestamp_key"),
        F.col("m")["normal_log"].alias("normal_log"),
        F.col("m")["cleaned_log"].alias("cleaned_log"),
        F.col("m")["base32_log"].alias("base32_log"))


def catalog_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def lookup_catalog(df: DataFrame, catalog: DataFrame, dataset_col: str = "dataset",
                   fields: tuple = ("timestamp_key", "normal_log")) -> DataFrame:
    """Attach catalogue fields (time key, file) to rows by dataset name.
    An equi-join: Spark broadcasts the catalogue while its bytes allow it."""
    cat = catalog.select(F.col("dataset").alias(dataset_col), *fields)
    return df.join(cat, dataset_col, "left")
