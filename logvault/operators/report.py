"""Result documents -> long metrics -> wide report.

Result documents have the shape ``{dataset: {config_json: {"ingest": {...},
"query_cold": [{...}, ...], "query_hot": [...]}}}`` (one per tool run or
file). Everything stays in long form until the final pivot, whose column set
has one column per methodology.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT_SCHEMA = ("map<string, map<string, struct<ingest: map<string,string>, "
                 "query_cold: array<map<string,string>>, query_hot: array<map<string,string>>>>>")
# Ingest metrics reported in MB (bytes / 1048576).
MB_METRICS = {"memory_average_B": "memory_average_MB", "compressed_size_B": "compressed_size_MB",
              "decompressed_size_B": "decompressed_size_MB"}
MIB = 1024 * 1024


def read_results(docs: DataFrame, doc_col: str = "doc", tool_col: str = "tool") -> DataFrame:
    """Documents -> ``(tool, dataset, config, phase, query_ind, metric, value, start_time)``.

    ``value`` is the metric as text (numbers and times share one column).
    Query lists keep their positions (``query_ind``); null entries are skipped.
    """
    m = docs.select(F.col(tool_col).alias("tool"), F.from_json(F.col(doc_col), RESULT_SCHEMA).alias("m"))
    ds = m.select("tool", F.explode("m").alias("dataset", "cfgs"))
    cf = ds.select("tool", "dataset", F.explode("cfgs").alias("config", "r"))
    entries = F.concat(
        F.array(F.struct(F.lit("ingest").alias("phase"), F.lit(None).cast("int").alias("query_ind"),
                         F.col("r.ingest").alias("kv"))),
        F.coalesce(F.transform("r.query_cold", lambda x, i: F.struct(
            F.lit("cold").alias("phase"), i.alias("query_ind"), x.alias("kv"))), F.array()),
        F.coalesce(F.transform("r.query_hot", lambda x, i: F.struct(
            F.lit("hot").alias("phase"), i.alias("query_ind"), x.alias("kv"))), F.array()))
    allp = (cf.select("tool", "dataset", "config", F.explode(entries).alias("e"))
            .select("tool", "dataset", "config", "e.*").filter(F.col("kv").isNotNull()))
    return (allp.select("tool", "dataset", "config", "phase", "query_ind",
                        F.col("kv")["start_time"].alias("start_time"), F.explode("kv").alias("metric", "value"))
            .filter(F.col("metric") != "start_time"))


def read_result_files(spark, glob: str) -> DataFrame:
    """Result files (one JSON document per file, e.g. ``<tool>/output.json``)
    -> ``(tool, doc)``; the tool is the name of the file's folder. Each file
    is one small document, read whole."""
    raw = spark.read.text(glob, wholetext=True)
    return raw.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("tool"),
                      F.col("value").alias("doc"))


def methodology_label(tool: Column, config: Column) -> Column:
    """``tool (k=v, k=v)`` from the configuration JSON (source key order)."""
    m = F.from_json(config, "map<string,string>")
    kv = F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(tool, F.lit(" ("), F.coalesce(F.array_join(kv, ", "), F.lit("")), F.lit(")"))


def sheet_label(dataset: Column, kind: str) -> Column:
    """``<dataset> (ingest|search|result)``."""
    return F.concat(dataset, F.lit(f" ({kind})"))


def query_metric_label(query_ind: Column, phase: Column) -> Column:
    """``q<i>_cold`` / ``q<i>_hot``."""
    return F.concat(F.lit("q"), query_ind.cast("string"), F.lit("_"), phase)


def unit_columns(metric: Column, value: Column) -> tuple[Column, Column]:
    """A10: bytes -> MB for the three named ingest metrics (-1, "no sample", has
    no MB value: NULL); others unchanged."""
    name = F.coalesce(*[F.when(metric == k, F.lit(v)) for k, v in MB_METRICS.items()], metric)
    val = F.when(metric.isin(*MB_METRICS), F.nullif(value, F.lit(-1.0)) / F.lit(float(MIB))).otherwise(value)
    return name, val


def report_long(results: DataFrame) -> DataFrame:
    """Long report rows ``(sheet, methodology, metric, value, start_time)``.

    Ingest sheet: metrics (A10 units) plus ``compression_ratio`` (A04).
    Search/result sheets: per-query time and hits, and the mean memory over a
    phase's queries with -1 samples excluded (A08) -- only for
    (tool, dataset, config) that have both cold and hot runs.
    """
    r = results.withColumn("methodology", methodology_label(F.col("tool"), F.col("config")))
    num = F.col("value").try_cast("double")
    is_q = F.col("phase").isin("cold", "hot")
    # (tool, dataset, config) with both cold and hot runs; queries of others are left out
    both = (r.filter(is_q).groupBy("tool", "dataset", "config")
            .agg(F.countDistinct("phase").alias("_np")).filter(F.col("_np") == 2)
            .select("tool", "dataset", "config", F.lit(True).alias("_both")))
    r = r.join(both, ["tool", "dataset", "config"], "left").filter(
        (F.col("phase") == "ingest") | F.coalesce(F.col("_both"), F.lit(False)))
    # cells read directly off one result row: ingest metrics, query time, query hits
    mb_name, mb_val = unit_columns(F.col("metric"), num)
    qlabel = query_metric_label(F.col("query_ind"), F.col("phase"))
    direct = r.select(
        F.when(F.col("phase") == "ingest", sheet_label(F.col("dataset"), "ingest"))
        .when(F.col("metric") == "time_taken_s", sheet_label(F.col("dataset"), "search"))
        .when(F.col("metric") == "result", sheet_label(F.col("dataset"), "result")).alias("sheet"),
        "methodology",
        F.when(F.col("phase") == "ingest", mb_name).otherwise(qlabel).alias("metric"),
        F.when(F.col("phase") == "ingest", mb_val).otherwise(num).alias("value"),
        "start_time").filter(F.col("sheet").isNotNull())
    # cells aggregated over several rows: compression ratio (A04), query memory
    ing = r.filter(F.col("phase") == "ingest")
    latest = (ing.filter(F.col("metric").isin("decompressed_size_B", "compressed_size_B"))
              .groupBy("dataset", "methodology", "metric")
              .agg(F.max_by(num, F.struct(F.col("start_time"), num)).alias("v"),
                   F.max("start_time").alias("start_time")))
    ratio = (latest.groupBy("dataset", "methodology")
             .agg(F.max(F.when(F.col("metric") == "decompressed_size_B", F.col("v"))).alias("d"),
                  F.max(F.when(F.col("metric") == "compressed_size_B", F.col("v"))).alias("c"),
                  F.max("start_time").alias("start_time"))
             .select(sheet_label(F.col("dataset"), "ingest").alias("sheet"), "methodology",
                     F.lit("compression_ratio").alias("metric"),
                     F.try_divide(F.col("d"), F.when(F.col("c") != 0, F.col("c"))).alias("value"),
                     "start_time"))
    mem = (r.filter(is_q & (F.col("metric") == "memory_average_B") & (num != -1))
           .groupBy("dataset", "methodology", "phase")
           .agg((F.avg(num) / F.lit(float(MIB))).alias("value"), F.max("start_time").alias("start_time"))
           .select(sheet_label(F.col("dataset"), "search").alias("sheet"), "methodology",
                   F.concat(F.lit("memory_average_"), F.col("phase"), F.lit("_MB")).alias("metric"),
                   "value", "start_time"))
    return direct.unionByName(ratio).unionByName(mem)


def report(long: DataFrame, methodologies: list[str] | None = None) -> DataFrame:
    """One row per (sheet, metric), one column per methodology.

    A cell recorded more than once keeps the latest value (by start time).
    Without a methodology list Spark's pivot finds the columns; the long form
    serves readers that want no wide one.
    """
    cell = F.max_by(F.col("value"), F.struct(F.col("start_time"), F.col("value")))
    return (long.groupBy("sheet", "metric").pivot("methodology", methodologies).agg(cell)
            .orderBy("sheet", "metric"))
