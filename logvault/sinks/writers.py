"""Write archives.

All writers are plain DataFrame writes (Parquet zstd level 3 unless noted).
``max_records_per_file`` / ``block_size`` bound file and row-group sizes
(the reference's 256 MB archive target and fixed batch sizes, S10); the
``rebalance`` option adds an AQE rebalance so output files come out evenly
sized even after skewed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.layouts import get_layout
from logvault.layouts.base import Layout

WRITE_MODES = ("overwrite", "append", "errorifexists", "ignore")  # S18
RAW_CODECS = ("gzip", "bzip2", "lz4", "snappy", "deflate", "none")


def _size_opts(max_records_per_file=None, block_size=None, row_group_rows=None) -> dict:
    o = {}
    if max_records_per_file:
        o["max_records_per_file"] = int(max_records_per_file)
    if block_size:
        o["parquet.block.size"] = str(int(block_size))
    if row_group_rows:
        o["parquet.block.row.count.limit"] = str(int(row_group_rows))
    return o


def _staged(df: DataFrame, layout: Layout, target_bytes: int) -> tuple[DataFrame, int]:
    """``df`` written once under the shared scratch folder, and the rows per
    file that give ``target_bytes``: its stored bytes over all its rows."""
    from logvault.operators.quality import archive_size
    from logvault.session import scratch_path
    spark = df.sparkSession
    stage = scratch_path(spark, "sized")
    layout.write(df, stage)
    staged = layout.read(spark, stage)
    per_row = archive_size(spark, stage) / max(1, staged.count())
    return staged, max(1, int(target_bytes / max(1.0, per_row)))


def write_layout(df: DataFrame, layout: Layout | str, path: str, mode: str = "errorifexists",
                 max_records_per_file: int | None = None, block_size: int | None = None,
                 row_group_rows: int | None = None, rebalance: bool = False,
                 target_file_bytes: int | None = None) -> None:
    """Write a built layout DataFrame.

    S10 size bounds: ``max_records_per_file`` (rows per file),
    ``target_file_bytes`` (an upper size, e.g. the reference's 256 MB archives:
    the archive is staged once, its bytes per row set the rows per file, then
    it is copied), ``block_size`` (bytes per row group)
    and ``row_group_rows`` (rows per row group; the reference's fixed batches
    of 10000 / 1000 rows). Large row groups scan fastest, so the defaults
    leave them to Parquet.
    """
    if mode not in WRITE_MODES:
        raise ValueError(f"mode must be one of {WRITE_MODES}")
    lay = get_layout(layout) if isinstance(layout, str) else layout
    if target_file_bytes and not max_records_per_file:
        df, max_records_per_file = _staged(df, lay, int(target_file_bytes))
    if rebalance:
        df = df.hint("rebalance")
    lay.write(df, path, mode=mode, **_size_opts(max_records_per_file, block_size, row_group_rows))


def ingest(lines: DataFrame, layout: Layout | str, path: str, mode: str = "errorifexists", **kw) -> None:
    """Lines -> layout -> archive, one job (the reference's ingest phase)."""
    lay = get_layout(layout) if isinstance(layout, str) else layout
    write_layout(lay.build(lines), lay, path, mode=mode, **kw)


def write_json_string(df: DataFrame, path: str, **kw) -> None:  # S09
    write_layout(df.select("line"), "json_string", path, **kw)


def ordered(df: DataFrame, keys: list, extra: list | None = None, timestamp_key=None,
            partitions: int | None = None) -> DataFrame:
    """S15 ordering: ``order_by = keys + extras not in keys`` (+ time key).

    Range partitioning uses the whole sort order and then a hash of the row and
    the input partition, so one hot key is spread over several ranges, with or
    without later sort columns and even among equal rows; within a partition rows are sorted (NULLS FIRST) so Parquet
    row-group min/max statistics can skip data on the keys. Without an
    explicit ``partitions`` the range count is the cluster's
    ``spark.sql.shuffle.partitions`` and AQE may coalesce small ranges.
    """
    order = list(keys) + [c for c in (extra or []) if c not in keys]
    if timestamp_key is not None and timestamp_key not in order:
        order.append(timestamp_key)
    cols = [(F.col(c) if isinstance(c, str) else c).asc_nulls_first() for c in order]
    # both are the same when a lost input partition is computed again
    tied = df.withColumn("_tie", F.xxhash64(F.to_json(F.struct("*")))).withColumn("_part", F.spark_partition_id())
    by = [*cols, F.col("_tie"), F.col("_part")]
    ranged = tied.repartitionByRange(partitions, *by) if partitions else tied.repartitionByRange(*by)
    return ranged.sortWithinPartitions(*cols).drop("_tie", "_part")


def write_ordered(df: DataFrame, layout: Layout | str, path: str, keys: list, extra: list | None = None,
                  timestamp_key=None, mode: str = "errorifexists", **kw) -> None:  # S15
    write_layout(ordered(df, keys, extra, timestamp_key), layout, path, mode=mode, **kw)


def write_raw(lines: DataFrame, path: str, codec: str = "gzip", mode: str = "errorifexists",
              max_records_per_file: int | None = None) -> None:
    """Compressed text (L7). Stock Spark has no zstd text codec; the
    zstd archive form is the JSON-string layout (S09)."""
    if codec not in RAW_CODECS:
        raise ValueError(f"codec must be one of {RAW_CODECS}")
    w = lines.select("line").write.mode(mode).option("compression", codec)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    w.text(path)


def restore(spark: SparkSession, path: str, layout: str = "raw") -> DataFrame:
    """Archive back to ``line`` text (raw text or JSON-string layout)."""
    if layout == "raw":
        return spark.read.text(path).select(F.col("value").alias("line"))
    if layout == "json_string":
        return spark.read.parquet(path).select("line")
    raise ValueError("restorable layouts: raw, json_string (others do not keep the line bytes)")


def write_report(report: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """One directory per sheet (``sheet=<name>``)."""
    w = report.write.mode(mode).partitionBy("sheet")
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.parquet(path)


def ingest_files(spark: SparkSession, src, layout: Layout | str, path: str, malformed: str = "fail",
                 blank: str = "empty", mode: str = "errorifexists", **kw) -> DataFrame:
    """Log files (path, directory or glob) -> archive, the way a dataset is loaded.

    ``malformed``: ``fail`` (a bad line fails the job, on every layout),
    ``skip`` (bad lines are left out and returned), ``keep`` (stored as they
    are; only the JSON-string layout can hold them). The inferred layout infers its schema
    straight from the files. Returns the rejected lines (lazy; empty unless
    ``skip``).
    """
    from logvault.layouts import InferredLayout
    from logvault.sources.lines import parse_lines, read_lines
    lay = get_layout(layout) if isinstance(layout, str) else layout
    lines = read_lines(spark, src, blank=blank)
    rejected = lines.limit(0)
    parsed = None
    if malformed == "skip":
        parsed, rejected = parse_lines(lines, "skip", out="_ok")
        lines = parsed.drop("_ok")
    elif malformed == "keep" and lay.name != "json_string":
        raise ValueError("only the json_string layout stores malformed lines as they are")
    elif malformed == "fail" and lay.name == "json_string":
        # the text layout never parses; validate so a bad line fails the job
        lines = lines.filter(F.parse_json("line").isNotNull())
    elif malformed not in ("fail", "keep"):
        raise ValueError("malformed must be fail, skip or keep")
    if isinstance(lay, InferredLayout) and malformed != "skip":
        df = lay.from_files(spark, src)
        if malformed == "fail" and "_corrupt_record" in df.columns:
            raise ValueError("malformed lines found while inferring the schema; use malformed='skip'")
    elif parsed is not None and hasattr(lay, "from_variant"):
        df = lay.from_variant(parsed, "_ok")  # already parsed: no second parse
    else:
        df = lay.build(lines)
    write_layout(df, lay, path, mode=mode, **kw)
    return rejected
