"""Archive quality checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def archive_size(spark: SparkSession, path: str) -> int:
    """Bytes of stored data files under ``path`` (0 when it does not exist).

    File lengths come from the file listing (the content column is never read).
    """
    try:
        files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
                 .select("length"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return 0
        raise
    return int(files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0])


def archive_sizes(spark: SparkSession, paths: dict) -> DataFrame:
    """A03 for several archives -> ``(archive, bytes)``."""
    rows = [(name, archive_size(spark, p)) for name, p in paths.items()]
    return spark.createDataFrame(rows, "archive string, bytes bigint")


def compression_ratio(raw_bytes: Column, stored_bytes: Column) -> Column:
    """Raw / stored; NULL when stored is 0 (see ``ratio_label``)."""
    return F.try_divide(raw_bytes.cast("double"), F.when(stored_bytes != 0, stored_bytes.cast("double")))


def ratio_label(raw_bytes: Column, stored_bytes: Column) -> Column:
    return F.coalesce(compression_ratio(raw_bytes, stored_bytes).cast("string"),
                      F.lit("compression failed: compressed size is 0"))


def ingest_speed(raw_bytes: Column, seconds: Column) -> Column:
    """Raw bytes per second."""
    return F.try_divide(raw_bytes.cast("double"), seconds.cast("double"))


def line_count_check(lines: DataFrame, catalog: DataFrame, dataset: str) -> DataFrame:
    """Counted lines vs the catalogue's ``number_of_lines``."""
    counted = lines.agg(F.count(F.lit(1)).alias("counted")).withColumn("dataset", F.lit(dataset))
    cat = catalog.select("dataset", "number_of_lines")
    return (counted.join(cat, "dataset", "left")
            .select("dataset", "number_of_lines", "counted",
                    F.coalesce(F.col("number_of_lines") == F.col("counted"), F.lit(False)).alias("ok")))


def roundtrip_report(original: DataFrame, restored: DataFrame, col: str = "line") -> DataFrame:
    """One row ``(n_original, n_restored, equal)``.

    Order-independent multiset digest in one aggregation over both sides:
    count and two sums of 64-bit hashes per side, combined map-side (no
    shuffle of lines). Use ``roundtrip_diff`` for the exact differing lines.
    """
    both = (original.select(F.col(col).alias("x"), F.lit(True).alias("a"))
            .unionByName(restored.select(F.col(col).alias("x"), F.lit(False).alias("a"))))
    h1 = F.xxhash64("x").cast("decimal(38,0)")
    h2 = F.xxhash64(F.concat(F.col("x"), F.lit("\u0001"))).cast("decimal(38,0)")

    def side(v, is_a):
        cond = F.col("a") if is_a else ~F.col("a")
        return F.coalesce(F.sum(F.when(cond, v)), F.lit(0))
    d = both.agg(side(F.lit(1), True).alias("n_a"), side(F.lit(1), False).alias("n_b"),
                 side(h1, True).alias("h1_a"), side(h1, False).alias("h1_b"),
                 side(h2, True).alias("h2_a"), side(h2, False).alias("h2_b"))
    return d.select(F.col("n_a").cast("bigint").alias("n_original"), F.col("n_b").cast("bigint").alias("n_restored"),
                    ((F.col("n_a") == F.col("n_b")) & (F.col("h1_a") == F.col("h1_b"))
                     & (F.col("h2_a") == F.col("h2_b"))).alias("equal"))


def roundtrip_diff(original: DataFrame, restored: DataFrame, col: str = "line") -> DataFrame:
    """Exact multiset difference both ways (``side``, ``line``)."""
    a, b = original.select(col), restored.select(col)
    return (a.exceptAll(b).withColumn("side", F.lit("missing"))
            .unionByName(b.exceptAll(a).withColumn("side", F.lit("extra"))))
