"""R09 with order: whether two archives hold the same lines in the same order, without sorting lines.

The digest of a sequence of lines is a polynomial of their hashes modulo a
prime. Digests of neighbouring pieces combine (the later one is multiplied by
the base to the number of lines before it), so each file split is digested where it is
read, in one scan a side, and two archives agree however their lines are cut
into files and splits. Only a row for each split is shuffled.

Lines are ordered by file path, then by place in the file. Line ends are not
compared: text readers take ``\\n``, ``\\r\\n`` and ``\\r`` alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvault.session import scratch_path

PRIME = (1 << 31) - 1  # products of two residues fit in 64 bits
BASES = (1_103_515_245, 1_664_525_013)  # two digests, 62 bits together
FORMATS = {"text": "value", "json_string": "line"}


def _times(a: Column, b: Column) -> Column:
    return F.pmod(a * b, F.lit(PRIME))


def _power(base: int, k: Column) -> Column:
    """``base ** k`` modulo the prime: a table lookup for each byte of the exponent (k >= 0)."""
    e, out = F.pmod(k, F.lit(PRIME - 1)), None  # base ** (PRIME - 1) is 1
    for j in range(4):
        table = F.expr(f"array({','.join(str(pow(base, x << 8 * j, PRIME)) for x in range(256))})")
        one = F.get(table, F.shiftright(e, 8 * j).bitwiseAND(F.lit(255)).cast("int")).cast("bigint")
        out = one if out is None else _times(out, one)
    return out


def split_digests(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """``file, block, n, d0, d1``: lines and digests of every split of the files under ``path``."""
    if fmt not in FORMATS:
        raise ValueError(f"fmt must be one of {sorted(FORMATS)}")
    line = F.col(FORMATS[fmt])
    src = spark.read.text(path) if fmt == "text" else spark.read.parquet(path)
    # ids rise with the place in a task, and a task reads each of its splits from front to end
    rows = src.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("k"),
                      *[F.pmod(F.xxhash64(line, F.lit(i)), F.lit(PRIME)).alias(f"h{i}") for i in range(len(BASES))])
    sums = rows.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("k").alias("k"),
        *[F.sum(_times(F.col(f"h{i}"), _power(b, F.col("k")))).alias(f"d{i}") for i, b in enumerate(BASES)])
    back = F.lit(PRIME - 1) - F.pmod("k", F.lit(PRIME - 1))  # divides by base ** k: the split starts at 0
    return sums.select("file", "block", "n", *[_times(F.pmod(f"d{i}", F.lit(PRIME)), _power(b, back)).alias(f"d{i}")
                                               for i, b in enumerate(BASES)])


def sequence_digest(spark: SparkSession, path: str, fmt: str = "text") -> DataFrame:
    """One row ``(n_lines, d0, d1)`` that depends on every line and its place."""
    # ranges of splits are written once, so a lost executor cannot cut them another way
    stage = scratch_path(spark, "split-digests")
    split_digests(spark, path, fmt).repartitionByRange("file", "block").withColumn("run", F.spark_partition_id()).write.parquet(stage)
    splits = spark.read.schema("file string, block bigint, n bigint, d0 bigint, d1 bigint, run int").parquet(stage)

    def before(w):
        return F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def combined(df, *keys):
        return df.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), *[
            F.coalesce(F.pmod(F.sum(_times(F.col(f"d{i}"), _power(b, F.col("before")))), F.lit(PRIME)), F.lit(0)).alias(f"d{i}")
            for i, b in enumerate(BASES)])
    runs = combined(splits.withColumn("before", before(Window.partitionBy("run").orderBy("file", "block"))), "run")
    # one row for each shuffle partition is left
    return combined(runs.withColumn("before", before(Window.orderBy("run")))).withColumnRenamed("n", "n_lines")


def roundtrip_ordered(spark: SparkSession, original: str, restored: str, fmt: str = "text",
                      restored_fmt: str = "text") -> DataFrame:
    """One row ``(n_original, n_restored, equal)``: equal lines in equal order."""
    a, b = sequence_digest(spark, original, fmt), sequence_digest(spark, restored, restored_fmt)
    both = a.withColumn("side", F.lit("a")).unionByName(b.withColumn("side", F.lit("b")))
    same = [F.min(c) == F.max(c) for c in ("n_lines", "d0", "d1")]
    return both.agg(F.max(F.when(F.col("side") == "a", F.col("n_lines"))).alias("n_original"),
                    F.max(F.when(F.col("side") == "b", F.col("n_lines"))).alias("n_restored"),
                    (same[0] & same[1] & same[2]).alias("equal"))
